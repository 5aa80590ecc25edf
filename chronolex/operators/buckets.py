"""Pairs of rows that share a bucket, without all pairs of a hot one.

Rows are sets of elements that are linked only if they share at least so many of them. Two such sets share one of the
rarest of either's elements (all but the needed ones, plus one), so in a hot bucket, where what all have in common
makes no link, rows need to meet only by elements that are rare among them. That loses no link.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex import scratch

#: members of a bucket that may meet in pairs
HOT = 256


def rare_keys(sets: DataFrame, needed: Column) -> DataFrame:
    """(key, id): the rarest elements of each set, all but `needed` of them plus one; those that no other set has are left out.

    sets: (id, elements, ...). The order is that of the number of sets that have an element, then of the element.
    """
    e = sets.select("id", (F.size("elements") - needed + 1).alias("_keep"), F.explode("elements").alias("key"))
    df = e.groupBy("key").agg(F.count("*").alias("_df"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("_df", "key"))
    return e.join(df, "key").withColumn("_nth", nth).where((F.col("_nth") <= F.col("_keep")) & (F.col("_df") > 1)).select("key", "id")


def cross_pairs(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], needed: Column, near: Column | None = None, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: pairs of rows of one bucket whose classes differ, each once.

    members: (key, id, c) and columns that `near` asks about as {column}_x and {column}_y. Buckets of more than `hot` members are
    taken apart by rare_keys(), for which sets_of(ids) gives (id, elements) of the rows in them.
    """
    size = members.groupBy("key").agg(F.count("*").alias("_m")).where(F.col("_m") > hot).select("key")
    large = scratch.written(size, "hot")
    if not large.isEmpty():
        rows = scratch.written(members.join(large, "key", "left_semi").drop("key").distinct(), "hot-rows")
        rare = rare_keys(sets_of(rows.select("id")), needed).join(rows, "id")
        members = members.join(large, "key", "left_anti").unionByName(rare.select(*members.columns))
    rest = [c for c in members.columns if c != "key"]
    x, y = (members.select("key", *[F.col(c).alias(f"{c}_{s}") for c in rest]) for s in "xy")
    on = (F.col("id_x") < F.col("id_y")) & (F.col("c_x") != F.col("c_y"))
    return x.join(y, "key").where(on if near is None else on & near).select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()
