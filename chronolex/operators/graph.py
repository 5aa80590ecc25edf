"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. large: each node hands its larger neighbours to the least one; else its smaller ones."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of an edge table; component is the least id of the nodes connected.

    Nulls and loops are left out, repeated edges count once, an empty table gives an empty one. Each
    round groups with map-side combining, joins on the node (a hot node is split by the adaptive
    skew join) and writes its edges to the shared folder; a star needs one round, a chain of n nodes
    about log n.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    last = None
    for _ in range(most_rounds):
        e = scratch.written(_star(_star(e, True), False), "components")
        if last is not None:
            scratch.drop(last)
        last = e
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))
        if ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low + top > 1").isEmpty():
            break  # each node points once, at a node that points nowhere
    else:
        raise RuntimeError("the components have not settled")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
