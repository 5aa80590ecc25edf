"""Bounded samples to fit models on."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: hashes are cut to so many bits where they are compared with a share
BITS = 30


def _least(size: int, n: int) -> int:
    """The hash, of BITS bits, below which about twice `size` of n rows lie."""
    return int(min(1.0, (2 * size + 100) / max(n, 1)) * (1 << BITS))


def bounded(rows: DataFrame, size: int, *keys: str, n: int | None = None) -> DataFrame:
    """At most `size` rows, those of the least hash of the keys; the same for the same rows.

    Only about twice the sample is ordered, however many rows and partitions there are. n: the number of rows, or a cheap bound
    on it (with a bound the sample may be smaller); counted if not given. The keys should tell rows apart, or copies are taken together.
    """
    h = F.xxhash64(*keys)
    return rows.where(F.pmod(h, F.lit(1 << BITS)) <= _least(size, rows.count() if n is None else n)).orderBy(h, *keys).limit(size)


def bounded_by(rows: DataFrame, size: int, group: str, counts: dict, *keys: str) -> DataFrame:
    """bounded() for each value of a group in one pass; counts: the rows of each value, of which others are left out."""
    h = F.xxhash64(*keys)
    least = F.lit(None).cast("long")
    for value, n in counts.items():
        least = F.when(F.col(group) == value, F.lit(_least(size, n))).otherwise(least)
    some = rows.where(F.pmod(h, F.lit(1 << BITS)) <= least)
    return some.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(h, *keys))).where(F.col("_nth") <= size).drop("_nth")
