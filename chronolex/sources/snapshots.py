"""Snapshots of a corpus: its tables compressed into one folder with a manifest, and their restoration."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators import store


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, first_ts, last_ts): the size of every table, and the span of documents, whose clocks `sources` tells."""
    out = None
    for name, df in tables.items():
        d = store.dated(df, tables["sources"]) if name == "documents" else df.withColumn("ts", F.lit(None).cast("long"))
        row = d.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        out = row if out is None else out.unionByName(row)
    return out


def snapshot(tables: dict[str, DataFrame], folder: str, force: bool = False) -> DataFrame:
    """Writes the tables below folder and returns their manifest; fails where the folder has them already, unless forced."""
    mode = "overwrite" if force else "errorifexists"
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode(mode).option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
    manifest({name: spark.read.parquet(f"{folder}/{name}.parquet") for name in tables}).coalesce(1).write.mode(mode).parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def restore(spark: SparkSession, folder: str, into: str, force: bool = False) -> DataFrame:
    """Copies a snapshot's tables into a folder, and fails unless every table has the rows of the manifest."""
    told = {r["name"]: r["rows"] for r in spark.read.parquet(f"{folder}/manifest").select("name", "rows").collect()}
    mode = "overwrite" if force else "errorifexists"
    for name in told:
        spark.read.parquet(f"{folder}/{name}.parquet").write.mode(mode).option("compression", "zstd").parquet(f"{into}/{name}.parquet")
    now = manifest({name: spark.read.parquet(f"{into}/{name}.parquet") for name in told})
    short = [r["name"] for r in now.collect() if r["rows"] != told[r["name"]]]
    if short:
        raise ValueError(f"restored tables differ from the manifest: {short}")
    return now
