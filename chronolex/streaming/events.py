"""Windows over a stream of events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex import scratch
from chronolex.operators import store


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) by tumbling window; events later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def once_each(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream holds now, written to the shared folder and read again.

    Without keys in append mode, which leaves out groups that the watermark hasn't closed. With keys (those of
    the stream's groups) in update mode: the last row of each key counts, so open groups come too.
    """
    spark: SparkSession = stream.sparkSession
    path, state = scratch.new_path(spark, name), scratch.new_path(spark, f"{name}-state")
    if keys:
        put = lambda rows, n: rows.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/part={n}")
        stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(f"{stream.schema.toDDL()}, _batch long").parquet(f"{path}/part=*")
        rest = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*keys, "_row.*").select(*stream.columns)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upserted(stream: DataFrame, name: str, keys: list[str], order: list) -> DataFrame:
    """The last row in order of each key, kept up batch by batch: each micro-batch is merged into the table so far.

    A version of the table is written per micro-batch and read by the next, so that a repeated batch gives the same version; the
    last one is returned. A stream without rows gives an empty table.
    """
    spark: SparkSession = stream.sparkSession
    path, state = scratch.new_path(spark, name), scratch.new_path(spark, f"{name}-state")
    done: list[int] = []

    def merge(rows: DataFrame, n: int) -> None:
        old = spark.read.schema(rows.schema).parquet(f"{path}/v={done[-1]}") if done else rows.where("false")
        store.last_wins(old.unionByName(rows), keys, order).write.mode("overwrite").parquet(f"{path}/v={n}")
        done.append(n)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/v={done[-1]}") if done else spark.createDataFrame([], stream.schema)
