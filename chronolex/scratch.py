"""Tables written to the shared folder that the session names, to cut lineage and survive lost executors.

Only paths that this module itself has made in this process are ever deleted, each by its exact name.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: paths of this process's tables that still stand
_made: set[str] = set()
_local = threading.local()


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the folder that nothing has yet; it may be deleted by delete()."""
    path = f"{folder(spark)}/chronolex/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    for made in getattr(_local, "open", []):
        made.append(path)
    return path


def written(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again."""
    path = new_path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def written_singly(df: DataFrame, name: str = "table") -> DataFrame:
    """written(), with rows handed to Python one by one: for rows of many MB, of which a batch would hold several in each worker and JVM."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = conf.get(key)
    conf.set(key, "1")
    try:
        return written(df, name)
    finally:
        conf.set(key, most)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its scan has fewer splits than there are; a table of many files stays as it is and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path that new_path() made; any other path is left alone."""
    if path in _made:
        _made.discard(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Deletes a table made by written() that is needed no more; does nothing for other frames."""
    path = df.__dict__.get("_scratch_path")
    if path:
        delete(df.sparkSession, path)


def settled(build: Callable[[], DataFrame], name: str = "result", keep: tuple[str, ...] = ()) -> DataFrame:
    """What build() returns, written; the tables that were written on the way are deleted, but for the paths in keep."""
    made: list[str] = []
    _local.open = [*getattr(_local, "open", []), made]
    try:
        out = written(build(), name)
    finally:
        _local.open = _local.open[:-1]
    for path in made:
        if path != out._scratch_path and path not in keep:
            delete(out.sparkSession, path)
    return out


_kept: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries of a session read, built at its first use; built anew once its files are gone."""
    key = (spark.sparkContext.applicationId, *key)
    have = _kept.get(key)
    if have is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(have._scratch_path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return have
    outer, _local.open = getattr(_local, "open", []), []
    try:
        _kept[key] = settled(build, str(key[1]))
    finally:
        _local.open = outer
    return _kept[key]


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this process that still stand; results that were not copied elsewhere go with them."""
    for path in list(_made):
        delete(spark, path)
