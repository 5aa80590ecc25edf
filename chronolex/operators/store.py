"""The dated corpus: times, slices, verdicts, and writes with their rules for conflicts.

Nulls: a null key never conflicts and is kept; null times fall out of slices. Empty tables give empty results.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators import timestamps

#: fixed values: weights of relations, for evidence before a claim and after it
PRIOR_WEIGHTS = {"identical": 1.0, "paraphrase": 0.95, "subsumes": 0.85, "partial": 0.45, "topical": 0.05, "unrelated": 0.0}
LATER_WEIGHTS = {"states": 1.0, "entails": 0.9, "anticipates_directionally": 0.5, "partially_anticipates": 0.3, "orthogonal": 0.0, "contradicts": -1.0}
#: fixed values: relations that take a claim's novelty away
DEFEATS = ["identical", "paraphrase", "subsumes"]


def dated(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs with `ts`, the published instant, or that of retrieval where published_at fixes none, and `told`, whether it does.

    Only queries that ask for a time pay for reading it; other columns pass by. Sources are joined by id.
    """
    ts = timestamps.instants(docs.sparkSession)("published_at", "date_provenance", "_tz", "_order")
    known = timestamps.known_clocks(sources)
    d = docs.join(known, F.col("source_id") == F.col("_source"), "left").withColumn("_utc", ts)
    return d.withColumn("ts", F.coalesce("_utc", F.unix_timestamp("retrieved_at"))).withColumn("told", F.col("_utc").isNotNull()).drop("_utc", "_source", "_tz", "_order")


def time_slice(docs: DataFrame, before: Column | int | None = None, after: Column | int | None = None, ts: str = "ts", exclude_source: str | None = None) -> DataFrame:
    """Rows strictly before and after the given times (each optional), without a source; rows without source stay."""
    if before is not None:
        docs = docs.where(F.col(ts) < before)
    if after is not None:
        docs = docs.where(F.col(ts) > after)
    return docs if exclude_source is None else docs.where(F.coalesce(F.col("source_id") != exclude_source, F.lit(True)))


def first_wins(existing: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """existing with those rows of new whose key isn't there yet; of several new ones the first in order."""
    least = new.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in new.columns if c not in keys]), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*new.columns)
    return existing.unionByName(least.join(existing.select(*keys), keys, "left_anti"))


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of the rows of a key the last in order. Combined map-side, so a key of many rows is no single task's work."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def merged_sources(rows: DataFrame) -> DataFrame:
    """One row per source id: kind and metadata of the first seen, name and domain of the last that has them."""
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seen_at", "name")))
    return rows.groupBy("id").agg(F.min_by("kind", F.struct("seen_at", "name")).alias("kind"), at("name").alias("name"), at("domain").alias("domain"))


def weight_of(direction: Column, relation: Column) -> Column:
    """The weight of a relation; null for one that its direction doesn't know."""
    weight = F.lit(None).cast("double")
    for name, table in (("prior", PRIOR_WEIGHTS), ("later", LATER_WEIGHTS)):
        for known, w in table.items():
            weight = F.when((direction == name) & (relation == known), F.lit(w)).otherwise(weight)
    return weight


def first_verdicts(judgements: DataFrame) -> DataFrame:
    """The first verdict of each (claim_id, doc_id, direction): relation, weight, conf in 0..1, quote, attributes_source.

    Unknown relations (letter case counts) are read as unrelated before a claim and as orthogonal after it, a missing
    confidence as 0.5. Rows of another direction fall out.
    """
    order = F.struct("judged_at", "relation", F.coalesce("confidence", F.lit(-1.0)), F.coalesce("quote", F.lit("")))
    first = judgements.where("direction in ('prior', 'later')").groupBy("claim_id", "doc_id", "direction").agg(F.min_by(F.struct("relation", "confidence", "quote", "attributes_source"), order).alias("r")).select("claim_id", "doc_id", "direction", "r.*")
    none = F.when(F.col("direction") == "prior", "unrelated").otherwise("orthogonal")
    first = first.withColumn("relation", F.when(weight_of(F.col("direction"), F.col("relation")).isNull(), none).otherwise(F.col("relation")))
    conf = F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return first.select("claim_id", "doc_id", "direction", "relation", weight_of(F.col("direction"), F.col("relation")).alias("weight"), conf.alias("conf"), "quote", "attributes_source")


def stable_id(*parts: str) -> Column:
    """First 32 hex digits of the SHA-256 of the parts, each followed by a zero byte."""
    zero = F.unhex(F.lit("00"))
    pieces = [x for p in parts for x in (F.encode(F.col(p), "utf-8"), zero)]
    return F.substring(F.sha2(F.concat(*pieces), 256), 1, 32)


def top_per(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of every key in order, with their `place` from 1. Spark cuts each key to n rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def updated_vectors(existing: DataFrame, new: DataFrame, order: list) -> DataFrame:
    """existing (key, model, dim, vec) with new vectors and models; a key that is there keeps its dim. Of several new ones the last in order."""
    last = last_wins(new, ["key"], order).select("key", F.col("model").alias("_m"), F.col("dim").alias("_d"), F.col("vec").alias("_v"))
    both = existing.join(last, "key", "full_outer")
    return both.select("key", F.coalesce("_m", "model").alias("model"), F.coalesce("dim", "_d").alias("dim"), F.coalesce("_v", "vec").alias("vec"))


def finished_runs(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """runs (run_id, started_at, finished_at, ...) with the last end told for each; runs without one stay as they are, ends of unknown runs are ignored."""
    last = ends.where("ended_at is not null").groupBy("run_id").agg(F.max("ended_at").alias("_end"))
    return runs.join(last, "run_id", "left").withColumn("finished_at", F.coalesce("_end", "finished_at")).drop("_end").select(*runs.columns)


def found_sources(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, id): the sources whose name is asked for, letter case aside; sources: (id, name), names: (asked)."""
    n = names.select("asked", F.lower("asked").alias("_k")).distinct()
    return sources.select("id", F.lower("name").alias("_k")).distinct().join(n, "_k").select("asked", "id")


def scorable(docs: DataFrame, chars: int, days: int, oldest: int) -> DataFrame:
    """(doc_id, ts, fallback): long documents at least `days` older than the newest; where there are none, the `oldest` long ones.

    docs: (doc_id, ts, text).
    """
    last = F.broadcast(docs.agg(F.max("ts").alias("_last")))
    long = docs.where((F.length("text") >= chars) & F.col("ts").isNotNull()).select("doc_id", "ts")
    good = long.join(last, F.col("ts") <= F.col("_last") - days * 86400).select("doc_id", "ts", F.lit(False).alias("fallback"))
    none = F.broadcast(good.limit(1).agg((F.count("*") == 0).alias("_none")))
    rest = long.orderBy("ts", "doc_id").limit(oldest).join(none, F.col("_none")).select("doc_id", "ts", F.lit(True).alias("fallback"))
    return good.unionByName(rest)


def config_hash(metadata: Column) -> Column:
    """16 hex digits of the SHA-256 of a map as JSON with sorted keys; null for null."""
    entry = lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"'))
    json = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), entry), ", "), F.lit("}"))
    return F.substring(F.sha2(json, 256), 1, 16)
