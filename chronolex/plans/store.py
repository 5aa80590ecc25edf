"""Queries over the store: counts, spans, lookups, upserts, manifests."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolex.operators import store
from chronolex.plans.base import ANCHORED, DATED, VERDICTS, Tables, query

CUT = 1672531200  # 2023-01-01, the slices' time


@query(f"WITH {DATED} SELECT count(*) AS n, count(DISTINCT source_id) AS sources FROM d WHERE ts < {CUT} AND ts > {CUT} - 63072000")
def slice_count(spark, sf):
    d = store.time_slice(Tables(spark, sf).dated, CUT, CUT - 63072000)
    return d.agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"))


@query(f"WITH {DATED} SELECT coalesce(source_id, '') AS source_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM d GROUP BY 1")
def corpus_span(spark, sf):
    return Tables(spark, sf).dated.groupBy(F.coalesce("source_id", F.lit("")).alias("source_id")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("WITH s AS (SELECT DISTINCT id FROM sources) SELECT s.id, count(d.doc_id) AS n FROM s LEFT JOIN documents d ON d.source_id = s.id GROUP BY s.id")
def sources_left_join_count(spark, sf):
    t = Tables(spark, sf)
    n = t.documents.groupBy("source_id").agg(F.count("*").alias("n"))
    return t.sources.select("id").distinct().join(n, F.col("id") == F.col("source_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("WITH s AS (SELECT id, min(kind) AS kind FROM sources GROUP BY id) SELECT kind, count(DISTINCT s.id) AS sources, count(*) AS documents FROM documents d JOIN s ON d.source_id = s.id GROUP BY kind")
def source_kind_rollup(spark, sf):
    t = Tables(spark, sf)
    n = t.documents.groupBy("source_id").agg(F.count("*").alias("n"))
    s = t.sources.groupBy("id").agg(F.min("kind").alias("kind"))
    return s.join(n, s.id == n.source_id).groupBy("kind").agg(F.count("*").alias("sources"), F.sum("n").alias("documents"))


@query("SELECT id, lower(name) AS name, count(*) AS seen FROM sources WHERE lower(name) IN (SELECT lower(name) FROM sources GROUP BY lower(name) HAVING count(*) > 1) GROUP BY 1, 2")
def find_source_ci(spark, sf):
    s = Tables(spark, sf).sources.select("id", F.lower("name").alias("name"))
    again = s.groupBy("name").count().where("count > 1").select("name")
    return s.join(again, "name", "left_semi").groupBy("id", "name").agg(F.count("*").alias("seen"))


@query(f"WITH {DATED} SELECT source_id, doc_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, doc_id) AS rn FROM d WHERE source_id IS NOT NULL) WHERE rn <= 5")
def docs_newest_per_source(spark, sf):
    w = Window.partitionBy("source_id").orderBy(F.desc("ts"), "doc_id")
    d = Tables(spark, sf).times.where("source_id is not null").select("source_id", "doc_id", "ts")
    return d.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query(f"WITH {DATED} SELECT doc_id, ts FROM d WHERE length(text) >= 3000 AND ts <= (SELECT max(ts) FROM d) - 1095 * 86400")
def select_scorable_docs(spark, sf):
    d = Tables(spark, sf).dated
    last = d.agg(F.max("ts").alias("last"))
    return d.where(F.length("text") >= 3000).select("doc_id", "ts").join(F.broadcast(last), F.col("ts") <= F.col("last") - 1095 * 86400).drop("last")


@query(f"WITH {DATED}, x AS (SELECT source_id, count(*) AS n FROM d WHERE source_id IS NOT NULL GROUP BY 1) SELECT source_id, n, row_number() OVER (ORDER BY n DESC, source_id) AS place FROM x ORDER BY n DESC, source_id LIMIT 25")
def snapshot_top_sources(spark, sf):
    n = Tables(spark, sf).dated.where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "source_id").limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source_id")).cast("long"))


@query("SELECT claim_id, doc_id, relation, conf FROM (WITH " + VERDICTS + " SELECT *, row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY direction) AS r FROM v) WHERE r = 1")
def upsert_first_wins(spark, sf):
    """Evidence: of a claim and document the first verdict stays, whatever its direction."""
    v = Tables(spark, sf).verdicts.select("claim_id", "doc_id", "relation", "conf", "direction")
    return store.first_wins(v.where("false"), v, ["claim_id", "doc_id"], ["direction"]).drop("direction")


@query("SELECT run_id, entity_type, entity_id, metric, score, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY run_id, entity_type, entity_id, metric ORDER BY written_at DESC, coalesce(score, -1) DESC) AS rn FROM scores) WHERE rn = 1")
def upsert_last_wins_scores(spark, sf):
    s = Tables(spark, sf).scores.select("run_id", "entity_type", "entity_id", "metric", "score", "lo", "hi", "written_at")
    return store.last_wins(s, ["run_id", "entity_type", "entity_id", "metric"], ["written_at", F.coalesce("score", F.lit(-1.0))]).drop("written_at")


@query("SELECT id, arg_min(kind, (seen_at, name)) AS kind, arg_max(name, (seen_at, name)) AS name, arg_max(domain, (seen_at, name)) FILTER (WHERE domain IS NOT NULL) AS domain FROM sources GROUP BY id")
def upsert_source_merge(spark, sf):
    return store.merged_sources(Tables(spark, sf).sources)


@query("SELECT doc_id, substr(sha256(url || chr(0)), 1, 32) AS stable_id FROM documents WHERE url IS NOT NULL")
def stable_id(spark, sf):
    return Tables(spark, sf).documents.where("url is not null").select("doc_id", store.stable_id("url").alias("stable_id"))


@query("SELECT domain, count(*) AS n FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM documents) WHERE domain <> '' GROUP BY domain")
def outlet_counts(spark, sf):
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]+)", 1)), r"^www\.", "")
    return Tables(spark, sf).documents.select(host.alias("domain")).where("domain <> ''").groupBy("domain").agg(F.count("*").alias("n"))


@query(f"WITH {DATED}, t AS (SELECT url, min(ts) AS ts FROM d WHERE url IS NOT NULL GROUP BY url) SELECT CAST(floor(ts / 604800.0) AS BIGINT) AS week, count(*) AS n FROM t GROUP BY 1")
def gdelt_tiles(spark, sf):
    """Weekly tiles of the corpus; a url counts in the week it came first."""
    t = Tables(spark, sf).dated.where("url is not null").groupBy("url").agg(F.min("ts").alias("ts"))
    return t.groupBy(F.floor(F.col("ts") / 604800).cast("long").alias("week")).agg(F.count("*").alias("n"))


@query("SELECT lower(trim(source)) AS channel, count(*) AS found, count(DISTINCT id) AS added, CAST(sum(CASE WHEN coalesce(length(text), 0) < 200 THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM documents GROUP BY 1")
def shell_channel_manifest(spark, sf):
    d = Tables(spark, sf).documents.groupBy(F.lower(F.trim("source")).alias("channel"))
    return d.agg(F.count("*").alias("found"), F.count_distinct("id").alias("added"), F.sum((F.coalesce(F.length("text"), F.lit(0)) < 200).cast("long")).alias("skipped"))


@query(f"WITH {ANCHORED} SELECT kind, count(*) AS n, min(anchor_ts) AS first_ts, max(anchor_ts) AS last_ts FROM a GROUP BY kind")
def claims_by_kind(spark, sf):
    return Tables(spark, sf).anchored.groupBy("kind").agg(F.count("*").alias("n"), F.min("anchor_ts").alias("first_ts"), F.max("anchor_ts").alias("last_ts"))


@query("SELECT doc_id, lang FROM documents WHERE source_id IS NOT NULL AND source_id <> (SELECT min(source_id) FROM documents) AND doc_id NOT IN (SELECT doc_id FROM subject_labels WHERE doc_id IS NOT NULL)")
def exclude_source_and_docs(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.where("source_id is not null")
    own = F.broadcast(t.documents.agg(F.min("source_id").alias("own")))
    return d.join(own, F.col("source_id") != F.col("own")).join(t.subject_labels.select("doc_id").where("doc_id is not null"), "doc_id", "left_anti").select("doc_id", "lang")
