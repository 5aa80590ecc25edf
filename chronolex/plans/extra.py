"""Queries over signatures, samples, windows of vectors and streams."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.operators import minhash, search
from chronolex.plans.base import Tables, query
from chronolex.streaming import events as streams


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z''-]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM w)),
b AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS base, count(*) OVER (PARTITION BY doc_id) AS shingles FROM s),
e AS (SELECT i, ('0x' || substr(sha256('seed' || i), 1, 8))::BIGINT AS seed FROM range(64) t(i))
SELECT doc_id, CAST(i AS INTEGER) AS i, any_value(shingles) AS shingles, min(xor(base, seed)) AS value FROM b, e WHERE shingles >= 20 GROUP BY doc_id, i""")
def minhash_signature(spark, sf):
    rows = minhash.signatures(Tables(spark, sf).documents)
    return rows.select("doc_id", "shingles", F.posexplode("signature").alias("i", "value"))


@query(" UNION ALL ".join(f"SELECT {m} AS mod, count(*) AS queries, CAST(sum(CASE WHEN f.place = 1 THEN 1 ELSE 0 END) AS BIGINT) AS kept, round(avg(s.score), 6) AS mean_best FROM (SELECT a.vec_id AS q, max(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS score, arg_max(b.vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS best FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND b.vec_id % {m} = 0 GROUP BY 1) s JOIN (SELECT a.vec_id AS q, b.vec_id AS best, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS place FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) f USING (q, best)" for m in (1, 2, 4, 8, 16)))
def scaling_recall(spark, sf):
    """How often the nearest vector of all is still found in a half, quarter ... of the corpus, and how near what is found is."""
    v = Tables(spark, sf).embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    q = v.where("id % 20 = 0")
    best = search.dense_topk(q, v, k=1).select("query_id", F.col("doc_id").alias("full"))
    parts = []
    for m in (1, 2, 4, 8, 16):
        found = search.dense_topk(q, v.where(f"id % {m} = 0"), k=1).join(best, "query_id")
        parts.append(found.agg(F.lit(m).alias("mod"), F.count("*").alias("queries"), F.sum((F.col("doc_id") == F.col("full")).cast("long")).alias("kept"), F.round(F.avg("score"), 6).alias("mean_best")))
    return reduce(DataFrame.unionByName, parts)


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query()
def stream_tumbling(spark, sf):
    return streams.drained(streams.tumbling_counts(_stream(spark, sf)), "tumbling", ["window_start", "event_type"])


@query("SELECT event_id, event_type FROM events")
def stream_once_each(spark, sf):
    return streams.drained(streams.once_each(_stream(spark, sf)), "once").select("event_id", "event_type")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\x{200b}-\x{200d}\x{feff}\x{2060}]', '', 'g'), '[ \t]+', ' ', 'g'), ' ([,.;:!?%)\]])', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM documents WHERE text IS NOT NULL")
def normalize_ws(spark, sf):
    t = F.translate("text", " ​‌‍﻿⁠", " ")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), r" ([,.;:!?%)\]])", "$1"), "\n{3,}", "\n\n")
    return Tables(spark, sf).documents.where("text is not null").select("doc_id", F.trim(t).alias("text"))
