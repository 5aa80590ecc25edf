"""Queries over copies, prevalence, first uses, ablation and further controls."""

from pyspark.sql import functions as F

from chronolex.operators import anchors, prevalence, scoring, syndication
from chronolex.plans.base import CANON, CANONICAL, DATED, Tables, query
from chronolex.plans.scores import FOLLOW, LAG, SIX, _lagged

#: the vectors of the tables are nearly orthogonal, so floors lie lower than for real ones
TOPICAL, EXPRESS = 0.2, 0.3


def _vectors(t):
    """Documents' vectors with their times, and those of every twentieth as claims."""
    v = t.embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec")).join(t.times.select(F.col("doc_id").alias("id"), "ts"), "id")
    return v.where("id % 20 = 0").withColumnRenamed("ts", "anchor_ts"), v


SPAN = "CASE " + " ".join(f"WHEN days >= {a} AND days < {b} THEN {i}" for i, (a, b) in enumerate(prevalence.WINDOWS)) + " END"
CURVE = f"""{DATED}, vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, ts FROM embeddings JOIN d ON doc_id = vec_id), sim AS (SELECT a.id AS claim_id, b.id AS doc_id, list_inner_product(a.v, b.v) AS score, floor((b.ts - a.ts) / 86400.0) AS days FROM vec a, vec b WHERE a.id % 20 = 0 AND a.id <> b.id),
near AS (SELECT * FROM (SELECT *, {SPAN} AS win FROM sim WHERE score >= {TOPICAL}) WHERE win IS NOT NULL), cur AS (SELECT claim_id, win, count(*) AS n_topical, count(*) FILTER (WHERE score >= {EXPRESS}) AS n_expressing FROM near GROUP BY 1, 2)"""


@query(f"WITH {CURVE} SELECT claim_id, win, n_topical, n_expressing FROM cur")
def prevalence_curve(spark, sf):
    return prevalence.curve(*_vectors(Tables(spark, sf)), topical=TOPICAL, express=EXPRESS)


MIDDLE = "CASE min(win) FILTER (WHERE baseline IS NOT NULL AND win >= 2 AND n_expressing >= 2 AND p >= greatest(2 * baseline, 0.02)) " + " ".join(f"WHEN {i} THEN {(a + b) // 2}" for i, (a, b) in enumerate(prevalence.WINDOWS)) + " END"


@query(f"WITH {CURVE}, x AS (SELECT *, n_expressing / n_topical AS p, sum(n_expressing) FILTER (WHERE win < 2) OVER (PARTITION BY claim_id) / sum(n_topical) FILTER (WHERE win < 2) OVER (PARTITION BY claim_id) AS baseline FROM cur WHERE n_topical >= 8), y AS (SELECT claim_id, any_value(baseline) AS b, max(p) FILTER (WHERE win >= 2) AS peak, {MIDDLE} AS lead_days FROM x GROUP BY claim_id) SELECT claim_id, round(b, 6) AS baseline, round(peak, 6) AS peak, round(peak - b, 6) AS adoption, round(1 - b, 6) AS surprisal, lead_days FROM y")
def lead_days(spark, sf):
    c = prevalence.curve(*_vectors(Tables(spark, sf)), topical=TOPICAL, express=EXPRESS)
    return prevalence.summary(c).select("claim_id", *SIX("baseline", "peak", "adoption", "surprisal"), "lead_days")


@query(f"WITH RECURSIVE {CURVE}, {CANONICAL}, st AS (SELECT near.*, coalesce(canonical, near.doc_id) AS story FROM near LEFT JOIN canon ON canon.doc_id = near.doc_id), one AS (SELECT claim_id, win, story, max(score) AS score, arg_max(doc_id, (score, doc_id)) AS doc_id, count(*) AS n FROM st GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY claim_id, win ORDER BY score DESC, doc_id DESC) AS place, CAST(sum(n) OVER (PARTITION BY claim_id, win) AS BIGINT) AS n_topical FROM one), x AS (SELECT *, row_number() OVER (PARTITION BY claim_id, win ORDER BY md5(claim_id || '|' || win || '|' || doc_id)) AS drawn FROM k WHERE place <= 60) SELECT claim_id, win, doc_id, place <= 10 AS in_trail, drawn <= 10 AS in_sample, n_topical FROM x WHERE place <= 10 OR drawn <= 10")
def topical_candidates(spark, sf):
    t = Tables(spark, sf)
    return prevalence.chosen(prevalence.candidates(*_vectors(t), t.canonical, topical=TOPICAL))


@query(f"WITH RECURSIVE {CANON} SELECT doc_id, class_id FROM cls")
def near_dup_components(spark, sf):
    return syndication.classes(Tables(spark, sf).documents)


@query(f"WITH RECURSIVE {DATED}, {CANONICAL} SELECT doc_id, ts FROM d WHERE doc_id NOT IN (SELECT doc_id FROM canon WHERE canonical <> doc_id)")
def keep_canonical(spark, sf):
    """Documents without the copies of an earlier one."""
    t = Tables(spark, sf)
    return t.times.select("doc_id", "ts").join(t.canonical.where("doc_id <> canonical"), "doc_id", "left_anti")


@query(f"WITH RECURSIVE {DATED}, {CANONICAL} SELECT source_id, count(*) AS collapsed FROM d JOIN canon USING (doc_id) WHERE canonical <> doc_id GROUP BY 1")
def syndicated_collapsed(spark, sf):
    """How many documents of each source are copies of an earlier one."""
    t = Tables(spark, sf)
    c = t.canonical.where("doc_id <> canonical")
    return t.documents.select("doc_id", "source_id").join(c, "doc_id").groupBy("source_id").agg(F.count("*").alias("collapsed"))


@query(f"WITH RECURSIVE {LAG}, {CANONICAL}, {FOLLOW}, e AS (SELECT fo.claim_id, fo.source_id, row_number() OVER (PARTITION BY fo.claim_id, coalesce(canonical, fo.doc_id) ORDER BY fo.ts, fo.doc_id) AS nth FROM fo LEFT JOIN canon ON canon.doc_id = fo.doc_id WHERE fo.up) SELECT claim_id, count(DISTINCT source_id) FILTER (WHERE nth = 1) AS sources FROM e GROUP BY 1")
def independent_sources(spark, sf):
    t = Tables(spark, sf)
    up = scoring.followers(_lagged(t)).where("up").select("claim_id", "doc_id", "source_id", "ts")
    return syndication.independent_sources(up, t.canonical)


@query(f"WITH {LAG}, s AS (SELECT l.claim_id, l.doc_id, l.ts, l.anchor_ts FROM l JOIN documents t ON t.doc_id = l.doc_id WHERE direction = 'prior' AND l.source_id = own_source AND l.doc_id <> own_doc AND lag < 0 AND relation IN ('identical','paraphrase','subsumes') AND conf >= 0.6 AND length(quote) >= 12 AND contains(lower(t.text), substr(lower(quote), 1, 60))) SELECT claim_id, arg_min(doc_id, (ts, doc_id)) AS doc_id, min(ts) AS first_ts, count(*) AS statements, CAST(floor((any_value(anchor_ts) - min(ts)) / 86400.0) AS BIGINT) AS moved_days FROM s GROUP BY claim_id")
def first_use_anchor(spark, sf):
    t = Tables(spark, sf)
    return anchors.first_use(_lagged(t), t.documents)


GRADES = f"""{LAG}, g AS (SELECT claim_id, max(weight * conf) FILTER (WHERE direction = 'prior') AS closed, avg(greatest(weight, 0) * conf) FILTER (WHERE direction = 'later' AND source_id = own_source) AS source, avg(greatest(weight, 0) * conf) FILTER (WHERE direction = 'later' AND source_id <> own_source) AS decoy,
  coalesce(bool_or(relation = 'partial') FILTER (WHERE direction = 'prior'), false) AS h FROM l GROUP BY 1),
ab AS (SELECT claim_id, closed, source, decoy, CASE WHEN closed IS NOT NULL THEN source - greatest(closed, decoy) END AS value, decoy IS NOT NULL AS decoy_controlled, closed >= 0.6 AND NOT h AS internalised FROM g WHERE coalesce(closed, source, decoy) IS NOT NULL)"""


def _grades(t):
    """Verdicts read as grades: earlier evidence as closed book, later evidence of its own source as source, of others as decoy."""
    x = _lagged(t).withColumn("score", F.greatest("weight", F.lit(0.0)) * F.col("conf"))
    same = F.col("source_id") == F.col("own_source")
    c = F.when(F.col("direction") == "later", F.when(same, "source").when(~same, "decoy"))
    later = x.select("claim_id", c.alias("condition"), "score", F.lit(False).alias("hedged")).where("condition is not null")
    prior = x.where("direction = 'prior'").groupBy("claim_id").agg(F.max("score").alias("score"), F.bool_or(F.col("relation") == "partial").alias("hedged"))
    return later.unionByName(prior.select("claim_id", F.lit("closed").alias("condition"), "score", "hedged"))


@query(f"WITH {GRADES} SELECT claim_id, round(closed, 6) AS closed, round(source, 6) AS source, round(decoy, 6) AS decoy, round(value, 6) AS value, decoy_controlled, internalised FROM ab")
def ablation_value(spark, sf):
    return anchors.ablation_values(_grades(Tables(spark, sf))).select("claim_id", *SIX("closed", "source", "decoy", "value"), "decoy_controlled", "internalised")


@query(f"WITH {GRADES} SELECT coalesce(own, '') AS source_id, count(*) AS claims, round(avg(value), 6) AS value, round(avg(value) FILTER (WHERE decoy_controlled), 6) AS controlled_value, round(avg(CASE WHEN internalised THEN 1.0 ELSE 0.0 END), 6) AS internalised_rate FROM ab JOIN (SELECT claim_id, own_source AS own FROM a) USING (claim_id) GROUP BY 1")
def ablation_rollup(spark, sf):
    t = Tables(spark, sf)
    r = anchors.ablation_values(_grades(t)).join(t.anchored.select("claim_id", F.coalesce("own_source", F.lit("")).alias("source_id")), "claim_id")
    rate = F.avg(F.when(F.col("internalised"), 1.0).otherwise(0.0))
    return r.groupBy("source_id").agg(F.count("*").alias("claims"), F.round(F.avg("value"), 6).alias("value"), F.round(F.avg(F.when(F.col("decoy_controlled"), F.col("value"))), 6).alias("controlled_value"), F.round(rate, 6).alias("internalised_rate"))
