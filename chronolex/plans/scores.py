"""Queries over verdicts: scores of claims, documents and sources, and the controls on them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolex import scratch
from chronolex.operators import scoring, store
from chronolex.plans.base import ANCHORED, CANONICAL, EVIDENCE, VERDICTS, Tables, query

LAG = f"{ANCHORED}, {EVIDENCE}, l AS (SELECT ev.*, a.anchor_ts, a.own_source, a.own_doc, d.ts, d.source_id, d.ts - a.anchor_ts AS lag, floor((d.ts - a.anchor_ts) / 86400.0) AS days, ev.doc_id <> a.own_doc AND coalesce(d.source_id <> a.own_source, true) AS other FROM ev JOIN a USING (claim_id) JOIN d ON d.doc_id = ev.doc_id)"
BEFORE = "be AS (SELECT * FROM l WHERE other AND direction = 'prior' AND lag < 0)"
STRENGTH = f"{BEFORE}, p AS (SELECT claim_id, max(weight * conf) AS strength, arg_min(doc_id, (-weight * conf, doc_id)) AS doc_id FROM be GROUP BY claim_id)"
WIN = "CASE " + " ".join(f"WHEN direction = '{'prior' if side == 'pre' else 'later'}' AND days >= {a} AND days < {b} THEN {i}" for i, (side, _, a, b) in enumerate(scoring.LONG)) + " END"
JUDGED = f"""jr AS (SELECT *, greatest(weight, 0.0) * conf AS pos, CASE WHEN relation = 'contradicts' THEN abs(weight) * conf ELSE 0.0 END AS neg, row_number() OVER (PARTITION BY claim_id, win ORDER BY md5(concat_ws('|', claim_id, win, doc_id))) AS nth FROM (SELECT *, {WIN} AS win FROM l WHERE other) WHERE win IS NOT NULL),
jw AS (SELECT claim_id, win, count(*) AS judged, count(*) FILTER (WHERE nth <= 10) AS n, avg(pos) FILTER (WHERE nth <= 10) AS expressed, sum(pos) AS support, sum(neg) AS refute FROM jr GROUP BY 1, 2)"""
PV = """pv AS (SELECT claim_id, greatest(0.0, 1 - coalesce(strength, 0)) AS surprisal, baseline, peak, peak - baseline AS adoption, CASE WHEN s + r > 1e-9 THEN (s - r) / (s + r) END AS vindication FROM a LEFT JOIN
  (SELECT claim_id, sum(expressed * n) FILTER (WHERE win < 2 AND n >= 4) / sum(n) FILTER (WHERE win < 2 AND n >= 4) AS baseline, max(expressed) FILTER (WHERE win >= 2 AND n >= 4) AS peak,
   coalesce(sum(support) FILTER (WHERE win >= 2), 0) AS s, coalesce(sum(refute) FILTER (WHERE win >= 2), 0) AS r FROM jw GROUP BY claim_id) USING (claim_id) LEFT JOIN p USING (claim_id))"""
# followers of claims: later evidence of others within 1095 days; legacy relations: states is identical, both anticipations are partial, orthogonal and contradicts topical
FOLLOW = "fo AS (SELECT *, relation IN ('states', 'anticipates_directionally', 'partially_anticipates') AND conf >= 0.5 AS up FROM l WHERE other AND direction = 'later' AND lag > 0 AND lag < 1095 * 86400)"
SPACED = lambda c: rf"' ' || trim(regexp_replace(strip_accents(lower({c})), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
HITS = f"fp AS (SELECT claim_id, list_filter(list_transform(fingerprints, lambda p: {SPACED('p')}), lambda p: contains(trim(p), ' ')) AS f FROM c), fx AS (SELECT doc_id, {SPACED('concat_ws(chr(32), title, text)')} AS t FROM documents), hi AS (SELECT DISTINCT fo.claim_id, fo.doc_id FROM fo JOIN fp USING (claim_id) JOIN fx ON fx.doc_id = fo.doc_id WHERE fo.up AND len(list_filter(f, lambda p: contains(t, p))) > 0)"
INFLUENCE_WINDOWS = """fi AS (SELECT fo.*, hi.doc_id IS NOT NULL AS hit FROM fo LEFT JOIN hi USING (claim_id, doc_id)), days(win_days) AS (VALUES (7), (30), (90), (180), (365), (1095)),
ic AS (SELECT claim_id, win_days, count(*) FILTER (WHERE near AND up) AS uptake_docs, count(*) FILTER (WHERE near AND up AND relation = 'states') AS strong_docs, count(*) FILTER (WHERE near AND relation IN ('orthogonal', 'contradicts')) AS topical_docs, count(*) FILTER (WHERE near AND up AND attributes_source) AS attributed_docs, count(*) FILTER (WHERE near AND up AND hit) AS fingerprint_docs FROM (SELECT fi.*, win_days, lag <= win_days * 86400 AS near FROM fi, days) GROUP BY 1, 2),
isr AS (SELECT claim_id, win_days, count(DISTINCT source_id) FILTER (WHERE lag <= win_days * 86400) AS uptake_sources FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, story ORDER BY lag, doc_id, source_id) AS nth FROM (SELECT fo.claim_id, fo.lag, fo.doc_id, fo.source_id, coalesce(canonical, fo.doc_id) AS story FROM fo LEFT JOIN canon ON canon.doc_id = fo.doc_id WHERE up)), days WHERE nth = 1 GROUP BY 1, 2),
iw AS (SELECT claim_id, win_days, coalesce(uptake_sources, 0) AS uptake_sources, uptake_docs, strong_docs, topical_docs, attributed_docs, fingerprint_docs, CASE WHEN uptake_docs + topical_docs > 0 THEN uptake_docs / (uptake_docs + topical_docs + 2.0) ELSE 0.0 END AS lift FROM ic LEFT JOIN isr USING (claim_id, win_days))"""
INF = """ig AS (SELECT claim_id, max(uptake_sources) FILTER (WHERE win_days = 1095) AS s, max(uptake_docs) FILTER (WHERE win_days = 1095) AS u, max(attributed_docs) FILTER (WHERE win_days = 1095) AS att, max(fingerprint_docs) FILTER (WHERE win_days = 1095) AS k, max(uptake_sources) FILTER (WHERE win_days = 7) AS soon, max(lift) AS lift FROM iw GROUP BY 1),
inf AS (SELECT a.claim_id, coalesce(s, 0) AS sources, CASE WHEN u > 0 THEN att / u ELSE 0.0 END AS attribution_rate, coalesce(k, 0) AS fingerprint_spread, CASE WHEN coalesce(s, 0) = 0 THEN 0.0 ELSE 0.45 * least(1.0, ln(1.0 + s) / ln(13.0)) + 0.20 * lift + 0.15 * least(1.0, soon / 3.0) + 0.10 * least(1.0, k / 3.0) + 0.10 * CASE WHEN u > 0 THEN att / u ELSE 0.0 END END AS influence FROM a LEFT JOIN ig USING (claim_id))"""
INFLUENCE = f"WITH RECURSIVE {LAG}, {CANONICAL}, {FOLLOW}, {HITS}, {INFLUENCE_WINDOWS}, {INF}"
# how a claim can be searched for: by its words, its document's vector, a fingerprint of two words or more
SEARCH = "sp AS (SELECT a.claim_id, (SELECT count(*) FROM d WHERE d.ts < a.anchor_ts) AS pool, 1 + CASE WHEN EXISTS (SELECT 1 FROM embeddings WHERE vec_id = a.own_doc) THEN 1 ELSE 0 END + CASE WHEN len(list_filter(fingerprints, lambda p: contains(trim(p), ' '))) > 0 THEN 1 ELSE 0 END AS retrievers FROM a JOIN c USING (claim_id))"
COVERAGE = "round(least(greatest(least(1.0, ln(1.0 + pool) / ln(20001.0)) * (0.35 + 0.65 * least(1.0, coalesce(topical, 0) / 4.0)) * (0.55 + 0.45 * least(1.0, retrievers / 3.0)), 0.0), 1.0), 4)"
ORI = f"""op AS (SELECT claim_id, max(weight * conf) AS best, count(*) FILTER (WHERE relation <> 'unrelated' AND conf >= 0.4) AS topical, count(*) FILTER (WHERE relation IN ('identical', 'paraphrase', 'subsumes') AND conf >= 0.5) AS defeating, count(DISTINCT source_id) FILTER (WHERE relation = 'partial' AND conf >= 0.5) AS part FROM be GROUP BY 1),
oc AS (SELECT claim_id, greatest(1 - coalesce(best, 0), 0.0) AS hi, coalesce(defeating, 0) = 0 AND coalesce(part, 0) >= 2 AS synthesis, {COVERAGE} AS coverage FROM sp LEFT JOIN op USING (claim_id)),
o AS (SELECT claim_id, hi, hi * coverage AS lo, hi * coverage + (hi - hi * coverage) * (0.35 + 0.65 * coverage) AS score, coverage, synthesis FROM oc)"""
FIRST = "ff AS (SELECT claim_id, arg_min(doc_id, (ts, doc_id)) AS doc_id, CAST(arg_min(days, (ts, doc_id)) AS BIGINT) AS lead_days FROM fo WHERE up GROUP BY 1)"
SIX = lambda *cols, plus=0.0: [F.round(F.col(c) + plus, 6).alias(c) for c in cols]
# the small addend settles exact halves alike in both engines
R = lambda *cols: ", ".join(f"round({c} + 1e-10, 6) AS {c}" for c in cols)
TEN = 1e-10


def _lagged(t):
    return scoring.with_lag(t.evidence, t.anchored, t.times)


def _searches(t):
    """(claim_id, pool, retrievers): documents before each claim, and the ways in which it can be searched for."""
    named = F.size(F.filter(F.coalesce("fingerprints", F.array().cast("array<string>")), lambda p: F.contains(F.trim(p), F.lit(" ")))) > 0
    c = t.anchored.join(t.claim_rows.select(F.col("id").alias("claim_id"), named.alias("_named")), "claim_id").join(t.embeddings.select(F.col("vec_id").alias("own_doc"), F.lit(1).alias("_vector")).distinct(), "own_doc", "left")
    ways = c.select("claim_id", (1 + F.coalesce("_vector", F.lit(0)) + F.coalesce(F.col("_named").cast("int"), F.lit(0))).alias("retrievers"))
    return ways.join(scoring.pools(t.anchored, t.times), "claim_id")


def _originality(t):
    return scoring.originality(scoring.before(_lagged(t)), _searches(t))


def _fingerprints(t):
    return t.claim_rows.select(F.col("id").alias("claim_id"), "fingerprints")


def _influence_windows(t, follow):
    hits = scoring.fingerprint_hits(follow.where("up"), _fingerprints(t), t.documents)
    return scoring.influence_windows(follow, hits, t.canonical)


def _influence(t):
    return scoring.influence_score(t.anchored, _influence_windows(t, scoring.followers(_lagged(t))))


@query(f"WITH {LAG}, {STRENGTH} SELECT claim_id, {R('strength')}, doc_id FROM p WHERE strength > 0.1")
def best_prior_receipt(spark, sf):
    return scoring.best_prior(scoring.before(_lagged(Tables(spark, sf)))).select("claim_id", *SIX("strength", plus=TEN), "doc_id")


@query(f"WITH {LAG}, {JUDGED} SELECT claim_id, win, judged, n, {R('expressed', 'support', 'refute')} FROM jw")
def judged_windows(spark, sf):
    return scoring.judged_windows(_lagged(Tables(spark, sf))).select("claim_id", "win", "judged", "n", *SIX("expressed", "support", "refute", plus=TEN))


@query(f"WITH {LAG}, {JUDGED}, {STRENGTH}, {PV} SELECT claim_id, {R('surprisal', 'baseline', 'peak', 'adoption', 'vindication')}, round(surprisal * CASE WHEN adoption IS NOT NULL THEN greatest(0.0, adoption) END * coalesce((1 + vindication) / 2, 1.0) + 1e-10, 6) AS pv FROM pv")
def predictive_value(spark, sf):
    t = Tables(spark, sf)
    x = _lagged(t)
    return scoring.predictive_value(t.anchored, scoring.judged_windows(x), scoring.prior_strength(scoring.before(x))).select("claim_id", *SIX("surprisal", "baseline", "peak", "adoption", "vindication", "pv", plus=TEN))


_WIN_SHORT = "CASE " + " ".join(f"WHEN direction = '{'prior' if side == 'pre' else 'later'}' AND days >= {a} AND days < {b} THEN {i}" for i, (side, _, a, b) in enumerate(scoring.SHORT)) + " END"


@query(f"WITH {LAG}, {JUDGED.replace(WIN, _WIN_SHORT)}, {STRENGTH}, {PV} SELECT claim_id, {R('surprisal', 'baseline', 'peak', 'adoption', 'vindication')} FROM pv")
def predictive_value_short(spark, sf):
    """The same over months instead of years, for claims about breaking events."""
    t = Tables(spark, sf)
    x = _lagged(t)
    return scoring.predictive_value(t.anchored, scoring.judged_windows(x, scoring.SHORT), scoring.prior_strength(scoring.before(x)), scoring.SHORT).select("claim_id", *SIX("surprisal", "baseline", "peak", "adoption", "vindication", plus=TEN))


@query(f"WITH {LAG}, {JUDGED}, b AS (SELECT claim_id, arg_min(doc_id, (-weight * conf, doc_id)) FILTER (WHERE weight > 0) AS anticipation, max(weight * conf) FILTER (WHERE weight > 0) AS strength, arg_min(doc_id, (-conf, doc_id)) FILTER (WHERE relation = 'contradicts') AS contradiction, max(conf) FILTER (WHERE relation = 'contradicts') AS contra_conf FROM jr WHERE direction = 'later' GROUP BY 1) SELECT claim_id, anticipation, {R('strength')}, contradiction, {R('contra_conf')} FROM b WHERE anticipation IS NOT NULL OR contradiction IS NOT NULL")
def best_anticipation(spark, sf):
    return scoring.strongest(_lagged(Tables(spark, sf))).select("claim_id", "anticipation", *SIX("strength", plus=TEN), "contradiction", *SIX("contra_conf", plus=TEN))


@query(f"WITH {LAG}, {BEFORE}, {SEARCH}, {ORI} SELECT claim_id, {R('hi', 'lo', 'score', 'coverage')}, synthesis FROM o")
def originality(spark, sf):
    return _originality(Tables(spark, sf)).select("claim_id", *SIX("hi", "lo", "score", "coverage", plus=TEN), "synthesis")


@query(f"{INFLUENCE} SELECT claim_id, win_days, uptake_sources, uptake_docs, strong_docs, topical_docs, attributed_docs, fingerprint_docs, {R('lift')} FROM iw")
def influence_windows(spark, sf):
    t = Tables(spark, sf)
    return _influence_windows(t, scoring.followers(_lagged(t))).select("claim_id", "win_days", "uptake_sources", "uptake_docs", "strong_docs", "topical_docs", "attributed_docs", "fingerprint_docs", *SIX("lift", plus=TEN))


@query(f"{INFLUENCE} SELECT claim_id, {R('influence')}, sources, {R('attribution_rate')}, fingerprint_spread FROM inf")
def influence_score(spark, sf):
    return _influence(Tables(spark, sf)).select("claim_id", *SIX("influence", plus=TEN), "sources", *SIX("attribution_rate", plus=TEN), "fingerprint_spread")


@query(f"WITH {LAG}, {FOLLOW}, {FIRST} SELECT claim_id, doc_id, lead_days FROM ff")
def first_follower(spark, sf):
    return scoring.first_follower(scoring.followers(_lagged(Tables(spark, sf))))


SIGNAL = f"{INFLUENCE}, {BEFORE}, {SEARCH}, {ORI}, {FIRST}, s AS (SELECT o.claim_id, o.score AS originality, inf.influence, sqrt(greatest(o.score, 0) * greatest(influence, 0)) AS signal, coverage, synthesis, lead_days FROM o JOIN inf USING (claim_id) LEFT JOIN ff USING (claim_id)), r AS (SELECT s.*, coalesce(a.salience, 0) AS salience, a.own_doc AS doc_id, a.own_source AS source_id FROM s JOIN a USING (claim_id))"


def _signal(t):
    """Each claim's originality, influence and signal, made once per session."""
    return scratch.once(t._spark, ("signal", t._sf), lambda: _signals(t))


def _signals(t):
    zero = F.lit(0.0)
    follow = scratch.written(scoring.followers(_lagged(t)), "followers")
    o = _originality(t).select("claim_id", F.col("score").alias("originality"), "coverage", "synthesis")
    influence = scoring.influence_score(t.anchored, _influence_windows(t, follow)).select("claim_id", "influence")
    s = o.join(influence, "claim_id").join(scoring.first_follower(follow).select("claim_id", "lead_days"), "claim_id", "left")
    s = s.withColumn("signal", F.sqrt(F.greatest("originality", zero) * F.greatest("influence", zero)))
    return s.join(t.anchored.select("claim_id", F.col("own_doc").alias("doc_id"), F.col("own_source").alias("source_id"), F.coalesce("salience", zero).alias("salience")), "claim_id")


@query(f"{SIGNAL} SELECT claim_id, {R('signal')} FROM r")
def claim_signal(spark, sf):
    return _signal(Tables(spark, sf)).select("claim_id", *SIX("signal", plus=TEN))


_MEAN = lambda c: f"round(sum({c} * salience) / CASE WHEN sum(salience) = 0 THEN count(*) ELSE sum(salience) END + 1e-10, 6) AS {c}"


@query(f"{SIGNAL} SELECT doc_id, count(*) AS claims, {_MEAN('originality')}, {_MEAN('influence')}, {_MEAN('signal')}, round(max(signal) + 1e-10, 6) AS peak FROM r GROUP BY doc_id")
def document_rollup(spark, sf):
    r = _signal(Tables(spark, sf))
    mean = lambda c: F.round(scoring.weighted_mean(c, "salience") + TEN, 6).alias(c)
    return r.groupBy("doc_id").agg(F.count("*").alias("claims"), mean("originality"), mean("influence"), mean("signal"), F.round(F.max("signal") + TEN, 6).alias("peak"))


@query(f"{SIGNAL}, q AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY signal DESC) AS rn, count(*) OVER (PARTITION BY source_id) AS n FROM r WHERE source_id IS NOT NULL), g AS (SELECT source_id, count(*) AS claims, avg(signal) FILTER (WHERE rn <= greatest(1, n // 10)) AS peak, avg(CASE WHEN signal >= 0.35 THEN 1.0 ELSE 0.0 END) AS hit_rate, median(signal) AS typical, median(originality) AS median_originality, median(influence) AS median_influence, median(lead_days) AS median_lead_days, avg(coverage) AS mean_coverage, CAST(sum(CASE WHEN synthesis THEN 1 ELSE 0 END) AS BIGINT) AS n_synthesis FROM q GROUP BY source_id) SELECT source_id, claims, {R('peak', 'hit_rate', 'typical')}, round(0.5 * peak + 0.3 * hit_rate + 0.2 * typical + 1e-10, 6) AS headline, {R('median_originality', 'median_influence', 'median_lead_days', 'mean_coverage')}, n_synthesis FROM g")
def source_rollup(spark, sf):
    s = scoring.source_scores(_signal(Tables(spark, sf)))
    return s.select("source_id", "claims", *SIX("peak", "hit_rate", "typical", "headline", "median_originality", "median_influence", "median_lead_days", "mean_coverage", plus=TEN), "n_synthesis")


@query(f"WITH {LAG}, x AS (SELECT a.claim_id, 1 - coalesce(max(weight * conf) FILTER (WHERE lag < 0 AND other), 0) AS base, 1 - coalesce(max(weight * conf) FILTER (WHERE days < 1460 AND l.doc_id <> a.own_doc), 0) AS moved FROM a LEFT JOIN (SELECT * FROM l WHERE direction = 'prior') l USING (claim_id) GROUP BY 1), ctl AS (SELECT count(*) AS n, round(avg(base), 6) AS base, round(avg(moved), 6) AS moved FROM x) SELECT *, CASE WHEN base >= 0.999 AND moved >= 0.999 THEN NULL ELSE moved < base - 0.02 END AS passed FROM ctl")
def date_shift_control(spark, sf):
    """Four more years of documents before a claim, its own source's too, must lower its novelty; undecided where both are untouched."""
    t = Tables(spark, sf)
    strength = F.col("weight") * F.col("conf")
    hi = lambda on: 1 - F.coalesce(F.max(F.when(on, strength)), F.lit(0.0))
    other = F.coalesce(F.col("source_id") != F.col("own_source"), F.lit(True))
    x = _lagged(t).where("direction = 'prior' and doc_id <> own_doc").groupBy("claim_id").agg(hi((F.col("lag") < 0) & other).alias("base"), hi(F.col("days") < 1460).alias("moved"))
    x = t.anchored.select("claim_id").join(x, "claim_id", "left").na.fill(1.0, ["base", "moved"])
    m = x.agg(F.count("*").alias("n"), F.round(F.avg("base"), 6).alias("base"), F.round(F.avg("moved"), 6).alias("moved"))
    return m.withColumn("passed", F.when((F.col("base") >= 0.999) & (F.col("moved") >= 0.999), F.lit(None)).otherwise(F.col("moved") < F.col("base") - 0.02))


@query(f"WITH {LAG}, {BEFORE}, {SEARCH}, {ORI}, blind AS (SELECT claim_id, cov + (1 - cov) * (0.35 + 0.65 * cov) AS score FROM (SELECT claim_id, {COVERAGE.replace('coalesce(topical, 0)', '0').replace('retrievers', '0')} AS cov FROM sp)), ctl AS (SELECT count(*) AS n, round(avg(o.score), 6) AS base, round(avg(blind.score), 6) AS blind, round(max(o.score) - min(o.score), 6) AS base_spread, round(max(blind.score) - min(blind.score), 6) AS blind_spread FROM o JOIN blind USING (claim_id)) SELECT *, CASE WHEN n > 0 THEN abs(blind - base) > 0.05 OR blind_spread < greatest(0.05, 0.5 * base_spread) END AS passed FROM ctl")
def no_retrieval_control(spark, sf):
    """Originality scored again with nothing retrieved: passes if that moves the mean by 0.05, or the scores collapse to half their spread or 0.05."""
    t = Tables(spark, sf)
    prior, asked = scoring.before(_lagged(t)), _searches(t)
    seen = scoring.originality(prior, asked).select("claim_id", F.col("score").alias("seen"))
    blind = scoring.originality(prior.where("false"), asked.withColumn("retrievers", F.lit(0))).select("claim_id", F.col("score").alias("unseen"))
    spread = lambda c: F.round(F.max(c) - F.min(c), 6)
    m = seen.join(blind, "claim_id").agg(F.count("*").alias("n"), F.round(F.avg("seen"), 6).alias("base"), F.round(F.avg("unseen"), 6).alias("blind"), spread("seen").alias("base_spread"), spread("unseen").alias("blind_spread"))
    moved, flat = F.abs(F.col("blind") - F.col("base")) > 0.05, F.col("blind_spread") < F.greatest(F.lit(0.05), 0.5 * F.col("base_spread"))
    return m.withColumn("passed", F.when(F.col("n") > 0, moved | flat))


@query(f"{INFLUENCE}, g AS (SELECT coalesce(own_source, '') AS source_id, sum(influence) AS s, count(*) AS n FROM inf JOIN a USING (claim_id) GROUP BY 1), x AS (SELECT source_id, n, round(s / n, 6) AS target, round((sum(s) OVER () - s) / nullif(sum(n) OVER () - n, 0), 6) AS decoy FROM g) SELECT source_id, n, target, decoy, CASE WHEN target > 0.02 THEN target > decoy END AS passed FROM x")
def decoy_control(spark, sf):
    """A source's mean influence must exceed that of the other sources' claims; undecided where it has next to none."""
    t = Tables(spark, sf)
    g = _influence(t).join(t.anchored.select("claim_id", F.coalesce("own_source", F.lit("")).alias("source_id")), "claim_id").groupBy("source_id").agg(F.sum("influence").alias("s"), F.count("*").alias("n"))
    every = g.agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    x = g.join(F.broadcast(every), F.lit(True)).select("source_id", "n", F.round(F.col("s") / F.col("n"), 6).alias("target"), F.round((F.col("_s") - F.col("s")) / F.nullif(F.col("_n") - F.col("n"), F.lit(0)), 6).alias("decoy"))
    return x.withColumn("passed", F.when(F.col("target") > 0.02, F.col("target") > F.col("decoy")))


_SHUFFLED = INFLUENCE.replace("SELECT claim_id, c.doc_id AS own_doc, kind, salience, d.ts AS anchor_ts, d.source_id AS own_source FROM c JOIN d USING (doc_id)", "SELECT * REPLACE (coalesce(lead(anchor_ts) OVER (ORDER BY md5(claim_id), claim_id), first_value(anchor_ts) OVER (ORDER BY md5(claim_id), claim_id)) AS anchor_ts) FROM (SELECT claim_id, c.doc_id AS own_doc, kind, salience, d.ts AS anchor_ts, d.source_id AS own_source FROM c JOIN d USING (doc_id))")


@query(f"WITH base AS ({INFLUENCE} SELECT count(*) AS n, avg(influence) AS base FROM inf), shuf AS ({_SHUFFLED} SELECT avg(influence) AS shuffled FROM inf) SELECT n, round(base, 6) AS base, round(shuffled, 6) AS shuffled, CASE WHEN n >= 3 AND base > 0.02 THEN shuffled < base END AS passed FROM base, shuf")
def shuffled_control(spark, sf):
    """Claims with one another's dates must be less influential.

    Each takes the date of the next in the order of its MD5, within groups of some 100,000 by the head of that MD5, the
    last of a group that of the first.
    """
    t = Tables(spark, sf)
    digits, n = 0, t.claim_rows.count()
    while n > 100_000 * 16**digits:
        digits += 1
    group = Window.partitionBy(F.substring("_h", 1, digits)).orderBy("_h", "claim_id")
    a = t.anchored.withColumn("_h", F.md5("claim_id"))
    moved = a.withColumn("anchor_ts", F.coalesce(F.lead("anchor_ts").over(group), F.first("anchor_ts").over(group))).drop("_h")
    score = lambda claims: scoring.influence_score(claims, _influence_windows(t, scoring.followers(scoring.with_lag(t.evidence, claims, t.times)))).agg(F.count("*").alias("n"), F.avg("influence").alias("m"))
    m = score(t.anchored).select("n", F.col("m").alias("b")).join(score(moved).select(F.col("m").alias("s")), F.lit(True))
    return m.select("n", F.round("b", 6).alias("base"), F.round("s", 6).alias("shuffled"), F.when((F.col("n") >= 3) & (F.col("b") > 0.02), F.col("s") < F.col("b")).alias("passed"))


@query("WITH g AS (SELECT direction, max(c) - min(c) AS diff FROM (SELECT claim_id, doc_id, direction, least(greatest(confidence, 0), 1) AS c FROM judgements WHERE confidence IS NOT NULL) GROUP BY claim_id, doc_id, direction HAVING count(*) > 1) SELECT direction, count(*) AS pairs, round(avg(diff), 6) AS mean_diff, round(max(diff), 6) AS max_diff, avg(diff) < 0.15 AS passed FROM g GROUP BY direction")
def judge_agreement(spark, sf):
    c = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    g = Tables(spark, sf).judgements.where("confidence is not null").withColumn("c", c).groupBy("claim_id", "doc_id", "direction").agg((F.max("c") - F.min("c")).alias("diff"), F.count("*").alias("k")).where("k > 1")
    return g.groupBy("direction").agg(F.count("*").alias("pairs"), F.round(F.avg("diff"), 6).alias("mean_diff"), F.round(F.max("diff"), 6).alias("max_diff"), (F.avg("diff") < 0.15).alias("passed"))


LATEST = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, entity_type, entity_id, metric ORDER BY written_at DESC, coalesce(score, -1) DESC) AS rn FROM scores) WHERE rn = 1)"


def _latest(t):
    s = t.scores.select("run_id", "entity_type", "entity_id", "metric", "score", "written_at")
    return store.last_wins(s, ["run_id", "entity_type", "entity_id", "metric"], ["written_at", F.coalesce("score", F.lit(-1.0))])


@query(f"WITH {LATEST} SELECT run_id, metric, count(score) AS n, round(avg(score), 6) AS mean, round(max(coalesce(score, 0)), 6) AS best FROM s GROUP BY 1, 2")
def unit_summary(spark, sf):
    return _latest(Tables(spark, sf)).groupBy("run_id", "metric").agg(F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max(F.coalesce("score", F.lit(0.0))), 6).alias("best"))


@query(f"WITH {LATEST}, e AS (SELECT run_id, entity_id, max(score) FILTER (WHERE metric = 'surprisal') AS s, max(score) FILTER (WHERE metric = 'adoption') AS a, max(score) FILTER (WHERE metric = 'vindication') AS v FROM s WHERE entity_type = 'claim' GROUP BY 1, 2), m AS (SELECT run_id, count(*) AS claims, avg(s) AS surprisal, avg(a) AS adoption, avg(v) AS vindication, max(coalesce(s * greatest(0, a) * coalesce((1 + v) / 2, 1), 0)) AS best FROM e GROUP BY 1) SELECT run_id, claims, {R('surprisal', 'adoption', 'vindication', 'best')}, row_number() OVER (ORDER BY best DESC, run_id) AS place FROM m")
def unit_rollup(spark, sf):
    """Each run's means of surprisal, adoption and vindication, nulls left out, in the order of its best claim; runs are few."""
    s = _latest(Tables(spark, sf)).where("entity_type = 'claim'")
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m)
    e = s.groupBy("run_id", "entity_id").agg(of("surprisal"), of("adoption"), of("vindication"))
    value = F.col("surprisal") * F.when(F.col("adoption").isNotNull(), F.greatest(F.lit(0.0), "adoption")) * F.coalesce((1 + F.col("vindication")) / 2, F.lit(1.0))
    m = e.groupBy("run_id").agg(F.count("*").alias("claims"), *[F.avg(c).alias(c) for c in ("surprisal", "adoption", "vindication")], F.max(F.coalesce(value, F.lit(0.0))).alias("best"))
    return m.select("run_id", "claims", *SIX("surprisal", "adoption", "vindication", "best", plus=TEN), F.row_number().over(Window.orderBy(F.desc("best"), "run_id")).cast("long").alias("place"))


@query(f"WITH {VERDICTS}, k AS (SELECT v.claim_id, v.doc_id, CASE WHEN trim(coalesce(title, '')) <> '' THEN lower(substr(trim(title), 1, 60)) ELSE substr(quote, 1, 80) END AS trail_key FROM v JOIN documents USING (doc_id) WHERE weight <> 0) SELECT claim_id, trail_key, min(doc_id) AS doc_id, count(*) - 1 AS copies FROM k WHERE trail_key <> '' GROUP BY 1, 2")
def trail_dedupe(spark, sf):
    """Evidence that bears on a claim, once per head of its title (of its quote where there is none), with the number of further copies."""
    t = Tables(spark, sf)
    v = t.verdicts.where("weight <> 0").join(t.documents.select("doc_id", F.trim(F.coalesce("title", F.lit(""))).alias("_t")), "doc_id")
    key = F.when(F.col("_t") != "", F.lower(F.substring("_t", 1, 60))).otherwise(F.substring("quote", 1, 80))
    return v.withColumn("trail_key", key).where("trail_key <> ''").groupBy("claim_id", "trail_key").agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("copies"))
