"""Each formula against numbers worked out by hand."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from chronolex.operators import scoring, store

DAY = 86400
V = "claim_id string, doc_id long, direction string, relation string, weight double, conf double, attributes_source boolean, extra int"
ANCHOR = 1000 * DAY
RELATIONS = store.PRIOR_WEIGHTS | store.LATER_WEIGHTS


def _lagged(spark, verdicts, docs, claims=(("c", 0, ANCHOR, "own"),)):
    v = spark.createDataFrame([(c, d, k, r, float(RELATIONS[r]), s, a, 1) for c, d, k, r, s, a in verdicts], V)
    c = spark.createDataFrame(list(claims), "claim_id string, own_doc long, anchor_ts long, own_source string")
    d = spark.createDataFrame(docs, "doc_id long, ts long, source_id string")
    return scoring.with_lag(v, c, d), c


def test_weak_prior_evidence_lowers_surprisal_but_gives_no_receipt(spark):
    x, c = _lagged(spark, [("c", 1, "prior", "topical", 0.8, None)], [(1, ANCHOR - DAY, "s")])
    prior = scoring.before(x)
    assert scoring.best_prior(prior).count() == 0
    r = scoring.predictive_value(c, scoring.judged_windows(x), scoring.prior_strength(prior)).first()
    assert r.surprisal == pytest.approx(0.96) and (r.baseline, r.pv) == (None, None)


def test_evidence_is_what_others_said_before(spark):
    rows = [("c", i, "prior", "identical", 0.9, None) for i in range(5)]
    docs = [(0, ANCHOR - 9, "x"), (1, ANCHOR - 1, "own"), (2, ANCHOR, "x"), (3, ANCHOR - 5, None), (4, ANCHOR - 5, "x")]
    x, _ = _lagged(spark, rows, docs)
    assert {r.doc_id for r in scoring.before(x).collect()} == {3, 4}  # neither itself, its own source, nor the same second


def test_predictive_value(spark):
    pre = [("c", i, "prior", "partial", 0.4, None) for i in range(1, 5)]
    post = [("c", i, "later", r, 0.5, None) for i, r in zip(range(11, 16), ["states", "states", "contradicts", "entails", "orthogonal"], strict=True)]
    docs = [(i, ANCHOR - 10 * DAY, "s") for i in range(1, 5)] + [(i, ANCHOR + 5 * DAY, "s") for i in range(11, 16)]
    x, c = _lagged(spark, pre + post, docs)
    r = scoring.predictive_value(c, scoring.judged_windows(x), scoring.prior_strength(scoring.before(x))).first()
    base, peak, s, f = 0.45 * 0.4, (0.5 + 0.5 + 0 + 0.45 + 0) / 5, 1.45, 0.5
    v = (s - f) / (s + f)
    assert (r.baseline, r.peak, r.vindication) == (pytest.approx(base), pytest.approx(peak), pytest.approx(v))
    assert r.pv == pytest.approx((1 - base) * (peak - base) * (1 + v) / 2)
    b = scoring.strongest(x).first()
    assert (b.anticipation, b.strength, b.contradiction, b.contra_conf) == (11, 0.5, 13, 0.5)


def test_the_rate_is_a_sample_and_support_is_not(spark):
    rows = [("c", i, "later", "states", 1.0, None) for i in range(1, 31)]
    x, _ = _lagged(spark, rows, [(i, ANCHOR + DAY, "s") for i in range(1, 31)])
    r = scoring.judged_windows(x).first()
    assert (r.judged, r.n, r.expressed, r.support) == (30, 10, 1.0, 30.0)


def test_a_prior_verdict_after_the_claim_falls_in_no_window(spark):
    x, _ = _lagged(spark, [("c", 1, "prior", "partial", 1.0, None), ("c", 2, "later", "states", 1.0, None)], [(1, ANCHOR + DAY, "s"), (2, ANCHOR - DAY, "s")])
    assert scoring.judged_windows(x).count() == 0


def test_originality_counts_sources_and_sure_topics(spark):
    rows = [("c", 1, "prior", "partial", 0.6, None), ("c", 2, "prior", "partial", 0.6, None), ("c", 3, "prior", "topical", 0.39, None), ("d", 1, "prior", "partial", 0.6, None), ("d", 4, "prior", "partial", 0.6, None)]
    docs = [(1, ANCHOR - 1, "s"), (2, ANCHOR - 1, "s"), (3, ANCHOR - 1, "t"), (4, ANCHOR - 1, "t")]
    x, _ = _lagged(spark, rows, docs, [("c", 0, ANCHOR, "own"), ("d", 0, ANCHOR, "own"), ("e", 0, ANCHOR, "own")])
    asked = spark.createDataFrame([("c", 50, 3), ("d", 50, 3), ("e", 0, 0)], "claim_id string, pool long, retrievers int")
    got = {r.claim_id: r for r in scoring.originality(scoring.before(x), asked).collect()}
    assert (got["c"].synthesis, got["d"].synthesis, got["e"].synthesis) == (False, True, False)
    cov = round(math.log1p(50) / math.log1p(20000) * (0.35 + 0.65 * 2 / 4), 4)
    hi = 1 - 0.45 * 0.6
    assert got["c"].coverage == pytest.approx(cov) and got["c"].lo == pytest.approx(hi * cov)
    assert got["c"].score == pytest.approx(hi * cov + (hi - hi * cov) * (0.35 + 0.65 * cov))
    assert (got["e"].hi, got["e"].score) == (1.0, pytest.approx(0.35))


def test_influence(spark):
    rows = [("c", 1, "later", "states", 0.9, True), ("c", 2, "later", "partially_anticipates", 0.5, False), ("c", 3, "later", "anticipates_directionally", 0.5, None), ("c", 4, "later", "orthogonal", 0.1, None), ("c", 5, "later", "entails", 1.0, True), ("c", 6, "later", "states", 0.49, True), ("c", 7, "later", "states", 1.0, True), ("c", 8, "later", "contradicts", 1.0, None)]
    docs = [(1, ANCHOR + 7 * DAY, "a"), (2, ANCHOR + 8 * DAY, "b"), (3, ANCHOR + 40 * DAY, "c"), (4, ANCHOR + 50 * DAY, "d"), (5, ANCHOR + DAY, "e"), (6, ANCHOR + DAY, "f"), (7, ANCHOR + DAY, "own"), (8, ANCHOR + 60 * DAY, "g")]
    x, c = _lagged(spark, rows, docs, [("c", 0, ANCHOR, "own"), ("none", 0, ANCHOR, "own")])
    follow = scoring.followers(x)
    hits = spark.createDataFrame([("c", 2), ("c", 5)], "claim_id string, doc_id long")
    same = spark.createDataFrame([(2, 1)], "doc_id long, canonical long")  # 2 is a copy of 1
    w = scoring.influence_windows(follow, hits, same)
    got = {r.win_days: r for r in w.where("claim_id = 'c'").collect()}
    assert (got[7].uptake_docs, got[7].uptake_sources, got[7].topical_docs) == (1, 1, 0)
    assert (got[30].uptake_docs, got[30].uptake_sources, got[30].strong_docs, got[30].fingerprint_docs) == (2, 1, 1, 1)
    assert (got[1095].uptake_docs, got[1095].uptake_sources, got[1095].topical_docs, got[1095].attributed_docs) == (3, 2, 2, 1)
    # the greatest lift is that of the first month, not of the last window
    assert got[30].lift == pytest.approx(2 / 4) and got[1095].lift == pytest.approx(3 / 7)
    s = {r.claim_id: r for r in scoring.influence_score(c, w).collect()}
    assert s["c"].influence == pytest.approx(0.45 * math.log1p(2) / math.log1p(12) + 0.20 * 0.5 + 0.15 / 3 + 0.10 / 3 + 0.10 / 3)
    assert s["none"].influence == 0.0
    f = scoring.first_follower(follow).collect()
    assert [(r.claim_id, r.doc_id, r.lead_days) for r in f] == [("c", 1, 7)]  # its own source, unsure and entailing documents don't count


def test_fingerprints_are_whole_words(spark):
    claims = spark.createDataFrame([("c", ["Café noir", "one"]), ("d", ["noir"]), ("e", None)], "claim_id string, fingerprints array<string>")
    docs = spark.createDataFrame([(1, None, "a CAFE, noir!"), (2, "cafe noire", None), (3, "one noir", "x")], "doc_id long, title string, text string")
    rows = spark.createDataFrame([(c, d) for c in "cde" for d in (1, 2, 3)] + [("c", 1)], "claim_id string, doc_id long")
    assert [tuple(r) for r in scoring.fingerprint_hits(rows, claims, docs).collect()] == [("c", 1)]


def test_weighted_mean_of_no_weight_is_zero(spark):
    df = spark.createDataFrame([(1, 0.5, 0.0), (1, 0.7, None), (2, 0.5, 1.0), (2, 1.0, 3.0)], "g int, x double, s double")
    got = {r.g: r.m for r in df.groupBy("g").agg(scoring.weighted_mean("x", "s").alias("m")).collect()}
    assert got == {1: 0.0, 2: pytest.approx(0.875)}


def test_source_scores_equal_plain_statistics(spark):
    rnd = random.Random(7)
    rows = [(s, x := round(rnd.random() * rnd.random(), 3), rnd.random(), rnd.choice([0.0, 0.25, x]), rnd.random(), rnd.choice([None, 0, 3, 700]), rnd.random() < 0.3) for s in ["a"] * 57 + ["b"] * 20 + ["c"] + [None] * 5 for _ in (0,)]
    got = {r.source_id: r for r in scoring.source_scores(spark.createDataFrame(rows, "source_id string, signal double, originality double, influence double, coverage double, lead_days long, synthesis boolean")).collect()}
    assert set(got) == {"a", "b", "c"}
    for s, r in got.items():
        own = [x for x in rows if x[0] == s]
        sig = sorted((x[1] for x in own), reverse=True)
        top = max(1, len(sig) // 10)
        peak, hit, mid = sum(sig[:top]) / top, sum(v >= 0.35 for v in sig) / len(sig), statistics.median(sig)
        assert (r.claims, r.peak, r.hit_rate, r.typical) == (len(own), pytest.approx(peak), pytest.approx(hit), pytest.approx(mid))
        assert r.headline == pytest.approx(0.5 * peak + 0.3 * hit + 0.2 * mid) and r.n_synthesis == sum(x[6] for x in own)
        assert r.median_originality == pytest.approx(statistics.median([x[2] for x in own])) and r.median_influence == pytest.approx(statistics.median([x[3] for x in own]))
        leads = [x[5] for x in own if x[5] is not None]
        assert r.median_lead_days == (statistics.median(leads) if leads else None)


def test_pools_are_strictly_older(spark):
    docs = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, DAY), (5, None)], "doc_id long, ts long")
    claims = spark.createDataFrame([("a", 5), ("b", 6), ("c", 10 * DAY), ("d", 1), ("e", None)], "claim_id string, anchor_ts long")
    assert {r.claim_id: r.pool for r in scoring.pools(claims, docs).collect()} == {"a": 0, "b": 2, "c": 4, "d": 0, "e": 0}


def test_unknown_relations_and_missing_confidence(spark):
    j = spark.createDataFrame([("c", 1, "prior", "Identical", None, None, None, 1), ("c", 1, "later", "related", 1.7, None, None, 1), ("c", 2, "sideways", "states", 1.0, None, None, 1)], "claim_id string, doc_id long, direction string, relation string, confidence double, quote string, attributes_source boolean, judged_at long")
    got = {r.direction: (r.relation, r.weight, r.conf) for r in store.first_verdicts(j).collect()}
    assert got == {"prior": ("unrelated", 0.0, 0.5), "later": ("orthogonal", 0.0, 1.0)}
    assert store.first_verdicts(j.where(F.lit(False))).count() == 0
