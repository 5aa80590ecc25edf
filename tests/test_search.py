import math
import random
from collections import Counter

import pytest

from __spark_entry__ import oracle_sql, queries
from chronolex import scratch
from chronolex.operators import search

Q = "query_id long, text string, before long, after long, exclude_source string, exclude_doc long"
D = "doc_id long, title string, text string, ts long, source_id string, extra int"
DOCS = [(1, "Été", "the quick brown fox", 10, "a", 1), (2, None, "Quick quick brown dogs", 20, "b", 1), (3, "", None, 30, None, 1), (4, "brown fox fox", "quick", 40, "a", 1), (5, None, "nothing here", None, "a", 1), (6, "brown", "fox", 50, None, 1)]


def _docs(spark):
    d = spark.createDataFrame(DOCS, D)
    told = search.words(d)
    return told, search.postings(told)


def test_tokens_fold_and_keep_letters(spark):
    df = spark.createDataFrame([("Été à Łódź, naïve x1",), (None,), ("",)], "t string")
    assert [r.w for r in df.select(search.tokens("t").alias("w")).collect()] == [["ete", "a", "łodz", "naive", "x1"], [], []]


def test_bm25_in_slices(spark):
    d, index = _docs(spark)
    q = spark.createDataFrame([(1, "quick fox", 45, 10, None, None), (2, "quick fox", None, None, "a", 2), (3, "ete", None, None, None, None), (4, "a of", None, None, None, None), (5, None, None, None, None, None)], Q)
    got = {}
    for r in search.bm25(q, index).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {1: [4, 2], 2: [6], 3: [1]}


def test_phrases_are_whole_and_sliced(spark):
    d, index = _docs(spark)
    p = spark.createDataFrame([(1, "Brown FOX", None, None, None, None), (1, "quick", None, None, None, None), (2, "brown fox", 50, 10, None, None), (3, "the quick brown fox jumps", None, None, None, None), (4, "quick brown dogs", None, None, "a", None), (5, None, None, None, None, None)], "query_id long, phrase string, before long, after long, exclude_source string, exclude_doc long")
    got = {}
    for r in search.phrase_search(p, d, index).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert got == {1: {1, 4, 6}, 2: {4}, 4: {2}}


def test_dense_slices(spark):
    rnd = random.Random(4)
    day = 86400
    docs = [(i, [rnd.gauss(0, 1) for _ in range(4)], rnd.randrange(0, 2000) * day, rnd.choice(["a", "b", None])) for i in range(300)] + [(900, None, 5, "a"), (901, [1.0, 0.0, 0.0, 0.0], None, "a")]
    qs = [(i, docs[i][1], rnd.choice([None, 900 * day]), rnd.choice([None, 100 * day]), rnd.choice([None, "a"])) for i in range(0, 300, 20)]
    v = spark.createDataFrame(docs, "id long, vec array<double>, ts long, source_id string")
    q = spark.createDataFrame(qs, "id long, vec array<double>, before long, after long, exclude_source string")
    got = {}
    for r in search.dense_topk(q, v, k=5, block=16).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    for i, x, hi, lo, src in qs:
        ok = [(-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y, t, s in docs if y and t is not None and j != i and (hi is None or t < hi) and (lo is None or t > lo) and (src is None or s is None or s != src)]
        assert got.get(i, []) == [j for _, j in sorted(ok)[:5]]
    plain = search.dense_topk(v.where("id = 0").select("id", "vec"), v.select("id", "vec"), k=3)
    assert plain.count() == 3 and search.dense_topk(q.where("false"), v).count() == 0 and search.dense_topk(q, v.where("false")).count() == 0


def test_fusion_sums_places_and_gives_the_bonus_once(spark):
    rows = [(1, 5, 1, "lexical", None), (1, 6, 1, "dense", None), (1, 6, 3, "lexical", None), (1, 5, 9, "fingerprint", "a b"), (1, 5, 2, "fingerprint", "c d")]
    got = search.rank_fusion(spark.createDataFrame(rows, "query_id long, doc_id long, place int, retriever string, hit string")).orderBy("place").collect()
    assert [(r.doc_id, r.best_rank, r.retrievers, r.hits) for r in got] == [(5, 1, ["fingerprint", "lexical"], ["a b", "c d"]), (6, 1, ["dense", "lexical"], [])]
    assert got[0].score == round(1 / 61 + 1 / 69 + 1 / 62 + 0.5, 6) and got[1].score == round(1 / 61 + 1 / 63, 6)


def test_queries_and_windows(spark):
    t = spark.createDataFrame([(1, 0, "The claim"), (1, 1, " the CLAIM "), (1, 2, None), (1, 3, ""), (1, 4, "other"), (1, 5, "third")], "query_id long, pos int, text string")
    assert [(r.n, r.text) for r in search.distinct_queries(t, 2).orderBy("n").collect()] == [(0, "The claim"), (1, "other")]
    f = spark.createDataFrame([(1, 0, 7, 0.2), (1, 1, 7, 0.5), (1, 2, 7, 0.5), (1, 0, 8, 0.5), (1, 0, 9, 0.1)], "query_id long, win int, doc_id long, score double")
    assert [(r.doc_id, r.win, r.score) for r in search.best_over_windows(f, 2).orderBy("place").collect()] == [(7, 1, 0.5), (8, 0, 0.5)]
    assert search.postings(search.words(spark.createDataFrame([], D))).count() == 0


def test_lists_stay_in_blocks_and_queries_come_to_them(spark):
    rnd = random.Random(7)
    word = [f"wo{i}" for i in range(40)]
    docs = [(i, None, " ".join(rnd.choices(word, [1 / (j + 1) for j in range(40)], k=rnd.randrange(0, 30))), rnd.choice([None, *range(50)]), rnd.choice(["a", "b", None])) for i in range(120)]
    qs = [(i, " ".join(["wo99", *rnd.choices(word, k=4)]), rnd.choice([None, 40]), rnd.choice([None, 10]), rnd.choice([None, "a"]), rnd.choice([None, i])) for i in range(20)]
    told = search.words(spark.createDataFrame(docs, "doc_id long, title string, text string, ts long, source_id string").repartition(4))
    index = search.postings(told)
    assert index.count() <= 4
    tf = {i: Counter(text.split()) for i, _, text, _, _ in docs}
    n, avgdl = len(docs), sum(sum(c.values()) for c in tf.values()) / len(docs)
    want = {}
    for i, text, before, after, source, own in qs:
        scores = []
        for j, _, _, ts, s in docs:
            if (ts is not None and (before is not None and ts >= before or after is not None and ts <= after)) or (source and s == source) or j == own:
                continue
            dl, x = sum(tf[j].values()), 0.0
            for w in set(text.split()):
                df = sum(w in c for c in tf.values())
                x += max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf[j][w] * 2.2 / (tf[j][w] + 1.2 * (0.25 + 0.75 * dl / avgdl))
            if any(w in tf[j] for w in text.split()):
                scores.append((-round(x, 6), j))
        want[i] = [(j, -x) for x, j in sorted(scores)[:5]]
    got = {i: [] for i in want}
    for r in search.bm25(spark.createDataFrame(qs, Q), index, 5).orderBy("query_id", "place").collect():
        got[r.query_id].append((r.doc_id, r.score))
    assert got == want


def test_stems_take_the_place_of_a_blocks_words(spark):
    docs = [(1, "Running runs", "ponies été", 5, "a"), (2, None, "the pony ran; running", 2, None), (3, None, None, None, "a")]
    told = search.words(spark.createDataFrame(docs, "doc_id long, title string, text string, ts long, source_id string"))
    numbers = lambda x: list(memoryview(bytes(x)).cast("i"))
    got = {}
    for block in search.stemmed(told).collect():
        assert len(block.terms) == len(set(block.terms)) and len(block.docs) == len(block.ts) == len(block.sources)
        ws = iter([block.terms[i] for i in numbers(block.at)])
        got |= {d: [next(ws) for _ in range(n)] for d, n in zip(block.docs, numbers(block.dl), strict=True)}
    assert got == {1: ["run", "run", "poni", "et"], 2: ["the", "poni", "ran", "run"], 3: []}
    assert search.stemmed(told).schema == told.schema


def test_documents_with_a_phrase_stay_in_their_blocks(spark):
    docs = [(i, None, f"{'x ' * (i % 7)}common words here and no no no no {'other' if i % 3 else 'word'}", i if i % 5 else None, "ab"[i % 2]) for i in range(200)]
    told = search.words(spark.createDataFrame(docs, "doc_id long, title string, text string, ts long, source_id string"))
    asked = [(1, "common words", None, None, None, None), (1, "no no", 150, 20, "a", 33), (2, "Common words", 30, None, None, 1), (3, "no other", None, 190, None, None), (4, "words common", None, None, None, None)]
    hits = search.phrase_search(spark.createDataFrame(asked, "query_id long, phrase string, before long, after long, exclude_source string, exclude_doc long"), told, search.postings(told), 3)
    got = {}
    for r in hits.orderBy("query_id", "phrase", "place").collect():
        got.setdefault((r.query_id, r.phrase), []).append((r.doc_id, r.score))
    avgdl, want = sum(len(t.split()) for _, _, t, _, _ in docs) / 200, {}
    for i, phrase, before, after, source, own in asked:
        tf = {j: f" {t} ".replace(" ", "  ").count("".join(f" {w} " for w in phrase.lower().split())) for j, _, t, _, _ in docs}
        df = sum(n > 0 for n in tf.values())
        rows = [(-round(max(math.log((200 - df + 0.5) / (df + 0.5)), 1e-6) * tf[j] * 2.2 / (tf[j] + 1.2 * (0.25 + 0.75 * len(t.split()) / avgdl)), 6), j) for j, _, t, ts, s in docs if tf[j] and not (ts is not None and (before is not None and ts >= before or after is not None and ts <= after)) and s != source and j != own]
        want |= {(i, phrase): [(j, -x) for x, j in sorted(rows)[:3]]} if rows else {}
    assert got == want
    plan = hits._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate explode" not in plan


def _from_python(node) -> int:
    """Rows that a plan which has run got from Python."""
    own = node.metrics().get("pythonNumRowsReceived")
    return (own.get().value() if node.nodeName() == "MapInArrow" else 0) + sum(_from_python(node.children().apply(i)) for i in range(node.children().size()))


def test_a_task_keeps_the_best_of_all_its_blocks(spark):
    rnd = random.Random(11)
    word = [f"wo{i}" for i in range(60)]
    docs = [(i, None, " ".join(rnd.choices(word, [1 / (j + 1) for j in range(60)], k=rnd.randrange(0, 40))), rnd.choice([None, *range(90)]), rnd.choice(["a", "b", None])) for i in range(900)]
    qs = [(i, " ".join(["wo0", "wo1", *rnd.choices(word, k=5)]), rnd.choice([None, 80]), rnd.choice([None, 10]), rnd.choice([None, "a"]), rnd.choice([None, i])) for i in range(20)]
    told = scratch.written(search.words(spark.createDataFrame(docs, "doc_id long, title string, text string, ts long, source_id string").repartition(12)))
    index = search.postings(told)
    asked = spark.createDataFrame(qs, Q)
    phrases = spark.createDataFrame([(i, p, *rest) for i, text, *rest in qs for p in (text[:7], "wo0 wo0")], "query_id long, phrase string, before long, after long, exclude_source string, exclude_doc long").distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        for found, most in ((lambda k: search.bm25(asked, index, k), 20), (lambda k: search.phrase_search(phrases, told, index, k), 40)):
            every, few = {}, {}
            for k, out in ((1000, every), (3, few)):
                hits = found(k)
                for r in sorted(hits.collect()):
                    out.setdefault(r[:-3], []).append((r.place, r.doc_id, r.score))
            assert {q: sorted(x) for q, x in few.items()} == {q: sorted(x)[:3] for q, x in every.items()}
            # the lists are made in Python too, a row a block
            assert _from_python(hits._jdf.queryExecution().executedPlan()) <= 4 * 3 * most + 2 * 12
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ends_sources_and_own_documents_hold_from_the_first_block(spark):
    rnd = random.Random(5)
    docs = [(i, None, " ".join(rnd.choices([f"wo{j}" for j in range(12)], k=rnd.randrange(1, 9))), rnd.choice([None, *range(60)]), rnd.choice(["a", "b", "c", None])) for i in range(3000)]
    qs = [(i, "wo1 wo2 wo11", *x) for i, x in enumerate([(None, None, None, None), (0, None, None, None), (30, None, "a", None), (None, 20, "b", 7), (40, 39, None, None), (59, 10, "c", 8)])]
    told = search.words(spark.createDataFrame(docs, "doc_id long, title string, text string, ts long, source_id string").repartition(4))
    index, tf = search.postings(told), {i: Counter(text.split()) for i, _, text, _, _ in docs}
    avgdl, dfs = sum(sum(c.values()) for c in tf.values()) / len(docs), {w: sum(w in c for c in tf.values()) for w in ("wo1", "wo2", "wo11")}
    got = {}
    for r in search.bm25(spark.createDataFrame(qs, Q), index, 4).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for i, _, before, after, source, own in qs:
        ok = [(j, tf[j]) for j, _, _, ts, s in docs if not (ts is not None and (before is not None and ts >= before or after is not None and ts <= after)) and not (source and s == source) and j != own]
        score = lambda c: round(sum(max(math.log((3000 - n + 0.5) / (n + 0.5)), 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avgdl)) for w, n in dfs.items()), 6)
        assert got.get(i, []) == [(j, -x) for x, j in sorted((-score(c), j) for j, c in ok if any(c[w] for w in dfs))[:4]]


@pytest.mark.parametrize("name", ["bm25_search", "porter_bm25", "rrf_fusion"])
def test_every_claim_is_asked(spark, name):
    sf = "/root/testdata/sf0.001"
    claims = {r.id: r.doc_id for r in spark.read.parquet(f"{sf}/claims.parquet").collect()}
    found = {r.query_id for r in queries()[name](spark, sf).collect()}
    # only what has nothing before it may find nothing
    assert len(found) > 0.9 * len(claims) and len({claims[i] % 20 for i in found}) > 15
    assert "% 20" not in oracle_sql().get(name, "")


def test_phrases_of_every_claim_are_asked(spark):
    sf = "/root/testdata/sf0.001"
    claims = {r.id: r.doc_id for r in spark.read.parquet(f"{sf}/claims.parquet").collect()}
    found = {r.query_id for r in queries()["phrase_search"](spark, sf).collect()}
    assert len({claims[i] % 20 for i in found}) > 5 and "% 20" not in oracle_sql()["phrase_search"]
