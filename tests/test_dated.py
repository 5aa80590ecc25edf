import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chronolex.functions import pages
from chronolex.operators import anchors, excerpts, minhash, prevalence, store, syndication
from chronolex.plans import extra
from chronolex.sources import feeds, snapshots

HEAD = "<html><head><title>Plain &amp; simple</title></head>"
PAGES = [
    (1, None, None),
    (2, "", ""),
    (3, f'{HEAD}<body><nav>Menu</nav><article class="a"><h1>One <b>two</b></h1><p>First , line</p><script>x()</script><div><p>Second&nbsp;line</p></div></article><footer>End</footer><a href=\'https://b.test/x?a=1&amp;b=2\'>b</a><a>none</a><a name="q" href="https://a.test/">a</a><a href="https://a.test/">again</a></body></html>', "https://x.test/2021/3/04/piece"),
    (4, '<meta property="og:title" content="Shared &quot;title&quot;"><meta content="2020-02-03" name="date"><time datetime="2019-01-01">then</time><p>No body element', "https://x.test/"),
    (5, '<script type="application/ld+json">{"@type": "Article", "datePublished": "2018-05-06T07:08:09Z"}</script><meta name="date" content="2001-01-01"><main>Main only</main>', None),
    (6, "<p>" + "long " * 50000 + "</p>", None),
]


def test_pages(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "id int, html string, url string, title string")
    h, u = F.col("html"), F.col("url")
    got = {r.id: r for r in df.select("id", pages.main_text(h).alias("text"), pages.title(h).alias("t"), pages.links(h).alias("links"), pages.date(h, u).alias("d")).collect()}
    assert [got[i].text for i in range(1, 6)] == ["", "", "One two\nFirst, line\nSecond line", "then\nNo body element", "Main only"]
    assert len(got[6].text) == 249999
    assert [got[i].t for i in range(1, 6)] == [None, None, "One two", 'Shared "title"', None]
    assert got[3].links == ["https://b.test/x?a=1&b=2", "https://a.test/"] and got[1].links == []
    assert [got[i].d and (got[i].d.value, got[i].d.confidence, got[i].d.provenance) for i in range(1, 6)] == [None, None, ("2021-03-04", "inferred", "url:path-date"), ("2020-02-03", "day", "meta:date"), ("2018-05-06T07:08:09Z", "exact", "jsonld:datePublished")]


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed><entry><id>1</id><title>On\n things</title><summary>About  them.</summary><published>2020-01-02T03:04:05Z</published><author><name>A B</name></author><author><name>C</name></author></entry><entry><id>2</id><title>Bare</title><published>soon</published></entry></feed>")
    got = {r.id: r for r in feeds.read_atom(spark, str(tmp_path / "a.xml")).collect()}
    assert (got["1"].title, got["1"].text, got["1"].published_ts) == ("On things", "On things\n\nA B, C\n\nAbout them.", 1577934245)
    assert (got["2"].text, got["2"].published_ts) == ("Bare", None)
    rows = [{"url": "u", "title": "later", "seendate": "20240102T000000Z", "domain": " A.Test"}, {"url": "u", "title": "first", "seendate": "20240101T000000Z", "domain": "A.test"}, {"url": "v", "title": None, "seendate": "2024-01-01"}, {"title": "no url"}]
    (tmp_path / "n.json").write_text("\n".join(map(json.dumps, rows)))
    got = {r.url: (r.title, r.domain, r.published_ts) for r in feeds.read_news(spark, str(tmp_path / "n.json")).collect()}
    assert got == {"u": ("first", "a.test", 1704067200), "v": (None, None, None)}


def test_snapshots(spark, tmp_path):
    d = spark.createDataFrame([(1, "2020-01-01T00:00:00Z", None, None, None), (2, None, None, None, "s")], "doc_id int, published_at string, retrieved_at timestamp, date_provenance string, source_id string")
    tables = {"documents": d, "sources": spark.createDataFrame([("s", {"tz": "Europe/Paris"})], "id string, metadata map<string,string>"), "claims": spark.createDataFrame([], "id string")}
    m = {r["name"]: (r["rows"], r.first_ts) for r in snapshots.snapshot(tables, str(tmp_path / "s")).collect()}
    assert m == {"documents": (2, 1577836800), "sources": (1, None), "claims": (0, None)}
    with pytest.raises(AnalysisException):
        snapshots.snapshot(tables, str(tmp_path / "s"))
    snapshots.snapshot(tables, str(tmp_path / "s"), force=True)
    assert snapshots.restore(spark, str(tmp_path / "s"), str(tmp_path / "r")).count() == 3
    with pytest.raises(AnalysisException):
        snapshots.restore(spark, str(tmp_path / "s"), str(tmp_path / "r"))


def _excerpt(text, terms, width):
    """The same by plain slicing."""
    if len(text) <= width or not terms:
        return text[:width]
    found = [(sum(t in text[s : s + width].lower() for t in terms), -s) for s in range(0, max(len(text) - width, 1), max(width // 3, 200))]
    at = -max(found)[1]
    edge = text.rfind("\n\n", max(0, at - 300), at + 1)
    return text[(edge + 2 if edge >= 0 else at) :][:width]


def test_excerpts(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "x", "\n\n", "\n"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 900))), rnd.sample(["alpha", "gamma", "zeta", "missing"], rnd.randint(0, 3)), 1) for i in range(120)] + [(900, None, ["alpha"], 1), (901, "", ["alpha"], 1), (902, "end\n\n" * 40000, ["end"], 1)]
    df = spark.createDataFrame(rows, "id int, text string, terms array<string>, excerpt int")
    got = {r.id: r.excerpt for r in excerpts.best_excerpt(df.drop("excerpt"), 600).collect()}
    assert got == {i: None if t is None else _excerpt(t, k, 600) for i, t, k, _ in rows}


def test_chunks_keep_all(spark):
    rnd = random.Random(5)
    texts = ["\n\n".join("w" * rnd.randint(1, 90) for _ in range(rnd.randint(1, 30))) for _ in range(50)] + ["", "a" * 500, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in df.select("id", "text", excerpts.paragraph_chunks(F.col("text"), 200).alias("c")).collect():
        if r.text is None:
            assert r.c is None
        else:
            assert "\n\n".join(r.c) == r.text
            assert all(len(c) <= 200 or "\n\n" not in c for c in r.c)
            assert all(len(a) + 2 + len(b.split("\n\n")[0]) > 200 for a, b in zip(r.c, r.c[1:], strict=False))


def test_fallback_queries(spark):
    df = spark.createDataFrame([("a", "Some plain words here", ["Bob", "Alice B", "Carol", "Dora"]), ("b", "The plain words here now", []), ("c", None, None), ("d", "a b c", None)], "id string, text string, entities array<string>")
    got = {r.id: r.queries for r in excerpts.fallback_queries(df, stop=["plain"]).collect()}
    assert got == {"a": ['"Alice B"', '"Carol"'], "b": ["words here"], "c": [], "d": []}


def _stories(n=40, seed=9):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs = []
    for _ in range(n):
        w = [rnd.choice(vocab) for _ in range(60)]
        docs.append(" ".join(w))
        for _ in range(rnd.randint(0, 4)):
            v = list(w)
            for _ in range(rnd.randint(0, 4)):
                v[rnd.randrange(len(v))] = "edit" + rnd.choice(vocab)
            docs.append(" ".join(v))
    return docs + ["", None, "too short to sign", docs[0], docs[0]]


def test_syndication_equals_all_pairs(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(_stories())], "doc_id long, text string, signature string")
    sig = {r.doc_id: r.signature for r in minhash.signatures(df).collect()}
    ids, up = sorted(sig), {i: i for i in sig}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            same = [x == y for x, y in zip(sig[a], sig[b], strict=True)]
            if a < b and sum(same) / 64 >= 0.55 and any(all(same[k : k + 4]) for k in range(0, 64, 4)):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    size = {}
    for i in ids:
        size[root(i)] = size.get(root(i), 0) + 1
    got = {r.doc_id: r.class_id for r in syndication.classes(df).collect()}
    assert got == {i: root(i) for i in ids if size[root(i)] > 1} and got
    assert syndication.classes(df.where("false")).count() == 0


def test_canonicals(spark):
    docs = spark.createDataFrame([(1, 50), (2, 10), (3, 10), (4, None), (5, None)], "doc_id long, ts long")
    cl = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "doc_id long, class_id long")
    c = syndication.canonicals(docs, cl)
    assert {r.doc_id: r.canonical for r in c.collect()} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 4}
    e = spark.createDataFrame([("c", 1, "s1", 50), ("c", 2, "s2", 10), ("c", 9, "s2", 1), ("c", 9, "s2", 1), ("d", 7, None, 3)], "claim_id string, doc_id long, source_id string, ts long")
    assert {r.claim_id: r.sources for r in syndication.independent_sources(e, c).collect()} == {"c": 1, "d": 0}


def test_prevalence(spark):
    day = 86400
    claims = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], None), (None, [1.0, 0.0], 0)], "id long, vec array<double>, anchor_ts long")
    docs = [(1, [1.0, 0.0], 5), (10, [0.5, 0.8], -1), (11, [1.0, 0.0], 0), (12, [1.0, 0.0], 90 * day - 1), (13, [1.0, 0.0], 90 * day), (14, [0.1, 0.9], 5), (15, None, 5), (16, [1.0, 0.0], None), (17, [0.5, 0.8], -730 * day - 1), (18, [0.5, 0.8], -730 * day)]
    docs = spark.createDataFrame(docs, "id long, vec array<double>, ts long")
    c = prevalence.curve(claims, docs, block=2)
    assert {(r.claim_id, r.win, r.n_topical, r.n_expressing) for r in c.collect()} == {(1, 1, 1, 0), (1, 0, 1, 0), (1, 2, 2, 2), (1, 3, 1, 1)}
    s = prevalence.summary(c, least=1).first()
    assert (s.baseline, s.peak, s.adoption, s.surprisal, s.lead_days) == (0.0, 1.0, 1.0, 1.0, 45)
    s = prevalence.summary(c, least=2).first()
    assert (s.baseline, s.peak, s.adoption, s.lead_days) == (None, 1.0, None, None)
    none = spark.createDataFrame([], "doc_id long, canonical long")
    top = prevalence.candidates(claims, docs, none, pool=1)
    assert {(r.win, r.doc_id, r.n_topical) for r in top.collect()} == {(1, 10, 1), (0, 18, 1), (2, 12, 2), (3, 13, 1)}
    # of one story the most similar document stands for all, in one place of the pool
    same = spark.createDataFrame([(11, 12), (12, 12), (10, 12)], "doc_id long, canonical long")
    found = prevalence.candidates(claims, docs, same, block=1)
    assert {(r.win, r.doc_id, r.n_topical) for r in found.collect()} == {(1, 10, 1), (0, 18, 1), (2, 12, 2), (3, 13, 1)}
    assert {(r.win, r.doc_id, r.in_trail) for r in prevalence.chosen(found).collect()} == {(1, 10, True), (0, 18, True), (2, 12, True), (3, 13, True)}
    assert prevalence.curve(claims, docs.where("false")).count() == 0 and prevalence.candidates(claims.where("false"), docs, none).count() == 0


def test_first_use(spark):
    cols = "claim_id string, doc_id long, direction string, relation string, conf double, quote string, ts long, anchor_ts long, lag long, source_id string, own_source string, own_doc long"
    q = "the very same words"
    end = 86400 * 3
    row = lambda c, d, r, s, quote, ts, src="s": (c, d, "prior", r, s, quote, ts, end, ts - end, src, "s" if src else None, 99)
    # seven earlier verdicts that say nothing don't hide the one that does
    rows = [row("a", 20 + i, "topical", 0.9, q, i) for i in range(7)] + [row("a", 1, "identical", 0.9, q, 100), row("a", 2, "identical", 0.9, q, 50, "t"), row("a", 3, "identical", 0.5, q, 10), row("a", 4, "paraphrase", 0.6, "not in the text at all", 20), row("a", 99, "identical", 0.9, q, 5), row("b", 1, "partial", 0.9, q, 100), row("c", 1, "identical", 0.9, None, 100), row("d", 1, "identical", 0.9, q, end), row("e", 1, "identical", 0.9, q, 100, None)]
    docs = spark.createDataFrame([(1, "He used The Very same words.", 7), (2, q, 7), (3, q, 7), (4, None, 7), (99, q, 7)], "doc_id long, text string, ts long")
    got = [(r.claim_id, r.doc_id, r.first_ts, r.statements, r.moved_days) for r in anchors.first_use(spark.createDataFrame(rows, cols), docs).collect()]
    assert got == [("a", 1, 100, 1, 2)]
    assert anchors.first_use(spark.createDataFrame([], cols), docs).count() == 0


def test_ablation_is_never_zero_without_decoy(spark):
    g = spark.createDataFrame([("a", "closed", 0.7, False), ("a", "source", 1.4, None), ("b", "closed", 0.2, True), ("b", "source", 0.5, None), ("b", "decoy", 0.4, None), ("c", "source", 0.5, None), ("d", "closed", 0.9, True), ("d", "source", None, None)], "claim_id string, condition string, score double, hedged boolean")
    got = {r.claim_id: (r.value if r.value is None else round(r.value, 6), r.decoy_controlled, r.internalised) for r in anchors.ablation_values(g).collect()}
    assert got["a"] == (0.3, False, True) and got["b"] == (0.1, True, False) and got["c"][:2] == (None, False)
    # a failed grade is a null one and must not be read as 0
    assert got["d"] == (None, False, False)


def test_top_per_breaks_ties_by_order(spark):
    df = spark.createDataFrame([("k", 1, 5), ("k", 1, 4), (None, 2, 1)], "k string, v int, i int")
    assert {(r.k, r.i, r.place) for r in store.top_per(df, ["k"], [F.desc("v"), "i"], 1).collect()} == {("k", 4, 1), (None, 1, 1)}


def test_stream_has_its_open_windows(spark):
    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.s, r.event_type): (r.n, round(r.total, 4)) for r in e.groupBy(F.date_trunc("hour", "ts").alias("s"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    rows = extra.stream_tumbling(spark, sf).collect()
    assert len(rows) == len(want) and {(r.window_start, r.event_type): (r.n, round(r.total, 4)) for r in rows} == want
