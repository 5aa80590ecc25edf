import json

from pyspark.sql import functions as F

from chronolex.functions import pages
from chronolex.operators import store
from chronolex.sources import landed


def test_posts_of_each_platform(spark, tmp_path):
    body = "<p>" + "word " * 100 + "</p>"
    sub = [{"id": 1, "title": "A &amp; B", "post_date": "2020-01-02", "canonical_url": "u", "body_html": body, "audience": "all"}, {"id": 1, "title": "again", "post_date": "2021", "canonical_url": "v", "body_html": body}, {"id": 2, "body_html": "<p>short</p>"}, {"title": "no id", "body_html": body}, {"id": 3, "body_html": None}]
    (tmp_path / "s.jsonl").write_text("\n".join([*map(json.dumps, sub), "not json", ""]))
    got = [(r.id, r.url, r.title, r.published_at, len(r.text)) for r in landed.read_posts(spark, str(tmp_path / "s.jsonl"), "substack").collect()]
    assert got == [("1", "u", "A & B", "2020-01-02", 499)]
    wp = [{"id": 7, "link": "l", "date_gmt": "2020", "title": {"rendered": "T"}, "content": {"rendered": body}}, {"id": 8, "content": {"rendered": "<p>" + "w " * 150 + "</p>"}}]
    hn = [{"objectID": "9", "created_at_i": 5, "points": 10, "story_text": body}, {"objectID": "10", "points": 9, "story_text": body}, {"objectID": "11", "story_text": body}]
    for rows, kind, want in ((wp, "wordpress", {"7"}), (hn, "hn", {"9"})):
        df = spark.createDataFrame([(json.dumps(r), 1) for r in rows], "j string, id int")
        assert {r.id for r in landed.posts(df, "j", kind).collect()} == want and landed.posts(df.where("false"), "j", kind).count() == 0


def test_walks_and_spans(spark):
    rows = spark.createDataFrame([("a", 50), ("a", 90), ("a", 91), ("a", None), (None, 5)], "channel string, ts long")
    got = {(r.channel, r.page): (r.rows, r.cursor, r.stalled) for r in landed.cursors(rows, F.when(F.col("ts") == 50, 0).otherwise(1)).collect()}
    assert got == {("a", 0): (1, 50, False), ("a", 1): (2, 90, True), (None, 1): (1, 5, False)}
    assert [tuple(r) for r in landed.tiles(10, 35, 10, spark).orderBy("tile").collect()] == [(0, 10, 20), (1, 20, 30), (2, 30, 35)]
    c = spark.createDataFrame([("x", 400 * 86400), ("y", None)], "claim_id string, anchor_ts long")
    assert {(r.span, r.from_ts // 86400, r.to_ts // 86400) for r in landed.spans(c, [(0, 90)], 36 * 86400).collect()} == {(1, 400, 490)}
    seen = spark.createDataFrame([("http://a", 5, None), ("http://a", 3, "t"), ("ftp://b", 1, "t"), (None, 1, "t"), ("http://c", None, "t")], "url string, ts long, title string")
    assert [tuple(r) for r in landed.first_seen(seen).collect()] == [("http://a", 3, "t")]


def test_store_writes(spark):
    old = spark.createDataFrame([("k", "m1", 64, [1.0]), ("o", "m1", 64, [2.0])], "key string, model string, dim int, vec array<double>")
    new = spark.createDataFrame([("k", "m2", 32, [3.0], 1), ("k", "m3", 16, [4.0], 2), ("n", "m2", 32, [5.0], 1)], "key string, model string, dim int, vec array<double>, seq int")
    assert {tuple(map(str, r)) for r in store.updated_vectors(old, new, ["seq"]).collect()} == {("k", "m3", "64", "[4.0]"), ("o", "m1", "64", "[2.0]"), ("n", "m2", "32", "[5.0]")}
    runs = spark.createDataFrame([("a", 1, None), ("b", 2, 5)], "run_id string, started_at long, finished_at long")
    ends = spark.createDataFrame([("a", 7), ("a", 9), ("z", 1), ("b", None)], "run_id string, ended_at long")
    assert {tuple(r) for r in store.finished_runs(runs, ends).collect()} == {("a", 1, 9), ("b", 2, 5)}
    s = spark.createDataFrame([("1", "The Post"), ("2", None)], "id string, name string")
    assert [tuple(r) for r in store.found_sources(s, spark.createDataFrame([("THE post",), ("x",)], "asked string")).collect()] == [("THE post", "1")]
    kept = store.first_wins(spark.createDataFrame([("u", 1)], "url string, doc_id int"), spark.createDataFrame([("u", 2), ("v", 4), ("v", 3)], "url string, doc_id int"), ["url"], ["doc_id"])
    assert {tuple(r) for r in kept.collect()} == {("u", 1), ("v", 3)}


def test_scorable_falls_back_to_the_oldest(spark):
    d = spark.createDataFrame([(1, 0, "x" * 9), (2, 86400 * 5, "x" * 9), (3, 86400 * 9, "x"), (4, None, "x" * 9), (5, 7, None)], "doc_id int, ts long, text string")
    pick = lambda days: {(r.doc_id, r.fallback) for r in store.scorable(d, 5, days, 1).collect()}
    assert pick(4) == {(1, False), (2, False)} and pick(100) == {(1, True)}
    assert store.scorable(d.where("false"), 5, 1, 3).count() == 0


def test_marks_dates_and_hashes(spark):
    df = spark.createDataFrame([("\u201cIt\u2019s\u201d \u2014 a\u00a0b\u2026", 10**9, {"b": "2", "a": "1"}), (None, 10**8, None), ("", None, {})], "t string, ts long, m map<string,string>")
    got = df.select(pages.plain_marks(F.col("t")).alias("p"), pages.quoted(F.col("t")).alias("q"), pages.plausible(F.col("ts")).alias("ts"), store.config_hash(F.col("m")).alias("h")).collect()
    assert [r.p for r in got] == ["\"It's\" - a b...", None, ""] and got[0].q.startswith("%E2%80%9CIt%E2%80%99s") and [r.ts for r in got] == [10**9, None, None]
    import hashlib

    assert got[0].h == hashlib.sha256(b'{"a": "1", "b": "2"}').hexdigest()[:16] and got[1].h is None
