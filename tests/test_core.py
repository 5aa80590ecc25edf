from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest

from chronolex.functions import zones
from chronolex.operators import evidence, graph, scoring, search, store, timestamps

DOC = "doc_id long, published_at string, date_provenance string, source_id string, extra int, id string"
SRC = "id string, metadata map<string,string>"


def epoch(*a, tz=UTC):
    return int(datetime(*a, tzinfo=tz).timestamp())


NY, PARIS = ZoneInfo("America/New_York"), ZoneInfo("Europe/Paris")
CASES = [
    ("2020-08-23T03:48:55.096Z", None, epoch(2020, 8, 23, 3, 48, 55)),
    ("2020-08-30T04:27:06−04:00", None, epoch(2020, 8, 30, 8, 27, 6)),
    ("1647071334635", None, 1647071334),
    ("20230917142240Z", None, epoch(2023, 9, 17, 14, 22, 40)),
    ("20180223T113034Z", None, epoch(2018, 2, 23, 11, 30, 34)),
    ("31 de octubre de 2023 a las 13:05", "fr", epoch(2023, 10, 31, 13, 5, tz=PARIS)),
    ("1er mars 2017", "fr", epoch(2017, 3, 1, tz=PARIS)),
    ("14 mars 2021 à 16h31", "fr", epoch(2021, 3, 14, 16, 31, tz=PARIS)),
    ("02/03/24", "us", epoch(2024, 2, 3, tz=NY)),
    ("02/03/24", "fr", epoch(2024, 3, 2, tz=PARIS)),
    ("February 12, 2022 3:22 p.m. ET", None, epoch(2022, 2, 12, 15, 22, tz=NY)),
    ("Sun, 01 Oct 2023 13:09:20 EDT", None, epoch(2023, 10, 1, 17, 9, 20)),
    ("Tue Feb 21 13:56:34 2023", "us", epoch(2023, 2, 21, 13, 56, 34, tz=NY)),
    ("2024-03-05 05:02:24 Australia/Sydney", None, epoch(2024, 3, 4, 18, 2, 24)),
    ("2018-06-22T15:36:47+02:00[Europe/Madrid]", None, epoch(2018, 6, 22, 13, 36, 47)),
    ("2024-03-10 02:30", "us", None),  # skipped
    ("2024-11-03 01:30", "us", None),  # twice
    ("2021-13-45", None, None),
    ("25/12/2020", "us", None),
    ("March 2021", None, None),
    ("3 hours ago", None, None),
    ("", None, None),
    (None, None, None),
    ("x" * 5000, None, None),
]


def test_timestamps(spark):
    rows = [(i, v, "meta:date", s, 1, "clash") for i, (v, s, _) in enumerate(CASES)] + [(99, "2024-03-10 02:30", "WP:date_gmt", "us", 1, "clash")]
    sources = spark.createDataFrame([("us", {"tz": "America/New_York", "date_order": "mdy"}), ("us", {"tz": "America/New_York", "date_order": "mdy"}), ("fr", {"tz": "Europe/Paris", "date_order": "dmy"}), (None, {})], SRC)
    got = {r.doc_id: r.published_ts for r in timestamps.normalised_timestamps(spark.createDataFrame(rows, DOC), sources).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)} | {99: epoch(2024, 3, 10, 2, 30)}
    assert timestamps.normalised_timestamps(spark.createDataFrame([], DOC), sources).count() == 0


@pytest.mark.parametrize("name", ["America/New_York", "Australia/Sydney", "Asia/Kolkata", "Europe/Lisbon"])
def test_transitions_agree_with_zone_data(name):
    instants, offsets = zones.transitions(name)
    tz = ZoneInfo(name)
    for t in range(0, 1_900_000_000, 9_876_543):
        at = max(int((instants <= t).sum()) - 1, 0)
        assert offsets[at] == datetime.fromtimestamp(t, tz).utcoffset().total_seconds()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(1, "z", 1), (2, "c", 3), (2, "b", 2)], "k int, v string, seq int")
    assert {(r.k, r.v) for r in store.first_wins(old, new, ["k"], ["seq"]).collect()} == {(1, "a"), (2, "b")}
    assert {(r.k, r.v) for r in store.last_wins(new, ["k"], ["seq"]).collect()} == {(1, "z"), (2, "c")}
    assert store.last_wins(new.where("false"), ["k"], ["seq"]).count() == 0


def test_slice_is_strict(spark):
    d = spark.createDataFrame([(1, 10, "a"), (2, 20, None), (3, 30, "b")], "doc_id int, ts long, source_id string")
    assert [r.doc_id for r in store.time_slice(d, 30, 10).collect()] == [2]
    assert {r.doc_id for r in store.time_slice(d, exclude_source="a").collect()} == {2, 3}


def test_quotes(spark):
    v = spark.createDataFrame([(1, 1, "prior", "identical", 0.9, "the quick  brown fox"), (2, 1, "prior", "identical", 0.9, "too short"), (3, 9, "later", "states", 0.9, "the quick brown fox"), (4, 1, "later", "states", 0.2, None)], "claim_id int, doc_id int, direction string, relation string, conf double, quote string")
    d = spark.createDataFrame([(1, "See The Quick brown\nfox run")], "doc_id int, text string")
    got = {r.claim_id: (r.relation, r.conf) for r in evidence.downgraded(evidence.checked(v, d)).collect()}
    assert got == {1: ("identical", 0.9), 2: ("topical", 0.3), 3: ("orthogonal", 0.3), 4: ("orthogonal", 0.2)}


def test_zone_rules_come_from_the_driver(spark):
    release, files = zones.rules()
    assert release and len(files["Europe/Paris"]) > 100
    zones.use({"Europe/Paris": files["Asia/Kolkata"]})
    try:
        assert zones.transitions("Europe/Paris")[1][-1] == 19800 and zones.transitions("America/New_York") is None
    finally:
        zones.use(files)
    rows = spark.createDataFrame([(1, "2020-01-01", "x", None, 1, "c"), (2, "2020-01-01 10:00", "x", None, 1, "c"), (3, "soon", "x", None, 1, "c")], DOC)
    got = {r.doc_id: (r.precision, r.confidence, r.zone_rules) for r in timestamps.normalised_timestamps(rows.withColumn("sure", timestamps.F.lit(" Exact")), spark.createDataFrame([], SRC), confidence_col="sure").collect()}
    assert got == {1: ("day", "day", release), 2: ("second", "exact", release), 3: (None, None, release)}


def test_dated_takes_retrieval_only_without_an_instant(spark):
    rows = spark.createDataFrame([(1, "1 March 2020", None, "fr", datetime(2021, 1, 1, tzinfo=UTC)), (2, "soon", None, None, datetime(2021, 1, 1, tzinfo=UTC)), (3, None, None, "fr", None)], "doc_id long, published_at string, date_provenance string, source_id string, retrieved_at timestamp")
    src = spark.createDataFrame([("fr", {"tz": "Europe/Paris"}), (None, {"tz": "Asia/Tokyo"})], SRC)
    assert {r.doc_id: (r.ts, r.told) for r in store.dated(rows, src).collect()} == {1: (epoch(2020, 3, 1, tz=PARIS), True), 2: (epoch(2021, 1, 1), False), 3: (None, False)}
