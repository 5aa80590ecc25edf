import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolex import scratch
from chronolex.llm import boilerplate, dart_minhash, history, languages, leakage, mixing, near_duplicates, repeated_lines, textvec
from chronolex.llm.subjects import PASSAGE, SubjectModel, _Passages

DOC = "doc_id long, source_id string, url string, text_hash string, text string, id string, n long"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def runs(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def similar(a, b, k, least, threshold):
    a, b = runs(a, k), runs(b, k)
    return min(len(a), len(b)) >= least and len(a & b) / len(a | b) >= threshold


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "short text", "x " * 5000]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(90)]
        for _ in range(rng.choice([1, 3, 8])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 2, 4, 9])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    return [(i, f"s{i % 2}" if i % 7 else None, f"https://www.a.example/{i}/", f"H{i}", t, "clash", 1) for i, t in enumerate(texts)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aÄ1 ,.\n_ßİ​é", max_size=30), min_size=1, max_size=5))
def test_words_as_the_regular_expression_has_them(texts):
    w = textvec.Words(texts)
    assert [w.text(i) for i in range(len(w.hash))] == [x for t in texts for x in words(t)]


def test_signatures_estimate_weighted_similarity():
    a, b = {i: 1 + i % 3 for i in range(300)}, {i: 1 + i % 2 for i in range(100, 420)}
    el = np.array([*a, *b], np.uint64)
    doc = np.array([0] * len(a) + [1] * len(b))
    sig = dart_minhash.signatures(textvec.mix(el), doc, np.array([*a.values(), *b.values()], float), 3, 2048)
    keys = a.keys() | b.keys()
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04 and (sig[2] == np.iinfo(np.uint64).max).all()


def test_near_duplicates_are_the_components(spark, corpus):
    got = {r.id: r.class_id for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(corpus, DOC), words=3, threshold=0.5, min_runs=20).collect()}
    label = {r[0]: r[0] for r in corpus}
    for _ in corpus:
        for x in corpus:
            for y in corpus:
                if x[0] < y[0] and label[x[0]] != label[y[0]] and similar(x[4], y[4], 3, 20, 0.5):
                    label[x[0]] = label[y[0]] = min(label[x[0]], label[y[0]])
        break
    changed = True
    while changed:
        changed = False
        for x in corpus:
            for y in corpus:
                if label[x[0]] < label[y[0]] and similar(x[4], y[4], 3, 20, 0.5):
                    label[y[0]], changed = label[x[0]], True
    sizes = {}
    for v in label.values():
        sizes[v] = sizes.get(v, 0) + 1
    assert got == {k: v for k, v in label.items() if sizes[v] > 1}
    assert near_duplicates.near_duplicate_classes(spark.createDataFrame([], DOC)).count() == 0


def test_batches_one_by_one_are_as_all_at_once(spark, corpus):
    rows = [(r[0], r[2] if r[0] % 5 else None, r[3], r[4]) for r in corpus] + [(500, "HTTP://A.example:80/9?utm_source=x#top", None, None), (501, None, "h12", "other")]
    schema = "ref long, url string, text_hash string, text string"
    accepted, want = [], set()
    for r in rows:
        same = lambda a, b: a[1] and b[1] and a[1].lower().replace("https://www.", "").rstrip("/") == b[1].lower().replace("https://www.", "").rstrip("/") or a[2] and b[2] and a[2].lower() == b[2].lower() or similar(a[3], b[3], 3, 20, 0.5)
        key = (r[0], "https://www.a.example/9/" if r[0] == 500 else r[1], r[2], r[3])
        if any(same(key, a) for a in accepted):
            want.add(r[0])
        else:
            accepted.append(key)
    for parts in (1, 3):
        h = history.History(spark, scratch.new_path(spark, "test-history"), words=3, threshold=0.5, min_runs=20, buckets=8)
        h.append(h.prepared(spark.createDataFrame(rows[:5], schema)))
        got = set()
        size = -(-len(rows[5:]) // parts)
        for k in range(parts):
            got |= {r.ref for r in h.rejected(spark.createDataFrame(rows[5:][k * size : (k + 1) * size], schema)).collect()}
        assert got == want


def test_what_a_batch_reads_follows_its_own_size(spark):
    schema = "ref long, url string, text_hash string, text string"
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    batch = [(10**6, "https://new.example/1", None, text(3))]
    read = []
    for n in (30, 300):
        h = history.History(spark, scratch.new_path(spark, "test-history"), words=3, threshold=0.5, min_runs=20, buckets=256)
        h.append(h.prepared(spark.createDataFrame([(i, f"https://a.example/{i}", None, text(i)) for i in range(n)], schema)))
        own = h._keys(h.prepared(spark.createDataFrame(batch, schema)))
        files = lambda df: {r[0] for r in df.select("_metadata.file_path").distinct().collect()}
        read.append(len(files(h.keys(own))))
        assert len(files(h.keys())) > 3 * read[-1]
        assert len(files(h.sets(spark.createDataFrame([(3,)], "ref long")))) == 1
        assert {r.ref for r in h.rejected(spark.createDataFrame(batch, schema)).collect()} == {10**6}
        assert h.sets().count() == n
    assert read[1] <= 1.2 * read[0] + 2


def test_string_ids_and_hot_buckets_of_near_duplicates(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(10**6)}"
    head = [word() for _ in range(60)]
    texts = [" ".join(head + [word() for _ in range(90)]) for _ in range(60)]
    for i in (0, 10, 20):  # linked to one text each, while all share the head
        w = texts[i].split()
        texts.append(" ".join(w[:100] + [word() for _ in range(3)] + w[103:]))
    rows = [(f"id{i:03d}", t, "clash") for i, t in enumerate(texts)]
    monkeypatch.setattr(near_duplicates.buckets.cross_pairs, "__defaults__", (None, 8))
    seen, check = [], near_duplicates.linking.verified
    monkeypatch.setattr(near_duplicates.linking, "verified", lambda pairs, *a: (seen.append(pairs.count()), check(pairs, *a))[1])
    got = {r.id: r.class_id for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "id string, text string, key string"), id_col="id", words=3, threshold=0.5, min_runs=20).collect()}
    assert got == {"id000": "id000", "id060": "id000", "id010": "id010", "id061": "id010", "id020": "id020", "id062": "id020"}
    assert sum(seen) < 4 * len(rows)


def test_a_hot_group_costs_a_check_per_row(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(10**6)}"
    story = [word() for _ in range(120)]
    edited = lambda n: " ".join([*story[:n], *(word() for _ in range(2)), *story[n:]])
    # the first arrival is like the story's first copy, but not enough to be linked
    texts = [" ".join(story[:68] + [word() for _ in range(40)])] + [edited(k + 2) for k in range(50)] + [edited(3)] * 20
    rows = [(10 + i, None, None, t) for i, t in enumerate(texts)]
    accepted = []
    for r in rows:
        if not any(similar(r[3], a[3], 3, 20, 0.5) for a in accepted):
            accepted.append(r)
    want = {r[0] for r in rows} - {a[0] for a in accepted}
    assert {10, 11} == {a[0] for a in accepted}
    seen, linked = [], history.History._linked

    def counted(self, pairs, left, right=None):
        seen.append(pairs.count())
        return linked(self, pairs, left, right)

    monkeypatch.setattr(history.History, "_linked", counted)
    monkeypatch.setattr(history, "PAIRS", 0, raising=False)
    schema = "ref long, url string, text_hash string, text string"
    other = " ".join(word() for _ in range(60))
    for known, most in (([(1, None, None, other)], 4), ([(1, None, None, texts[0]), *((k, None, None, texts[1]) for k in range(2, 9)), (9, None, None, other)], 4)):
        seen.clear()
        h = history.History(spark, scratch.new_path(spark, "test-history"), words=3, threshold=0.5, min_runs=20, buckets=8)
        h.append(h.prepared(spark.createDataFrame(known, schema)))
        got = {r.ref for r in h.rejected(spark.createDataFrame(rows, schema), accept=False).collect()}
        assert got == (want if len(known) == 1 else {r[0] for r in rows}) and sum(seen) < most * len(rows)


def test_repeated_lines(spark):
    rows = [(i, "s" if i else None, None, None, t, "x", 1) for i, t in enumerate([None, "Share THIS!\nbody one\n", "share this\nshare, this", "12\n--", "» Share this", "", None])]
    docs = spark.createDataFrame(rows, DOC)
    lines = repeated_lines.repeated_lines(docs, min_documents=3)
    assert {tuple(r) for r in lines.collect()} == {(1, 0), (2, 0), (2, 1), (4, 0)}
    out = {r.doc_id: r.text for r in repeated_lines.without_lines(docs, lines).collect()}
    assert out[1] == "body one\n" and out[2] == "" and out[3] == "12\n--" and out[6] is None
    assert repeated_lines.repeated_lines(docs.where("false")).count() == 0


def test_bitmaps_round_trip():
    for n in (1, 4096, 4097, 65536):
        low = np.sort(np.random.default_rng(n).choice(65536, n, replace=False)).astype("<u2")
        assert (repeated_lines.unpack(repeated_lines.pack(low), n) == low).all()


def test_leaks(spark):
    item = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x y " + item + " z"), (2, "T3, t4 t­5 " + " ".join(f"t{i}" for i in range(6, 16)) + " no"), (3, " ".join(f"t{i}" for i in range(12))), (4, None), (5, "t0 " * 40), (6, " ".join(f"t{i}" for i in range(4, 12))), (7, " ".join(f"t{i}" for i in range(12, 20)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, "a"), (8, "too short", "a"), (9, None, "a")], "item_id long, text string, doc_id string")
    assert {tuple(r) for r in leakage.leaked_items(leakage.positional_index(docs), items).collect()} == {(7, 1), (7, 2)}
    assert leakage.leaked_items(leakage.positional_index(docs.where("false")), items).count() == 0


def test_proximity_keeps_the_order(spark):
    item = [f"t{i}" for i in range(13)]
    swap = item[:5] + [item[6], item[5]] + item[7:]
    gap = item[:6] + ["x"] + item[6:]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(swap)), (3, " ".join(gap))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    index = leakage.positional_index(docs).unionByName(leakage.positional_index(docs.selectExpr("doc_id + 10 as doc_id", "text")))
    found = lambda slop: {r.doc_id for r in leakage.leaked_items(index, items, slop=slop).collect()}
    assert found(0) == {1, 11} and found(2) == {1, 3, 11, 13}


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = languages.train(docs.where("doc_id % 2 = 0"), sample=200)
    known = languages.labelled(docs.where("doc_id % 2 = 1 and lang in ('en', 'fr', 'de', 'es', 'pt')"), "lang", tuple(languages.NAMES))
    got = languages.language_lines(known, table).where("line_no = -1").join(known.select("doc_id", "language"), "doc_id")
    right, n = got.where("lang = language").count(), got.count()
    assert n > 100 and right / n > 0.9  # some labels are wrong


def test_a_language_that_it_never_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.train(docs, sample=200)
    odd = ["Город вчера решил, что новый мост через реку будет построен в следующем году. " * 4, "Ma kaupunki on eilen päättänyt, että uusi silta joen yli rakennetaan ensi vuonna kyllä. " * 4]
    rows = spark.createDataFrame([*enumerate(odd), (2, "The city decided yesterday that the new bridge over the river will be built next year. " * 4), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang, r.confidence) for r in languages.language_lines(rows, model).collect()}
    assert got[0] == ("und", 0.0) and got[1][0] == "und" and got[2][0] == "en" and got[2][1] > 0.9 and len(got) == 3
    n = languages.language_lines(docs, model).where("lang = 'und'").count()
    assert n < 5


def test_lines_with_bars_are_prose_or_rows(spark):
    lines = ["Signal is published weekly by a small office in the old port. | Imprint | Sitemap", "Tasbren Union | 15 | 52 | New Velden", "| the first cell holds a long note | and the second one too |", "Home\tArts\tArchive", "", "a | plain line of words with one bar", "||", "\t\t\n  | x |  ", "THE SIGNAL IS PUBLISHED WEEKLY IN PORT VELDEN. | IMPRINT | SITEMAP"]
    t = languages._Text(["\n".join(lines[:4]), None, "\n".join(lines[4:])])
    assert t.wordless().tolist() == [False, True, True, True, False, False, False, True, True, True, False]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = languages.train(docs, sample=200)
    body = "\n".join(["Die Stadt hat gestern beschlossen, dass die neue Brücke über den Fluss im nächsten Jahr gebaut wird."] * 5)
    got = languages.language_lines(spark.createDataFrame([(1, f"{body}\n{lines[0]}\n{lines[2]}")], "doc_id long, text string"), table).collect()
    assert {(r.line_no, r.lang) for r in got} == {(-1, "de"), (5, "en")}


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5, np.uint64))) == list(range(n))


def test_mixing(spark):
    rows = [(i, ["A ", "b", None][i % 3], 10 + i % 7) for i in range(300)] + [(1000, "b", 0)]
    usage, shares, shards = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int"), total_tokens=4000, block=16, shard=8)
    got = {r.doc_id: r for r in usage.collect()}
    assert len(got) == 301 and got[2].uses_max == 0 and got[1000].tokens_used == 0
    assert max(r.uses_max for r in got.values() if r.source == "a") <= 1 and max(r.uses_max for r in got.values() if r.source == "b") <= 3
    real = {r.source: r for r in shares.collect()}
    assert real["gone"].tokens_used == 0 and abs(real["a"].actual_share + real["b"].actual_share - 1) < 1e-9
    assert (real["a"].reachable, real["b"].reachable, real["gone"].reachable) == (False, True, True)
    # the packed shards hold exactly the used tokens, a slot one block's, and each document's pieces are whole
    used, slots = {}, {}
    for r in shards.collect():
        used[r.doc_id] = used.get(r.doc_id, 0) + r.n_tokens
        slots.setdefault((r.shard, r.slot), []).append(r)
        assert 0 <= r.first_token and r.first_token + r.n_tokens <= got[r.doc_id].tokens
    assert used == {k: r.tokens_used for k, r in got.items() if r.tokens_used}
    assert all(len({r.source for r in s}) == 1 and sum(r.n_tokens for r in s) <= 16 and k[1] < 8 for k, s in slots.items())


def test_reachable_shares_are_met(spark):
    rows = [(i, "abc"[i % 3], 100) for i in range(3000)]
    shares = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), spark.createDataFrame([("a", 0.2, 2), ("b", 0.3, 2), ("c", 0.5, 2)], "source string, target_share double, max_repeats int"), block=64).shares.collect()
    assert all(r.reachable and abs(r.actual_share - r.target_share) <= r.tolerance < 0.03 for r in shares)


def test_joins_that_grow_are_merged(spark):
    for n in (30, 3000):
        rows = spark.range(n).selectExpr("id as doc_id", "'a' as source", "100L as tokens")
        m = mixing.mixed(rows, spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"), block=64)
        plan = m.shards._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_subject_leaves():
    rng = random.Random(1)
    topics = [[f"{c}{i:02d}term" for i in range(25)] for c in "abc"]
    common = [f"common{i}" for i in range(30)]
    para = lambda k: " ".join(rng.choice(topics[k]) if rng.random() < 0.5 else rng.choice(common) for _ in range(30))
    texts = [para(i % 3) + "\n" + para(i % 3) for i in range(240)]
    model = SubjectModel.load(SubjectModel.fit(texts, np.arange(240) % 3, 3, leaves=12, least=8).dump())
    share, _ = model.shares([para(0) + "\n" + para(2), para(1), "", None], 3)
    assert share[0][0] > 0.3 and share[0][2] > 0.3 and share[1].argmax() == 1 and share[2].sum() == 0


def test_passages_hold_every_letter():
    rng = random.Random(2)
    topics = [[f"{c}{i:02d}term" for i in range(25)] for c in "abc"]
    line = lambda k, n: " ".join(rng.choice(topics[k]) for _ in range(n))
    texts = ["\n".join(rng.choice(["", line(0, 1), line(1, 8), line(2, 40)]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None, "\n\n", "short"]
    p = _Passages(texts)
    count = [sum(c.isalpha() for c in t or "") for t in texts]
    assert np.bincount(p.doc, weights=p.letters, minlength=len(texts)).tolist() == count
    assert all(n >= PASSAGE or n == count[d] for d, n in zip(p.doc, p.letters, strict=True))
    assert [p.doc[i] for i in p.line] == [d for d, t in enumerate(texts) for _ in words(t)]
    model = SubjectModel.fit([line(i % 3, 30) for i in range(240)], np.arange(240) % 3, 3, leaves=12, least=8)
    wrapped = "\n".join([line(0, 8) for _ in range(6)] + [""] + [line(2, 8) for _ in range(6)])
    share, _ = model.shares([wrapped, line(1, 9)], 3)
    assert share[0][0] > 0.3 and share[0][2] > 0.3 and share[1][1] > 0.9


def test_furniture_is_what_different_stories_share():
    story = lambda k: 'long words ' * 20 + 'abcdefghij'[k]
    texts = [f"Menu\nPublished daily in the old port\nBy Ann{'abc'[k]} Smith, who writes about harbours\n{story(k)}\nsaid so" for k in range(3)] + [f"Copied line of the story\n{story(9)}" for _ in range(5)] + ["Menu\nelse", "", None]
    urls = [f"https://www.a.example/{k}" for k in range(8)] + ["https://b.example/", None, "no address"]
    found = boilerplate.furniture(texts, urls)
    assert {k for k in found[0] if k[0] != "~"} == {"menu", "publisheddailyintheoldport", "saidso"} and found[3] == set() and found[8:] == [set()] * 3
    labels = boilerplate.weak_labels(texts[0], None, found[0], cues=None)
    assert labels[:4] == [0, 0, 0, 1]


def _pages(n=700):
    rows = duckdb.sql("SELECT text, url, title FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL AND url IS NOT NULL ORDER BY doc_id").fetchall()
    unseen = lambda u: sum(map(ord, u.split("/")[2].removeprefix("www."))) % 4 == 0 if "//" in u else False
    return [r for r in rows if not unseen(r[1])][:n], [r for r in rows if unseen(r[1])]


@pytest.mark.parametrize(("cues", "family", "least"), [pytest.param(boilerplate._CUE, r"share|partager|teilen|comparti|· email|courriel|correo|e-mail|copy link", 0.7, id="share"), pytest.param(None, r"cookie|privacy|datenschutz|confidentialité|privacidad|©|rights|droits|rechte|derechos|direitos", 0.7, id="no phrases")])
def test_lines_without_their_cues_on_sites_never_seen(cues, family, least):
    """Furniture whose cue phrases, and whose sites, the labeller was never shown; without cues it has only layout and repetition."""
    seen, unseen = _pages()
    held = re.compile(family)
    again = boilerplate.furniture([r[0] for r in seen], [r[1] for r in seen])
    labels = np.concatenate([np.array(boilerplate.weak_labels(t, h, k, cues, held)) for (t, _, h), k in zip(seen, again, strict=True)])
    model = boilerplate.Labeller().fit(boilerplate.Leaves([r[0] for r in seen], [r[1] for r in seen]), labels)
    off = model.predict(boilerplate.Leaves([r[0] for r in unseen], [r[1] for r in unseen])) < 0
    want = np.concatenate([np.array(boilerplate.weak_labels(t, h)) for t, _, h in unseen])
    low = [re.sub(r"\s+", " ", x).strip().lower() for t, _, _ in unseen for x in t.split("\n")]
    on = np.array([bool(held.search(x)) for x in low]) & (want == 0)
    assert on.sum() > 50 and off[on].mean() > least
    assert off[want == 1].mean() < 0.08


def test_long_pages_are_learnt_in_pieces():
    first, size = boilerplate._pieces(np.array([0, 5, 905]), np.array([5, 900, 0]))
    assert first.tolist() == [0, 5, 405, 805, 905] and size.tolist() == [5, 400, 400, 100, 0]


def test_page_lines_of_odd_rows(spark):
    rows = [(1, None, None), (2, "", "x"), (None, "Menu", "https://a.example/"), (4, "12\n--", None), (5, "Accept all cookies\nMenu\n" + "A paragraph of the author with many words in it. " * 8, "https://a.example/"), (5, "Menu", "::")]
    docs = spark.createDataFrame([(*r, None, 1) for r in rows], "doc_id long, text string, url string, title string, line_no int")
    got = {tuple(r) for r in boilerplate.page_lines(docs, boilerplate.train(docs)).collect()}
    assert all(d == 5 for d, _ in got) and boilerplate.page_lines(docs.where("false"), boilerplate.train(docs.where("false"))).count() == 0
