"""Queries over texts and vectors: retrieval in slices of time, quotes, claims."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex import scratch
from chronolex.operators import evidence, excerpts, prevalence, search
from chronolex.plans.base import ANCHORED, CHECKED, EVIDENCE, VERDICTS, Tables, query

# queries are the claims, each cut off at its own time, without its own source and document
EVERY = f"""{ANCHORED}, q0 AS (SELECT a.claim_id AS query_id, anchor_ts AS before, own_source, own_doc, x.text, x.fingerprints, x.entities FROM a JOIN (SELECT id, any_value(text) AS text, any_value(fingerprints) AS fingerprints, any_value(entities) AS entities FROM claims GROUP BY id) x ON x.id = a.claim_id)"""
# those of documents whose id is divisible by 20
ASKED = f"{EVERY[:-1]} WHERE own_doc % 20 = 0)"
WORDS = lambda c: rf"list_filter(string_split_regex(strip_accents(lower({c})), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
TOK = f"tok AS MATERIALIZED (SELECT doc_id, ts, source_id, {WORDS('concat_ws(chr(32), title, text)')} AS w FROM d), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok), post AS MATERIALIZED (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"
SEEN = "(own_source IS NULL OR tok.source_id IS NULL OR tok.source_id <> own_source) AND tok.doc_id <> own_doc AND tok.ts < before"
BM = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
BM25 = f"""{TOK}, q1 AS (SELECT DISTINCT query_id, unnest(list_filter({WORDS('text')}, lambda w: length(w) >= 3)[1:40]) AS term FROM q0),
bs AS (SELECT query_id, doc_id, round(sum({BM}), 6) AS score FROM post JOIN df USING (term) JOIN q1 USING (term), st GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT query_id, bs.doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bs.doc_id) AS place FROM bs JOIN q0 USING (query_id) JOIN tok ON tok.doc_id = bs.doc_id WHERE {SEEN}) WHERE place <= 15)"""
SPACED = lambda w: f"array_to_string(list_transform({w}, lambda x: ' ' || x || ' '), '')"
PHRASE = f"""qp AS (SELECT DISTINCT query_id, phrase, {SPACED('w')} AS p FROM (SELECT query_id, phrase, {WORDS('phrase')} AS w FROM (SELECT query_id, unnest(fingerprints) AS phrase FROM q0)) WHERE len(w) >= 2),
pf AS (SELECT p, doc_id, ts, source_id, len(w) AS dl, (length(t) - length(replace(t, p, ''))) / length(p) AS tf FROM (SELECT DISTINCT p FROM qp), (SELECT *, {SPACED('w')} AS t FROM tok) WHERE contains(t, p)),
pr AS (SELECT * FROM (SELECT query_id, phrase, tok.doc_id, round({BM}, 6) AS score, row_number() OVER (PARTITION BY query_id, phrase ORDER BY round({BM}, 6) DESC, tok.doc_id) AS place FROM pf tok JOIN (SELECT p, count(*) AS df FROM pf GROUP BY 1) USING (p) JOIN qp USING (p) JOIN q0 USING (query_id), st WHERE {SEEN}) WHERE place <= 15)"""
DENSE = f"dn AS (SELECT * FROM (SELECT query_id, tok.doc_id, list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, tok.doc_id) AS place FROM q0 JOIN embeddings x ON x.vec_id = own_doc, embeddings y JOIN tok ON tok.doc_id = y.vec_id WHERE {SEEN}) WHERE place <= 15)"
PER_QUERY, LIMIT = 15, 20


def _told(t: Tables) -> DataFrame:
    """The corpus's words, read once per session."""
    return scratch.once(t._spark, ("words", t._sf), lambda: search.words(t.dated))


def _index(t: Tables, stem: bool = False) -> DataFrame:
    """The corpus's posting lists, written once per session."""
    return scratch.once(t._spark, ("postings", t._sf, stem), lambda: search.postings(search.stemmed(_told(t)) if stem else _told(t)))


def _asked(t: Tables) -> DataFrame:
    a = t.anchored.select(F.col("claim_id").alias("query_id"), F.col("anchor_ts").alias("before"), F.lit(None).cast("long").alias("after"), F.col("own_source").alias("exclude_source"), F.col("own_doc").alias("exclude_doc"))
    return a.join(t.claim_rows.select(F.col("id").alias("query_id"), "text", "fingerprints", "entities"), "query_id")


def _part(asked: DataFrame) -> DataFrame:
    """The claims of documents whose id is divisible by 20."""
    return asked.where("exclude_doc % 20 = 0")


def _lexical(t: Tables, asked: DataFrame, stem: bool = False) -> DataFrame:
    return scratch.written_singly(search.bm25(asked, _index(t, stem), PER_QUERY, stem), "words-found")


def _phrases(t: Tables, asked: DataFrame) -> DataFrame:
    p = asked.select("query_id", F.explode("fingerprints").alias("phrase"), *search.SLICE)
    return scratch.written_singly(search.phrase_search(p, _told(t), _index(t), PER_QUERY), "phrases-found")


def _dense(t: Tables, asked: DataFrame) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec")).join(t.times.select(F.col("doc_id").alias("id"), "ts", "source_id"), "id")
    # claims of one document share its vector and bounds, so it is asked once
    of = v.join(asked.select(F.col("exclude_doc").alias("id")).distinct(), "id", "left_semi").select("id", "vec", F.col("ts").alias("before"), F.col("source_id").alias("exclude_source"))
    found = search.dense_topk(of, v, PER_QUERY)
    return asked.select("query_id", F.col("exclude_doc").alias("own")).join(found.withColumnRenamed("query_id", "own"), "own").drop("own")


@query(f"WITH {EVERY}, {BM25} SELECT query_id, doc_id, score, CAST(place AS INTEGER) AS place FROM bm")
def bm25_search(spark, sf):
    t = Tables(spark, sf)
    return _lexical(t, _asked(t))


@query()
def porter_bm25(spark, sf):
    """As bm25_search, with words met by their stems."""
    t = Tables(spark, sf)
    return _lexical(t, _asked(t), stem=True)


@query(f"WITH {EVERY}, {TOK}, {PHRASE} SELECT query_id, phrase, doc_id, score, CAST(place AS INTEGER) AS place FROM pr")
def phrase_search(spark, sf):
    t = Tables(spark, sf)
    return _phrases(t, _asked(t))


@query(f"WITH {ASKED}, {TOK}, {DENSE} SELECT query_id, doc_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM dn")
def dense_sliced(spark, sf):
    t = Tables(spark, sf)
    return _dense(t, _part(_asked(t))).select("query_id", "doc_id", F.round("score", 6).alias("score"), "place")


@query(f"WITH {EVERY}, {BM25}, {PHRASE}, {DENSE}, pl AS (SELECT query_id, doc_id, place, 'lexical' AS retriever, NULL AS hit FROM bm UNION ALL SELECT query_id, doc_id, place, 'dense', NULL FROM dn UNION ALL SELECT query_id, doc_id, place, 'fingerprint', phrase FROM pr), f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + place)) + CASE WHEN count(hit) > 0 THEN 0.5 ELSE 0 END, 6) AS score, min(place) AS best_rank, array_to_string(list_sort(list(DISTINCT retriever)), '+') AS retrievers, count(DISTINCT hit) AS hits FROM pl GROUP BY 1, 2) SELECT query_id, doc_id, score, CAST(best_rank AS INTEGER) AS best_rank, retrievers, hits, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM f) WHERE place <= 20")
def rrf_fusion(spark, sf):
    """Words, vectors and fingerprints of each claim, all in the slice before it, fused by reciprocal ranks."""
    t = Tables(spark, sf)
    none = F.lit(None).cast("string")
    rows = lambda df, name, hit=none: df.select("query_id", "doc_id", "place", F.lit(name).alias("retriever"), hit.alias("hit"))
    asked = _asked(t)
    placed = rows(_lexical(t, asked), "lexical").unionByName(rows(_dense(t, asked), "dense")).unionByName(rows(_phrases(t, asked), "fingerprint", F.col("phrase")))
    return search.rank_fusion(placed, LIMIT).select("query_id", "doc_id", "score", "best_rank", F.array_join("retrievers", "+").alias("retrievers"), F.size("hits").cast("long").alias("hits"), "place")


_SPANS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(prevalence.WINDOWS[2:]))


@query(f"WITH {ASKED}, sp(win, lo, hi) AS (VALUES {_SPANS}), dn AS (SELECT q0.query_id, win, y.vec_id AS doc_id, row_number() OVER (PARTITION BY query_id, win ORDER BY list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, y.vec_id) AS place FROM q0 JOIN embeddings x ON x.vec_id = own_doc, embeddings y JOIN d ON d.doc_id = y.vec_id, sp WHERE d.ts > before + lo * 86400 AND d.ts < before + hi * 86400 AND y.vec_id <> own_doc AND (own_source IS NULL OR d.source_id IS NULL OR d.source_id <> own_source)), m AS (SELECT query_id, doc_id, max(round(1.0::DOUBLE / (60 + place), 6)) AS score, arg_min(win, (-round(1.0::DOUBLE / (60 + place), 6), win)) AS win FROM dn WHERE place <= 15 GROUP BY 1, 2) SELECT query_id, doc_id, score, win, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM m) WHERE place <= 14")
def window_union(spark, sf):
    """What vectors find in each window after a claim, united: of each document its best score, the 14 best documents."""
    t = Tables(spark, sf)
    v = t.embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec")).join(t.times.select(F.col("doc_id").alias("id"), "ts", "source_id"), "id")
    asked, out = v.where("id % 20 = 0"), None
    for win, (lo, hi) in enumerate(prevalence.WINDOWS[2:]):
        q = asked.select("id", "vec", (F.col("ts") + lo * 86400).alias("after"), (F.col("ts") + hi * 86400).alias("before"), F.col("source_id").alias("exclude_source"))
        found = search.dense_topk(q, v, PER_QUERY).select(F.col("query_id").alias("own"), F.lit(win).alias("win"), "doc_id", F.round(1.0 / (search.RRF_K + F.col("place")), 6).alias("score"))
        out = found if out is None else out.unionByName(found)
    fused = _part(_asked(t)).select("query_id", F.col("exclude_doc").alias("own")).join(out, "own").drop("own")
    return search.best_over_windows(fused)


@query("WITH x AS (SELECT id, any_value(text) AS text, any_value(fingerprints) AS f, any_value(entities) AS e FROM claims GROUP BY id), t AS (SELECT id AS query_id, 0 AS pos, text FROM x UNION ALL SELECT id, 100 + i, f[i] FROM (SELECT id, f, unnest(range(1, len(f) + 1)) AS i FROM x) UNION ALL SELECT id, 200 + i, e[i] FROM (SELECT id, e, unnest(range(1, len(e) + 1)) AS i FROM x)), k AS (SELECT query_id, lower(trim(text)) AS k, min(pos) AS pos, arg_min(trim(text), pos) AS text FROM t WHERE trim(text) <> '' GROUP BY 1, 2) SELECT query_id, CAST(n AS INTEGER) AS n, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, k) - 1 AS n FROM k) WHERE n < 5")
def query_expansion(spark, sf):
    """The different texts to search a claim by, the claim's own first, then fingerprints and names."""
    c = Tables(spark, sf).claim_rows
    listed = lambda col, base: c.select(F.col("id").alias("query_id"), F.posexplode(col).alias("pos", "text")).withColumn("pos", F.col("pos") + base)
    texts = c.select(F.col("id").alias("query_id"), F.lit(0).alias("pos"), "text").unionByName(listed("fingerprints", 101)).unionByName(listed("entities", 201))
    return search.distinct_queries(texts)


@query("SELECT query_id, doc_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS place FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE place <= 10")
def dense_topk(spark, sf):
    v = Tables(spark, sf).embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    return search.dense_topk(v.where("id % 20 = 0"), v).withColumn("score", F.round("score", 6))


@query(f"WITH {VERDICTS}, {CHECKED} SELECT claim_id, doc_id, direction, ok FROM k")
def quote_supported(spark, sf):
    t = Tables(spark, sf)
    return evidence.checked(t.verdicts, t.documents).select("claim_id", "doc_id", "direction", "ok")


@query(f"WITH {EVIDENCE} SELECT claim_id, doc_id, direction, relation, weight, conf, length(quote) AS quote_chars FROM ev")
def downgraded_verdicts(spark, sf):
    t = Tables(spark, sf)
    return evidence.downgraded(evidence.checked(t.verdicts, t.documents)).select("claim_id", "doc_id", "direction", "relation", "weight", "conf", F.length("quote").cast("long").alias("quote_chars"))


BOLD = "b AS (SELECT id, any_value(doc_id) AS doc_id, any_value(kind) AS kind, round(any_value(coalesce(salience, 0) + CASE WHEN len(fingerprints) > 0 THEN 0.15 ELSE 0 END + CASE WHEN kind = 'prediction' AND falsifiable THEN 0.15 ELSE 0 END - CASE WHEN explicit THEN 0 ELSE 0.1 END), 6) AS boldness FROM claims GROUP BY id)"


@query(f"WITH {BOLD}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY boldness DESC, id) AS rk FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rk > 1, boldness DESC, id) AS place FROM k) SELECT doc_id, id, kind, boldness, CAST(place AS INTEGER) AS place FROM p WHERE place <= 5")
def boldness_canvass(spark, sf):
    """Of each document five claims: the boldest of each kind, then the boldest of the rest."""
    zero = F.lit(0.0)
    bold = F.coalesce("salience", zero) + F.when(F.size("fingerprints") > 0, 0.15).otherwise(zero) + F.when((F.col("kind") == "prediction") & F.col("falsifiable"), 0.15).otherwise(zero) - F.when(F.col("explicit"), zero).otherwise(0.1)
    b = Tables(spark, sf).claim_rows.select("doc_id", "id", "kind", F.round(bold, 6).alias("boldness"))
    k = b.withColumn("rk", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(F.desc("boldness"), "id")))
    return k.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("rk") > 1, F.desc("boldness"), "id"))).where("place <= 5").drop("rk")


@query("WITH x AS (SELECT id, any_value(doc_id) AS doc_id, any_value(fingerprints) AS f FROM claims GROUP BY id) SELECT x.id, len(f) AS given, len(list_filter(f, lambda p: length(p) >= 8 AND contains(trim(p), ' ') AND contains(lower(text), lower(p)))) AS valid FROM x JOIN documents USING (doc_id) WHERE f IS NOT NULL AND text IS NOT NULL")
def fingerprint_validate(spark, sf):
    t = Tables(spark, sf)
    c = t.claim_rows.select("id", "doc_id", "fingerprints").where("fingerprints is not null").join(t.documents.select("doc_id", F.lower("text").alias("low")).where("low is not null"), "doc_id")
    ok = F.filter("fingerprints", lambda p: (F.length(p) >= 8) & F.contains(F.trim(p), F.lit(" ")) & F.contains(F.col("low"), F.lower(p)))
    return c.select("id", F.size("fingerprints").cast("long").alias("given"), F.size(ok).cast("long").alias("valid"))


@query("SELECT doc_id, CAST(m[1] AS INTEGER) * 10000 + CAST(m[2] AS INTEGER) * 100 + CAST(m[3] AS INTEGER) AS day FROM (SELECT doc_id, regexp_extract(url, '/((19|20)[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})/', 1) AS y, [regexp_extract(url, '/((?:19|20)[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})/', 1), regexp_extract(url, '/((?:19|20)[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})/', 2), regexp_extract(url, '/((?:19|20)[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})/', 3)] AS m FROM documents) WHERE y <> ''")
def url_path_date(spark, sf):
    part = lambda i: F.regexp_extract("url", "/((?:19|20)[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})/", i)
    return Tables(spark, sf).documents.where(part(1) != "").select("doc_id", (part(1).cast("int") * 10000 + part(2).cast("int") * 100 + part(3).cast("int")).alias("day"))
