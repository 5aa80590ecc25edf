"""Queries over pages, feeds, excerpts and names.

The tables hold pages as text, so the queries on markup write each document as a page first, with menu, script and
links around it, and read it again: what comes out must be what SQL finds in the text itself.
"""

from pyspark.sql import functions as F

from chronolex.functions import pages
from chronolex.operators import excerpts, store
from chronolex.plans.base import DATED, VERDICTS, Tables, query
from chronolex.sources import feeds


def _pages(t):
    """(doc_id, url, html) of documents with title and text; lines are paragraphs."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda p: F.concat(F.lit("<p class='x'>"), pages.escaped(p), F.lit("</p>"))), "\n")
    head = F.concat(F.lit("<html><head><title>"), pages.escaped(F.col("title")), F.lit("</title><script>var a = '<p>no</p>';</script>"), F.lit('<meta content="'), F.col("published_at"), F.lit('" property="article:published_time"></head><body><nav><p>Menu</p></nav>'))
    link = F.concat(F.lit('<aside><a class="s" href="'), pages.escaped(F.col("url")), F.lit('">Share</a><a href="#top">Up</a></aside>'))
    d = t.documents.where("text is not null").withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "url", "published_at")})
    return d.select("doc_id", "url", F.concat(head, F.lit("<article>"), body, F.lit("</article>"), link, F.lit("</body></html>")).alias("html"))


WHOLE = "text IS NOT NULL"
TIDY = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({c}, chr(160), ' '), '[\x{{200b}}-\x{{200d}}\x{{feff}}\x{{2060}}]', '', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ([,.;:!?%)\]])', '\1', 'g'), '([(\[]) ', '\1', 'g'), ' *\n *', chr(10), 'g'), '\n{{2,}}', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: {TIDY('p')}), lambda p: p <> ''), chr(10)) AS text FROM documents WHERE {WHOLE}")
def html_main_text(spark, sf):
    return _pages(Tables(spark, sf)).select("doc_id", pages.main_text(F.col("html")).alias("text"))


@query(f"SELECT doc_id, {TIDY('title')} AS title FROM documents WHERE {WHOLE} AND trim(title) <> ''")
def page_title(spark, sf):
    return _pages(Tables(spark, sf)).select("doc_id", pages.title(F.col("html")).alias("title")).where("title is not null")


@query(f"SELECT doc_id, url AS link FROM documents WHERE {WHOLE} AND regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '\\s')")
def extract_links(spark, sf):
    return _pages(Tables(spark, sf)).select("doc_id", F.explode(pages.links(F.col("html"))).alias("link"))


@query(f"SELECT doc_id, trim(published_at) AS value, 'meta:article:published_time' AS provenance FROM documents WHERE {WHOLE} AND trim(published_at) <> ''")
def page_date(spark, sf):
    found = _pages(Tables(spark, sf)).select("doc_id", pages.date(F.col("html"), F.lit("")).alias("d"))
    return found.where("d is not null").select("doc_id", "d.value", "d.provenance")


SQUEEZED = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


@query(f"WITH {DATED} SELECT d.id, {SQUEEZED('title')} AS title, ts AS published_ts, length({SQUEEZED('text')}) AS abstract_chars FROM d WHERE id IS NOT NULL AND lower(trim((SELECT source FROM documents x WHERE x.doc_id = d.doc_id))) = 'arxiv' AND title IS NOT NULL AND text IS NOT NULL")
def atom_entries(spark, sf):
    """Documents of the paper channel, written as Atom entries and read again."""
    d = Tables(spark, sf).dated.where("lower(trim(source)) = 'arxiv' and id is not null and title is not null and text is not null")
    at = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = [F.lit("<entry><id>"), F.col("id"), F.lit("</id><title>"), pages.escaped(F.col("title")), F.lit("</title><summary>"), pages.escaped(F.col("text")), F.lit("</summary><published>"), at, F.lit("</published></entry>")]
    got = feeds.parse_atom(d.select(F.concat(*parts).alias("xml")), "xml")
    # the text is title, empty line, abstract
    return got.select("id", "title", "published_ts", (F.length("text") - F.when(F.col("title") != "", F.length("title") + 2).otherwise(0)).cast("long").alias("abstract_chars"))


@query(r"SELECT doc_id, CAST(epoch(strptime(published_at, '%Y%m%dT%H%M%SZ')) AS BIGINT) AS seen_ts FROM documents WHERE regexp_full_match(published_at, '[0-9]{8}T[0-9]{6}Z') AND try_strptime(published_at, '%Y%m%dT%H%M%SZ') IS NOT NULL")
def seendate_parse(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", feeds.seen_instant(F.col("published_at")).alias("seen_ts")).where("seen_ts is not null")


ONE = "oc AS (SELECT id, any_value(text) AS claim, any_value(entities) AS e, any_value(fingerprints) AS f FROM claims GROUP BY id)"
EXCERPT = f"""{VERDICTS}, {ONE}, x AS (SELECT v.claim_id, v.doc_id, v.direction, t.text, list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', claim, array_to_string(coalesce(f, []), ' '), array_to_string(coalesce(e, []), ' '))), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS terms FROM v JOIN oc ON oc.id = v.claim_id JOIN documents t ON t.doc_id = v.doc_id WHERE t.text IS NOT NULL),
y AS (SELECT *, unnest(range(0, greatest(length(text) - 1400, 1), 466)) AS start FROM x WHERE length(text) > 1400 AND len(terms) > 0),
z AS (SELECT claim_id, doc_id, direction, any_value(text) AS text, arg_max(start, (len(list_filter(terms, lambda w: contains(substr(lower(text), start + 1, 1400), w))), -start)) AS best FROM y GROUP BY ALL),
lo AS (SELECT *, greatest(best - 300, 0) AS lo, reverse(substr(text, greatest(best - 300, 0) + 1, best + 1 - greatest(best - 300, 0))) AS back FROM z),
ex AS (SELECT claim_id, doc_id, direction, substr(text, CASE WHEN strpos(back, chr(10) || chr(10)) > 0 THEN lo + length(back) - strpos(back, chr(10) || chr(10)) + 1 ELSE best END + 1, 1400) AS excerpt FROM lo UNION ALL SELECT claim_id, doc_id, direction, substr(text, 1, 1400) FROM x WHERE length(text) <= 1400 OR len(terms) = 0)"""


@query(f"WITH {EXCERPT} SELECT claim_id, doc_id, direction, md5(excerpt) AS excerpt_md5, length(excerpt) AS chars FROM ex")
def best_excerpt(spark, sf):
    t = Tables(spark, sf)
    c = t.claim_rows.select(F.col("id").alias("claim_id"), excerpts.claim_terms(F.col("text"), F.col("fingerprints"), F.col("entities")).alias("terms"))
    rows = t.verdicts.select("claim_id", "doc_id", "direction").join(c, "claim_id").join(t.documents.select("doc_id", "text").where("text is not null"), "doc_id")
    return excerpts.best_excerpt(rows).select("claim_id", "doc_id", "direction", F.md5("excerpt").alias("excerpt_md5"), F.length("excerpt").alias("chars"))


@query("WITH c AS (SELECT doc_id, text, list_reduce(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {'done': []::VARCHAR[], 'cur': p}), lambda a, b: CASE WHEN length(a.cur) + length(b.cur) + 2 > 2000 AND a.cur <> '' THEN {'done': list_append(a.done, a.cur), 'cur': b.cur} ELSE {'done': a.done, 'cur': CASE WHEN a.cur = '' THEN b.cur ELSE a.cur || chr(10) || chr(10) || b.cur END} END) AS r FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN [text] WHEN r.cur <> '' THEN list_append(r.done, r.cur) ELSE r.done END AS x FROM c) SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_no, CAST(length(x[i]) AS INTEGER) AS chars, md5(x[i]) AS chunk_md5 FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM l)")
def paragraph_chunks(spark, sf):
    chunk = excerpts.paragraph_chunks(F.col("text"), 2000)
    return Tables(spark, sf).documents.where("text is not null").select("doc_id", F.posexplode(chunk).alias("chunk_no", "chunk")).select("doc_id", "chunk_no", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query(f"WITH {ONE}, q AS (SELECT id, list_filter(coalesce(e, []), lambda x: length(x) > 3)[1:2] AS named, regexp_extract_all(coalesce(claim, ''), '[A-Za-z]{{4,}}')[1:3] AS w FROM oc) SELECT id, CASE WHEN len(named) > 0 THEN array_to_string(list_transform(named, lambda x: '\"' || x || '\"'), ' | ') ELSE array_to_string(w, ' ') END AS queries FROM q")
def fallback_queries(spark, sf):
    return excerpts.fallback_queries(Tables(spark, sf).claim_rows).select("id", F.array_join("queries", " | ").alias("queries"))


@query("WITH s AS (SELECT DISTINCT id, lower(domain) AS h FROM sources WHERE domain IS NOT NULL) SELECT id, CASE WHEN starts_with(h, 'www.') THEN substr(h, 5) ELSE 'www.' || h END AS twin, string_split(regexp_replace(h, '^www\\.', ''), '.')[1] AS stem FROM s")
def origin_candidates(spark, sf):
    """Other hosts that may serve a source: with or without www, and the stem of its name."""
    s = Tables(spark, sf).sources.where("domain is not null").select("id", F.lower("domain").alias("h")).distinct()
    bare = F.regexp_replace("h", r"^www\.", "")
    return s.select("id", F.when(F.startswith("h", F.lit("www.")), bare).otherwise(F.concat(F.lit("www."), "h")).alias("twin"), F.substring_index(bare, ".", 1).alias("stem"))


@query(f"WITH {DATED} SELECT lower(trim(title)) AS page, coalesce(lang, '') AS lang, min(ts) AS first_ts, arg_min(doc_id, (ts, doc_id)) AS doc_id, count(*) AS revisions FROM d WHERE trim(title) <> '' GROUP BY 1, 2")
def first_revision(spark, sf):
    """The earliest document of each title and language, as an encyclopaedia's first revision."""
    d = Tables(spark, sf).dated.where("trim(title) <> ''").groupBy(F.lower(F.trim("title")).alias("page"), F.coalesce("lang", F.lit("")).alias("lang"))
    return d.agg(F.min("ts").alias("first_ts"), F.min_by("doc_id", F.struct("ts", "doc_id")).alias("doc_id"), F.count("*").alias("revisions"))


@query("SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 5], ' ')))) AS shingles FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z''-]+') AS w FROM documents WHERE text IS NOT NULL)")
def word_shingles(spark, sf):
    """The number of different runs of six words of each document."""
    d = Tables(spark, sf).documents.where("text is not null").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z'-]+"), F.lit(0)).alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, 6), " "))
    return d.select("doc_id", F.when(F.size("w") >= 6, F.size(F.array_distinct(runs))).otherwise(0).cast("long").alias("shingles"))


@query("SELECT id, claim_id, doc_id, place FROM (SELECT id, id AS claim_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(salience, 0) DESC, id) AS place FROM (SELECT id, any_value(doc_id) AS doc_id, any_value(salience) AS salience FROM claims GROUP BY id)) WHERE place <= 3")
def salient_claims(spark, sf):
    """The three most salient claims of each document."""
    c = Tables(spark, sf).claim_rows.select("id", F.col("id").alias("claim_id"), "doc_id", F.coalesce("salience", F.lit(0.0)).alias("s"))
    return store.top_per(c, ["doc_id"], [F.desc("s"), "id"], 3).drop("s")
