"""Queries over landed feeds, writes into a store that already holds rows, and what is derived on the way in."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolex.functions import pages
from chronolex.operators import prevalence, scoring, search, store
from chronolex.plans.base import ANCHORED, CANONICAL, DATED, VERDICTS, Tables, query
from chronolex.plans.pages import TIDY
from chronolex.plans.store import CUT
from chronolex.sources import landed
from chronolex.streaming import events as streams

DAY = 86400
_TEXT = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: {TIDY('p')}), lambda p: p <> ''), chr(10))"
_POSTS = lambda channel, least, more="": f"WITH x AS (SELECT id, published_at, {_TEXT} AS t FROM documents WHERE lower(trim(source)) = '{channel}' AND id IS NOT NULL AND text IS NOT NULL {more}), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY published_at NULLS FIRST, t) AS nth FROM x WHERE length(t) >= {least}) SELECT id, published_at, length(t) AS chars, md5(t) AS text_md5 FROM k WHERE nth = 1"


def _html():
    lines = F.transform(F.split("text", "\n"), lambda p: F.concat(F.lit("<p>"), pages.escaped(p), F.lit("</p>")))
    return F.concat(F.lit("<div><nav>Menu</nav>"), F.array_join(lines, "\n"), F.lit("</div>"))


def _landed(spark, sf, channel, *fields, more=None):
    """The channel's documents as its interface would land them, read again; more: (doc_id, ...) with further fields."""
    d = Tables(spark, sf).documents.where((F.lower(F.trim("source")) == channel) & F.col("text").isNotNull())
    d = d if more is None else d.join(more, "doc_id", "left")
    got = landed.posts(d.select(F.to_json(F.struct(*fields)).alias("json")), "json", channel)
    return got.select("id", "published_at", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


@query(_POSTS("substack", 200))
def substack_archive(spark, sf):
    return _landed(spark, sf, "substack", "id", F.col("url").alias("canonical_url"), "title", F.col("published_at").alias("post_date"), _html().alias("body_html"))


@query(_POSTS("wordpress", 400))
def wordpress_posts(spark, sf):
    return _landed(spark, sf, "wordpress", "id", F.col("url").alias("link"), F.col("published_at").alias("date_gmt"), F.struct(F.col("title").alias("rendered")).alias("title"), F.struct(_html().alias("rendered")).alias("content"))


@query(_POSTS("hn", 300, "AND doc_id IN (SELECT doc_id FROM judgements GROUP BY doc_id HAVING count(*) >= 5)"))
def hn_posts(spark, sf):
    """Forum posts; the tables have no points, so a landed post gets two for every verdict on it."""
    points = Tables(spark, sf).judgements.groupBy("doc_id").agg((2 * F.count("*")).cast("int").alias("points"))
    return _landed(spark, sf, "hn", F.col("id").alias("objectID"), "url", "title", F.col("published_at").alias("created_at_i"), _html().alias("story_text"), "points", more=points)


@query(f"WITH {DATED} SELECT url, min(ts) AS first_ts, arg_min(coalesce(title, ''), (ts, coalesce(title, ''))) AS title FROM d WHERE regexp_matches(url, '^https?://') AND ts IS NOT NULL GROUP BY url")
def url_discovery(spark, sf):
    return landed.first_seen(Tables(spark, sf).dated)


@query(f"WITH {DATED}, l AS (SELECT lower(trim(source)) AS channel, ts FROM d), m AS (SELECT max(ts) AS newest FROM l), g AS (SELECT channel, CAST(floor((newest - ts) / {30.0 * DAY}) AS BIGINT) AS page, count(*) AS rows, min(ts) AS cursor FROM l, m WHERE ts IS NOT NULL GROUP BY 1, 2) SELECT channel, page, rows, cursor, coalesce(cursor >= lag(cursor) OVER (PARTITION BY channel ORDER BY page), false) AS stalled FROM g")
def keyset_cursors(spark, sf):
    """The cursors of a walk back through each channel in pages of thirty days."""
    d = Tables(spark, sf).dated.select(F.lower(F.trim("source")).alias("channel"), "ts")
    rows = d.join(F.broadcast(d.agg(F.max("ts").alias("newest"))), F.lit(True))
    return landed.cursors(rows, F.floor((F.col("newest") - F.col("ts")) / (30 * DAY)).cast("long"))


_FROM, _STEP = CUT - 730 * DAY, 7 * DAY


@query(f"WITH {DATED}, t AS (SELECT tile, {_FROM} + tile * {_STEP} AS from_ts, least({_FROM} + (tile + 1) * {_STEP}, {CUT}) AS to_ts FROM range({-(-(CUT - _FROM) // _STEP)}) r(tile)), f AS (SELECT url, min(ts) AS ts FROM d WHERE url IS NOT NULL AND ts >= {_FROM} AND ts < {CUT} GROUP BY url) SELECT tile, from_ts, to_ts, count(f.url) AS n FROM t LEFT JOIN f ON f.ts >= from_ts AND f.ts < to_ts GROUP BY ALL")
def weekly_tiles(spark, sf):
    """A range tiled in weeks, empty ones too; a url counts in the week in which it came first."""
    first = Tables(spark, sf).dated.where(f"url is not null and ts >= {_FROM} and ts < {CUT}").groupBy("url").agg(F.min("ts").alias("ts"))
    n = first.groupBy(F.floor((F.col("ts") - _FROM) / _STEP).alias("tile")).agg(F.count("*").alias("n"))
    return landed.tiles(_FROM, CUT, _STEP, spark).join(n, "tile", "left").na.fill(0, ["n"])


_SPANS = [(0, 90), (90, 180), (180, 365), (365, 730)]
_ALL = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate([(-365, 0), *_SPANS]))


@query(f"WITH RECURSIVE {ANCHORED}, {CANONICAL}, n AS (SELECT url, min(ts) AS ts, arg_min(doc_id, (ts, doc_id)) AS doc_id FROM d WHERE url IS NOT NULL AND lower(trim(source)) = 'gdelt' GROUP BY url), k AS (SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM canon WHERE canonical <> doc_id)), s(span, lo, hi) AS (VALUES {_ALL}), x AS (SELECT claim_id, span, anchor_ts + lo * 86400 AS from_ts, anchor_ts + hi * 86400 AS to_ts FROM a, s WHERE anchor_ts + lo * 86400 >= 1483228800) SELECT claim_id, span, from_ts, to_ts, (SELECT count(*) FROM k WHERE k.ts >= from_ts AND k.ts < to_ts) AS n FROM x")
def claim_news(spark, sf):
    """News items to gather for each claim, by span: one per url, without copies of an earlier story.

    Counted as the difference of what is older than a span's end and than its start, so no claim meets the items one by one.
    """
    t = Tables(spark, sf)
    d = t.documents.where((F.lower(F.trim("source")) == "gdelt") & F.col("url").isNotNull()).select("doc_id", "url").join(t.times.select("doc_id", "ts"), "doc_id")
    first = d.groupBy("url").agg(F.min(F.struct("ts", "doc_id")).alias("f")).select("f.*")
    items = first.join(t.canonical.where("doc_id <> canonical").select("doc_id"), "doc_id", "left_anti")
    spans = landed.spans(t.anchored, _SPANS, 1483228800)
    ends = spans.select(F.col("from_ts").alias("claim_id"), F.col("from_ts").alias("anchor_ts")).unionByName(spans.select(F.col("to_ts").alias("claim_id"), F.col("to_ts").alias("anchor_ts"))).distinct()
    older = scoring.pools(ends, items)
    at = lambda c: older.select(F.col("claim_id").alias(c), F.col("pool").alias(f"_{c}"))
    return spans.join(at("from_ts"), "from_ts").join(at("to_ts"), "to_ts").select("claim_id", "span", "from_ts", "to_ts", (F.col("_to_ts") - F.col("_from_ts")).alias("n"))


@query("WITH s AS (SELECT DISTINCT id, lower(domain) AS h, regexp_replace(lower(domain), '^www\\.', '') AS bare FROM sources WHERE domain IS NOT NULL) SELECT id, h, array_to_string(CASE WHEN h = string_split(bare, '.')[1] || '.substack.com' THEN [h, CASE WHEN starts_with(h, 'www.') THEN bare ELSE 'www.' || h END] ELSE [h, CASE WHEN starts_with(h, 'www.') THEN bare ELSE 'www.' || h END, string_split(bare, '.')[1] || '.substack.com'] END, ' ') AS hosts FROM s")
def origin_hosts(spark, sf):
    """The hosts that may serve a source, in the order to try: its own, with or without www, its platform's."""
    s = Tables(spark, sf).sources.where("domain is not null").select("id", F.lower("domain").alias("h")).distinct()
    bare = F.regexp_replace("h", r"^www\.", "")
    twin = F.when(F.startswith("h", F.lit("www.")), bare).otherwise(F.concat(F.lit("www."), "h"))
    return s.select("id", "h", F.array_join(F.array_distinct(F.array("h", twin, F.concat(F.substring_index(bare, ".", 1), F.lit(".substack.com")))), " ").alias("hosts"))


_CHANNELS = {"gdelt": 120, "wordpress": 120, "substack": 120, "wikipedia": 3, "arxiv": 120, "hn": 100, "podcast": 40}


@query(f"WITH c(channel, cap) AS (VALUES {', '.join(f'({k!r}, {v})' for k, v in _CHANNELS.items())}), f AS (SELECT lower(trim(source)) AS channel, count(DISTINCT url) AS found, count(DISTINCT url) FILTER (WHERE length(text) >= 200) AS usable FROM documents GROUP BY 1) SELECT channel, cap, coalesce(found, 0) AS found, least(coalesce(usable, 0), cap) AS added, CASE WHEN found IS NULL THEN 'skipped' WHEN usable = 0 THEN 'failed' ELSE 'ok' END AS status FROM c LEFT JOIN f USING (channel)")
def channel_status(spark, sf):
    """What each planned channel found, how much of it is taken under its cap, and whether it could be searched at all."""
    plan = spark.createDataFrame(list(_CHANNELS.items()), "channel string, cap int")
    f = Tables(spark, sf).documents.groupBy(F.lower(F.trim("source")).alias("channel")).agg(F.count_distinct("url").alias("found"), F.count_distinct(F.when(F.length("text") >= 200, F.col("url"))).alias("usable"))
    status = F.when(F.col("found").isNull(), "skipped").when(F.col("usable") == 0, "failed").otherwise("ok")
    return plan.join(f, "channel", "left").select("channel", "cap", F.coalesce("found", F.lit(0)).alias("found"), F.least(F.coalesce("usable", F.lit(0)), F.col("cap")).alias("added"), status.alias("status"))


@query(f"WITH {DATED}, g AS (SELECT lower(trim(title)) AS page, coalesce(lang, '') AS lang, min(ts) FILTER (WHERE told) AS told_ts, min(ts) AS any_ts, max(least(length(text), 12000)) AS chars FROM d WHERE trim(title) <> '' AND length(text) >= 200 AND lower(trim(source)) = 'wikipedia' GROUP BY 1, 2) SELECT page, lang, coalesce(told_ts, any_ts) AS first_ts, CASE WHEN told_ts IS NULL THEN 'capture' ELSE 'first-revision' END AS provenance, chars FROM g")
def wikipedia_milestones(spark, sf):
    """The earliest revision of each article and language, else its earliest capture; extracts of 200 characters or more, 12,000 of which are kept."""
    d = Tables(spark, sf).dated.where((F.trim("title") != "") & (F.length("text") >= 200) & (F.lower(F.trim("source")) == "wikipedia"))
    g = d.groupBy(F.lower(F.trim("title")).alias("page"), F.coalesce("lang", F.lit("")).alias("lang")).agg(F.min(F.when(F.col("told"), F.col("ts"))).alias("t"), F.min("ts").alias("any"), F.max(F.least(F.length("text"), F.lit(12000))).cast("long").alias("chars"))
    return g.select("page", "lang", F.coalesce("t", "any").alias("first_ts"), F.when(F.col("t").isNull(), "capture").otherwise("first-revision").alias("provenance"), "chars")


@query("SELECT coalesce(source_id, '') AS source_id, count(*) AS documents, count(vec_id) AS vectors FROM documents LEFT JOIN embeddings ON 'doc:' || vec_id = 'doc:' || doc_id GROUP BY 1")
def keyed_vectors(spark, sf):
    """Vectors met through their keys: those that begin with doc: belong to documents."""
    t = Tables(spark, sf)
    v = t.embeddings.select(F.concat(F.lit("doc:"), "vec_id").alias("key")).where(F.startswith("key", F.lit("doc:"))).select("key", F.lit(1).alias("v"))
    d = t.documents.select(F.coalesce("source_id", F.lit("")).alias("source_id"), F.concat(F.lit("doc:"), "doc_id").alias("key"))
    return d.join(v, "key", "left").groupBy("source_id").agg(F.count("*").alias("documents"), F.count("v").alias("vectors"))


@query("SELECT coalesce(lang, '') AS lang, count(*) AS n, min(doc_id) AS doc_id FROM documents WHERE starts_with(title, 'The ') GROUP BY 1")
def title_prefix(spark, sf):
    return Tables(spark, sf).documents.where(F.startswith("title", F.lit("The "))).groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


@query("WITH n AS (SELECT DISTINCT upper(name) AS asked FROM sources) SELECT DISTINCT asked, id FROM n JOIN sources ON lower(name) = lower(asked)")
def source_lookup(spark, sf):
    s = Tables(spark, sf).sources
    return store.found_sources(s, s.select(F.upper("name").alias("asked")))


@query(f"WITH {DATED}, g AS (SELECT doc_id, ts FROM d WHERE length(text) >= 3000 AND ts <= (SELECT max(ts) FROM d) - 9999 * 86400), o AS (SELECT doc_id, ts FROM d WHERE length(text) >= 3000 AND ts IS NOT NULL ORDER BY ts, doc_id LIMIT 25) SELECT doc_id, ts, false AS fallback FROM g UNION ALL SELECT doc_id, ts, true FROM o WHERE (SELECT count(*) FROM g) = 0")
def oldest_fallback(spark, sf):
    """A horizon that no document reaches: the 25 oldest long documents stand in."""
    return store.scorable(Tables(spark, sf).dated.select("doc_id", "ts", "text"), 3000, 9999, 25)


@query(f"WITH {DATED}, {VERDICTS}, x AS (SELECT claim_id, url, doc_id, ts, row_number() OVER (PARTITION BY claim_id, url ORDER BY ts, doc_id) AS nth FROM (SELECT DISTINCT v.claim_id, d.url, d.doc_id, d.ts FROM v JOIN d ON d.doc_id = v.doc_id WHERE weight <> 0 AND url IS NOT NULL AND ts IS NOT NULL)) SELECT claim_id, url, doc_id, ts, row_number() OVER (PARTITION BY claim_id ORDER BY ts, doc_id) AS place FROM x WHERE nth = 1")
def claim_timeline(spark, sf):
    """The evidence of each claim in the order of time, each url once; a claim's urls are ordered in one task, so copies go first."""
    t = Tables(spark, sf)
    v = t.verdicts.where("weight <> 0").select("claim_id", "doc_id").distinct().join(t.documents.select("doc_id", "url").where("url is not null"), "doc_id").join(t.times.select("doc_id", "ts").where("ts is not null"), "doc_id")
    first = v.groupBy("claim_id", "url").agg(F.min(F.struct("ts", "doc_id")).alias("f")).select("claim_id", "url", "f.doc_id", "f.ts")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("claim_id").orderBy("ts", "doc_id")).cast("long"))


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id, metric ORDER BY run_id DESC, written_at DESC, coalesce(score, -1) DESC) AS nth, count(*) OVER (PARTITION BY entity_type, entity_id, metric) AS versions FROM scores) SELECT entity_type, entity_id, metric, run_id, score, versions FROM s WHERE nth = 1")
def unit_merge(spark, sf):
    """Scores of several runs as one: of each entity and metric the newest run's."""
    keys = ["entity_type", "entity_id", "metric"]
    s = Tables(spark, sf).scores.select(*keys, "run_id", "score", "written_at")
    best = F.max_by(F.struct("run_id", "score"), F.struct("run_id", "written_at", F.coalesce("score", F.lit(-1.0))))
    return s.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("versions")).select(*keys, "b.run_id", "b.score", "versions")


@query("WITH x AS (SELECT doc_id, substr(concat_ws(chr(10) || chr(10), nullif(trim(title), ''), substr(text, 1, 6000)), 1, 8000) AS t FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) SELECT doc_id, length(CASE WHEN trim(t) = '' THEN ' ' ELSE t END) AS chars, md5(CASE WHEN trim(t) = '' THEN ' ' ELSE t END) AS input_md5 FROM x")
def embedding_inputs(spark, sf):
    """What is still to be embedded: title and head of the documents without a vector, blank ones as one blank (an encoder takes no empty text)."""
    t = Tables(spark, sf)
    d = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    title = F.trim(F.coalesce("title", F.lit("")))
    x = F.substring(F.concat_ws("\n\n", F.when(title != "", title), F.substring("text", 1, 6000)), 1, 8000)
    x = F.when(F.trim(x) == "", " ").otherwise(x)
    return d.select("doc_id", F.length(x).cast("long").alias("chars"), F.md5(x).alias("input_md5"))


@query("SELECT 'doc:' || vec_id AS key, CASE WHEN embedding[2] > 0 THEN 'm2' ELSE 'm1' END AS model, CASE WHEN embedding[1] > 0 THEN 64 ELSE 32 END AS dim, CASE WHEN embedding[2] > 0 THEN CAST(label AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END AS head FROM embeddings WHERE embedding[1] > 0 OR embedding[2] > 0")
def upsert_vectors(spark, sf):
    """Vectors of a second model over those of a first: vector and model change, the dimension of a key that is there stays."""
    e = Tables(spark, sf).embeddings.withColumn("key", F.concat(F.lit("doc:"), "vec_id"))
    old = e.where("embedding[0] > 0").select("key", F.lit("m1").alias("model"), F.lit(64).alias("dim"), F.slice("embedding", 1, 1).cast("array<double>").alias("vec"))
    new = e.where("embedding[1] > 0").select("key", F.lit("m2").alias("model"), F.lit(32).alias("dim"), F.array(F.col("label").cast("double")).alias("vec"))
    return store.updated_vectors(old, new, ["model"]).select("key", "model", "dim", F.get("vec", F.lit(0)).alias("head"))


@query("SELECT sha256(claim_id || chr(0) || doc_id || chr(0) || direction) AS key, arg_max(coalesce(relation, ''), (judged_at, coalesce(relation, ''), coalesce(confidence, -1))) AS response, count(*) AS writes FROM judgements WHERE judged_at IS NOT NULL AND claim_id IS NOT NULL AND doc_id IS NOT NULL AND direction IS NOT NULL GROUP BY 1")
def upsert_cache(spark, sf):
    """A cache of verdicts by the hash of what was asked: the last answer stays."""
    j = Tables(spark, sf).judgements.where("judged_at is not null and claim_id is not null and doc_id is not null and direction is not null")
    key = F.sha2(F.concat_ws("\x00", "claim_id", F.col("doc_id").cast("string"), "direction"), 256)
    relation = F.coalesce("relation", F.lit(""))
    return j.groupBy(key.alias("key")).agg(F.max_by(relation, F.struct("judged_at", relation, F.coalesce("confidence", F.lit(-1.0)))).alias("response"), F.count("*").alias("writes"))


@query("WITH r AS (SELECT run_id, min(written_at) AS started, max(written_at) AS ended FROM scores GROUP BY 1) SELECT run_id, CAST(floor(epoch(started)) AS BIGINT) AS started_ts, CASE WHEN run_id <> (SELECT max(run_id) FROM r) THEN CAST(floor(epoch(ended)) AS BIGINT) END AS finished_ts FROM r")
def run_finish(spark, sf):
    """Runs of the scores, of which all but the last are told to have ended."""
    s = Tables(spark, sf).scores.select("run_id", F.unix_timestamp("written_at").alias("at"))
    runs = s.groupBy("run_id").agg(F.min("at").alias("started_at"), F.lit(None).cast("long").alias("finished_at"))
    ends = s.join(F.broadcast(s.agg(F.max("run_id").alias("_last"))), F.col("run_id") != F.col("_last")).select("run_id", F.col("at").alias("ended_at"))
    return store.finished_runs(runs, ends).select("run_id", F.col("started_at").alias("started_ts"), F.col("finished_at").alias("finished_ts"))


@query("WITH o AS (SELECT url, min(doc_id) AS doc_id FROM documents WHERE url IS NOT NULL AND lower(trim(source)) = 'gdelt' GROUP BY 1), n AS (SELECT url, min(doc_id) AS doc_id FROM documents WHERE url IS NOT NULL GROUP BY 1) SELECT url, coalesce(o.doc_id, n.doc_id) AS doc_id, o.url IS NULL AS was_added FROM n LEFT JOIN o USING (url)")
def upsert_documents(spark, sf):
    """All channels written into a store that holds the news already: a url that is there keeps its document."""
    d = Tables(spark, sf).documents.where("url is not null").select("url", "doc_id", F.lower(F.trim("source")).alias("channel"))
    old = d.where("channel = 'gdelt'").groupBy("url").agg(F.min("doc_id").alias("doc_id"), F.lit(False).alias("was_added"))
    return store.first_wins(old, d.select("url", "doc_id", F.lit(True).alias("was_added")), ["url"], ["doc_id"])


@query("WITH s AS (SELECT id, map_entries(metadata) AS m FROM (SELECT id, any_value(metadata) AS metadata FROM sources WHERE metadata IS NOT NULL GROUP BY id)) SELECT id, substr(sha256('{' || array_to_string(list_transform(list_sort(m), lambda e: '\"' || e.key || '\": \"' || e.value || '\"'), ', ') || '}'), 1, 16) AS config_hash FROM s")
def config_hashes(spark, sf):
    s = Tables(spark, sf).sources.where("metadata is not null").groupBy("id").agg(F.first("metadata").alias("metadata"))
    return s.select("id", store.config_hash(F.col("metadata")).alias("config_hash"))


_MARKS = "replace(translate(title, chr(8216) || chr(8217) || chr(8218) || chr(8220) || chr(8221) || chr(8222) || chr(8211) || chr(8212) || chr(8722) || chr(160), chr(39) || chr(39) || chr(39) || '\"\"\"--- '), chr(8230), '...')"


@query(f"SELECT doc_id, {_MARKS} AS plain, url_encode({_MARKS}) AS query FROM documents WHERE title IS NOT NULL")
def search_titles(spark, sf):
    """Titles with plain marks, and as a search would ask for them."""
    plain = pages.plain_marks(F.col("title"))
    return Tables(spark, sf).documents.where("title is not null").select("doc_id", plain.alias("plain"), pages.quoted(plain).alias("query"))


@query("SELECT CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """The hourly windows of the stream of events, those still open too."""
    from chronolex.plans.extra import _stream

    w = streams.drained(streams.tumbling_counts(_stream(spark, sf)), "tumbling", ["window_start", "event_type"])
    return w.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def stream_upsert(spark, sf):
    """The last event of each user, merged batch by batch."""
    from chronolex.plans.extra import _stream

    e = _stream(spark, sf).where("user_id is not null").select("user_id", "ts", "event_id", "event_type")
    return streams.upserted(e, "last-events", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_TOPICAL = 0.2


@query(f"WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id AS q, b.id AS d, list_inner_product(a.e, b.e) AS s FROM v a, v b WHERE a.id % 20 = 0 AND a.id <> b.id), m(mod) AS (VALUES (1), (2), (4), (8), (16)), k AS (SELECT mod, q, count(*) AS pool, count(*) FILTER (WHERE s >= {_TOPICAL}) AS topical, max(s) AS best FROM p, m WHERE d % mod = 0 GROUP BY 1, 2) SELECT mod, count(*) AS queries, round(avg(pool), 6) AS mean_pool, round(avg(topical), 6) AS mean_topical, round(avg(best), 6) AS mean_best, round(avg(least(greatest(least(1.0, ln(1.0 + pool) / ln(20001.0)) * (0.35 + 0.65 * least(1.0, topical / 4.0)) * (0.55 + 0.45 / 3.0), 0.0), 1.0)), 3) AS mean_coverage FROM k GROUP BY 1")
def scaling_table(spark, sf):
    """Pool, topical neighbourhood, best similarity and coverage of every twentieth vector in a whole corpus, its half, quarter ..."""
    e = Tables(spark, sf).embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    none = F.lit(0).cast("long")
    asked, out = e.where("id % 20 = 0"), None
    for m in (1, 2, 4, 8, 16):
        part = e.where(f"id % {m} = 0")
        near = prevalence.curve(asked.withColumn("anchor_ts", none), part.withColumn("ts", none), [(0, 1)], topical=_TOPICAL, express=2.0).select(F.col("claim_id").alias("id"), "n_topical")
        best = search.dense_topk(asked, part, k=1).select(F.col("query_id").alias("id"), "score")
        size = F.broadcast(part.agg(F.count("*").alias("n")))
        x = asked.select("id").join(size, F.lit(True)).join(near, "id", "left").join(best, "id").withColumn("pool", F.col("n") - (F.pmod("id", F.lit(m)) == 0).cast("int"))
        topical = F.coalesce("n_topical", none)
        row = x.agg(F.lit(m).alias("mod"), F.count("*").alias("queries"), F.round(F.avg("pool"), 6).alias("mean_pool"), F.round(F.avg(topical), 6).alias("mean_topical"), F.round(F.avg("score"), 6).alias("mean_best"), F.round(F.avg(scoring.coverage(F.col("pool"), topical, F.lit(1))), 3).alias("mean_coverage"))
        out = row if out is None else out.unionByName(row)
    return out
