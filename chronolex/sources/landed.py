"""Landed JSON of publishing platforms as document rows. A crawler pages and lands it; these readers keep what is a document.

Null and unreadable rows are dropped, as are rows without an id; of several rows of an id the first by date, then by text counts.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions import pages

#: fixed values: by platform the schema of a post, its fields, whether its text is markup, and the characters it needs
PLATFORMS = {
    "substack": ("id string, canonical_url string, title string, post_date string, body_html string", ("id", "canonical_url", "title", "post_date", "body_html"), True, 200),
    "wordpress": ("id string, link string, date_gmt string, title struct<rendered: string>, content struct<rendered: string>", ("id", "link", "title.rendered", "date_gmt", "content.rendered"), True, 400),
    "hn": ("objectID string, url string, title string, created_at_i string, story_text string, points int", ("objectID", "url", "title", "created_at_i", "story_text"), True, 300),
}
LEAST_POINTS = 10


def posts(rows: DataFrame, json_col: str, platform: str) -> DataFrame:
    """(id, url, title, published_at, text) of a column that holds one post each, as the platform's interface gives it.

    Markup becomes text; posts shorter than the platform's least are dropped, and forum posts under LEAST_POINTS.
    """
    schema, fields, markup, least = PLATFORMS[platform]
    j = rows.select(F.from_json(json_col, schema).alias("j")).select("j.*")
    if platform == "hn":
        j = j.where(F.col("points") >= LEAST_POINTS)
    p = j.select(*[F.col(f).alias(n) for f, n in zip(fields, ("id", "url", "title", "published_at", "text"), strict=True)]).where("id is not null")
    if markup:
        p = p.withColumn("title", pages.tidy(pages.unescaped(F.col("title")))).withColumn("text", pages.main_text(F.col("text")))
    p = p.where(F.length("text") >= least)
    return p.groupBy("id").agg(F.min(F.struct("published_at", "text", "url", "title")).alias("r")).select("id", "r.url", "r.title", "r.published_at", "r.text")


def read_posts(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """posts() of the JSON lines under a path."""
    return posts(spark.read.text(path), "value", platform)


def first_seen(rows: DataFrame, url: str = "url", ts: str = "ts") -> DataFrame:
    """(url, first_ts, title): each http address with the time and title it came with first."""
    web = rows.where(F.col(url).rlike("^https?://") & F.col(ts).isNotNull())
    return web.groupBy(F.col(url).alias("url")).agg(F.min(F.struct(F.col(ts).alias("ts"), F.coalesce("title", F.lit("")).alias("title"))).alias("f")).select("url", F.col("f.ts").alias("first_ts"), F.col("f.title").alias("title"))


def cursors(rows: DataFrame, page: Column) -> DataFrame:
    """(channel, page, rows, cursor, stalled): of each page, newest first, the oldest time, from which the next goes on; stalled if it is no older than the last.

    rows: (channel, ts). A channel's pages are few, its rows may be many; they are aggregated before pages are ordered.
    """
    from pyspark.sql import Window

    g = rows.where("ts is not null").groupBy("channel", page.alias("page")).agg(F.count("*").alias("rows"), F.min("ts").alias("cursor"))
    last = F.lag("cursor").over(Window.partitionBy("channel").orderBy("page"))
    return g.withColumn("stalled", F.coalesce(F.col("cursor") >= last, F.lit(False)))


def tiles(start: int, end: int, step: int, spark: SparkSession) -> DataFrame:
    """(tile, from_ts, to_ts): windows of `step` seconds that tile a range; the last one may be shorter."""
    t = spark.range(start, end, step).select(F.floor((F.col("id") - start) / step).alias("tile"), F.col("id").alias("from_ts"))
    return t.withColumn("to_ts", F.least(F.col("from_ts") + step, F.lit(end)))


def spans(claims: DataFrame, windows: list, earliest: int) -> DataFrame:
    """(claim_id, span, from_ts, to_ts): the year before a claim (span 0) and each window after it, in days, from which news are gathered.

    Spans that begin before `earliest` are left out, as news lists don't reach there. claims: (claim_id, anchor_ts).
    """
    days = [(-365, 0), *windows]
    each = F.array(*[F.struct(F.lit(i).alias("span"), (F.col("anchor_ts") + a * 86400).alias("from_ts"), (F.col("anchor_ts") + b * 86400).alias("to_ts")) for i, (a, b) in enumerate(days)])
    return claims.where("anchor_ts is not null").select("claim_id", F.inline(each)).where(F.col("from_ts") >= earliest)
