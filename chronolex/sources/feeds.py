"""Landed feeds as document rows: Atom entries of papers and news listings in JSON.

Fetching is not the engine's work: a crawler lands files, and these readers turn them into rows. Malformed dates
are null, entries without an address or title stay with nulls, missing files fail as Spark's readers do.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "id string, title string, summary string, published string, author array<struct<name: string>>"
ARTICLE = "url string, title string, seendate string, domain string, language string"


def seen_instant(text: Column) -> Column:
    """Epoch seconds of a news listing's compact UTC time (20240131T235959Z); null for any other form."""
    return F.when(text.rlike(r"^[0-9]{8}T[0-9]{6}Z\z"), F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'"))))


def as_papers(entries: DataFrame) -> DataFrame:
    """(id, title, text, published_ts) of parsed Atom entries; the text is title, authors and abstract with single blanks."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    names = F.array_join(F.coalesce(F.filter(F.col("author.name"), lambda n: n.isNotNull()), F.array().cast("array<string>")), ", ")
    text = F.concat_ws("\n\n", *[F.when(c != "", c) for c in (flat("title"), names, flat("summary"))])
    return entries.select("id", flat("title").alias("title"), text.alias("text"), F.unix_timestamp(F.try_to_timestamp("published")).alias("published_ts"))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Papers of the Atom files under a path; each file is split by entry."""
    return as_papers(spark.read.option("rowTag", "entry").option("mode", "PERMISSIVE").schema(ENTRY).xml(path))


def parse_atom(rows: DataFrame, xml_col: str) -> DataFrame:
    """Papers of a column that holds one Atom entry each; unreadable entries are dropped."""
    e = rows.select(F.from_xml(xml_col, ENTRY, {"rowTag": "entry"}).alias("e")).where("e.id is not null")
    return as_papers(e.select("e.*"))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """News listings of JSON lines: (url, title, domain, language, published_ts), each url once with its earliest time."""
    rows = spark.read.schema(ARTICLE).json(path).where("url is not null").withColumn("published_ts", seen_instant(F.col("seendate")))
    first = rows.groupBy("url").agg(F.min_by(F.struct("title", F.lower(F.trim("domain")).alias("domain"), "language", "published_ts"), F.struct(F.coalesce("published_ts", F.lit(2**62)), F.coalesce("title", F.lit("")))).alias("r"))
    return first.select("url", "r.*")
