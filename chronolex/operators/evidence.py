"""Mechanical checks of quoted evidence, and the downgrading of verdicts that fail them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.operators import store


def normal(text: str | Column) -> Column:
    """Lower case with single blanks; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \t\r\n]+", " "))


def supported(quote: Column, text: Column) -> Column:
    """Whether a normalised quote stands in a normalised text: whole, or enough of its runs of four words.

    Quotes under 12 characters never do; of n runs' words at least max(1, (n - 3) div 2) runs must be found.
    """
    w = F.split(quote, " ")
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 4), " "))
    hits = F.size(F.filter(runs, lambda r: F.contains(text, r)))
    part = (n >= 4) & (hits >= F.greatest(F.lit(1), F.floor((n - 3) / 2)))
    return (F.length(quote) >= 12) & (F.contains(text, quote) | part)


def checked(verdicts: DataFrame, docs: DataFrame) -> DataFrame:
    """Verdicts with `ok`: whether their quote is supported by their document (false without document or quote)."""
    d = docs.select("doc_id", normal("text").alias("_text"))
    return verdicts.join(d, "doc_id", "left").withColumn("ok", F.coalesce(supported(normal("quote"), F.col("_text")), F.lit(False))).drop("_text")


def downgraded(rows: DataFrame) -> DataFrame:
    """Unsupported verdicts lose their claim and their quote: prior ones become topical, later ones orthogonal, confidence at most 0.3."""
    prior = (F.col("direction") == "prior") & F.col("relation").isin("identical", "paraphrase", "subsumes", "partial")
    later = (F.col("direction") == "later") & (F.col("relation") != "orthogonal")
    fall = ~F.col("ok") & (prior | later)
    told = {
        "conf": F.when(fall, F.least("conf", F.lit(0.3))).otherwise(F.col("conf")),
        "relation": F.when(fall & prior, "topical").when(fall & later, "orthogonal").otherwise(F.col("relation")),
        "quote": F.when(fall, "").otherwise(F.col("quote")),
    }
    return rows.withColumns(told).withColumn("weight", store.weight_of(F.col("direction"), F.col("relation")))
