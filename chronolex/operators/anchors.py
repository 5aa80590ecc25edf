"""Whether a claim is its author's first use of it, and what the source adds to what was known without it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.operators.store import DEFEATS

SURE, LEAST_QUOTE, QUOTE_HEAD = 0.6, 12, 60


def first_use(lagged: DataFrame, docs: DataFrame) -> DataFrame:
    """(claim_id, doc_id, first_ts, statements, moved_days): the author's earliest own document that already says the claim.

    lagged: verdicts with lag, ts, anchor_ts, source_id, own_source, own_doc. Of a claim's prior verdicts on other documents of its own source
    those count whose relation takes novelty away with confidence SURE or more and whose quote, LEAST_QUOTE characters or longer,
    stands in the document by its first QUOTE_HEAD characters; `statements` of them. Claims without one have no row. No cap
    on candidates: a single-machine tool caps them to save model calls, and there are none here.
    """
    own = lagged.where("direction = 'prior' and source_id = own_source and doc_id <> own_doc and lag < 0")
    rows = own.where(F.col("relation").isin(DEFEATS) & (F.col("conf") >= SURE) & (F.length("quote") >= LEAST_QUOTE)).select("claim_id", "doc_id", "ts", "anchor_ts", "quote")
    said = rows.join(docs.select("doc_id", F.lower("text").alias("_text")), "doc_id").where(F.contains("_text", F.substring(F.lower("quote"), 1, QUOTE_HEAD)))
    g = said.groupBy("claim_id").agg(F.min(F.struct("ts", "doc_id")).alias("f"), F.first("anchor_ts").alias("anchor_ts"), F.count("*").alias("statements"))
    return g.select("claim_id", F.col("f.doc_id").alias("doc_id"), F.col("f.ts").alias("first_ts"), "statements", F.floor((F.col("anchor_ts") - F.col("f.ts")) / 86400).alias("moved_days"))


def ablation_values(grades: DataFrame) -> DataFrame:
    """(claim_id, closed, source, decoy, value, decoy_controlled, internalised) from grades (claim_id, condition, score, hedged).

    Conditions are closed, source and decoy; a repeated grade's mean counts. value: the source's score over the best
    alternative, which is closed alone where there is no decoy (null, never 0); null without closed or source.
    internalised: known without the source (0.6 or more) and not hedged.
    """
    s = F.when(F.col("score").isNotNull(), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    at = lambda c: F.avg(F.when(F.col("condition") == c, s)).alias(c)
    hedged = F.coalesce(F.bool_or(F.when(F.col("condition") == "closed", F.col("hedged"))), F.lit(False))
    g = grades.groupBy("claim_id").agg(at("closed"), at("source"), at("decoy"), hedged.alias("h"))
    value = F.when(F.col("closed").isNotNull(), F.col("source") - F.greatest("closed", "decoy"))
    return g.select("claim_id", "closed", "source", "decoy", value.alias("value"), F.col("decoy").isNotNull().alias("decoy_controlled"), ((F.col("closed") >= 0.6) & ~F.col("h")).alias("internalised"))
