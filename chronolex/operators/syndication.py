"""Copies that outlets take from each other: the corpus's plain MinHash, banded, and what remains without copies.

Texts without a signature (null, empty, fewer than 20 shingles) are copies of nothing and stand for themselves.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex import scratch
from chronolex.operators import buckets, minhash
from chronolex.operators.graph import connected_components

BANDS, SIMILAR = 16, 0.55


def estimate(x: Column, y: Column) -> Column:
    """The share of equal places of two signatures."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda same: same)) / F.lit(float(minhash.HASHES))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(id_col, class_id): documents linked to another, directly or through others, class_id the least id of theirs.

    Two documents are linked if they share a band of their signatures and agree in `similar` of its places. No bucket
    is left out for its size: equal signatures collapse first, every row is then checked against the least member of
    each of its buckets, and pairs are made only between members whose components still differ, in hot buckets only by
    places that are rare among them (buckets.cross_pairs).
    """
    return scratch.settled(lambda: _classes(docs, id_col, text_col, similar), "classes")


def _classes(docs: DataFrame, id_col: str, text_col: str, similar: float) -> DataFrame:
    sig = scratch.written(minhash.signatures(docs, id_col, text_col).select(F.col(id_col).alias("id"), "signature", F.xxhash64("signature").alias("whole")), "signatures")
    rep = sig.groupBy("whole").agg(F.min("id").alias("rep"))
    copies = sig.select("id", "whole").join(rep, "whole").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = sig.join(rep.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "signature")
    wide = minhash.HASHES // BANDS
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("signature", i * wide + 1, wide)) for i in range(BANDS)])
    rows = reps.select("id", F.explode(keys).alias("key"))
    lead = rows.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("size")).where("size > 1").select("key", "leader")
    shared = scratch.written(rows.join(lead, "key"), "buckets")

    def check(pairs: DataFrame) -> DataFrame:
        x, y = (reps.select(F.col("id").alias(c), F.col("signature").alias(s)) for c, s in (("a", "x"), ("b", "y")))
        return scratch.written(pairs.join(x, "a").join(y, "b").where(estimate(F.col("x"), F.col("y")) >= similar).select("a", "b"), "links")

    links = check(shared.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    comp = scratch.written(connected_components(links), "components")
    placed = shared.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    left = scratch.written(placed.join(mixed, "key", "left_semi"), "open")
    if left.isEmpty():
        rest = links.where("false")
    else:
        places = F.transform("signature", lambda v, i: F.xxhash64(i, v))
        sets = lambda ids: reps.join(ids, "id", "left_semi").select("id", places.alias("elements"))
        rest = check(buckets.cross_pairs(left, sets, F.lit(math.ceil(similar * minhash.HASHES))))
    return connected_components(links.unionByName(rest).unionByName(copies)).select(F.col("id").alias(id_col), F.col("component").alias("class_id"))


def canonicals(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, canonical): of every class the earliest document, the least id among equals; docs: (doc_id, ts)."""
    c = classes.join(docs.select("doc_id", "ts"), "doc_id")
    first = c.groupBy("class_id").agg(F.min_by("doc_id", F.struct(F.coalesce("ts", F.lit(2**62)), "doc_id")).alias("canonical"))
    return c.select("doc_id", "class_id").join(first, "class_id").select("doc_id", "canonical")


def independent_sources(evidence: DataFrame, canonical: DataFrame) -> DataFrame:
    """(claim_id, sources): different sources of a claim's evidence, a class of copies counting once, for its first row.

    evidence: (claim_id, doc_id, source_id, ts); a claim whose evidence has no source has 0.
    """
    e = evidence.join(canonical, "doc_id", "left").withColumn("canonical", F.coalesce("canonical", "doc_id"))
    first = e.groupBy("claim_id", "canonical").agg(F.min_by("source_id", F.struct(F.coalesce("ts", F.lit(2**62)), "doc_id")).alias("source_id"))
    return first.groupBy("claim_id").agg(F.count_distinct("source_id").alias("sources"))
