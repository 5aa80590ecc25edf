"""Problem 1: groups of documents whose texts are linked by similarity, directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex import scratch
from chronolex.llm import linking
from chronolex.operators import buckets
from chronolex.operators.graph import connected_components


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, min_runs: int = 1) -> DataFrame:
    """(id, class_id): one row per document that is linked to another; class_id is the least id of its class.

    Documents are linked if their sets of runs of `words` words have a Jaccard similarity of at least
    the threshold; texts with fewer than min_runs runs, empty and null texts are never linked. Ids
    must be unique; other columns are ignored. An empty table gives an empty one.

    Every run counts once: documents are linked by sets, so the signatures' weights are all 1.

    Candidates come from banded DartMinHash signatures and each is checked on its whole set, whose runs are told apart by 32-bit hashes:
    1. equal sets collapse to a representative by their hash;
    2. each representative is checked against one of the least members of its buckets, the one it
       shares most buckets with;
    3. what shares a bucket across the components so found is checked pair by pair; in hot buckets only what
       also shares a run that is rare among their texts (buckets.cross_pairs), which loses no link.
    A bucket of a third of all rows thus costs a check per row, as long as its rows link to its least member, and
    else a check per pair with a rare run in common.
    """
    return scratch.settled(lambda: _classes(docs, id_col, text_col, words, threshold, min_runs), "classes")


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, min_runs: int) -> DataFrame:
    sk = scratch.written(linking.sketches(docs, id_col, text_col, words, min_runs), "sketches")
    sets = sk.groupBy("set_hash", "n").agg(F.min("id").alias("rep"))
    member = sk.select("id", "set_hash", "n").join(sets, ["set_hash", "n"]).select("id", "rep")
    copies = scratch.written(member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")), "copies")
    rows = sk.join(copies.select(F.col("a").alias("id")), "id", "left_anti").select("id", F.explode("bands").alias("key"))
    lead = rows.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("size")).where("size > 1").select("key", "leader")
    shared = scratch.written(rows.join(lead, "key").select("key", "id", "leader"), "buckets")
    star = shared.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("shared"))

    check = lambda pairs: scratch.written(linking.verified(pairs, docs, id_col, text_col, words, threshold), "links")
    first = scratch.written(star.groupBy("id").agg(F.min_by("leader", F.struct(-F.col("shared"), "leader")).alias("leader")), "first")
    links = check(first.select(F.col("id").alias("a"), F.col("leader").alias("b")))
    comp = scratch.written(connected_components(links), "classes")
    # what is left: members of one bucket whose components differ and that weren't compared yet
    placed = shared.select("key", "id").join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    open_ = scratch.written(placed.join(mixed, "key", "left_semi").join(sk.select("id", "n"), "id").select("key", "id", "n", "c"), "open")
    near = F.least("n_x", "n_y") >= threshold * F.greatest("n_x", "n_y")
    texts = lambda ids: linking.run_lists(docs, ids, id_col, text_col, words)
    rest = buckets.cross_pairs(open_, texts, F.ceil(threshold * F.size("elements")), near)
    done = first.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    rest = scratch.written(rest.join(done, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(check(rest))
    return connected_components(links.unionByName(copies)).select("id", F.col("component").alias("class_id"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_classes(_documents(spark, sf), words=6, threshold=0.5, min_runs=20)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of documents of one class, as the case list wants it; it grows with the squares of classes, p1_classes with documents."""
    c = p1_classes(spark, sf)
    return c.select(F.col("id").alias("doc_a"), "class_id").join(c.select(F.col("id").alias("doc_b"), "class_id"), "class_id").where("doc_a < doc_b").select("doc_a", "doc_b")
