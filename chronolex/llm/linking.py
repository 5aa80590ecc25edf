"""Linked texts: sketches, candidate pairs from banded signatures, and the exact check of a pair."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex import scratch
from chronolex.llm import dart_minhash, textvec

#: coordinates are BANDS * ROWS; two texts of similarity s share a band with 1 - (1 - s**ROWS)**BANDS
BANDS, ROWS, SEED = 40, 3, 11


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, min_runs: int) -> DataFrame:
    """(id, n, set_hash, bands) of each text with at least min_runs different runs of `words` words.

    n: size of the set of runs; set_hash: a hash of the whole set, equal for equal sets. Null texts
    count as empty and have no sketch. One pass, no shuffle.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in textvec.slices(texts):
                h, doc = textvec.run_sets(texts[lo:hi], words)
                n = np.bincount(doc, minlength=hi - lo)
                keep = n >= min_runs
                if not keep.any():
                    continue
                whole = np.zeros(hi - lo, np.uint64)
                np.add.at(whole, doc, textvec.mix(h))
                place = np.cumsum(keep) - 1
                on = keep[doc]
                sig = dart_minhash.signatures(h[on], place[doc[on]], np.ones(int(on.sum())), int(keep.sum()), BANDS * ROWS, SEED)
                keys = dart_minhash.bands(sig, ROWS)
                rows = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows + lo)), pa.array(n[rows], pa.int64()), pa.array(whole[rows].view(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))],
                    ["id", "n", "set_hash", "bands"],
                )

    return scratch.spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")).mapInArrow(sketch, f"id {docs.schema[id_col].dataType.simpleString()}, n long, set_hash long, bands array<long>")


def _run_sets(rows: DataFrame, words: int) -> DataFrame:
    """rows with their last column, a text, replaced by `runs`: the sorted hashes of its runs of words, four bytes each."""
    keys = rows.columns[:-1]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            for lo, hi in textvec.slices(texts):
                h, doc = textvec.run_sets(texts[lo:hi], words)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                short = (h >> np.uint64(22)).astype("<u4")
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array([short[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], [*keys, "runs"])

    return rows.mapInArrow(sets, ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "runs binary"]))


def run_lists(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, elements): the runs of the texts of some ids, as arrays of 54-bit hashes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in textvec.slices(texts):
                h, doc = textvec.run_sets(texts[lo:hi], words)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64)))], ["id", "elements"])

    return rows.mapInArrow(lists, f"id {rows.schema['id'].dataType.simpleString()}, elements array<long>")


def jaccard_of(kind: type):
    """The Jaccard similarity of two sorted sets, given as bytes of numbers; 0 where either is empty or null."""

    @F.pandas_udf(T.DoubleType())
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if x and y:
                x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out[i] = both / (len(x) + len(y) - both)
        return pd.Series(out)

    return jaccard


jaccard = jaccard_of(np.uint32)

#: pairs whose ids may be broadcast; more are joined by shuffle
BROADCAST = 1_000_000


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have a similarity of at least the threshold; pairs must be written already.

    Only texts of a pair are cut into runs. Up to BROADCAST pairs travel to the texts, so that only the sets of
    the a side are shuffled; beyond it the texts are.
    """
    few = F.broadcast if pairs.count() <= BROADCAST else lambda df: df
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    left = _run_sets(texts.join(few(pairs), F.col("_id") == F.col("a")).select("a", "b", "text"), words).withColumnRenamed("runs", "x")
    right = _run_sets(texts.join(few(pairs.select("b").distinct()), F.col("_id") == F.col("b")).select("b", "text"), words).withColumnRenamed("runs", "y")
    return left.join(right, "b").where(jaccard("x", "y") >= threshold).select("a", "b")
