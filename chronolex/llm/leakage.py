"""Problem 7: passages of evaluation items in training text, by a distributed positional inverted index."""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex import scratch
from chronolex.llm import textvec

#: positions left free between two documents of a segment, so that no passage reaches across
GAP = 256
#: words of items that one pass over the index looks up; more items are looked up in more passes
ITEM_WORDS = 2_000_000

_INDEX = "segment long, term long, n int, positions binary"


def _segments(tag: int):
    return lambda batches: _tagged_segments(batches, (tag << 40) + (TaskContext.get().partitionId() << 20))


def _tagged_segments(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for lo, hi in textvec.slices(texts):
            w = textvec.Words(texts[lo:hi], drop_unseen=True)
            position = (np.arange(len(w.hash)) + GAP * w.doc).astype("<u4")
            first = (w.first[:-1] + GAP * np.arange(hi - lo)).astype("<u4")
            order = np.argsort(w.hash, kind="stable")
            term = w.hash[order]
            head = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            ends = np.append(head, len(term))
            data = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(position[order].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(head), number)), pa.array(term[head].view(np.int64)), pa.array(np.diff(ends).astype(np.int32)), data], ["segment", "term", "n", "positions"])
            # the segment's documents: where each starts (n = -1) and its id (n = -2)
            yield pa.RecordBatch.from_arrays([pa.array([number] * 2), pa.array([0, 0], pa.int64()), pa.array([-1, -2], pa.int32()), pa.array([first.tobytes(), ids[lo:hi].astype("<i8").tobytes()], pa.binary())], ["segment", "term", "n", "positions"])
            number += 1


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(segment, term, n, positions): for each segment of about a million characters, where each word stands.

    A word is a run of letters and digits of the lower-case text without invisible characters; null texts
    and ids are left out. Segments are built where the text is read; nothing is shuffled. The table can be
    stored, asked again with other items, and have the index of further documents appended: the numbers of the segments
    of one call begin with 23 random bits of its own.
    """
    rows = scratch.spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"))
    return rows.mapInArrow(_segments(uuid.uuid4().int & 0x7FFFFF), _INDEX)


def _item_words(items: list[tuple[int, str | None]], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the items long enough to match, one after the other, each item's id, and where it starts."""
    w = textvec.Words([t for _, t in items], drop_unseen=True)
    n = np.diff(w.first)
    long = n >= words
    return w.hash[long[w.doc]], np.array([i for i, _ in items], np.int64)[long], np.concatenate(([0], np.cumsum(n[long])))


def _matcher(term: np.ndarray, item: np.ndarray, start: np.ndarray, words: int, slop: int):
    """A function that finds the items' passages in one segment."""

    def match(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        blob = table.column("positions").combine_chunks()
        blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
        known = table.column("term").to_numpy().view(np.uint64)
        first = ids = None
        lists, keys = [], []
        for i, k in enumerate(n):
            data = blob[i].as_buffer()
            if k == -1:
                first = np.frombuffer(data, "<u4").astype(np.int64)
            elif k == -2:
                ids = np.frombuffer(data, "<i8")
            else:
                keys.append(known[i])
                lists.append(data)
        out_item, out_doc = [], []
        if keys and first is not None:
            order = np.argsort(keys)
            keys, lists = np.array(keys)[order], [lists[i] for i in order]
            at = np.minimum(np.searchsorted(keys, term), len(keys) - 1)
            there = keys[at] == term
            for i in _with_run(there, start, words):
                s, e = start[i], start[i + 1]
                hits = _passages([lists[k] if ok else None for k, ok in zip(at[s:e], there[s:e], strict=True)], words, slop)
                docs = np.unique(np.searchsorted(first, hits, side="right") - 1)
                out_item += [item[i]] * len(docs)
                out_doc += list(ids[docs])
        return pa.table({"item_id": pa.array(out_item, pa.int64()), "doc_id": pa.array(out_doc, pa.int64())})

    return match


def _with_run(there: np.ndarray, start: np.ndarray, words: int) -> np.ndarray:
    """The items that have `words` neighbouring words that all stand in the segment."""
    total = np.concatenate(([0], np.cumsum(there)))
    full = np.zeros(len(there) + 1, np.int64)
    if len(there) >= words:
        full[: len(there) - words + 1] = total[words:] - total[:-words] == words
    sums = np.concatenate(([0], np.cumsum(full)))
    return np.flatnonzero(sums[np.maximum(start[1:] - words + 1, start[:-1])] > sums[start[:-1]])


def _in_order(lists: list, start: int, slop: int) -> bool:
    """Whether the words of a window follow each other, each within slop of its place after `start`."""
    last = -1
    for k, x in enumerate(lists):
        i = np.searchsorted(x, max(start + k - slop, last + 1))
        if i == len(x) or x[i] > start + k + slop:
            return False
        last = x[i]
    return True


def _passages(lists: list, words: int, slop: int) -> np.ndarray:
    """Positions in the segment where `words` neighbouring words of the item stand in order.

    lists: of each word of the item its positions, None if it has none. Each window is entered through
    its rarest word, and the lists of the others are intersected shifted by their offsets.
    """
    size = np.array([len(x) if x is not None else 0 for x in lists])
    lists = [np.frombuffer(x, "<u4").astype(np.int64) if x is not None else None for x in lists]
    found = []
    entered = {}
    for o in range(len(lists) - words + 1):
        window = size[o : o + words]
        if window.all():
            entered.setdefault(o + int(window.argmin()), []).append(o)
    for p, windows in entered.items():
        base = lists[p] - p  # where the item's first word would stand
        lo, hi = windows[0], windows[-1] + words
        hit = np.zeros((hi - lo, len(base)), bool)
        alive = np.ones(len(base), bool)
        for q in sorted(range(lo, hi), key=lambda q: abs(q - p)):
            near = np.flatnonzero(alive)
            if size[q] and len(near):
                want = base[near] + q - slop
                k = np.searchsorted(lists[q], want)
                ok = k < len(lists[q])
                ok[ok] = lists[q][k[ok]] <= want[ok] + 2 * slop
                hit[q - lo, near] = ok
            if abs(q - p) == 1 and q != p and hi - lo > 2:  # a passage holds a neighbour on one side at least
                sides = [x - lo for x in (p - 1, p + 1) if lo <= x < hi]
                if all(abs(x - (p - lo)) == 1 for x in sides) and q - lo == sides[-1]:
                    alive &= hit[sides].any(0)
        for o in windows:
            full = hit[o - lo : o - lo + words].all(0)
            at = base[full] + o
            if slop:
                at = at[[_in_order(lists[o : o + words], int(x), slop) for x in at]] if len(at) else at
            found.append(at)
    return np.maximum(np.concatenate(found), 0) if found else np.zeros(0, np.int64)


def leaked_items(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", words: int = 13, slop: int = 0) -> DataFrame:
    """(item_id, doc_id): documents that have `words` or more consecutive words of an item in the same order.

    slop 0: exactly consecutive; else each word may stand up to slop positions off its place, in the same order (proximity).
    Shorter, empty and null items match nothing; rows of one id count together, and pairs are distinct.

    The items are the small side: they are looked up in blocks of at most ITEM_WORDS words, and only the
    blocks' hashes are broadcast. From the index come only the lists of words that the items have.
    """
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    blocks = 1 + int((rows.agg(F.sum(F.length("text"))).first()[0] or 0) // (4 * ITEM_WORDS))
    out = None
    for b in range(blocks):
        block = [tuple(r) for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()]
        term, item, start = _item_words(block, words)
        spark = index.sparkSession
        wanted = spark.createDataFrame(pa.table({"term": pa.array(np.unique(term).view(np.int64))}).to_pandas(), "term long")
        # one scan: a segment's number is that of its task, so it can't be put together from two
        lists = index.join(F.broadcast(wanted.withColumn("asked", F.lit(True))), "term", "left").where("asked or n < 0").drop("asked")
        pairs = lists.groupBy("segment").applyInArrow(_matcher(term, item, start, words, slop), "item_id long, doc_id long")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def _leaks(spark: SparkSession, sf: str, slop: int) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "eval_items"))
    index = lambda: scratch.written(positional_index(docs.select("doc_id", "text")), "index")
    return scratch.settled(lambda: leaked_items(index(), items, slop=slop), "leaks")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf, 0)


def p7_proximity(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf, 2)
