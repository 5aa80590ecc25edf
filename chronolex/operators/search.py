"""Retrieval in slices of time: tokens, BM25, phrases, vectors and rank fusion. Ties fall to the lesser document id.

A query has (query_id, text, before, after, exclude_source, exclude_doc); each bound but the text may be null. Slices are strict on
both sides, documents without a source stay unless excluded by id. Statistics are those of all documents, whatever the slice.
"""

import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex import scratch
from chronolex.functions import stemming

K1, B = 1.2, 0.75
SLICE = ["before", "after", "exclude_source", "exclude_doc"]
RRF_K, FINGERPRINT_BONUS = 60, 0.5
#: tokens of a query that take part, and the least length of one
MOST, SHORT = 40, 3
#: vectors of one time bucket lie in one block or more
BUCKET = 91 * 86400


def _fold_table() -> tuple[str, str]:
    """Accented letters and their plain ones; combining marks have none and so fall out."""
    pairs = [(chr(c), d[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if (d := unicodedata.normalize("NFD", chr(c))) != chr(c) and d[0].isascii() and chr(c).islower()]
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


def folded(text: str | Column) -> Column:
    """Lower case without diacritics; empty for null."""
    return F.translate(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), *_fold_table())


def tokens(text: str | Column) -> Column:
    """Runs of letters and digits of the folded text; none for null."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: words of a block, queries and phrases that meet a block at once
BLOCK, ASKED, PHRASES = 1 << 22, 1 << 15, 1 << 17
_DOCS = "docs array<bigint>, ts array<bigint>, sources array<string>, dl binary"
_NEVER = -(2**63)
#: partitions of blocks that one task reads at most, words that are held at once, and what rounding may move a score by
RUN, PIECE, SLACK = 16, 1 << 19, 2e-6
#: numbers in a block's rows that have a place for every document, the share of documents that makes a row of a list, hits that are held until they are added, and places of short lists that are read at once
ROOM, DENSE, HELD, SHORTS = 1 << 23, 1 / 16, 1 << 17, 1 << 18
#: what any sum of a document with a word is over
LEAST = np.nextafter(0, 1)


def words(docs: DataFrame, stem: bool = False) -> DataFrame:
    """The words of title and text of each document in blocks, over all cores; docs: (doc_id, title, text, ts, source_id).

    A block has some BLOCK words: its documents by ts (docs, ts, sources, and in dl their numbers of words), its different words (terms),
    and for each place in the texts, one after the other, the number of its word (at). Binary columns are 32-bit numbers.
    """
    rows = scratch.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ts").cast("long").alias("ts"), "source_id", F.concat_ws(" ", "title", "text").alias("_t"))).select("doc_id", "ts", "source_id", tokens("_t").alias("w"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(3).flatten())
            if n >= BLOCK:
                yield _block(held)
                held, n = [], 0
        if sum(len(x) for x in held):
            yield _block(held)

    told = rows.mapInArrow(coded, f"{_DOCS}, terms array<string>, at binary")
    return stemmed(told) if stem else told


def _row(names: list[str], *values: pa.Array | bytes) -> pa.RecordBatch:
    """One row; an array stands in it as a list."""
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) if isinstance(v, bytes) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], names)


def _block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    doc, ts, source, w = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
    found = w.flatten().dictionary_encode()
    dl = w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((doc.to_numpy(zero_copy_only=False), ts.fill_null(_NEVER).to_numpy(zero_copy_only=False)))
    moved = dl[order]
    at = found.indices.to_numpy(zero_copy_only=False)[np.repeat((np.cumsum(dl) - dl)[order] - (np.cumsum(moved) - moved), moved) + np.arange(moved.sum())]
    return _row(["docs", "ts", "sources", "dl", "terms", "at"], doc.take(pa.array(order)), ts.take(pa.array(order)), source.take(pa.array(order)), moved.astype("<i4").tobytes(), found.dictionary, at.astype("<i4").tobytes())


def stemmed(told: DataFrame) -> DataFrame:
    """Blocks of words() with each word's stem in its place; a block's different words are stemmed once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                to = pa.array([stemming.stem(w) for w in row["terms"].as_py()], pa.string()).dictionary_encode()
                at = to.indices.to_numpy(zero_copy_only=False)[np.frombuffer(row["at"].as_py(), "<i4")]
                yield _row([*row], row["docs"].values, row["ts"].values, row["sources"].values, row["dl"].as_py(), to.dictionary, at.astype("<i4").tobytes())

    return told.mapInArrow(each, told.schema)


def postings(told: DataFrame) -> DataFrame:
    """The lists of each block of words(): in pos the documents of each word, one word after the other, by their place in the block, and in tf how often it stands there.

    dfs has the lengths of the lists. Nothing is shuffled, and a word's lists are never put together.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                dl = np.frombuffer(row["dl"].as_py(), "<i4")
                key = np.frombuffer(row["at"].as_py(), "<i4").astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl)
                key.sort()
                head = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
                tf, key = np.diff(np.append(head, len(key))), key[head]
                dfs = np.bincount(key // len(dl), minlength=len(row["terms"].values))
                yield _row([*row][:5] + ["dfs", "pos", "tf"], row["docs"].values, row["ts"].values, row["sources"].values, row["dl"].as_py(), row["terms"].values, pa.array(dfs, pa.int64()), (key % len(dl)).astype("<i4").tobytes(), tf.astype("<i4").tobytes())

    return told.mapInArrow(listed, f"{_DOCS}, terms array<string>, dfs array<bigint>, pos binary, tf binary")


def lengths(index: DataFrame) -> DataFrame:
    """(n, avgdl) of an index: its documents and their mean length."""

    @F.pandas_udf("long")
    def total(dl: pd.Series) -> pd.Series:
        return dl.map(lambda x: int(np.frombuffer(x, "<i4").sum(dtype=np.int64)))

    return index.select(F.size("docs").alias("n"), total("dl").alias("words")).agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))


def _chunks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """(chunk, {name}): arrays of some `most` rows each, as structs."""
    n = rows.agg(F.ceil(F.count("*") / most).alias("_n"))
    return rows.join(F.broadcast(n), F.lit(True)).groupBy(F.pmod(F.xxhash64(rows.columns[0]), "_n").alias("chunk")).agg(F.collect_list(F.struct(*rows.columns)).alias(name))


def _in_runs(blocks: DataFrame) -> DataFrame:
    """Blocks over all cores, up to RUN partitions to a task: what the first of a task's blocks give spares work on the others."""
    cores, n = blocks.sparkSession.sparkContext.defaultParallelism, blocks.rdd.getNumPartitions()
    return scratch.spread(blocks).coalesce(max(cores, -(-n // RUN)))


def bm25(queries: DataFrame, index: DataFrame, k: int = 10, stem: bool = False) -> DataFrame:
    """(query_id, doc_id, score, place): the k best documents of each query by BM25 over the OR of its first words of SHORT letters or more.

    index: postings() with the same stem. Queries, each with its words and their numbers of documents, go to the blocks of the index, where
    the parts of its words are added up over the documents before its end; a task gives k rows per query, so hits are never written out.
    """
    split = (lambda c: stemming.stems(tokens(c))) if stem else tokens
    own = F.array_distinct(F.slice(F.filter(split("text"), lambda w: F.length(w) >= SHORT), 1, MOST))
    q = queries.select("query_id", *SLICE, F.explode(own).alias("term"))
    df = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    df = df.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    asked = q.join(df, "term").groupBy("query_id", *SLICE).agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("w"))
    asked = asked.select("query_id", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"), "exclude_source", F.col("exclude_doc").cast("long").alias("exclude_doc"), F.col("w.term").alias("terms"), F.col("w.df").alias("dfs"))
    asked = scratch.written(asked, "asked")
    met = _in_runs(index).crossJoin(F.broadcast(_chunks(asked, ASKED, "q").crossJoin(lengths(index))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _best_of_run(batches, k, _score, lambda q: q, ["query_id"])

    hits = met.mapInArrow(best, T.StructType([queries.schema["query_id"], T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    return ranked(hits, k)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for i in range(len(batch)):
            yield {n: batch.column(n)[i] for n in batch.schema.names}


def _best_of_run(batches: Iterator[pa.RecordBatch], k: int, score: Callable, of: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The k best of each query over all blocks of a task, one batch for each chunk of queries.

    score(row, block, kept) adds a block's documents to kept; of(q) gives the queries of a chunk, of which the columns in names are returned.
    """
    found: dict[int, tuple[list[pa.Array], _Kept]] = {}
    last, block = None, None
    for row in _rows(batches):
        # a block meets all chunks of queries one after the other
        if last is None or not all(last[c].equals(row[c]) for c in last):
            last = {c: row[c] for c in row if c not in ("chunk", "q", "n", "avgdl")}
            block = _Block(row)
        q, chunk = of(row["q"].values), row["chunk"].as_py()
        if chunk not in found:
            found[chunk] = [q.field(c).take(pa.array(np.arange(len(q)))) for c in names], _Kept(len(q), k)
        score(row, block, found[chunk][1])
    for columns, kept in found.values():
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept.who)) for c in columns), pa.array(kept.doc), pa.array(kept.score)], [*names, "doc_id", "score"])


class _Kept:
    """Of each of n queries the k best documents so far; least has the score of the k-th, 0 while there are fewer."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.zeros(n)
        self.who, self.doc, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, who: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        ok = score >= self.least[who]
        met = np.zeros(len(self.least), bool)
        met[who[ok]] = True
        old = met[self.who]
        who, doc, score = (np.concatenate((a[old], b[ok])) for a, b in ((self.who, who), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, who))
        place = np.arange(len(who)) - np.searchsorted(who[order], who[order])
        order, place = order[place < self.k], place[place < self.k]
        who, doc, score = who[order], doc[order], score[order]
        self.least[who[place == self.k - 1]] = score[place == self.k - 1]
        self.who, self.doc, self.score = (np.concatenate((a[~old], b)) for a, b in ((self.who, who), (self.doc, doc), (self.score, score)))


class _Block:
    """A block's documents as arrays; for those of postings() its lists too, made when they are first asked for."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.row = row
        self.ids = row["docs"].values.to_numpy(zero_copy_only=False)
        self.ts = row["ts"].values.fill_null(_NEVER).to_numpy(zero_copy_only=False)
        self.untimed = int(self.ts.searchsorted(_NEVER, "right"))
        sources = row["sources"].values.dictionary_encode()
        self.sources, self.source_of = sources.dictionary, sources.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.rows: list[np.ndarray] = []
        self.row_of = np.full(len(row["terms"].values), -1)
        self.n, self.norm = row["n"].as_py(), K1 * (1 - B + B * np.frombuffer(row["dl"].as_py(), "<i4") / row["avgdl"].as_py())

    def idf(self, df: pa.Array) -> np.ndarray:
        df = df.to_numpy(zero_copy_only=False)
        return np.maximum(np.log((self.n - df + 0.5) / (df + 0.5)), 1e-6)

    @cached_property
    def lists(self) -> tuple[np.ndarray, ...]:
        """Documents of all lists, the lists' lengths and starts, what each place is worth, and the most of each list."""
        pos, tf = (np.frombuffer(self.row[c].as_py(), "<i4") for c in ("pos", "tf"))
        size = self.row["dfs"].values.to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        value = tf * (K1 + 1) / (tf + self.norm[pos])
        return pos, size, start, value, np.maximum.reduceat(value, start) if len(size) else value

    @cached_property
    def keys(self) -> np.ndarray:
        """Word and document of each place of the lists as one number, in order."""
        pos, size, *_ = self.lists
        return np.repeat(np.arange(len(size)) * len(self.ids), size) + pos

    def rows_for(self, code: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Of each word the row with what it adds to every document; -1 where its list is short or no room is left, the words that are asked most first."""
        pos, size, start, value, _ = self.lists
        words, first, times = np.unique(code, return_index=True, return_counts=True)
        new = np.flatnonzero((self.row_of[words] < 0) & (size[words] >= len(self.ids) * DENSE))
        new = new[np.argsort(-times[new], kind="stable")][: max(0, ROOM // len(self.ids) - len(self.rows))]
        for j, weight in zip(words[new].tolist(), idf[first[new]].tolist(), strict=True):
            at, every = slice(start[j], start[j] + size[j]), np.zeros(len(self.ids))
            every[pos[at]] = weight * value[at]
            self.row_of[j] = len(self.rows)
            self.rows.append(every)
        return self.row_of[code]

    def slices(self, q: pa.StructArray) -> "_Slices":
        return _Slices(self, *(q.field(c) for c in SLICE))


class _Slices:
    """The slices of queries in a block: places before `end`, but those from `untimed` to `to`, of a source, and of a document."""

    def __init__(self, block: _Block, before: pa.Array, after: pa.Array, source: pa.Array, own: pa.Array):
        given = lambda x: x.is_valid().to_numpy(zero_copy_only=False)
        number = lambda x: x.fill_null(_NEVER).to_numpy(zero_copy_only=False)
        self.block, self.has_own, self.own = block, given(own), number(own)
        self.end = np.where(given(before), block.ts.searchsorted(np.maximum(number(before), _NEVER + 1)), len(block.ids))
        self.to = np.where(given(after), block.ts.searchsorted(number(after), "right"), 0)
        self.source = pc.index_in(source, value_set=block.sources).fill_null(-2).to_numpy(zero_copy_only=False)

    def has(self, who: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Whether the slice of each query has the document at a place."""
        ok = (where < self.end[who]) & ((where < self.block.untimed) | (where >= self.to[who])) & (self.block.source_of[where] != self.source[who])
        return ok & ~(self.has_own[who] & (self.block.ids[where] == self.own[who]))


    @cached_property
    def of_source(self) -> tuple[np.ndarray, np.ndarray]:
        """Places by source, and where each source's begin."""
        order = np.argsort(self.block.source_of, kind="stable")
        return order, np.searchsorted(self.block.source_of[order], np.arange(len(self.block.sources) + 1))

    @cached_property
    def of_own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places by document, and of each query the first and last of its own."""
        order = np.argsort(self.block.ids, kind="stable")
        ids = self.block.ids[order]
        return order, np.searchsorted(ids, self.own, "left"), np.where(self.has_own, np.searchsorted(ids, self.own, "right"), 0)

    def clear(self, i: int, sums: np.ndarray) -> None:
        """Sets to 0 the sums of documents, by place, that the slice of a query hasn't."""
        sums[self.block.untimed : self.to[i]] = 0
        if (j := self.source[i]) >= 0:
            order, start = self.of_source
            gone = order[start[j] : start[j + 1]]
            sums[gone[: gone.searchsorted(len(sums))]] = 0
        order, first, last = self.of_own
        for place in order[first[i] : last[i]]:
            if place < len(sums):
                sums[place] = 0


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e6 + 0.5) / 1e6


def _score(row: dict[str, pa.Scalar], block: _Block, kept: _Kept) -> None:
    """Adds to kept the documents of a block that are among the k best of the queries that meet it.

    All lists of a query are added up over the documents before its end; a query with k documents leaves out a block whose lists, by their
    most together, can't reach the k-th, and only documents that reach it are looked at any further.
    """
    q = row["q"].values
    terms, slices = q.field("terms"), block.slices(q)
    code = pc.index_in(terms.flatten(), value_set=row["terms"].values).fill_null(-1).to_numpy(zero_copy_only=False)
    who = np.repeat(np.arange(len(q)), terms.value_lengths().to_numpy(zero_copy_only=False))
    here = np.flatnonzero((code >= 0) & (slices.end[who] > 0))
    if not len(here):
        return
    who, code, idf = who[here], code[here].astype(np.int64), block.idf(q.field("dfs").flatten())[here]
    _, _, start, _, most = block.lists
    need = np.where(kept.least > 2 * SLACK, kept.least - SLACK, 0.0)
    here = np.flatnonzero((np.bincount(who, idf * most[code], len(q)) >= need)[who])
    who, code, idf = who[here], code[here], idf[here]
    if not len(who):
        return
    for who, where, score in _sums(block, slices, who, code, idf, need, kept.k):
        ok = slices.has(who, where)
        kept.add(who[ok], block.ids[where[ok]], _rounded(score[ok]))


def _sums(block: _Block, slices: _Slices, who: np.ndarray, code: np.ndarray, idf: np.ndarray, need: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, place, sum) of some HELD documents at a time: those of each query whose sum is its need or more; where that is 0, all that may be among its k best."""
    pos, _, start, value, _ = block.lists
    mine = np.flatnonzero(np.bincount(who, minlength=len(need)))
    row, rows = block.rows_for(code, idf), block.rows
    long = row >= 0
    row, ends_long = row[long].tolist(), np.searchsorted(who[long], mine, "right")
    # of short lists the part that stands before their query's end
    who, code, idf = who[~long], code[~long], idf[~long]
    n = np.searchsorted(block.keys, code * len(block.ids) + slices.end[who]) - start[code]
    ends = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(who, mine, "right")]
    got, held, last, done = [], 0, 0, 0
    for run in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(ends // SHORTS)) + 1):
        some = slice(done, done := int(np.searchsorted(who, mine[run[-1]], "right")))
        m = n[some]
        at = np.repeat(start[code[some]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        where, worth = pos[at].astype(np.int64), value[at] * np.repeat(idf[some], m)
        lo, base = 0, int(ends[run[-1]]) - len(at)
        for i, hi, stop, end, least in zip(*(x.tolist() for x in (mine[run], ends[run] - base, ends_long[run], slices.end[mine[run]], need[mine[run]])), strict=True):
            sums = np.bincount(where[lo:hi], worth[lo:hi], end) if hi > lo else np.zeros(end)
            for r in row[last:stop]:
                sums += rows[r][:end]
            lo, last = hi, stop
            if not least:
                slices.clear(i, sums)
                least = max(_least(sums, k) - SLACK, LEAST)
            found = (sums >= least).nonzero()[0]
            if len(found):
                got.append((i, found, sums[found]))
                held += len(found)
            if held >= HELD:
                yield _joined(got)
                got, held = [], 0
    if got:
        yield _joined(got)


def _joined(got: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    who, where, score = zip(*got, strict=True)
    return np.repeat(who, list(map(len, where))), np.concatenate(where), np.concatenate(score)


def _least(sums: np.ndarray, k: int) -> float:
    """A number that k of the sums or more reach, near the k-th; 0 if there are fewer sums."""
    if len(sums) <= k:
        return 0.0
    if len(sums) < 32 * k:
        return np.partition(sums, len(sums) - k)[len(sums) - k]
    # the greatest of each of 8 k equal parts belong to different documents
    n = len(sums) // (8 * k)
    most = sums[: n * 8 * k].reshape(n, 8 * k).max(axis=0)
    return np.partition(most, 7 * k)[7 * k]


def ranked(scored: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def phrase_search(phrases: DataFrame, told: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, phrase, doc_id, score, place): the k best documents that have a whole phrase, word for word, by BM25 of the phrase.

    phrases: (query_id, phrase, *SLICE), of which those of two words or more count; told: words(), index: its postings(). The different
    phrases go to the blocks, where each is looked up with all its words at once, first to count its documents, then for the k rows of
    each query; the documents that have a phrase aren't written out.
    Occurrences are counted without overlap.
    """
    p = phrases.withColumn("_w", tokens("phrase")).where(F.size("_w") >= 2).distinct()
    different = scratch.written(p.select("_w").distinct().withColumn("_p", F.monotonically_increasing_id()), "phrases")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            n = np.zeros(len(row["q"].values), np.int64)
            for which, _, _ in _occurrences(row):
                n += np.bincount(which, minlength=len(n))
            which = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([row["q"].values.field("_p").take(pa.array(which)), pa.array(n[which])], ["_p", "df"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _best_of_run(batches, k, _score_phrases, lambda q: q.field("asked").flatten(), ["query_id", "phrase"])

    df = scratch.written_singly(scratch.spread(told).crossJoin(F.broadcast(_chunks(different.select("_p", "_w"), PHRASES, "q"))).mapInArrow(counted, "_p long, df long").groupBy("_p").agg(F.sum("df").alias("df")), "phrase-df")
    asked = F.struct("query_id", "phrase", *[F.col(c) if c == "exclude_source" else F.col(c).cast("long").alias(c) for c in SLICE])
    q = scratch.written(p.join(different, "_w").groupBy("_p").agg(F.first("_w").alias("_w"), F.collect_list(asked).alias("asked")).join(df, "_p"), "phrases-asked")
    kinds = [phrases.schema["query_id"], phrases.schema["phrase"], T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]
    hits = _in_runs(told).crossJoin(F.broadcast(_chunks(q, PHRASES, "q").crossJoin(lengths(index)))).mapInArrow(best, T.StructType(kinds))
    return ranked(hits, k, "phrase")


def _score_phrases(row: dict[str, pa.Scalar], block: _Block, kept: _Kept) -> None:
    """Adds to kept the documents of a block that have a phrase, for each query that asks for it."""
    q = row["q"].values
    asked, idf = q.field("asked"), block.idf(q.field("df"))
    slices, many = block.slices(asked.flatten()), asked.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(many) - many
    for which, where, tf in _occurrences(row):
        score, n = _rounded(idf[which] * tf * (K1 + 1) / (tf + block.norm[where])), many[which]
        hit = np.repeat(np.arange(len(which)), n)
        who = np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ok = score[hit] >= kept.least[who]
        hit, who = hit[ok], who[ok]
        ok = slices.has(who, where[hit])
        kept.add(who[ok], block.ids[where[hit[ok]]], score[hit[ok]])


def _occurrences(row: dict[str, pa.Scalar]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(phrase's number, document's place in the block, occurrences): where a block has the phrases that meet it, some PIECE words at a time."""
    ws, mix = row["q"].values.field("_w"), np.uint64(0x9E3779B97F4A7C15)
    code = pc.index_in(ws.flatten(), value_set=row["terms"].values).fill_null(-1).to_numpy(zero_copy_only=False)
    sizes = ws.value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    short = lambda x: (x * mix) >> np.uint64(44)
    by = {}
    for size in np.unique(sizes).tolist():
        number = np.flatnonzero(sizes == size)
        ps = code[first[number][:, None] + np.arange(size)]
        number, ps = number[(ps >= 0).all(1)], ps[(ps >= 0).all(1)].astype(np.uint64)
        if not len(number):
            continue
        key = ps[:, 0]
        for j in range(1, size):
            key = key * mix + ps[:, j]
        seen = np.zeros(1 << 20, bool)
        seen[short(key)] = True
        by[size] = number, ps, key, np.argsort(key, kind="stable"), seen
    words, all_ends = np.frombuffer(row["at"].as_py(), "<i4"), np.cumsum(np.frombuffer(row["dl"].as_py(), "<i4"), dtype=np.int64)
    lo = 0
    while lo < len(all_ends):
        base = int(all_ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(all_ends, base + PIECE, "right")))
        at, ends = words[base : all_ends[hi - 1]].astype(np.uint64), all_ends[lo:hi] - base
        mixed = at
        for size in range(2, max(by, default=0) + 1):
            if size > len(at):
                break
            mixed = mixed[:-1] * mix + at[size - 1 :]
            if size not in by:
                continue
            number, ps, key, order, seen = by[size]
            place = np.flatnonzero(seen[short(mixed)])
            left = np.searchsorted(key, mixed[place], "left", sorter=order)
            times = np.searchsorted(key, mixed[place], "right", sorter=order) - left
            # phrases of one hash, should there be any, are all compared
            which = order[np.repeat(left - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            place = np.repeat(place, times)
            doc = np.searchsorted(ends, place, "right")
            same = place + size <= ends[doc]
            for j in range(size):
                same[same] = at[place[same] + j] == ps[which[same], j]
            which, doc, tf = _counted(which[same], doc[same], place[same], size, number, len(ends))
            yield which, doc + lo, tf
        lo = hi


def _counted(which: np.ndarray, doc: np.ndarray, place: np.ndarray, size: int, number: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of phrases of one size per phrase and document, without overlap."""
    key = which * docs + doc
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1]))
    keep = np.ones(len(key), bool)
    # only where one occurrence reaches into the next are they walked through
    for k in np.unique(key[1:][~new[1:] & (np.diff(place) < size)]):
        free = -1
        for i in range(np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")):
            keep[i] = place[i] >= free
            free = place[i] + size if keep[i] else free
    head = np.flatnonzero(new)
    return number[key[head] // docs], key[head] % docs, np.add.reduceat(keep.astype(np.int64), head) if len(head) else head


def rank_fusion(placements: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, doc_id, score, best_rank, retrievers, hits, place): reciprocal ranks of all placements, summed.

    placements: (query_id, doc_id, place from 1, retriever, hit): one row per retriever and asked text; hit is the fingerprint that was
    found, else null. Each placement gives 1 / (60 + place), a document with any hit 0.5 once. retrievers and hits are sorted.
    """
    g = placements.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (RRF_K + F.col("place"))).alias("s"), F.min("place").alias("best_rank"), F.sort_array(F.collect_set("retriever")).alias("retrievers"), F.sort_array(F.collect_set("hit")).alias("hits"))
    return ranked(g.select("query_id", "doc_id", F.round(F.col("s") + F.when(F.size("hits") > 0, FINGERPRINT_BONUS).otherwise(0.0), 6).alias("score"), "best_rank", "retrievers", "hits"), k)


def blocks(df: DataFrame, name: str, block: int, *by: str) -> DataFrame:
    """(*by, {name}_{column}...): arrays of about `block` rows that agree in `by`; rows without id or vector are left out."""
    df = df.where("id is not null and vec is not null")
    n = df.groupBy(*by).agg(F.ceil(F.count("*") / block).alias("_n"))
    rest = [c for c in df.columns if c not in by]
    with_n = df.join(F.broadcast(n), list(by)) if by else df.join(F.broadcast(n), F.lit(True))
    g = with_n.groupBy(*by, F.pmod(F.xxhash64("id"), "_n").alias("_block")).agg(F.collect_list(F.struct(*rest)).alias("r"))
    return g.select(*by, *[F.col(f"r.{c}").alias(f"{name}_{c}") for c in rest])


_HITS = T.ArrayType(T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]))
_EVER = 2**53


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 512) -> DataFrame:
    """(query_id, doc_id, score, place): of each query the k vectors of its slice with the largest dot product, itself aside.

    queries: (id, vec) and, where they are to be sliced, before, after, exclude_source; vectors: (id, vec) and then ts, source_id.
    Vectors are gathered in blocks of a quarter of a year, and meet only the blocks of queries whose slice reaches it; a
    task multiplies two blocks and keeps k rows per query, so pairs are never written out.
    """
    sliced = "ts" in vectors.columns
    never = lambda c: F.lit(None).cast(c)
    v = vectors.select("id", "vec", *(["ts", F.when(F.col("source_id").isNotNull(), F.xxhash64("source_id")).otherwise(1).alias("src")] if sliced else [F.lit(0).cast("long").alias("ts"), F.lit(1).cast("long").alias("src")])).where("ts is not null")
    v = v.withColumn("tb", F.floor(F.col("ts") / BUCKET))
    has = lambda c: F.col(c).cast("long") if sliced and c in queries.columns else never("long")
    # 0 excludes nothing, 1 is no source
    src = F.when(F.col("exclude_source").isNotNull(), F.xxhash64("exclude_source")).otherwise(0) if sliced and "exclude_source" in queries.columns else F.lit(0).cast("long")
    q = queries.select("id", "vec", F.coalesce(has("after"), F.lit(-_EVER)).alias("lo"), F.coalesce(has("before"), F.lit(_EVER)).alias("hi"), src.alias("src"))
    span = v.agg(F.min("tb").alias("first"), F.max("tb").alias("last"))
    q = q.join(F.broadcast(span), F.lit(True)).withColumn("from", F.greatest(F.floor(F.col("lo") / BUCKET), "first")).withColumn("to", F.least(F.floor(F.col("hi") / BUCKET), "last")).where(F.col("from") <= F.col("to")).drop("first", "last")

    @F.pandas_udf(_HITS)
    def best(qi: pd.Series, qv: pd.Series, lo: pd.Series, hi: pd.Series, qs: pd.Series, di: pd.Series, dv: pd.Series, dt: pd.Series, ds: pd.Series) -> pd.Series:
        out = []
        for a, x, l, h, s1, b, y, t, s2 in zip(qi, qv, lo, hi, qs, di, dv, dt, ds, strict=True):
            a, b, t = np.asarray(a), np.asarray(b), np.asarray(t)
            sims = np.stack(x).astype(np.float64) @ np.stack(y).astype(np.float64).T
            bad = (a[:, None] == b[None, :]) | (t[None, :] <= np.asarray(l)[:, None]) | (t[None, :] >= np.asarray(h)[:, None])
            s1, s2 = np.asarray(s1), np.asarray(s2)
            bad |= (s1 != 0)[:, None] & (s1[:, None] == s2[None, :])
            sims[bad] = -np.inf
            rows = []
            for i, s in zip(a, sims, strict=True):
                top = np.lexsort((b, -s))[:k] if len(s) <= 4 * k else (c := np.flatnonzero(s >= np.partition(s, -k)[-k]))[np.lexsort((b[c], -s[c]))][:k]
                rows += [(int(i), int(b[j]), float(s[j])) for j in top if np.isfinite(s[j])]
            out.append(rows)
        return pd.Series(out)

    qb = blocks(q, "q", block, "from", "to").withColumn("tb", F.explode(F.sequence("from", "to")))
    hits = qb.join(blocks(v, "d", block, "tb"), "tb").select(F.explode(best("q_id", "q_vec", "q_lo", "q_hi", "q_src", "d_id", "d_vec", "d_ts", "d_src")).alias("h")).select("h.*")
    return ranked(hits, k)


def distinct_queries(texts: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, n, text): the first `most` different texts of each query in order, letter case aside, from 0; the claim itself comes first.

    texts: (query_id, pos, text); blank and null texts fall out.
    """
    first = texts.where(F.trim("text") != "").groupBy("query_id", F.lower(F.trim("text")).alias("_k")).agg(F.min(F.struct("pos", "text")).alias("f"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("f.pos", "_k")) - 1
    return first.select("query_id", n.alias("n"), F.trim("f.text").alias("text")).where(F.col("n") < most)


def best_over_windows(fused: DataFrame, most: int = 14) -> DataFrame:
    """(query_id, doc_id, score, win, place): of each document its greatest fused score over a query's windows, the `most` best documents.

    fused: (query_id, win, doc_id, score); of equal scores the earlier window counts.
    """
    best = fused.groupBy("query_id", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "win")).alias("b"))
    return ranked(best.select("query_id", "doc_id", (-F.col("b.s")).alias("score"), F.col("b.win").alias("win")), most)
