"""Problem 6: lines that stand in many documents of one source, found through compressed bitmaps."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex import scratch
from chronolex.llm import textvec

#: a container holds the documents whose ids agree in all but their low 16 bits
CONTAINER = 16
#: up to so many documents a container is a sorted list of low halves, beyond it a bit set of 8 KB
SPARSE = 4096

_SCHEMA = "source_id string, line_key long, container long, turn int, n int, bitmap binary, lines binary"


def pack(low: np.ndarray) -> bytes:
    """A container from sorted distinct low halves: the shorter of a list and a bit set."""
    if len(low) <= SPARSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << CONTAINER, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    if n <= SPARSE:
        return np.frombuffer(data, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).astype("<u2")


def _line_keys(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the lines with letters: text index, line number, and a hash of the line's lower-case letters."""
    lines = textvec.Lines(texts)
    letter = lines.kind == textvec.LETTER
    has = lines.counts(letter) > 0
    key = textvec.span_hashes(lines.cp, lines.start[has], lines.end[has], letter)
    return lines.doc[has], lines.number[has], key.view(np.int64)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of one batch of documents, and for each document in one the number of its line."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        codes = batch.column(1).dictionary_encode()
        source, names = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary
        texts = batch.column(2).to_pylist()
        found = [(d + lo, n, k) for lo, hi in textvec.slices(texts) for d, n, k in [_line_keys(texts[lo:hi])]]
        if not found:
            continue
        doc, line, key = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((line, ids[doc], key, source[doc]))
        src, line, key, ident = source[doc][order], line[order], key[order], ids[doc][order]
        turn = _turns(src, key, ident)  # a line that a document has twice has a second bitmap for it
        order = np.lexsort((ident, turn, ident >> CONTAINER, key, src))
        src, line, key, ident, turn = (x[order] for x in (src, line, key, ident, turn))
        box, low = ident >> CONTAINER, (ident & ((1 << CONTAINER) - 1)).astype("<u2")
        first = np.flatnonzero(_changes(src, key, box, turn))
        ends = np.append(first, len(src))
        n = np.diff(ends)
        if (n > SPARSE).any():
            data = pa.array([pack(low[a : a + c]) for a, c in zip(first, n, strict=True)], pa.binary())
        else:  # the lists lie one after the other already
            data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * 2).astype(np.int32).tobytes()), pa.py_buffer(low.tobytes())])
        at = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(line.astype("<u4").tobytes())])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(src[first])), *map(pa.array, (key[first], box[first], turn[first].astype(np.int32), n.astype(np.int32))), data, at], ["source_id", "line_key", "container", "turn", "n", "bitmap", "lines"])


def _changes(*cols: np.ndarray) -> np.ndarray:
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return new


def _turns(*cols: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal rows."""
    new = _changes(*cols)
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def line_bitmaps(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(source_id, line_key, container, turn, n, bitmap, lines): which documents hold a line, by batch of documents.

    Lines are the same if they agree in lower case in their letters; lines without letters and rows
    without source, id or text are left out. Variants of a line fall on one key, so their documents are
    united in the batch, before any shuffle: a line of a third of all documents makes one row per batch
    and container. turn: the bitmap of 0 has the documents, 1 those that have the line once more, ...
    """
    return scratch.spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source_id"), F.col(text_col).alias("text")).where("id is not null and source_id is not null and text is not null")).mapInArrow(_bitmaps, _SCHEMA)


@F.pandas_udf(T.IntegerType())
def _cardinality(parts: pd.Series) -> pd.Series:
    """Documents in the union of a container's bitmaps."""
    return pd.Series([int(p[0]["n"]) if len(p) == 1 else len(np.unique(np.concatenate([unpack(x["bitmap"], x["n"]) for x in p]))) for p in parts], dtype="int32")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Looks the documents and line numbers up in bitmaps."""
    for batch in batches:
        n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        low = [unpack(b, k) for b, k in zip(batch.column(2).to_pylist(), n, strict=True)]
        line = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4")
        if len(line):
            ids = (np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n) << CONTAINER) + np.concatenate(low)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(line.astype(np.int32))], ["doc_id", "line_no"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source_id", text_col: str = "text", min_documents: int = 6) -> DataFrame:
    """(doc_id, line_no) of each line that stands in at least min_documents different documents of its source.

    Documents without id, source or text have no rows; rows of one id count as one document (their
    rows are given once for each copy of a line). An empty table gives an empty one.

    The bitmaps are counted with map-side combining; only containers of lines whose counts can reach
    the threshold are united (at most 65,536 documents each) for the exact cardinality. No text is
    shuffled and nothing is broadcast unless the adaptive planner finds it small.
    """
    return scratch.settled(lambda: _repeated(docs, id_col, source_col, text_col, min_documents), "repeated-lines")


def _repeated(docs: DataFrame, id_col: str, source_col: str, text_col: str, min_documents: int) -> DataFrame:
    maps = scratch.written(line_bitmaps(docs, id_col, source_col, text_col), "bitmaps")
    by = ["source_id", "line_key"]
    often = maps.where("turn = 0").groupBy(*by).agg(F.sum("n").alias("n")).where(F.col("n") >= min_documents).select(*by)
    some = scratch.written(maps.join(often, by, "left_semi"), "repeated")
    boxes = some.where("turn = 0").groupBy(*by, "container").agg(F.collect_list(F.struct("n", "bitmap")).alias("parts"))
    cases = boxes.select(*by, _cardinality("parts").alias("n")).groupBy(*by).agg(F.sum("n").alias("n")).where(F.col("n") >= min_documents).select(*by)
    return some.join(cases, by, "left_semi").select("container", "n", "bitmap", "lines").mapInArrow(_rows, "doc_id long, line_no int")


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines whose bits are set; a text without such lines comes as it is."""
    out = []
    for text, lines in zip(texts, gone, strict=True):
        if text is None or lines is None:
            out.append(text)
            continue
        own = text.split("\n")
        bits = np.zeros(len(own), bool)
        lines = np.asarray(lines)
        bits[lines[lines < len(own)]] = True
        out.append("\n".join(x for x, off in zip(own, bits, strict=True) if not off))
    return pd.Series(out, dtype=object)


def without_lines(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the given (doc_id, line_no) lines taken out of their text; all columns stay, null texts stay null.

    The lines of a document meet it as one row and are looked up as the bits of a map of its lines.
    """
    gone = lines.groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", "_gone_id")
    met = docs.join(gone, F.col(id_col) == F.col("_gone_id"), "left")
    return met.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(_cut(F.col(text_col), F.col("_gone")))).drop("_gone", "_gone_id")


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, chars, text_md5) of every document after its source's repeated lines are taken out."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source_id", "text")
    return without_lines(docs, repeated_lines(docs)).select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source_id", "text"))


P6_SQL = r"""
WITH lines AS (SELECT doc_id, source_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE source_id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT doc_id, source_id, line_no, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS key FROM lines),
often AS (SELECT source_id, key FROM k WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 6)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN often USING (source_id, key)
"""

P6_CLEAN_SQL = P6_SQL.split("SELECT doc_id, CAST(line_no AS INTEGER)")[0] + """, gone AS (SELECT DISTINCT doc_id, line_no FROM k JOIN often USING (source_id, key)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS t FROM lines l LEFT JOIN gone USING (doc_id, line_no) WHERE gone.line_no IS NULL GROUP BY 1), out AS (SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.source_id IS NULL THEN d.text ELSE coalesce(kept.t, '') END AS t FROM documents d LEFT JOIN kept USING (doc_id))
SELECT doc_id, length(t) AS chars, md5(t) AS text_md5 FROM out"""
