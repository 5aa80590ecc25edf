"""Problem 5: languages of documents and of their lines, by naive Bayes over hashed character n-grams."""

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex import scratch
from chronolex.llm import sampling, textvec

#: fixed values: how labels name the languages
NAMES = {"en": "en eng english", "fr": "fr fra fre french", "de": "de deu ger german", "es": "es spa spanish", "pt": "pt por portuguese"}
ORDERS = (3, 4)
FEATURES = 1 << 16
#: training takes at most so many labelled documents of each language
SAMPLE = 1500
#: log odds are divided by this for the confidence, as neighbouring n-grams aren't independent
TEMPERATURE = 12.0
#: the code of a text in none of the languages, whose n-grams are on average less likely than its language's by so much in the logarithm
UNKNOWN, MARGIN = "und", 2.0
#: a cell of so many words, two of them no names by their case, is prose and not a cell of a table
PROSE = 5


@lru_cache(1)
def _lower() -> np.ndarray:
    """Lower-case code points; for what isn't a letter a space."""
    out = np.full(0x110000, 32, np.uint32)
    letters = np.flatnonzero(textvec.classes() == textvec.LETTER)
    out[letters] = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in letters.tolist()]
    return out


class Model(NamedTuple):
    """table: log-probability of each n-gram by language, less their mean; base: that mean; floor: the mean log-probability of an
    n-gram below which a text is in none of the languages, by language."""

    table: np.ndarray
    base: np.ndarray
    floor: np.ndarray


class _Text:
    """Lines of some texts with the n-gram features that start at each character (-1: none)."""

    def __init__(self, texts: list):
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t or "") + 1 for t in texts], out=starts[1:])
        self.raw = np.frombuffer("\n".join([*[t or "" for t in texts], ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.low = _lower()[self.raw]
        self.end = np.flatnonzero(self.raw == 10)
        self.start = np.concatenate(([0], self.end[:-1] + 1)) if len(self.end) else self.end
        bounds = np.append(np.searchsorted(self.start, starts[:-1]), len(self.start))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        self.number = np.arange(len(self.start)) - bounds[self.doc] if len(self.start) else self.start
        self.letters = self.count(self.low != 32)

    def count(self, mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.end] - total[self.start]

    def features(self, n: int) -> np.ndarray:
        low = self.low.astype(np.uint32)
        size = len(low) - n + 1
        if size <= 0:
            return np.full(len(low), -1)
        h = np.full(size, n, np.uint32)
        gaps = np.zeros(size, np.int8)
        for j in range(n):
            h = (h ^ low[j : j + size]) * np.uint32(0x01000193)
            gaps += low[j : j + size] == 32
        h ^= h >> np.uint32(15)
        out = (h & np.uint32(FEATURES - 1)).astype(np.int64)
        out[gaps > 1] = -1  # at most one border of a word
        return np.concatenate((out, np.full(n - 1, -1)))

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Log-probability sums of each line, a column for each language."""
        out = np.zeros((len(self.start), len(table)))
        padded = np.concatenate((table, np.zeros((len(table), 1), table.dtype)), axis=1)
        total = np.zeros(len(self.raw) + 1)
        for n in ORDERS:
            f = self.features(n)
            for k, row in enumerate(padded):
                np.cumsum(row[f], out=total[1:])
                out[:, k] += total[self.end] - total[self.start]
        return out

    def level(self, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the base over the n-grams of each line, and their number."""
        out, count = np.zeros(len(self.start)), np.zeros(len(self.start))
        padded, total = np.append(base, 0), np.zeros(len(self.raw) + 1)
        for n in ORDERS:
            f = self.features(n)
            np.cumsum(padded[f], out=total[1:])
            out += total[self.end] - total[self.start]
            count += self.count(f >= 0)
        return out, count

    def wordless(self) -> np.ndarray:
        """Lines that have no language: rows of tables, program code, lists of names."""
        raw = self.raw
        signs = self.count(np.isin(raw, np.frombuffer("_{}=<>()[];#*/\\".encode("utf-32-le"), np.uint32)))
        first = np.concatenate(([True], self.low[:-1] == 32)) & (self.low != 32)
        words = self.count(first)
        upper = self.raw != self.low
        capital = self.count(first & upper)
        caps = self.count(upper & (self.low != 32))
        names = (capital > 0.75 * words) & (caps < 0.6 * self.letters)
        # in lines of capitals, case tells nothing
        loud = np.repeat(caps >= 0.6 * self.letters, self.end - self.start + 1)
        return self.rows(first, first & (~upper | loud)) | (signs > 0.06 * np.maximum(self.letters, 1)) & (signs >= 3) | names & (words >= 3)

    def rows(self, first: np.ndarray, small: np.ndarray) -> np.ndarray:
        """Rows of tables: lines with two bars or tabs that begin and end with a bar, or none of whose cells is prose.

        first: where words begin; small: where those do whose case makes them no names.
        """
        raw = self.raw
        cell = np.flatnonzero((raw == 124) | (raw == 9) | (raw == 10))
        line = np.searchsorted(self.end, cell)
        within = lambda mask: np.diff(np.cumsum(mask)[cell], prepend=0)
        prose = np.zeros(len(self.end), bool)
        prose[line[(within(first) >= PROSE) & (within(small) >= 2)]] = True
        ink = np.flatnonzero((raw != 32) & (raw != 10) & (raw != 13))
        at = np.searchsorted(ink, self.start), np.searchsorted(ink, self.end) - 1
        some = at[0] <= at[1]
        framed = np.zeros(len(self.end), bool)
        framed[some] = (raw[ink[at[0][some]]] == 124) & (raw[ink[at[1][some]]] == 124)
        bars = np.bincount(line, minlength=len(self.end)) - 1
        return (bars >= 2) & (framed | ~prose)


_OUT = ["doc_id", "line_no", "lang", "confidence"]


def labelled(docs: DataFrame, label_col: str, languages: tuple[str, ...]) -> DataFrame:
    """docs with `language`: the code that a label's part before - or _ stands for, else null."""
    head = F.lower(F.trim(F.split(F.col(label_col), "[-_]")[0]))
    out = F.lit(None).cast("string")
    for code in languages:
        out = F.when(head.isin(NAMES.get(code, code).split()), code).otherwise(out)
    return docs.withColumn("language", out)


def _counter(languages: tuple[str, ...], table: np.ndarray | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), FEATURES), np.int64)
        for batch in batches:
            labels = np.array([languages.index(x) for x in batch.column(0).to_pylist()])
            texts = batch.column(1).to_pylist()
            for lo, hi in textvec.slices(texts):
                t = _Text(texts[lo:hi])
                lang = labels[lo:hi][t.doc]
                use = ~t.wordless() & (t.letters >= 20)
                if table is not None:
                    use &= t.scores(table).argmax(1) == lang
                for n in ORDERS:
                    f = t.features(n)
                    line = np.repeat(np.arange(len(t.start)), t.end - t.start + 1)
                    on = (f >= 0) & use[line]
                    total += np.bincount(lang[line[on]] * FEATURES + f[on], minlength=total.size).reshape(total.shape)
        k, f = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), pa.array(total[k, f])], ["language", "feature", "n"])

    return count


def _leveller(languages: tuple[str, ...], table: np.ndarray, base: np.ndarray):
    """Number and sum, by language, of the mean log-probabilities of the texts' n-grams."""

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(languages)))
        for batch in batches:
            labels = np.array([languages.index(x) for x in batch.column(0).to_pylist()])
            texts = batch.column(1).to_pylist()
            for lo, hi in textvec.slices(texts):
                t = _Text(texts[lo:hi])
                lang = labels[lo:hi][t.doc]
                scores = t.scores(table)
                use = ~t.wordless() & (t.letters >= 20) & (scores.argmax(1) == lang)
                low, count = t.level(base)
                sums = np.bincount(t.doc[use], weights=(low + scores[np.arange(len(lang)), lang])[use], minlength=hi - lo)
                n = np.bincount(t.doc[use], weights=count[use], minlength=hi - lo)
                on = n >= 100
                mean = sums[on] / n[on]
                for k, x in enumerate((np.ones(on.sum()), mean)):
                    total[k] += np.bincount(labels[lo:hi][on], weights=x, minlength=len(languages))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(languages))), *map(pa.array, total)], ["language", "n", "s"])

    return level


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", languages: tuple[str, ...] = tuple(NAMES), sample: int = SAMPLE, rounds: int = 2) -> Model:
    """The model of labelled documents: a log-probability matrix (languages x FEATURES), its mean, and floors.

    At most `sample` documents of each language, taken by hash. Labels may be wrong: after
    the first round only the lines count that the model so far gives the language of their document.
    """
    rows = labelled(docs, label_col, languages).where(F.col("language").isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), "language", F.col(text_col).alias("text"))
    # one scan of the labels, and one of the texts, for all languages
    counts = {r["language"]: r["count"] for r in labelled(docs, label_col, languages).where("language is not null").groupBy("language").count().collect()}
    chosen = scratch.written(sampling.bounded_by(rows, sample, "language", counts, "doc_id").select("language", "text"), "sample")
    table = None
    for _ in range(rounds):
        found = chosen.mapInArrow(_counter(languages, table), "language long, feature long, n long").groupBy("language", "feature").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(languages), FEATURES))
        counts[found["language"], found["feature"]] = found["n"]
        counts += 0.5
        table = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
        base = table.mean(0)
        table -= base
    level = chosen.mapInArrow(_leveller(languages, table, base), "language long, n double, s double").groupBy("language").agg(*[F.sum(c).alias(c) for c in "ns"]).toPandas().sort_values("language")
    n, s = (level[c].to_numpy() if len(level) == len(languages) else np.zeros(len(languages)) for c in "ns")
    floor = np.where(n > 0, s / np.maximum(n, 1) - MARGIN, -np.inf)
    scratch.drop(chosen)
    return Model(table, base, floor)


def language_lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, languages: tuple[str, ...] = tuple(NAMES), min_letters: int = 100, min_line: int = 60) -> DataFrame:
    """(doc_id, line_no, lang, confidence): the language of each document (line_no -1) and of its foreign lines.

    A document's language is that of most of its letters; documents with fewer than min_letters letters and
    null texts have no rows. A line of min_line letters or more has a row if its language is another one.
    Tables, lists of names and program code have none. confidence: for a document, the probability of a letter of its prose to be in
    the language, for a line, that of its language; both tempered, with equal priors, so that a rare language isn't swallowed.
    A document whose n-grams are far less likely than those of its language's training texts is in none of the languages: it has
    the language UNKNOWN, confidence 0, and no lines. carry: a column that comes along as `carry`.
    The model is the only broadcast (languages x FEATURES floats); one pass without a shuffle.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, UNKNOWN])
        table, base, floor = sent.value
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo, hi in textvec.slices(texts):
                t = _Text(texts[lo:hi])
                n = hi - lo
                scores = t.scores(table)
                lang = scores.argmax(1)
                spoken = ~t.wordless()
                weight = np.where(spoken, t.letters, 0)
                share = np.zeros((n, len(languages)))
                np.add.at(share, (t.doc, lang), weight)
                total = np.bincount(t.doc, weights=t.letters, minlength=n)
                has = (total >= min_letters) & (share.sum(1) > 0)
                main = share.argmax(1)
                low, count = t.level(base)
                own = main[t.doc]
                grams = np.bincount(t.doc, weights=np.where(spoken, count, 0), minlength=n)
                mean = np.bincount(t.doc, weights=np.where(spoken, low + scores[np.arange(len(own)), lang], 0), minlength=n) / np.maximum(grams, 1)
                strange = has & (grams >= 100) & (mean < floor[main])
                d = np.flatnonzero(has)
                odds = scores / TEMPERATURE
                odds = np.exp(odds - odds.max(1, keepdims=True)) if len(odds) else odds
                odds /= np.maximum(odds.sum(1, keepdims=True), 1e-9)
                sure = np.bincount(t.doc, weights=weight * odds[np.arange(len(own)), own], minlength=n) / np.maximum(share.sum(1), 1)
                foreign = np.flatnonzero(spoken & (t.letters >= min_line) & (has & ~strange)[t.doc] & (lang != own))
                told = np.where(strange[d], len(languages), main[d])
                rows = np.concatenate((d, t.doc[foreign]))
                out = [pa.array(ids[lo + rows]), pa.array(np.concatenate((np.full(len(d), -1), t.number[foreign])).astype(np.int32)), pa.array(np.concatenate((names[told], names[lang[foreign]])).astype(object), pa.string()), pa.array(np.concatenate((np.where(strange[d], 0.0, sure[d]), odds[foreign, lang[foreign]])))]
                yield pa.RecordBatch.from_arrays([*out, *([batch.column(2).take(pa.array(lo + rows))] if carry else [])], _OUT + ["carry"] * bool(carry))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(carry).cast("string").alias("carry")] if carry else [])).where("doc_id is not null and text is not null")
    return scratch.spread(rows).mapInArrow(lines, "doc_id long, line_no int, lang string, confidence double" + ", carry string" * bool(carry))


def _all(spark: SparkSession, sf: str) -> DataFrame:
    """language_lines() of all documents, with their labels."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    return language_lines(docs, train(docs), carry="lang")


def p5_languages(spark: SparkSession, sf: str) -> DataFrame:
    return _all(spark, sf).drop("carry")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of documents whose label says otherwise, and of lines in another language than their document."""
    told = F.lower(F.split("carry", "[-_]")[0])
    return _all(spark, sf).where(F.col("lang") != UNKNOWN).where((F.col("line_no") >= 0) | told.isNull() | (told != F.col("lang"))).select("doc_id", "line_no", "lang")
