"""Problem 9: subject areas of documents, by leaves of a bisecting k-means over passages.

A document is cut into passages (lines joined until they are long enough), each a small document of its own, so that a document on two
areas doesn't blur them. Normalised term vectors of a bounded sample's passages are clustered by bisecting
k-means; a leaf gets the subject that its discriminative terms stand for in the labelled documents, or none.
Every passage of the corpus is then a mixture of leaves, and a document the mixture of its passages by their letters.
The weights of terms use the labels too: without that, leaves follow language and style.
"""

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex import scratch
from chronolex.llm import sampling, textvec

#: fitting takes at most so many labelled documents
SAMPLE = 3000
LEAVES, LEAST = 160, 12
#: letters from which a passage is complete, and the least share of an area beside another one
PASSAGE, SHARE = 80, 0.25
#: how sharply a passage prefers its nearest leaves: the factor of the cosine in the exponent
SHARP = 25.0
#: log odds by which a term has to tell a subject
TELLING = 0.7


class _Passages:
    """The passages of some texts and their words: lines joined until they have PASSAGE letters.

    What is left at a text's end joins its last passage, or is one by itself, so that every letter lies in one.
    """

    def __init__(self, texts: list):
        w = textvec.Words([t or "" for t in texts])
        end = np.flatnonzero(w.cp == 10)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        total = np.zeros(len(w.cp) + 1, np.int64)
        np.cumsum(w.kind == textvec.LETTER, out=total[1:])
        letters = total[end] - total[start]
        bounds = np.searchsorted(start, w.starts)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        rest = total[w.starts[doc + 1]] - total[start] if len(doc) else letters
        opens, have, last = np.zeros(len(doc), bool), 0, -1
        for i, (d, n, r) in enumerate(zip(doc.tolist(), letters.tolist(), rest.tolist(), strict=True)):
            if d != last or have >= PASSAGE <= r:
                opens[i], have, last = True, 0, d
            have += n
        place = np.cumsum(opens) - 1
        self.hash, self.line = w.hash, place[np.searchsorted(end, w.start)]
        self.letters = np.bincount(place, weights=letters, minlength=int(opens.sum())).astype(np.int64)
        self.doc = doc[opens]

    def terms(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passage and term index of each word of the vocabulary."""
        if not len(vocabulary) or not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(vocabulary, self.hash), len(vocabulary) - 1)
        ok = vocabulary[at] == self.hash
        return self.line[ok], at[ok]


def _bisect(x: np.ndarray, leaves: int, least: int, seed: int = 5) -> np.ndarray:
    """Leaf of each row of x (unit rows): the widest cluster is split in two until there are enough."""
    rng = np.random.default_rng(seed)
    leaf = np.zeros(len(x), np.int64)

    def spread(rows):
        return len(rows) - np.linalg.norm(x[rows].sum(0)) if len(rows) >= 2 * least else 0.0

    width = {0: spread(np.arange(len(x)))}
    while len(width) < leaves and max(width.values()) > 0:
        k = max(width, key=width.get)
        rows = np.flatnonzero(leaf == k)
        y = x[rows]
        best = None
        for _ in range(2):
            c = y[rng.choice(len(y), 2, replace=False)]
            side = None
            for _ in range(12):
                new = (y @ (c[0] - c[1])) < 0
                if side is not None and (new == side).all() or new.all() or not new.any():
                    side = new
                    break
                side = new
                c = np.stack([y[~side].sum(0), y[side].sum(0)])
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
            if min(side.sum(), (~side).sum()) >= least:
                gain = np.linalg.norm(y[side].sum(0)) + np.linalg.norm(y[~side].sum(0))
                if best is None or gain > best[0]:
                    best = (gain, side)
        if best is None:
            width[k] = 0.0
            continue
        new = max(width) + 1
        leaf[rows[best[1]]] = new
        width[k], width[new] = spread(rows[~best[1]]), spread(rows[best[1]])
    return leaf


class SubjectModel:
    """vocabulary, idf, unit centroids by leaf, and each leaf's subject (-1: none)."""

    def __init__(self, **parts: np.ndarray):
        self.vocabulary, self.idf, self.centroids, self.subject = (parts[k] for k in ("vocabulary", "idf", "centroids", "subject"))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vocabulary=self.vocabulary, idf=self.idf, centroids=self.centroids, subject=self.subject)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> "SubjectModel":
        return SubjectModel(**np.load(io.BytesIO(data)))

    @staticmethod
    def fit(texts: list, labels: np.ndarray, n_subjects: int, leaves: int = LEAVES, least: int = LEAST) -> "SubjectModel":
        """labels: a subject's index for each text."""
        p = _Passages(texts)
        doc = p.doc[p.line]
        seen = np.unique(np.stack([p.hash, doc.astype(np.uint64)]), axis=1)
        words, df = np.unique(seen[0], return_counts=True)
        keep = (df >= max(6, 0.002 * len(texts))) & (df <= 0.25 * len(texts))
        vocabulary, df = words[keep], df[keep]
        idf = np.log(len(texts) / df).astype(np.float32)
        line, term = p.terms(vocabulary)
        x = np.zeros((len(p.letters), len(vocabulary)), np.float32)
        np.add.at(x, (line, term), 1)
        has = np.minimum(x, 1)
        # how strongly each term tells each subject: log odds of its passages' labels
        lab = labels[p.doc]
        n = np.stack([has[lab == s].sum(0) for s in range(n_subjects)])
        size = np.bincount(lab, minlength=n_subjects)[:, None]
        tell = np.log((n + 0.5) / (size + 1)) - np.log((n.sum(0) - n + 0.5) / (size.sum() - size + 1))
        # terms that tell no subject would cluster passages by language or style
        idf = idf * np.maximum(tell.max(0) - TELLING, 0).astype(np.float32) if len(x) else idf
        np.log1p(x, out=x)
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        leaf = _bisect(x, leaves, least)
        kinds = np.unique(leaf)
        centroids = np.zeros((len(kinds), len(vocabulary)), np.float32)
        subject = np.full(len(kinds), -1)
        every = has.mean(0) if len(has) else has.sum(0)
        for k, kind in enumerate(kinds):
            rows = leaf == kind
            c = x[rows].sum(0)
            centroids[k] = c / max(np.linalg.norm(c), 1e-9)
            rate = has[rows].mean(0)
            # discriminative terms: common in the leaf, rarer outside, weighted by how much they tell it
            gain = rate * np.log((rate + 1e-3) / (every + 1e-3))
            top = np.argsort(-gain, kind="stable")[:25]
            evidence = (tell[:, top] * np.maximum(gain[top], 0)).sum(1) / max(np.maximum(gain[top], 0).sum(), 1e-9)
            if len(top) and evidence.max() > 0.7:
                subject[k] = evidence.argmax()
        return SubjectModel(vocabulary=vocabulary, idf=idf, centroids=centroids, subject=subject)

    def shares(self, texts: list, n_subjects: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text by subject (the last column: by none), as shares of its passages.

        A passage belongs to every leaf that it shares a term with, by the exponential of SHARP times their cosine.
        """
        p = _Passages(texts)
        out = np.zeros((len(texts), n_subjects + 1))
        line, term = p.terms(self.vocabulary)
        told = np.zeros((len(p.letters), n_subjects + 1), np.float32)
        if len(line) and len(self.centroids):
            key = line * len(self.vocabulary) + term
            key, times = np.unique(key, return_counts=True)
            line, term = key // len(self.vocabulary), key % len(self.vocabulary)
            weight = (np.log1p(times) * self.idf[term]).astype(np.float32)
            head = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            length = np.sqrt(np.add.reduceat(weight**2, head))
            rows = self.centroids.T[term]
            rows *= weight[:, None]
            cosine = np.add.reduceat(rows, head, axis=0) / np.maximum(length, 1e-9)[:, None]
            near = np.exp(SHARP * (cosine - cosine.max(1, keepdims=True)))
            near[cosine <= 0] = 0
            near /= np.maximum(near.sum(1, keepdims=True), 1e-9)
            leaf_of = np.zeros((len(self.subject), n_subjects + 1), np.float32)
            leaf_of[np.arange(len(self.subject)), np.where(self.subject < 0, n_subjects, self.subject)] = 1
            told[line[head]] = near @ leaf_of
        told[:, n_subjects] += 1 - told.sum(1)
        np.add.at(out, p.doc, told * p.letters[:, None])
        return out / np.maximum(out.sum(1, keepdims=True), 1), p.letters


def train(docs: DataFrame, labels: DataFrame, subjects: list[str], sample: int = SAMPLE) -> bytes:
    """A model fitted in one task to at most `sample` labelled documents, taken by hash.

    Labels are compared in lower case; unknown and null ones don't count, and a document labelled more than
    once has its most frequent label (the first in order if equally frequent). Labels may be wrong.
    """
    known = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(subjects))
    votes = known.groupBy("doc_id", "subject").count().groupBy("doc_id").agg(F.max_by("subject", F.struct("count", "subject")).alias("subject"))
    votes = scratch.written(sampling.bounded(votes, sample, "doc_id", n=votes.count()), "labelled")
    # the sample's labels, at most `sample` of them, travel to the texts
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(votes), "doc_id")

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in parts if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values("doc_id")
        model = SubjectModel.fit(pdf["text"].tolist(), pdf["subject"].map(subjects.index).to_numpy(), len(subjects))
        yield pd.DataFrame({"model": [model.dump()]})

    chosen = scratch.written(rows, "sample")
    found = chosen.coalesce(1).mapInPandas(fit, "model binary").collect()
    scratch.drop(chosen)
    scratch.drop(votes)
    return bytes(found[0].model) if found else SubjectModel.fit([], np.zeros(0, np.int64), len(subjects)).dump()


def document_subjects(docs: DataFrame, model: bytes, subjects: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, subject, share): the one or two areas of each document, and their shares of its passages.

    An area counts if it has the largest share, or a share of at least SHARE beside a larger one. Null and empty
    texts and documents whose leaves stand for no subject have no rows. The model (vocabulary x
    leaves) is the only broadcast; one pass without a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = SubjectModel.load(sent.value)
        names = np.array(subjects, object)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo, hi in textvec.slices(texts):
                share, _ = m.shares(texts[lo:hi], len(subjects))
                order = np.argsort(-share[:, :-1], axis=1, kind="stable")[:, :2]
                top = np.take_along_axis(share, order, 1)
                first = top[:, 0] >= SHARE
                second = first & (top[:, 1] >= SHARE)
                for on, k in ((first, 0), (second, 1)):
                    d = np.flatnonzero(on)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + d]), pa.array(names[order[d, k]], pa.string()), pa.array(top[d, k])], ["doc_id", "subject", "share"])

    return scratch.spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")).mapInArrow(assign, "doc_id long, subject string, share double")


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    subjects = sorted(r.subject for r in spark.read.parquet(f"{sf}/subjects.parquet").select("subject").distinct().collect())
    return document_subjects(docs, train(docs, spark.read.parquet(f"{sf}/subject_labels.parquet"), subjects), subjects)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and summed shares by subject."""
    return _assigned(spark, sf).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("share").alias("weight"))
