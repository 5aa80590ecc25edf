"""Whole-batch text arithmetic in numpy: words, word runs, lines and their 64-bit hashes.

Every function works on a slice of an Arrow batch inside a Spark task. Texts are joined into one
array of code points; spans of it are hashed by prefix sums of a polynomial modulo 2**64, so a
batch costs a few passes over its characters whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
LETTER, DIGIT, UNSEEN = 1, 2, 4
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_RUN = 0xD6E8FEB86659FD93
#: fixed values: characters without a glyph (soft hyphen, zero-width space, joiners, marks, BOM)
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
#: characters handled at once; bounds the memory of a task whatever the size of its batch
CHUNK = 1 << 20
ROWS = 1023


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(1)
def classes() -> np.ndarray:
    """For each code point: LETTER, DIGIT (what else counts as alphanumeric) or UNSEEN."""
    chars = [chr(i) for i in range(0x110000)]
    letter = np.fromiter(map(str.isalpha, chars), bool, len(chars))
    alnum = np.fromiter(map(str.isalnum, chars), bool, len(chars))
    out = np.where(letter, LETTER, np.where(alnum, DIGIT, 0)).astype(np.uint8)
    out[[ord(c) for c in INVISIBLE]] = UNSEEN
    return out


@lru_cache(1)
def _values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def slices(texts: list, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` characters each; a longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and (size + n > limit or i - lo >= ROWS):
            yield lo, i
            lo, size = i, 0
        size += n + 1
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list, drop_unseen: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each followed by a line break, and where each text starts."""
    low = [(t or "").lower() for t in texts]
    if drop_unseen and any(c in t for t in low for c in INVISIBLE):
        table = dict.fromkeys(map(ord, INVISIBLE))
        low = [t.translate(table) for t in low]
    starts = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in low], out=starts[1:])
    data = "\n".join([*low, ""]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32), starts


def span_hashes(cp: np.ndarray, a: np.ndarray, b: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span [a, b); of its kept characters only, if `keep` is given."""
    pw, inv = powers(len(cp) + 1)
    v = _values()[cp]
    total = np.zeros(len(cp) + 1, np.uint64)
    if keep is None:
        np.cumsum(v * pw[:-1], out=total[1:])
        return mix((total[b] - total[a]) * inv[a])
    rank = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(keep, out=rank[1:])
    np.cumsum(np.where(keep, v * pw[rank[:-1]], U(0)), out=total[1:])
    return mix((total[b] - total[a]) * inv[rank[a]])


class Words:
    """The words of some texts: `hash` by word, `doc` the index of its text, `start`/`end` its characters."""

    def __init__(self, texts: list, drop_unseen: bool = False):
        self.cp, self.starts = code_points(texts, drop_unseen)
        self.kind = classes()[self.cp]
        edge = np.diff(np.concatenate(([0], ((self.kind & 3) != 0).view(np.int8), [0])))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = span_hashes(self.cp, self.start, self.end)
        self.first = np.searchsorted(self.start, self.starts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.cp[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")


def runs(word_hash: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words of a text, and the text of each."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * U(_RUN) + word_hash[j : j + n]
    same = doc[:n] == doc[k - 1 :]
    return mix(h[same]), doc[:n][same]


def run_sets(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of word runs of each of at most ROWS texts: 54-bit hashes sorted by text and value, and the text of each."""
    w = Words(texts)
    h, doc = runs(w.hash, w.doc, k)
    key = np.sort((doc.astype(np.uint64) << U(54)) | (h >> U(10)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & U((1 << 54) - 1), (key >> U(54)).astype(np.int64)


class Lines:
    """Lines of some texts: `doc`, `number` in its text, `start`/`end` in `cp`."""

    def __init__(self, texts: list):
        self.cp, self.starts = code_points(texts)
        self.kind = classes()[self.cp]
        self.end = np.flatnonzero(self.cp == 10)
        self.start = np.concatenate(([0], self.end[:-1] + 1)) if len(self.end) else self.end
        self.first = np.searchsorted(self.start, self.starts[:-1])
        bounds = np.append(self.first, len(self.start))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        self.number = np.arange(len(self.start)) - bounds[self.doc] if len(self.start) else self.start

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """How many characters of each line are in the mask."""
        total = np.zeros(len(self.cp) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.end] - total[self.start]
