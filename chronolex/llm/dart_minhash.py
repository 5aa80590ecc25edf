"""Sparse weighted signatures from hashed darts, and bands of them.

Darts fall as a Poisson process of intensity one over (element, weight, rank); a dart is known from
the hash of its element and cell alone, so two texts see the same darts where their weights reach.
A text takes the darts inside its element regions, below a rank of about t over its total weight; each
dart belongs to one coordinate, and a coordinate keeps its earliest. Two texts keep the same dart
with the probability of their weighted Jaccard similarity. Work is the number of darts, not elements
times coordinates.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from chronolex.llm.textvec import U, mix

#: rank levels: cells are [0, 1/16), then doubling
FIRST_LEVEL = 1 / 16


@lru_cache(64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative Poisson probabilities as fractions of 2**64, to invert by search."""
    out, p, total, k = [], math.exp(-mean), 0.0, 0
    while total < 1 - 1e-15 and k < mean + 40 * math.sqrt(mean + 1):
        total += p
        out.append(min(total, 1.0))
        k += 1
        p *= mean / k
    return np.array(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, k: int, seed: int = 1) -> np.ndarray:
    """docs x k array of dart ids (uint32 of the dart's hash, in the low half; rank in the high half).

    element, doc, weight: parallel arrays of the sparse weighted sets; weights of zero or less fall out.
    A row of a text without weight is all ones (no signature).
    """
    top = np.iinfo(np.uint64).max
    sig = np.full(docs * k, top, np.uint64)
    ok = weight > 0
    element, doc, weight = element[ok], doc[ok], weight[ok]
    total = np.bincount(doc, weights=weight, minlength=docs)
    has = total > 0
    need = k * math.log(k) + 2 * k
    theta = np.where(has, need / np.where(has, total, 1), 0.0)
    element = mix(element ^ mix(np.full(1, seed, np.uint64)))
    low = np.zeros(docs)
    while True:
        _throw(sig, element, doc, weight, low, theta, k)
        empty = (sig.reshape(docs, k) == top).any(1) & has
        if not empty.any():
            return sig.reshape(docs, k)
        again = empty[doc]
        element, doc, weight = element[again], doc[again], weight[again]
        low = np.where(empty, theta, np.inf)
        theta = np.where(empty, theta * 2, 0.0)


def _throw(sig, element, doc, weight, low, theta, k):
    """Lowers sig by the darts of rank in [low, theta) of each text."""
    level, a, b = 0, 0.0, FIRST_LEVEL
    while (reach := theta > a).any():
        for slab in range(math.ceil(weight.max()) if len(weight) else 0):
            on = np.flatnonzero(reach[doc] & (low[doc] < b) & (weight > slab))
            if len(on):
                cell = mix(element[on] + U((slab * 4099 + level * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                count = np.searchsorted(_poisson(b - a), _unit(cell), side="right")
                at = np.repeat(np.arange(len(on)), count)
                turn = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                dart = mix(cell[at] + turn.astype(np.uint64) * U(0xD1B54A32D192ED03) + U(1))
                other = mix(dart)
                rank = a + (b - a) * _unit(dart)
                d = doc[on[at]]
                hit = (rank < theta[d]) & (rank >= low[d])
                if (weight[on] < slab + 1).any():
                    hit &= slab + _unit(mix(other)) < weight[on[at]]
                d, rank, other = d[hit], rank[hit], other[hit]
                # positive floats of one sign order as their bits do
                packed = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | (other >> U(32))
                np.minimum.at(sig, d * k + (other & U(0xFFFFFFFF)).astype(np.int64) % k, packed)
        level, a, b = level + 1, b, b * 2


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """docs x (k // rows) int64 keys: the hash of each group of `rows` coordinates and of its place."""
    n = sig.shape[1] // rows
    key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), (len(sig), n)).copy()
    for r in range(rows):
        key = mix(key ^ sig[:, r : n * rows : rows] * U(0x9E3779B97F4A7C15))
    return key.view(np.int64)
