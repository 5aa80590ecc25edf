"""The corpus's plain MinHash: 64 hashes of six-word shingles, for texts with at least 20 of them."""

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex import scratch

HASHES, WORDS, LEAST = 64, 6, 20
#: texts hashed at once
ROWS = 512
_WORD = re.compile(r"[A-Za-z][A-Za-z'-]+")


def seeds() -> np.ndarray:
    """One 32-bit seed per hash, from the SHA-256 of its name."""
    return np.array([int(hashlib.sha256(f"seed{i}".encode()).hexdigest()[:8], 16) for i in range(HASHES)], np.uint32)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, shingles, signature): the number of different shingles, and per hash the least of them XOR its seed.

    Texts with fewer than LEAST shingles and null texts have no row. One pass without a shuffle.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = seeds()
        md5 = partial(hashlib.md5, usedforsecurity=False)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), ROWS):
                keep, sizes, heads = [], [], []
                for i, text in enumerate(texts[lo : lo + ROWS], lo):
                    w = _WORD.findall(text.lower())
                    shingles = {" ".join(w[k : k + WORDS]) for k in range(len(w) - WORDS + 1)}
                    if len(shingles) >= LEAST:
                        keep.append(i)
                        sizes.append(len(shingles))
                        heads += [md5(s.encode()).digest()[:4] for s in shingles]
                if keep:
                    base = np.frombuffer(b"".join(heads), ">u4").astype(np.uint32)
                    first = np.cumsum([0, *sizes[:-1]])
                    rows = np.stack([np.minimum.reduceat(base ^ s, first) for s in seed], axis=1).astype(np.int64)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), HASHES).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), lists], [id_col, "shingles", "signature"])

    return scratch.spread(docs.select(id_col, F.col(text_col).alias("text")).where("text is not null")).mapInArrow(sign, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, shingles long, signature array<long>")
