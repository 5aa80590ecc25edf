"""How much of a topic's neighbourhood says what a claim says, window by window of time around it.

A claim is a vector with an anchor time, a document a vector with a time. Both are gathered into blocks; a task
multiplies two blocks and returns counts, or the best rows of each claim and window, so pairs are never written out.
Rows without id, vector or time take no part; empty tables give empty results.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators.search import BUCKET, blocks

DAY = 86400
#: fixed values: windows in days around a claim, [from, to), the first two before it
WINDOWS = [(-730, -365), (-365, 0), (0, 90), (90, 180), (180, 365), (365, 730)]
PRE = 2
#: fixed values: similarity that counts as on the topic, and as saying it; the least neighbourhood
TOPICAL, EXPRESS, LEAST = 0.45, 0.62, 8
POOL, TRAIL, SAMPLE = 60, 10, 10


def _pairs(q: tuple, d: tuple):
    """Similarity and days from claim to document of every pair of two blocks; a row itself is out of all windows."""
    (qi, qv, qt), (di, dv, dt) = q, d
    sims = np.stack(qv).astype(np.float64) @ np.stack(dv).astype(np.float64).T
    days = np.floor((np.asarray(dt)[None, :] - np.asarray(qt)[:, None]) / DAY)
    days[np.asarray(qi)[:, None] == np.asarray(di)[None, :]] = np.inf
    return sims, days


def _joined(claims: DataFrame, docs: DataFrame, block: int, windows: list) -> DataFrame:
    """Pairs of blocks: documents are gathered by quarter of a year, and meet only claims with a window that reaches it."""
    at = lambda days: F.floor((F.col("ts") + days * DAY) / BUCKET)
    q = claims.select("id", "vec", F.col("anchor_ts").alias("ts")).where("ts is not null").withColumn("from", at(min(a for a, _ in windows))).withColumn("to", at(max(b for _, b in windows)))
    q = blocks(q, "q", block, "from", "to").withColumn("tb", F.explode(F.sequence("from", "to")))
    d = docs.where("ts is not null").withColumn("tb", F.floor(F.col("ts") / BUCKET))
    return q.join(blocks(d, "d", block, "tb"), "tb")


_SIX = ("q_id", "q_vec", "q_ts", "d_id", "d_vec", "d_ts")


def curve(claims: DataFrame, docs: DataFrame, windows: list = WINDOWS, topical: float = TOPICAL, express: float = EXPRESS, block: int = 512) -> DataFrame:
    """(claim_id, win, n_topical, n_expressing) of every window in which a claim has topical documents.

    claims: (id, vec, anchor_ts); docs: (id, vec, ts).
    """

    @F.pandas_udf("array<struct<claim_id: bigint, win: int, n_topical: bigint, n_expressing: bigint>>")
    def count(qi: pd.Series, qv: pd.Series, qt: pd.Series, di: pd.Series, dv: pd.Series, dt: pd.Series) -> pd.Series:
        out = []
        for a, x, s, b, y, t in zip(qi, qv, qt, di, dv, dt, strict=True):
            sims, days = _pairs((a, x, s), (b, y, t))
            rows = []
            for w, (lo, hi) in enumerate(windows):
                inside = (days >= lo) & (days < hi)
                near, says = (inside & (sims >= topical)).sum(1), (inside & (sims >= express)).sum(1)
                rows += [(int(a[i]), w, int(near[i]), int(says[i])) for i in np.flatnonzero(near)]
            out.append(rows)
        return pd.Series(out)

    rows = _joined(claims, docs, block, windows).select(F.inline(count(*_SIX)))
    return rows.groupBy("claim_id", "win").agg(F.sum("n_topical").alias("n_topical"), F.sum("n_expressing").alias("n_expressing"))


def summary(curve: DataFrame, windows: list = WINDOWS, pre: int = PRE, least: int = LEAST) -> DataFrame:
    """(claim_id, baseline, peak, adoption, surprisal, lead_days) from windows with at least `least` topical documents.

    baseline: pooled share before the claim; peak: greatest share after it; lead_days: the middle of the first
    window after it with a share of at least max(2 * baseline, 0.02) and two documents. Undecided stays null.
    """
    firm = curve.where(F.col("n_topical") >= least).withColumn("p", F.col("n_expressing") / F.col("n_topical"))
    before = F.col("win") < pre
    total = lambda c: F.sum(F.when(before, F.col(c)))
    g = firm.groupBy("claim_id").agg((total("n_expressing") / total("n_topical")).alias("baseline"), F.max(F.when(~before, F.col("p"))).alias("peak"), F.collect_list(F.when(~before & (F.col("n_expressing") >= 2), F.struct("win", "p"))).alias("after"))
    rising = F.filter("after", lambda w: w["p"] >= F.greatest(2 * F.col("baseline"), F.lit(0.02)))
    middle = F.array(*[F.lit((a + b) // 2) for a, b in windows])
    lead = F.when(F.col("baseline").isNotNull() & (F.size(rising) > 0), F.get(middle, F.array_min(F.transform(rising, lambda w: w["win"]))))
    return g.select("claim_id", "baseline", "peak", (F.col("peak") - F.col("baseline")).alias("adoption"), (1 - F.col("baseline")).alias("surprisal"), lead.alias("lead_days"))


def candidates(claims: DataFrame, docs: DataFrame, canonical: DataFrame, windows: list = WINDOWS, topical: float = TOPICAL, pool: int = POOL, block: int = 512) -> DataFrame:
    """(claim_id, win, doc_id, score, place, n_topical): per claim and window the `pool` most similar stories on the topic; ties fall to the greater id.

    canonical: (doc_id, canonical), by which documents tell one story; a story stands in a window with its most similar document,
    and takes one place of the pool in however many copies. n_topical: all documents on the topic in the window, copies too.
    """
    told = docs.join(canonical.select(F.col("doc_id").alias("id"), F.col("canonical").alias("_c")), "id", "left").select("id", "vec", "ts", F.coalesce("_c", "id").alias("story"))

    @F.pandas_udf("array<struct<claim_id: bigint, win: int, story: bigint, doc_id: bigint, score: double, n: bigint>>")
    def best(qi: pd.Series, qv: pd.Series, qt: pd.Series, di: pd.Series, dv: pd.Series, dt: pd.Series, ds: pd.Series) -> pd.Series:
        out = []
        for a, x, s, b, y, t, z in zip(qi, qv, qt, di, dv, dt, ds, strict=True):
            sims, days = _pairs((a, x, s), (b, y, t))
            b, z, rows = np.asarray(b), np.asarray(z), []
            for w, (lo, hi) in enumerate(windows):
                ok = (days >= lo) & (days < hi) & (sims >= topical)
                for i in np.flatnonzero(ok.any(1)):
                    c = np.flatnonzero(ok[i])
                    c = c[np.lexsort((-b[c], -sims[i, c]))]
                    top = c[np.sort(np.unique(z[c], return_index=True)[1])[:pool]]
                    # the first row of a block carries how many documents there were
                    rows += [(int(a[i]), w, int(z[k]), int(b[k]), float(sims[i, k]), len(c) if k == top[0] else 0) for k in top]
            out.append(rows)
        return pd.Series(out)

    rows = _joined(claims, told, block, windows).select(F.inline(best(*_SIX, "d_story")))
    g = rows.groupBy("claim_id", "win", "story").agg(F.max(F.struct("score", "doc_id")).alias("b"), F.sum("n").alias("n"))
    total = g.groupBy("claim_id", "win").agg(F.sum("n").alias("n_topical"))
    by = Window.partitionBy("claim_id", "win").orderBy(F.desc("b.score"), F.desc("b.doc_id"))
    cut = g.withColumn("place", F.row_number().over(by)).where(F.col("place") <= pool)
    return cut.join(total, ["claim_id", "win"]).select("claim_id", "win", F.col("b.doc_id").alias("doc_id"), F.col("b.score").alias("score"), "place", "n_topical")


def chosen(candidates: DataFrame, trail: int = TRAIL, sample: int = SAMPLE) -> DataFrame:
    """(claim_id, win, doc_id, in_trail, in_sample, n_topical): what a judge should read of the candidates.

    The trail is the most similar `trail`, the sample the first `sample` in the order of an MD5 of claim, window and
    document: uniform, and the same in every run. A claim and window have at most the pool's rows.
    """
    drawn = F.row_number().over(Window.partitionBy("claim_id", "win").orderBy(F.md5(F.concat_ws("|", "claim_id", "win", "doc_id"))))
    c = candidates.withColumn("drawn", drawn)
    return c.where((F.col("place") <= trail) | (F.col("drawn") <= sample)).select("claim_id", "win", "doc_id", (F.col("place") <= trail).alias("in_trail"), (F.col("drawn") <= sample).alias("in_sample"), "n_topical")
