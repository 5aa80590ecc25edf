"""Problem 4: new batches against everything accepted so far, through a persisted index of band keys."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex import scratch
from chronolex.llm import dart_minhash, linking, textvec
from chronolex.operators import buckets

#: folders of keys and of run sets, by hash, where the index's maker names no number; keys of a folder
BUCKETS, FILE = 64, 60_000
#: up to so many pairs of rows that share a band are written at once; more are first thinned round by round
PAIRS = 5_000_000
#: thinning ends after so many rounds without a tenth fewer pairs
IDLE = 8
#: fixed values: query parameters that only track the visitor
TRACKING = "utm_[a-z_]+|gclid|fbclid|dclid|gbraid|wbraid|msclkid|yclid|twclid|igshid|mc_cid|mc_eid|_ga|_gl|_hsenc|_hsmi|mkt_tok|spm|vero_id|oly_anon_id|oly_enc_id|wickedid"


def same_url(url: str | Column) -> Column:
    """A url without what doesn't tell pages apart; null for null and blank ones.

    Left out: scheme, letter case of the host, leading `www.`, the scheme's default port, closing slash,
    fragment, and tracking parameters.
    """
    url = F.trim(F.col(url) if isinstance(url, str) else url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise(":(80|443)$")
    host = F.regexp_replace(F.regexp_replace(host, port, F.lit("")), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({TRACKING})(=|$)")), "&")
    return F.when(url != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _sketch(words: int, min_runs: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for lo, hi in textvec.slices(texts):
                h, doc = textvec.run_sets(texts[lo:hi], words)
                n = np.bincount(doc, minlength=hi - lo)
                cut = np.concatenate(([0], np.cumsum(n)))
                keep = n >= min_runs
                whole = np.zeros(hi - lo, np.uint64)
                np.add.at(whole, doc, textvec.mix(h))
                on = keep[doc]
                place = np.cumsum(keep) - 1
                keys = dart_minhash.bands(dart_minhash.signatures(h[on], place[doc[on]], np.ones(int(on.sum())), int(keep.sum()), linking.BANDS * linking.ROWS, linking.SEED), linking.ROWS)
                short = (h >> np.uint64(22)).astype("<u4")
                bands = [keys[place[i]] if keep[i] else None for i in range(hi - lo)]
                runs = [np.sort(short[cut[i] : cut[i + 1]]).tobytes() if keep[i] else None for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), pa.array(whole.view(np.int64), mask=~keep), pa.array(bands, pa.list_(pa.int64())), pa.array(runs, pa.binary())], _NAMES)

    return sketch


_NAMES = ["ref", "url_key", "hash_key", "set_hash", "bands", "runs"]
_PREPARED = "ref long, url_key long, hash_key long, set_hash long, bands array<long>, runs binary"


class History:
    """An index, in a folder, of what was accepted: exact keys, band keys and run sets by row.

    keys: (bucket, key, exact, ref), in folders by hash of the key; sets: (part, ref, keys, set_hash, bands, runs), in folders by hash of the row.
    A batch reads only the folders that its own keys fall into, then only those of the rows it met; no text of the
    history is read again. `buckets` is fixed when the index is made: with buckets_for(rows expected) a folder holds some 60,000 keys,
    so what a batch reads follows its own size, not that of the history.
    """

    def __init__(self, spark: SparkSession, path: str, words: int = 5, threshold: float = 0.8, min_runs: int = 1, buckets: int = BUCKETS):
        self.spark, self.path, self.words, self.threshold, self.min_runs, self.buckets = spark, path.rstrip("/"), words, threshold, min_runs, buckets

    def _raw(self, rows: DataFrame) -> DataFrame:
        keys = rows.select("ref", F.when(same_url("url").isNotNull(), F.xxhash64(F.lit("url"), same_url("url"))).alias("url_key"), F.when(F.trim("text_hash") != "", F.xxhash64(F.lit("hash"), F.lower(F.trim("text_hash")))).alias("hash_key"), "text")
        return scratch.spread(keys).mapInArrow(_sketch(self.words, self.min_runs), _PREPARED)

    def prepared(self, rows: DataFrame) -> DataFrame:
        """(ref, url_key, hash_key, set_hash, bands, runs) of rows (ref, url, text_hash, text), written for reuse; one pass, no shuffle."""
        return scratch.written(self._raw(rows), "prepared")

    def _keys(self, p: DataFrame) -> DataFrame:
        exact = F.filter(F.array("url_key", "hash_key", F.when(F.col("set_hash").isNotNull(), F.xxhash64(F.lit("set"), "set_hash"))), lambda k: k.isNotNull())
        keys = p.select("ref", F.explode(exact).alias("key"), F.lit(True).alias("exact")).unionByName(p.select("ref", F.explode("bands").alias("key"), F.lit(False).alias("exact")))
        return keys.select(F.pmod("key", F.lit(self.buckets)).cast("int").alias("bucket"), "key", "exact", "ref")

    def append(self, prepared: DataFrame) -> None:
        """Adds accepted rows to the index."""
        n = prepared.count()
        self._write("sets", prepared.withColumn("part", self._part("ref")), "part", n)
        self._write("keys", self._keys(prepared), "bucket", n * (2 + linking.BANDS))

    def load(self, rows: DataFrame) -> None:
        """append() of all of an empty index's rows (ref, url, text_hash, text); their run sets are written once, and the keys read back from them."""
        n = rows.count()
        self._write("sets", self._raw(rows).withColumn("part", self._part("ref")), "part", n)
        self._write("keys", self._keys(self._table("sets")), "bucket", n * (2 + linking.BANDS))

    def _write(self, name: str, rows: DataFrame, by: str, n: int) -> None:
        """Appends n rows: each folder gets a file, or more where its rows are over FILE on average; a task gets some 40 MB."""
        spread = F.pmod(F.xxhash64("ref"), F.lit(1 + n // (self.buckets * FILE)))
        tasks = max(1 + n // (FILE // 2 if name == "sets" else 32 * FILE), min(self.buckets, self.spark.sparkContext.defaultParallelism))
        rows.repartition(tasks, by, spread).write.mode("append").partitionBy(by).option("compression", "zstd").parquet(f"{self.path}/{name}")

    def _table(self, name: str) -> DataFrame:
        schema = {"keys": "key long, exact boolean, ref long, bucket int", "sets": f"{_PREPARED}, part int"}[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _part(self, ref: str) -> Column:
        return F.pmod(F.xxhash64(ref), F.lit(self.buckets)).cast("int")

    def _pruned(self, table: DataFrame, by: str, values: DataFrame) -> DataFrame:
        """The folders of a table that the values fall into; their numbers, at most `buckets`, come to the driver."""
        some = [r[0] for r in values.select(by).distinct().collect()]
        return table if 2 * len(some) > self.buckets else table.where(F.col(by).isin(some))

    def keys(self, own: DataFrame | None = None) -> DataFrame:
        table = self._table("keys")
        return table if own is None else self._pruned(table, "bucket", own)

    def sets(self, refs: DataFrame | None = None) -> DataFrame:
        """(ref, set_hash, runs) of the rows with a run set, or of those in the folders that some refs lie in."""
        table = self._table("sets")
        table = table if refs is None else self._pruned(table, "part", refs.select(self._part("ref").alias("part")))
        return table.where("runs is not null").select("ref", "set_hash", "runs")

    def _linked(self, pairs: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b), written already, whose run sets are similar enough; b is of the history unless right is given."""
        wanted = pairs.select(F.col("b").alias("ref")).distinct()
        right = (self.sets(wanted) if right is None else right).join(wanted, "ref", "left_semi")
        both = pairs.join(left.select(F.col("ref").alias("a"), F.col("runs").alias("x")), "a").join(right.select(F.col("ref").alias("b"), F.col("runs").alias("y")), "b")
        return both.where(linking.jaccard("x", "y") >= self.threshold).select("a", "b")

    def _slices(self, left: DataFrame, met: DataFrame) -> list[DataFrame]:
        """The rows of met, all at once if they make few pairs with left, else in parts that grow: what links to one part needn't meet the next."""
        by = ["bucket", "key"]
        n = left.groupBy(*by).agg(F.count("*").alias("n")).join(met.groupBy(*by).agg(F.count("*").alias("m")), by).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        if n <= PAIRS:
            return [met]
        # rows of one set link alike
        kinds = self.sets(met.select(F.col("b").alias("ref"))).select(F.col("ref").alias("b"), F.coalesce("set_hash", "ref").alias("set_hash")).join(met.select("b").distinct(), "b", "left_semi")
        met = scratch.written(met.join(kinds, "b").groupBy(*by, "set_hash").agg(F.min("b").alias("b")).select(*by, "b"), "met")
        part = lambda k: F.pmod(F.xxhash64("b"), F.lit(k)) == 0
        steps = [4096, 512, 64, 8, 1]
        return [met.where(part(k) if i == 0 else part(k) & ~part(steps[i - 1])) for i, k in enumerate(steps)]

    def rejected(self, batch: DataFrame, accept: bool = True) -> DataFrame:
        """(ref) of the batch's rows that aren't to be accepted; the others join the index if accept.

        batch: (ref, url, text_hash, text), taken in order of ref. A row is rejected if it agrees with an
        indexed row, or an earlier accepted row of the batch, in its url, its text_hash, or by linked
        text. Nulls and blanks agree with nothing, short texts (fewer than min_runs runs) are never
        linked; refs must be unique in batch and index. An empty batch rejects nothing.
        """
        return scratch.settled(lambda: self._rejected(batch, accept), "rejected")

    def _rejected(self, batch: DataFrame, accept: bool) -> DataFrame:
        p = self.prepared(batch)
        own = scratch.written(self._keys(p), "batch-keys")
        # against the history: equal keys; then the least row of each shared bucket; then its other rows
        index = self.keys(own)
        by = ["bucket", "key"]
        gone = scratch.written(own.where("exact").join(index.where("exact").select(*by), by, "left_semi").select("ref").distinct(), "equal")
        left = own.join(gone, "ref", "left_anti").where("not exact")
        met = index.where("not exact").join(left.select(*by).distinct(), by, "left_semi").select(*by, F.col("ref").alias("b"))
        met = scratch.written(met, "met")
        lead = met.groupBy(*by).agg(F.min("b").alias("b"))
        first = scratch.written(left.join(lead, by).select(F.col("ref").alias("a"), "b").distinct(), "first")
        near = scratch.written(self._linked(first, p).select(F.col("a").alias("ref")).distinct(), "near")
        left = left.join(near, "ref", "left_anti")
        gone = gone.unionByName(near)
        for part in self._slices(left, met):
            more = left.join(part, by).select(F.col("ref").alias("a"), "b").distinct().join(first, ["a", "b"], "left_anti")
            more = scratch.written(more, "more")
            if not more.isEmpty():
                near = scratch.written(self._linked(more, p).select(F.col("a").alias("ref")).distinct(), "near")
                gone, left = gone.unionByName(near), left.join(near, "ref", "left_anti")
        gone = scratch.written(gone.distinct(), "against-history")
        # among the batch itself
        rest = scratch.written(own.join(gone, "ref", "left_anti"), "rest")
        gone = gone.unionByName(self._among(p, rest))
        gone = scratch.written(gone.distinct(), "rejected")
        if accept:
            self.append(p.join(gone, "ref", "left_anti"))
        return gone

    def _among(self, p: DataFrame, keys: DataFrame) -> DataFrame:
        """The refs that agree with an earlier row of the batch that is itself not rejected."""
        by = ["bucket", "key"]
        lead = keys.groupBy(*by).agg(F.min("ref").alias("b"), F.count("*").alias("size")).where("size > 1").select(*by, "b")
        shared = scratch.written(keys.join(lead, by), "shared")
        gone, open_, before, idle = None, shared.select(*by, "exact", "ref"), None, 0
        while True:
            # the least of all its buckets has nothing earlier to agree with: it is accepted, and what agrees with it rejected
            late = shared.where("ref <> b").select("ref").distinct()
            sure = scratch.written(shared.where("ref = b").select("ref").distinct().join(late, "ref", "left_anti"), "sure")
            pairs = shared.where("ref <> b").join(sure.withColumnRenamed("ref", "b"), "b", "left_semi")
            equal = pairs.where("exact").select("ref").distinct()
            first = scratch.written(pairs.where("not exact").join(equal, "ref", "left_anti").select(F.col("ref").alias("a"), "b").distinct(), "pairs")
            hit = scratch.written(equal.unionByName(self._linked(first, p, p).select(F.col("a").alias("ref"))).distinct(), "copies")
            gone = hit if gone is None else gone.unionByName(hit)
            open_ = scratch.written(open_.join(hit.unionByName(sure), "ref", "left_anti"), "open")
            size = open_.where("not exact").groupBy(*by).agg(F.count("*").alias("n"))
            left = size.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
            idle = 0 if before is None or left < 0.9 * before else idle + 1
            before = left if not idle else before
            if left <= PAIRS or idle == IDLE:
                break
            # who kept out a bucket's next row may be decided now
            lead = open_.groupBy(*by).agg(F.min("ref").alias("b"))
            shared = scratch.written(open_.join(lead, by), "shared")
        members = open_.where("not exact").select("key", F.col("ref").alias("id"), F.col("ref").alias("c"))
        lists = lambda ids: p.select(F.col("ref").alias("id"), _elements("runs").alias("elements")).join(ids, "id", "left_semi")
        pairs = buckets.cross_pairs(members, lists, F.ceil(self.threshold * F.size("elements"))).select(F.col("b").alias("a"), F.col("a").alias("b"))
        links = scratch.written(self._linked(scratch.written(pairs, "pairs"), p, p), "links")
        exact = open_.where("exact").select("key", "ref").distinct()
        undecided = scratch.written(links.select(F.col("a").alias("ref")).unionByName(links.select(F.col("b").alias("ref"))).unionByName(exact.select("ref")).distinct(), "undecided")
        accepted = None
        while not undecided.isEmpty():
            # accepted now: who has no undecided row before it, by link or key
            blocked = links.join(undecided.withColumnRenamed("ref", "b"), "b", "left_semi").select(F.col("a").alias("ref"))
            live = exact.join(undecided, "ref", "left_semi")
            later = live.join(live.groupBy("key").agg(F.min("ref").alias("least")), "key").where("ref > least").select("ref")
            now = scratch.written(undecided.join(blocked.unionByName(later).distinct(), "ref", "left_anti"), "accepted")
            hit = links.join(now.withColumnRenamed("ref", "b"), "b", "left_semi").select(F.col("a").alias("ref"))
            held = exact.join(now, "ref", "left_semi").groupBy("key").agg(F.min("ref").alias("least"))
            hit = hit.unionByName(exact.join(held, "key").where("ref > least").select("ref")).distinct()
            hit = scratch.written(hit.join(undecided, "ref", "left_semi"), "hit")
            gone = gone.unionByName(hit)
            undecided = scratch.written(undecided.join(now.unionByName(hit), "ref", "left_anti"), "undecided")
        return gone


@F.pandas_udf(T.ArrayType(T.LongType()))
def _elements(runs: pd.Series) -> pd.Series:
    """The hashes of a run set, four bytes each."""
    return runs.map(lambda b: None if b is None else np.frombuffer(b, "<u4").astype(np.int64))


def buckets_for(rows: int) -> int:
    """Folders of an index that is to hold so many rows, some 60,000 keys each."""
    return min(max(16, rows * (2 + linking.BANDS) // FILE), 1 << 16)


def _start(spark: SparkSession, sf: str) -> tuple[History, DataFrame]:
    """A history of all documents, and the arrivals; refs keep the two kinds of ids apart."""
    docs, incoming = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "incoming"))
    history = History(spark, scratch.new_path(spark, "history"), words=6, threshold=0.5, min_runs=20, buckets=buckets_for(docs.count()))
    history.load(docs.select((F.col("doc_id") * 2).alias("ref"), "url", "text_hash", "text"))
    return history, incoming.select((F.col("arrival_id") * 2 + 1).alias("ref"), "url", "text_hash", "text", "batch_no")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The arrivals of all batches, in order of arrival_id, that aren't to be accepted; the index starts from documents."""
    history, rows = _start(spark, sf)
    return history.rejected(rows.drop("batch_no")).select(F.expr("(ref - 1) div 2").alias("arrival_id"))


def p4_batches(spark: SparkSession, sf: str) -> DataFrame:
    """(batch_no, arrival_id): the same with the batches handed over one after the other, each against all that was accepted before it.

    Batches are few; each is looked up in the folders that its keys fall into, decided, and its accepted rows appended.
    """
    history, rows = _start(spark, sf)
    found = None
    for n in sorted(r[0] for r in rows.where("batch_no is not null").select("batch_no").distinct().collect()):
        part = history.rejected(rows.where(F.col("batch_no") == n).drop("batch_no")).select(F.lit(n).alias("batch_no"), F.expr("(ref - 1) div 2").alias("arrival_id"))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else rows.where("false").select("batch_no", F.col("ref").alias("arrival_id"))
