"""Problem 8: sources mixed to target shares of tokens, in fixed-length blocks with capped repeats."""

import base64
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex import scratch
from chronolex.llm.textvec import U, mix

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: tokens of a block, blocks of an output shard, seed of all draws
BLOCK, SHARD, SEED = 512, 256, 17
#: rows that one ordered group of a running sum has on average
GROUP = 100_000


def _encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): sizes in tokens of a public tokenizer; source in lower case without outer blanks.

    Null and empty texts have 0 tokens. The vocabulary is read on the driver and broadcast (about 1 MB).
    """
    from public_tokenizers import PATTERN

    with open(tokenizer, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), PATTERN))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*sent.value).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()], pa.int64())], ["doc_id", "source", "tokens"])

    return scratch.spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.trim(source_col)).alias("source"), F.col(text_col).alias("text")).where("doc_id is not null")).mapInArrow(count, "doc_id long, source string, tokens long")


def running_offsets(df: DataFrame, group: str, order: str, size: str, rows: int) -> DataFrame:
    """df with `offset`: the sum of `size` over the rows of its group before it.

    Two levels: rows fall into buckets by the hash of `order`, each bucket is ordered by itself, and only
    bucket sums are ordered over the group; so a group of a third of all rows is many tasks' work. The sums, one per
    group and GROUP rows, are broadcast up to GROUP of them a group and merged beyond.
    """
    buckets = max(1, -(-rows // GROUP))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    sums = df.groupBy(group, "_bucket").agg(F.sum(size).alias("_sum"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inner = F.coalesce(F.sum(size).over(Window.partitionBy(group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inner", inner).join(F.broadcast(base) if buckets <= GROUP else base.hint("merge"), [group, "_bucket"]).withColumn("offset", F.col("_base") + F.col("_inner")).drop("_bucket", "_base", "_inner")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index under a pseudorandom permutation of range(size) that the key picks: a Feistel network, walked until inside."""
    half = np.maximum(np.ceil(np.log2(np.maximum(size, 2)) / 2), 1).astype(np.uint64)
    mask = (U(1) << half) - U(1)
    x = index.astype(np.uint64)
    out = np.full(len(x), -1, np.int64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for turn in range(4):
            left, right = right, left ^ (mix(right + mix(key[todo] + U(turn))) & mask[todo])
        x[todo] = (left << half[todo]) | right
        done = x[todo] < size[todo].astype(np.uint64)
        out[todo[done]] = x[todo[done]].astype(np.int64)
        todo = todo[~done]
    return out


class Mix(NamedTuple):
    """What mixed() gives: the use of each document, the share of each source, and what lies in each slot of each shard."""

    usage: DataFrame
    shares: DataFrame
    shards: DataFrame


def mixed(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Mix:
    """Three tables: the use of each document, the share of each source, and the packed shards.

    counts: (doc_id, source, tokens); targets: (source, target_share, max_repeats). The documents of a source lie
    end to end in blocks of `block` tokens. An output of total_tokens (the corpus's own size if None) has shards of
    `shard` blocks; each shard draws its sources' counts from a multinomial; a source's slots, counted through
    all shards, take its blocks by a new pseudorandom permutation each time around, at most max_repeats times;
    later slots stay empty, so an unreachable share falls short and shows so in the report.

    usage: (doc_id, source, tokens, tokens_used, uses_min, uses_max), one row per document; sources without
    target, null sources and empty documents are used 0 times. A document in several blocks may be used
    more often in one than in another; uses_max never exceeds max_repeats.
    shares: (source, target_share, max_repeats, tokens, tokens_used, actual_share, reachable, tolerance), one row per target. Where all
    shares are reachable they differ from their targets by the draw alone, beyond `tolerance` (four standard deviations) once in 16,000.
    shards: (shard, slot, source, doc_id, first_token, n_tokens): the pieces of documents in each slot that is filled; a slot has the
    pieces of one block, in the order of first_token within each document.

    Sides of joins that grow with the corpus are merged, never broadcast; only the targets and sums by group are.
    """
    spark = counts.sparkSession
    counts = scratch.written(counts.withColumn("source", F.lower(F.trim("source"))), "tokens")
    goal = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    size = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = [r.asDict() for r in goal.join(size, "source", "left").orderBy("source").collect()]  # a row per target
    rows = sum(r["docs"] or 0 for r in plan)
    total = total_tokens or int(size.agg(F.sum("tokens")).first()[0] or 0)
    shards = max(1, -(-total // (block * shard)))
    names = [r["source"] for r in plan]
    share = np.array([r["target_share"] or 0.0 for r in plan])
    share = share / share.sum() if share.sum() > 0 else share
    have = np.array([-(-(r["tokens"] or 0) // block) for r in plan], np.int64)
    most = np.array([r["max_repeats"] or 0 for r in plan], np.int64)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                size = min(shard, max(0, -(-total // block) - k * shard))
                n = np.random.default_rng([seed, k]).multinomial(size, share) if len(share) else np.zeros(0, np.int64)
                yield pd.DataFrame({"shard": k, "source": names, "n": n, "first": np.cumsum(n) - n})

    drawn = scratch.written(spark.range(shards).mapInPandas(draw, "shard long, source string, n long, first long").where("n > 0"), "draws")
    placed = running_offsets(drawn, "source", "shard", "n", shards * max(len(names), 1))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {s: i for i, s in enumerate(names)}
        for pdf in batches:
            source = pdf["source"].map(at).to_numpy(np.int64)
            n = pdf["n"].to_numpy(np.int64)
            k, turn = np.repeat(source, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            slot = turn + np.repeat(pdf["offset"].to_numpy(np.int64), n)
            place = turn + np.repeat(pdf["first"].to_numpy(np.int64), n)
            of = np.repeat(pdf["shard"].to_numpy(np.int64), n)
            ok = slot < have[k] * most[k]
            k, slot, place, of = k[ok], slot[ok], place[ok], of[ok]
            around = slot // np.maximum(have[k], 1)
            key = mix(mix((k + 1).astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)) ^ around.astype(np.uint64))
            yield pd.DataFrame({"shard": of, "slot": place, "source": np.array(names, object)[k], "block": permuted(slot % np.maximum(have[k], 1), have[k], key)})

    filled = scratch.written(placed.select("shard", "source", "n", "first", "offset").mapInPandas(slots, "shard long, slot long, source string, block long"), "slots")
    # documents by block: the tokens of each that lie in it
    laid = running_offsets(counts.join(F.broadcast(goal.select("source")), "source", "left_semi").where("tokens > 0"), "source", "doc_id", "tokens", rows)
    first, last = F.expr(f"offset div {block}"), F.expr(f"(offset + tokens - 1) div {block}")
    parts = laid.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0), F.col("block") * block - F.col("offset"))
    parts = scratch.written(parts.select("source", "block", "doc_id", begin.alias("first_token"), (F.least("tokens", (F.col("block") + 1) * block - F.col("offset")) - begin).alias("n_tokens")), "parts")
    by = ["source", "block"]
    uses = filled.groupBy(*by).agg(F.count("*").alias("uses"))
    joined = parts.join(uses.hint("merge"), by, "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    used = joined.groupBy("doc_id").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.min("uses").alias("uses_min"), F.max("uses").alias("uses_max"))
    usage = scratch.written(counts.join(used.hint("merge"), "doc_id", "left").na.fill(0, ["tokens_used", "uses_min", "uses_max"]), "usage")
    real = usage.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("tokens_used").alias("tokens_used"))
    everything = usage.agg(F.sum("tokens_used").alias("_all"))
    shares = goal.join(real, "source", "left").na.fill(0, ["tokens", "tokens_used"]).join(F.broadcast(everything), F.lit(True)).withColumn("actual_share", F.coalesce(F.col("tokens_used") / F.nullif("_all", F.lit(0)), F.lit(0.0))).drop("_all")
    p = F.col("target_share") / (float(sum(r["target_share"] or 0.0 for r in plan)) or 1.0)
    shares = shares.withColumn("reachable", F.col("tokens") * F.col("max_repeats") >= p * total).withColumn("tolerance", 4 * F.sqrt(p * (1 - p) / max(1, -(-total // block))))
    return Mix(usage, shares, filled.join(parts.hint("merge"), by).select("shard", "slot", "source", "doc_id", "first_token", "n_tokens"))


def _mix(spark: SparkSession, sf: str, tokenizer: str) -> Mix:
    counts = token_counts(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text"), tokenizer=tokenizer)
    return mixed(counts, spark.read.parquet(f"{sf}/mix_targets.parquet"))


def p8_usage(spark: SparkSession, sf: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return _mix(spark, sf, tokenizer).usage


def p8_shares(spark: SparkSession, sf: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return _mix(spark, sf, tokenizer).shares


def p8_shards(spark: SparkSession, sf: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return _mix(spark, sf, tokenizer).shards
