import random

from pyspark.sql import functions as F

from chronolex.operators import buckets


def test_hot_buckets_lose_no_link_and_make_few_pairs(spark):
    rnd = random.Random(3)
    common = list(range(30))
    sets = {i: set(common) | {1000 * (i + 1) + k for k in range(40)} for i in range(400)}
    for i in range(0, 20, 2):  # ten linked pairs
        sets[i + 1] = set(rnd.sample(sorted(sets[i]), 62)) | {10**6 + i}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, elements array<long>")
    members = rows.select(F.lit(7).alias("key"), "id", F.col("id").alias("c"))
    needed = F.ceil(0.5 * F.size("elements"))
    got = {(r.a, r.b) for r in buckets.cross_pairs(members.withColumn("key", F.col("key").cast("long")), lambda ids: rows.join(ids, "id", "left_semi"), needed, hot=50).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert len(want) == 10 and want <= got and len(got) < 400
    every = buckets.cross_pairs(members.withColumn("key", F.col("key").cast("long")), lambda ids: rows.join(ids, "id", "left_semi"), needed, hot=500)
    assert every.count() == 400 * 399 // 2
