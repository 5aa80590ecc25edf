"""Scores of claims from verdicts in windows of time around them.

verdicts: (claim_id, doc_id, direction, relation, weight, conf, attributes_source, ...), quotes checked; claims: (claim_id,
own_doc, anchor_ts, own_source, ...); docs: (doc_id, ts, source_id). Evidence of a claim is what other documents of other sources
say; rows without a source stay. Undecided stays null, never 0. Aggregates are combined map-side and ranks cut before
the shuffle, so a claim with a third of all verdicts costs no single task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators.search import folded
from chronolex.operators.store import DEFEATS

DAY = 86400
#: fixed values: windows in days around a claim: (set, side, index, from, to), [from, to)
LONG = [("pre", 0, -730, -365), ("pre", 1, -365, 0), ("post", 0, 0, 90), ("post", 1, 90, 180), ("post", 2, 180, 365), ("post", 3, 365, 730), ("post", 4, 730, 1460)]
SHORT = [("pre", 0, -365, -90), ("pre", 1, -90, 0), ("post", 0, 0, 30), ("post", 1, 30, 90), ("post", 2, 90, 180), ("post", 3, 180, 365)]
INFLUENCE_DAYS = [7, 30, 90, 180, 365, 1095]
MIN_JUDGED, RATE = 4, 10
#: fixed values: relations of later documents that take a claim up, those that only share its subject, and the confidence an uptake needs
UPTAKE = ["states", "anticipates_directionally", "partially_anticipates"]
STRONG = ["states"]
ON_TOPIC = ["orthogonal", "contradicts"]
SURE, TOPICAL_SURE = 0.5, 0.4
HIT = 0.35


def with_lag(verdicts: DataFrame, claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Verdicts with `lag`, seconds from the claim to the document, `days`, its floor in days, the document's ts and source, and what the claim is its own."""
    d = docs.select("doc_id", "ts", "source_id")
    rows = verdicts.join(claims.select("claim_id", "anchor_ts", "own_source", "own_doc"), "claim_id").join(d, "doc_id")
    return rows.withColumn("lag", F.col("ts") - F.col("anchor_ts")).withColumn("days", F.floor(F.col("lag") / DAY))


def of_others(lagged: DataFrame) -> DataFrame:
    """Verdicts on other documents of other sources than the claim's."""
    return lagged.where(F.col("doc_id") != F.col("own_doc")).where(F.coalesce(F.col("source_id") != F.col("own_source"), F.lit(True)))


def before(lagged: DataFrame) -> DataFrame:
    """Evidence strictly before the claim."""
    return of_others(lagged).where("direction = 'prior' and lag < 0")


def prior_strength(prior: DataFrame) -> DataFrame:
    """(claim_id, strength, doc_id): the greatest weight times confidence, however small, and the least document id that has it."""
    p = prior.withColumn("strength", F.col("weight") * F.col("conf"))
    return p.groupBy("claim_id").agg(F.max("strength").alias("strength"), F.min_by("doc_id", F.struct(-F.col("strength"), "doc_id")).alias("doc_id"))


def best_prior(prior: DataFrame, least: float = 0.1) -> DataFrame:
    """prior_strength() of claims whose strongest evidence is worth a receipt: above `least`."""
    return prior_strength(prior).where(F.col("strength") > least)


def coverage(pool: Column, topical: Column, retrievers: Column) -> Column:
    """How far a search can be trusted to have found what there is, 0..1, to four places."""
    one = F.lit(1.0)
    raw = F.least(one, F.log1p(pool) / F.log1p(F.lit(20000.0))) * (0.35 + 0.65 * F.least(one, topical / 4)) * (0.55 + 0.45 * F.least(one, retrievers / 3))
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), one), 4)


def originality(prior: DataFrame, searches: DataFrame) -> DataFrame:
    """(claim_id, hi, lo, score, coverage, synthesis) of each claim of searches: (claim_id, pool, retrievers).

    pool: documents before the claim; retrievers: ways of search that could find something for it. prior: evidence before
    the claim, by other sources. hi is what the strongest leaves, lo what is left of it where the search was thin.
    synthesis: nothing says the whole, but two sources or more a part each.
    """
    sure = F.col("conf") >= SURE
    per = prior.groupBy("claim_id").agg(
        F.max(F.col("weight") * F.col("conf")).alias("best"),
        F.sum(((F.col("relation") != "unrelated") & (F.col("conf") >= TOPICAL_SURE)).cast("int")).alias("topical"),
        F.sum((F.col("relation").isin(DEFEATS) & sure).cast("int")).alias("defeating"),
        F.count_distinct(F.when((F.col("relation") == "partial") & sure, F.col("source_id"))).alias("partial"),
    )
    rows = searches.join(per, "claim_id", "left").na.fill(0, ["best", "topical", "defeating", "partial", "pool", "retrievers"])
    rows = rows.withColumn("coverage", coverage(F.col("pool"), F.col("topical"), F.col("retrievers"))).withColumn("hi", F.greatest(1 - F.col("best"), F.lit(0.0))).withColumn("lo", F.col("hi") * F.col("coverage"))
    return rows.select("claim_id", "hi", "lo", (F.col("lo") + (F.col("hi") - F.col("lo")) * (0.35 + 0.65 * F.col("coverage"))).alias("score"), "coverage", ((F.col("defeating") == 0) & (F.col("partial") >= 2)).alias("synthesis"))


def pools(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(claim_id, pool): how many documents are strictly older than each claim.

    Counted by second and day, so that the ordered group of one task is a day's different seconds, and another one the days.
    """
    day = F.floor(F.col("ts") / DAY)
    events = docs.select("ts", F.lit(1).alias("n")).unionByName(claims.select(F.col("anchor_ts").alias("ts"), F.lit(0).alias("n"))).where("ts is not null").groupBy("ts").agg(F.sum("n").alias("n")).withColumn("day", day)
    inner = events.withColumn("_in", F.sum("n").over(Window.partitionBy("day").orderBy("ts")) - F.col("n"))
    days = events.groupBy("day").agg(F.sum("n").alias("n")).withColumn("_base", F.sum("n").over(Window.orderBy("day")) - F.col("n")).drop("n")
    at = inner.join(days, "day").select("ts", (F.col("_in") + F.col("_base")).alias("pool"))
    return claims.select("claim_id", F.col("anchor_ts").alias("ts")).join(at, "ts", "left").select("claim_id", F.coalesce("pool", F.lit(0)).alias("pool"))


def window_column(windows: list) -> Column:
    """The place of a verdict in the windows, by its days: earlier evidence in those before the claim, later evidence in those after it; null outside."""
    out = F.lit(None).cast("int")
    for i, (side, _, a, b) in enumerate(windows):
        on = (F.col("direction") == ("prior" if side == "pre" else "later")) & (F.col("days") >= a) & (F.col("days") < b)
        out = F.when(on, F.lit(i)).otherwise(out)
    return out


def judged_windows(lagged: DataFrame, windows: list = LONG, rate: int = RATE) -> DataFrame:
    """(claim_id, win, judged, n, expressed, support, refute) of each window with verdicts.

    expressed is the mean of positive weight times confidence over the window's rate sample: its first `rate` documents in
    the order of an MD5 of claim, window and document, n of them. support and refute are sums over all `judged` verdicts.
    """
    rows = of_others(lagged).withColumn("win", window_column(windows)).where("win is not null")
    rows = rows.select("claim_id", "win", "doc_id", "relation", (F.greatest("weight", F.lit(0.0)) * F.col("conf")).alias("pos"), F.when(F.col("relation") == "contradicts", F.abs("weight") * F.col("conf")).otherwise(0.0).alias("neg"))
    drawn = Window.partitionBy("claim_id", "win").orderBy(F.md5(F.concat_ws("|", "claim_id", "win", "doc_id")))
    sample = rows.select("claim_id", "win", "doc_id", "pos").withColumn("_nth", F.row_number().over(drawn)).where(F.col("_nth") <= rate)
    sample = sample.groupBy("claim_id", "win").agg(F.count("*").alias("n"), F.avg("pos").alias("expressed"))
    return rows.groupBy("claim_id", "win").agg(F.count("*").alias("judged"), F.sum("pos").alias("support"), F.sum("neg").alias("refute")).join(sample, ["claim_id", "win"]).select("claim_id", "win", "judged", "n", "expressed", "support", "refute")


def predictive_value(claims: DataFrame, judged: DataFrame, priors: DataFrame, windows: list = LONG, min_judged: int = MIN_JUDGED) -> DataFrame:
    """(claim_id, surprisal, baseline, peak, adoption, vindication, pv) of every claim.

    surprisal: what the strongest prior evidence, however weak, leaves of 1. Baseline and peak come from windows with at
    least min_judged sampled verdicts and are null without one; support and refutation from all windows after the claim.
    """
    pre = F.col("win") < sum(1 for w in windows if w[0] == "pre")
    firm = F.col("n") >= min_judged
    rows = judged.groupBy("claim_id").agg(
        (F.sum(F.when(pre & firm, F.col("expressed") * F.col("n"))) / F.sum(F.when(pre & firm, F.col("n")))).alias("baseline"),
        F.max(F.when(~pre & firm, F.col("expressed"))).alias("peak"),
        F.sum(F.when(~pre, F.col("support")).otherwise(0.0)).alias("s"),
        F.sum(F.when(~pre, F.col("refute")).otherwise(0.0)).alias("r"),
    )
    rows = claims.select("claim_id").join(rows, "claim_id", "left").join(priors.select("claim_id", F.col("strength").alias("p")), "claim_id", "left")
    rows = rows.withColumn("surprisal", F.greatest(F.lit(0.0), 1 - F.coalesce("p", F.lit(0.0))))
    rows = rows.withColumn("adoption", F.col("peak") - F.col("baseline")).withColumn("vindication", F.when(F.col("s") + F.col("r") > 1e-9, (F.col("s") - F.col("r")) / (F.col("s") + F.col("r"))))
    pv = F.col("surprisal") * F.when(F.col("adoption").isNotNull(), F.greatest(F.lit(0.0), F.col("adoption"))) * F.coalesce((1 + F.col("vindication")) / 2, F.lit(1.0))
    return rows.select("claim_id", "surprisal", "baseline", "peak", "adoption", "vindication", pv.alias("pv"))


def strongest(lagged: DataFrame, windows: list = LONG) -> DataFrame:
    """(claim_id, anticipation, strength, contradiction, contra_conf): the later documents that bear a claim out most, and contradict it most surely.

    Of equals the least document id; a claim with neither has no row.
    """
    post = of_others(lagged).withColumn("win", window_column(windows)).where("win is not null and direction = 'later'").withColumn("x", F.col("weight") * F.col("conf"))
    best = lambda on, x: F.min(F.when(on, F.struct((-x).alias("x"), "doc_id")))
    g = post.groupBy("claim_id").agg(best(F.col("weight") > 0, F.col("x")).alias("a"), best(F.col("relation") == "contradicts", F.col("conf")).alias("c"))
    return g.where("a is not null or c is not null").select("claim_id", F.col("a.doc_id").alias("anticipation"), (-F.col("a.x")).alias("strength"), F.col("c.doc_id").alias("contradiction"), (-F.col("c.x")).alias("contra_conf"))


def followers(lagged: DataFrame, last: int = INFLUENCE_DAYS[-1]) -> DataFrame:
    """Later evidence strictly after a claim and within `last` days, by other sources, with `up`: whether it takes the claim up."""
    later = of_others(lagged).where("direction = 'later' and lag > 0").where(F.col("lag") < last * DAY)
    return later.withColumn("up", F.col("relation").isin(UPTAKE) & (F.col("conf") >= SURE))


def fingerprint_hits(rows: DataFrame, claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(claim_id, doc_id) of rows whose document has one of the claim's fingerprints, word for word; each pair once.

    Letters are compared without case and diacritics; fingerprints of one word don't count. Texts are shuffled once, by id.
    """
    phrase = lambda p: F.trim(F.regexp_replace(folded(p), r"[^\p{L}\p{N}]+", " "))
    f = claims.select("claim_id", F.filter(F.transform("fingerprints", phrase), lambda p: F.contains(p, F.lit(" "))).alias("_f")).where(F.size("_f") > 0)
    pairs = rows.select("claim_id", "doc_id").distinct().join(f, "claim_id")
    text = F.concat(F.lit(" "), F.regexp_replace(folded(F.concat_ws(" ", "title", "text")), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    met = pairs.join(docs.select("doc_id", text.alias("_t")), "doc_id")
    return met.where(F.exists("_f", lambda p: F.contains(F.col("_t"), F.concat(F.lit(" "), p, F.lit(" "))))).select("claim_id", "doc_id")


def influence_windows(follow: DataFrame, hits: DataFrame, canonical: DataFrame, days: list[int] = INFLUENCE_DAYS) -> DataFrame:
    """(claim_id, win_days, uptake_sources, uptake_docs, strong_docs, topical_docs, attributed_docs, fingerprint_docs, lift), cumulative.

    follow: followers(); hits: (claim_id, doc_id) with a fingerprint; canonical: (doc_id, canonical), by which documents that
    share a story count once as a source, with the earliest of them. lift: share of the uptake beside what is only on the topic.
    """
    rows = follow.join(hits.withColumn("_hit", F.lit(True)), ["claim_id", "doc_id"], "left")
    up = F.col("up")
    kinds = {"uptake_docs": up, "strong_docs": up & F.col("relation").isin(STRONG), "topical_docs": F.col("relation").isin(ON_TOPIC), "attributed_docs": up & F.coalesce("attributes_source", F.lit(False)), "fingerprint_docs": up & F.coalesce("_hit", F.lit(False))}
    counts = rows.groupBy("claim_id").agg(*[F.sum(((F.col("lag") <= d * DAY) & on).cast("long")).alias(f"{k}_{d}") for d in days for k, on in kinds.items()])
    first = follow.where("up").join(canonical, "doc_id", "left").groupBy("claim_id", F.coalesce("canonical", "doc_id").alias("story")).agg(F.min(F.struct("lag", "doc_id", "source_id")).alias("f"))
    source = first.where("f.source_id is not null").groupBy("claim_id", "f.source_id").agg(F.min("f.lag").alias("lag"))
    sources = source.groupBy("claim_id").agg(*[F.sum((F.col("lag") <= d * DAY).cast("long")).alias(f"s_{d}") for d in days])
    each = F.array(*[F.struct(F.lit(d).alias("win_days"), F.coalesce(f"s_{d}", F.lit(0)).alias("uptake_sources"), *[F.col(f"{k}_{d}").alias(k) for k in kinds]) for d in days])
    out = counts.join(sources, "claim_id", "left").select("claim_id", F.inline(each))
    return out.withColumn("lift", F.when(F.col("uptake_docs") + F.col("topical_docs") > 0, F.col("uptake_docs") / (F.col("uptake_docs") + F.col("topical_docs") + 2.0)).otherwise(0.0))


def influence_score(claims: DataFrame, windows: DataFrame, days: list[int] = INFLUENCE_DAYS) -> DataFrame:
    """(claim_id, influence, sources, attribution_rate, fingerprint_spread) of every claim; 0 where no independent source took it up.

    Breadth of the uptake .45, greatest lift of any window .20, sources in the first window .15, fingerprints .10, share
    of the uptake that names its source .10.
    """
    last, soon = F.col("win_days") == days[-1], F.col("win_days") == days[0]
    at = lambda on, c: F.max(F.when(on, F.col(c))).alias(c if on is last else "soon")
    g = windows.groupBy("claim_id").agg(at(last, "uptake_sources"), at(last, "uptake_docs"), at(last, "attributed_docs"), at(last, "fingerprint_docs"), at(soon, "uptake_sources"), F.max("lift").alias("lift"))
    rows = claims.select("claim_id").join(g, "claim_id", "left").na.fill(0)
    one = F.lit(1.0)
    rate = F.when(F.col("uptake_docs") > 0, F.col("attributed_docs") / F.col("uptake_docs")).otherwise(0.0)
    score = 0.45 * F.least(one, F.log1p("uptake_sources") / F.log1p(F.lit(12.0))) + 0.20 * F.col("lift") + 0.15 * F.least(one, F.col("soon") / 3) + 0.10 * F.least(one, F.col("fingerprint_docs") / 3) + 0.10 * rate
    return rows.select("claim_id", F.when(F.col("uptake_sources") > 0, score).otherwise(0.0).alias("influence"), F.col("uptake_sources").alias("sources"), rate.alias("attribution_rate"), F.col("fingerprint_docs").alias("fingerprint_spread"))


def first_follower(follow: DataFrame) -> DataFrame:
    """(claim_id, doc_id, lead_days): the earliest uptake of each claim by another source, and the days it took."""
    f = follow.where("up").groupBy("claim_id").agg(F.min(F.struct("ts", "doc_id", "days")).alias("f"))
    return f.select("claim_id", F.col("f.doc_id").alias("doc_id"), F.col("f.days").cast("long").alias("lead_days"))


def weighted_mean(value: str, weight: str) -> Column:
    """Σxw / Σw over a group; where all weights are 0 or null the sum is divided by the number of rows, so it is 0."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    return F.sum(F.col(value) * w) / F.when(F.sum(w) == 0, F.count("*").cast("double")).otherwise(F.sum(w))


def ranked_groups(rows: DataFrame, group: list[str], value: str, steps: float = 4096.0) -> DataFrame:
    """(*group, value, k, before, n): each different value of a group, descending, with the rows that have it, those above it, and all.

    Nulls are left out. Equal values collapse map-side; values are ordered within steps of 1/steps, and only the sums of
    steps over the group, so a group of a third of all rows is many tasks' work.
    """
    h = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("k")).withColumn("_step", F.floor(F.col(value) * steps))
    sums = h.groupBy(*group, "_step").agg(F.sum("k").alias("_s"))
    base = sums.withColumn("_base", F.sum("_s").over(Window.partitionBy(*group).orderBy(F.desc("_step"))) - F.col("_s")).withColumn("n", F.sum("_s").over(Window.partitionBy(*group))).drop("_s")
    inner = F.sum("k").over(Window.partitionBy(*group, "_step").orderBy(F.desc(value))) - F.col("k")
    return h.withColumn("_in", inner).join(base, [*group, "_step"]).select(*group, value, "k", (F.col("_in") + F.col("_base")).alias("before"), "n")


def medians(rows: DataFrame, group: list[str], values: dict[str, float]) -> DataFrame:
    """(*group, median_{value} for each): exact medians, the mean of the middle two where they are even in number; values: steps by column."""
    long = F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_x"), F.lit(s).alias("_scale")) for v, s in values.items()])
    h = ranked_groups(rows.select(*group, F.inline(long)).withColumn("_x", F.col("_x") * F.col("_scale")), [*group, "_name", "_scale"], "_x", 1.0)
    hit = lambda at: (F.col("before") <= F.expr(at)) & (F.expr(at) < F.col("before") + F.col("k"))
    mid = h.groupBy(*group, "_name", "_scale").agg(((F.max(F.when(hit("(n - 1) div 2"), F.col("_x"))) + F.max(F.when(hit("n div 2"), F.col("_x")))) / 2).alias("_m"))
    return mid.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == v, F.col("_m") / F.col("_scale"))).alias(f"median_{v}") for v in values])


def source_scores(rows: DataFrame) -> DataFrame:
    """Per source_id: claims, peak, hit_rate, typical, headline, medians of originality, influence and lead, mean coverage, synthesis count.

    rows: (source_id, signal, originality, influence, coverage, lead_days, synthesis) of claims; null sources are left out. peak is the mean
    of the top tenth (one at least), headline .5 peak + .3 hit rate + .2 median.
    """
    rows = rows.where("source_id is not null")
    by = ["source_id"]
    h = ranked_groups(rows, by, "signal").withColumn("_top", F.greatest(F.lit(1), F.expr("n div 10")))
    take = F.greatest(F.lit(0), F.least("k", F.col("_top") - F.col("before")))
    peak = h.groupBy(*by).agg((F.sum(F.col("signal") * take) / F.sum(take)).alias("peak"))
    plain = rows.groupBy(*by).agg(F.count("*").alias("claims"), F.avg(F.when(F.col("signal") >= HIT, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg("coverage").alias("mean_coverage"), F.sum(F.col("synthesis").cast("long")).alias("n_synthesis"))
    mid = medians(rows, by, {"signal": 4096.0, "originality": 4096.0, "influence": 4096.0, "lead_days": 1.0}).withColumnRenamed("median_signal", "typical")
    out = plain.join(peak, by).join(mid, by)
    return out.withColumn("headline", 0.5 * F.col("peak") + 0.3 * F.col("hit_rate") + 0.2 * F.col("typical"))
