"""Parts of texts: the passage that bears most on a claim, chunks of whole paragraphs, and search terms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, LOOK_BACK = 1400, 300


def claim_terms(text: Column, *lists: Column) -> Column:
    """The different lower-case words of more than three letters or digits in a text and lists of texts."""
    none = F.array().cast("array<string>")
    low = F.lower(F.concat_ws(" ", text, *[F.array_join(F.coalesce(x, none), " ") for x in lists]))
    return F.array_distinct(F.filter(F.split(low, "[^a-z0-9]+"), lambda w: F.length(w) > 3))


def best_excerpt(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """rows with `excerpt`: the `width` characters of `text` that hold most of `terms`, from a paragraph's start where one is near.

    Windows begin every max(width div 3, 200) characters; the first of the best wins. It is moved back to after the
    last empty line that starts within LOOK_BACK characters before it. Short texts come whole, a null text is null,
    and without terms the text's head is taken.
    """
    step = max(width // 3, 200)
    last = F.greatest(F.length("text") - width, F.lit(1)) - 1
    # windows are cut once, so that the search for terms runs over them and not over expressions of the text
    windows = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.struct(F.lower(F.substring(F.col("text"), s + 1, F.lit(width))).alias("w"), (-s).alias("back")))
    scored = F.transform(windows, lambda x: F.struct(F.size(F.filter("terms", lambda t: F.contains(x["w"], t))).alias("found"), x["back"].alias("back")))
    whole = (F.length("text") <= width) | (F.size("terms") == 0)
    r = rows.withColumn("_best", F.when(~whole, -F.array_max(scored)["back"]))
    r = r.withColumn("_low", F.greatest(F.col("_best") - LOOK_BACK, F.lit(0)))
    r = r.withColumn("_before", F.substring(F.col("text"), F.col("_low") + 1, F.col("_best") + 1 - F.col("_low")))
    r = r.withColumn("_edge", F.locate("\n\n", F.reverse("_before")))
    start = F.when(F.col("_best").isNull(), 0).when(F.col("_edge") > 0, F.col("_low") + F.length("_before") - F.col("_edge") + 1).otherwise(F.col("_best"))
    return r.withColumn("excerpt", F.substring(F.col("text"), start + 1, F.lit(width))).drop("_best", "_low", "_before", "_edge")


def paragraph_chunks(text: Column, size: int = 60000) -> Column:
    """Array of chunks: paragraphs packed in order, a new chunk where the next would pass `size` characters.

    A longer paragraph is a chunk of its own, so nothing is cut or lost; a null text gives null.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def pack(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        full = (F.length(cur) + F.length(p) + 2 > size) & (cur != "")
        return F.struct(F.when(full, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"), F.when(full | (cur == ""), p).otherwise(F.concat(cur, F.lit("\n\n"), p)).alias("cur"))

    packed = F.aggregate(F.split(text, "\n\n"), start, pack, lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(packed)


def fallback_queries(claims: DataFrame, most: int = 2, stop: list[str] | None = None) -> DataFrame:
    """(id, queries): up to `most` of the first three entities longer than three characters, quoted; without any the first three words of four letters or more that aren't stop words."""
    none = F.array().cast("array<string>")
    named = F.slice(F.filter(F.coalesce("entities", none), lambda e: F.length(e) > 3), 1, min(most, 3))
    stopped = F.array(*[F.lit(w) for w in stop or []]).cast("array<string>")
    words = F.slice(F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)), lambda w: ~F.array_contains(stopped, F.lower(w))), 1, 3)
    plain = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(none)
    return claims.select("id", F.when(F.size(named) > 0, F.transform(named, lambda e: F.concat(F.lit('"'), e, F.lit('"')))).otherwise(plain).alias("queries"))
