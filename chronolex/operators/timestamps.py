"""Timestamps of many formats and zones as epoch seconds.

A value's shape has one class per character: digits, letters, and each other character as it is. All
values of a shape have their numbers and words in the same columns, so a shape's parser is made once and
its values are converted as columns of a character matrix. Words take part by their role only (month,
half of the day, zone, anything else), looked up once per distinct word.
"""

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions import zones

#: fixed values: month names and abbreviations in en, fr, de, es, pt
MONTHS = {
    1: "january jan janvier janv januar jänner enero ene janeiro",
    2: "february feb février fevrier févr fevr februar febrero fevereiro fev",
    3: "march mar mars märz maerz mär marzo março marco",
    4: "april apr avril avr abril abr",
    5: "may mai mayo maio",
    6: "june jun juin juni junio junho",
    7: "july jul juillet juil juli julio julho",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setembro set",
    10: "october oct octobre oktober okt octubre outubro out",
    11: "november nov novembre noviembre novembro",
    12: "december dec décembre decembre déc dezember dez diciembre dic dezembro",
}
_MONTH = {w: m for m, names in MONTHS.items() for w in names.split()}
_ZONE = re.compile(r"\[?\b([A-Za-z]+(?:/[A-Za-z_]+(?:[-+][A-Za-z_0-9]+)*)+)\]?|\[([A-Za-z]+)\]")
_TOKEN = re.compile(r"9+|a+|.", re.DOTALL)
#: epoch numbers by digits: seconds, milli-, micro- and nanoseconds
_EPOCH = {9: 1, 10: 1, 12: 1000, 13: 1000, 16: 10**6, 19: 10**9}


def _shape(codes: np.ndarray) -> np.ndarray:
    """Character classes: 9 for digits, a for letters, itself for the rest."""
    digit = (codes >= 48) & (codes <= 57)
    low = codes | 32
    letter = ((low >= 97) & (low <= 122)) | ((codes >= 0xC0) & (codes <= 0x24F) & (codes != 0xD7) & (codes != 0xF7))
    return np.where(digit, np.uint32(57), np.where(letter, np.uint32(97), codes))


@lru_cache(65536)
def _layout(shape: str) -> tuple[tuple[str, int, int], ...]:
    return tuple((m[0], m.start(), m.end()) for m in _TOKEN.finditer(shape))


def _role(word: str) -> tuple[str, int]:
    word = word.lower()
    if word in _MONTH:
        return "M", _MONTH[word]
    if word in ("am", "pm"):
        return "P", int(word == "pm")
    if word in ("t", "h"):
        return word.upper(), 0
    if word in zones.ABBREVIATIONS:
        return "Z", zones.ABBREVIATIONS[word]
    if word in zones.CLOCKS:
        return "C", list(zones.CLOCKS).index(word)
    return "w", 0


@lru_cache(65536)
def _plan(shape: str, roles: str) -> dict | None:
    """Which tokens hold which part, for a shape and the roles of its words; None if there's no full date."""
    tokens, k = [], 0
    for text, a, b in _layout(shape):
        if text[0] == "9":
            tokens.append(("9" * (b - a), a, b))
        elif text[0] == "a":
            if roles[k] != "w":
                tokens.append((roles[k], a, b, k))
            k += 1
        else:
            tokens.append((text, a, b))
    # one character per token (a number shows its length as a letter from A for one digit), for matching
    line = "".join(chr(0x100 + len(t[0])) if t[0][0] == "9" else t[0] for t in tokens)
    n1, n2, n4 = "[āĂ]", "Ă", "Ą"
    num = "[ā-ƀ]"
    out: dict = {}
    put = lambda m, **names: out.update({k: tokens[m.start(g)] for k, g in names.items() if m.start(g) >= 0})
    bare = re.fullmatch(rf"\s*({num})(?:\.{num})?\s*", line)
    if bare and (n := len(tokens[bare.start(1)][0])) in _EPOCH and not roles.strip("w"):
        return {"epoch": tokens[bare.start(1)], "unit": _EPOCH[n]}
    # time of day: 9:99, 9:99:99, 9:99:99.9..., 9h99
    clock = re.search(rf"(?<!{num})({n1})[:H]({n2})(?::({n2})(?:[.,]{num})?)?(?!{num})", line)
    if clock:
        put(clock, hour=1, minute=2, second=3)
        rest = line[: clock.start()] + "\x00" * (clock.end() - clock.start()) + line[clock.end() :]
        zone = re.compile(rf"\s*P?\s*,?\s*([-+])({n2}):?({n2})?(?!{num})|\s*P?\s*,?\s*([-+])({n4})").match(line, clock.end())
        if zone:
            put(zone, **({"sign": 1, "zh": 2, "zm": 3} if zone.start(1) >= 0 else {"sign": 4, "zhm": 5}))
            rest = rest[: zone.start()] + "\x00" * (zone.end() - zone.start()) + rest[zone.end() :]
    else:
        rest = line
    # the date
    day = [
        (re.search(rf"(?<!{num})({n4})([-/.])({n1})\2({n1})(?!{num})", rest), {"year": 1, "month": 3, "day": 4}),
        (re.search(rf"(?<!{num})({n1})([-/.])({n1})\2({n4}|{n2})(?!{num})", rest), {"first": 1, "then": 3, "year": 4}),
        (re.search(rf"(?<!{num})({n1})[\s.\-/]*M[\s.,\-/]*({n4})(?!{num})", rest), {"day": 1, "year": 2}),
        (re.search(rf"M[\s.\-]*({n1})[\s,]+({n4})(?!{num})", rest), {"day": 1, "year": 2}),
        (re.search(rf"M[\s.]*({n1})\s*\x00+\s*[ZC]?\s*({n4})(?!{num})", rest), {"day": 1, "year": 2}),
    ]
    found = [(m, names) for m, names in day if m]
    packed = re.search("(?<![ā-ƀ])([ĈČĎ])(?![ā-ƀ])(?:T([ĄĆ])(?:[.,][ā-ƀ])?)?", rest) if not found else None
    if found:
        put(found[0][0], **found[0][1])
        if "M" in rest and "month" not in out and "first" not in out:
            if rest.count("M") != 1:
                return None
            out["named"] = tokens[rest.index("M")][3]
    elif packed:
        put(packed, packed=1, packed_time=2)
        zone = re.compile(rf"\s*([-+])({n2}):?({n2})?(?!{num})|\s*([-+])({n4})").match(line, packed.end())
        if zone:
            put(zone, **({"sign": 1, "zh": 2, "zm": 3} if zone.start(1) >= 0 else {"sign": 4, "zhm": 5}))
    else:
        return None
    for role, name in (("P", "half"), ("Z", "abbreviation"), ("C", "clock")):
        at = [t[3] for t in tokens if t[0] == role]
        if len(at) > 1 and role != "Z":
            return None
        if at:
            out[name] = at[-1]
    return out


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since the epoch of calendar dates, and which dates exist."""
    month = (y - 1970) * 12 + m - 1
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    first = month.astype("M8[M]").astype("M8[D]").astype(np.int64)
    after = (month + 1).astype("M8[M]").astype("M8[D]").astype(np.int64)
    return first + d - 1, ok & (d <= after - first)


def _convert(values: list, provenance: list, tz: list, order: list) -> tuple[np.ndarray, np.ndarray]:
    """Epoch seconds of each value, and which values fix an instant."""
    n = len(values)
    out, fixed = np.zeros(n, np.int64), np.zeros(n, bool)
    text, named = [], [None] * n
    for i, v in enumerate(values):
        v = v or ""
        if "/" in v or "[" in v:
            m = _ZONE.search(v)
            if m and ((m[1] or m[2]).lower() in zones.ABBREVIATIONS or zones.transitions(m[1] or m[2]) is not None):
                named[i] = m[1] or m[2]
                v = v[: m.start()] + v[m.end() :]
        if "." in v and ("m." in v or "M." in v):
            v = re.sub(r"\b([aApP])\.\s?[mM]\.", r"\1m", v)
        text.append(v.replace("−", "-").replace("–", "-").replace(" ", " ").strip())
    length = np.array([len(v) for v in text])
    for size in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == size)
        codes = np.frombuffer("".join([text[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), size)
        shape = np.ascontiguousarray(_shape(codes)).view(f"U{size}").ravel() if codes.max() < 0x110000 else None
        kinds, which = np.unique(shape, return_inverse=True)
        for k, kind in enumerate(kinds):
            at = np.flatnonzero(which == k)
            _convert_shape(kind.ljust(size, "\0"), codes[at], rows[at], named, provenance, tz, order, out, fixed)
    return out, fixed


def _convert_shape(shape, codes, rows, named, provenance, tz, order, out, fixed):
    """Converts the values of one shape: codes has a row for each."""
    spans = [(a, b) for t, a, b in _layout(shape) if t[0] == "a"]
    role_of, value_of = np.zeros((len(rows), len(spans)), "U1"), np.zeros((len(rows), len(spans)), np.int64)
    for s, (a, b) in enumerate(spans):
        words, at = np.unique(np.ascontiguousarray(codes[:, a:b]).view(f"U{b - a}").ravel(), return_inverse=True)
        roles = [_role(str(w)) for w in words]
        role_of[:, s] = np.array([r for r, _ in roles])[at]
        value_of[:, s] = np.array([v for _, v in roles])[at]
    signature = role_of.view(f"U{len(spans)}").ravel() if spans else np.full(len(rows), "")
    for roles in np.unique(signature):
        on = np.flatnonzero(signature == roles)
        plan = _plan(shape, str(roles))
        if plan is not None:
            _convert_plan(plan, codes[on], value_of[on], rows[on], named, provenance, tz, order, out, fixed)


def _convert_plan(plan, codes, words, rows, named, provenance, tz, order, out, fixed):
    def number(token, lo=0, hi=None):
        a, b = token[1], token[2]
        v = np.zeros(len(rows), np.int64)
        for c in range(a + lo, b if hi is None else a + hi):
            v = v * 10 + (codes[:, c].astype(np.int64) - 48)
        return v

    zero = np.zeros(len(rows), np.int64)
    if "epoch" in plan:
        out[rows], fixed[rows] = number(plan["epoch"]) // plan["unit"], True
        return
    ok = np.ones(len(rows), bool)
    hour, minute, second = (number(plan[k]) if k in plan else zero for k in ("hour", "minute", "second"))
    timed = "hour" in plan
    if "packed" in plan:
        p = plan["packed"]
        year, month, day = number(p, 0, 4), number(p, 4, 6), number(p, 6, 8)
        digits = p[2] - p[1]
        if digits >= 12:
            hour, minute, timed = number(p, 8, 10), number(p, 10, 12), True
            second = number(p, 12, 14) if digits == 14 else zero
        elif "packed_time" in plan:
            q = plan["packed_time"]
            hour, minute, timed = number(q, 0, 2), number(q, 2, 4), True
            second = number(q, 4, 6) if q[2] - q[1] == 6 else zero
    else:
        year = number(plan["year"])
        if plan["year"][2] - plan["year"][1] == 2:
            year = year + 2000
        if "first" in plan:
            a, b = number(plan["first"]), number(plan["then"])
            kind = np.array([order[i] or "" for i in rows])
            both = (a <= 12) & (b <= 12) & (a != b)
            mdy = (kind == "mdy") | ((kind != "dmy") & (a <= 12) & (b > 12))
            ok &= (kind == "mdy") | (kind == "dmy") | ~both
            month, day = np.where(mdy, a, b), np.where(mdy, b, a)
        else:
            month = number(plan["month"]) if "month" in plan else words[:, plan["named"]]
            day = number(plan["day"])
    if "half" in plan and timed:
        ok &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * words[:, plan["half"]]
    days, real = _days(year, month, day)
    ok &= real & (hour < 24) & (minute < 60) & (second < 60)
    local = days * 86400 + hour * 3600 + minute * 60 + second
    if "sign" in plan:
        h, m = (number(plan["zhm"]) // 100, number(plan["zhm"]) % 100) if "zhm" in plan else (number(plan["zh"]), number(plan["zm"]) if "zm" in plan else zero)
        sign = np.where(codes[:, plan["sign"][1]] == 45, -1, 1)
        out[rows], fixed[rows] = local - sign * (h * 3600 + m * 60), ok & (h < 24) & (m < 60)
        return
    if "abbreviation" in plan:
        out[rows], fixed[rows] = local - words[:, plan["abbreviation"]] * 60, ok
        return
    names = list(zones.CLOCKS.values())
    zone = np.array([named[i] or (names[words[j, plan["clock"]]] if "clock" in plan else None) or ("UTC" if (provenance[i] or "").lower() == "wp:date_gmt" else tz[i]) or "UTC" for j, i in enumerate(rows)])
    for name in np.unique(zone):
        at = np.flatnonzero(zone == name)
        if name.lower() in zones.ABBREVIATIONS:
            u, settled = local[at] - 60 * zones.ABBREVIATIONS[name.lower()], np.ones(len(at), bool)
        else:
            u, settled = zones.to_utc(local[at], str(name), np.full(len(at), not timed))
        out[rows[at]], fixed[rows[at]] = u, ok[at] & settled


def instants(spark: SparkSession):
    """A column function of (value, provenance, tz, date_order) that gives epoch seconds, for use in any projection.

    The zone files of the driver are sent along, so all tasks follow one release of the zone rules.
    """
    sent = spark.sparkContext.broadcast(zones.rules()[1])

    @F.pandas_udf("long")
    def instant(value: pd.Series, provenance: pd.Series, tz: pd.Series, order: pd.Series) -> pd.Series:
        zones.use(sent.value)
        lists = [x.astype(object).where(x.notna(), None).tolist() for x in (value, provenance, tz, order)]
        ts, fixed = _convert(*lists)
        return pd.Series(pd.array(ts, dtype="Int64")).where(pd.Series(fixed), pd.NA)

    return instant


def known_clocks(sources: DataFrame) -> DataFrame:
    """(_source, _tz, _order) by source: the metadata of repeated ids count once, the largest value if they differ."""
    return sources.where("id is not null").groupBy(F.col("id").alias("_source")).agg(F.max(F.col("metadata")["tz"]).alias("_tz"), F.max(F.col("metadata")["date_order"]).alias("_order"))


def normalised_timestamps(docs: DataFrame, sources: DataFrame, id_col: str = "doc_id", value_col: str = "published_at", provenance_col: str = "date_provenance", source_col: str = "source_id", confidence_col: str | None = None) -> DataFrame:
    """(id_col, published_ts, precision, zone_rules): epoch seconds in UTC of each row's value, null where it doesn't fix one instant.

    An offset, zone name or abbreviation in the value holds; else UTC for the provenance wp:date_gmt;
    else the `tz` of the source's metadata; else UTC. All-numeric dates whose year doesn't lead follow the
    source's `date_order`; where that is unknown, only dates with one reading count. Dates without a
    time are the start of their day. Null, partial and impossible values, and clock times that their
    zone skips or has twice, give null. Every row gives a row, repeated ids included; the metadata of
    repeated sources count once (the largest value if they differ).

    precision: `day` for values without a time of day, else `second`, null without an instant. zone_rules: the
    release of the zone data. With confidence_col a fifth column, `confidence`, has the stated confidence
    corrected to what the value bears: null without an instant, `day` instead of `exact` for a bare date.
    Sources are joined by id (the adaptive planner broadcasts them when small); nothing else is shuffled.
    """
    spark = docs.sparkSession
    told = [F.lower(F.trim(confidence_col)).alias("_told")] if confidence_col else []
    rows = docs.select(F.col(id_col).alias("_id"), F.col(value_col).alias("_value"), F.col(provenance_col).alias("_provenance"), F.col(source_col).alias("_source"), *told)
    ts = instants(spark)("_value", "_provenance", "_tz", "_order")
    clock = F.col("_value").rlike(r"[0-9]:[0-9]{2}|[0-9]h[0-9]{2}|[0-9]T[0-9]|^\s*[0-9.]{9,}Z?\s*$")
    out = rows.join(known_clocks(sources), "_source", "left").select("_id", ts.alias("published_ts"), clock.alias("_clock"), *(["_told"] if told else []))
    has = F.col("published_ts").isNotNull()
    columns = [F.col("_id").alias(id_col), "published_ts", F.when(has, F.when(F.col("_clock"), "second").otherwise("day")).alias("precision"), F.lit(zones.rules()[0]).alias("zone_rules")]
    if told:
        columns.append(F.when(has, F.when((F.col("_told") == "exact") & ~F.col("_clock"), "day").otherwise(F.col("_told"))).alias("confidence"))
    return out.select(*columns)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "published_at", "date_provenance", "source_id")
    plain = F.col("published_at").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|\+00:00)\z")
    return normalised_timestamps(docs.where("published_at is not null").where(~plain), spark.read.parquet(f"{sf}/sources.parquet")).where("published_ts is not null").select("doc_id", "published_ts")
