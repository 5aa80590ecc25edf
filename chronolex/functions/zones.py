"""Zone transition tables as arrays, with the version of the zone data they were made from."""

import hashlib
import io
import os
import re
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from importlib import resources
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np

#: fixed values: zone abbreviations and their minutes east of Greenwich
ABBREVIATIONS = {
    "z": 0, "utc": 0, "ut": 0, "gmt": 0, "wet": 0,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180,
    "bst": 60, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "jst": 540, "kst": 540, "sgt": 480, "hkt": 480, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780,
}
#: fixed values: abbreviations that stand for a zone's clock time, whatever the season
CLOCKS = {"et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"}

FROM, TO = 1900, 2101


@lru_cache(1)
def rules() -> tuple[str, dict[str, bytes]]:
    """The release of this machine's zone data, and each zone's file: what the driver sends to every task."""
    files = {}
    for name in sorted(available_timezones()):
        for root in TZPATH:
            path = os.path.join(root, *name.split("/"))
            if os.path.isfile(path):
                with open(path, "rb") as f:
                    files[name] = f.read()
                break
        else:
            at = resources.files("tzdata").joinpath("zoneinfo", *name.split("/"))
            files[name] = at.read_bytes()
    release = ""
    for root in TZPATH:
        for name, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)")):
            path = os.path.join(root, name)
            if not release and os.path.isfile(path):
                with open(path) as f:
                    release = (re.match(pattern, f.readline()) or [""] * 2)[1]
    # data without a release name are told by their content
    digest = hashlib.sha256(b"".join(k.encode() + v for k, v in files.items())).hexdigest()[:12]
    return release or f"sha256:{digest}", files


_given: dict[str, bytes] | None = None


def use(files: dict[str, bytes]) -> None:
    """Makes this process read zones from the given files instead of its own."""
    global _given
    if files is not _given:
        _given = files
        transitions.cache_clear()


@lru_cache(1024)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(instants, offsets): offsets[i] seconds hold from instants[i] on; None for an unknown zone."""
    data = (_given if _given is not None else rules()[1]).get(zone)
    if data is None:
        return None
    tz = ZoneInfo.from_file(io.BytesIO(data), zone)
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    offset = lambda t: int((epoch + timedelta(seconds=t)).astimezone(tz).utcoffset().total_seconds())
    at, end, step = (FROM - 1970) * 31556952, (TO - 1970) * 31556952, 14 * 86400
    instants, offsets = [at], [offset(at)]
    while at < end:
        after = at + step
        if (new := offset(after)) != offsets[-1]:
            lo, hi = at, after
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == offsets[-1] else (lo, mid)
            instants.append(hi)
            offsets.append(new)
        at = after
    return np.array(instants, np.int64), np.array(offsets, np.int64)


def to_utc(local: np.ndarray, zone: str, start_of_day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instants of clock times in a zone, and which are fixed: skipped and repeated clock times aren't.

    start_of_day: these take the first instant of their day instead, which always exists.
    """
    table = transitions(zone)
    if table is None:
        return local, np.zeros(len(local), bool)
    instants, offsets = table
    at = lambda u: offsets[np.maximum(np.searchsorted(instants, u, side="right") - 1, 0)]
    before, after = at(local - 93600), at(local + 93600)
    u, v = local - before, local - after
    u_ok, v_ok = at(u) == before, at(v) == after
    fixed = u_ok & (~v_ok | (u == v)) | (v_ok & ~u_ok)
    out = np.where(u_ok, u, v)
    gap = ~u_ok & ~v_ok
    change = instants[np.maximum(np.searchsorted(instants, local + 93600 - after, side="right") - 1, 0)]
    out = np.where(start_of_day, np.where(gap, change, np.where(u_ok & v_ok, np.minimum(u, v), out)), out)
    return out, fixed | start_of_day
