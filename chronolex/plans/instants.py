"""The published instant of documents in SQL: what the timestamps operator is held against, and the times all dated queries read."""

from chronolex.functions import zones
from chronolex.operators.timestamps import MONTHS

_NAMES = {w: m for m, names in MONTHS.items() for w in names.split()}
_ANY = "|".join(sorted(_NAMES, key=lambda w: (-len(w), w)))
_MAP = lambda d: "MAP {" + ", ".join(f"'{k}': {v}" for k, v in d.items()) + "}"
_ABBR = "|".join(sorted((k for k in zones.ABBREVIATIONS if k != "z"), key=lambda w: (-len(w), w)))
_CLOCKS = _MAP({k: f"'{v}'" for k, v in zones.CLOCKS.items()})

#: common table expressions that end in pub(doc_id, utc): the instant that published_at fixes, or null
INSTANTS = rf"""z0 AS (SELECT doc_id, lower(coalesce(date_provenance, '')) AS prov, m.tz, m.ord, trim(replace(replace(published_at, '−', '-'), chr(160), ' ')) AS v, lower(trim(replace(replace(published_at, '−', '-'), chr(160), ' '))) AS l
  FROM documents LEFT JOIN (SELECT id, max(metadata['tz']) AS tz, max(metadata['date_order']) AS ord FROM sources WHERE id IS NOT NULL GROUP BY id) m ON m.id = source_id),
z1 AS (SELECT *, regexp_extract(v, '([A-Z][A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?)\]?$', 1) AS named, regexp_extract(v, '^(\d{{10}}|\d{{13}}|\d{{16}})(?:\.\d+)?$', 1) AS num,
  regexp_extract(v, '(?:^|[^\d])(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:$|[^\d])', ['y', 'm', 'd']) AS ymd, regexp_extract(v, '^(\d{{4}})(\d\d)(\d\d)(?:T?(\d\d)(\d\d)(\d\d)Z?)?$', ['y', 'm', 'd', 'h', 'i', 's']) AS pk,
  regexp_extract(v, '^(\d{{1,2}})[/.](\d{{1,2}})[/.](\d{{4}}|\d\d)(?:$|[^\d])', ['a', 'b', 'y']) AS num3, regexp_extract(l, '(\d{{1,2}})(?:\.|er)?\s+(?:de\s+)?({_ANY})\.?\s+(?:de\s+)?(\d{{4}})', ['d', 'm', 'y']) AS dmy,
  regexp_extract(l, '(?:^|[^a-zà-ÿ])({_ANY})\.?\s+(\d{{1,2}})(?:,?\s+|\s+\d\d:\d\d:\d\d\s+)(\d{{4}})(?:$|[^\d])', ['m', 'd', 'y']) AS mdy,
  regexp_extract(l, '(\d{{1,2}})[:h](\d\d)(?::(\d\d))?(?:[.,]\d+)?\s*(a\.?m\b|p\.?m\b)?', ['h', 'i', 's', 'ap']) AS clk, regexp_extract(v, ':\d\d(?:[.,]\d+)?\s*([-+])(\d\d):?(\d\d)', ['g', 'h', 'i']) AS off,
  regexp_matches(v, '\d[zZ]$') AS zulu, regexp_extract(l, '[\d.m]\s*\b({_ABBR})$', 1) AS abbr, regexp_extract(l, '\b(et|ct|mt|pt)$', 1) AS clock FROM z0),
z2 AS (SELECT *, CASE WHEN pk.y <> '' THEN [pk.y, pk.m, pk.d] WHEN ymd.y <> '' THEN [ymd.y, ymd.m, ymd.d] WHEN num3.y <> '' THEN CASE WHEN ord = 'mdy' OR (ord IS NULL AND TRY_CAST(num3.b AS INT) > 12) THEN [num3.y, num3.a, num3.b] WHEN ord = 'dmy' OR TRY_CAST(num3.a AS INT) > 12 OR num3.a = num3.b THEN [num3.y, num3.b, num3.a] END
  WHEN dmy.y <> '' THEN [dmy.y, {_MAP(_NAMES)}[dmy.m]::VARCHAR, dmy.d] WHEN mdy.y <> '' THEN [mdy.y, {_MAP(_NAMES)}[mdy.m]::VARCHAR, mdy.d] END AS day,
  CASE WHEN pk.h <> '' THEN [pk.h, pk.i, pk.s] WHEN pk.y = '' AND clk.h <> '' THEN [CASE WHEN clk.ap = '' THEN clk.h ELSE (TRY_CAST(clk.h AS INT) % 12 + CASE WHEN clk.ap[1] = 'p' THEN 12 ELSE 0 END)::VARCHAR END, clk.i, CASE WHEN clk.s = '' THEN '0' ELSE clk.s END] END AS tod FROM z1 WHERE v IS NOT NULL),
z3 AS (SELECT *, try_strptime(concat_ws(' ', CASE WHEN length(day[1]) = 2 THEN '20' || day[1] ELSE day[1] END, day[2], day[3], coalesce(tod[1], '0'), coalesce(tod[2], '0'), coalesce(tod[3], '0')), '%Y %m %d %H %M %S') AS local,
  CASE WHEN named <> '' THEN named WHEN clock <> '' THEN {_CLOCKS}[clock] WHEN prov = 'wp:date_gmt' THEN 'UTC' ELSE coalesce(tz, 'UTC') END AS zone FROM z2),
z4 AS (SELECT *, CAST(epoch(local) AS BIGINT) AS e, CAST(epoch(timezone(zone, local)) AS BIGINT) AS u FROM z3),
pub AS (SELECT doc_id, CASE WHEN num <> '' THEN TRY_CAST(num AS BIGINT) // CASE length(num) WHEN 10 THEN 1 WHEN 13 THEN 1000 ELSE 1000000 END WHEN off.g <> '' THEN e - CASE WHEN off.g = '-' THEN -1 ELSE 1 END * (TRY_CAST(off.h AS INT) * 3600 + TRY_CAST(off.i AS INT) * 60) WHEN zulu THEN e WHEN abbr <> '' THEN e - 60 * {_MAP(zones.ABBREVIATIONS)}[abbr]
  WHEN tod IS NULL THEN list_min(list_filter([u - 3600, u, u + 3600], lambda x: timezone(zone, to_timestamp(x)) = local)) WHEN len(list_filter([u - 3600, u - 1800, u, u + 1800, u + 3600], lambda x: timezone(zone, to_timestamp(x)) = local)) = 1 AND timezone(zone, to_timestamp(u)) = local THEN u END AS utc FROM z4 WHERE num <> '' OR local IS NOT NULL)"""

P3_SQL = rf"WITH {INSTANTS} SELECT doc_id, utc AS published_ts FROM pub JOIN documents USING (doc_id) WHERE utc IS NOT NULL AND NOT regexp_full_match(published_at, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|\+00:00)')"
