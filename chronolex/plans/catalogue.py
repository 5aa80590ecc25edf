"""All queries of the core library by name, and the SQL that says the same."""

from chronolex.operators import timestamps
from chronolex.plans import base, dated, extra, ingest, instants, pages, scores, search, store  # noqa: F401  (the plans register themselves)


def queries() -> dict:
    return base.QUERIES | {"p3_found": timestamps.p3_found}


def oracle_sql() -> dict[str, str]:
    return base.SQL | {"p3_found": instants.P3_SQL}
