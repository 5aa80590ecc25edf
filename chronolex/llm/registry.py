"""Queries of this subpackage and the SQL that says the same, where SQL can on whole tables."""

from chronolex.llm import boilerplate, history, languages, leakage, mixing, near_duplicates, repeated_lines, subjects


def queries() -> dict:
    return {
        "p1_found": near_duplicates.p1_found,
        "p1_classes": near_duplicates.p1_classes,
        "p2_found": boilerplate.p2_found,
        "p4_found": history.p4_found,
        "p4_batches": history.p4_batches,
        "p5_found": languages.p5_found,
        "p5_languages": languages.p5_languages,
        "p6_found": repeated_lines.p6_found,
        "p6_clean": repeated_lines.p6_clean,
        "p7_found": leakage.p7_found,
        "p7_proximity": leakage.p7_proximity,
        "p8_usage": mixing.p8_usage,
        "p8_shares": mixing.p8_shares,
        "p8_shards": mixing.p8_shards,
        "p9_found": subjects.p9_found,
        "p9_composition": subjects.p9_composition,
    }


def oracle_sql() -> dict[str, str]:
    return {"p6_found": repeated_lines.P6_SQL, "p6_clean": repeated_lines.P6_CLEAN_SQL}
