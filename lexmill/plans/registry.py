"""All registered queries of the engine's own operators, with their SQL oracles."""

from __future__ import annotations

from lexmill.plans import language, layout, records, stored, tables, texts

FLAGSHIP = "pair_quality_flags"
ALL = {**texts.QUERIES, **tables.QUERIES, **records.QUERIES, **layout.QUERIES, **language.QUERIES, **stored.QUERIES}


def queries() -> dict:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
