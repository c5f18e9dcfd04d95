"""All queries of the forensic operators, and their SQL, by name."""

from __future__ import annotations

from tracelake.queries import logs, mft, ml

PARTS = (logs, mft, ml)


def queries() -> dict:
    return {name: query for part in PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
