"""Severities, worst last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = ("info", "low", "medium", "high", "critical")
RANK = {s: k + 1 for k, s in enumerate(ORDER)}


def rank(severity: Column) -> Column:
    """1 (info) to 5 (critical); 0 for anything else."""
    out = F.lit(0)
    for s, k in RANK.items():
        out = F.when(severity == s, k).otherwise(out)
    return out


def rank_sql(severity: str) -> str:
    return f"CASE {severity} " + " ".join(f"WHEN '{s}' THEN {k}" for s, k in RANK.items()) + " ELSE 0 END"


def worst(severity: Column) -> Column:
    """The worst severity of a group."""
    return F.max_by(severity, rank(severity))


def worst_sql(severity: str) -> str:
    return f"max_by({severity}, {rank_sql(severity)})"
