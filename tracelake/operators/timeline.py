"""Findings in order of time, and the stages they stand for.

Findings may be many, so their order numbers come from a range partitioning, not one sort in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.rules.signatures import PHASE
from tracelake.store import cut, parallelism


def phase(category: Column) -> Column:
    out = F.lit("Discovery")
    for code, name in PHASE.items():
        out = F.when(category == code, name).otherwise(out)
    return out


def phase_sql(category: str) -> str:
    return f"CASE {category} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PHASE.items()) + " ELSE 'Discovery' END"


def numbered(rows: DataFrame, order: list[str], name: str, nulls_last: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with their place, from 1, in an order that names each row.

    The rows are written once and dealt by ranges of the whole order, so rows of one time are split as
    well; a place is the one in the range plus the sizes of the ranges before.
    """
    by = [F.col(c).asc_nulls_last() if c in nulls_last else F.col(c).asc_nulls_first() for c in order]
    dealt = cut(rows, "rows").repartitionByRange(parallelism(rows.sparkSession), *by).sortWithinPartitions(*by)
    held = cut(dealt.withColumn("at__", F.monotonically_increasing_id()).withColumn("part__", F.shiftright("at__", 33)), "numbered")
    sizes = held.groupBy("part__").agg(F.count("*").alias("n__"), F.min("at__").alias("first__"))  # a row for each partition
    before = F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("part__", (F.coalesce(before, F.lit(0)) - F.col("first__") + 1).alias("shift__"))
    return held.join(F.broadcast(shift), "part__").withColumn(name, F.col("at__") + F.col("shift__")).drop("part__", "at__", "shift__")


def timeline(anomalies: DataFrame) -> DataFrame:
    """Findings by time, undated ones last; equal times by line, then rule."""
    rows = numbered(anomalies, ["ts", "line_number", "rule_no", "source_ip"], "place", ("ts",))
    return rows.select("place", "ts", "line_number", "category", phase(F.col("category")).alias("phase"), "severity", "confidence", "source_ip")


def timeline_sql(anomalies: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY ts NULLS LAST, line_number, rule_no, source_ip)::BIGINT AS place, ts, line_number, category, {phase_sql('category')} AS phase, severity, confidence, source_ip FROM ({anomalies})"
