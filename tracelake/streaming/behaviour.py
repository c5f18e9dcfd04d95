"""Denied and missing requests per source over windows of a stream of entries.

State is one row of counters a source and window; the watermark closes windows and drops what
arrives later than `late`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.detect import AUTH_HIGH, AUTH_LEAST, MISSING_LEAST
from tracelake.rules.signatures import AUTH_FAILURES, ENUMERATION


def windowed_counts(entries: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(window_start, source_ip, requests, errors, denied, missing, bytes) of entries with a ts; streaming or not."""
    rows = entries.where("source_ip is not null and ts is not null")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    status = F.col("status_code")
    per = rows.groupBy(F.window("ts", window).alias("w"), "source_ip").agg(F.count("*").alias("requests"), F.count_if(status >= 400).alias("errors"), F.count_if(status.isin(401, 403)).alias("denied"), F.count_if(status == 404).alias("missing"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return per.select(F.col("w.start").alias("window_start"), "source_ip", "requests", "errors", "denied", "missing", "bytes")


def alerts(counts: DataFrame) -> DataFrame:
    """Windows in which a source passes a threshold: (window_start, source_ip, category, n, severity)."""
    found = F.array_compact(
        F.array(
            F.when(F.col("denied") >= AUTH_LEAST, F.struct(F.lit(AUTH_FAILURES).alias("category"), F.col("denied").alias("n"), F.when(F.col("denied") >= AUTH_HIGH, "high").otherwise("medium").alias("severity"))),
            F.when(F.col("missing") >= MISSING_LEAST, F.struct(F.lit(ENUMERATION).alias("category"), F.col("missing").alias("n"), F.lit("medium").alias("severity"))),
        )
    )
    return counts.select("window_start", "source_ip", F.explode(found).alias("a")).select("window_start", "source_ip", "a.*")
