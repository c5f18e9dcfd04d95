"""How abnormal each source address looks, and why.

One grouping per address with map-side combining, its mean over addresses as a second aggregate of
one row, and a score that adds fixed parts in a fixed order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.iocs import is_private
from tracelake.rules.iocs import PRIVATE
from tracelake.rx import Rx, quoted

ABNORMAL = 0.5
# Agents of tools and robots.
BOTS = Rx(r"sqlmap|nikto|nmap|masscan|curl|python-requests|go-http|bot|scan")


def counts() -> list[Column]:
    """Aggregates of a source address."""
    status = F.col("status_code")
    return [
        F.count("*").alias("requests"),
        F.count_if(status >= 400).alias("errors"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count_if(status.isin(401, 403)).alias("denied"),
        F.count_distinct("url").alias("urls"),
        F.coalesce(F.bool_or(F.col("user_agent").rlike(BOTS.java)), F.lit(False)).alias("robot"),
    ]


def per_source(entries: DataFrame) -> DataFrame:
    """Counts of each source address."""
    return entries.where("source_ip is not null").groupBy("source_ip").agg(*counts())


#: Condition, weight and reason code of each part of the score, in the order in which they are added.
PARTS = (
    ("ratio > 3", 0.28, "volume-high"),
    ("ratio > 1.8 AND ratio <= 3", 0.12, "volume-raised"),
    ("error_rate > 0.5", 0.3, "errors-high"),
    ("error_rate > 0.25 AND error_rate <= 0.5", 0.15, "errors-raised"),
    ("denied >= 5", 0.22, "denied"),
    ("urls >= 20 AND cast(urls AS DOUBLE) / requests > 0.7", 0.18, "many-paths"),
    ("robot", 0.2, "robot-agent"),
)
EXTERNAL = 0.05


def traffic_score(entries: DataFrame) -> DataFrame:
    """One row a source address: counts, score, class, and the reasons."""
    return scored(per_source(entries))


def scored(own: DataFrame) -> DataFrame:
    """The same of the counts of each source address."""
    mean = own.agg(F.avg("requests").alias("mean"))  # one row
    rows = own.join(F.broadcast(mean)).withColumn("ratio", F.col("requests") / F.col("mean")).withColumn("error_rate", F.col("errors") / F.col("requests"))
    parts: list[Column] = [F.when(F.expr(c), F.lit(w)).otherwise(F.lit(0.0)) for c, w, _ in PARTS]
    rows = rows.withColumn("sum__", reduce(lambda a, b: a + b, parts))
    score = F.least(F.lit(1.0), F.col("sum__") + F.when(~is_private(F.col("source_ip")) & (F.col("sum__") > 0), EXTERNAL).otherwise(0.0))
    why = F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(r)) for c, _, r in PARTS])), ",")
    rows = rows.withColumn("score", score)
    return rows.select("source_ip", "requests", "errors", F.round("error_rate", 3).alias("error_rate"), "bytes", "denied", "urls", F.round("score", 3).alias("score"), F.when(F.col("score") >= ABNORMAL, "abnormal").otherwise("normal").alias("class"), F.when(why == "", "nothing-unusual").otherwise(why).alias("reasons"))


def traffic_sql(entries: str) -> str:
    total = " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for c, w, _ in PARTS)
    why = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, _, r in PARTS)
    return f"""WITH own AS (SELECT source_ip, count(*)::BIGINT AS requests, count(*) FILTER (status_code >= 400)::BIGINT AS errors, coalesce(sum(bytes), 0)::BIGINT AS bytes, count(*) FILTER (status_code IN (401, 403))::BIGINT AS denied,
        count(DISTINCT url)::BIGINT AS urls, coalesce(bool_or(regexp_matches(user_agent, {quoted(BOTS.re2)})), false) AS robot FROM ({entries}) WHERE source_ip IS NOT NULL GROUP BY 1),
      rates AS (SELECT *, requests / (SELECT avg(requests) FROM own) AS ratio, errors::DOUBLE / requests AS error_rate FROM own),
      sums AS (SELECT *, {total} AS total FROM rates),
      scored AS (SELECT *, least(1::DOUBLE, total + CASE WHEN NOT regexp_matches(source_ip, {quoted(PRIVATE.re2)}) AND total > 0 THEN {EXTERNAL}::DOUBLE ELSE 0::DOUBLE END) AS raw FROM sums)
      SELECT source_ip, requests, errors, round(error_rate, 3) AS error_rate, bytes, denied, urls, round(raw, 3) AS score, CASE WHEN raw >= {ABNORMAL} THEN 'abnormal' ELSE 'normal' END AS class,
        coalesce(nullif(array_to_string(list_filter([{why}], lambda x: x IS NOT NULL), ','), ''), 'nothing-unusual') AS reasons FROM scored"""
