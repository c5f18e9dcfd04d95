"""Connected components of a graph of links, by alternating star contractions.

Every round joins and groups in Spark; nothing of the graph reaches the driver but one checksum a
round. Rounds are written to the shared folder, and the one before is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut_at, drop


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of links (a > b), again as distinct links (a > b).

    Large: every node hands its larger neighbours to its smallest one. Small: every node hands its
    smaller neighbours and itself to the smallest. The minimum comes from a grouping with
    map-side combining, and joins back as an equi-join whose large keys Spark can split.
    """
    pairs = links.select("a", "b")
    if large:
        pairs = pairs.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low"))
    least = least.select("hub", F.least("hub", "low").alias("low"))
    met = pairs.join(least, pairs["a"] == least["hub"]).select("a", "b", "low")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = out.unionAll(least.select(F.col("hub").alias("a"), F.col("low").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link: root is the smallest node of its component.

    Links may repeat, run either way or join a node to itself; rows with a null end are no links.
    A node without a link to another isn't returned.
    """
    spark = links.sparkSession
    pair = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole"))
    now, path = cut_at(pair.where("whole and a > b").select("a", "b").distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        following, new_path = cut_at(_stars(_stars(now, True), False), "links")
        drop(spark, path)
        now, path = following, new_path
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
