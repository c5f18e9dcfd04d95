"""Rows at even strides of their order, found by counting instead of sorting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks counted at once, as a power of two; rows of a block that are ranked with a sort; bits of a block's key taken by each further count.
BLOCKS, RANKED, FINER = 14, 1024, 8


def stride_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows numbered floor(i * n / most), from 0, in the order of a whole-number key that names each row, with place, and nth, their number within the sample; all rows if there are no more than `most`.

    Blocks of the key's range are counted, and the blocks that hold wanted places (`most` of them at most) are
    cut finer and counted again until they are small; only what is left of them is ranked. The rows are read
    once for each count, so they should be written already.
    """
    spark = rows.sparkSession
    n, low, high = rows.agg(F.count(key), F.min(key), F.max(key)).first()
    if n <= most:
        place = F.row_number().over(Window.orderBy(key)) - 1  # `most` rows at most
        return rows.where(F.col(key).isNotNull()).withColumn("place", place.cast("long")).withColumn("nth", F.col("place"))
    wanted = np.unique(np.arange(most, dtype=np.int64) * n // most)
    shift = max(0, int(high - low).bit_length() - BLOCKS)
    inside = rows.withColumn("from__", F.col(key) - F.lit(low)).where("from__ is not null")
    parents: np.ndarray | None = None  # blocks that hold wanted places, and the rows before each
    before: np.ndarray | None = None
    while True:
        block = F.shiftright("from__", shift)
        here = inside
        if parents is not None:
            chosen = spark.createDataFrame([(int(x),) for x in parents], "parent__ long")  # `most` rows at most
            here = inside.join(F.broadcast(chosen), F.shiftright("from__", wider) == F.col("parent__"), "left_semi")
        found = here.groupBy(block.alias("block")).agg(F.count("*").alias("n")).orderBy("block").collect()  # 2^BLOCKS, or `most` times 2^FINER at most
        blocks, sizes = np.array([r["block"] for r in found], np.int64), np.array([r["n"] for r in found], np.int64)
        starts = np.cumsum(sizes) - sizes
        if parents is not None:
            of = np.searchsorted(parents, blocks >> (wider - shift))
            first = np.searchsorted(of, np.arange(len(parents)))
            starts = starts - starts[first][of] + before[of]
        at = np.searchsorted(starts, wanted, side="right") - 1
        hit = np.unique(at)
        parents, before = blocks[hit], starts[hit]
        if shift == 0 or sizes[hit].max() <= RANKED:
            break
        wider, shift = shift, max(0, shift - FINER)
    places = spark.createDataFrame([(int(b), int(w - s), int(w), i) for i, (b, s, w) in enumerate(zip(blocks[at], starts[at], wanted))], "block__ long, own__ long, place long, nth long")  # `most` rows
    chosen = spark.createDataFrame([(int(x),) for x in parents], "parent__ long")
    few = inside.withColumn("of__", F.shiftright("from__", shift)).join(F.broadcast(chosen), F.col("of__") == F.col("parent__"), "left_semi")
    ranked = few.withColumn("rank__", F.row_number().over(Window.partitionBy("of__").orderBy(key)) - 1)
    return ranked.join(F.broadcast(places), (F.col("of__") == F.col("block__")) & (F.col("rank__") == F.col("own__"))).drop("from__", "of__", "rank__", "block__", "own__")


def stride_sample_sql(source: str, key: str, most: int) -> str:
    return f"""(WITH placed AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS place, count(*) OVER () AS n__ FROM ({source}))
      SELECT * EXCLUDE (n__), row_number() OVER (ORDER BY place) - 1 AS nth FROM placed WHERE n__ <= {most} OR place IN (SELECT i * (SELECT max(n__) FROM placed) // {most} FROM range({most}) AS r(i)))"""
