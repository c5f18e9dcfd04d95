"""Operator 6: Hilbert-curve sharding with DataFrame functions only.

Size (on a log scale), source and language are each quantised to 256 cells, the three-dimensional
Hilbert index of the cell orders the rows, and the order is cut into runs of equal row counts
(law `rows`): runs hold few neighbouring cells, so the least and largest value of each dimension
tell which files a filter can skip. Equal texts of one cell follow each other.

The order is found by a range partitioning over (index, crc32, size, id), which splits a hot cell
by id; a row's rank is its place in its partition plus the sizes of those before.

Defined cases: a null text counts no bytes and has crc32 0; null dimensions are cell 0; repeated
rows take a slot each; ties go by id, nulls first; an empty table gives no rows. With fewer rows
than shards some shards are empty.
Texts of any length are read whole; columns other than the four named are not read, whatever their names.
Equal texts share a Hilbert cell if source and language agree as well, and then their ranks follow each
other; law `rows` cuts shards by rank alone, so a group of equal texts may lie in several shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut, parallelism

SHARDS = 40
LEVELS = 8  # bits of a dimension
DIMS = 3
#: Bytes that a row counts besides its text.
OVERHEAD = 16


def _turn(x: int, by: int) -> int:
    """A DIMS-bit number rotated left."""
    by %= DIMS
    return ((x << by) | (x >> (DIMS - by))) & ((1 << DIMS) - 1)


def curve() -> tuple[list[int], list[int]]:
    """The curve as a machine: for state * 8 + octant, the octant's number on the curve and the next state.

    A state is where the curve enters a cube and along which dimension it leaves; octants are
    numbered by the inverse Gray code after turning the cube to the standard entry.
    """
    full = 1 << DIMS
    gray = [k ^ (k >> 1) for k in range(full)]
    ones = [(~k & (k + 1)).bit_length() - 1 for k in range(full)]  # trailing ones
    number, following = [], []
    for state in range(full * DIMS):
        entry, along = divmod(state, DIMS)
        for octant in range(full):
            w = gray.index(_turn(octant ^ entry, -(along + 1)))
            into = 0 if w == 0 else gray[2 * ((w - 1) // 2)]
            way = 0 if w == 0 else ones[w - 1 if w % 2 == 0 else w] % DIMS
            number.append(w)
            following.append((entry ^ _turn(into, along + 1)) * DIMS + (along + way + 1) % DIMS)
    return number, following


def hilbert(*dims: Column) -> Column:
    """Index of a cell, given LEVELS bits of each dimension."""
    number, following = curve()
    numbers, states = F.array(*map(F.lit, number)), F.array(*map(F.lit, following))
    octants = []
    for bit in reversed(range(LEVELS)):
        parts = [F.shiftleft(F.shiftright(d.cast("int"), bit).bitwiseAND(F.lit(1)), j) for j, d in enumerate(dims)]
        octants.append(parts[0] + parts[1] + parts[2])
    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))

    def step(acc: Column, octant: Column) -> Column:
        at = acc["state"] * (1 << DIMS) + octant
        return F.struct((acc["index"] * (1 << DIMS) + F.get(numbers, at)).alias("index"), F.get(states, at).alias("state"))

    return F.aggregate(F.array(*octants), start, step, lambda acc: acc["index"])


def hashed(name: Column) -> Column:
    """Cell of a name."""
    cells = (1 << LEVELS) - 1
    return F.when(name.isNull(), 0).otherwise(1 + F.crc32(name.cast("string").cast("binary")) % cells)


def log_scaled(size: Column) -> Column:
    """Cell of a size: ten to a doubling."""
    return F.least(F.lit((1 << LEVELS) - 1), F.floor(F.log2(size) * 10)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(id, size, text_crc32, cells of the three dimensions, hilbert, shard, slot) of every row.

    Texts are read once and not moved.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{id}`").alias("id"), (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), hashed(F.col(f"`{source}`")).alias("source_cell"), hashed(F.col(f"`{lang}`")).alias("lang_cell"))
    rows = rows.withColumn("size_cell", log_scaled(F.col("size")))
    rows = rows.withColumn("hilbert", hilbert(F.col("size_cell"), F.col("source_cell"), F.col("lang_cell")))
    order = ["hilbert", "text_crc32", "size", "id"]
    sorted_ = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order).withColumn("place__", F.monotonically_increasing_id())
    held = cut(sorted_.withColumn("part__", F.shiftright("place__", 33)), "shards")
    pieces = held.groupBy("part__").agg(F.count("*").alias("n"), F.min("place__").alias("first"))  # a row for each partition
    to_here = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    shift = pieces.select("part__", (F.coalesce(F.sum("n").over(to_here), F.lit(0)) - F.col("first")).alias("shift__"), F.sum("n").over(all_rows).alias("total__"))
    ranked = held.join(shift, "part__").withColumn("rank__", F.col("place__") + F.col("shift__"))
    placed = ranked.withColumn("shard", F.expr(f"(rank__ * {shards}) div total__").cast("int"))
    first = F.expr(f"(shard * total__ + {shards - 1}) div {shards}")
    return placed.select(F.col("id").alias(id), "size", "text_crc32", "size_cell", "source_cell", "lang_cell", "hilbert", "shard", (F.col("rank__") - first).alias("slot"))


def manifest(sharded: DataFrame) -> DataFrame:
    """Rows, bytes and the range of each dimension's cells of every shard: what a reader prunes files by."""
    ranges = [f(c).alias(f"{k}_{c}") for c in ("size_cell", "source_cell", "lang_cell") for k, f in (("least", F.min), ("most", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), *ranges)
