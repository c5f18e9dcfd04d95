"""Operator 1: mixing sources to target weights by Pfair scheduling.

A source with weight w releases its block k at slot floor(k / w) and has to place it before slot
ceil((k + 1) / w). Serving the released block with the earliest deadline in every slot keeps each
source less than one block from its weight after every slot. Weights are taken exactly, so the
schedule doesn't repeat: the driver walks through it once and keeps the blocks done before each
range of RANGE slots, from which tasks work the ranges out again, and every block finds its slot by
a join. So that this walk doesn't grow with the rows, blocks do: of BLOCK rows until the mix has about
SLOTS slots, and of as many more beyond as keep it so, unless a block's rows are given. Rows are numbered in a shuffled order within their sources by a range partitioning of their
ids, whose partitions split large sources, and the sizes of its pieces; a period can be given, and
then weights are rounded to whole parts of it.

The mix is as long as it takes every row to appear: sources that would run out earlier start over
(column epoch), so no row is left out and weights hold to the end.

Defined cases: a null source is a source of its own; repeated rows, null ids and null texts are
rows like any other; an empty table gives an empty mix; one source alone has weight 1; weights
that name sources without rows are ignored, and sources without a weight raise. Input columns with
the names of output columns are replaced; others are carried along, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut, packed, parallelism, unpacked
from tracelake.session import ship

#: Parts that weights are rounded to by `parts` if no other number is given.
PERIOD = 4096
#: Slots that a task works out.
RANGE = 1 << 15
#: Epochs of a row that are written out together.
ERA = 4096
#: Rows of a block, at least, and slots of a mix, about, from which blocks grow.
BLOCK, SLOTS = 8, 1 << 21
#: Default weights go by this power of the sources' sizes: below 1, small sources weigh more than their share.
POWER = 0.7
OUT = ("epoch", "block", "slot", "position")


def parts(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole parts of a period, one at least, by largest remainders."""
    if not weights:
        return {}
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources; a period of {period} slots holds one of each at most")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights have to be positive")
    total = sum(weights.values())
    free = period - len(weights)
    exact = {s: w / total * free for s, w in sorted(weights.items())}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def exact(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in the very proportion of the weights."""
    if any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("weights have to be positive")
    whole = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[w.denominator for w in whole.values()])
    return {s: int(w * unit) for s, w in whole.items()}


def served(own: list[int], total: int, done: list[int], start: int) -> Iterator[int]:
    """The number of the source served in each slot from `start` on: earliest deadline first among
    released blocks. `done`, the blocks of each source placed before, is kept up to date."""
    waiting: dict[int, list[int]] = {}
    ready: list[tuple[int, int]] = []
    for s, w in enumerate(own):
        waiting.setdefault(max(done[s] * total // w, start), []).append(s)
    slot = start
    while True:
        for s in waiting.pop(slot, ()):
            heapq.heappush(ready, (-(-(done[s] + 1) * total // own[s]), s))
        _, s = heapq.heappop(ready)
        done[s] += 1
        slot += 1
        waiting.setdefault(max(done[s] * total // own[s], slot), []).append(s)
        yield s


def schedule(own: Mapping[str, int], period: int = PERIOD) -> list[str]:
    """The source served in each slot of a period."""
    names = sorted(own)
    return [names[s] for s in islice(served([own[n] for n in names], period, [0] * len(names), 0), period)]


def ranges(own: list[int], total: int, blocks: list[int], size: int) -> list[tuple[int, int, list[int]]]:
    """(first slot, slots, blocks done before) of each range of the mix, which ends with the slot in
    which the last source has shown all its blocks."""
    done, slot, left, out = [0] * len(own), 0, len(own), []
    walk = served(own, total, done, 0)
    while left:
        before, first = list(done), slot
        while left and slot < first + size:
            s = next(walk)
            slot += 1
            left -= done[s] == blocks[s]
        out.append((first, slot - first, before))
    return out


def _slots(own: list[int], total: int):
    def run(batches):
        for batch in batches:
            for first, n, done in zip(*[c.to_pylist() for c in batch.columns]):
                sources, blocks = [], []
                for s in islice(served(own, total, done, first), n):
                    sources.append(s)
                    blocks.append(done[s] - 1)
                yield pa.RecordBatch.from_arrays([pa.array(sources, pa.int32()), pa.array(blocks, pa.int64()), pa.array(range(first, first + n), pa.int64())], ["source__", "block", "slot"])

    return run


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", id: str = "doc_id", block: int | None = None, period: int | None = None, power: float = POWER, ordered: bool = False, row: str | None = None) -> DataFrame:
    """`docs` with epoch, block (number within the source), slot and position in the mix; rows of further epochs repeat.

    If `ordered`, partition k holds the k-th run of positions, in order. `row` names a column that tells rows apart
    whenever `docs` is read, and isn't carried along; without it `docs` is written first, with such a column.
    """
    spark = docs.sparkSession
    ship(spark)
    name = F.when(F.col(f"`{source}`").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")))
    kept = [c for c in docs.columns if c.lower() not in OUT and c != row]
    own_row = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`")
    held = docs.select(packed(kept).alias("own"), name.alias("name__"), F.col(f"`{id}`").alias("id__"), own_row.alias("row__"))
    held = cut(held, "mix") if row is None else held
    rows = held.select("name__", "id__", "row__")
    order = ["name__", F.xxhash64("id__"), "id__", "row__"]
    numbered = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order).select("name__", "row__", F.monotonically_increasing_id().alias("place__"))
    numbered = cut(numbered.withColumn("part__", F.shiftright("place__", 33)), "mix-order")
    pieces = numbered.groupBy("name__", "part__").agg(F.count("*").alias("n"), F.min("place__").alias("first"))
    sizes = {r["name__"]: r["n"] for r in pieces.groupBy("name__").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    given = {n: float(c) ** power for n, c in sizes.items()} if weights is None else {("null" if k is None else f"={k}"): w for k, w in weights.items()}
    if missing := sizes.keys() - given.keys():
        raise ValueError(f"no weight for {sorted(missing)}")
    shares = {n: given[n] for n in sizes}
    parted = exact(shares) if period is None else parts(shares, period)
    names = sorted(sizes)
    own, total = [parted[n] for n in names], sum(parted.values())
    if block is None:
        longest = max((-(-sizes[n] * total // w) for n, w in zip(names, own)), default=0)  # rows of the mix
        block = max(BLOCK, -(-longest // SLOTS))
    walked = ranges(own, total, [-(-sizes[n] // block) for n in names], RANGE)
    length = sum(n for _, n, _ in walked)
    starts = spark.createDataFrame(walked, "first long, n long, done array<long>").repartition(max(1, len(walked)))  # a row for each range
    plan = starts.mapInArrow(_slots(own, total), "source__ int, block long, slot long")
    per_source = [(k, n, sizes[n], -(-length * own[k] * block // (total * sizes[n])) + 1) for k, n in enumerate(names)]
    facts = F.broadcast(spark.createDataFrame(per_source, "source__ int, name__ string, size__ long, epochs__ long"))  # a row for each source
    before = pieces.withColumn("before__", F.sum("n").over(Window.partitionBy("name__").orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("name__", "part__", (F.coalesce("before__", F.lit(0)) - F.col("first")).alias("shift__"))
    placed = numbered.join(before, ["name__", "part__"]).join(facts, "name__")
    # A row of a small source may appear in very many epochs: they are dealt out by eras.
    placed = placed.withColumn("era__", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"epochs__ div {ERA}"))))
    if max((r[3] for r in per_source), default=0) >= ERA:
        placed = placed.repartition("row__", "era__")
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.col("era__") * ERA, F.least(F.col("era__") * ERA + ERA - 1, "epochs__"))))
    placed = placed.withColumn("g__", F.col("epoch") * F.col("size__") + F.col("place__") + F.col("shift__"))
    placed = placed.withColumn("block", F.expr(f"g__ div {block}")).join(plan, ["source__", "block"])
    placed = placed.select("row__", "epoch", "block", "slot", (F.col("slot") * block + F.col("g__") % block).alias("position"))
    out = held.select("own", "row__").join(placed, "row__").select(*unpacked("own", kept), "epoch", "block", "slot", "position")
    if not ordered:
        return out
    runs = parallelism(spark)
    return out.repartitionById(runs, F.expr(f"cast(position * {runs} div {max(1, length * block)} as int)")).sortWithinPartitions("position")

