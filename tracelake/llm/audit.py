"""Operator 13: how filters interact, by a Gray-code walk over the subsets of filters.

Every document gets a mask of the filters that it fails. Documents are counted by part and mask, 32
cells for five filters; that is all that is needed of them. A walk then visits every subset of active
filters in Gray-code order: each step toggles one filter, moves the counter of active failures of the
mask cells that it concerns, and adds or takes the cells whose counter leaves or reaches zero to or
from the running survivors. The survivors of all 32 states are stored, and what any filter removes at
any place of any order is a difference of two of them.

Filters A to D look at a text alone; E compares texts table-wide by two 64-bit hashes and the text's
length. Groups of equal texts are formed with map-side combining, and only those of several documents
are joined back, on the hashes.

Defined cases: a null text counts as empty, a null part as the empty string; a row without an id is a
document without labels, and neither fails E nor makes others fail it; repeated rows count each; a
document is good (toxic) if any of its labels says so; texts of any length are read whole; columns
other than the named ones are not read; a part's rows come whether or not a filter removes
anything; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut
from tracelake.session import ship

WORD, SIGNS = r"[^\x20\x09-\x0D]+", "[#$%&*|]"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
LETTERS = "ABCDE"
#: Parts walked at once.
PARTS = 64
MEASURES = ("n", "good", "toxic")


def states(cells: np.ndarray) -> np.ndarray:
    """Of counts by mask (last axis): the counts that survive each set of active filters, indexed by that set."""
    masks = np.arange(cells.shape[-1])
    failing = np.zeros(len(masks), np.int64)  # active filters that a cell's documents fail
    running = cells.sum(axis=-1)
    out, active = np.empty_like(cells), 0
    out[..., 0] = running
    for step in range(1, len(masks)):
        toggled = step & -step
        active ^= toggled
        hit = (masks & toggled) != 0
        if active & toggled:
            running = running - cells[..., hit & (failing == 0)].sum(axis=-1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            running = running + cells[..., hit & (failing == 0)].sum(axis=-1)
        out[..., active] = running
    return out


def _orders(letters: str) -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and the filter numbers at their places."""
    orders = ["".join(p) for p in permutations(letters)]
    return orders, np.array([[letters.index(x) for x in order] for order in orders])


def _steps(letters: str):
    """Of rows (part, cells): a row for each order and step."""
    orders, at = _orders(letters)
    k = len(letters)
    bit = 1 << at
    after = np.cumsum(bit, axis=1)
    before = after - bit
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                some = batch.slice(start, PARTS)
                cells = np.zeros((3, some.num_rows, 1 << k), np.int64)
                for row, own in enumerate(some.column(1).to_pylist()):
                    for cell in own:
                        cells[:, row, cell["mask"]] = [cell[m] for m in MEASURES]
                left = states(cells)
                lost = left[:, :, before] - left[:, :, after]
                failing = np.stack([cells[0][:, (np.arange(1 << k) >> f & 1) == 1].sum(axis=1) for f in range(k)], axis=1)
                alone = cells[0][:, 1 << np.arange(k)]
                shapley = np.stack([lost[0][:, at == f].sum(axis=1) for f in range(k)], axis=1)
                values = [left[0][:, after], lost[0], failing[:, at] - lost[0], alone[:, at], lost[1], lost[2], shapley[:, at]]
                n = some.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(some.column(0).to_numpy(zero_copy_only=False), len(orders) * k), pa.string()),
                        pa.array(np.tile(np.repeat(orders, k), n), pa.string()),
                        pa.array(np.tile(np.arange(1, k + 1), len(orders) * n), pa.int32()),
                        *[pa.array(v.reshape(-1), pa.int64()) for v in values],
                    ],
                    names,
                )

    return run


def own_failures(text: Column) -> list[Column]:
    """Whether a text (not null) fails each of the filters A to D."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    # The array is made once and handed on, as a column of one element.
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        sizes["n"] < FEWEST_WORDS,
        F.lit(100) * sizes["distinct"] < F.lit(LEAST_DISTINCT) * sizes["n"],
        F.lit(100).cast("long") * capitals > F.lit(MOST_CAPITALS).cast("long") * F.length(text),
        text.rlike(SIGNS),
    ]


def masks(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) of every document: bit f of the mask is set if it fails filter f of LETTERS."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    own = sum((F.when(fails, 1 << f).otherwise(0) for f, fails in enumerate(own_failures(F.col("text")))), F.lit(0))
    marks = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.reverse("text")).alias("b"), F.length("text").alias("n"))
    rows = cut(rows.select("id", "part", own.alias("own"), marks.alias("same")), "filters")
    equal = rows.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    equal = cut(equal.where("n > 1").select("same", "first"), "equal")
    repeats = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return rows.join(equal, "same", "left").select("id", "part", (F.col("own") + F.when(repeats, 1 << 4).otherwise(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled so, by part and mask."""
    marks = labels.groupBy(F.col(f"`{id}`").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    met = masks(docs, id, text, part).join(marks, "id", "left")
    return met.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: what the step keeps and removes, and at what cost."""
    ship(docs.sparkSession)
    found = cells(docs, labels, id, text, part)
    wide = found.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))  # 32 cells at most
    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return wide.mapInArrow(_steps(LETTERS), f"part string, filter_order string, step int, {counts}")
