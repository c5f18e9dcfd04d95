"""Operator 10: SimHash near-duplicates through covering locality-sensitive hashing.

Every text gets a 64-bit SimHash of its word shingles. Equal fingerprints collapse to one; the
distinct ones meet in 15 tables. Table v keeps the bits whose class has an odd inner product with
v (4-bit classes 1 to 15 dealt round to the bits): three differing bits span at most three
dimensions, so some v is orthogonal to all of them and the pair collides there. No pair within the
radius is missed, and none is linked without its distance being counted.

Large buckets are not compared pair by pair: their fingerprints are dealt again by a second family
of covering masks, over the bits that the bucket leaves open, and so on, until buckets are small or
so few bits are open that all members link. A level is one job for all large buckets. Buckets emit a
spanning forest of their links, never all pairs.

Defined cases: a null text counts as empty; texts without words get fingerprint zero, linked like
any other; repeated rows and copies share a component; a null doc_id takes part, and a component
without any doc_id has a null id; texts of any length are read whole; columns other than the two named are
not read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut
from tracelake.llm.components import components
from tracelake.session import ship

BITS, CLASS_BITS = 64, 4
RADIUS = CLASS_BITS - 1
#: Members of a bucket up to which each is compared with each, inside one task's memory.
COMPARED = 8192
#: Shingles hashed, and bucket rows compared, at once.
BLOCK = 1 << 20
ALL = (1 << BITS) - 1
LANES = np.uint64(0x0001000100010001)
#: Rows that a 16-bit lane can count.
LANE_ROWS = 60_000


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of all shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, 42)]
    starts, ends, at = [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    return [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits set in over half of each run of hashes; zero for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    # Runs beyond a lane's range are counted in parts.
    parts = [np.arange(s, s + n, LANE_ROWS) for s, n in zip(starts, sizes[full])]
    owner = np.repeat(np.arange(len(full)), [len(p) for p in parts])
    cuts = np.concatenate(parts)
    for bit in range(16):
        packed = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
        for lane in range(4):
            count = (packed >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
            count = np.bincount(owner, weights=count, minlength=len(full))
            out[full] |= (count * 2 > sizes[full]).astype(np.uint64) << np.uint64(16 * lane + bit)
    return out


def fingerprint(text: Column, width: int = 3) -> Column:
    """64-bit SimHash of a text column, as the long of the same bits."""
    ship()

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        done, held, sizes, waiting = [], [], [], 0
        for x in texts:
            h = np.array(shingle_hashes(x.as_py(), width), np.uint64)
            held.append(h)
            sizes.append(len(h))
            waiting += len(h)
            if waiting >= BLOCK:
                done.append(majority(np.concatenate(held), np.array(sizes)))
                held, sizes, waiting = [], [], 0
        done.append(majority(np.concatenate([np.empty(0, np.uint64), *held]), np.array(sizes, np.int64)))
        return pa.array(np.concatenate(done).view(np.int64))

    return prints(text)


def covering_masks(open_bits: list[int]) -> list[int]:
    """15 masks over the open bits: each set of up to three of them is clear in some mask."""
    kind = {bit: 1 + k % 15 for k, bit in enumerate(open_bits)}
    return [sum(1 << bit for bit, c in kind.items() if (c & v).bit_count() % 2) for v in range(1, 16)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def family(level: int) -> list[int]:
    """The masks of a level: as many covering families, over differently ordered bits."""
    order = list(range(BITS))
    if level:
        random.Random(level).shuffle(order)
    return covering_masks(order)


def _deal(rows: DataFrame, level: int) -> DataFrame:
    """Rows (bits, key, fp) of every fingerprint in every table of a level, below the bits fixed before it."""
    masks = F.array(*[F.lit(_signed(m)) for m in family(level)])
    dealt = rows.select("fp", "fixed", F.explode(masks).alias("mask")).select(F.col("fixed").bitwiseOR(F.col("mask")).alias("bits"), "fp")
    if level:  # two ways may fix the same bits
        dealt = dealt.distinct()
    return dealt.select("bits", F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp")


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links between nodes 0 to n - 1, some that connect the same components without a cycle."""
    root = np.arange(n)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*kept)) if kept else (a[:0], b[:0])
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        order = np.lexsort((low, high))
        pick = order[np.r_[True, np.diff(high[order]) > 0]]
        kept.append((a[pick], b[pick]))
        root[high[pick]] = low[pick]
        while (root[root] != root).any():
            root = root[root]


def bucket_links(bits: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within the buckets of rows sorted by (bits, key, fp): pairs of row numbers."""
    n = len(fp)
    new = np.r_[True, (bits[1:] != bits[:-1]) | (key[1:] != key[:-1])] if n else np.empty(0, bool)
    bucket = np.cumsum(new)
    a, b, waiting = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    sizes = np.bincount(bucket)[bucket] if n else bucket
    rows = np.flatnonzero(sizes > 1)
    step = 0
    while len(rows):
        step += 1
        rows = rows[rows + step < n]
        rows = rows[bucket[rows + step] == bucket[rows]]
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + step]) <= radius]
        a.append(near)
        b.append(near + step)
        waiting += len(near)
        if waiting > BLOCK:
            x = spanning(np.concatenate(a), np.concatenate(b), n)
            a, b, waiting = [x[0]], [x[1]], 0
    return spanning(np.concatenate(a), np.concatenate(b), n)


def _within(most: int):
    """Of sorted bucket rows: links (fp, other), and rows (fp, null, bits) of buckets of over `most` rows."""
    names, kinds = ["fp", "other", "bits"], [pa.int64()] * 3

    def out(fp, other, bits):
        return pa.RecordBatch.from_arrays([pa.array(fp, kinds[0]), pa.array(other, kinds[1]), pa.array(bits, kinds[2])], names)

    def compared(bits, key, fp):
        a, b = bucket_links(bits, key, fp.view(np.uint64))
        return out(fp[a], fp[b], np.zeros(len(a), np.int64))

    def large(bits, fp):
        return out(fp, pa.nulls(len(fp), pa.int64()), bits)

    def run(batches):
        held = [np.empty(0, np.int64)] * 3
        spilling = None  # the bucket whose rows go on as they come
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(3)]
            if spilling is not None:
                same = (rows[0] == spilling[0]) & (rows[1] == spilling[1])
                if same.any():
                    yield large(rows[0][same], rows[2][same])
                    rows = [x[~same] for x in rows]
                if not len(rows[0]):
                    continue
                spilling = None
            held = [np.concatenate([h, x]) for h, x in zip(held, rows)]
            bits, key, fp = held
            starts = np.flatnonzero(np.r_[True, (bits[1:] != bits[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[starts, len(fp)])
            last = starts[-1]
            if sizes[-1] > most:
                spilling = (bits[-1], key[-1])
                last = len(fp)
            big = np.repeat(sizes > most, sizes)
            if big[:last].any():
                yield large(bits[:last][big[:last]], fp[:last][big[:last]])
            small = ~big[:last]
            if small.any():
                yield compared(bits[:last][small], key[:last][small], fp[:last][small])
            held = [x[last:] for x in held]
        if len(held[0]):
            yield compared(*held)

    return run


def print_links(prints: DataFrame, compared: int = COMPARED) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within the radius."""
    ship()
    rows, links, level = prints.select("fp", F.lit(0).cast("long").alias("fixed")), [], 0
    while True:
        dealt = _deal(rows, level).repartition("bits", "key").sortWithinPartitions("bits", "key", "fp")
        found = cut(dealt.mapInArrow(_within(compared), "fp long, other long, bits long"), "near")
        links.append(found.where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b")))
        large = found.where("other is null").select("fp", F.col("bits").alias("fixed"))
        if not large.take(1):
            return reduce(DataFrame.unionAll, links)
        few = F.bit_count(F.col("fixed")) >= BITS - RADIUS  # all that agree on these bits link
        stars = large.where(few).select("fp", "fixed", F.col("fp").bitwiseAND(F.col("fixed")).alias("key"))
        hubs = stars.groupBy("fixed", "key").agg(F.min("fp").alias("b"))
        links.append(stars.join(hubs, ["fixed", "key"]).select(F.col("fp").alias("a"), "b"))
        rows, level = large.where(~few), level + 1


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long, component_id) of every row: the smallest id reachable over links of up to three bits."""
    prints = cut(docs.select(F.col(f"`{id}`").alias("id"), fingerprint(F.col(f"`{text}`").cast("string"), width).alias("fp")), "prints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    joined = components(print_links(least.select("fp")))
    ranked = least.join(joined, least["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    own = ranked.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = ranked.join(own, "root").select(F.col("fp").alias("node"), "component_id")
    return prints.join(placed, prints["fp"] == placed["node"]).select(F.col("id").alias(id), "fp", "component_id")
