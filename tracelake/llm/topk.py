"""Operator 7: exact top-k by integer inner product, with a KD-tree per shard.

Components become floor(64 * x). Rows with equal vectors share one point (of their ids the k + 1
smallest can matter, no more). Points are dealt to cells by their place among the median splits of a
bounded sample, so that cells have tight boxes, and a cell of many points to several shards by hash.
Each shard builds a KD-tree by median splits along its widest dimension, with the tight bounding box
of every node.

Each query first searches its own shard, which gives it a kth score; then it goes to those other
cells only whose box can reach that score. A box bounds a query's scores by the sum over dimensions of
the larger of q * low and q * high. A shard is searched best first: every query takes the node of the
best bound from its queue, a leaf's scores raise the kth score, other nodes put their children into
the queue, and the search ends when the best bound is below the kth score. Bounds, scores and
comparisons are in whole numbers below 2^52, so the result is exact; vectors with larger components
are searched in Python's integers, without bounds.

Points come first in a shard's stream and queries follow, so that a task holds the points of one
shard and a batch of queries. The driver gets the sample and the boxes of the cells, 2^CELLS at most
for each vector length.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor
do rows without an id; a query meets vectors of its own length only; its own row (by id) is left out;
ties go to the smaller id; fewer than k candidates give fewer rows; repeated rows are candidates each
(of rows of one id, the query's own are left out together); components and scores beyond a long are
held at its ends; columns other than the two named are not read, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut
from tracelake.session import ship

K, EVERY, SCALE = 20, 20, 64
#: Points of a shard, about; points of a leaf, at most; sample of the splits, at most; cells, as a power of two, at most.
SHARD, LEAF, SAMPLE, CELLS = 8192, 256, 20_000, 11
#: Queries searched at once.
BLOCK = 1024
#: Shards of a cell, more than there can be.
PIECES = 1 << 40
LONG = (1 << 63) - 1


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of every component; null if the vector takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.when(x >= 2.0**57, F.lit(LONG)).when(x < -(2.0**57), F.lit(-LONG - 1)).otherwise(F.floor(x * SCALE))
    return F.when(vector.isNotNull() & ~bad, F.transform(wide, whole))


def splits(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Heap-ordered (dimension, median) of the splits of a sample; a point goes right if it is larger."""
    out = [(0, 0)] * (2**depth - 1)
    held = {0: sample}
    for node in range(2**depth - 1):
        rows = held.pop(node)
        if len(rows):
            dim = int((rows.max(axis=0) - rows.min(axis=0)).argmax())
            out[node] = (dim, int(np.median(rows[:, dim])))
        right = rows[:, out[node][0]] > out[node][1] if len(rows) else np.empty(0, bool)
        held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
    return out


class Tree:
    """A KD-tree over the rows of a matrix: leaves are runs of `order`, nodes have tight boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.left: list[int] = []
        self.span: list[tuple[int, int]] = []
        low, high = [], []

        def add(a: int, b: int) -> int:
            rows = points[self.order[a:b]]
            low.append(rows.min(axis=0))
            high.append(rows.max(axis=0))
            self.span.append((a, b))
            self.left.append(-1)
            return len(self.span) - 1

        todo = [add(0, len(points))] if len(points) else []
        while todo:
            node = todo.pop()
            a, b = self.span[node]
            dim = int((high[node] - low[node]).argmax())
            if b - a <= leaf or high[node][dim] == low[node][dim]:
                continue
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(points[self.order[a:b], dim], mid)]
            self.left[node] = add(a, a + mid)
            todo += [self.left[node], add(a + mid, b)]
        self.points = points[self.order].astype(np.float64)
        self.low, self.high = np.array(low, np.float64), np.array(high, np.float64)

    def bounds(self, queries: np.ndarray, nodes: slice | list[int] = slice(None)) -> np.ndarray:
        """No score of a query with a node's point is larger."""
        return np.maximum(queries, 0) @ self.high[nodes].T + np.minimum(queries, 0) @ self.low[nodes].T

    def search(self, queries: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows, and their scores, that can be among the k best: all at or above the kth score found."""
        least = kth.copy()
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
        found = np.full((len(queries), k), -np.inf)
        queue = np.full((len(queries), max(1, len(self.span))), -np.inf)  # the bounds of the nodes that wait
        if len(self.span):
            queue[:, :1] = self.bounds(queries, [0])
        while True:
            node = queue.argmax(axis=1)
            at = queue[np.arange(len(queries)), node]
            live = np.flatnonzero((at >= least) & (at > -np.inf))
            if not len(live):
                break
            queue[live, node[live]] = -np.inf
            for n in np.unique(node[live]):
                some = live[node[live] == n]
                if self.left[n] >= 0:
                    pair = [self.left[n], self.left[n] + 1]
                    queue[some[:, None], pair] = self.bounds(queries[some], pair)
                    continue
                a, b = self.span[n]
                scores = queries[some] @ self.points[a:b].T
                top = np.concatenate([found[some], scores], axis=1)
                found[some] = np.partition(top, top.shape[1] - k, axis=1)[:, -k:]
                least[some] = np.maximum(least[some], found[some].min(axis=1))
                row, col = np.nonzero(scores >= least[some][:, None])
                cuts = np.searchsorted(row, np.arange(len(some) + 1))
                for x, q in enumerate(some):
                    if cuts[x] < cuts[x + 1]:
                        c = col[cuts[x] : cuts[x + 1]]
                        kept[q].append((self.order[a + c], scores[x, c]))
        out = []
        for q, parts in enumerate(kept):
            rows = np.concatenate([np.empty(0, np.int64), *[p[0] for p in parts]])
            scores = np.concatenate([np.empty(0), *[p[1] for p in parts]])
            good = scores >= least[q]
            out.append((rows[good], scores[good]))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _limit(dims: int) -> float:
    """Components below it, in both vectors, give sums below 2^52."""
    return 2.0**26 / dims**0.5


def _large(v: np.ndarray) -> np.ndarray:
    return (np.abs(v.astype(np.float64)) >= _limit(v.shape[1])).any(axis=1)


class Shard:
    """The points of a shard, and their ids."""

    def __init__(self, ids: list[list[int]], points: np.ndarray):
        self.ids, self.raw = ids, points
        self.tree = None if _large(points).any() else Tree(points)

    def best(self, of: list[int], queries: np.ndarray, kth: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query (its id in `of`) up to k pairs (-score, id), best first."""
        out: list[list[tuple[int, int]]] = [[] for _ in of]
        large = _large(queries) if self.tree else np.ones(len(of), bool)
        small = np.flatnonzero(~large)
        if len(small):
            # k + 1: the query's own row may be among the best.
            hits = self.tree.search(queries[small].astype(np.float64), kth[small], k + 1)
            for q, (rows, scores) in zip(small.tolist(), hits):
                out[q] = [(-int(x), i) for r, x in zip(rows.tolist(), scores.tolist()) for i in self.ids[r] if i != of[q]]
        for q in np.flatnonzero(large).tolist():
            scores = self.raw.astype(object) @ queries[q].astype(object)
            held = (max(-LONG - 1, min(LONG, x)) for x in scores)
            out[q] = [(-x, i) for own, x in zip(self.ids, held) for i in own if i != of[q]]
        return [sorted(x)[:k] for x in out]


def _searcher(k: int):
    """Of rows (dims, shard, kind, vec_id, ids, v, kth), sorted: the points (kind 0) of a shard, then its queries (kind 1)."""
    names = ["query_id", "vec_id", "score"]

    def run(batches):
        key, held, shard = None, [], None
        for batch in batches:
            marks = np.array([batch.column(c).to_numpy() for c in range(3)])
            edges = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0), True]) if batch.num_rows else []
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if tuple(marks[:2, a]) != key:
                    key, held, shard = tuple(marks[:2, a]), [], None
                if not marks[2, a]:
                    held.append(part)
                    continue
                if shard is None and held:
                    shard = Shard(list(chain.from_iterable(x.column(4).to_pylist() for x in held)), np.concatenate([_matrix(x.column(5)) for x in held]))
                    held = []
                for at in range(0, part.num_rows if shard else 0, BLOCK):
                    some = part.slice(at, BLOCK)
                    of = some.column(3).to_pylist()
                    kth = np.nan_to_num(some.column(6).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
                    found = shard.best(of, _matrix(some.column(5)), kth, k)
                    rows = [(q, i, -x) for q, best in zip(of, found) for x, i in best]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ([], [], []))], names)

    return run


def _routed(held):
    """Of queries (vec_id, v, dims, shard, kth): a row for each other shard that can hold a score of the kth or more."""

    def run(batches):
        for batch in batches:
            rows: list[np.ndarray] = []
            to: list[np.ndarray] = []
            dims, own = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            kth = np.nan_to_num(batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
            for n in np.unique(dims):
                cells, low, high, pieces = held.value[int(n)]
                who = np.flatnonzero(dims == n)
                q = _matrix(batch.column(1).take(pa.array(who)))
                x = q.astype(np.float64)
                reached = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T >= kth[who][:, None]
                reached |= _large(q)[:, None] | (cells < 0)  # neither large vectors nor the cell of large ones are bounded
                row, cell = np.nonzero(reached)
                n_to = pieces[cell]
                first = np.repeat(cells[cell] * PIECES, n_to) + np.arange(n_to.sum()) - np.repeat(np.cumsum(n_to) - n_to, n_to)
                rows.append(np.repeat(who[row], n_to))
                to.append(first)
            row, shard = np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.int64), *to])
            other = shard != own[row]
            row, shard = row[other], shard[other]
            for at in range(0, len(row), 1 << 14):
                some = batch.take(pa.array(row[at : at + (1 << 14)]))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(shard[at : at + (1 << 14)]), some.column(4)], ["vec_id", "v", "dims", "shard", "kth"])

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("vec_id"), quantised(F.col(f"`{vector}`")).alias("v")).where("vec_id is not null and size(v) > 0")
    # Of equal vectors the k + 1 smallest ids, cut before the shuffle as well as after it.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("n__", nth).where(F.col("n__") <= k + 1)
    points = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dims", F.size("v")), "points")
    n, longest = points.agg(F.count("*"), F.max("dims")).first()
    depth = min(CELLS, (max(1, -(-n // SHARD)) - 1).bit_length())
    sample = np.zeros((0, 1), np.int64)
    if depth:
        part = points.where((F.col("dims") == longest) & (F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))))
        sample = np.array([r["v"] for r in part.select("v").limit(2 * SAMPLE).collect()], np.int64).reshape(-1, longest)  # about SAMPLE rows
    tree = np.array(splits(sample, depth) or [(0, 0)], np.int64)  # 2^CELLS rows at most

    @F.arrow_udf("long")
    def cell(vs: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(vs).to_numpy()
        out = np.zeros(len(vs), np.int64)
        for n_dims in np.unique(sizes):
            who = np.flatnonzero(sizes == n_dims)
            v = _matrix(vs.take(pa.array(who)))
            at = np.zeros(len(who), np.int64)
            if n_dims == longest:
                for _ in range(depth):
                    dim, middle = tree[at].T
                    at = 2 * at + 1 + (v[np.arange(len(v)), dim] > middle)
            out[who] = np.where(_large(v), -1, at)
        return pa.array(out)

    placed = points.withColumn("cell", cell("v"))
    sizes = F.broadcast(placed.groupBy("dims", "cell").agg(F.ceil(F.count("*") / SHARD).cast("long").alias("pieces")))  # a row for each cell
    dealt = placed.join(sizes, ["dims", "cell"]).withColumn("shard", F.col("cell") * PIECES + F.pmod(F.xxhash64("v"), F.col("pieces")))
    dealt = cut(dealt.select("dims", "cell", "pieces", "shard", "v", "ids"), "dealt")
    sides = dealt.select("dims", "cell", "pieces", F.posexplode("v").alias("at", "x")).groupBy("dims", "cell", "pieces", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    boxes: dict[int, list] = {}
    for r in sides.groupBy("dims", "cell", "pieces").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("box")).orderBy("dims", "cell").collect():  # a row for each cell
        boxes.setdefault(r["dims"], []).append((r["cell"], [x["low"] for x in r["box"]], [x["high"] for x in r["box"]], r["pieces"]))
    table = {d: (np.array([b[0] for b in of], np.int64), np.array([b[1] for b in of], np.float64), np.array([b[2] for b in of], np.float64), np.array([b[3] for b in of], np.int64)) for d, of in boxes.items()}
    held = spark.sparkContext.broadcast(table)  # 2 doubles a dimension of each cell

    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    asked = cut(asked.join(dealt.select("v", "dims", "shard"), "v").select("vec_id", "v", "dims", "shard"), "asked")
    shape = "query_id long, vec_id long, score long"

    def met(queries: DataFrame) -> DataFrame:
        none = F.lit(None)
        one = dealt.select(F.col("dims").cast("long"), "shard", F.lit(0).cast("long").alias("kind"), none.cast("long").alias("vec_id"), "ids", "v", none.cast("long").alias("kth"))
        two = queries.select(F.col("dims").cast("long"), "shard", F.lit(1).cast("long").alias("kind"), "vec_id", none.cast("array<long>").alias("ids"), "v", "kth")
        both = one.unionAll(two).repartition("dims", "shard").sortWithinPartitions("dims", "shard", "kind")
        return both.mapInArrow(_searcher(k), shape)

    own = cut(met(asked.withColumn("kth", F.lit(None).cast("long"))), "own")
    seen = own.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    known = asked.join(seen.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", F.col("dims").cast("long").alias("dims"), "shard", "kth")
    rest = met(known.mapInArrow(_routed(held), "vec_id long, v array<long>, dims long, shard long, kth long"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = own.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
