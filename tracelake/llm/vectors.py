"""Operator 11: near-duplicate vectors through navigable small-world graphs, one a shard.

Equal vectors become one point with a count. Points are dealt to shards by hash, so that a group of
copies spreads over all of them, and a shard holds NUMBERS numbers at most. Each shard builds a
hierarchy of graphs: layer 0 has all its points, each further layer a sixteenth of them. A layer is
built in batches: a batch is searched in the layer so far, its neighbours are chosen so that they
point in different directions (a candidate is left out if it is nearer to a chosen neighbour than to
the point), and links run both ways.

Before it answers, a shard audits itself: points of its own, and probes made at a cosine of exactly the
least that links, are searched and also compared with every point; the beam is doubled until AUDIT of
the true neighbours is found, and beyond WIDEST the shard is compared whole.

Then every point is searched in every shard. What a search finds is verified by cosine in double
precision. A search whose beam is full of links is repeated with a wider beam, and beyond WIDEST
compared with all points of the shard, so that no group is cut off. A task hands on the number of
links of a query, and links that connect what it found (a spanning forest over its shard's points
and its queries), never all pairs; components are united from these.

Searches are approximate: n_links counts what the row's own searches found, every one of them a true
link; the audit bounds what is missed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are their own component (a null id then has a null component); vectors of different
lengths don't link; every row counts as a vector, also if its id or its vector comes again, and equal
vectors link with each other; a row without an id takes part, and a component without any id
has a null id; components of any size are scaled before they are squared; columns other than the two
named are not read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, parallelism
from tracelake.llm.components import components
from tracelake.session import ship

ALIKE = 0.9
#: Links of a point in a layer, the beam while a layer is built, and that of searches, to begin with.
LINKS, BUILD, BEAM, WIDEST = 16, 48, 24, 768
#: Points of a layer that are compared with each other; a layer's share of the one below.
SMALL, THINNED = 512, 16
#: Numbers (components and links of its points) of a shard at most, and the least number of shards.
NUMBERS, SHARDS = 1 << 22, 6
#: Own points and probes of an audit, and the share of their neighbours to be found.
AUDITED, AUDIT = 256, 0.99
#: Queries searched at once, nodes expanded at once by each, and numbers of a block of comparisons.
QUERIES, EXPANDED, BLOCK = 512, 4, 1 << 24
#: What 32-bit cosines may be off.
SLACK = 1e-4


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows (not zero) scaled to length one, without overflow."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _best(ids: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each row, nearest first."""
    k = min(k, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.tile(np.arange(k), (len(near), 1))
    rows = np.arange(len(near))[:, None]
    at = at[rows, np.argsort(-near[rows, at], axis=1, kind="stable")]
    return ids[rows, at], near[rows, at]


class Layer:
    """A graph over the first points of a matrix: a row of neighbours for each, -1 where there are fewer."""

    def __init__(self, points: np.ndarray, links: int = LINKS):
        self.points, self.most = points, 2 * links
        self.near = np.full((len(points), self.most), -1, np.int32)
        self.links = links

    def search(self, queries: np.ndarray, entries: np.ndarray, beam: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nearest `beam` points met among the first `size`, nearest first, -1 where there are fewer; entries: a row of nodes for each."""
        n = len(queries)
        every = np.arange(n)
        seen = np.zeros((n, size + 1), bool)  # the last column is that of no node
        seen[:, size] = True
        width = max(beam, entries.shape[1])
        ids = np.full((n, width), -1, np.int32)
        near = np.full((n, width), -np.inf, np.float32)
        done = np.ones((n, width), bool)
        first = np.sort(np.where(entries < size, entries, entries % size), axis=1)  # the layer above may hold points that aren't there yet
        again = np.c_[np.zeros(n, bool), first[:, 1:] == first[:, :-1]]
        k = entries.shape[1]
        ids[:, :k] = np.where(again, -1, first)
        near[:, :k] = np.where(again, -np.inf, np.einsum("qkd,qd->qk", self.points[first], queries))
        done[:, :k] = again
        seen[every[:, None], first] = True
        live = every
        step = min(EXPANDED, width)
        while len(live):
            waiting = np.where(done[live], -np.inf, near[live])
            at = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
            rows = np.arange(len(live))[:, None]
            open_ = waiting[rows, at] > -np.inf
            some = open_.any(axis=1)
            live, at, open_ = live[some], at[some], open_[some]
            if not len(live):
                break
            done[live[:, None], at] = True
            nodes = np.where(open_, ids[live[:, None], at], -1)
            next_ = np.where(nodes[:, :, None] >= 0, self.near[nodes], -1).reshape(len(live), -1)
            next_[next_ >= size] = -1
            fresh = ~seen[live[:, None], next_]
            next_ = np.where(fresh, next_, -1)
            next_ = -np.sort(-next_, axis=1)  # equal nodes side by side
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            row, col = np.nonzero(next_ >= 0)
            if not len(row):
                continue
            seen[live[row], next_[row, col]] = True
            found = np.full(next_.shape, -np.inf, np.float32)
            found[row, col] = np.einsum("kd,kd->k", self.points[next_[row, col]], queries[live[row]])
            all_ids, all_near = np.concatenate([ids[live], next_], axis=1), np.concatenate([near[live], found], axis=1)
            all_done = np.concatenate([done[live], next_ < 0], axis=1)
            keep = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            rows = np.arange(len(live))[:, None]
            ids[live], near[live], done[live] = all_ids[rows, keep], all_near[rows, keep], all_done[rows, keep]
        return _best(ids, near, beam)

    def chosen(self, of: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of candidates (nearest first) up to `most` for each point that aren't nearer to a chosen one than to it; then the nearest of the rest."""
        out = np.full((len(ids), most), -1, np.int32)
        for start in range(0, len(ids), 1024):
            own, far = ids[start : start + 1024], near[start : start + 1024]
            vectors = self.points[own]
            between = np.einsum("qkd,qjd->qkj", vectors, vectors)
            usable = (own >= 0) & (own != of[start : start + 1024, None])
            picked = np.zeros(own.shape, bool)
            for k in range(own.shape[1]):
                closer = (between[:, k] > far[:, k, None]) & picked
                picked[:, k] = usable[:, k] & ~closer.any(axis=1) & (picked.sum(axis=1) < most)
            # Chosen ones first, then the others, each nearest first.
            order = np.argsort(np.where(picked, 0, np.where(usable, 1, 2)), axis=1, kind="stable")[:, :most]
            rows = np.arange(len(own))[:, None]
            kept = np.where(usable[rows, order], own[rows, order], -1)
            out[start : start + 1024, : kept.shape[1]] = kept
        return out

    def linked(self, new: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        """Links new points with their candidates, both ways; a point of too many links chooses again."""
        own = self.chosen(new, ids, near, self.links)
        self.near[new, : self.links] = own
        row, col = np.nonzero(own >= 0)
        to, source = own[row, col], new[row]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        have = (self.near[targets] >= 0).sum(axis=1)
        fits = have + counts <= self.most
        place = np.arange(len(to)) - np.repeat(first, counts) + np.repeat(have, counts)
        simple = np.repeat(fits, counts)
        self.near[to[simple], place[simple]] = source[simple]
        full = np.flatnonzero(~fits)
        for start in range(0, len(full), 256):
            some = full[start : start + 256]
            width = int(self.most + counts[some].max())
            wide = np.full((len(some), width), -1, np.int32)
            wide[:, : self.most] = self.near[targets[some]]
            for k, t in enumerate(some):
                wide[k, self.most : self.most + counts[t]] = source[first[t] : first[t] + counts[t]]
            apart = np.einsum("qkd,qd->qk", self.points[wide], self.points[targets[some]])
            apart[wide < 0] = -np.inf
            wide, apart = _best(wide, apart, 2 * self.most)
            self.near[targets[some]] = self.chosen(targets[some], wide, apart, self.most)


class Graph:
    """The layers over the points of a shard (32-bit unit vectors), the last one with all of them; points are in an order without meaning."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray] | None = None):
        self.points = points
        sizes = [len(points)]
        while sizes[-1] > SMALL:
            sizes.append(-(-sizes[-1] // THINNED))
        self.layers = []
        for k, size in enumerate(reversed(sizes)):
            layer = Layer(points[:size])
            if layers:
                layer.near = layers[k]
            else:
                self._build(layer)
            self.layers.append(layer)

    def _entries(self, queries: np.ndarray) -> np.ndarray:
        """For each query nodes of the layers so far that are near it; the first nodes if there is none yet."""
        if not self.layers:
            return np.tile(np.arange(min(4, len(self.points)), dtype=np.int32), (len(queries), 1))
        top = self.layers[0].points
        ids, _ = _best(np.tile(np.arange(len(top), dtype=np.int32), (len(queries), 1)), queries @ top.T, 4)
        for layer in self.layers[1:]:
            ids, _ = layer.search(queries, ids, 8, len(layer.points))
        return ids[:, :4]

    def _build(self, layer: Layer) -> None:
        size = len(layer.points)
        done = min(size, SMALL)
        own = np.arange(done, dtype=np.int32)
        ids, near = _best(np.tile(own, (done, 1)), layer.points[:done] @ layer.points[:done].T, BUILD)
        layer.linked(own, ids, near)
        while done < size:
            new = np.arange(done, min(size, done + min(done, 2048)), dtype=np.int32)
            queries = layer.points[new]
            found = [layer.search(queries[k : k + QUERIES], self._entries(queries[k : k + QUERIES]), BUILD, done) for k in range(0, len(new), QUERIES)]
            # Points of one batch may be each other's neighbours.
            beside = _best(np.tile(new, (len(new), 1)), queries @ queries.T, BUILD // 2)
            ids, near = (np.concatenate([np.concatenate([f[x] for f in found]), beside[x]], axis=1) for x in (0, 1))
            layer.linked(new, *_best(ids, near, BUILD))
            done += len(new)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return self.layers[-1].search(queries, self._entries(queries), beam, len(self.points)) if len(self.layers) > 1 else _best(np.tile(np.arange(len(self.points), dtype=np.int32), (len(queries), 1)), queries @ self.points.T, beam)


class Shard:
    """The points of a shard in double precision, their graph, and the beam of its searches (0: compare with all)."""

    def __init__(self, exact: np.ndarray, alike: float = ALIKE, layers: list[np.ndarray] | None = None, beam: int | None = None):
        self.exact, self.alike = exact, alike
        self.graph = Graph(exact.astype(np.float32), layers)
        self.beam = self._audited() if beam is None else beam

    def within(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of the links found, by number."""
        small = queries.astype(np.float32)
        rows, points, wide = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.arange(len(queries))
        n = len(self.exact)
        block = int(max(1, min(QUERIES, BLOCK // max(1, n))))
        while len(wide) and beam and beam <= min(WIDEST, n):
            again = []
            for start in range(0, len(wide), block):
                of = wide[start : start + block]
                ids, near = self.graph.search(small[of], beam)
                likely = near >= self.alike - SLACK
                full = likely.all(axis=1) & (ids.shape[1] < n)
                again.append(of[full])
                row, col = np.nonzero(likely & ~full[:, None])
                rows.append(of[row])
                points.append(ids[row, col].astype(np.int64))
            wide = np.concatenate(again)
            beam *= 4
        for start in range(0, len(wide), block):
            of = wide[start : start + block]
            row, col = np.nonzero(small[of] @ self.graph.points.T >= self.alike - SLACK)
            rows.append(of[row])
            points.append(col)
        row, point = np.concatenate(rows), np.concatenate(points)
        sure = np.zeros(len(row), bool)
        for start in range(0, len(row), 1 << 16):
            part = slice(start, start + (1 << 16))
            sure[part] = np.einsum("kd,kd->k", queries[row[part]], self.exact[point[part]]) >= self.alike
        return row[sure], point[sure]

    def _audited(self) -> int:
        n, dims = self.exact.shape
        rng = np.random.default_rng(n)
        own = rng.permutation(n)[:AUDITED]
        aside = rng.standard_normal((len(own), dims))
        aside -= np.einsum("kd,kd->k", aside, self.exact[own])[:, None] * self.exact[own]
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        at = min(1.0, self.alike + 1e-6)
        probes = np.where(length > 1e-9, at * self.exact[own] + (1 - at * at) ** 0.5 * aside / np.maximum(length, 1e-9), self.exact[own])
        queries = np.concatenate([self.exact[own], probes])
        true = np.bincount(self.within(queries, 0)[0], minlength=len(queries))
        beam = BEAM
        while beam <= min(WIDEST, n):
            met = np.bincount(self.within(queries, beam)[0], minlength=len(queries))
            if (met / np.maximum(true, 1))[true > 0].mean() >= AUDIT:
                return beam
            beam *= 2
        return 0


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


#: Rows that a task hands on at once.
ROWS = 4096
_POINT = "dims int, shard int, place int, key struct<a: bigint, b: bigint>, n long, v array<double>, beam int, near array<int>"


def _runs(batches):
    """Of sorted batches whose first two columns are dims and shard: (dims, shard, table) of each, one at a time."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.array([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        edges = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0), True])
        for a, b in zip(edges, edges[1:]):
            now = int(marks[0, a]), int(marks[1, a])
            if now != key:
                if held:
                    yield *key, pa.Table.from_batches(held).combine_chunks()
                key, held = now, []
            held.append(batch.slice(a, b - a))
    if held:
        yield *key, pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _built(alike: float):
    """Of points (dims, shard, key, n, v) sorted by shard: the same with their place, the shard's beam, and their neighbours in every layer from layer 0 up."""

    def run(batches):
        for dims, shard, table in _runs(batches):
            exact = _matrix(_column(table, "v"))
            own = Shard(unit(exact), alike)
            layers = own.graph.layers[::-1]
            for start in range(0, len(exact), ROWS):
                part = table.slice(start, ROWS)
                n = part.num_rows
                near = [np.concatenate([layer.near[k] for layer in layers if k < len(layer.near)]) for k in range(start, start + n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(start, start + n, dtype=np.int32)), _column(part, "key"), _column(part, "n"), _column(part, "v"), pa.array(np.full(n, own.beam, np.int32)), pa.array(near, pa.list_(pa.int32()))],
                    ["dims", "shard", "place", "key", "n", "v", "beam", "near"],
                )

    return run


def _restored(table: pa.Table, alike: float) -> Shard:
    exact = unit(_matrix(_column(table, "v")))
    near = _column(table, "near")
    flat, ends = near.flatten().to_numpy(), near.offsets.to_numpy()
    ends = ends - ends[0]
    wide = 2 * LINKS
    per = np.diff(ends) // wide
    layers = [flat[ends[:-1][per > k][:, None] + k * wide + np.arange(wide)] for k in range(per.max())]
    return Shard(exact, alike, layers[::-1], int(_column(table, "beam")[0].as_py()))


class Forest:
    """Which points of a shard are known to be connected."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def spanning(self, row: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Of links (query, point) sorted by query, the numbers of some that connect the same: the first of each query, and those that connect more points."""
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
        start = np.repeat(first, np.diff(np.r_[first, len(row)]))
        kept = [first]
        while True:
            a, b = self.root[point[start]], self.root[point]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                return np.unique(np.concatenate(kept))
            high, low = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            high, at = np.unique(high, return_index=True)
            self.root[high] = low[at]
            kept.append(apart[at])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _searched(alike: float):
    """Of the points of a shard (kind 0), then its queries (kind 1): (key, links) and, of links that connect what was found, (key, other)."""
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def out(key, links, other):
        return pa.RecordBatch.from_arrays([key, pa.array(links, pa.int64()), other], ["key", "links", "other"])

    def keys(a, b):
        return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], fields=list(kind))

    def run(batches):
        held: list[pa.RecordBatch] = []
        now, shard = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.array([batch.column(c).to_numpy() for c in range(4)])  # dims, shard, part, kind
            edges = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0), True])
            for start, end in zip(edges, edges[1:]):
                piece = batch.slice(start, end - start)
                if tuple(marks[:3, start]) != now:
                    now, held, shard = tuple(marks[:3, start]), [], None
                if marks[3, start] == 0:
                    held.append(piece)
                    continue
                if shard is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held).combine_chunks()
                    shard, held = _restored(table, alike), []
                    a, b = (_column(table, "key").field(c).to_numpy() for c in ("a", "b"))
                    n, forest = _column(table, "n").to_numpy(), Forest(len(a))
                    del table
                qa, qb = (piece.column(4).field(c).to_numpy() for c in ("a", "b"))
                row, point = shard.within(unit(_matrix(piece.column(6))), shard.beam)
                other = (a[point] != qa[row]) | (b[point] != qb[row])
                row, point = row[other], point[other]
                order = np.argsort(row, kind="stable")
                row, point = row[order], point[order]
                counts = np.bincount(row, weights=n[point], minlength=len(qa)).astype(np.int64)
                some = np.flatnonzero(counts)
                if len(some):
                    yield out(keys(qa[some], qb[some]), counts[some], pa.nulls(len(some), kind))
                kept = forest.spanning(row, point)
                if len(kept):
                    yield out(keys(qa[row[kept]], qb[row[kept]]), np.zeros(len(kept), np.int64), keys(a[point[kept]], b[point[kept]]))

    return run


def _usable(v: Column) -> Column:
    """Whether a vector can link: there, not zero, every component a finite number."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", alike: float = ALIKE) -> DataFrame:
    """(id, n_links, component_id) of every row: how many others it links with, and the smallest id reachable over links."""
    spark = rows.sparkSession
    ship(spark)
    wide = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    named = rows.select(F.col(f"`{id}`").alias("id"), wide.alias("v")).withColumn("usable", _usable(F.col("v")))
    key = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    named = named.select("id", F.when(F.col("usable"), key).alias("key"), F.when(F.col("usable"), F.col("v")).alias("v"))
    points = cut(named.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")), "points")
    total = points.agg(F.sum(F.size("v").cast("long") + 2 * LINKS)).first()[0] or 0
    n_shards = max(SHARDS, -(-total // NUMBERS))
    placed = points.select(F.size("v").alias("dims"), F.pmod("key.a", F.lit(n_shards)).cast("int").alias("shard"), "key", "n", "v")
    dealt = placed.repartition(n_shards, "dims", "shard").sortWithinPartitions("dims", "shard", "key")
    built = cut(dealt.mapInArrow(_built(alike), _POINT), "graphs")
    # Every point is asked of every shard; the queries of a shard are dealt to as many tasks as make use of the cluster.
    parts = max(1, -(-parallelism(spark) // n_shards))
    none = F.lit(None)
    one = built.select("dims", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "key", "n", "v", "place", "beam", "near")
    two = placed.select("dims", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.pmod("key.b", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "key", none.cast("long").alias("n"), "v", none.cast("int").alias("place"), none.cast("int").alias("beam"), none.cast("array<int>").alias("near"))
    both = one.unionAll(two).repartition(n_shards * parts, "dims", "shard", "part").sortWithinPartitions("dims", "shard", "part", "kind", "place")
    found = cut(both.mapInArrow(_searched(alike), "key struct<a: bigint, b: bigint>, links long, other struct<a: bigint, b: bigint>"), "found")
    roots = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    ranked = points.select("key", "least", "n").join(roots, points["key"] == roots["node"], "left").withColumn("root", F.coalesce("root", "key"))
    own = ranked.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = ranked.join(own, "root").join(links, "key", "left").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = named.select("id", "key").join(cut(facts, "facts"), "key", "left")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
