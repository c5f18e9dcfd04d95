"""Near-duplicates by the likeness of shingle sets: exact Jaccard of five-word shingles.

Candidates come from several independent fingerprints of a text: 20 bands of five minima each of
its shingles under different hashes (two texts that are 0.8 alike meet in none with a chance of
0.0004), and the components of operator 10's SimHash over shingles of the same width. No candidate
links without its Jaccard being counted. Texts with the same shingles collapse to one before.

First each member of a bucket (a band or a SimHash component) is held to the bucket's two hubs, its
least and its greatest key, which joins the large groups by few pairs. What is still in different
components of one band is dealt anew, under the rarest of its shingles (a prefix filter, which no
alike pair escapes), held to the hubs of those buckets, and at last, where components still differ,
to each other. So what a band brings together is never left out, and texts that share only what is
common aren't compared. Buckets of over CROWD texts aren't met pair by pair: such texts are grouped by the
crowded buckets that they share, and those outside a group's largest component are compared with all of
the group in blocks of bounded size, by counting the shingles in common, a block of each side a task; a task hands
on one link for each two components. Shingle sets are made for the texts that are compared only.

Defined cases: a null text counts as empty; texts without words are alike; a text of fewer words
than a shingle is one shingle; repeated rows and copies share a component; ties go to the smaller
id; a null id takes part, and a component without any id has a null id. Ids may be structs. Texts of
any length are read whole. Input columns other than the two named are not read. An empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import simhash
from tracelake.llm.common import cut, released
from tracelake.llm.components import components
from tracelake.session import ship

WIDTH, ALIKE = 5, (4, 5)
BANDS, MINIMA = 20, 5
#: Texts in one batch handed back, and shingles hashed anew at once.
ROWS, PART = 128, 2048
#: Texts of a bucket that are met pair by pair; texts, and shingles, of a block of a larger group; different shingles counted at once.
CROWD, BLOCK, BLOCK_GRAMS, COUNTED = 48, 512, 1 << 19, 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SEEDS = np.random.default_rng(5).integers(0, 2**64, BANDS * MINIMA, dtype=np.uint64)[:, None]
_ODD = np.random.default_rng(6).integers(0, 2**64, BANDS * MINIMA, dtype=np.uint64)[:, None] | np.uint64(1)


def bands(own: np.ndarray) -> np.ndarray:
    """A hash for each band of a set's minima; none of an empty set."""
    if not len(own):
        return own
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
    for k in range(0, len(own), PART):
        h = (own[None, k : k + PART] ^ _SEEDS) * _ODD
        least = np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, MINIMA).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return out


def key(own: np.ndarray) -> int:
    """A hash of a whole set."""
    places = np.arange(len(own), dtype=np.uint64)
    return int(np.bitwise_xor.reduce(_mixed(own + _mixed(places + np.uint64(1))))) ^ len(own) if len(own) else 0


def _shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    return [np.array(simhash.shingle_hashes(x.as_py(), width), np.uint64) for x in texts]


def _marks(width: int):
    """Of rows (id, mark, text): (id, mark, key, fp, bands)."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                hashes = _shingles(part.column(2), width)
                fp = simhash.majority(np.concatenate(hashes), np.array([len(h) for h in hashes]))
                own = [np.unique(h) for h in hashes]
                keys = np.array([key(x) for x in own], np.uint64)
                lists = pa.array([bands(x).view(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys.view(np.int64)), pa.array(fp.view(np.int64)), lists], ["id", "mark", "key", "fp", "bands"])

    return run


def _sets(width: int):
    """Of rows (text): (key, grams), the hashes of its different shingles."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                own = [np.unique(h) for h in _shingles(batch.column(0).slice(k, ROWS), width)]
                keys = np.array([key(x) for x in own], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["key", "grams"])

    return run


def _grams(keys: DataFrame, sets: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """(key, grams) of some keys: sets are made again from one text of each, and of no other."""
    marks = cut(sets.join(keys, "key").select("mark"), "used")
    return cut(named.join(marks, "mark", "left_semi").select("text").mapInArrow(released(_sets(width)), "key long, grams array<long>").dropDuplicates(["key"]), "grams")


def _confirmed(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Of pairs of keys (a, b) those whose sets are alike."""
    up, down = ALIKE
    both = pairs.join(grams.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    return cut(both.where(F.col("common") * down >= (F.size("x") + F.size("y") - F.col("common")) * up).select("a", "b"), "alike")


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """Each member of a bucket (bucket, key) with the bucket's least and greatest key, as pairs (a, b), a < b."""
    hubs = buckets.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    held = buckets.join(hubs, "bucket").select("key", F.explode(F.array("low", "high")).alias("hub")).where("hub <> key")
    return cut(held.select(F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b")).distinct(), "tried")


def _open(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """Members, with their roots, of the buckets whose members aren't all in one component."""
    roots = components(links)
    placed = buckets.join(roots, buckets["key"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "key"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return cut(placed.join(several, "bucket"), "open")


def _prefixes(grams: DataFrame) -> DataFrame:
    """(bucket, key, n, at): every set under the rarest of its shingles, as many as two alike sets can't both do without.

    Of a set of n shingles less than n / 5 + 1 can be missing in a set alike to it, so two alike sets
    share one of these, whatever the order, as long as it is the same for all; that by rarity among the
    sets at hand makes buckets small. `at` is the shingle's place in that order.
    """
    up, down = ALIKE
    rows = grams.select("key", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = rows.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = rows.join(often, "gram").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("grams"))
    kept = F.slice("grams", 1, F.expr(f"n - cast(ceil(n * {up} / {down}) as int) + 1"))
    return ranked.select("key", "n", F.posexplode(kept).alias("at", "g")).where("g.often > 1").select(F.col("g.gram").alias("bucket"), "key", "n", "at")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left has in common with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    flat = [np.concatenate(side) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    shared = np.intersect1d(*flat)
    place = [np.searchsorted(shared, x) for x in flat]
    known = [(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == x) if len(shared) else np.zeros(len(x), bool) for p, x in zip(place, flat)]
    order = [np.flatnonzero(k)[np.argsort(p[k], kind="stable")] for k, p in zip(known, place)]
    for start in range(0, len(shared), COUNTED):
        wide = []
        for side in range(2):
            at = place[side][order[side]]
            some = order[side][np.searchsorted(at, start) : np.searchsorted(at, start + COUNTED)]
            m = np.zeros((len(left) if side == 0 else len(right), COUNTED), np.float32)
            m[rows[side][some], place[side][some] - start] = 1
            wide.append(m)
        out += wide[0] @ wide[1].T
    return out


def _blocks(batches):
    """Of rows (cluster, i, j, side, key, root, grams), sorted, side 0 first: links (a, b) of alike sets, one for each two roots."""
    up, down = ALIKE
    now, left, seen = None, [], set()
    for batch in batches:
        marks = np.array([batch.column(c).to_numpy() for c in range(4)]) if batch.num_rows else np.empty((4, 0))
        edges = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0), True]) if batch.num_rows else []
        for start, end in zip(edges, edges[1:]):
            block = tuple(marks[:3, start])
            if block != now:
                now, left, seen = block, [], set()
            for at in range(start, end, BLOCK):
                part = batch.slice(at, min(BLOCK, end - at))
                keys, roots = part.column(4).to_pylist(), part.column(5).to_pylist()
                rows = list(zip(keys, roots, (x.values.to_numpy() for x in part.column(6))))
                if not marks[3, start]:
                    left += rows
                    continue
                both = common_counts([r[2] for r in left], [r[2] for r in rows])
                sizes = [np.array([len(r[2]) for r in side], np.float32) for side in (left, rows)]
                alike = both * (up + down) >= (sizes[0][:, None] + sizes[1]) * up
                found = [(min(left[x][0], rows[y][0]), max(left[x][0], rows[y][0]), frozenset((left[x][1], rows[y][1]))) for x, y in zip(*np.nonzero(alike)) if left[x][1] != rows[y][1]]
                out = []
                for a, b, roots_ in found:
                    if roots_ not in seen:
                        seen.add(roots_)
                        out.append((a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])


def _crowded_links(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """Links (a, b) between the components of rows (bucket, key, n, root) of crowded buckets, that of exact comparison."""
    hubs = rows.groupBy("bucket").agg(F.min("key").alias("hub"))
    groups = components(rows.join(hubs, "bucket").select(F.col("key").alias("a"), F.col("hub").alias("b")))
    keys = rows.select("key", "n", "root").distinct()
    keys = cut(keys.join(groups, keys["key"] == groups["node"]).select("key", "n", keys["root"], groups["root"].alias("cluster")), "crowd")
    per = keys.groupBy("cluster", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    facts = per.groupBy("cluster").agg(F.max(F.struct("rows", "root")).alias("major"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams"))
    minor = per.join(facts.select("cluster", "major"), "cluster").where("root <> major.root").groupBy("cluster").agg(F.sum("rows").alias("few"), F.sum("grams").alias("few_grams"))
    pieces = lambda n, g: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(g) / BLOCK_GRAMS)).cast("long")
    plan = facts.join(minor, "cluster").select("cluster", F.col("major.root").alias("major"), pieces("few", "few_grams").alias("ni"), pieces("rows", "grams").alias("nj"))
    placed = keys.join(cut(plan, "plan"), "cluster")
    mark = F.xxhash64("key")
    one = placed.where("root <> major").select("cluster", F.pmod(mark, F.col("ni")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nj") - 1)).alias("j"), F.lit(0).alias("side"), "key", "root")
    two = placed.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1)).alias("i"), F.pmod(mark, F.col("nj")).alias("j"), F.lit(1).alias("side"), "key", "root")
    both = one.unionAll(two).join(grams, "key").select("cluster", "i", "j", "side", "key", "root", "grams")
    dealt = both.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side")
    return cut(dealt.mapInArrow(released(_blocks), "a long, b long"), "met")


def _grouped(docs: DataFrame, id: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(id, key) of every row, and (key, least id, root) of every distinct set."""
    spark = docs.sparkSession
    ship(spark)
    named = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    named = named.withColumn("mark", F.xxhash64("id", "text"))
    kind = T.StructType([named.schema["id"], *[T.StructField(n, t) for n, t in (("mark", T.LongType()), ("key", T.LongType()), ("fp", T.LongType()), ("bands", T.ArrayType(T.LongType())))]])
    rows = cut(named.select("id", "mark", "text").mapInArrow(released(_marks(width)), kind), "marks")
    sets = cut(rows.groupBy("key").agg(F.min("id").alias("least"), F.min("mark").alias("mark"), F.min("fp").alias("fp")), "sets")
    members = rows.select("key", F.explode("bands").alias("band")).distinct()
    shared = members.groupBy("band").agg(F.count("*").alias("in")).where("in > 1").select("band")
    members = cut(members.join(shared, "band").select(F.struct(F.lit(1).alias("kind"), "band").alias("bucket"), "key"), "bands")
    prints = components(simhash.print_links(sets.select("fp").distinct()))
    looks = sets.join(prints, sets["fp"] == prints["node"], "left").select(F.struct(F.lit(0).alias("kind"), F.coalesce("root", "fp").alias("band")).alias("bucket"), "key")
    tried = _hub_pairs(members.unionAll(looks))
    links = _confirmed(tried, _grams(tried.select(F.explode(F.array("a", "b")).alias("key")).distinct(), sets, named, width))
    grams = _grams(_open(members, links).select("key").distinct(), sets, named, width)
    few = cut(_prefixes(grams), "prefixes")
    again = _hub_pairs(_open(few, links).select("bucket", "key"))
    links = links.unionAll(_confirmed(cut(again.join(tried, ["a", "b"], "left_anti"), "pairs"), grams))
    left = _open(few, links)
    crowds = cut(left.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > CROWD).select("bucket"), "crowds")
    if crowds.take(1):
        links = links.unionAll(_crowded_links(left.join(crowds, "bucket", "left_semi").select("bucket", "key", "n", "root"), grams))
        left = left.join(crowds, "bucket", "left_anti")
    other = left.select("bucket", F.col("key").alias("b"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("at").alias("place"))
    up, down = ALIKE
    # Two sets share no more than the first shingle that they share and what comes after it, in the one order of all.
    most = "least(n - at, m - place)"
    more = left.withColumnRenamed("key", "a").join(other, "bucket").where(f"a < b and root <> other and n * {down} >= m * {up} and m * {down} >= n * {up} and ({most}) * {up + down} >= (n + m) * {up}")
    more = more.select("a", "b").distinct().join(tried.unionAll(again), ["a", "b"], "left_anti")
    joined = components(links.unionAll(_confirmed(cut(more, "pairs"), grams)))
    return rows.select("id", "key"), sets.join(joined, sets["key"] == joined["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, component_id) of every row: the smallest id reachable over pairs that are alike."""
    rows, ranked = _grouped(docs, id, text, width)
    own = ranked.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = ranked.join(own, "root").select("key", "component_id")
    return rows.join(placed, "key").select(F.col("id").alias(id), "component_id")


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The smallest id of each component, in column `id`: texts and their rows are not joined for it."""
    _, ranked = _grouped(docs, id, text, width)
    return ranked.groupBy("root").agg(F.min("least").alias(id)).select(id)
