"""Isolation forest over a bounded sample, and the score of every row.

A tree needs LEAVES rows and the forest TREES of them, so it grows from a sample at even strides (SAMPLE rows at
most) and every row is scored. The numbers it draws are of one seeded stream: each tree has a stretch
of it, with a place for every row and every node, so that trees and nodes don't wait for each other
and the same forest grows in any engine. Features are rounded before, for the same reason.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.random import uniform, uniform_sql
from tracelake.operators.strides import stride_sample
from tracelake.session import ship

TREES, LEAVES, SAMPLE, LEAST = 100, 256, 5000, 5
EULER = 0.5772156649
DIGITS = 6
#: Numbers of a tree's stretch for its nodes, two each; the rows follow.
NODES = 1024


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


class Forest:
    """Trees as arrays by node: the root is 1, the children of k are 2k (less than the value) and 2k + 1; feature -1 is a leaf, whose path length counts."""

    def __init__(self, rows: np.ndarray, seed: int, trees: int = TREES, leaves: int = LEAVES):
        self.size = min(leaves, len(rows))
        self.scale = expected_path(self.size) or 1.0
        self.depth = math.ceil(math.log2(max(2, self.size)))
        n_trees, n_nodes = (trees if len(rows) else 0), 2 << self.depth
        self.feature, self.value, self.path = np.full((n_trees, n_nodes), -1), np.zeros((n_trees, n_nodes)), np.zeros((n_trees, n_nodes))
        for tree in range(n_trees):
            self._grow(tree, rows, seed)

    def _grow(self, tree: int, rows: np.ndarray, seed: int) -> None:
        start = tree * (len(rows) + NODES)
        drawn = uniform(seed, start + NODES + np.arange(len(rows)))
        numbers = uniform(seed, start + np.arange(NODES))
        own = rows[np.argsort(drawn, kind="stable")[: self.size]]
        at = np.ones(len(own), int)
        for depth in range(self.depth + 1):
            for node in np.unique(at[at >> depth == 1]):
                here = own[at == node]
                low, high = here.min(axis=0), here.max(axis=0)
                usable = np.flatnonzero(high > low)
                if depth == self.depth or not len(usable):
                    self.path[tree, node] = depth + expected_path(len(here))
                    continue
                f = usable[int(numbers[2 * node] * len(usable))]
                v = low[f] + numbers[2 * node + 1] * (high[f] - low[f])
                self.feature[tree, node], self.value[tree, node] = f, v
                at[at == node] = 2 * node + (here[:, f] >= v)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; near 0.5 is ordinary."""
        if not len(self.feature) or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for feature, value, path in zip(self.feature, self.value, self.path):
            node = np.ones(len(rows), int)
            for _ in range(self.depth):
                f = feature[node]
                inner = np.flatnonzero(f >= 0)
                at = node[inner]
                node[inner] = 2 * at + (rows[inner, f[inner]] >= value[at])
            total += path[node]
        return 2 ** (-total / len(self.feature) / self.scale)


def scored(df: DataFrame, names: tuple[str, ...], key: str, seed: int, out: str = "score") -> DataFrame:
    """`df` (written already: it is read several times) with the isolation score of its feature columns; at least LEAST rows are needed, else 0."""
    spark = df.sparkSession
    ship(spark)
    rounded = [F.round(F.col(n).cast("double"), DIGITS).alias(n) for n in names]
    sample = stride_sample(df.select(key, *rounded), key, SAMPLE).orderBy("nth").collect()  # SAMPLE rows at most
    rows = np.array([[r[n] for n in names] for r in sample], float).reshape(-1, len(names))
    held = spark.sparkContext.broadcast(Forest(rows if len(rows) >= LEAST else rows[:0], seed))  # TREES trees of 2 * LEAVES nodes at most

    @F.arrow_udf("double")
    def score(features: pa.Array) -> pa.Array:
        return pa.array(held.value.score(features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)))

    return df.withColumn(out, score(F.array(*rounded)))


def scored_sql(source: str, names: tuple[str, ...], sampled: str, seed: str) -> str:
    """`source` with `score` for DuckDB, from `sampled` (nth, and the features) and a seed: trees level by level, then walked by all rows."""
    depths = math.ceil(math.log2(LEAVES))
    listed = "[" + ", ".join(f"round({n}, {DIGITS})::DOUBLE" for n in names) + "]"
    c = "(CASE WHEN {n} <= 1 THEN 0 ELSE 2 * (ln({n} - 1) + " + str(EULER) + ") - 2 * ({n} - 1) / {n}::DOUBLE END)"
    ctes = [
        f"seeded AS MATERIALIZED (SELECT {seed} AS seed)",
        f"sampled AS MATERIALIZED (SELECT nth AS place, {listed} AS f FROM ({sampled}))",
        f"facts AS MATERIALIZED (SELECT count(*) AS n, least({LEAVES}, count(*)) AS taken, ceil(log2(greatest(2, least({LEAVES}, count(*))))) AS depth, any_value(seed) AS seed FROM sampled, seeded)",
        f"""level0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS node, place, f FROM (
          SELECT tree, place, f, taken, row_number() OVER (PARTITION BY tree ORDER BY u, place) AS nth FROM (SELECT tree, place, f, taken, {uniform_sql('seed', f'tree * (n + {NODES}) + {NODES} + place')} AS u FROM range({TREES}) AS t(tree), sampled, facts WHERE n >= {LEAST})) WHERE nth <= taken)""",
    ]
    for d in range(depths + 1):
        ctes.append(f"""nodes{d} AS MATERIALIZED (
          SELECT tree, node, size, CASE WHEN {d} < facts.depth THEN usable END AS usable, {uniform_sql('facts.seed', f'tree * (n + {NODES}) + 2 * node')} AS u0, {uniform_sql('facts.seed', f'tree * (n + {NODES}) + 2 * node + 1')} AS u1 FROM (
            SELECT tree, node, max(size) AS size, list({{'k': k, 'lo': lo, 'hi': hi}} ORDER BY k) FILTER (hi > lo) AS usable FROM (
              SELECT tree, node, k, count(*) AS size, min(x) AS lo, max(x) AS hi FROM (SELECT tree, node, unnest(f) AS x, generate_subscripts(f, 1) AS k FROM level{d}) GROUP BY ALL) GROUP BY tree, node), facts)""")
        ctes.append(f"""splits{d} AS MATERIALIZED (SELECT tree, node, s.k AS k, s.lo + u1 * (s.hi - s.lo) AS value, {d} + {c.format(n='size')} AS path FROM (SELECT *, usable[1 + floor(u0 * len(usable))::BIGINT] AS s FROM nodes{d}))""")
        if d < depths:
            ctes.append(f"level{d + 1} AS MATERIALIZED (SELECT tree, 2 * node + (CASE WHEN f[k] >= value THEN 1 ELSE 0 END) AS node, place, f FROM level{d} JOIN splits{d} USING (tree, node) WHERE k IS NOT NULL)")
    ctes.append("trees AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM splits{d}" for d in range(depths + 1)) + ")")
    # Rows of equal features go the same ways.
    ctes.append(f"walked AS MATERIALIZED (SELECT DISTINCT {listed} AS f FROM ({source}))")
    ctes.append("walk0 AS (SELECT f, tree, k, value, path, node FROM walked, trees WHERE node = 1)")
    for d in range(1, depths + 1):
        ctes.append(f"""walk{d} AS (SELECT w.f, w.tree, coalesce(t.k, CASE WHEN t.tree IS NULL THEN w.k END) AS k, coalesce(t.value, w.value) AS value, coalesce(t.path, w.path) AS path, coalesce(t.node, w.node) AS node
          FROM walk{d - 1} w LEFT JOIN trees t ON w.k IS NOT NULL AND t.tree = w.tree AND t.node = 2 * w.node + (CASE WHEN w.f[w.k] >= w.value THEN 1 ELSE 0 END))""")
    ctes.append(f"paths AS (SELECT f, sum(path) AS total FROM walk{depths} GROUP BY f)")
    scale = c.format(n="taken")
    return f"""WITH {', '.join(ctes)} SELECT s.*, coalesce(pow(2, -total / {TREES} / CASE WHEN {scale} = 0 THEN 1 ELSE {scale} END), 0) AS score
      FROM (SELECT *, {listed} AS f__ FROM ({source})) s LEFT JOIN paths ON paths.f = s.f__, facts"""
