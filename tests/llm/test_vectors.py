import numpy as np
import pytest

from tracelake.llm import vectors

SHAPE = "vec_id long, embedding array<float>, id string, key string, v string, shard string, n string"


def brute(rows, alike=0.9):
    """(id, n_links, component) by comparing all."""
    usable = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a in usable:
        for b in usable:
            x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
            if a != b and len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= alike:
                    links[a].add(b)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out.append((rows[k][0], len(links[k]), min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(i, v, "a", "b", "c", "d", "e") for i, v in rows], SHAPE)
    return sorted(map(tuple, vectors.near_duplicates(df).collect()), key=str)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(150)]
    hub = rng.normal(size=8)
    rows += [(1000 + k, (hub + 0.2 * rng.normal(size=8)).tolist()) for k in range(60)]
    rows += [(2000 + k, hub.tolist()) for k in range(20)] + [(5, hub.tolist()), (None, hub.tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [1.0, None] * 4), (3004, [float("nan")] * 8), (3005, [float("inf")] * 8), (None, None)]
    rows += [(3006, [1e38] * 8), (3007, [1e-38] * 8), (3008, [1.0] * 9), (3009, [-1.0] * 8), (3010, [2.0]), (3011, [5.0]), (3010, [2.0])]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("spread", [0.02, 0.2, 0.42])
def test_recall_within_crowded_shards(spread):
    """A third of all points are of one group: nothing is cut off, and what is found is true."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 32))
    x[:2000] = x[0] + spread * rng.normal(size=(2000, 32))
    x[2000:2600:2] = x[2001:2601:2] + 0.3 * rng.normal(size=(300, 32))
    x = vectors.unit(x[rng.permutation(len(x))])
    shard = vectors.Shard(x)
    true = {(r, p) for r, p in zip(*(v.tolist() for v in np.nonzero(x[:1500] @ x.T >= 0.9)))}
    got = set(zip(*(v.tolist() for v in shard.within(x[:1500], shard.beam))))
    assert got <= true and len(got) >= 0.97 * len(true)


def test_graph_is_kept_as_it_is(spark):
    rng = np.random.default_rng(1)
    x = vectors.unit(rng.normal(size=(1500, 16)))
    one = vectors.Shard(x)
    two = vectors.Shard(x, layers=[layer.near for layer in one.graph.layers], beam=one.beam)
    assert len(one.graph.layers) == 2
    assert all((a == b).all() for a, b in zip(one.within(x[:100], one.beam), two.within(x[:100], two.beam)))


def test_forest_connects_what_links_connect():
    row, point = np.array([0, 0, 1, 1, 2, 2, 3]), np.array([1, 2, 2, 3, 5, 6, 1])
    forest = vectors.Forest(8)
    kept = forest.spanning(row, point)
    assert len(kept) == 4 + 3 and len({forest.root[p] for p in (1, 2, 3)}) == 1 and forest.root[5] == forest.root[6] != forest.root[1]
    assert len(forest.spanning(row, point)) == 4
