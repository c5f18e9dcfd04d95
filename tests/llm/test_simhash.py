import itertools
import re

import numpy as np
import xxhash

from tracelake.llm import simhash
from tracelake.llm.components import components


def by_hand(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    """Smallest id reachable, by comparing all pairs."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}


def test_masks_cover_every_set_of_three_bits():
    masks = simhash.covering_masks(list(range(64)))
    assert all(any(not m & bits for m in masks) for trio in itertools.combinations(range(64), 3) for bits in [sum(1 << b for b in trio)])
    few = simhash.covering_masks([3, 9, 11, 40])
    assert all(any(not m & bits for m in few) for trio in itertools.combinations([3, 9, 11, 40], 3) for bits in [sum(1 << b for b in trio)])


def test_majority_of_long_runs():
    h = np.random.default_rng(1).integers(0, 2**63, 200_001, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert int(simhash.majority(h, np.array([len(h)]))[0]) == want


TEXTS = ["The Quick brown fox jumps over the lazy dog", "the quick BROWN fox jumps over the lazy dog", "one two", "ÉTÉ été", "", None, "\t\n", "a\x0bb c\xa0d e", "x " * 3000]


def test_documents(spark):
    base = [f"w{k} w{k * 7 % 31} w{k * 3 % 17}" for k in range(60)]
    texts = TEXTS + [" ".join(base)] * 3 + [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(40)]
    docs = spark.createDataFrame([(100 + k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, fp int, component_id int")
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [(100 + k, by_hand(t)) for k, t in enumerate(texts)]
    want = grouped(prints)
    for i, p in prints:
        assert rows[i]["fp"] & simhash.ALL == p and rows[i]["component_id"] == want[i]


def test_large_buckets_are_dealt_again(spark):
    """Buckets beyond the limit take the recursive way and give the same components."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(2**63))
    prints = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(0, 2**63, 30)})
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    want = grouped([(simhash._signed(p), p) for p in prints])
    joined = components(simhash.print_links(df, compared=6)).collect()
    root = {r["node"]: r["root"] for r in joined}
    assert {p: root.get(p, p) for p in want} == want


def test_empty_and_nameless(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "other words here now")], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    assert sorted(str(r["component_id"]) for r in rows) == ["4", "None", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(50)] + [(7, 7), (None, 3), (200, 100)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(got) == 41 + 51
    assert all(got[k] == 0 for k in range(41)) and all(got[200 + k] == 100 for k in range(50))
