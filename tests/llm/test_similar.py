import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from tracelake.llm import similar


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components_by_jaccard(rows):
    """Smallest id reachable, by the exact Jaccard of all pairs; and the pairs that are alike."""
    root = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}
    pairs = []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(root, 2):
        a, b = sets[i], sets[j]
        if 5 * len(a & b) >= 4 * len(a | b):
            pairs.append((i, j))
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}, pairs


def corpus():
    """Texts with copies of every likeness from 0.6 to 1, a large group of near copies, and short and empty ones."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for _ in range(100):
        n = rng.randrange(30, 400)
        base = [word() for _ in range(n)]
        copy = list(base)
        for k in rng.sample(range(n), max(1, round(n * rng.uniform(0.0, 0.06)))):
            copy[k] = word()
        texts += [" ".join(base), " ".join(copy)]
    passage = [word() for _ in range(60)]
    for _ in range(60):
        near = list(passage)
        near[rng.randrange(60)] = word()
        texts += [" ".join(near), " ".join(passage + [word() for _ in range(60)])]
    texts += ["", None, " \t", "one two", "One  two", "one two three", texts[0]]
    return list(enumerate(texts))


def test_groups_are_those_of_exact_jaccard(spark):
    rows = corpus()
    want, pairs = components_by_jaccard(rows)
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 100 and got == want


def test_pipeline_drops_copies_that_are_alike(spark):
    rows = corpus()
    want, _ = components_by_jaccard(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert kept == sorted(i for i, root in want.items() if i == root)


def test_nameless_and_none(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "other words here now and then")], "doc_id long, text string")
    assert sorted(str(r["component_id"]) for r in similar.near_duplicates(docs).collect()) == ["4", "None", "None"]
    assert similar.near_duplicates(docs.limit(0)).count() == 0


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 7000))) for _ in range(9)]
    got = similar.common_counts(sets[:4], sets[3:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:4]]).all()
    assert similar.common_counts(sets[:1], [np.array([10**9])]).sum() == 0


@pytest.mark.parametrize(("crowd", "block"), [(2, 7), (48, 512)])
def test_crowds_of_half_alike_texts(spark, monkeypatch, crowd, block):
    """Very many texts near the limit, some pairs above it and most below: components are those of all pairs."""
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets} and 5 < len(set(got.values())) < 85


def test_recall_of_planted_near_copies(spark):
    """Copies with a word changed here and there, down to the limit of likeness: nearly all are found, and texts of their own stay apart."""
    rng = random.Random(9)
    rows, pairs = [], []
    for k in range(300):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        rows.append((k, " ".join(words)))
        other, at = list(words), rng.sample(range(len(words)), max(1, len(words) // 50))
        for x in at:
            other[x] = f"new{rng.randrange(10**6)}"
        a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, other))
        rows.append((1000 + k, " ".join(other)))
        pairs.append((k, 1000 + k, len(a & b) / len(a | b)))
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert len(near) > 150 and sum(got[a] == got[b] for a, b in near) >= 0.995 * len(near)
    assert all(got[a] != got[b] for a, b, j in pairs if j < 0.8)
