import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import bayes, clusters, features, forest, hybrid, strides
from tracelake.rules import corpus
from tracelake.sources import testbed


def entropy(s):
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def test_entropy(spark):
    texts = ["aab", "", None, "a😀b", "xxxx", "0123456789abcdef"]
    got = [r["e"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.shannon_entropy(F.col("t")).alias("e")).collect()]
    assert got == pytest.approx([entropy(t or "") for t in texts])


def test_tokens(spark):
    df = spark.createDataFrame([("GET /../../etc/passwd; cat | nc %2e && wget 123456 12 " + "z" * 30,), (None,)], "t string")
    tokens = [r["tokens"] for r in text.with_tokens(df, "t").collect()]
    assert Counter(tokens[0]) == Counter(["§traversal"] * 2 + ["§urlenc", "§cmdsep", "§pipe", "§andcmd", "get", "etc", "passwd", "cat", "nc", "wget", "12"])
    assert tokens[1] == []


def test_high_entropy(spark):
    df = spark.createDataFrame([("k=aB3dE5gH7jK9mN1pQ3sT5vX7z " + "a" * 40,)], "t string")
    assert [x["token"][:4] for x in df.select(text.high_entropy_tokens(F.col("t")).alias("x")).first()["x"]] == ["k=aB"]


def test_bayes_by_hand(spark):
    docs = [(0, "red red blue", "x"), (1, "green blue", "y"), (2, "red green", "x")]
    model = bayes.fit(spark.createDataFrame(docs, "doc int, text string, label string"))
    got = bayes.predict(spark.createDataFrame([(1, "red blue nope"), (2, "")], "k int, t string"), model, "k", "t").orderBy("k").collect()
    px, py = 2 / 3 * (4 / 8) * (2 / 8), 1 / 3 * (1 / 5) * (2 / 5)
    assert got[0]["label"] == "x" and got[0]["confidence"] == pytest.approx(px / (px + py), rel=1e-4)
    assert got[1]["label"] == "x" and got[1]["confidence"] == pytest.approx(2 / 3, rel=1e-4)


def test_corpus_is_learnable(spark):
    assert len(corpus.LABELS) == 18
    found = bayes.cross_validated(testbed.labelled(spark, "")).collect()
    assert np.mean([r["label"] == r["predicted"] for r in found]) > 0.8


def test_forest_finds_the_odd_one_and_repeats_itself(spark):
    rows = [(k, 0.5 + (k % 10) / 100, 0.5 - (k % 7) / 100) for k in range(300)] + [(999, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    one, two = (sorted(map(tuple, forest.scored(df, ("a", "b"), "k", 11).select("k", "score").collect())) for _ in range(2))
    assert one == two and max(one, key=lambda x: x[1])[0] == 999
    assert all(0 < s < 1 for _, s in one)


def test_forest_needs_rows(spark):
    assert [r["score"] for r in forest.scored(spark.createDataFrame([(1, 2.0)], "k int, a double"), ("a",), "k", 1).collect()] == [0.0]


def test_choice_of_k():
    assert [clusters.choose_k(n) for n in (6, 13, 50, 10**9)] == [2, 3, 5, 6]


@pytest.mark.parametrize(("n", "most"), [(10, 20), (100, 7), (101, 50), (64, 64)])
def test_stride(spark, n, most):
    got = sorted((r["place"], r["nth"], r["k"]) for r in strides.stride_sample(spark.range(n).select((F.col("id") * 3 - 50).alias("k")), "k", most).collect())
    want = list(range(n)) if n <= most else sorted({i * n // most for i in range(most)})
    assert got == [(x, i, 3 * x - 50) for i, x in enumerate(want)]


def test_stride_over_gaps_and_crowds(spark, monkeypatch):
    """Blocks of very different sizes are cut until each is small."""
    monkeypatch.setattr(strides, "BLOCKS", 3)
    monkeypatch.setattr(strides, "RANKED", 4)
    monkeypatch.setattr(strides, "FINER", 2)
    keys = sorted({*range(1000), *(10**12 + k * k for k in range(500)), -(10**15)})
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = sorted((r["place"], r["k"]) for r in strides.stride_sample(df, "k", 37).collect())
    assert got == [(p, keys[p]) for p in sorted({i * len(keys) // 37 for i in range(37)})]
    assert strides.stride_sample(df.limit(0), "k", 5).count() == 0


def test_models_of_any_size_agree(spark, monkeypatch):
    """Scoring in the row and by a join, and the same for cross-validation."""
    docs = spark.createDataFrame([(k, f"word{k % 7} thing{k % 11} also{k % 3} GET /../x", f"l{k % 4}") for k in range(120)] + [(500, "", "l1"), (501, None, "l2"), (502, "nothing known", "only")], "doc int, text string, label string")
    asked = spark.createDataFrame([(1, "word3 thing3 unknown"), (2, ""), (3, None), (4, "also1 " * 70_000)], "k int, t string")
    seen = []
    for held in (1 << 20, 1):
        monkeypatch.setattr(bayes, "HELD", held)
        model = bayes.fit(docs)
        assert (model.small() is None) == (held == 1)
        classes = sorted((r["k"], r["label"], round(r["confidence"], 6)) for r in bayes.predict(asked, model, "k", "t").collect())
        seen.append((classes, sorted(map(tuple, bayes.cross_validated(docs, most=held).collect()))))
    assert seen[0] == seen[1] and len(seen[0][1]) == 123 and all(p for _, _, p in seen[0][1])


def test_lines_are_scored_where_they_are(spark):
    model = bayes.fit(spark.createDataFrame([(0, "red", "x"), (1, "blue", "y")], "doc int, text string, label string"))
    plan = bayes.predict(spark.range(10).select("id", F.col("id").cast("string").alias("t")), model, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_folds_deal_each_label_round(spark):
    rows = [(k, "t", "often" if k % 5 else "rare") for k in range(203)]
    got = {r["doc"]: r["fold"] for r in bayes.in_folds(spark.createDataFrame(rows, "doc int, text string, label string")).collect()}
    for label in ("often", "rare"):
        own = [k for k, _, x in rows if x == label]
        assert [got[k] for k in own] == [i % 5 for i in range(len(own))]


def test_entropy_of_large_alphabets(spark):
    texts = ["".join(chr(0x4E00 + k * k % 900) for k in range(3000)), "".join(map(chr, range(32, 400))), "ab" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["e"] for r in df.select(text.shannon_entropy(F.col("t")).alias("e")).collect()] == pytest.approx([entropy(t) for t in texts])
    assert [r["e"] for r in df.select(text.shannon_entropy(F.col("t"), 0).alias("e")).collect()] == pytest.approx([entropy(t) for t in texts])


def test_entropy_flags_of_partitions(spark):
    """Each partition hands on a few, and the first of all are among them, each prefix once."""
    token = lambda k: "".join(chr(97 + (k * 7 + j * (k % 5 + 3)) % 26) + str((k + j) % 10) for j in range(18))
    rows = [(k, f"{token(k % 40)} and {token(k % 9)}") for k in range(300, 0, -1)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(6)
    got = [(r["place"], r["k"]) for r in hybrid.entropy_flags(df, "k", "t").orderBy("place").collect()]
    one = [(r["place"], r["k"]) for r in hybrid.entropy_flags(df.coalesce(1), "k", "t").orderBy("place").collect()]
    assert got == one and len(got) == 12


def test_centres_are_seeded_far_apart_and_empty_ones_stay():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(size=(40, 3)) + m for m in (0, 20, 40)])
    centres = clusters.fitted(points, 3, 5)
    assert sorted(np.round(centres.mean(axis=1) / 20)) == [0, 1, 2]
    assert (clusters.fitted(points, 3, 5) == centres).all()
    assert len(clusters.fitted(np.ones((9, 2)), 3, 1)) == 3


def test_noisy_or(spark):
    row = spark.range(1).select(hybrid.noisy_or(F.lit(0.5), F.lit(2.0) * 0.25, F.lit(-1.0)).alias("x")).first()
    assert row["x"] == pytest.approx(0.75)


def test_feature_names_agree(spark):
    df = spark.createDataFrame([("x", "y", None, None, None, None, None)], "raw string, message string, url string, user_agent string, status_code int, bytes long, ts timestamp")
    row = features.log_features(df).first()
    assert [row[n] for n in features.LOG_NAMES][0] == pytest.approx(12 / 23) and row["status_class"] == 0
