import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import sentence
from tracelake.llm import quality


def tables(spark, n=300, marked=100):
    rng = random.Random(4)
    rows, marks = [], []
    for k in range(n):
        good = rng.random() < 0.7
        text = sentence("en", k, 40) if good else sentence("en", k, 40).upper().replace(" ", "!! ")
        rows.append((k, text, f"src{(k % 3) + (0 if good else 2)}", "en"))
        if k < marked:
            marks.append((k, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def auc(z, y):
    """How often a good one is above a bad one."""
    place = np.argsort(np.argsort(z, kind="stable"), kind="stable")
    n = y.sum()
    return (place[y > 0].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_views_teach_each_other(spark):
    """Both views know something here, so labels are exchanged, and both count."""
    docs, labels = tables(spark)
    model = quality.train(docs, labels)
    assert model.added > 100 and min(model.skills) > 0.1 and (model.calibration[:2] > 0).all()
    found = quality.score(docs, model).collect()
    y = np.array([not r["text"].isupper() for r in found])
    assert np.mean([r["good"] for r in found] == y) > 0.95


def test_surest_are_those_of_all_rows(spark):
    docs, _ = tables(spark)
    rows = [tuple(r) for r in docs.collect()]
    views = [quality.parsed(*r[1:]) for r in rows]
    rng = np.random.default_rng(2)
    model = quality.Model(np.ones(quality.WORDS), np.zeros(quality.STATS), np.ones(quality.STATS))
    features = [[r[0], *(x.tobytes() for x in v)] for r, v in zip(rows, views)]
    free = spark.createDataFrame(features + features[:50], "key long, words binary, shares binary, meta binary")  # a repeated row is picked once
    for view, width in ((0, quality.WORDS + quality.STATS + 1), (1, quality.META)):
        weights = rng.normal(size=width)
        z = model.rows(views, view).times(weights)
        slope, offset = 100.0, -100.0 * float(np.median(z))
        p = quality.sigmoid(slope * z + offset)
        got = quality.surest(free.repartition(6), model, view, weights, (slope, offset), {3, 8}, (5, 7))
        want = []
        for good, quota in ((0, 5), (1, 7)):
            sure = p if good else 1 - p
            want += [(k, good) for _, k in sorted((-sure[k], k) for k in range(len(rows)) if sure[k] >= quality.SURE and k not in (3, 8))[:quota]]
        assert [(key, good) for key, good, _ in got] == want and len(want) == 12


@pytest.mark.parametrize("n", [30, 3000])
def test_calibration_stays_within_bounds(n):
    """Separable rows, a constant column and one that says the contrary: slopes are bounded and not negative."""
    rng = np.random.default_rng(n)
    y = (rng.random(n) < 0.7).astype(float)
    w = quality.calibrated(np.c_[(2 * y - 1) * 1e-4, np.ones(n), -y], y)
    assert 0 < w[0] * 1e-4 < 20 and w[2] == 0 and np.isfinite(w).all()
    noise = quality.calibrated(rng.normal(size=(n, 1)) * 1e-5, y)
    assert abs(quality.sigmoid(noise[-1:])[0] - y.mean()) < 0.1


def test_held_out_labels():
    """On labels that weren't learned from: no constant answer passes, and both views do as well as the text alone."""
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text, source, lang, quality, toxic FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) WHERE quality IS NOT NULL ORDER BY doc_id").fetchall()
    held = np.array([zlib.crc32(str(r[0]).encode()) % 3 == 0 for r in rows])
    y = np.array([int(r[4] == 1 and not r[5]) for r in rows])
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0))
    aside = [r for r, h in zip(rows, held) if h]
    p = model.score(*([r[k] for r in aside] for k in (1, 2, 3)))
    alone = model.log_odds([quality.parsed(*r[1:4]) for r in aside])[:, 0]
    assert auc(p, y[held]) >= max(0.85, auc(alone, y[held]) - 0.005)
    assert np.mean((p >= 0.5) == y[held]) > y[held].mean() + 0.05
    assert np.percentile(p, 95) - np.percentile(p, 5) > 0.5 and ((p > 0.05) & (p < 0.95)).mean() > 0.3


def test_odd_rows(spark):
    rows = [(1, None, None, None, 1, "a"), (2, "", "s", "en", 2, "b"), (None, "text", "s", "en", 3, "c"), (1, "x " * 50_000, "s", None, 4, "d"), (1, "x", "s", None, 4, "d"), (1, "x", "s", None, 4, "d")]
    shape = "doc_id long, text string, source string, lang string, key int, words string"
    docs = spark.createDataFrame(rows, shape).withColumnsRenamed({}).selectExpr("*", "1 AS good", "'q' AS quality_score", "2 AS mark", "3 AS meta", "4 AS text__")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (None, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    found = quality.score(docs, model)
    assert found.columns == [*[c for c in docs.columns if c not in ("good", "quality_score")], "quality_score", "good"]
    assert found.count() == 6 and {r["quality_score"] for r in found.collect()} == {0.5} and found.agg(F.sum("meta")).first()[0] == 18
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
