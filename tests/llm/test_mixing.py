from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tracelake.llm import mixing
from tracelake.llm.common import row_of_file


def worst(out, weights):
    """Largest deviation of a source from its given weight, in blocks of one row, after any slot."""
    total = sum(map(Fraction, weights.values()))
    done, most = Counter(), 0
    for t, r in enumerate(out):
        done[r["source"]] += 1
        most = max(most, *(abs(done[s] - Fraction(w) / total * (t + 1)) for s, w in weights.items()))
    return most


@pytest.mark.parametrize(("weights", "sizes"), [({"a": 0.9, "b": 0.1}, {"a": 27_000, "b": 3000}), ({"a": 0.9999, "b": 0.0001}, {"a": 500, "b": 1})])
def test_long_mixes_keep_the_given_weights(spark, monkeypatch, weights, sizes):
    monkeypatch.setattr(mixing, "RANGE", 7000, raising=False)
    rows = [(k, s) for s, n in sizes.items() for k in range(n)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=1).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(len(out))) and len(out) > 7000
    assert Counter((r["doc_id"], r["source"]) for r in out if r["epoch"] == 0) == Counter(rows)
    assert worst(out, weights) < 1


def test_more_sources_than_parts(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('s', id) AS source")
    assert mixing.mix(docs, block=1).count() == 5000


def test_the_walk_is_bounded(spark, monkeypatch):
    """Blocks grow with the mix, so that the driver walks about as many slots for any number of rows, and weights hold to a block."""
    monkeypatch.setattr(mixing, "SLOTS", 50)
    walked = []
    monkeypatch.setattr(mixing, "ranges", lambda *a, go=mixing.ranges: walked.append(sum(r[1] for r in go(*a))) or go(*a))
    for n in (300, 3000):
        rows = [(k, "ab"[k % 3 == 0]) for k in range(n)]
        out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 0.5, "b": 0.5}).orderBy("position").collect()
        assert Counter((r["doc_id"], r["source"]) for r in out if r["epoch"] == 0) == Counter(rows)
        assert worst(out, {"a": 0.5, "b": 0.5}) <= -(-len(out) // 40)
    assert max(walked) <= 60


def test_rows_of_files_are_not_written_again(spark, tmp_path):
    rows = [(k % 40, "abc"[k % 3], f"t{k}") for k in range(200)] + [(1, "a", "t1")] * 3
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = mixing.mix(docs.select("*", row_of_file(docs).alias("row")), row="row").collect()
    assert "row" not in out[0] and Counter((r["doc_id"], r["source"], r["text"]) for r in out if r["epoch"] == 0) == Counter(rows)
    assert sorted(r["position"] for r in out) == list(range(len(out)))
    assert row_of_file(docs.withColumn("_metadata", F.lit(1))) is None and row_of_file(spark.range(3)) is None
