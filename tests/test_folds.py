"""Cross-validation moves a text once, and work doesn't grow with texts times labels."""

from pyspark.sql import functions as F

from tracelake.operators import bayes


def _shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_large_models_are_not_met_by_every_token_and_label(spark):
    """nb_accuracy, ml_metrics: with a model larger than tasks hold, every token of a text met every label in a shuffle."""
    text = F.concat_ws(" ", *[F.concat(F.lit(f"w{j}x"), (F.col("id") % (j + 2)).cast("string")) for j in range(30)], F.concat(F.lit("own"), F.floor(F.col("id") / 3).cast("string")))
    docs = spark.range(2000).select(F.col("id").cast("int").alias("doc"), text.alias("text"), F.concat(F.lit("l"), (F.col("id") % 40).cast("string")).alias("label"))
    want = sorted(map(tuple, bayes.cross_validated(docs).collect()))
    before = _shuffled(spark)
    found = sorted(map(tuple, bayes.cross_validated(docs, most=600 * 5 * 40).collect()))  # 600 of 1,164 tokens are held
    assert found == want
    assert _shuffled(spark) - before < 2_500_000


def test_texts_are_written_once_and_not_moved_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(bayes, "cut", lambda df, name, cut=bayes.cut: written.append((name, df.columns)) or cut(df, name))
    docs = spark.createDataFrame([(k, f"w{k % 7} x{k % 3}", f"l{k % 2}") for k in range(60)], "doc int, text string, label string")
    found = bayes.cross_validated(docs)
    assert found.count() == 60
    assert [name for name, columns in written if {"text", "tokens__"} & set(columns)] == ["folds"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window [row_number" not in plan
