"""Columns of a caller, whatever their names, and odd rows, in every operator that carries columns along and in every stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import WORDS, sentence
from tracelake.llm import chat, fingerprints, langid, mixing, pieces, quality, secrets, shards, simhash, similar

#: Names that operators use inside, or give to what they add.
NAMES = (
    "own", "row", "name__", "id__", "row__", "text__", "found__", "spans__", "before__", "mark__", "check__", "nth__", "tokens__", "place__", "part__", "shift__", "era__", "source__", "size__", "epochs__", "g__",
    "mark", "check", "nth", "last", "before", "found", "spans", "bucket", "key", "grams", "fp", "bands", "node", "root", "least", "component_id", "a", "b", "n", "at", "x", "g", "lang_pred", "score", "rejected",
    "epoch", "block", "slot", "position", "ids", "decoded", "n_tokens", "quality_score", "good", "id", "print", "run", "guest", "turn", "c0", "c1", "odd name", "dotted.name", "_metadata",
)
BASE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, sentence(lang, k, 60), lang, f"s{k % 3}", k) for k, lang in enumerate([*WORDS] * 12)]
    rows += [(900, sentence("en", 999) + " token = abcdef0123456789abcdef0123", "en", "s1", 1), (901, None, None, None, None), (902, "", "en", "s1", 0), rows[0], rows[0], (None, sentence("fr", 777), "fr", "s2", 5), (903, "the house and " * 40_000, "en", "s0", 9)]
    df = spark.createDataFrame(rows, BASE)
    return df.select("*", *[F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for k, c in enumerate(NAMES)])


def carried(df, without=()):
    """Every row still holds its own values under the caller's names."""
    names = [(k, c) for k, c in enumerate(NAMES) if c not in without]
    assert {c for _, c in names} <= set(df.columns) and len(df.columns) == len(set(df.columns))
    right = [F.col(f"`{c}`") == F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for k, c in names]
    wrong = F.lit(False)
    for x in right:
        wrong = wrong | ~F.coalesce(x, F.lit(False))
    assert df.where(wrong).count() == 0
    return df.count()


def test_operators_carry_columns(spark, docs):
    n = docs.count()
    assert carried(mixing.mix(docs), mixing.OUT) >= n
    assert carried(pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded"), ("ids", "decoded")) == n
    assert carried(langid.identify(docs, langid.train(docs)), ("lang_pred", "score", "rejected")) == n
    assert carried(secrets.scan(docs), ("spans",)) == n and carried(secrets.redact(docs)) == n
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "0 AS toxic", "'x' AS key", "'y' AS mark")
    assert carried(quality.score(docs, quality.train(docs, labels)), ("quality_score", "good")) == n


def test_operators_that_name_what_they_read(spark, docs):
    n = docs.count()
    assert fingerprints.with_following(docs).count() == n and shards.shard(docs).count() == n
    assert simhash.near_duplicates(docs).count() == n and similar.near_duplicates(docs).count() == n
    turns = docs.drop("turn", "conv_id").selectExpr("*", "doc_id AS conv_id", "0 AS turn", "'user' AS role", "'x' AS body", "'y' AS seq")
    assert chat.digests(chat.format_turns(turns)).count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_carry_columns(spark, docs, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs.drop("_metadata").withColumn("_metadata", F.lit("x")).drop("_metadata").write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    out = stage(spark, read, "")
    replaced = ("position", "ids", "n_tokens") if name.startswith("Sentence") else ()
    n = carried(out, (*replaced, "_metadata"))
    assert n > 20 and (replaced or out.columns == read.columns)
    nothing = stage(spark, read.limit(0), "")
    assert nothing.count() == 0 and nothing.columns == out.columns


def test_ids_all_null(spark):
    rows = [(None, f"text {k % 7}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert fingerprints.with_following(df).count() == 60 and simhash.near_duplicates(df).count() == 60
