import random
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import mixing
from tracelake.llm.common import shared_folder
from tests.llm.test_simhash import by_hand, grouped
from tests.llm.test_text_operators import WORDS, sentence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for k in range(120):
        lang = rng.choice(list(WORDS))
        rows.append([k, sentence(lang, k, 60), lang, f"s{k % 4}", 0])
    rows += [[500 + k, rows[k][1], rows[k][2], "s9", 0] for k in range(10)]  # copies
    rows += [[600, "12345 !!", "en", "s1", 8], [601, None, "en", None, None], [602, sentence("en", 999) + " token = abcdef0123456789abcdef0123", None, "s1", 1], rows[3], [None, sentence("fr", 777), "fr", "s2", 5]]
    return spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = stages["language ID"](spark, docs, "").cache()
    assert kept.columns == docs.columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()}
    assert gone == {600, 601}
    assert kept.where("doc_id = 602").first()["lang"] == "en"
    once = stages["SimHash near-dedup"](spark, kept, "").cache()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None]
    groups = grouped(sorted({(i, by_hand(t)) for i, t in rows}))
    assert sorted(r["doc_id"] for r in once.where("doc_id is not null").collect()) == sorted({i for i, root in groups.items() if i == root})
    assert once.where("doc_id is null").count() == 1 and once.columns == docs.columns
    clean = stages["secret scans"](spark, once, "").cache()
    row = clean.where("doc_id = 602").first()
    assert row["text"].endswith("[assign]") and row["n_chars"] == len(row["text"]) and clean.count() == once.count()
    mixed = stages["mixing sources to target weights"](spark, clean, "").cache()
    assert mixed.columns == docs.columns
    assert {r["text"] for r in mixed.collect()} == {r["text"] for r in clean.collect()} and mixed.count() >= clean.count()
    stages["secret scans"](spark, once, "").coalesce(1).write.parquet(str(tmp_path / "clean"))
    order = mixing.mix(spark.read.parquet(str(tmp_path / "clean"))).select("position", "doc_id").collect()
    stages["mixing sources to target weights"](spark, spark.read.parquet(str(tmp_path / "clean")), "").write.parquet(str(tmp_path / "mixed"))
    last = stages["SentencePiece encoding and decoding"](spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in last:
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["text"] == library.decode(r["ids"])
    by_position = lambda rows: [r["doc_id"] for r in sorted(rows, key=lambda r: r["position"])]
    assert by_position(last) == by_position(order) and len({r["position"] for r in last}) == len(last)


def test_unrelated_texts_of_one_id_stay(spark):
    rows = [(1, "one two three four five six"), (1, "other words that have nothing in common"), (1, "one two three four five six"), (2, "one two three four five six"), (None, "seven"), (None, "eight"), (None, "seven")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("1", rows[0][1]), ("1", rows[1][1]), ("None", "eight"), ("None", "seven")]


def test_files_of_the_work_are_removed(spark, docs, tmp_path):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(folder.iterdir()) - before) == 1 and out.count() > 100


def test_run_and_empty_tables(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = tmp_path / "some"
    docs.withColumn("text", F.col("text")).write.parquet(str(some / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(some)).count() > 100
