"""From raw documents to token ids: language ID, near-duplicate removal, secret redaction, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm import langid, mixing, pieces, secrets, similar
from tracelake.llm.common import drop, packed, row_of_file, scratch, shared_folder, table, unpacked
from tracelake.llm.queries import model_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID, taught by the labelled ones, doesn't reject; a missing lang is filled in.

    Null texts, empty ones and texts without a letter go; very long ones are read whole; repeated rows
    are judged each; of equally near languages the first by name is taken; an empty table gives an
    empty table; further columns stay as they are, whatever their names.
    """
    rows = docs.select(packed(docs.columns).alias("own"), "text")
    found = langid.identify(rows, langid.train(docs)).where(~F.col("rejected"))
    return found.select(*[F.coalesce(x, "lang_pred").alias(c) if c == "lang" else x for c, x in zip(docs.columns, unpacked("own", docs.columns))])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, null being last; of repeated rows one.

    Near-duplicates share 0.8 or more of their five-word shingles. Rows are told apart by all that they
    hold, so texts that have nothing in common stay whatever their doc_id. Null and empty texts are
    one group; very long texts are read whole; an empty table gives an empty table; further columns stay as
    they are, whatever their names.
    """
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(packed(docs.columns).alias("own"), "doc_id", "text", F.xxhash64(*names).alias("mark"), F.xxhash64(F.lit(1), *reversed(names)).alias("check"))
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "check").alias("row"), "text")
    kept = similar.representatives(named, "row").select("row.mark", "row.check")
    # Repeated rows are cut before texts are moved; the join then finds them where it needs them.
    nth = F.row_number().over(Window.partitionBy("mark", "check").orderBy("mark"))
    once = rows.select("own", "mark", "check", nth.alias("nth")).where("nth = 1")
    return once.join(kept, ["mark", "check"], "left_semi").select(*unpacked("own", docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows a changed text.

    Null and empty texts stay as they are; very long ones are scanned whole; repeated rows stay; of
    overlapping secrets the one that starts first names the place; an empty table gives an empty table;
    further columns stay as they are, whatever their names.
    """
    clean = secrets.redact(docs.select(packed(docs.columns).alias("own"), F.length("text").alias("before"), "text"))
    n = F.when(F.length("text") != F.col("before"), F.length("text").cast("long"))
    changed = {"text": lambda x: F.col("text"), "n_chars": lambda x: F.coalesce(n, x)}
    return clean.select(*[changed.get(c, lambda x: x)(x).alias(c) for c, x in zip(docs.columns, unpacked("own", docs.columns))])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; those of sources that weigh more than their share appear again.

    Partition k holds the k-th run of positions in order, so the files carry the order. Texts of any
    length, null ones too, are rows like any other, and so are repeated rows; of sources with equal deadlines the
    first by name is served; an empty table gives an empty table; further columns stay as they are,
    whatever their names.
    """
    row = row_of_file(docs)
    rows = docs.select(packed(docs.columns).alias("own"), "doc_id", "source", *[] if row is None else [row.alias("row")])
    return mixing.mix(rows, ordered=True, row=None if row is None else "row").select(*unpacked("own", docs.columns))


def with_position(docs: DataFrame) -> DataFrame:
    """`docs` as read from files that Spark wrote, with `position` (replaced if there is one): numbers in the order of the rows, file by file.

    The number of the file and the row's place in it make one, so nothing has to be counted or moved.
    """
    part = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).try_cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "position"]
    return docs.select(*kept, (F.shiftleft(F.coalesce(part, F.lit(0)), 33) + F.col("_metadata.row_index")).alias("position"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids, and the text that they decode to in place of the text; `position` goes up in the order of the mix.

    A null text has no ids and decodes to the empty text; texts of any length are encoded whole; repeated rows
    are encoded each; of pieces of equal score the leftmost pair is merged first, as in the library; an empty table gives an
    empty table; columns named position, ids or n_tokens are replaced, others stay as they are.
    """
    docs = with_position(docs)
    kept = [c for c in docs.columns if c.lower() not in ("text", "ids", "n_tokens")]
    ids = pieces.encode_documents(docs, model_path(), keep=kept, decoded="text")
    return ids.select(*[f"`{c}`" for c in kept], "text", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", as_pieces),
]

#: Language ID, SimHash and the piece model have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again.

    What a stage wrote for itself is removed at its end, and its own result when the next one is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
