"""Where intermediate results go: the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in `spark.checkpoint.dir`. Only a local session without
    that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/tracelake"


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Later stages start from the files, so a lost executor costs only its own tasks, and
    a plan with several uses of `df` computes it once.
    """
    return cut_at(df, name)[0]


#: Folders written by `cut_at` within the open `scratch` blocks, the innermost last.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what `cut` wrote within: wrap the work up to the action that uses it."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop(spark, path)


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `cut`, with the path, for loops that drop what they no longer need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder written by `cut_at`."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session is set."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
