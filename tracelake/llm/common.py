"""What the operators of this subpackage share: the driver's tables, and where intermediate results go."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.store import cut, cut_at, drop, parallelism, scratch, shared_folder

__all__ = ["cut", "cut_at", "drop", "parallelism", "packed", "released", "row_of_file", "scratch", "shared_folder", "table", "unpacked"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(columns: list[str]) -> Column:
    """Columns of a caller as one struct, by place: whatever their names, an operator's own columns don't clash with them."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]) if columns else F.lit(None).cast("int")


def unpacked(struct: str, columns: list[str]) -> list[Column]:
    """The columns that `packed` has put into a struct, under their names."""
    return [F.col(struct)[f"c{k}"].alias(c) for k, c in enumerate(columns)]


def row_of_file(docs: DataFrame) -> Column | None:
    """What tells rows apart that come straight from files, whenever they are read: the file and the place in it. None if they don't come so."""
    if "_metadata" in docs.columns:
        return None
    row = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        docs.select(row)
    except AnalysisException:  # no files, or not of a kind that numbers its rows
        return None
    return row


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that gives memory back to the system at the end of its task.

    Workers live on from task to task, and what their allocators keep adds up beside the executor's own memory.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidy
