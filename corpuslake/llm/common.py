"""What the operators of this subpackage share: keys, columns that pass through, stored stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.plans.storage import forget, stored, text_batches

__all__ = ["NULL_ID", "ROW", "blob", "bounded", "forget", "id_key", "passed", "passing", "stored", "table", "text_batches", "text_key", "trimmed", "unnamed"]

#: A null id sorts before every other one.
NULL_ID = -(2**63)

#: The struct in which a row's own columns pass through an operator, so that no name of theirs meets one of its own.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def unnamed(docs: DataFrame, *taken: str) -> list[str]:
    """Columns of docs that have none of the taken names, in any case (Spark tells no case apart)."""
    gone = {n.lower() for n in taken}
    return [c for c in docs.columns if c.lower() not in gone]


def passing(names: list[str]) -> Column:
    """ROW: the named columns in one struct."""
    return F.struct(*[quoted(c).alias(c) for c in names] or [F.lit(None).cast("int").alias("nothing")]).alias(ROW)


def passed(names: list[str]) -> list[Column]:
    """The columns of ROW again."""
    return [F.col(ROW).getField(c).alias(c) for c in names]


def bounded(small: DataFrame, most: int) -> DataFrame:
    """small, to be broadcast if it has at most so many rows; else as it is, for Spark to shuffle."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_key(*columns: str) -> Column:
    """A key of a row's content; rows that agree in all columns share it."""
    return F.xxhash64(*[F.col(c) for c in columns])


def blob(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A binary column's values; null counts as empty."""
    return [x or b"" for x in column.to_pylist()]


def give_back() -> None:
    """Return this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its worker gives back what it freed: idle workers count to an executor's memory while later stages run."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped
