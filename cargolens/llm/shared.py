"""Steps that several operators take: stored copies, prefix sums over stored parts, sizes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share.

    It lies in ``spark.checkpoint.dir``, or in the warehouse where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as a table in the shared folder and read back.

    Cuts the lineage and outlives the loss of executors; a task that is run again
    replaces its own files only.
    """
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a task holds few texts as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Batches after which a worker gives unused memory back; that takes about a millisecond.
RELEASE_EVERY = 4


def _release() -> None:
    """Give memory back that this process holds but does not use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def releasing(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, by a worker that gives unused memory back every few batches and at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(run(batches), 1):
            yield batch
            if number % RELEASE_EVERY == 0:
                _release()
        _release()

    return whole


def buckets_for(docs: DataFrame, text_col: str, bytes_each: int, least: int = 8) -> int:
    """How many buckets of about ``bytes_each`` bytes of text ``docs`` fills."""
    total = docs.agg(F.sum(text_bytes(F.col(text_col)))).first()[0] or 0
    return max(least, -(-total // bytes_each))


def sums_before(parts: DataFrame, part: str, sums: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Per part, what the parts before it hold in total: ``base_<sum>`` for every sum.

    ``parts`` has one row per part (and key), so its size follows the number of tasks
    that wrote the parts and not the number of rows in them.
    """
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        *keys, part, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in sums)
    )
