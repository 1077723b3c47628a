"""How large an input is, and into how many parts it must go for a task to stay small."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession

#: Stored bytes of one part: some 350,000 facts, which take 50 to 250 MB as rows of a sort or a sum.
STORED_BYTES = 4 * 2**20
#: Bytes that one task reads of raw files, and those of a shuffle that it reads where Spark chooses
#: the parts: either way some 450,000 facts at most.
TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": 32 * 2**20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 * 2**20,
}


def stored_bytes(frame: DataFrame) -> int:
    """What the files behind a frame hold, without the folders that its filters leave out."""
    default = frame.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # The default stands for inputs of unknown size.
    return sum(size for size in sizes if size < int(default))


def parts(frame: DataFrame) -> int:
    """Into how many parts to shuffle a frame, so that each stays small and every core has one.

    The session's own number is fixed, and would let the memory of each task grow with the input.
    """
    return max(ceil(stored_bytes(frame) / STORED_BYTES), frame.sparkSession.sparkContext.defaultParallelism)


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Writes inside sort in tasks small enough not to spill; smaller settings of the session stay.

    A fact is some 400 bytes in a sort, most of them the name of its file, and 15 as it is stored, so
    Spark's own sizes give a task up to 740 MB to sort.
    """
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {key: spark.conf.get(key) for key in TASK_BYTES}
    try:
        for key, most in TASK_BYTES.items():
            if int(bytes_of(before[key])) > most:
                spark.conf.set(key, most)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
