"""Contiguous shards of equal size from global prefix sums.

Rows are ordered by id in range partitions; each partition's total is known from one
aggregation; the running sum of those totals plus the running sum inside a partition is a
row's global position in bytes. Equal cuts of the whole give the shards.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.shared import stored, sums_before


def balanced_shards(
    frame: DataFrame,
    n_shards: int,
    size: Column,
    id_col: str = "doc_id",
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Put every row into one of ``n_shards`` shards that follow the order of ``id_col``.

    Returns id, size, the carried columns, ``shard`` (0 up), ``slot`` (0 up without gaps in
    each shard) and ``first_byte`` (sizes of all rows before). A row belongs to the shard that
    holds the middle of its bytes, so a shard differs from its target by at most half its
    first and half its last row. Rows of equal id (repeated rows) follow each other in the
    order they are read; null ids come first; rows of size zero take slots as any other. Other
    columns of ``frame`` are not read, whatever their names. An empty frame gives no rows;
    fewer rows than shards leave shards empty.
    """
    extra = dict(carry or {})
    rows = (
        frame.select(
            F.col(id_col).alias("_id"),
            F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
            F.monotonically_increasing_id().alias("_read"),
            *(c.alias(f"_c{i}") for i, c in enumerate(extra.values())),
        )
        # The place of reading tells equal ids apart, so that one id may hold any share of the rows.
        .repartitionByRange("_id", "_read")
        .sortWithinPartitions("_id", "_read")
        .withColumn("_part", F.spark_partition_id())
    )
    rows = stored(rows, "ordered")
    parts = stored(
        rows.groupBy("_part").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "totals"
    )
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    bases = sums_before(parts, "_part", ("bytes", "rows"))

    inside = Window.partitionBy("_part").orderBy("_id", "_read").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base_bytes") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    rank = F.col("base_rows") + F.count(F.lit(1)).over(inside)
    placed = rows.join(bases, "_part").select(
        "_id", "_size", *(f"_c{i}" for i in range(len(extra))), before.alias("_first"), rank.alias("_rank")
    )
    # Exact in 64 bits up to 10^17 bytes for some tens of shards.
    cut = F.expr(f"(2 * _first + _size) * {n_shards} div {max(1, 2 * total)}")
    placed = placed.withColumn("_shard", F.least(cut, F.lit(n_shards - 1)).cast("int"))
    starts = placed.groupBy("_shard").agg(F.min("_rank").alias("_start"))
    return placed.join(F.broadcast(starts), "_shard").select(  # one row per shard
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        *(F.col(f"_c{i}").alias(name) for i, name in enumerate(extra)),
        F.col("_shard").alias("shard"),
        (F.col("_rank") - F.col("_start")).alias("slot"),
        F.col("_first").alias("first_byte"),
    )
