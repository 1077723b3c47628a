"""Grand totals next to their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOTALS = "_totals"


def with_shares(
    grouped: DataFrame, sums: list[str], shares: dict[str, Column], keep: tuple[str, ...] = ()
) -> DataFrame:
    """Add columns computed from the grand totals of ``sums``.

    ``shares`` maps a new column to an expression; ``total("X")`` inside it is
    the total of column ``X``. The totals come from a scalar subquery, so nothing
    is gathered into one task and no join is made. It sums every measure of
    ``grouped`` (``keep`` names the rest), which makes its plan equal to the
    outer one: the aggregation below is computed once and its exchange reused.
    """
    parts = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in keep]
    totals = grouped.agg(F.struct(*parts).alias(_TOTALS))
    return grouped.withColumn(_TOTALS, totals.scalar()).withColumns(shares).drop(_TOTALS)


def total(column: str) -> Column:
    return F.col(f"{_TOTALS}.{column}")
