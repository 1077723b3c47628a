"""Restricting and ordering a finished result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_result(
    frame: DataFrame,
    *,
    where: Column | None = None,
    order_by: str,
    descending: bool = True,
    tiebreak: tuple[str, ...] = (),
    n: int | None = None,
) -> DataFrame:
    """Rows that pass ``where``, ordered with NULLs last, at most ``n`` of them.

    ``tiebreak`` columns make the order total, so that a cut at ``n`` is stable.
    """
    rows = frame if where is None else frame.where(where)
    key = F.col(order_by)
    ordered = rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *tiebreak)
    return ordered if n is None else ordered.limit(n)


def largest(frame: DataFrame, measure: str, n: int, code: str) -> DataFrame:
    """The ``n`` rows with the largest measure; rows without one never qualify."""
    return select_result(
        frame, where=F.col(measure).isNotNull(), order_by=measure, tiebreak=(code,), n=n
    )
