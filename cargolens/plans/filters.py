"""From a selection to Column predicates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolens.model import LEVEL_BY_ATTRIBUTE, FilterState


def _member(column: str, values: tuple) -> Column:
    """Membership that also finds missing codes when ``None`` was selected."""
    known = [v for v in values if v is not None]
    test = F.col(column).isin(known)
    return (test | F.col(column).isNull()) if None in values else test


def conditions(
    state: FilterState,
    *,
    include_year: bool = True,
    exclude: str | None = None,
    year_range: tuple[int, int] | None = None,
    include_flow: bool = True,
) -> dict[str, Column]:
    """One predicate per restricted column.

    Kept apart by column so that each can be applied as soon as its column
    exists: flow, year, month and NCM on the facts, the rest on a dimension.
    ``exclude`` drops one attribute's own predicate (for its option list).
    """
    found: dict[str, Column] = {}
    if include_flow:
        found["FLUXO"] = F.col("FLUXO") == state.flow
    if year_range is not None:
        found["CO_ANO"] = F.col("CO_ANO").between(*year_range)
    elif include_year and state.year is not None:
        found["CO_ANO"] = F.col("CO_ANO") == state.year
    if state.months and exclude != "months":
        found["CO_MES"] = F.col("CO_MES").isin(list(state.months))
    for attribute, level in LEVEL_BY_ATTRIBUTE.items():
        values = getattr(state, attribute)
        if values and exclude != attribute:
            found[level.code] = _member(level.code, values)
    return found


def all_of(predicates: list[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def predicate(state: FilterState, **scope) -> Column:
    """The whole selection as one predicate over the star view."""
    return all_of(list(conditions(state, **scope).values()))
