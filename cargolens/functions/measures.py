"""Guarded arithmetic. Spark's ANSI mode raises on division by zero, so every
ratio states what an unusable denominator means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KG_PER_TONNE = 1000.0


def _double(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def per_positive(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator`` where the denominator is above zero, else NULL."""
    bottom = _double(denominator)
    return F.when(bottom > 0, _double(numerator) / bottom)


def per_nonzero(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator`` unless the denominator is zero, else NULL."""
    bottom = _double(denominator)
    return F.when(bottom != 0, _double(numerator) / bottom)


def change(current: Column | str, base: Column | str) -> Column:
    """Relative change against a base; NULL for a zero or missing base."""
    return per_nonzero(_double(current) - _double(base), base)


def tonnes(kilograms: Column | str) -> Column:
    return _double(kilograms) / F.lit(KG_PER_TONNE)


def close(left: Column, right: Column, relative: float, absolute: float) -> Column:
    """Equality within a relative or an absolute tolerance; two NULLs are equal."""
    a, b = _double(left), _double(right)
    slack = F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    both_missing = a.isNull() & b.isNull()
    return both_missing | F.coalesce(F.abs(a - b) <= slack, F.lit(False))
