"""The register of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry.data import Data, data
from registry.views import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def comparable(frame: DataFrame) -> DataFrame:
    """Fractions rounded to six decimals, so that engines agree on the last bits."""
    return frame.withColumns(
        {
            f.name: F.round(F.col(f.name).cast("double"), 6)
            for f in frame.schema
            if isinstance(f.dataType, (T.DoubleType, T.DecimalType))
        }
    )


def register(
    name: str,
    run: Callable[[Data], DataFrame],
    sql: str | None = None,
    views: tuple[str, ...] = (),
    doubles: tuple[str, ...] = (),
) -> None:
    """``run`` is the Spark query; ``sql`` over ``views`` must give the same rows."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: comparable(run(data(spark, sf_dir)))
    if sql is not None:
        ORACLES[name] = oracle(sql, *views, doubles=doubles)
