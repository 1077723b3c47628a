"""Exports against imports, country by country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.labels import balance_status
from cargolens.model import BALANCED, DEFICIT, EXPORT, IMPORT, SURPLUS, FilterState, TradeTables
from cargolens.plans.star import facts_by

STATUSES = (SURPLUS, DEFICIT, BALANCED)


def trade_balance_by_country(tables: TradeTables, state: FilterState) -> DataFrame:
    """Exports, imports, balance and trade flow per country, in no order.

    The flow of the selection is ignored. Countries without trade either way drop.
    """
    state.require_year()
    rows = facts_by(
        tables,
        state,
        ["FLUXO", "CO_PAIS", "PAIS"],
        ["VL_FOB"],
        where={"FLUXO": F.col("FLUXO").isin(EXPORT, IMPORT)},
        include_flow=False,
    )

    def side(flow: str):
        return F.sum(F.when(F.col("FLUXO") == flow, F.col("VL_FOB")).otherwise(0)).cast("double")

    countries = rows.groupBy("CO_PAIS", "PAIS").agg(
        side(EXPORT).alias("EXPORTACOES"), side(IMPORT).alias("IMPORTACOES")
    )
    exports, imports = F.col("EXPORTACOES"), F.col("IMPORTACOES")
    return (
        countries.where((exports != 0) | (imports != 0))
        .withColumns({"SALDO": exports - imports, "CORRENTE_COMERCIO": exports + imports})
        .withColumn("SITUACAO", balance_status(F.col("SALDO")))
    )


def balance_totals(balance: DataFrame) -> DataFrame:
    """The whole balance in one row."""
    totals = balance.agg(
        F.coalesce(F.sum("EXPORTACOES"), F.lit(0.0)).alias("EXPORTACOES"),
        F.coalesce(F.sum("IMPORTACOES"), F.lit(0.0)).alias("IMPORTACOES"),
    )
    exports, imports = F.col("EXPORTACOES"), F.col("IMPORTACOES")
    return totals.withColumns(
        {"SALDO": exports - imports, "CORRENTE_COMERCIO": exports + imports}
    ).withColumn("SITUACAO", balance_status(F.col("SALDO")))


def balance_extremes(balance: DataFrame, each_side: int = 10) -> DataFrame:
    """The largest deficits and the largest surpluses, from low to high.

    Two top-k passes over one shared aggregation; no window over all countries.
    """
    saldo = F.col("SALDO")
    deficits = balance.where(saldo < 0).orderBy(saldo.asc(), "CO_PAIS").limit(each_side)
    surpluses = balance.where(saldo > 0).orderBy(saldo.desc(), "CO_PAIS").limit(each_side)
    both = deficits.unionByName(surpluses).dropDuplicates(["CO_PAIS"])
    return both.orderBy("SALDO", "CO_PAIS")


def balance_status_counts(balance: DataFrame) -> DataFrame:
    """Countries per status in a fixed order, zero where there are none."""
    counts = balance.agg(
        F.array(
            *[
                F.struct(
                    F.lit(position).alias("ORDEM"),
                    F.lit(status).alias("SITUACAO"),
                    F.count_if(F.col("SITUACAO") == status).alias("PAISES"),
                )
                for position, status in enumerate(STATUSES, start=1)
            ]
        ).alias("rows")
    )
    return counts.select(F.inline("rows")).orderBy("ORDEM")
