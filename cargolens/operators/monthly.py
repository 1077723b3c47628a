"""Monthly history, its comparison with earlier years, and the headline of a year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.labels import month_label
from cargolens.functions.measures import change, per_positive
from cargolens.model import FilterState, TradeTables
from cargolens.plans.star import facts_by

METRICS = ("VL_FOB", "KG_LIQUIDO", "FOB_POR_KG")
ALL_MONTHS = tuple(range(1, 13))


def monthly_history(
    tables: TradeTables,
    state: FilterState,
    metric: str,
    daily_average: bool = False,
    history_years: int = 5,
) -> DataFrame:
    """Value per month of the selected year and the years before it.

    ``daily_average`` divides by the month's business days (not for the price,
    which is a ratio already); months without business days have no value.
    """
    year = state.require_year()
    if metric not in METRICS:
        raise ValueError("Medida desconhecida para o perfil mensal")
    measures = ["VL_FOB", "KG_LIQUIDO"] if metric == "FOB_POR_KG" else [metric]
    rows = facts_by(
        tables,
        state,
        ["CO_ANO", "CO_MES", "DIAS_UTEIS"],
        measures,
        include_year=False,
        year_range=(year - history_years, year),
    )
    months = rows.groupBy("CO_ANO", "CO_MES").agg(
        *[F.sum(m).alias(m) for m in measures], F.max("DIAS_UTEIS").alias("DIAS_UTEIS")
    )
    if metric == "FOB_POR_KG":
        value = per_positive("VL_FOB", "KG_LIQUIDO")
    elif daily_average:
        value = per_positive(metric, "DIAS_UTEIS")
    else:
        value = F.col(metric).cast("double")
    return months.select(
        F.col("CO_ANO").alias("ANO"), F.col("CO_MES").alias("MES"), value.alias("VALOR"), "DIAS_UTEIS"
    ).orderBy("ANO", "MES")


def history_years_present(history: DataFrame, year: int) -> DataFrame:
    """Earlier years that have facts, in order."""
    return history.where(F.col("ANO") < year).select("ANO").distinct().orderBy("ANO")


def monthly_profile(history: DataFrame, year: int, months: tuple[int, ...] = ()) -> DataFrame:
    """The selected months: this year, last year, and the band of all earlier years.

    The months keep the order in which they were given. A year counts towards the
    band's size even when its month has no value.
    """
    in_year = F.col("ANO") == year
    last_year = F.col("ANO") == year - 1
    earlier = F.col("ANO") < year
    by_month = history.groupBy(F.col("MES").alias("_month")).agg(
        F.max(F.when(in_year, F.col("VALOR"))).alias("ATUAL"),
        F.max(F.when(last_year, F.col("VALOR"))).alias("ANTERIOR"),
        F.min(F.when(earlier, F.col("VALOR"))).alias("MIN_5A"),
        F.max(F.when(earlier, F.col("VALOR"))).alias("MAX_5A"),
        F.avg(F.when(earlier, F.col("VALOR"))).alias("MEDIA_5A"),
        F.nullif(F.countDistinct(F.when(earlier, F.col("ANO"))), F.lit(0)).alias("N_ANOS_BANDA"),
    )
    selected = F.array(*[F.lit(m) for m in (months or ALL_MONTHS)])
    grid = history.sparkSession.range(1).select(F.posexplode(selected).alias("_position", "MES"))
    profile = grid.join(by_month, F.col("MES") == F.col("_month"), "left")
    return (
        profile.withColumns(
            {
                "VAR_1A": change("ATUAL", "ANTERIOR"),
                "DESVIO_MEDIA_5A": change("ATUAL", "MEDIA_5A"),
                "MES_LABEL": month_label(F.col("MES")),
            }
        )
        .orderBy("_position")
        .drop("_position", "_month")
    )


def monthly_headline(
    profile: DataFrame, metric: str, months: tuple[int, ...] = ()
) -> DataFrame:
    """Current and previous level of a profile, the annual change and the peak month.

    Values and weights add up; the price is averaged over the months. The previous
    level covers every selected month, also those the current year lacks so far.
    """
    if metric not in METRICS:
        raise ValueError("Medida desconhecida para o perfil mensal")
    level = F.avg if metric == "FOB_POR_KG" else F.sum
    order = F.array(*[F.lit(m) for m in (months or ALL_MONTHS)])
    # On a tie the month that comes first in the selection is the peak.
    peak = F.max(
        F.when(
            F.col("ATUAL").isNotNull(),
            F.struct("ATUAL", (-F.array_position(order, F.col("MES"))).alias("first"), "MES"),
        )
    )
    row = profile.agg(
        level("ATUAL").alias("VALOR_ATUAL"), level("ANTERIOR").alias("VALOR_ANTERIOR"), peak.alias("_peak")
    )
    return row.select(
        "VALOR_ATUAL",
        "VALOR_ANTERIOR",
        change("VALOR_ATUAL", "VALOR_ANTERIOR").alias("VAR_ANUAL"),
        F.col("_peak.MES").alias("MES_PICO"),
        F.col("_peak.ATUAL").alias("VALOR_PICO"),
        month_label(F.col("_peak.MES")).alias("MES_PICO_LABEL"),
    )
