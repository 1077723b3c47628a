"""The effective tariff: duties as a percentage of imports, month by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.labels import month_year_label
from cargolens.functions.measures import per_nonzero
from cargolens.sources.references import TARIFF_REQUIRED

# Fixed value: how far the published rate may be from duties / imports, in points.
TOLERANCE = 0.001


def clean_tariff(raw: DataFrame) -> DataFrame:
    """Dates and numbers, complete rows only, one row per country and month."""
    missing = sorted(set(TARIFF_REQUIRED) - set(raw.columns))
    if missing:
        raise ValueError(f"A série tarifária precisa de: {', '.join(missing)}")
    numbers = TARIFF_REQUIRED[1:]
    country = F.col("PAIS") if "PAIS" in raw.columns else F.lit("")
    typed = raw.select(
        country.cast("string").alias("PAIS"),
        F.to_date(F.try_to_timestamp(F.col("DATA").cast("string"))).alias("DATA"),
        *[F.col(n).try_cast("double").alias(n) for n in numbers],
    ).na.drop(subset=list(TARIFF_REQUIRED))
    # Which of several rows for a month stays is fixed by their values; min() also
    # runs before the shuffle, so a month repeated very often costs nothing extra.
    row = F.min(F.struct(*numbers)).alias("row")
    return typed.groupBy("PAIS", "DATA").agg(row).select("PAIS", "DATA", "row.*")


def _gap() -> Column:
    rate = per_nonzero("DIREITOS_ADUANEIROS_USD", "IMPORTACOES_CONSUMO_USD") * 100
    return F.abs(rate - F.col("TARIFA_EFETIVA_PCT"))


def tariff_violations(series: DataFrame) -> DataFrame:
    """Months whose published rate does not follow from duties and imports."""
    return series.withColumn("DIFERENCA", _gap()).where(F.col("DIFERENCA") > TOLERANCE)


def tariff_series(raw: DataFrame) -> DataFrame:
    """The cleaned series in order; a rate that does not add up fails the query."""
    failure = F.raise_error(
        F.lit("A tarifa efetiva não confere com direitos ÷ importações para consumo.")
    ).cast("double")
    rate = F.when(_gap() > TOLERANCE, failure).otherwise(F.col("TARIFA_EFETIVA_PCT"))
    series = clean_tariff(raw).withColumn("TARIFA_EFETIVA_PCT", rate)
    return series.withColumn("MES_LABEL", month_year_label(F.col("DATA"))).orderBy("PAIS", "DATA")


def tariff_headline(series: DataFrame) -> DataFrame:
    """Latest rate per country, its change on the previous row and on the same
    month a year before, and the first peak.

    A window holds the months of one country, which the calendar bounds.
    """
    rate, date = F.col("TARIFA_EFETIVA_PCT"), F.col("DATA")
    country = Window.partitionBy("PAIS")
    rows = series.select(
        "PAIS",
        "DATA",
        "TARIFA_EFETIVA_PCT",
        F.lag(rate).over(country.orderBy("DATA")).alias("previous"),
        F.max("DATA").over(country).alias("latest"),
    )
    peak = F.max(F.struct(rate.alias("rate"), (-F.unix_date(date)).alias("day"), date.alias("date")))
    headline = rows.groupBy("PAIS").agg(
        F.max("DATA").alias("DATA"),
        F.max_by(rate, date).alias("TARIFA_EFETIVA_PCT"),
        F.max_by("previous", "DATA").alias("previous"),
        F.max(F.when(date == F.add_months("latest", -12), rate)).alias("year_before"),
        peak.alias("peak"),
    )
    return headline.select(
        "PAIS",
        "DATA",
        month_year_label(date).alias("MES_LABEL"),
        "TARIFA_EFETIVA_PCT",
        (rate - F.col("previous")).alias("VAR_MENSAL"),
        (rate - F.col("year_before")).alias("VAR_12_MESES"),
        F.col("peak.date").alias("DATA_PICO"),
        F.col("peak.rate").alias("PICO"),
        month_year_label(F.col("peak.date")).alias("PICO_LABEL"),
    )
