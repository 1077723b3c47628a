"""Small reference files: tariff exemptions and the effective-tariff series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions.cleaning import parse_integer
from cargolens.sources.keyed import KeyedTable, write_keyed

EXEMPTION_TEXTS = ("LIMITACOES_ESCOPO", "CODIGOS_HTSUS", "DESCRICAO_HTSUS_EXEMPLO", "TIPO_ESCOPO_SH6")
EXEMPTION_COUNTS = (
    "QTD_LINHAS_HTSUS", "QTD_HTSUS_8", "QTD_HTSUS_10", "QTD_SEM_LIMITACAO", "QTD_CONDICIONADAS",
)
EXEMPTION_PAGES = ("PAGINA_INICIAL", "PAGINA_FINAL")


def read_exemptions(spark: SparkSession, path: str) -> DataFrame:
    """The exemption list, one line per SH6, from a ";"-separated file.

    Texts stay empty rather than NULL, codes are padded to six digits, counts are read
    like other whole numbers ("2.0" is 2).
    """
    raw = spark.read.csv(path, sep=";", header=True, multiLine=True, escape='"')
    casts = {}
    for name in raw.columns:
        if name in EXEMPTION_COUNTS:
            casts[name] = parse_integer(F.col(name)).cast("bigint")
        elif name in EXEMPTION_PAGES:
            casts[name] = parse_integer(F.col(name))
        else:
            casts[name] = F.coalesce(F.col(name), F.lit(""))
    return raw.withColumns(casts).withColumn("CO_SH6", pad_sh6())


def pad_sh6():
    """Codes shorter than six digits are padded; longer ones are left whole."""
    code = F.col("CO_SH6")
    return F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)


def write_exemptions(exemptions: DataFrame, path: str) -> KeyedTable:
    """Store the list with its codes padded and declared unique, so that queries join it as it is."""
    return write_keyed(exemptions.withColumn("CO_SH6", pad_sh6()), path, ("CO_SH6",))


def unique_exemptions(exemptions: DataFrame | KeyedTable) -> DataFrame:
    """The list with one row per code; a repeated code fails the query that reads it.

    A list with a declared key needs no check in the query.
    """
    if isinstance(exemptions, KeyedTable):
        return exemptions.frame
    padded = exemptions.withColumn("CO_SH6", pad_sh6())
    others = [c for c in padded.columns if c != "CO_SH6"]
    failure = F.raise_error(F.concat(F.lit("Código SH6 repetido na referência de isenções: "), F.col("CO_SH6")))
    row = F.struct(*others)
    # The guard is a filter and cannot be pruned away.
    listed = padded.groupBy("CO_SH6").agg(F.count(F.lit(1)).alias("_n"), F.any_value(row).alias("_row"))
    alone = F.when(F.col("_n") > 1, failure.cast("boolean")).otherwise(True)
    return listed.where(alone).select("CO_SH6", "_row.*")


def exemption_codes(exemptions: DataFrame | KeyedTable) -> DataFrame:
    """The distinct codes of the list, padded before they are compared."""
    if isinstance(exemptions, KeyedTable):
        return exemptions.frame.select("CO_SH6")
    return exemptions.select(pad_sh6().alias("CO_SH6")).distinct()


TARIFF_REQUIRED = (
    "DATA", "IMPORTACOES_CONSUMO_USD", "DIREITOS_ADUANEIROS_USD", "BASE_TRIBUTAVEL_USD",
    "TARIFA_EFETIVA_PCT", "TARIFA_BASE_TRIBUTAVEL_PCT",
)


def read_tariff_series(spark: SparkSession, path: str) -> DataFrame:
    """The raw monthly tariff series, every column as text."""
    return spark.read.csv(path, sep=";", header=True)
