"""How complete the loaded data is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.measures import per_nonzero
from cargolens.model import UNCLASSIFIED, UNKNOWN_COUNTRY, TradeTables
from cargolens.plans.star import ROW_COUNT, facts_by

# --- fixed values: the report's indicators ----------------------------------
ALL_FACTS = "Registros na fato"
FILES = "Arquivos processados"


def _undescribed(level: str) -> Column:
    return F.col(f"CO_{level}").isNotNull() & F.col(f"NO_{level}_POR").isNull()


def _indicators() -> dict[str, tuple[list[str], Column]]:
    """Each indicator with the columns of the star it reads, those of one dimension."""
    days = F.col("DIAS_UTEIS")
    return {
        "NCM sem classificação": (["SETOR"], F.col("SETOR") == UNCLASSIFIED),
        "País sem descrição": (["PAIS"], F.col("PAIS") == UNKNOWN_COUNTRY),
        "Registros sem dias úteis": (["DIAS_UTEIS"], days.isNull() | (days <= 0)),
        **{
            f"Registros {level} sem descrição": ([f"CO_{level}", f"NO_{level}_POR"], _undescribed(level))
            for level in ("SH2", "SH4", "SH6")
        },
    }


# By dimension, so that facts are summed by one key at a time: there are far fewer products, countries
# and months than combinations of them.
_SEPARATELY = (("País sem descrição",), ("Registros sem dias úteis",))


def quality_report(tables: TradeTables) -> DataFrame:
    """Facts that miss a description, as counts and as a share of all facts.

    The facts are read once for each dimension, and only the key of that.
    """
    tests = {ALL_FACTS: ([], F.lit(True)), **_indicators()}
    together = [name for name in tests if not any(name in group for group in _SEPARATELY)]
    parts = []
    for group in (together, *_SEPARATELY):
        rows = facts_by(tables, None, [c for name in group for c in tests[name][0]], [ROW_COUNT])
        parts.append(
            rows.agg(
                *[
                    F.coalesce(F.sum(F.when(tests[name][1], F.col(ROW_COUNT))), F.lit(0)).cast("double").alias(f"_{i}")
                    for i, name in enumerate(tests)
                    if name in group
                ]
            )
        )
    # One row each, none of which has a column of another.
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = both.agg(*[F.max(f"_{i}").alias(f"_{i}") for i in range(len(tests))])
    if tables.loads is None:
        files = F.lit(0.0)
    else:
        files = tables.loads.agg(F.count(F.lit(1)).cast("double")).scalar()
    everything = F.col("_0")

    def entry(position: int, name: str, value: Column, share: Column) -> Column:
        return F.struct(
            F.lit(position).alias("_order"),
            F.lit(name).alias("INDICADOR"),
            value.alias("VALOR"),
            share.alias("PERCENTUAL"),
        )

    no_share = F.lit(None).cast("double")
    entries = [entry(0, ALL_FACTS, everything, no_share)]
    for i, name in enumerate(list(tests)[1:], start=1):
        entries.append(entry(i, name, F.col(f"_{i}"), per_nonzero(F.col(f"_{i}"), everything)))
    entries.append(entry(len(entries), FILES, files, no_share))
    return counts.select(F.inline(F.array(*entries))).orderBy("_order").drop("_order")


def load_log(loads: DataFrame) -> DataFrame:
    """Loaded files in order of flow and name."""
    return loads.select(
        F.col("flow").alias("FLUXO"),
        F.col("source_file").alias("ARQUIVO"),
        F.col("rows_loaded").alias("LINHAS"),
        F.col("loaded_at").alias("CARREGADO_EM"),
    ).orderBy("FLUXO", "ARQUIVO")
