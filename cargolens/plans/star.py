"""The star: facts with their dimension attributes.

``star`` is the plain view. ``facts_by`` is what the operators use: it joins only
the dimensions a question needs and decides, dimension by dimension, *when*:

* a dimension the optimizer estimates below ``spark.sql.autoBroadcastJoinThreshold``
  is joined to the fact rows, where it becomes a map-side hash join;
* any other dimension waits until the facts are summed to the keys in use. The
  partial sums run before the shuffle, so a product holding a third of all
  facts arrives at the join as a handful of rows, and the join shuffles sums,
  not facts. AQE still turns that join into a broadcast when the real size allows;
* labels of a key that is part of the result wait in any case.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.model import (
    UNCLASSIFIED,
    UNKNOWN_COUNTRY,
    UNKNOWN_ISIC,
    UNKNOWN_UNIT,
    DimensionError,
    FACT_SCHEMA,
    FilterState,
    MEASURES,
    NotInRollup,
    TradeTables,
)
from cargolens.plans.filters import all_of, conditions

ROW_COUNT = "REGISTROS"
#: What a rollup is summed by. It holds sums of all measures and of the number of facts.
ROLLUP_KEYS = ("FLUXO", "CO_ANO", "CO_MES", "CO_NCM", "CO_PAIS", "SG_UF_NCM")


@dataclass(frozen=True)
class Dimension:
    """How one dimension attaches to the facts."""

    table: str
    keys: dict[str, str]  # fact column -> dimension column
    attributes: dict[str, tuple[str, str | None]]  # star column -> (dimension column, default)


PRODUCT = Dimension(
    "ncm",
    {"CO_NCM": "CO_NCM"},
    {
        "SETOR": ("SETOR", UNCLASSIFIED),
        "CATEGORIA_USO": ("CATEGORIA_USO", UNCLASSIFIED),
        "CO_SH2": ("CO_SH2", None),
        "NO_SH2_POR": ("NO_SH2_POR", None),
        "CO_SH4": ("CO_SH4", None),
        "NO_SH4_POR": ("NO_SH4_POR", None),
        "CO_SH6": ("CO_SH6", None),
        "NO_SH6_POR": ("NO_SH6_POR", None),
        "NO_NCM_POR": ("NO_NCM_POR", None),
    },
)
COUNTRY = Dimension(
    "country",
    {"CO_PAIS": "CO_PAIS"},
    {"PAIS": ("PAIS", UNKNOWN_COUNTRY), "CO_PAIS_ISOA3": ("CO_PAIS_ISOA3", None)},
)
UNIT = Dimension("unit", {"CO_UNID": "CO_UNID"}, {"UNIDADE": ("UNIDADE", UNKNOWN_UNIT)})
CALENDAR = Dimension(
    "calendar", {"CO_ANO": "ANO", "CO_MES": "MES"}, {"DIAS_UTEIS": ("DIAS_UTEIS", None)}
)
STAR = (PRODUCT, COUNTRY, UNIT, CALENDAR)
KEYS = {d.table: list(d.keys.values()) for d in STAR}

# The industry section is not part of the view; only the sector operator asks for it.
_ISIC = {
    "CO_ISIC_SECAO": ("CO_ISIC_SECAO", UNKNOWN_ISIC),
    "NO_ISIC_SECAO": ("NO_ISIC_SECAO", UNCLASSIFIED),
}
_SOURCES = (Dimension("ncm", PRODUCT.keys, {**PRODUCT.attributes, **_ISIC}), COUNTRY, UNIT, CALENDAR)


def attach(rows: DataFrame, dimension: Dimension, side: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Left-join the wanted attributes of a dimension, defaults filled in."""
    names = [name for name in dimension.attributes if name in wanted]
    side = side.select(
        *[F.col(column).alias(f"_key_{column}") for column in dimension.keys.values()],
        *[F.col(dimension.attributes[name][0]).alias(name) for name in names],
    )
    match = all_of([rows[f] == side[f"_key_{d}"] for f, d in dimension.keys.items()])
    joined = rows.join(side, match, "left").drop(*[c for c in side.columns if c.startswith("_key_")])
    defaults = {n: dimension.attributes[n][1] for n in names if dimension.attributes[n][1] is not None}
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(text)) for n, text in defaults.items()})


def star(tables: TradeTables) -> DataFrame:
    """Every fact with the attributes of its four dimensions.

    ``dropDuplicates`` on the key proves to Catalyst that a join adds no rows, so
    the joins behind columns nobody reads leave the plan. A dimension too large to
    broadcast goes without: its shuffle must stand directly below the join for
    adaptive execution to split a product that holds much of the facts. Keys are
    unique, so both plans give the same rows.
    """
    rows = _facts(tables, FACT_SCHEMA.names)
    for dimension in STAR:
        side = checked(tables, dimension)
        if _fits(tables, dimension):
            side = side.dropDuplicates(list(dimension.keys.values()))
        rows = attach(rows, dimension, side, dimension.attributes)
    return rows


def register_star(tables: TradeTables, name: str = "trade_star") -> DataFrame:
    """Make the star available to ``spark.sql`` under ``name``."""
    view = star(tables)
    view.createOrReplaceTempView(name)
    return view


def repeated_keys(side: DataFrame, keys: list[str]) -> list[str]:
    """Up to five keys that a dimension holds more than once."""
    known = side.where(all_of([F.col(k).isNotNull() for k in keys]))
    repeated = known.groupBy(*keys).count().where("count > 1").limit(5)
    return sorted("/".join(str(r[k]) for k in keys) for r in repeated.collect())


def checked(tables: TradeTables, dimension: Dimension) -> DataFrame:
    """A dimension's table, after its keys have been found unique once for these tables.

    Stored dimensions were checked when they were written.
    """
    side = getattr(tables, dimension.table)
    if dimension.table not in tables.checked:
        require_unique(side, dimension.table, KEYS[dimension.table])
        tables.checked.add(dimension.table)
    return side


def require_unique(side: DataFrame, name: str, keys: list[str]) -> None:
    if found := repeated_keys(side, keys):
        raise DimensionError(f"Chaves repetidas em {name}: {', '.join(found)}")


def is_small(frame: DataFrame) -> bool:
    """Whether the optimizer's size estimate allows a broadcast in this session."""
    limit = frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    estimate = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)) <= int(limit)


def _fits(tables: TradeTables, dimension: Dimension) -> bool:
    if dimension.table not in tables.small:
        tables.small[dimension.table] = is_small(getattr(tables, dimension.table))
    return tables.small[dimension.table]


def facts_by(
    tables: TradeTables,
    state: FilterState | None,
    columns: list[str],
    measures: list[str],
    *,
    where: dict[str, Column] | None = None,
    **scope,
) -> DataFrame:
    """The selected facts with ``columns`` of the star and additive ``measures``.

    Rows may be facts or partial sums of facts, so callers must sum them. Ask for
    ``REGISTROS`` to count facts. ``where`` adds predicates by star column.
    """
    tests: dict[str, list[Column]] = {}
    for source in (conditions(state, **scope) if state else {}, where or {}):
        for name, test in source.items():
            tests.setdefault(name, []).append(test)

    wanted = set(columns)
    rows = _apply(_covering(tables, wanted | tests.keys(), measures), tests)

    late = []
    for dimension in _SOURCES:
        tested = dimension.attributes.keys() & tests.keys()
        asked = dimension.attributes.keys() & wanted
        if not tested and not asked:
            continue
        side = checked(tables, dimension)
        if not _fits(tables, dimension):
            late.append(dimension)
        elif set(dimension.keys) <= wanted:
            # The key is kept anyway: facts are filtered now, and the labels are
            # added to the sums, so that the shuffle carries the key alone.
            if tested:
                rows = _apply(attach(rows, dimension, side, tested), tests).drop(*tested)
            if asked:
                late.append(dimension)
        else:
            rows = _apply(attach(rows, dimension, side, tested | asked), tests)
    if late:
        keys = [c for c in columns if c in rows.columns]
        keys += [k for d in late for k in d.keys if k not in keys]
        rows = sum_by(rows, keys, measures)
        for dimension in late:
            needed = dimension.attributes.keys() & (wanted | tests.keys())
            rows = _apply(attach(rows, dimension, getattr(tables, dimension.table), needed), tests)
    return rows.select(*columns, *measures)


def _covering(tables: TradeTables, columns: set[str], measures: list[str]) -> DataFrame:
    """The rollup if it has every key that ``columns`` of the star hang on, else the facts.

    Its sums stand for the facts of their keys, and its count of facts for ``REGISTROS``. States
    are named in it, blank ones too, which all operators do themselves.
    """
    needed = {c for c in columns if c in FACT_SCHEMA.names}
    for dimension in _SOURCES:
        if dimension.attributes.keys() & columns:
            needed |= dimension.keys.keys()
    if tables.rollup is not None and needed <= set(ROLLUP_KEYS) and set(measures) <= {*MEASURES, ROW_COUNT}:
        return tables.rollup
    rows = _facts(tables, needed)
    return rows.withColumn(ROW_COUNT, F.lit(1).cast("long")) if ROW_COUNT in measures else rows


def _facts(tables: TradeTables, needed: Iterable[str]) -> DataFrame:
    if tables.fact is None:
        lacking = sorted(set(needed) - set(ROLLUP_KEYS))
        raise NotInRollup(f"O agregado não guarda {', '.join(lacking)}; consulte a base completa.")
    return tables.fact


def _apply(rows: DataFrame, tests: dict[str, list[Column]]) -> DataFrame:
    """Filter by the tests whose column is there, and strike them off."""
    ready = [name for name in tests if name in rows.columns]
    found = [test for name in ready for test in tests.pop(name)]
    return rows.where(all_of(found)) if found else rows


def sum_by(rows: DataFrame, keys: list, measures: list[str]) -> DataFrame:
    if not measures:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
