"""The plans behind the operators: what is read, joined, shuffled and gathered."""

from __future__ import annotations

import random
import re

import pytest
from conftest import by, fact, make_tables, rows

import __spark_entry__  # noqa: F401  (fills the registry)
from cargolens.model import EXPORT_COLUMNS, IMPORT_COLUMNS, DimensionError, FilterState, TradeTables
from cargolens.operators.exposure import product_exposure, state_products
from cargolens.operators.impact import sector_impact, state_impact
from cargolens.operators.ranking import country_ranking
from cargolens.operators.trade import country_composition, hierarchy_table, summary_metrics
from cargolens.plans.star import facts_by, is_small, star
from cargolens.sources.raw import Layout, clean_facts, read_raw
from registry.core import QUERIES
from registry.data import data

SF = "/root/testdata/sf0.001"
STATE = FilterState(flow="EXP", year=1998)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan(frame) -> str:
    """The plan that ran, without the initial plans that are printed next to it."""
    frame.collect()
    kept, skip_below = [], None
    for line in plan(frame).splitlines():
        depth = len(line) - len(line.lstrip(" :|"))
        if skip_below is not None and depth > skip_below:
            continue
        skip_below = depth if "== Initial Plan ==" in line else None
        kept.append(line)
    return "\n".join(kept)


@pytest.fixture(scope="module")
def tables(spark):
    return data(spark, SF).tables


def _fact_scans(text: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan" in line and "VL_FOB" in line]


def test_year_and_flow_select_folders(tables):
    for frame in (hierarchy_table(tables, STATE, "SH4"), country_ranking(tables, STATE, "VL_FOB")):
        scans = _fact_scans(plan(frame))
        assert scans
        for scan in scans:
            filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan).group(1)
            assert "FLUXO" in filters and "CO_ANO" in filters


def test_only_needed_columns_are_read(tables):
    scan = _fact_scans(plan(country_ranking(tables, STATE, "VL_FOB")))[0]
    assert scan.split("ReadSchema: ")[1].startswith("struct<CO_PAIS:string,VL_FOB:decimal(18,2)>")


def test_totals_share_the_scan(spark, tables):
    exemptions = data(spark, SF).exemptions
    for frame in (
        hierarchy_table(tables, STATE, "Setor"),
        country_ranking(tables, STATE, "VL_FOB"),
        country_composition(tables, STATE, "003", "SETOR"),
        product_exposure(tables, STATE, exemptions),
        state_products(tables, STATE, exemptions, "SP"),
        state_impact(tables, STATE, exemptions),
    ):
        text = final_plan(frame)
        assert "ReusedExchange" in text
        # Main plan and subqueries together read the facts once.
        assert len(_fact_scans(text)) == 1, text


def test_unused_dimensions_leave_the_view(tables):
    text = plan(star(tables).where("FLUXO = 'EXP'").groupBy("PAIS").sum("VL_FOB"))
    assert "dim_country" in text and "dim_ncm" not in text and "dim_unit" not in text


def test_no_cross_products_and_no_wide_windows(spark):
    """Nothing is multiplied, and only the ranking of states uses a window without keys."""
    wide = set()
    for name, run in QUERIES.items():
        text = plan(run(spark, SF))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name
        if re.search(r"Window \[.*windowspecdefinition\((?:[^,]+ DESC|[^,]+ ASC)", text):
            wide.add(name)
    assert wide <= {"q32_impact_bands", "q22_top_states"}


def _rank_all(tables, exemptions):
    """Results of the main operators, keyed for comparison."""
    state = FilterState(year=2026, categories=("Bens de Consumo", "Bens Intermediários", "Não classificado"))
    return [
        rows(summary_metrics(tables, state)),
        by(hierarchy_table(tables, state, "SH6"), "CODIGO"),
        by(hierarchy_table(tables, state, "NCM"), "CODIGO"),
        by(country_ranking(tables, state, "KG_LIQUIDO"), "CO_PAIS"),
        by(country_composition(tables, state, "249", "SETOR"), "CODIGO"),
        by(product_exposure(tables, state, exemptions), "CO_NCM"),
        by(state_products(tables, state, exemptions, "SP", "NCM"), "CODIGO"),
        by(state_impact(tables, state, exemptions), "UF"),
        by(sector_impact(tables, state, exemptions), "CO_ISIC_SECAO"),
    ]


def _forced(tables, small: bool):
    flags = {name: small for name in ("ncm", "country", "unit", "calendar")}
    return TradeTables(tables.fact, tables.ncm, tables.country, tables.unit, tables.calendar, tables.loads, flags)


def test_large_dimensions_and_a_hot_product(spark, exemptions):
    """One product and one country hold a third of the facts each; dimensions may be any size."""
    chance = random.Random(7)
    products = [
        (f"{i:08d}", chance.choice(["Agropecuária", "Indústria Extrativa"]),
         chance.choice(["Bens de Consumo", "Bens Intermediários"]), f"{i % 7:02d}", None, f"{i % 7:02d}01", "x",
         "020110" if i % 5 == 0 else f"{i % 7:02d}01{i % 3:02d}", "s", f"n{i}", chance.choice("AB"), "z")
        for i in range(40)
    ]
    facts = [
        fact("EXP", chance.choice([2024, 2025, 2026]), chance.randint(1, 12),
             "00000005" if chance.random() < 0.34 else f"{chance.randint(0, 45):08d}",
             "249" if chance.random() < 0.34 else chance.choice(["160", "063", "777", None]),
             chance.choice(["SP", "MG", " ", None]), 1, chance.randint(0, 9), chance.randint(0, 100))
        for _ in range(1500)
    ]
    tables = make_tables(spark, facts, products)
    small = _rank_all(_forced(tables, True), exemptions)
    assert small == _rank_all(_forced(tables, False), exemptions)
    in_2026 = [f for f in facts if f[1] == 2026]
    assert len(in_2026) > 300
    allowed = {p[0] for p in products if p[2] in ("Bens de Consumo", "Bens Intermediários")}
    unknown = {f"{i:08d}" for i in range(40, 46)}
    assert small[0][0]["VL_FOB"] == sum(f[11] for f in in_2026 if f[3] in allowed | unknown)


def test_facts_are_summed_before_a_large_dimension_joins(spark, tables):
    late = facts_by(_forced(tables, False), STATE, ["CO_SH4"], ["VL_FOB"])
    text = plan(late)
    join = text.index("Join")
    assert "partial_sum" in text[join:] and "CO_NCM" in text[join:]
    early = plan(facts_by(_forced(tables, True), STATE, ["CO_SH4"], ["VL_FOB"]))
    assert "partial_sum" not in early and "BroadcastHashJoin" in early


def test_a_repeated_key_fails_every_reader(spark, tables):
    twice = tables.ncm.unionAll(tables.ncm.limit(1))
    for small in (True, False):
        broken = _forced(TradeTables(tables.fact, twice, tables.country, tables.unit, tables.calendar), small)
        for read in (star, lambda t: hierarchy_table(t, STATE, "SH4")):
            with pytest.raises(DimensionError, match="ncm"):
                read(broken)


def test_no_sort_below_a_sum(tables, spark):
    exposure = product_exposure(tables, STATE, data(spark, SF).exemptions)
    impact = state_impact(tables, STATE, data(spark, SF).exemptions)
    for frame in (exposure, impact):
        assert "rangepartitioning" not in plan(frame)


def test_a_hot_key_of_the_view_is_split(spark):
    """Facts of one product are a third of all; the join of a large dimension must not put them in one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    facts = spark.range(0, 120_000, 1, 16).selectExpr(
        "'EXP' FLUXO", "2026 CO_ANO", "cast(id % 12 as int) CO_MES",
        "if(id % 3 = 0, '00000005', lpad(cast(id % 5000 as string), 8, '0')) CO_NCM",
        "'10' CO_UNID", "'249' CO_PAIS", "uuid() SG_UF_NCM", "cast(id as double) VL_FOB",
    )
    base = make_tables(spark, [])
    products = spark.range(5000).selectExpr(
        "lpad(cast(id as string), 8, '0') CO_NCM",
        *[f"cast(id % 7 as string) {c}" for c in base.ncm.columns if c != "CO_NCM"],
    )
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        tables = TradeTables(facts, products, base.country, base.unit, base.calendar,
                             small={"country": True, "unit": True, "calendar": True})
        view = star(tables).select("CO_NCM", "SETOR", "SG_UF_NCM", "VL_FOB")
        assert "skewed" in final_plan(view)
        assert view.count() == 120_000
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_size_check_follows_the_session(spark, tables):
    assert is_small(tables.country)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert not is_small(tables.country)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("flow, charset", [("EXP", "utf-8"), ("IMP", "windows-1252"), ("IMP", None)])
def test_cleaning_stays_small_enough_to_be_compiled(spark, tmp_path, flow, charset):
    """The JVM leaves methods above 8,000 bytes interpreted, which halves the speed of a load."""
    columns = EXPORT_COLUMNS if flow == "EXP" else IMPORT_COLUMNS
    (tmp_path / "x.csv").write_text(";".join(columns))
    raw = read_raw(spark, Layout(flow, ";".join(columns), (str(tmp_path / "x.csv"),), charset))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    code = clean_facts(raw, flow)._jdf.queryExecution().explainString(mode)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000, sizes
