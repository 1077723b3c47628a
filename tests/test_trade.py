from __future__ import annotations

import pytest
from conftest import COUNTRIES, PRODUCTS, SMALL_FACTS, by, fact, make_tables, rows
from pyspark.sql import functions as F

from cargolens.model import LEVEL_BY_ATTRIBUTE, FilterState
from cargolens.operators.balance import (
    balance_extremes,
    balance_status_counts,
    balance_totals,
    trade_balance_by_country,
)
from cargolens.operators.monthly import monthly_headline, monthly_history, monthly_profile
from cargolens.operators.options import all_filter_options, available_months, available_years, filter_options
from cargolens.operators.quality import load_log, quality_report
from cargolens.operators.ranking import country_ranking
from cargolens.operators.select import largest, select_result
from cargolens.plans.star import register_star
from cargolens.operators.trade import (
    classification_detail,
    country_composition,
    hierarchy_table,
    summary_metrics,
)

JANUARY = FilterState(flow="EXP", year=2026, months=(1,))


def test_small_star(small):
    summary = rows(summary_metrics(small, JANUARY))[0]
    assert summary == {
        "VL_FOB": 750.0, "KG_LIQUIDO": 140.0, "QT_ESTAT": 14.0, "FOB_POR_KG": 750 / 140,
        "REGISTROS": 4, "NCMS": 2, "PAISES": 2,
    }
    sectors = rows(hierarchy_table(small, JANUARY, "Setor"))
    assert [(r["CODIGO"], r["VL_FOB"], r["PARTICIPACAO_FOB"]) for r in sectors] == [
        ("Agropecuária", 450.0, 0.6), ("Indústria de Transformação", 300.0, 0.4)]
    composition = by(country_composition(small, JANUARY, "249", "SETOR"), "CODIGO")
    assert composition["Agropecuária"]["VL_FOB"] == 250
    assert composition["Indústria de Transformação"]["VL_FOB"] == 300
    price = rows(monthly_history(small, JANUARY, "FOB_POR_KG"))
    assert price[0]["VALOR"] == pytest.approx(750 / 140)
    daily = rows(monthly_history(small, JANUARY, "VL_FOB", True))
    assert daily[0]["VALOR"] == pytest.approx(750 / 21)


def test_nothing_selected_gives_null_sums_and_zero_counts(small):
    row = rows(summary_metrics(small, FilterState(year=1900)))[0]
    assert row["VL_FOB"] is None and row["REGISTROS"] == 0 and row["NCMS"] == 0


@pytest.mark.parametrize(
    "call",
    [
        lambda t: hierarchy_table(t, JANUARY, "SH8"),
        lambda t: filter_options(t, JANUARY, "country"),
        lambda t: country_composition(t, JANUARY, "249", "SH2"),
        lambda t: monthly_history(t, JANUARY, "QT_ESTAT"),
        lambda t: monthly_history(t, FilterState(), "VL_FOB"),
        lambda t: country_ranking(t, JANUARY, "FOB_POR_KG"),
        lambda t: country_ranking(t, FilterState(), "VL_FOB"),
        lambda t: trade_balance_by_country(t, FilterState()),
        lambda t: classification_detail(t, JANUARY, "CNAE", "1"),
    ],
)
def test_bad_requests_fail_before_any_plan(small, call):
    with pytest.raises(ValueError):
        call(small)


def test_options(spark, small):
    assert [r["CO_ANO"] for r in rows(available_years(small, "EXP"))] == [2026]
    assert [r["CO_MES"] for r in rows(available_months(small, "EXP", 2026))] == [1]
    state = FilterState(year=2026, sectors=("Agropecuária",), sh2=("02",))
    # The own filter is ignored, the others apply.
    assert [r["CODIGO"] for r in rows(filter_options(small, state, "sh2"))] == ["01"]
    assert rows(filter_options(small, state, "sectors"))[0]["CODIGO"] == "Indústria de Transformação"


def test_facts_without_a_product_row(spark):
    tables = make_tables(spark, [*SMALL_FACTS, fact("EXP", 2026, 1, "99999999", "999", " ", 1, 0, 50)])
    sectors = by(hierarchy_table(tables, JANUARY, "Setor"), "CODIGO")
    assert sectors["Não classificado"]["FOB_POR_KG"] is None
    codes = by(hierarchy_table(tables, JANUARY, "SH2"), "CODIGO")
    assert codes[None]["DESCRICAO"] == "Não classificado" and codes[None]["VL_FOB"] == 50
    products, countries = classification_detail(tables, JANUARY, "SH2", None)
    assert [r["CODIGO"] for r in rows(products)] == ["99999999"]
    assert [(r["CO_PAIS"], r["PAIS"]) for r in rows(countries)] == [("999", "País não identificado")]
    # A share refers to the whole even when the list is cut.
    top = rows(hierarchy_table(tables, JANUARY, "NCM", limit=1))
    assert len(top) == 1 and top[0]["PARTICIPACAO_FOB"] == pytest.approx(450 / 800)


def test_ranking_edges(spark):
    facts = [
        fact("EXP", 2026, 1, "01010100", "249", "SP", 1, 1, 100),
        fact("EXP", 2025, 1, "01010100", "249", "SP", 1, 1, 0),
        fact("EXP", 2024, 1, "01010100", "249", "SP", 1, 1, 50),
        fact("EXP", 2025, 1, "01010100", "160", "SP", 1, 1, 70),
        fact("EXP", 2026, 1, "01010100", "063", "SP", 1, 1, 300),
        fact("EXP", 2026, 1, "01010100", None, "SP", 1, 1, 900),
        fact("EXP", 2026, 1, "01010100", "777", "SP", 1, 1, None),
    ]
    ranking = rows(country_ranking(make_tables(spark, facts), FilterState(year=2026), "VL_FOB"))
    assert [r["CO_PAIS"] for r in ranking] == ["063", "249", "777", "160"]
    usa, china = ranking[1], ranking[3]
    assert usa["VAR_1A"] is None and usa["VAR_2A"] == 1.0 and usa["PARTICIPACAO"] == 0.25
    assert china["VALOR"] is None and china["VAR_1A"] is None and china["PAIS"] == "China"
    assert ranking[2]["VALOR"] == 0.0


def test_balance(spark):
    facts = [
        fact("EXP", 2026, 1, "01010100", "249", "SP", 1, 1, 100),
        fact("IMP", 2026, 1, "01010100", "249", "SP", 1, 1, 30),
        fact("IMP", 2026, 1, "01010100", "160", "SP", 1, 1, 200),
        fact("EXP", 2026, 1, "01010100", "063", "SP", 1, 1, 5),
        fact("IMP", 2026, 1, "01010100", "063", "SP", 1, 1, 5),
        fact("EXP", 2026, 1, "01010100", "777", "SP", 1, 1, 0),
    ]
    balance = trade_balance_by_country(make_tables(spark, facts), FilterState(flow="IMP", year=2026))
    got = sorted(rows(balance), key=lambda r: -abs(r["SALDO"]))
    assert [(r["CO_PAIS"], r["SALDO"], r["SITUACAO"]) for r in got] == [
        ("160", -200.0, "Déficit"), ("249", 70.0, "Superávit"), ("063", 0.0, "Zerado")]
    assert got[0]["EXPORTACOES"] == 0.0
    assert rows(balance_totals(balance))[0]["SALDO"] == -130.0
    assert [r["PAISES"] for r in rows(balance_status_counts(balance))] == [1, 1, 1]
    assert [r["CO_PAIS"] for r in rows(balance_extremes(balance, 1))] == ["160", "249"]


HISTORY = [(2024, 1, 80.0), (2025, 1, 100.0), (2026, 1, 110.0), (2024, 2, 50.0), (2025, 2, 70.0), (2026, 2, 60.0)]


def history(spark, values):
    return spark.createDataFrame(values, "ANO int, MES int, VALOR double")


def test_monthly_profile(spark):
    profile = rows(monthly_profile(history(spark, HISTORY), 2026, (1, 2)))
    assert [r["ATUAL"] for r in profile] == [110, 60]
    assert [r["MIN_5A"] for r in profile] == [80, 50]
    assert [r["MAX_5A"] for r in profile] == [100, 70]
    assert [r["ANTERIOR"] for r in profile] == [100, 70]
    assert [round(r["VAR_1A"], 4) for r in profile] == [0.1, -0.1429]
    assert [r["MEDIA_5A"] for r in profile] == [90, 60]
    assert [r["MES_LABEL"] for r in profile] == ["jan", "fev"]


def test_monthly_profile_gaps(spark):
    values = [(2024, 1, None), (2025, 1, 0.0), (2026, 1, 5.0), (2026, 3, 5.0), (2025, 2, 7.0)]
    got = by(monthly_profile(history(spark, values), 2026), "MES")
    assert len(got) == 12
    # A year counts although its value is missing; a zero base gives no change.
    assert got[1]["N_ANOS_BANDA"] == 2 and got[1]["MEDIA_5A"] == 0.0 and got[1]["VAR_1A"] is None
    assert got[2]["ATUAL"] is None and got[2]["ANTERIOR"] == 7.0
    assert got[3]["N_ANOS_BANDA"] is None and got[12]["ATUAL"] is None


def test_monthly_headline(spark):
    values = [(2025, 1, 10.0), (2025, 2, 30.0), (2026, 1, 50.0), (2026, 3, 50.0)]
    profile = monthly_profile(history(spark, values), 2026)
    row = rows(monthly_headline(profile, "VL_FOB"))[0]
    # The previous year is summed over all months; the first of two peaks wins.
    assert (row["VALOR_ATUAL"], row["VALOR_ANTERIOR"], row["VAR_ANUAL"]) == (100.0, 40.0, 1.5)
    assert (row["MES_PICO"], row["MES_PICO_LABEL"]) == (1, "jan")
    backwards = monthly_profile(history(spark, values), 2026, (3, 1))
    assert rows(monthly_headline(backwards, "VL_FOB", (3, 1)))[0]["MES_PICO"] == 3
    assert rows(monthly_headline(profile, "FOB_POR_KG"))[0]["VALOR_ATUAL"] == 50.0
    empty = rows(monthly_headline(monthly_profile(history(spark, []), 2026), "VL_FOB"))[0]
    assert empty["VALOR_ATUAL"] is None and empty["MES_PICO"] is None


def test_days_missing_in_calendar(spark):
    facts = [fact("EXP", 2026, 1, "01010100", "249", "SP", 1, 1, 100), fact("EXP", 2026, 2, "01010100", "249", "SP", 1, 1, 9)]
    got = by(monthly_history(make_tables(spark, facts), FilterState(year=2026), "VL_FOB", True), "MES")
    assert got[2]["VALOR"] is None and got[2]["DIAS_UTEIS"] is None


def test_quality(spark):
    tables = make_tables(spark, [*SMALL_FACTS, fact("EXP", 2026, 2, "99999999", "999", " ", 1, 0, 50)])
    got = by(quality_report(tables), "INDICADOR")
    assert got["Registros na fato"] == {"INDICADOR": "Registros na fato", "VALOR": 5.0, "PERCENTUAL": None}
    assert got["NCM sem classificação"]["PERCENTUAL"] == 0.2
    assert got["Registros sem dias úteis"]["VALOR"] == 1.0
    assert got["Registros SH2 sem descrição"]["VALOR"] == 0.0
    assert got["Arquivos processados"]["VALOR"] == 1.0
    assert rows(load_log(tables.loads))[0]["LINHAS"] == 4


def test_selecting_rows(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 3.0)], "k string, v double")
    assert [r.k for r in select_result(frame, order_by="v", tiebreak=("k",)).collect()] == ["c", "d", "a", "b"]
    assert [r.k for r in select_result(frame, order_by="v", descending=False).collect()][-1] == "b"
    assert [r.k for r in largest(frame, "v", 2, "k").collect()] == ["c", "d"]
    assert select_result(frame, where=F.col("v") > 1, order_by="v", n=1, tiebreak=("k",)).first().k == "c"


def test_star_in_sql(spark, small):
    register_star(small, "star_of_test")
    row = spark.sql("SELECT SETOR, sum(VL_FOB) v FROM star_of_test WHERE PAIS = 'China' GROUP BY SETOR").first()
    assert (row.SETOR, row.v) == ("Agropecuária", 200.0)


def test_shares_add_up(small):
    for level in ("Setor", "SH4", "NCM"):
        assert sum(r["PARTICIPACAO_FOB"] for r in rows(hierarchy_table(small, JANUARY, level))) == pytest.approx(1)
    assert len(PRODUCTS) == 2 and len(COUNTRIES) == 3


def test_all_options_equal_the_single_lists(spark, small):
    """One scan gives what six queries give, whatever filters are set."""
    for filters in ({}, {"sectors": ("Agropecuária",)}, {"sectors": ("x",), "sh2": ("01",)}, {"ncm": ("02011000",), "sh4": (None, "0201")}):
        state = FilterState(year=2026, **filters)
        together = all_filter_options(small, state)
        for attribute in LEVEL_BY_ATTRIBUTE:
            single = {(r["CODIGO"], r["DESCRICAO"]) for r in rows(filter_options(small, state, attribute))}
            mine = [r for r in rows(together) if r["ATRIBUTO"] == attribute]
            assert {(r["CODIGO"], r["DESCRICAO"]) for r in mine} == single and len(mine) == len(single)
