from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from cargolens.functions.cleaning import (
    business_day,
    business_day_number,
    collapse_blanks,
    fold,
    macro_sector,
    normalize_code,
    normalize_header,
    pad_code,
    parse_integer,
    parse_measure,
    state_or_default,
    use_category,
)
from cargolens.functions.labels import (
    balance_status_label,
    chart_label,
    classification_label,
    month_label,
    state_label,
    status_label,
    translate_scope,
)
from cargolens.functions.measures import change, close, per_nonzero, per_positive
from cargolens.model import STATUS_AFFECTED, FilterState


def apply(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


NUMBERS = ["2020", " 2020 ", "1.0", "1.5", "2.5", "-1.5", "1e3", "x", "", " ", None, "99999999999", "1d", "1f",
           "0x10", "0X1f", "0b11", "0o7", "1_000", "1__0", "_1", "+7", "+ 7", "7.", ".5", "-.5", "1,5", "--1", "1 2",
           "2147483647", "2147483648", "\t7", "1_0.5", "1e400", "inf", "1e"]


def test_integers_read_like_a_lenient_sql_cast(spark):
    con = duckdb.connect()
    expected = [con.execute("SELECT try_cast(trim(?::VARCHAR) AS INTEGER)", [v]).fetchone()[0] for v in NUMBERS]
    assert apply(spark, NUMBERS, parse_integer) == expected


MEASURES = ["1.234", "1,234", "1.234,5", "1d", "", None, " 12 ", "-3", "1e2", "1E-2", ".5", "5.", "abc", "1f", "0", "0x10",
            "1_000", "1_", "inf", "-Infinity", "1e400", "\t7\n", "."]


def test_measures_read_like_a_lenient_sql_cast(spark):
    con = duckdb.connect()
    sql = "SELECT try_cast(replace(trim(?::VARCHAR), ',', '.') AS DOUBLE)"
    expected = [con.execute(sql, [v]).fetchone()[0] for v in MEASURES]
    assert apply(spark, MEASURES, parse_measure) == expected


def test_no_nan_enters_a_measure(spark):
    assert apply(spark, ["NaN", "nan", "-NaN"], parse_measure) == [None] * 3


def test_codes(spark):
    assert apply(spark, ["123.0", "072", "nan", " ", None, "<NA>", "12.345", "abc", "-7.00"],
                 lambda c: normalize_code(c, 8)) == [
        "00000123", "00000072", None, None, None, None, "00012345", None, "00000007"]
    assert apply(spark, ["072", "1234"], lambda c: normalize_code(c, 3)) == ["072", "1234"]
    assert apply(spark, ["7", " 12 ", "123456789", ""], lambda c: pad_code(c, 8)) == [
        "00000007", "00000012", "12345678", "00000000"]


def test_business_days(spark):
    words = ["Sim", "não", " ÚTIL ", "Não Útil", "1", "0", "1.0", "talvez", None, "Falso"]
    assert apply(spark, words, business_day) == [1, 0, 1, 0, 1, 0, None, None, None, 0]
    assert apply(spark, [0.0, 2.0, -1.0, None], business_day_number, "double") == [0, 1, 0, None]


def test_fold(spark):
    assert apply(spark, [" Ação  Ítem ", "AQÜICULTURA", "nº", None], fold) == ["acao item", "aquicultura", "no", None]


@pytest.mark.parametrize(
    "code, name, sector",
    [
        ("A", None, "Agropecuária"), (" a ", "x", "Agropecuária"), ("Z", "Pesca", "Agropecuária"),
        ("B", "Transformação", "Indústria Extrativa"), (None, "INDÚSTRIAS EXTRATIVAS", "Indústria Extrativa"),
        ("C", None, "Indústria de Transformação"), (None, "transformação", "Indústria de Transformação"),
        (None, None, "Outros Produtos"), ("D", "Serviços", "Outros Produtos"),
    ],
)
def test_macro_sector(spark, code, name, sector):
    frame = spark.createDataFrame([(code, name)], "c string, n string")
    assert frame.select(macro_sector(F.col("c"), F.col("n"))).first()[0] == sector


@pytest.mark.parametrize(
    "code, name, category",
    [
        ("1", "BENS DE CAPITAL", "Bens de Capital"), ("2", "Bens intermediários", "Bens Intermediários"),
        ("3", "bens de CONSUMO", "Bens de Consumo"), ("4", "Lubrificantes", "Combustíveis e Lubrificantes"),
        ("5", " Outros ", "Outros"), ("9", None, "Categoria 9"), ("9", "  ", "Categoria 9"),
        (None, None, "Não classificado"),
    ],
)
def test_use_category(spark, code, name, category):
    frame = spark.createDataFrame([(code, name)], "c string, n string")
    assert frame.select(use_category(F.col("c"), F.col("n"))).first()[0] == category


def test_ratios_never_divide_by_zero(spark):
    frame = spark.createDataFrame([(6.0, 3.0), (6.0, 0.0), (6.0, -3.0), (6.0, None)], "a double, b double")
    got = [tuple(r) for r in frame.select(per_positive("a", "b"), per_nonzero("a", "b"), change("a", "b")).collect()]
    assert got == [(2.0, 2.0, 1.0), (None, None, None), (None, -2.0, -3.0), (None, None, None)]


def test_close_within_tolerance(spark):
    frame = spark.createDataFrame(
        [(1e15, 1e15 + 1.0), (1.0, 1.00005), (1.0, 1.01), (None, None), (1.0, None)], "a double, b double"
    )
    got = [r[0] for r in frame.select(close(F.col("a"), F.col("b"), 1e-11, 1e-4)).collect()]
    assert got == [True, True, False, True, False]


def test_labels(spark):
    assert apply(spark, [1, 12, 13], month_label, "int") == ["jan", "dez", None]
    assert apply(spark, ["SP", "XX"], state_label) == ["São Paulo (SP)", "XX"]
    assert apply(spark, [STATUS_AFFECTED, "?"], status_label) == ["Potencialmente afetado", None]
    assert apply(spark, ["Déficit"], balance_status_label) == ["▼ Déficit"]
    assert apply(spark, ["Pharma | Other||Ex ", "", None], translate_scope) == [
        "Somente uso farmacêutico | Other | Somente o produto descrito no Anexo II", "", ""]
    assert apply(spark, ["abcdef"], lambda c: chart_label(c, F.lit("01"), 3)) == ["abc · 01"]
    assert apply(spark, [" ", None, "SP"], state_or_default) == ["Não informado", "Não informado", "SP"]
    assert apply(spark, [" a \n b ", None], collapse_blanks) == ["a b", ""]


def test_classification_labels(spark):
    frame = spark.createDataFrame(
        [("01", "Animais"), ("02", None), ("03", "03"), (None, "Não classificado")], "c string, d string"
    )
    label = classification_label("SH2", F.col("c"), F.col("d"))
    assert [r[0] for r in frame.select(label).collect()] == [
        "Animais (SH2 01)", "SH2 02 — descrição não localizada", "SH2 03 — descrição não localizada",
        "Não classificado (SH2 )"]
    sector = classification_label("Setor", F.col("c"), F.col("d"))
    assert [r[0] for r in frame.select(sector).collect()] == ["Animais", "02", "03", "Não classificado"]


def test_headers_and_selection():
    assert normalize_header("  co  ano ") == "CO_ANO"
    state = FilterState(sectors=("a",), sh2=("b",), sh6=("c",), ncm=("d",))
    assert state.narrowed_from("sh2") == FilterState(sectors=("a",), sh2=("b",))
    with pytest.raises(ValueError):
        FilterState().require_year()


def test_no_cap_on_digits_and_letters(spark):
    """Long spellings and letters that decompose to several are read whole."""
    from cargolens.functions.cleaning import fold, normalize_code, parse_integer

    texts = ["0b" + "0" * 40 + "101", "0x" + "0" * 40 + "A", "1" * 120 + ".0", "o\ufb01cina", "\uff21gro", "V\u1ea1t"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    x = F.col("x")
    got = frame.orderBy("i").select(parse_integer(x), normalize_code(x, 8), fold(x)).collect()
    assert [got[0][0], got[1][0]] == [5, 10]
    assert got[2][1] == "1" * 120
    assert [r[2] for r in got[3:]] == ["oficina", "agro", "vat"]


def test_export_keeps_all_digits(spark):
    from cargolens.sources.export import with_decimal_comma

    values = [5e-8, 0.123456789, 12345678.25, 1e27, 0.0, -2.5, None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in with_decimal_comma(frame).collect()]
    assert got == ["0,00000005", "0,123456789", "12345678,25", "1" + "0" * 27 + ",0", "0,0", "-2,5", None]
