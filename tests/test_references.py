from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from conftest import EXEMPTION_SCHEMA, by, rows
from pyspark.errors import PySparkException

from cargolens.operators.exemptions import (
    clean_lines,
    consolidate_exemptions,
    duplicate_codes,
    merge_continuations,
    require_unique_codes,
)
from cargolens.operators.tariff import clean_tariff, tariff_headline, tariff_series, tariff_violations
from cargolens.model import DimensionError
from cargolens.sources.keyed import read_keyed
from cargolens.sources.references import (
    read_exemptions,
    read_tariff_series,
    unique_exemptions,
    write_exemptions,
)

TARIFF = [
    # date, country, imports, duties, base, rate, rate on base
    ("2025-04-01", "BRAZIL", "1000", "10", "500", "1.0", "2.0"),
    ("2025-05-01", "BRAZIL", "1000", "30", "500", "3.0", "6.0"),
    ("2025-05-01", "BRAZIL", "1000", "30", "500", "3.0", "6.0"),
    ("2026-04-01", "BRAZIL", "1000", "30", "500", "3.0", "6.0"),
    ("2026-05-01", "BRAZIL", "2000", "40", "500", "2.0", "8.0"),
    ("2026-06-01", "BRAZIL", "n/d", "40", "500", "2.0", "8.0"),
    ("junho", "BRAZIL", "2000", "40", "500", "2.0", "8.0"),
    ("2026-05-01", "CHILE", "100", "5", "50", "5.0", "10.0"),
]
TARIFF_SCHEMA = (
    "DATA string, PAIS string, IMPORTACOES_CONSUMO_USD string, DIREITOS_ADUANEIROS_USD string, "
    "BASE_TRIBUTAVEL_USD string, TARIFA_EFETIVA_PCT string, TARIFA_BASE_TRIBUTAVEL_PCT string"
)


def test_tariff(spark, tmp_path):
    raw = spark.createDataFrame(TARIFF, TARIFF_SCHEMA)
    series = tariff_series(raw)
    assert [(r["PAIS"], r["MES_LABEL"]) for r in rows(series)] == [
        ("BRAZIL", "abr/2025"), ("BRAZIL", "mai/2025"), ("BRAZIL", "abr/2026"), ("BRAZIL", "mai/2026"), ("CHILE", "mai/2026")]
    got = by(tariff_headline(series), "PAIS")
    brazil = got["BRAZIL"]
    assert (brazil["MES_LABEL"], brazil["TARIFA_EFETIVA_PCT"]) == ("mai/2026", 2.0)
    assert (brazil["VAR_MENSAL"], brazil["VAR_12_MESES"]) == (-1.0, -1.0)
    # The first of two equal peaks.
    assert (brazil["PICO_LABEL"], brazil["PICO"]) == ("mai/2025", 3.0)
    assert got["CHILE"]["VAR_MENSAL"] is None and got["CHILE"]["VAR_12_MESES"] is None

    raw.coalesce(1).write.option("sep", ";").option("header", True).csv(str(tmp_path / "t"))
    assert tariff_series(read_tariff_series(spark, str(tmp_path / "t"))).count() == 5


def test_tariff_must_add_up(spark):
    wrong = spark.createDataFrame([*TARIFF, ("2024-01-01", "PERU", "100", "5", "50", "5.1", "10")], TARIFF_SCHEMA)
    assert [r["PAIS"] for r in rows(tariff_violations(clean_tariff(wrong)))] == ["PERU"]
    with pytest.raises(PySparkException, match="não confere"):
        tariff_series(wrong).collect()
    # No imports, no rate to compare with.
    none = spark.createDataFrame([("2024-01-01", "PERU", "0", "0", "50", "5.1", "10")], TARIFF_SCHEMA)
    assert tariff_series(none).count() == 1
    with pytest.raises(ValueError, match="TARIFA_EFETIVA_PCT"):
        tariff_series(wrong.drop("TARIFA_EFETIVA_PCT"))


def test_exemption_file(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text(
        "﻿CO_SH6;QTD_LINHAS_HTSUS;LIMITACOES_ESCOPO;CODIGOS_HTSUS;DESCRICAO_HTSUS_EXEMPLO;TIPO_ESCOPO_SH6\n"
        '20110;2;;0201.10.05 | 0201.10.10;"Beef; ""fresh""";Sem limitação explícita\n'
        "280410;1;Ex;2804.10.00;;Condicionado\n",
        encoding="utf-8",
    )
    got = by(read_exemptions(spark, str(path)), "CO_SH6")
    assert set(got) == {"020110", "280410"}
    assert got["020110"]["LIMITACOES_ESCOPO"] == "" and got["020110"]["DESCRICAO_HTSUS_EXEMPLO"] == 'Beef; "fresh"'
    assert got["280410"]["QTD_LINHAS_HTSUS"] == 1 and got["280410"]["DESCRICAO_HTSUS_EXEMPLO"] == ""


def test_unique_exemptions(spark, exemptions):
    assert unique_exemptions(exemptions).count() == 3
    assert EXEMPTION_SCHEMA.startswith("CO_SH6")


LINES_SCHEMA = (
    "DOCUMENTO string, LINHA bigint, PAGINA_PDF int, HTSUS string, DESCRICAO_EN string, LIMITACAO_ESCOPO string"
)


def expected_merge(lines):
    """The merge line by line, in order."""
    out, last = [], {}
    for document, number, page, code, text, scope in sorted(lines):
        code, text, scope = (" ".join((v or "").split()) for v in (code, text, scope))
        digits = "".join(c for c in code if c.isdigit())
        if len(digits) in (8, 10):
            last[document] = len(out)
            out.append([document, number, page, code, text, scope, digits])
        elif not code and text and document in last:
            row = out[last[document]]
            row[4] = f"{row[4]} {text}".strip()
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed, block", [(1, 1), (2, 3), (3, 7), (4, 4096)])
def test_continuation_lines(spark, seed, block):
    chance = random.Random(seed)
    lines = []
    # One document holds most of the lines.
    for document, count in (("hot", 120), ("a", 20), ("b", 5), ("c", 1)):
        for number in range(count):
            kind = chance.random()
            code = "" if kind < 0.55 else "Note" if kind < 0.6 else "1234.5" if kind < 0.65 else f"{number:04d}.10.00"
            code = code + "05" if code and kind > 0.9 else code
            text = chance.choice(["", " wide\n  text ", f"t{number}", None])
            lines.append((document, number, number // 10, code or chance.choice(["", " ", None]), text, chance.choice(["", "Ex"])))
    merged = merge_continuations(clean_lines(spark.createDataFrame(lines, LINES_SCHEMA)), block)
    names = ["DOCUMENTO", "LINHA", "PAGINA_PDF", "HTSUS", "DESCRICAO_EN", "LIMITACAO_ESCOPO", "HTSUS_DIGITOS"]
    got = sorted(tuple(r[n] for n in names) for r in rows(merged))
    assert got == sorted(expected_merge(lines))


def test_consolidation(spark):
    lines = [
        ("d", 1, 42, "0201.10.05", "Beef", ""), ("d", 2, 43, "0201.10.10", "Veal", "Ex"),
        ("d", 3, 44, "0201.10.05.90", "Other", "Pharma"), ("d", 4, 44, "0201.10.05.91", "Other", "Ex"),
        ("d", 5, 45, "2804.10.00", "Hydrogen", "Ex"), ("d", 6, 46, "9801.00.10", "Returned goods", ""),
        ("d", 7, 46, "9703.00.00", "Sculptures", ""),
    ]
    cleaned = clean_lines(spark.createDataFrame(lines, LINES_SCHEMA))
    got = by(consolidate_exemptions(cleaned, source="s", annex="a", effective_date="2026-07-22"), "CO_SH6")
    assert set(got) == {"020110", "280410", "970300"}
    beef = got["020110"]
    assert (beef["QTD_LINHAS_HTSUS"], beef["QTD_HTSUS_8"], beef["QTD_HTSUS_10"]) == (4, 2, 2)
    assert (beef["QTD_SEM_LIMITACAO"], beef["QTD_CONDICIONADAS"], beef["TIPO_ESCOPO_SH6"]) == (1, 3, "Misto")
    assert beef["LIMITACOES_ESCOPO"] == "Ex | Pharma"
    assert beef["CODIGOS_HTSUS"] == "0201.10.05 | 0201.10.10 | 0201.10.05.90 | 0201.10.05.91"
    assert (beef["DESCRICAO_HTSUS_EXEMPLO"], beef["PAGINA_INICIAL"], beef["PAGINA_FINAL"]) == ("Beef", 42, 44)
    assert got["280410"]["TIPO_ESCOPO_SH6"] == "Condicionado"
    assert got["970300"]["TIPO_ESCOPO_SH6"] == "Sem limitação explícita" and got["970300"]["LIMITACOES_ESCOPO"] == ""

    assert rows(duplicate_codes(cleaned)) == []
    require_unique_codes(cleaned)
    doubled = cleaned.unionByName(cleaned.where("LINHA = 5"))
    with pytest.raises(ValueError, match="28041000"):
        require_unique_codes(doubled)


def test_a_line_that_runs_on_and_on(spark):
    """One coded line with thousands of continuations: its text in order, put together by blocks."""
    lines = [("d", 0, 1, "0201.10.05", None, "")] + [("d", n, 1, "", f"t{n}", "") for n in range(1, 5000)]
    lines += [("d", 5000, 2, "0201.10.06", "next", "Ex")]
    merged = merge_continuations(clean_lines(spark.createDataFrame(lines, LINES_SCHEMA).repartition(6)), 64)
    got = {r["LINHA"]: r["DESCRICAO_EN"] for r in rows(merged)}
    assert got == {0: " ".join(f"t{n}" for n in range(1, 5000)), 5000: "next"}


def test_declared_key(spark, exemptions, tmp_path):
    """A stored list is joined as it is: its key was checked when it was written."""
    path = str(tmp_path / "list")
    short = exemptions.withColumn("CO_SH6", F.expr("cast(cast(CO_SH6 as int) as string)"))
    kept = write_exemptions(short, path)
    assert kept.keys == ("CO_SH6",) and read_keyed(spark, path).frame.count() == 3
    plan = unique_exemptions(read_keyed(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    with pytest.raises(DimensionError, match="020110"):
        write_exemptions(exemptions.union(exemptions.where("CO_SH6 = '020110'")), str(tmp_path / "twice"))
    with pytest.raises(DimensionError):
        read_keyed(spark, str(tmp_path / "twice"))
    exemptions.write.mode("append").parquet(path)
    with pytest.raises(DimensionError, match="não são os da chave"):
        read_keyed(spark, path)
