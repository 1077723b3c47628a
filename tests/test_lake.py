from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from conftest import COUNTRIES, PRODUCTS, by, make_tables, rows

from cargolens.model import FilterState, NotInRollup
from cargolens.operators.quality import load_log, quality_report
from cargolens.operators.trade import hierarchy_table, summary_metrics
from cargolens.sources.export import with_decimal_comma, write_csv
from cargolens.plans.star import facts_by, star
from cargolens.sources import generations, lake, rollup, storage
from cargolens.sources.lake import load, open_tables, read_facts, read_loads, source_report
from cargolens.sources.raw import RawFileError, inspect_files
from cargolens.sources.rollup import (
    RollupError,
    build_rollup,
    monthly_rollup,
    read_rollup_facts,
    refresh_rollup,
    rollup_mismatches,
)

EXPORT_HEADER = "CO_ANO;CO_MES;CO_NCM;CO_UNID;CO_PAIS;SG_UF_NCM;CO_VIA;CO_URF;QT_ESTAT;KG_LIQUIDO;VL_FOB"
IMPORT_HEADER = EXPORT_HEADER + ";VL_FRETE;VL_SEGURO"


def write(folder, name, lines, charset="utf-8"):
    path = folder / name[:3].lower() / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("\n".join(lines).encode(charset))
    return path


def export_row(year, month="1", ncm="1010100", fob="100", uf="sp"):
    return f"{year};{month};{ncm};10;249;{uf};1;1;2;20;{fob}"


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    write(folder, "EXP_2025.csv", [EXPORT_HEADER, export_row(2025), export_row(2025, "13"), export_row(2025, ncm=" "),
                                   export_row("x"), export_row(2025, "2", fob="1,5", uf=" ")])
    write(folder, "EXP_2026.csv", [EXPORT_HEADER, export_row(2026), export_row(2026, "3")])
    write(folder, "IMP_2026.csv", [IMPORT_HEADER, export_row(2026) + ";7;0,5"])
    write(folder, "EXP_notes.csv", ["not a fact file"])
    return folder


@pytest.fixture
def dimensions(spark):
    t = make_tables(spark, [], PRODUCTS, COUNTRIES)
    return {"ncm": t.ncm, "country": t.country, "unit": t.unit, "calendar": t.calendar}


def test_first_load(spark, raw, tmp_path, dimensions):
    root = str(tmp_path / "lake")
    result = load(spark, str(raw), root, dimensions)
    assert (result.files_loaded, result.files_skipped, result.rows_loaded) == (3, 0, 5)
    facts = rows(read_facts(spark, root))
    assert sorted((r["FLUXO"], r["CO_ANO"], r["CO_MES"]) for r in facts) == [
        ("EXP", 2025, 1), ("EXP", 2025, 2), ("EXP", 2026, 1), ("EXP", 2026, 3), ("IMP", 2026, 1)]
    decimal = [r for r in facts if (r["CO_ANO"], r["CO_MES"]) == (2025, 2)][0]
    assert decimal["VL_FOB"] == 1.5 and decimal["SG_UF_NCM"] == "" and decimal["VL_FRETE"] is None
    imports = [r for r in facts if r["FLUXO"] == "IMP"][0]
    assert (imports["VL_FRETE"], imports["VL_SEGURO"]) == (7.0, 0.5)
    assert imports["CO_NCM"] == "01010100" and imports["CO_URF"] == "0000001" and imports["SG_UF_NCM"] == "SP"
    tables = open_tables(spark, root)
    assert by(hierarchy_table(tables, FilterState(year=2026), "Setor"), "CODIGO")["Agropecuária"]["VL_FOB"] == 200
    assert [r["LINHAS"] for r in rows(load_log(tables.loads))] == [2, 2, 1]


def test_incremental_load(spark, raw, tmp_path):
    root = str(tmp_path / "lake")
    load(spark, str(raw), root)
    again = load(spark, str(raw), root)
    assert (again.files_loaded, again.files_skipped, again.rows_loaded) == (0, 3, 0)

    # A changed file replaces its own rows and nobody else's.
    write(raw, "EXP_2026.csv", [EXPORT_HEADER, export_row(2026, fob="900"), export_row(2026, "4"), export_row(2026, "5")])
    changed = load(spark, str(raw), root)
    assert (changed.files_loaded, changed.files_skipped, changed.rows_loaded) == (1, 2, 3)
    got = rows(read_facts(spark, root).where("FLUXO = 'EXP'").groupBy("CO_ANO").count().orderBy("CO_ANO"))
    assert got == [{"CO_ANO": 2025, "count": 2}, {"CO_ANO": 2026, "count": 3}]

    # A file that is gone takes its rows along.
    os.rename(raw / "exp" / "EXP_2025.csv", tmp_path / "EXP_2025.csv")
    removed = load(spark, str(raw), root)
    assert (removed.files_removed, removed.files_loaded) == (1, 0)
    assert read_facts(spark, root).where("CO_ANO = 2025").count() == 0
    assert read_loads(spark, root).count() == 2

    # It comes back, and a rebuild gives the same.
    os.rename(tmp_path / "EXP_2025.csv", raw / "exp" / "EXP_2025.csv")
    assert load(spark, str(raw), root).rows_loaded == 2
    before = sorted(map(str, rows(read_facts(spark, root))))
    rebuilt = load(spark, str(raw), root, rebuild=True)
    assert rebuilt.files_loaded == 3
    assert sorted(map(str, rows(read_facts(spark, root)))) == before


def facts_of(spark, root):
    return sorted(map(str, rows(read_facts(spark, root))))


class Died(Exception):
    pass


def die(*_args, **_kwargs):
    raise Died


@pytest.mark.parametrize("rebuild", [False, True])
@pytest.mark.parametrize("step", ["publish", "write_table", "create"])
def test_a_load_that_dies_changes_nothing(spark, raw, tmp_path, dimensions, monkeypatch, step, rebuild):
    """Readers see all old facts and dimensions until everything is in place, then all new ones."""
    root = str(tmp_path / "lake")
    load(spark, str(raw), root, dimensions)
    before, opened = facts_of(spark, root), open_tables(spark, root)
    products = rows(opened.ncm)
    write(raw, "EXP_2026.csv", [EXPORT_HEADER, export_row(2026, fob="900")])
    os.rename(raw / "imp" / "IMP_2026.csv", tmp_path / "IMP_2026.csv")
    new = dimensions | {"ncm": dimensions["ncm"].withColumn("SETOR", F.lit("Novo"))}
    with monkeypatch.context() as patch:
        patch.setattr(storage if step == "create" else generations, step, die)
        with pytest.raises(Died):
            load(spark, str(raw), root, new, rebuild=rebuild)
    assert facts_of(spark, root) == before and rows(open_tables(spark, root).ncm) == products
    assert sorted(r["SOURCE_FILE"][-12:] for r in rows(read_facts(spark, root)))[-1] == "IMP_2026.csv"

    result = load(spark, str(raw), root, new, rebuild=rebuild)
    assert (result.files_loaded, result.files_removed) == (2 if rebuild else 1, 1)
    assert {r["SETOR"] for r in rows(open_tables(spark, root).ncm)} == {"Novo"}
    assert sorted(r["VL_FOB"] for r in rows(read_facts(spark, root))) == [1.5, 100, 900]
    # Who opened the lake before the switch still reads what was there then.
    assert sorted(map(str, rows(opened.fact))) == before and rows(opened.ncm) == products


def test_a_half_written_generation_is_passed_over(spark, raw, tmp_path):
    root = tmp_path / "lake"
    load(spark, str(raw), str(root))
    before = facts_of(spark, str(root))
    (root / "generations" / "000000000002").write_text('{"files": "tab')
    assert facts_of(spark, str(root)) == before
    write(raw, "EXP_2024.csv", [EXPORT_HEADER, export_row(2024)])
    assert load(spark, str(raw), str(root)).rows_loaded == 1
    assert generations.current(spark, str(root)).number == 3
    assert read_facts(spark, str(root)).count() == 6


def test_two_writers(spark, raw, tmp_path):
    root = str(tmp_path / "lake")
    load(spark, str(raw), root)
    base = generations.current(spark, root)
    second = generations.publish(spark, root, base, base.tables)
    with pytest.raises(generations.ConcurrentWrite):
        generations.publish(spark, root, base, base.tables)
    assert generations.current(spark, root) == second


def test_old_generations_go_last(spark, raw, tmp_path):
    """Two generations stay; folders that neither refers to are removed, others are not."""
    root = tmp_path / "lake"
    for year in (2010, 2011, 2012):
        write(raw, "EXP_2026.csv", [EXPORT_HEADER, export_row(2026, fob=str(year))])
        load(spark, str(raw), str(root))
    assert [g.number for g in generations.all_complete(spark, str(root))] == [2, 3]
    folders = sorted(str(p.relative_to(root / "fact")) for p in (root / "fact").glob("*/*/CO_ANO=2026/*") if "FLUXO=EXP" in str(p))
    assert len(folders) == 2
    assert len(list((root / "fact").glob("BATCH=*"))) == 3
    assert len(list((root / "tables").iterdir())) == 2
    assert sorted(r["VL_FOB"] for r in rows(read_facts(spark, str(root)).where("CO_ANO = 2026 AND FLUXO = 'EXP'"))) == [2012]


def test_empty_lake(spark, tmp_path):
    assert read_facts(spark, str(tmp_path)).count() == 0 and read_loads(spark, str(tmp_path)).count() == 0
    assert {r["ESTADO"] for r in rows(source_report(spark, str(tmp_path)))} == {"ausente"}
    with pytest.raises(FileNotFoundError):
        open_tables(spark, str(tmp_path))


@pytest.mark.parametrize(
    "name, lines, message",
    [
        ("EXP_2024.csv", [EXPORT_HEADER, export_row("x")], "sem linhas"),
        ("EXP_2024.csv", [EXPORT_HEADER], "sem linhas"),
        ("EXP_2024.csv", [EXPORT_HEADER, export_row(2024), export_row(2023)], "ano do nome 2024"),
        ("EXP_2024.csv", ["CO_ANO;CO_MES", "2024;1"], "Colunas ausentes em EXP_2024.csv: CO_NCM, CO_PAIS"),
        ("IMP_2024.csv", [EXPORT_HEADER, export_row(2024)], "VL_FRETE, VL_SEGURO"),
    ],
)
def test_a_bad_file_stops_the_batch(spark, raw, tmp_path, name, lines, message):
    root = str(tmp_path / "lake")
    load(spark, str(raw), root)
    write(raw, name, lines)
    write(raw, "EXP_2022.csv", [EXPORT_HEADER, export_row(2022)])
    with pytest.raises(RawFileError, match=message):
        load(spark, str(raw), root)
    assert read_facts(spark, root).count() == 5 and read_loads(spark, root).count() == 3


def test_charsets_and_headers(spark, tmp_path):
    folder = tmp_path / "raw"
    write(folder, "EXP_2020.csv", ["﻿" + EXPORT_HEADER, export_row(2020, uf="é")])
    odd = EXPORT_HEADER.lower().replace("co_ano", ' " co  ano"').split(";")
    # Columns in another order, headers in another spelling.
    swapped = ";".join([odd[1], odd[0], *odd[2:]])
    write(folder, "EXP_2021.csv", [swapped, "5;2021;1010100;10;249;€ã;1;1;2;20;8"], "cp1252")
    (folder / "exp" / "EXP_2022.csv").write_bytes(
        EXPORT_HEADER.encode() + b"\r\n" + export_row(2022, uf="@").encode().replace(b"@", b"\x81\xe3") + b"\r\n")
    paths = [str(folder / "exp" / f"EXP_{y}.csv") for y in (2020, 2021, 2022)]
    got = {r["source_file"][-8:-4]: r["charset"] for r in rows(inspect_files(spark, paths))}
    assert got == {"2020": "utf-8", "2021": "windows-1252", "2022": "latin-1"}
    root = str(tmp_path / "lake")
    load(spark, str(folder), root)
    facts = by(read_facts(spark, root), "CO_ANO")
    assert facts[2020]["SG_UF_NCM"] == "É" and facts[2021]["SG_UF_NCM"] == "€Ã"
    assert facts[2021]["CO_MES"] == 5 and facts[2022]["SG_UF_NCM"].endswith("Ã")


def test_folder_names_with_blanks_and_accents(spark, tmp_path):
    folder = tmp_path / "dados brutos é"
    write(folder, "EXP_2020 (v2).csv", [EXPORT_HEADER, export_row(2020)])
    root = str(tmp_path / "lake")
    assert load(spark, str(folder), root).rows_loaded == 1
    assert load(spark, str(folder), root).files_skipped == 1
    assert read_facts(spark, root).count() == 1


def test_nothing_to_load(spark, tmp_path):
    (tmp_path / "raw" / "exp").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "raw"), str(tmp_path / "lake"))
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none"), str(tmp_path / "lake"))


def test_rollup(spark, raw, tmp_path, dimensions):
    root, output = str(tmp_path / "lake"), str(tmp_path / "rollup")
    load(spark, str(raw), root, dimensions)
    with pytest.raises(ValueError):
        build_rollup(spark, root, root)
    result = build_rollup(spark, root, output)
    assert result.source_rows == 5 and result.rollup_rows == 5 and result.rollup_bytes > 0
    with pytest.raises(FileExistsError):
        build_rollup(spark, root, output)
    build_rollup(spark, root, output, force=True)

    full, both, small = open_tables(spark, root), open_tables(spark, root, rollup=output), open_tables(spark, None, rollup=output)
    assert full.rollup is None and both.rollup is not None and small.fact is None
    for state in (FilterState(year=2025), FilterState(flow="IMP"), FilterState(months=(1,), sectors=("Agropecuária",))):
        want = rows(summary_metrics(full, state))
        assert rows(summary_metrics(both, state)) == want and rows(summary_metrics(small, state)) == want
    assert rows(quality_report(small)) == rows(quality_report(full))
    assert {r["SG_UF_NCM"] for r in rows(small.rollup)} == {"SP", "Não informado"}
    sums = read_rollup_facts(spark, output)
    assert {r["CO_UNID"] for r in rows(sums)} == {None} and sums.schema.names == full.fact.schema.names
    assert open_tables(spark, root, rollup=output, prefer_rollup=False).rollup is None
    assert open_tables(spark, root, rollup=str(tmp_path / "none")).rollup is None
    assert by(small.loads, "flow").keys() == {"EXP", "IMP"}


def test_questions_go_where_they_are_answered(spark, raw, tmp_path, dimensions):
    """Units and offices are in the facts only; everything else comes from the sums."""
    root, output = str(tmp_path / "lake"), str(tmp_path / "rollup")
    load(spark, str(raw), root, dimensions)
    build_rollup(spark, root, output)
    both, small = open_tables(spark, root, rollup=output), open_tables(spark, None, rollup=output)

    def sources(frame):
        return {part for part in ("lake/fact", "rollup/fact") for f in frame.inputFiles() if part in f}

    by_month = facts_by(both, FilterState(year=2026), ["CO_MES", "SETOR"], ["VL_FOB", "REGISTROS"])
    assert sources(by_month) == {"rollup/fact"}
    by_unit = facts_by(both, FilterState(year=2026), ["UNIDADE"], ["VL_FOB", "REGISTROS"])
    assert sources(by_unit) == {"lake/fact"} and rows(by_unit)[0]["UNIDADE"] == "Quilograma"
    assert sources(facts_by(both, None, ["CO_URF"], ["VL_FOB"])) == {"lake/fact"}
    for columns in (["UNIDADE"], ["CO_URF"], ["CO_VIA", "CO_MES"]):
        with pytest.raises(NotInRollup):
            facts_by(small, None, columns, ["VL_FOB"])
    with pytest.raises(NotInRollup):
        star(small)

    # A rollup that is behind its lake is not asked.
    write(raw, "EXP_2026.csv", [EXPORT_HEADER, export_row(2026, fob="900")])
    load(spark, str(raw), root)
    late = open_tables(spark, root, rollup=output)
    assert late.rollup is None and rows(summary_metrics(late, FilterState(year=2026)))[0]["VL_FOB"] == 900
    refresh_rollup(spark, root, output)
    assert open_tables(spark, root, rollup=output).rollup is not None


def test_refresh_sums_what_changed(spark, raw, tmp_path, dimensions, monkeypatch):
    root, output = str(tmp_path / "lake"), tmp_path / "rollup"
    load(spark, str(raw), root, dimensions)
    refresh_rollup(spark, root, str(output))

    def folders():
        files = generations.current(spark, str(output)).files(spark)
        return {(r.flow, r.file_year): (r.batch, r.source_rows) for r in files}

    first = folders()
    assert first.keys() == {("EXP", 2025), ("EXP", 2026), ("IMP", 2026)}
    write(raw, "EXP_2026.csv", [EXPORT_HEADER, export_row(2026, fob="900"), export_row(2026, "4"), export_row(2026, "4")])
    load(spark, str(raw), root)
    with monkeypatch.context() as patch:
        patch.setattr(generations, "publish", die)
        with pytest.raises(Died):
            refresh_rollup(spark, root, str(output))
    assert folders() == first
    result = refresh_rollup(spark, root, str(output))
    second = folders()
    assert {k for k in second if second[k] != first[k]} == {("EXP", 2026)} and second["EXP", 2026][1] == 3
    assert (result.source_rows, result.rollup_rows) == (6, 5)
    whole = str(tmp_path / "whole")
    build_rollup(spark, root, whole)
    assert sorted(map(str, rows(read_rollup_facts(spark, str(output))))) == sorted(map(str, rows(read_rollup_facts(spark, whole))))
    assert folders() == second

    # A year that is gone goes from the rollup as well; nothing is summed again.
    os.rename(raw / "exp" / "EXP_2025.csv", tmp_path / "EXP_2025.csv")
    load(spark, str(raw), root)
    refresh_rollup(spark, root, str(output))
    assert folders() == {k: v for k, v in second.items() if k != ("EXP", 2025)}
    assert rows(generations.current(spark, str(output)).read(spark, "rollup_info"))[0]["source_rows"] == 4


def test_a_wrong_sum_is_not_published(spark, raw, tmp_path, dimensions, monkeypatch):
    root, output = str(tmp_path / "lake"), str(tmp_path / "rollup")
    load(spark, str(raw), root, dimensions)
    real = rollup.monthly_sums
    monkeypatch.setattr(rollup, "monthly_sums", lambda fact: real(fact.where("CO_MES <> 3")))
    with pytest.raises(RollupError, match="EXP 2026 KG_LIQUIDO"):
        build_rollup(spark, root, output)
    assert generations.current(spark, output) is None
    with pytest.raises(FileNotFoundError):
        read_rollup_facts(spark, output)


def test_rollup_needs_a_complete_source(spark, tmp_path, raw):
    root = str(tmp_path / "lake")
    load(spark, str(raw), root)
    with pytest.raises(RollupError, match="sem dim_calendar_month, dim_country, dim_ncm, dim_unit"):
        build_rollup(spark, root, str(tmp_path / "rollup"))


def test_rollup_check_finds_what_is_lost(spark, small):
    rollup = monthly_rollup(small.fact)
    assert rollup.count() == 4 and rows(rollup_mismatches(small.fact, rollup)) == []
    lost = rows(rollup_mismatches(small.fact, rollup.where("SG_UF_NCM <> 'GO'")))
    assert {(r["MEDIDA"], r["COMPLETO"] - r["AGREGADO"]) for r in lost} == {
        ("VL_FOB", 300.0), ("KG_LIQUIDO", 50.0), ("QT_ESTAT", 5.0)}
    # A flow that is missing altogether.
    assert len(rows(rollup_mismatches(small.fact, rollup.limit(0)))) == 5


def test_export(spark, tmp_path):
    frame = spark.createDataFrame(
        [("á;b", 12345678.5, 1), ('say "x"', 0.1 + 0.2, 2), ("", None, 3)], "t string, v double, n int")
    assert [r.v for r in with_decimal_comma(frame).collect()] == ["12345678,5", "0,30000000000000004", None]
    path = str(tmp_path / "out")
    write_csv(frame.coalesce(1), path)
    part = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv"][0]
    assert part.read_bytes().startswith(b"\xef\xbb\xbft;v;n")
    assert part.read_text(encoding="utf-8-sig").splitlines() == [
        "t;v;n", '"á;b";12345678,5;1', '"say ""x""";0,30000000000000004;2', ";;3"]


def test_one_pass_over_raw_files(spark, raw, tmp_path, monkeypatch):
    """Clean files are read once; a file with quoted line breaks, or rows of two charsets, twice."""
    root, reads, real = str(tmp_path / "lake"), [], lake.read_raw
    monkeypatch.setattr(lake, "read_raw", lambda s, layout, seen: reads.append(layout) or real(s, layout, seen))
    load(spark, str(raw), root)
    assert sorted((r.flow, len(r.paths), r.charset) for r in reads) == [("EXP", 2, None), ("IMP", 1, None)]
    reads.clear()

    noted = EXPORT_HEADER + ";OBS"
    write(raw, "EXP_2019.csv", [noted, export_row(2019) + ';"first', 'second; ""third"""', export_row(2019, "2") + ";x"])
    mixed = [noted, export_row(2018, uf="Ã£") + ";?", export_row(2018, "2", uf="ã") + ";?"]
    write(raw, "EXP_2018.csv", mixed, "cp1252")
    write(raw, "EXP_2017.csv", [noted, export_row(2017, uf="ã") + ";é", export_row(2017, "2", uf="€") + ";?"], "cp1252")
    write(raw, "EXP_2016.csv", [noted, export_row(2016, uf="ã") + ";€"])
    assert load(spark, str(raw), root).rows_loaded == 7
    assert [(r.charset, r.quoted_breaks, len(r.paths)) for r in reads] == [(None, False, 4), ("utf-8", True, 1), ("windows-1252", False, 1)]
    states = {}
    for r in rows(read_facts(spark, root).where("CO_ANO < 2020").orderBy("CO_ANO", "CO_MES")):
        states.setdefault(r["CO_ANO"], []).append(r["SG_UF_NCM"])
    assert states == {2016: ["Ã"], 2017: ["Ã", "€"], 2018: ["Ã£".upper(), "Ã"], 2019: ["SP", "SP"]}
    assert len({r["batch"] for r in map(lambda f: f.asDict(), generations.current(spark, root).files(spark))}) == 3
    assert load(spark, str(raw), root).files_loaded == 0
