"""Steps whose tasks must stay small however large the tables are."""

from __future__ import annotations

from conftest import SMALL_FACTS, fact, make_tables, rows

from cargolens.operators import quality
from cargolens.plans import sizes
from cargolens.plans.star import ROLLUP_KEYS
from cargolens.sources import lake, rollup, storage

def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rollup_sums_after_one_shuffle_in_small_parts(spark, tmp_path, monkeypatch):
    facts = SMALL_FACTS + [fact("EXP", 2026, 1, "01010100", "249", uf, 1, 1, 1) for uf in ("SP", " ", None, "")]
    make_tables(spark, facts).fact.repartition(4).write.parquet(str(tmp_path / "fact"))
    stored = spark.read.parquet(str(tmp_path / "fact"))
    monkeypatch.setattr(sizes, "STORED_BYTES", 1000)
    summed = rollup.monthly_rollup(stored)
    text = plan(summed)
    assert text.count("Exchange hashpartitioning") == 1 and text.rindex("HashAggregate") < text.index("Exchange")
    assert sizes.parts(stored) > 8 and f", {sizes.parts(stored)})" in text
    keys = [tuple(r[k] for k in ROLLUP_KEYS) for r in rows(summed)]
    assert len(keys) == len(set(keys)) == 5
    assert {r["SG_UF_NCM"]: r["VL_FOB"] for r in rows(summed) if r["CO_PAIS"] == "249" and r["CO_NCM"] == "01010100"} == {
        "SP": 101.0, "MG": 150.0, "Não informado": 3.0}


def test_inputs_of_unknown_size_do_not_count(spark):
    assert sizes.parts(spark.createDataFrame([(1,)], "a int").repartition(2)) == 8


def test_quality_sums_facts_by_one_dimension_at_a_time(small, monkeypatch):
    asked, real = [], quality.facts_by
    monkeypatch.setattr(quality, "facts_by", lambda t, state, columns, measures: asked.append(set(columns)) or real(t, state, columns, measures))
    found = {r["INDICADOR"]: r["VALOR"] for r in rows(quality.quality_report(small))}
    assert found["Registros na fato"] == 4 and found["País sem descrição"] == 0
    assert not [c for c in asked if len(c & {"SETOR", "PAIS", "DIAS_UTEIS"}) > 1]
    assert set().union(*asked) >= {"SETOR", "PAIS", "DIAS_UTEIS", "CO_SH2", "NO_SH6_POR"}


def test_raw_files_are_sorted_in_small_tasks(spark, tmp_path, monkeypatch):
    """Rows of one large file go through several tasks, and the session's settings stay."""
    header = "CO_ANO;CO_MES;CO_NCM;CO_UNID;CO_PAIS;SG_UF_NCM;CO_VIA;CO_URF;QT_ESTAT;KG_LIQUIDO;VL_FOB"
    lines = [f"2025;{1 + k % 12};{k};10;249;SP;1;1;2;20;{k}" for k in range(20_000)]
    (tmp_path / "raw" / "exp").mkdir(parents=True)
    (tmp_path / "raw" / "exp" / "EXP_2025.csv").write_text("\n".join([header, *lines]))
    before = {key: spark.conf.get(key) for key in sizes.TASK_BYTES}
    monkeypatch.setitem(sizes.TASK_BYTES, "spark.sql.files.maxPartitionBytes", 10_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lake.load(spark, str(tmp_path / "raw"), str(tmp_path / "lake"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {key: spark.conf.get(key) for key in sizes.TASK_BYTES} == before
    # As many as the file has parts; by the number of cores alone there are 8.
    assert len(storage.list_paths(spark, f"{tmp_path}/lake/fact/*/*/*/*/*.parquet")) > 40
    facts = rows(lake.read_facts(spark, str(tmp_path / "lake")))
    assert sorted(int(r["VL_FOB"]) for r in facts) == list(range(20_000))


def test_small_tasks_keep_smaller_settings(spark):
    read, shuffled = sizes.TASK_BYTES
    spark.conf.set(read, "1m")
    try:
        with sizes.small_tasks(spark):
            assert spark.conf.get(read) == "1m" and spark.conf.get(shuffled) == str(sizes.TASK_BYTES[shuffled])
        assert spark.conf.get(read) == "1m"
    finally:
        spark.conf.unset(read)
