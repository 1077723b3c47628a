"""Raw files written and read without steps that grow with the files."""

from __future__ import annotations

import csv

import pytest
from conftest import fact, make_tables, rows
from pyspark.sql import functions as F

from cargolens.sources import raw
from registry import rawfiles


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "content, kind",
    [
        (b"", raw.PLAIN),
        (b"plain; text", raw.PLAIN),
        ("Operação €".encode(), raw.IS_UTF8),
        ("Operação €".encode("cp1252"), raw.IS_WINDOWS),
        ("Operação".encode("latin-1") + b"\x81", raw.IS_LATIN),
        (b"\x9d", raw.IS_LATIN),
        (b"\xc3\x9d", raw.IS_UTF8),
    ],
)
def test_the_bytes_of_a_row_are_looked_at_once(spark, content, kind):
    found = raw._kind(F.col("text"))
    frame = spark.createDataFrame([(content.decode("latin-1"),)], "text string").select(found.alias("kind"))
    assert rows(frame) == [{"kind": kind}]
    assert str(found).count("encode(") == 1


def test_cells_of_ascii_are_not_decoded(spark, tmp_path):
    """A row is decoded for its cells, not for what other columns hold."""
    (tmp_path / "x.csv").write_bytes("CO_NCM;SG_UF_NCM;OBS\n1;SP;ação\n2;ã;ação\n;;ação\n".encode())
    read = raw.read_raw(spark, raw.Layout("EXP", "CO_NCM;SG_UF_NCM;OBS", (str(tmp_path / "x.csv"),)))
    assert [(r["CO_NCM"], r["SG_UF_NCM"]) for r in rows(read)] == [("1", "SP"), ("2", "ã"), (None, None)]
    text = plan(read)
    assert text.index("octet_length(concat_ws(, CO_NCM") < text.index("transform(")


def test_raw_years_are_written_as_they_are_read(spark, tmp_path, monkeypatch):
    """No shuffle, so files end at a number of rows; no file is a header alone."""
    monkeypatch.setattr(rawfiles, "ROWS_PER_FILE", 2)
    facts = [fact(flow, year, 1 + k % 12, f"{k:08d}", "249", "SP", k, k, k) for flow in ("EXP", "IMP") for year in (1997, 1998) for k in range(7)]
    frame = make_tables(spark, facts).fact
    frame.write.partitionBy("FLUXO", "CO_ANO").parquet(str(tmp_path / "fact"))
    stored = spark.read.schema(frame.schema).parquet(str(tmp_path / "fact"))
    folder = rawfiles.write_raw_folder(spark, stored, str(tmp_path / "out"))
    assert folder == f"{tmp_path}/out/raw"
    counts = {}
    for path in (tmp_path / "out" / "raw").glob("*/*.csv"):
        with open(path, encoding="utf-8" if path.parent.name == "exp" else "latin-1", newline="") as lines:
            found = list(csv.DictReader(lines, delimiter=";"))
        assert 1 <= len(found) <= 2
        key = (path.parent.name, path.name.split("_")[1])
        counts[key] = counts.get(key, 0) + len(found)
    assert counts == {(flow, year): 7 for flow in ("exp", "imp") for year in ("1997", "1998")}
