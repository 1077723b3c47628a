"""Queries next to their SQL twins, on given tables and on rows with nulls, ties and odd blanks."""

from __future__ import annotations

import duckdb
import pytest
from compare import connect, difference

from cargolens.llm.queries import QUERIES
from cargolens.llm.twins import ORACLES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINES = "one two three four\n" * 20
ROWS = [
    (None, "No id", "en", "a", 5),
    (1, None, None, None, None),
    (2, "", "", "b", 0),
    (3, " \t\n\x0b\x0c\r ", None, "b", 7),
    (4, LINES, "en", "b", len(LINES)),
    (4, LINES, "en", "b", len(LINES)),
    (4, "Same id, other text", "en", "b", 19),
    *((k, " ".join(f"w{i * k % 97}" for i in range(k)) + " É #*", "de", "c", None) for k in range(5, 160)),
    (10**12, "x" * 100_000 + " #" * 300, "zz", "d", 1),
]


@pytest.mark.parametrize("name", ORACLES)
def test_on_given_tables(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


@pytest.mark.parametrize("name", ORACLES)
@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[1:2], []], ids=["all", "one", "null", "none"])
def test_on_odd_rows(spark, tmp_path, name, rows):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert difference(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None
