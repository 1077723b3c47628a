"""Run registered queries next to their SQL twins.

    python tests/compare.py /root/testdata/sf0.01 [name-part ...] [setting=value ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


_KINDS = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "void": "INTEGER",
}


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def difference(frame, con, sql: str) -> str | None:
    """None when both sides agree, else what differs first."""
    names = sorted(frame.columns)
    rows = sorted((tuple(r[n] for n in names) for r in frame.collect()), key=_key)
    result = con.execute(sql)
    described = {d[0]: str(d[1]) for d in result.description}
    if sorted(described) != names:
        return f"columns {names} against {sorted(described)}"
    positions = [list(described).index(n) for n in names]
    expected = sorted((tuple(r[i] for i in positions) for r in result.fetchall()), key=_key)
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    odd = [
        f"{n}: {types[n]} against {described[n]}" for n in names if _KINDS.get(types[n], types[n]) != described[n]
    ]
    if odd:
        return "types " + ", ".join(odd)
    if len(rows) != len(expected):
        return f"{len(rows)} rows against {len(expected)}"
    for mine, theirs in zip(rows, expected):
        bad = [n for n, a, b in zip(names, mine, theirs) if a != b]
        if bad:
            return f"{bad}: {dict(zip(names, mine))} against {dict(zip(names, theirs))}"
    return None


def main() -> int:
    import __spark_entry__ as registered
    from cargolens.session import session

    sf_dir, parts = sys.argv[1], [a for a in sys.argv[2:] if "=" not in a]
    settings = dict(a.split("=", 1) for a in sys.argv[2:] if "=" in a)
    local = {"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    spark = session(**{**local, **settings})
    spark.sparkContext.setLogLevel("ERROR")
    con, failures = connect(sf_dir), 0
    oracles = registered.oracle_sql()
    for name, run in registered.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            problem = difference(frame, con, oracles[name]) if name in oracles else None
            rows = frame.count() if not problem else "-"
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", "-"
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name:42} {rows!s:>8} {time.time() - start:6.1f}s {problem or ''}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(main() > 0)
