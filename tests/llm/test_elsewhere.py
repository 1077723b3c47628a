"""The queries from another folder, where workers cannot find the package by themselves."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from cargolens.session import session
spark = session(**{"spark.master": "local[2]", "spark.sql.shuffle.partitions": "2",
                   "spark.checkpoint.dir": sys.argv[2], "spark.sql.warehouse.dir": sys.argv[2] + "/warehouse"})
for name in ("op10_suffix_dedup", "op12_pair_index_bpe"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_get_the_package(tmp_path):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", CODE, ROOT, str(tmp_path)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split() == ["op10_suffix_dedup", "200", "op12_pair_index_bpe", "200"]
