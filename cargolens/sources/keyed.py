"""Stored tables with a declared key.

That a key is unique is checked once, on the rows that were written, and noted beside them
together with a fingerprint of the files. Readers rely on the note: they join the table as it is,
and no job runs while their plan is built.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.model import DimensionError
from cargolens.sources import storage

_NOTE = "_declared_key.json"


@dataclass(frozen=True)
class KeyedTable:
    """A table and the columns of which no two rows share all values."""

    frame: DataFrame
    keys: tuple[str, ...]


def _fingerprint(spark: SparkSession, path: str) -> str:
    files = sorted(f for f in storage.list_sizes(spark, path) if not f[0].startswith(("_", ".")))
    return hashlib.sha256(json.dumps(files).encode()).hexdigest()


def write_keyed(frame: DataFrame, path: str, keys: tuple[str, ...]) -> KeyedTable:
    """Store ``frame`` and declare its key; nothing is declared if a key repeats or is missing."""
    spark = frame.sparkSession
    frame.write.parquet(path)
    stored = spark.read.schema(frame.schema).parquet(path)
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    found = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | missing)
    wrong = sorted(r[0] for r in found.select(key).limit(5).collect())
    if wrong:
        raise DimensionError(f"{', '.join(keys)} não é chave de {path}: {', '.join(wrong)}")
    note = json.dumps({"keys": list(keys), "files": _fingerprint(spark, path)})
    storage.create(spark, f"{path}/{_NOTE}", note + "\n")
    return KeyedTable(stored, tuple(keys))


def read_keyed(spark: SparkSession, path: str) -> KeyedTable:
    """A table that ``write_keyed`` stored. Raises if it has no note, or its files are others now."""
    place = f"{path}/{_NOTE}"
    if not storage.exists(spark, place):
        raise DimensionError(f"{path} não declara chave.")
    note = json.loads(storage.read_text(spark, place))
    if note["files"] != _fingerprint(spark, path):
        raise DimensionError(f"Os arquivos de {path} não são os da chave declarada.")
    return KeyedTable(spark.read.parquet(path), tuple(note["keys"]))
