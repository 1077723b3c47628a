"""Generations of a set of stored tables: readers see all of one, a writer adds the next.

Layout under a root::

    fact/BATCH=../...        facts, written once per batch and never changed
    tables/<name>-<id>       every other table, likewise
    generations/<number>     which of them belong together; the greatest number holds

A generation is put in place by creating its file where there is none, and that is the only
switch: before it a reader sees all old tables, after it all new ones, and a writer that dies
earlier leaves the old ones as they were. What only older generations refer to is removed last.
The table ``files`` of a generation names the fact folders that count; others are not read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from cargolens.sources import storage

BATCH = "BATCH"
#: Columns of ``files``: the batch, the folder below it, and how many folders the batch wrote.
FILE_FIELDS = (
    T.StructField("batch", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("batch_folders", T.IntegerType()),
)


class ConcurrentWrite(RuntimeError):
    """Another writer has published since this one looked."""


@dataclass(frozen=True)
class Generation:
    root: str
    number: int
    tables: dict[str, str]

    def path(self, table: str) -> str:
        return f"{self.root}/{self.tables[table]}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(self.path(table))

    def files(self, spark: SparkSession) -> list[Row]:
        """The fact folders that count: one row per folder, so the driver sees names only."""
        return self.read(spark, "files").collect()


def new_id() -> str:
    return uuid.uuid4().hex


def _read(spark: SparkSession, root: str, path: str) -> Generation | None:
    """None for a file whose writer has not finished it."""
    text = storage.read_text(spark, path)
    if not text.endswith("\n"):
        return None
    return Generation(root, int(path.rsplit("/", 1)[1]), json.loads(text))


def all_complete(spark: SparkSession, root: str) -> list[Generation]:
    """Every generation that is still there, oldest first."""
    root = root.rstrip("/")
    found = (_read(spark, root, path) for path in storage.list_paths(spark, f"{root}/generations/[0-9]*"))
    return [g for g in found if g is not None]


def current(spark: SparkSession, root: str) -> Generation | None:
    """The generation that holds, or None where nothing was ever published."""
    root = root.rstrip("/")
    for path in reversed(storage.list_paths(spark, f"{root}/generations/[0-9]*")):
        if (generation := _read(spark, root, path)) is not None:
            return generation
    return None


def write_table(frame: DataFrame, root: str, name: str) -> str:
    """Store a table under a name of its own; returns its place below the root."""
    place = f"tables/{name}-{new_id()}"
    frame.write.parquet(f"{root}/{place}")
    return place


def publish(spark: SparkSession, root: str, base: Generation | None, tables: dict[str, str]) -> Generation:
    """Make ``tables`` the next generation after ``base``, the one this writer started from.

    Raises ``ConcurrentWrite`` when another writer was first. A file that a writer left
    unfinished is passed over.
    """
    number = base.number if base else 0
    while True:
        number += 1
        path = f"{root}/generations/{number:012d}"
        if storage.create(spark, path, json.dumps(tables) + "\n"):
            return Generation(root, number, tables)
        time.sleep(0.2)  # it may be in the middle of being written
        if _read(spark, root, path) is not None:
            raise ConcurrentWrite(f"Outra carga publicou a geração {number} de {root}.")


def fact_paths(root: str, files: Iterable[Row]) -> list[str]:
    """Paths of the given fact folders; a batch of which all folders count is one path."""
    batches: dict[str, list[Row]] = {}
    for row in files:
        batches.setdefault(row.batch, []).append(row)
    paths = []
    for batch, rows in sorted(batches.items()):
        base = f"{root}/fact/{BATCH}={batch}"
        whole = len(rows) == rows[0].batch_folders
        paths += [base] if whole else sorted(f"{base}/{r.folder}" for r in rows)
    return paths


def read_folders(spark: SparkSession, root: str, files: Iterable[Row], schema: T.StructType) -> DataFrame:
    """The facts in the given folders; filters on the folders' keys select folders, not rows."""
    paths = fact_paths(root, files)
    if not paths:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])
    return spark.read.schema(stored).option("basePath", f"{root}/fact").parquet(*paths).drop(BATCH)


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove what only generations before the last ``keep`` refer to.

    Readers that opened one of the last ``keep`` generations go on undisturbed. The file of a
    generation goes last, so an interrupted removal is taken up by the next one.
    """
    known = all_complete(spark, root)
    old, kept = known[:-keep], known[-keep:]
    if not old:
        return
    live = {(r.batch, r.folder) for g in kept for r in g.files(spark)}
    batches = {batch for batch, _ in live}
    still = {place for g in kept for place in g.tables.values()}
    for generation in old:
        if storage.exists(spark, generation.path("files")):
            dead = {(r.batch, r.folder) for r in generation.files(spark)} - live
            for batch in {b for b, _ in dead} - batches:
                storage.remove(spark, f"{root}/fact/{BATCH}={batch}")
            for batch, folder in sorted(dead):
                if batch in batches:
                    storage.remove(spark, f"{root}/fact/{BATCH}={batch}/{folder}")
        places = sorted(set(generation.tables.values()) - still, key=lambda p: p == generation.tables["files"])
        for place in places:
            storage.remove(spark, f"{root}/{place}")
        storage.remove(spark, f"{root}/generations/{generation.number:012d}")
