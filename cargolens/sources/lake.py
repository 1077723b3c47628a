"""The trade lake: Parquet tables kept in step with a folder of raw files.

A load reads all new and changed raw files in one job and writes their facts once, under a
batch of their own, in folders by flow, year and raw file. The facts are checked where they
lie, and then one generation (see ``generations``) says which folders and which dimension
tables count from now on. Nothing is moved or removed before that, so a load that dies at any
point leaves the old facts and dimensions as they were, and is simply repeated.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.model import FACT_SCHEMA, MEASURES, TradeTables
from cargolens.plans.sizes import small_tasks
from cargolens.plans.star import KEYS, ROLLUP_KEYS, ROW_COUNT, require_unique
from cargolens.sources import generations, storage
from cargolens.sources.generations import FILE_FIELDS, Generation
from cargolens.sources.raw import (
    Layout,
    RawFileError,
    clean_facts,
    discover_fact_files,
    load_report,
    missing_columns,
    observed_kinds,
    read_raw,
    with_headers,
)

PARTITIONS = ("FLUXO", "CO_ANO", "SOURCE_ID")
DIMENSIONS = {
    "ncm": "dim_ncm",
    "country": "dim_country",
    "unit": "dim_unit",
    "calendar": "dim_calendar_month",
}
LOADS_SCHEMA = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("flow", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("rows_loaded", T.LongType()),
        T.StructField("loaded_at", T.TimestampNTZType()),
        T.StructField("file_year", T.IntegerType()),
    ]
)
FILES_SCHEMA = T.StructType([*LOADS_SCHEMA.fields, *FILE_FIELDS])


@dataclass(frozen=True)
class LoadResult:
    files_loaded: int
    files_skipped: int
    files_removed: int
    rows_loaded: int


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def source_id(source_file):
    """A folder-safe name for a raw file, the same on every run."""
    return F.sha2(source_file, 256)


def _files(spark: SparkSession, generation: Generation | None) -> DataFrame:
    if generation is None:
        return spark.createDataFrame([], FILES_SCHEMA)
    return spark.read.schema(FILES_SCHEMA).parquet(generation.path("files"))


def read_loads(spark: SparkSession, root: str) -> DataFrame:
    """The raw files whose facts are in the lake."""
    return _files(spark, generations.current(spark, root)).select(*LOADS_SCHEMA.names)


def plan_load(files: DataFrame, loads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to read (new or changed) and loaded files that are gone from the folder."""
    known = loads.select("source_file", F.col("fingerprint").alias("known"))
    changed = files.join(known, "source_file", "left").where(
        ~F.col("known").eqNullSafe(F.col("fingerprint"))
    )
    return changed.drop("known"), loads.join(files, "source_file", "left_anti")


def _layouts(files: list, seen: dict[str, tuple[str, bool, bool]] | None = None) -> list[Layout]:
    """Files that are read together; with ``seen``, by the charset and line breaks found in them."""
    groups: dict[tuple, list[str]] = {}
    for row in files:
        charset, quoted, _ = seen[row.source_file] if seen else (None, False, False)
        groups.setdefault((row.flow, row.header, charset or "", quoted), []).append(row.path)
    return [
        Layout(flow, header, tuple(sorted(paths)), charset or None, quoted)
        for (flow, header, charset, quoted), paths in sorted(groups.items())
    ]


def _raise_on(problems: DataFrame, text) -> None:
    """Raise with up to five offending files."""
    found = problems.select(text.alias("text")).orderBy("text").limit(5).collect()
    if found:
        raise RawFileError("; ".join(row.text for row in found))


def check_dimensions(dimensions: dict[str, DataFrame]) -> None:
    """Raise when a dimension holds a key twice, as its joins would count facts twice."""
    for name, keys in KEYS.items():
        if name in dimensions:
            require_unique(dimensions[name], name, keys)


def load(
    spark: SparkSession,
    raw_dir: str,
    root: str,
    dimensions: dict[str, DataFrame] | None = None,
    *,
    rebuild: bool = False,
) -> LoadResult:
    """Bring the lake in step with the raw folder.

    Unchanged files are skipped, changed ones replaced, vanished ones left out; dimensions that
    are given replace the stored ones. All of it takes effect at once, as the lake's next
    generation. When a file is bad or a dimension repeats a key, there is none. ``rebuild`` loads
    every file again, changed or not.
    """
    root = root.rstrip("/")
    found = discover_fact_files(spark, raw_dir)
    # One row per file. Taken once, so that every later step sees the same state.
    listing = found.collect()
    if not listing:
        raise FileNotFoundError(f"{raw_dir} não contém arquivos anuais EXP_ ou IMP_")
    files = spark.createDataFrame(listing, found.schema)
    if dimensions:
        check_dimensions(dimensions)

    before = generations.current(spark, root)
    known = _files(spark, before)
    changed, vanished = plan_load(files, known)
    to_read = listing if rebuild else changed.collect()
    gone = vanished.count()
    if not (to_read or gone or dimensions):
        return LoadResult(0, len(listing), 0, 0)

    batches = [generations.new_id(), generations.new_id()]
    try:
        loaded = _load_files(spark, root, batches, to_read) if to_read else []
        tables = dict(before.tables) if before else {}
        for name, frame in (dimensions or {}).items():
            tables[DIMENSIONS[name]] = generations.write_table(frame, root, DIMENSIONS[name])
        replaced = spark.createDataFrame([(row.source_file,) for row in to_read], "source_file string")
        kept = known.join(files, "source_file", "left_semi").join(replaced, "source_file", "left_anti")
        after = kept.unionByName(spark.createDataFrame(loaded, FILES_SCHEMA))
        tables["files"] = generations.write_table(after.coalesce(1), root, "files")
    except Exception:
        _remove_batches(spark, root, batches)
        raise
    try:
        generations.publish(spark, root, before, tables)
    except generations.ConcurrentWrite:
        # After any other failure it is not known whether the generation holds, so its facts stay.
        _remove_batches(spark, root, batches)
        raise
    generations.expire(spark, root)
    return LoadResult(len(to_read), len(listing) - len(to_read), gone, sum(row[3] for row in loaded))


def _remove_batches(spark: SparkSession, root: str, batches: list[str]) -> None:
    for batch in batches:
        storage.remove(spark, f"{root}/fact/{generations.BATCH}={batch}")


def _load_files(spark: SparkSession, root: str, batches: list[str], to_read: list) -> list[tuple]:
    """Write the facts of the given raw files and check them; their entries in ``files``.

    All files are read once, into the first batch. Those that turn out to have line breaks
    inside quotes, or rows that look like different charsets, are read again into the second.
    """
    files = with_headers(spark, spark.createDataFrame(to_read))
    found = files.collect()
    _raise_on(
        missing_columns(spark.createDataFrame(found, files.schema)),
        F.concat(F.lit("Colunas ausentes em "), "file_name", F.lit(": "), F.array_join("missing", ", ")),
    )
    seen = _write_facts(spark, root, batches[0], _layouts(found))
    again = {file for file, (_, quoted, mixed) in seen.items() if quoted or mixed}
    once = [row for row in found if row.source_file not in again]
    twice = [row for row in found if row.source_file in again]
    if twice:
        _write_facts(spark, root, batches[1], _layouts(twice, seen))
    report = [(batches[0], row) for row in _report(spark, root, batches[0], once)]
    report += [(batches[1], row) for row in _report(spark, root, batches[1], twice)]
    bad = sorted(f"{row.file_name}: {row.problem}" for _, row in report if row.problem)
    if bad:
        raise RawFileError("; ".join(bad[:5]))
    now, folders = _now(), {batches[0]: len(found), batches[1]: len(twice)}
    return [
        (
            r.source_file, r.flow, r.fingerprint, r.rows_loaded, now, r.file_year, batch,
            f"FLUXO={r.flow}/CO_ANO={r.file_year}/SOURCE_ID={r.SOURCE_ID}", folders[batch],
        )
        for batch, r in report
    ]


def _write_facts(spark: SparkSession, root: str, batch: str, layouts: list[Layout]) -> dict[str, tuple[str, bool, bool]]:
    """Clean the rows of raw files into a batch; what their bytes were, by file."""
    observed = [Observation() for _ in layouts]
    cleaned = [clean_facts(read_raw(spark, layout, seen), layout.flow) for layout, seen in zip(layouts, observed)]
    facts = reduce(DataFrame.unionByName, cleaned).withColumn("SOURCE_ID", source_id(F.col("SOURCE_FILE")))
    # Rows of one raw file are neighbours already; sorting within the task gives
    # tight month and product ranges per row group without a shuffle.
    ordered = facts.sortWithinPartitions(*PARTITIONS, "CO_MES", "CO_NCM")
    with small_tasks(spark):
        ordered.write.partitionBy(*PARTITIONS).parquet(f"{root}/fact/{generations.BATCH}={batch}")
    return {file: kinds for seen in observed for file, kinds in observed_kinds(seen).items()}


def _report(spark: SparkSession, root: str, batch: str, files: list) -> list:
    """Row counts and years of the facts of ``files``, from folder names and row counts alone."""
    if not files:
        return []
    place = f"{root}/fact/{generations.BATCH}={batch}"
    written = spark.read.schema(fact_storage_schema()).parquet(place)
    named = spark.createDataFrame(files).withColumn("SOURCE_ID", source_id(F.col("source_file")))
    return load_report(named, written.select("SOURCE_ID", "CO_ANO"), "SOURCE_ID").collect()


def fact_storage_schema() -> T.StructType:
    """Columns of the stored facts, the partition columns last."""
    data = [f for f in FACT_SCHEMA if f.name not in PARTITIONS]
    keys = [T.StructField(f.name, f.dataType) for f in FACT_SCHEMA if f.name in PARTITIONS]
    return T.StructType([*data, *keys, T.StructField("SOURCE_ID", T.StringType())])


def read_facts(spark: SparkSession, root: str) -> DataFrame:
    """The stored facts; flow and year filters select folders, not rows."""
    root, generation = root.rstrip("/"), generations.current(spark, root)
    files = generation.files(spark) if generation else []
    return generations.read_folders(spark, root, files, fact_storage_schema()).select(*FACT_SCHEMA.names)


def source_report(spark: SparkSession, root: str) -> DataFrame:
    """Each table that a complete lake has, and whether it is there and has rows."""
    generation = generations.current(spark, root)
    needed = ["files", *DIMENSIONS.values()]
    found = {t: generation.read(spark, t) for t in needed if generation and t in generation.tables}
    if "files" in found:
        found = {"fact": found["files"].where("rows_loaded > 0"), "loads": found.pop("files"), **found}
    rows = []
    for table in ("fact", "loads", *DIMENSIONS.values()):
        state = "ausente" if table not in found else "vazia" if found[table].isEmpty() else "completa"
        rows.append((table, state))
    return spark.createDataFrame(rows, "TABELA string, ESTADO string")


def open_tables(
    spark: SparkSession, root: str | None, *, rollup: str | None = None, prefer_rollup: bool = True
) -> TradeTables:
    """The tables to query: the lake, and the rollup at ``rollup`` where it answers the same.

    Each question goes to the rollup if that covers all columns and measures it needs, else to
    the facts, so results never depend on the choice. A rollup that is older than the lake's
    last load is left aside. Without ``root`` there is the rollup alone, and a question that it
    does not cover raises ``NotInRollup``.
    """
    generation = generations.current(spark, root) if root else None
    sums = generations.current(spark, rollup) if rollup and prefer_rollup else None
    base = generation or sums
    if base is None:
        raise FileNotFoundError(f"Nenhuma carga publicada em {root or rollup}")
    if generation and sums and folder_marks(spark, generation) != rollup_marks(spark, sums):
        sums = None
    dims = {name: base.read(spark, table) for name, table in DIMENSIONS.items() if table in base.tables}
    missing = sorted(DIMENSIONS[name] for name in DIMENSIONS.keys() - dims.keys())
    if missing:
        raise FileNotFoundError(f"Tabelas ausentes em {base.root}: {', '.join(missing)}")
    return TradeTables(
        fact=read_facts(spark, root) if generation else None,
        loads=_files(spark, generation).select(*LOADS_SCHEMA.names) if generation else base.read(spark, "loads"),
        rollup=read_sums(spark, sums) if sums else None,
        checked=set(DIMENSIONS),
        **dims,
    )


def folder_marks(spark: SparkSession, generation: Generation) -> dict[tuple[str, int], str]:
    """For each flow and year of the lake a mark that changes with any of its raw files."""
    rows: dict[tuple[str, int], list[str]] = {}
    for r in generation.files(spark):
        rows.setdefault((r.flow, r.file_year), []).append(f"{r.batch}/{r.folder}")
    return {key: sha256("\n".join(sorted(names)).encode()).hexdigest() for key, names in rows.items()}


def rollup_marks(spark: SparkSession, generation: Generation) -> dict[tuple[str, int], str]:
    """The marks of the flows and years that a rollup was summed from."""
    return {(r.flow, r.file_year): r.mark for r in generation.files(spark)}


def sums_schema() -> T.StructType:
    """Columns of the stored sums, the folders' keys last."""
    kinds = {f.name: f.dataType for f in FACT_SCHEMA}
    data = [T.StructField(c, kinds[c]) for c in (*ROLLUP_KEYS, *MEASURES) if c not in PARTITIONS]
    keys = [T.StructField(c, kinds[c]) for c in PARTITIONS if c in kinds]
    return T.StructType([*data, T.StructField(ROW_COUNT, T.LongType()), *keys])


def read_sums(spark: SparkSession, generation: Generation) -> DataFrame:
    """The sums of a rollup with the number of facts behind each."""
    return generations.read_folders(spark, generation.root, generation.files(spark), sums_schema())
