"""Raw fact files: finding them, checking them, reading and cleaning their rows.

Rows are read once, byte for byte, and cleaned at once. What the bytes of each file turn out to
be is observed on the way; the few files that need it are read a second time. The driver handles
file names, header lines and counts only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from cargolens.functions.cleaning import (
    CODE_WIDTHS,
    as_constant,
    normalize_header,
    pad_code,
    parse_integer,
    parse_measure,
    plain_numbers,
    state_code,
)
from cargolens.model import (
    EXPORT,
    EXPORT_COLUMNS,
    FACT_SCHEMA,
    IMPORT,
    IMPORT_COLUMNS,
    MEASURES,
)
from cargolens.sources import storage

UTF8, WINDOWS, LATIN = "utf-8", "windows-1252", "latin-1"
REQUIRED = {EXPORT: EXPORT_COLUMNS, IMPORT: IMPORT_COLUMNS}
NUMERIC = ("CO_ANO", "CO_MES", *MEASURES)


class RawFileError(ValueError):
    """A raw file that cannot be loaded."""


def _cp1252_only() -> tuple[str, str]:
    """Control characters of Latin-1 and what Windows-1252 puts in their place."""
    controls, letters = [], []
    for byte in range(0x80, 0xA0):
        try:
            letters.append(bytes([byte]).decode("cp1252"))
            controls.append(chr(byte))
        except UnicodeDecodeError:
            continue
    return "".join(controls), "".join(letters)


_CONTROLS, _LETTERS = _cp1252_only()
# Bytes without a meaning in Windows-1252, as Latin-1 reads them.
_UNDEFINED = "".join(chr(b) for b in range(0x80, 0xA0) if chr(b) not in _CONTROLS)
# What a row's bytes are: ASCII, else valid UTF-8, else defined in Windows-1252, else Latin-1.
PLAIN, IS_UTF8, IS_WINDOWS, IS_LATIN = range(4)
CHARSETS = {PLAIN: UTF8, IS_UTF8: UTF8, IS_WINDOWS: WINDOWS, IS_LATIN: LATIN}
_BROKEN = "_broken"
# Bytes of a file that its header line is looked for in.
HEADER_BYTES = 65_536


def discover_fact_files(spark: SparkSession, raw_dir: str) -> DataFrame:
    """Files ``exp/EXP_AAAA*.csv`` and ``imp/IMP_AAAA*.csv`` with their fingerprint.

    The flow is the folder's; the file name must agree with it and carry a year.
    Only file metadata is read.
    """
    try:
        found = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.csv")
            .load(f"{raw_dir.rstrip('/')}/{{exp,imp}}")
            .select("path", F.col("_metadata.file_path").alias("source_file"), "length", "modificationTime")
        )
    except AnalysisException as error:
        raise FileNotFoundError(f"Nenhuma pasta exp ou imp sob {raw_dir}") from error
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    flow = F.upper(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    files = found.withColumns({"flow": flow, "file_name": name}).where(
        F.col("file_name").rlike(r"(?i)^(EXP|IMP)_\d{4}")
        & (F.upper(F.substring("file_name", 1, 3)) == F.col("flow"))
    )
    print_of = F.concat_ws("|", "source_file", F.col("length"), F.unix_micros("modificationTime"))
    return files.select(
        "flow",
        "source_file",
        "path",
        "file_name",
        F.regexp_extract("file_name", r"_(\d{4})", 1).cast("int").alias("file_year"),
        F.col("length").alias("file_bytes"),
        F.sha2(print_of, 256).alias("fingerprint"),
    )


def _beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def _kind(text: Column) -> Column:
    """What the bytes of ``text`` are, one character per byte."""
    # The bytes stand in one branch only: what branches share is worked out in each of them again.
    raw = F.encode(text, "ISO-8859-1")
    return (
        F.when(~_beyond_ascii(text), PLAIN)
        .when(F.is_valid_utf8(raw.cast("string")), IS_UTF8)
        .when(text.rlike(f"[{_UNDEFINED}]"), IS_LATIN)
        .otherwise(IS_WINDOWS)
    )


def inspect_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The charset of each file, from one pass over the whole files.

    UTF-8 when every line is valid UTF-8, else Windows-1252 unless a line has a byte that it
    does not define, else Latin-1.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\x00").option("quote", "").schema("value string").csv(paths)
    files = lines.groupBy(F.col("_metadata.file_path").alias("source_file")).agg(F.max(_kind(F.coalesce("value", F.lit("")))).alias("kind"))
    charset = reduce(lambda c, kind: c.when(F.col("kind") == kind, CHARSETS[kind]), (PLAIN, IS_UTF8, IS_LATIN), F)
    return files.select("source_file", charset.otherwise(WINDOWS).alias("charset"))


def header_line(spark: SparkSession, path: str) -> str:
    """The first line of a file, read by itself."""
    first = storage.first_bytes(spark, path, HEADER_BYTES).splitlines()[:1]
    line = first[0] if first else b""
    try:
        return line.decode("utf-8-sig")
    except UnicodeDecodeError:
        return line.decode("latin-1").translate(str.maketrans(_CONTROLS, _LETTERS))


def with_headers(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``files`` with their header lines; as many rows as there are files."""
    found = files.collect()
    headers = [(r.source_file, header_line(spark, r.path)) for r in found]
    return files.join(spark.createDataFrame(headers, "source_file string, header string"), "source_file")


def header_names(header: Column) -> Column:
    """Normalised column names of a header line."""
    cells = F.transform(F.split(header, ";"), lambda c: F.trim(c, F.lit('" \t')))
    return F.transform(cells, lambda c: F.regexp_replace(F.upper(c), r"\s+", "_"))


def missing_columns(files: DataFrame) -> DataFrame:
    """Files (with ``flow`` and ``header``) that lack required columns, and which ones."""
    required = F.when(
        F.col("flow") == IMPORT, F.array(*[F.lit(c) for c in IMPORT_COLUMNS])
    ).otherwise(F.array(*[F.lit(c) for c in EXPORT_COLUMNS]))
    lacking = F.array_sort(F.array_except(required, header_names(F.col("header"))))
    return files.withColumn("missing", lacking).where(F.size("missing") > 0)


@dataclass(frozen=True)
class Layout:
    """Files that can be read together: one flow and one header line.

    ``charset`` is that of all of them, or None where it is not known yet. In files that have
    line breaks inside quotes a row can be found only from the start of the file.
    """

    flow: str
    header: str
    paths: tuple[str, ...]
    charset: str | None = None
    quoted_breaks: bool = False

    @property
    def columns(self) -> list[str]:
        return [normalize_header(cell.strip().strip('"')) for cell in self.header.split(";")]


def read_raw(spark: SparkSession, layout: Layout, seen: Observation | None = None) -> DataFrame:
    """The columns that facts need as text, with the file each row came from. No inference pass.

    Without a charset every row is read by what its own bytes are. ``seen`` then observes, for
    each file, which kinds of rows it has, and whether rows look cut by a quoted line break:
    ``observed_kinds`` tells which files have to be read again.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*layout.columns, _BROKEN]])
    rows = (
        spark.read.schema(schema)
        .option("sep", ";")
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("encoding", "ISO-8859-1")
        .option("columnNameOfCorruptRecord", _BROKEN)
        .option("multiLine", layout.quoted_breaks)
        .csv(list(layout.paths))
        .withColumn("SOURCE_FILE", F.col("_metadata.file_path"))
    )
    kind = _kind(F.concat_ws(";", *layout.columns))
    if layout.charset is not None:
        kind = F.lit(max(k for k, c in CHARSETS.items() if c == layout.charset))
    rows = rows.withColumn("_kind", kind)
    if seen is not None:
        # At most five entries a file.
        cut = F.contains(_BROKEN, F.lit('"'))
        entry = F.struct(F.col("SOURCE_FILE").alias("file"), F.when(cut, -1).otherwise(F.col("_kind")).alias("kind"))
        rows = rows.observe(seen, F.collect_set(F.when(cut | (F.col("_kind") > PLAIN), entry)).alias("kinds"))

    texts = [c for c in layout.columns if c in REQUIRED[layout.flow] and c not in NUMERIC]
    # Numbers need no decoding, and nor do cells of ASCII, which those of facts nearly always are,
    # whatever else the row holds. One array for all cells, as the steps for the few other rows
    # would make the compiled code of each cell too large.
    cells = F.array(*texts)
    utf8 = F.transform(cells, lambda c: F.decode(F.encode(c, "ISO-8859-1"), "UTF-8"))
    # Windows-1252 is Latin-1 but for these characters.
    windows = F.transform(cells, lambda c: F.translate(c, _CONTROLS, _LETTERS))
    read = (
        F.when(~_beyond_ascii(F.concat_ws("", *texts)), cells)
        .when(F.col("_kind") == IS_UTF8, utf8)
        .when(F.col("_kind") == IS_WINDOWS, windows)
        .otherwise(cells)
    )
    rows = rows.withColumn("_cells", read)
    decoded = [F.col("_cells")[k].alias(c) for k, c in enumerate(texts)]
    return rows.select(*[F.col(c) for c in layout.columns if c in NUMERIC], *decoded, "SOURCE_FILE")


def observed_kinds(seen: Observation) -> dict[str, tuple[str, bool, bool]]:
    """By file: its charset, whether it has quoted line breaks, and whether its rows were read as
    different charsets. Files of ASCII rows are left out.
    """
    kinds: dict[str, set[int]] = {}
    for row in seen.get["kinds"]:
        kinds.setdefault(row["file"], set()).add(row["kind"])
    return {
        file: (CHARSETS[max(PLAIN, *found)], -1 in found, len(found - {-1}) > 1) for file, found in kinds.items()
    }


def clean_facts(raw: DataFrame, flow: str) -> DataFrame:
    """Typed facts of one flow; rows without a year, a valid month or a product drop.

    Exports carry no freight and insurance.
    """
    given = [m for m in MEASURES if m in REQUIRED[flow]]
    plain = plain_numbers(*map(F.col, given))

    def measure(name: str) -> Column:
        return parse_measure(F.col(name), plain) if name in given else as_constant(None, "double")

    cleaned = {
        "FLUXO": as_constant(flow),
        "CO_ANO": parse_integer(F.col("CO_ANO")),
        "CO_MES": parse_integer(F.col("CO_MES")),
        "SG_UF_NCM": state_code(F.col("SG_UF_NCM")),
        "SOURCE_FILE": F.col("SOURCE_FILE"),
    }
    for name in ("CO_NCM", "CO_UNID", "CO_PAIS", "CO_VIA", "CO_URF"):
        cleaned[name] = pad_code(F.col(name), CODE_WIDTHS[name])
    for name in ("QT_ESTAT", "KG_LIQUIDO", "VL_FOB", "VL_FRETE", "VL_SEGURO"):
        cleaned[name] = measure(name)
    usable = raw.where(is_valid_fact())
    return usable.select(*[cleaned[f.name].alias(f.name) for f in FACT_SCHEMA])


def is_valid_fact() -> Column:
    """The rule a raw row must meet to become a fact."""
    return (
        parse_integer(F.col("CO_ANO")).isNotNull()
        # A list, not a range: a range would put the parsing into the code twice.
        & parse_integer(F.col("CO_MES")).isin(list(range(1, 13)))
        & (F.trim(F.col("CO_NCM")) != "")
    )


def load_report(files: DataFrame, facts: DataFrame, key: str = "SOURCE_FILE") -> DataFrame:
    """Valid rows and year range per file, files without any valid row included.

    ``files`` and ``facts`` are matched by ``key``; facts must carry ``CO_ANO``.
    ``problem`` is NULL for a sound file.
    """
    found = facts.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows_loaded"),
        F.min("CO_ANO").alias("first_year"),
        F.max("CO_ANO").alias("last_year"),
    )
    # The number of files bounds both sides of this join.
    report = files.join(found, key, "left").withColumn(
        "rows_loaded", F.coalesce("rows_loaded", F.lit(0))
    )
    year = F.col("file_year")
    problem = F.when(F.col("rows_loaded") == 0, F.lit("sem linhas válidas")).when(
        (F.col("first_year") != year) | (F.col("last_year") != year),
        F.format_string("ano do nome %s difere dos anos internos %s a %s", year, "first_year", "last_year"),
    )
    return report.withColumn("problem", problem)
