"""Sources and sinks: raw files into the lake, the rollup, references, exports.

These queries first write files from the given tables, then read them the way the
library reads the official ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.model import FilterState, TradeTables
from cargolens.operators.quality import quality_report
from cargolens.operators.tariff import tariff_series
from cargolens.operators.trade import hierarchy_table, summary_metrics
from cargolens.plans.star import facts_by
from cargolens.sources import storage
from cargolens.sources.export import write_csv
from cargolens.sources.generations import current
from cargolens.sources.lake import DIMENSIONS, load, open_tables, plan_load, read_facts, read_loads, source_report
from cargolens.sources.raw import (
    clean_facts,
    discover_fact_files,
    inspect_files,
    load_report,
    missing_columns,
    with_headers,
)
from cargolens.sources.references import read_exemptions, read_tariff_series
from cargolens.sources.rollup import (
    build_rollup,
    monthly_rollup,
    read_rollup_facts,
    refresh_rollup,
    rollup_mismatches,
    rollup_reduction,
)
from cargolens.sources.storage import shared_folder
from registry.core import register
from registry.data import Data
from registry.rawfiles import write_raw_folder
from registry.star import CLEANED_SQL
from registry.trade import (
    _BREAKDOWN,
    _BREAKDOWN_DOUBLES,
    _SUMMARY,
    _SUMMARY_DOUBLES,
    EXPORTS_1998,
    QUALITY,
)

_DOUBLES = ("QT_ESTAT", "KG_LIQUIDO", "VL_FOB", "VL_FRETE", "VL_SEGURO")


@dataclass
class Files:
    """A raw folder and the lake and rollup built from it, once per set of tables."""

    data: Data

    @cached_property
    def raw(self) -> str:
        spark = self.data.spark
        return write_raw_folder(spark, self.data.tables.fact, shared_folder(spark, "raw"))

    @cached_property
    def lake(self) -> str:
        root = f"{shared_folder(self.data.spark, 'lake')}"
        t = self.data.tables
        dims = {"ncm": t.ncm, "country": t.country, "unit": t.unit, "calendar": t.calendar}
        load(self.data.spark, self.raw, root, dims)
        return root

    @cached_property
    def rollup(self) -> str:
        output = f"{self.lake}-rollup"
        build_rollup(self.data.spark, self.lake, output)
        return output

    @cached_property
    def changed(self) -> tuple[str, str]:
        """A lake loaded twice, and its rollup, built after the first load and refreshed after the second.

        In between the exports of 1997 were replaced, the imports of 1999 vanished, and product
        names were written in capitals.
        """
        spark, t = self.data.spark, self.data.tables
        raw = write_raw_folder(spark, t.fact, shared_folder(spark, "raw-before"))
        root, output = shared_folder(spark, "lake-changed"), shared_folder(spark, "rollup-changed")
        dims = {"ncm": t.ncm, "country": t.country, "unit": t.unit, "calendar": t.calendar}
        load(spark, raw, root, dims)
        build_rollup(spark, root, output)
        for pattern in ("exp/EXP_1997_*.csv", "imp/IMP_1999_*.csv"):
            for path in storage.list_paths(spark, f"{raw}/{pattern}"):
                storage.remove(spark, path)
        new = t.fact.where("FLUXO = 'EXP' AND CO_ANO = 1997").withColumn("VL_FOB", F.col("VL_FOB") * 2)
        after = write_raw_folder(spark, new, shared_folder(spark, "raw-after"))
        for path in storage.list_paths(spark, f"{after}/exp/*.csv"):
            storage.move(spark, path, f"{raw}/exp/{path.rsplit('/', 1)[1]}")
        load(spark, raw, root, dims | {"ncm": t.ncm.withColumn("NO_NCM_POR", F.upper("NO_NCM_POR"))})
        refresh_rollup(spark, root, output)
        return root, output

    @cached_property
    def rebuilt(self) -> str:
        """A lake without dimensions, loaded and then rebuilt from the same files."""
        root = shared_folder(self.data.spark, "lake-rebuilt")
        load(self.data.spark, self.raw, root)
        load(self.data.spark, self.raw, root, rebuild=True)
        return root

    @cached_property
    def sums(self) -> TradeTables:
        """The rollup alone, without the facts behind it."""
        return open_tables(self.data.spark, None, rollup=self.rollup)

    @cached_property
    def found(self) -> DataFrame:
        return discover_fact_files(self.data.spark, self.raw)

    def inspected(self) -> DataFrame:
        paths = [row.path for row in self.found.select("path").collect()]
        files = self.found.join(inspect_files(self.data.spark, paths), "source_file")
        return with_headers(self.data.spark, files)


_files: dict[int, Files] = {}


def files(d: Data) -> Files:
    return _files.setdefault(id(d), Files(d))


register(
    "s1_discovered_files",
    lambda d: files(d).found.select("flow", "file_year").distinct(),
    "SELECT DISTINCT FLUXO AS flow, CO_ANO AS file_year FROM fact",
    ("fact",),
)
register(
    "s3_charsets",
    lambda d: files(d).inspected().select("flow", "file_year", "charset").distinct(),
    """SELECT DISTINCT FLUXO AS flow, CO_ANO AS file_year, CASE WHEN FLUXO = 'EXP' THEN 'utf-8'
  WHEN CO_ANO = 2000 THEN 'latin-1' ELSE 'windows-1252' END AS charset FROM fact""",
    ("fact",),
)
register(
    "s4_missing_columns",
    # Export files judged by the rules for imports.
    lambda d: missing_columns(files(d).inspected().withColumn("flow", F.lit("IMP")))
    .select("file_year", F.array_join("missing", ", ").alias("FALTAM"))
    .distinct(),
    "SELECT DISTINCT CO_ANO AS file_year, 'VL_FRETE, VL_SEGURO' AS FALTAM FROM fact WHERE FLUXO = 'EXP'",
    ("fact",),
)
register(
    "s5_s14_loaded_facts",
    lambda d: read_facts(d.spark, files(d).lake).drop("SOURCE_FILE"),
    "SELECT * EXCLUDE (SOURCE_FILE) REPLACE (upper(trim(SG_UF_NCM)) AS SG_UF_NCM) FROM fact",
    ("fact",),
    _DOUBLES,
)
register(
    "s9_load_manifest",
    lambda d: read_loads(d.spark, files(d).lake)
    .groupBy("flow", "file_year")
    .agg(F.sum("rows_loaded").alias("rows_loaded")),
    "SELECT FLUXO AS flow, CO_ANO AS file_year, count(*) AS rows_loaded FROM fact GROUP BY FLUXO, CO_ANO",
    ("fact",),
)


def _altered_loads(d: Data) -> DataFrame:
    """The manifest as if 1997 had changed and a vanished file had been loaded before."""
    loads = read_loads(d.spark, files(d).lake)
    changed = loads.withColumn(
        "fingerprint", F.when(F.col("file_year") == 1997, F.lit("old")).otherwise(F.col("fingerprint"))
    )
    vanished = loads.withColumn("source_file", F.concat("source_file", F.lit(".gone")))
    return changed.unionByName(vanished.where("file_year = 1999"))


register(
    "s9_changed_files",
    lambda d: plan_load(files(d).found, _altered_loads(d))[0].select("flow", "file_year").distinct(),
    "SELECT DISTINCT FLUXO AS flow, CO_ANO AS file_year FROM fact WHERE CO_ANO = 1997",
    ("fact",),
)
register(
    "s10_vanished_files",
    lambda d: plan_load(files(d).found, _altered_loads(d))[1]
    .groupBy("flow", "file_year")
    .agg(F.sum("rows_loaded").alias("rows_loaded")),
    """SELECT FLUXO AS flow, CO_ANO AS file_year, count(*) AS rows_loaded FROM fact
WHERE CO_ANO = 1999 GROUP BY FLUXO, CO_ANO""",
    ("fact",),
)


def _report(d: Data) -> DataFrame:
    raw = d.stored("raw_records")
    facts = clean_facts(raw.where("FLUXO = 'EXP'"), "EXP").unionByName(clean_facts(raw.where("FLUXO = 'IMP'"), "IMP"))
    named = raw.select(F.col("SOURCE_FILE").alias("source_file")).distinct()
    # A second name per file, under which no row was found.
    listed = named.unionByName(named.select(F.concat(F.lit("empty_"), "source_file").alias("source_file")))
    year = F.regexp_extract("source_file", r"_(\d{4})", 1).cast("int")
    files = listed.withColumn("file_year", year).withColumnRenamed("source_file", "SOURCE_FILE")
    return load_report(files, facts)


register(
    "q48_load_report",
    _report,
    f"""WITH limpos AS ({CLEANED_SQL}), arquivos AS (
  SELECT DISTINCT SOURCE_FILE FROM raw_records
  UNION ALL SELECT DISTINCT 'empty_' || SOURCE_FILE FROM raw_records),
contados AS (
  SELECT a.SOURCE_FILE, CAST(regexp_extract(a.SOURCE_FILE, '_(\\d{{4}})', 1) AS INT) AS file_year,
         count(l.CO_ANO) AS rows_loaded, min(l.CO_ANO) AS first_year, max(l.CO_ANO) AS last_year
  FROM arquivos a LEFT JOIN limpos l ON l.SOURCE_FILE = a.SOURCE_FILE GROUP BY 1, 2)
SELECT *, CASE WHEN rows_loaded = 0 THEN 'sem linhas válidas'
  WHEN first_year <> file_year OR last_year <> file_year
  THEN 'ano do nome ' || file_year || ' difere dos anos internos ' || first_year || ' a ' || last_year END AS problem
FROM contados""",
    ("raw_records",),
)

# --- rollup ------------------------------------------------------------------------
_ROLLUP = """SELECT FLUXO, CO_ANO, CO_MES, CO_NCM, CO_PAIS,
  coalesce(nullif(trim(SG_UF_NCM), ''), 'Não informado') AS SG_UF_NCM,
  sum(QT_ESTAT) AS QT_ESTAT, sum(KG_LIQUIDO) AS KG_LIQUIDO, sum(VL_FOB) AS VL_FOB,
  sum(VL_FRETE) AS VL_FRETE, sum(VL_SEGURO) AS VL_SEGURO,
  CAST(NULL AS VARCHAR) AS CO_UNID, CAST(NULL AS VARCHAR) AS CO_VIA, CAST(NULL AS VARCHAR) AS CO_URF,
  'AGREGADO_MENSAL' AS SOURCE_FILE
FROM fact GROUP BY 1, 2, 3, 4, 5, 6"""
register("q43_monthly_rollup", lambda d: monthly_rollup(d.tables.fact), _ROLLUP, ("fact",), _DOUBLES)
register(
    "s15_published_rollup",
    lambda d: read_rollup_facts(d.spark, files(d).rollup),
    _ROLLUP,
    ("fact",),
    _DOUBLES,
)
register(
    "s17_copied_dimensions",
    lambda d: open_tables(d.spark, files(d).lake, rollup=files(d).rollup).ncm,
    "SELECT * FROM dim_ncm",
    ("dim_ncm",),
)
register(
    "s18_rollup_lineage",
    lambda d: current(d.spark, files(d).rollup).read(d.spark, "rollup_info").select("source_rows", "aggregation_level"),
    """SELECT count(*) AS source_rows, 'FLUXO + CO_ANO + CO_MES + CO_NCM + CO_PAIS + SG_UF_NCM' AS aggregation_level
FROM fact""",
    ("fact",),
)
register(
    "s19_query_on_rollup",
    lambda d: hierarchy_table(
        open_tables(d.spark, files(d).lake, rollup=files(d).rollup), FilterState(flow="EXP", year=1998), "Setor"
    ),
    _BREAKDOWN.format(code="SETOR", label="SETOR", where="FLUXO = 'EXP' AND CO_ANO = 1998"),
    ("star",),
    _BREAKDOWN_DOUBLES,
)
register(
    "q42_rollup_mismatches",
    # A rollup that lost the imports of one year must be caught in every measure.
    lambda d: rollup_mismatches(
        d.tables.fact, monthly_rollup(d.tables.fact).where("NOT (FLUXO = 'IMP' AND CO_ANO = 1997)")
    ),
    "WITH alvo AS (SELECT * FROM fact WHERE NOT (FLUXO = 'IMP' AND CO_ANO = 1997))\n"
    + "\nUNION ALL ".join(
        f"""SELECT 'IMP' AS FLUXO, '{m}' AS MEDIDA,
  (SELECT CAST(sum({m}) AS DOUBLE) FROM fact WHERE FLUXO = 'IMP') AS COMPLETO,
  (SELECT CAST(sum({m}) AS DOUBLE) FROM alvo WHERE FLUXO = 'IMP') AS AGREGADO"""
        for m in _DOUBLES
    ),
    ("fact",),
    ("COMPLETO", "AGREGADO"),
)
register(
    "q44_rollup_reduction",
    lambda d: rollup_reduction(d.tables.fact, monthly_rollup(d.tables.fact)),
    f"""SELECT a AS LINHAS_COMPLETO, b AS LINHAS_AGREGADO, 1 - CAST(b AS DOUBLE) / a AS REDUCAO_LINHAS
FROM (SELECT (SELECT count(*) FROM fact) AS a, (SELECT count(*) FROM ({_ROLLUP}) r) AS b) t""",
    ("fact",),
    ("REDUCAO_LINHAS",),
)

# --- replaced, removed and rebuilt sources ---------------------------------------------
_CHANGED = """SELECT * REPLACE (upper(trim(SG_UF_NCM)) AS SG_UF_NCM,
    VL_FOB * CASE WHEN FLUXO = 'EXP' AND CO_ANO = 1997 THEN 2 ELSE 1 END AS VL_FOB)
  FROM fact WHERE NOT (FLUXO = 'IMP' AND CO_ANO = 1999)"""
register(
    "s11_replaced_and_removed_sources",
    lambda d: read_facts(d.spark, files(d).changed[0]).drop("SOURCE_FILE"),
    f"SELECT * EXCLUDE (SOURCE_FILE) FROM ({_CHANGED}) t",
    ("fact",),
    _DOUBLES,
)
register(
    "s12_replaced_dimensions",
    lambda d: open_tables(d.spark, files(d).changed[0]).ncm,
    "SELECT * REPLACE (upper(NO_NCM_POR) AS NO_NCM_POR) FROM dim_ncm",
    ("dim_ncm",),
)
register(
    "s13_rebuilt_facts",
    lambda d: read_facts(d.spark, files(d).rebuilt).drop("SOURCE_FILE"),
    "SELECT * EXCLUDE (SOURCE_FILE) REPLACE (upper(trim(SG_UF_NCM)) AS SG_UF_NCM) FROM fact",
    ("fact",),
    _DOUBLES,
)
register(
    "s15_refreshed_rollup",
    lambda d: read_rollup_facts(d.spark, files(d).changed[1]),
    _ROLLUP.replace("FROM fact", f"FROM ({_CHANGED}) t"),
    ("fact",),
    _DOUBLES,
)


def _source_reports(d: Data) -> DataFrame:
    whole, bare = (source_report(d.spark, root) for root in (files(d).lake, files(d).rebuilt))
    return whole.withColumn("LAGO", F.lit("completo")).unionByName(bare.withColumn("LAGO", F.lit("sem dimensões")))


_STATE = "CASE WHEN count(*) = 0 THEN 'vazia' ELSE 'completa' END AS ESTADO"
register(
    "s16_required_tables",
    _source_reports,
    "\nUNION ALL ".join(
        f"""SELECT '{name}' AS TABELA, {_STATE}, 'completo' AS LAGO FROM {view}
UNION ALL SELECT '{name}', {"max('ausente')" if view.startswith('dim') else _STATE}, 'sem dimensões' FROM {view}"""
        for name, view in {"fact": "fact", "loads": "fact", **{v: v for v in DIMENSIONS.values()}}.items()
    ),
    ("fact", "dim_ncm", "dim_country", "dim_unit", "dim_calendar_month"),
)
register(
    "s19_summary_on_rollup",
    # The count of facts as well, from sums alone.
    lambda d: summary_metrics(files(d).sums, EXPORTS_1998),
    _SUMMARY.format(where="FLUXO = 'EXP' AND CO_ANO = 1998"),
    ("star",),
    _SUMMARY_DOUBLES,
)
register(
    "s19_quality_on_rollup",
    lambda d: quality_report(files(d).sums).where("INDICADOR <> 'Arquivos processados'"),
    f"SELECT * FROM ({QUALITY}) t WHERE INDICADOR <> 'Arquivos processados'",
    ("star", "loads"),
    ("VALOR", "PERCENTUAL"),
)
register(
    "s19_units_beside_a_rollup",
    # Not in the rollup, so read from the facts.
    lambda d: facts_by(
        open_tables(d.spark, files(d).lake, rollup=files(d).rollup), EXPORTS_1998, ["UNIDADE"], ["VL_FOB", "REGISTROS"]
    )
    .groupBy("UNIDADE")
    .agg(F.sum("VL_FOB").alias("VL_FOB"), F.sum("REGISTROS").alias("REGISTROS")),
    """SELECT UNIDADE, CAST(sum(VL_FOB) AS DOUBLE) AS VL_FOB, count(*) AS REGISTROS
FROM star WHERE FLUXO = 'EXP' AND CO_ANO = 1998 GROUP BY UNIDADE""",
    ("star",),
    ("VL_FOB",),
)

# --- reference files and exports ------------------------------------------------------


def _exemption_file(d: Data) -> DataFrame:
    path = shared_folder(d.spark, "exemptions")
    # Codes as numbers, so that leading zeros have to come back on reading.
    numeric = d.exemptions.withColumn("CO_SH6", F.col("CO_SH6").cast("int").cast("string"))
    numeric.write.option("sep", ";").option("header", True).csv(path)
    return read_exemptions(d.spark, path)


register("s7_exemption_file", _exemption_file, "SELECT * FROM exemptions", ("exemptions",))


def _tariff_file(d: Data) -> DataFrame:
    path = shared_folder(d.spark, "tariff")
    d.derived("tariff_raw").write.option("sep", ";").option("header", True).csv(path)
    return tariff_series(read_tariff_series(d.spark, path)).select("PAIS", "DATA", "TARIFA_EFETIVA_PCT")


register(
    "s8_tariff_file",
    _tariff_file,
    """SELECT PAIS, CAST(DATA AS DATE) AS DATA, CAST(TARIFA_EFETIVA_PCT AS DOUBLE) AS TARIFA_EFETIVA_PCT
FROM tariff_raw WHERE TRY_CAST(BASE_TRIBUTAVEL_USD AS DOUBLE) IS NOT NULL""",
    ("tariff_raw",),
    ("TARIFA_EFETIVA_PCT",),
)


def _export(d: Data) -> DataFrame:
    """Exported amounts, read back as plain text."""
    path = shared_folder(d.spark, "export")
    fact = d.tables.fact.select("CO_NCM", "CO_MES", "VL_FOB", F.col("VL_FRETE").cast("double"))
    write_csv(fact, path)
    schema = "CO_NCM string, CO_MES string, VL_FOB string, VL_FRETE string"
    return d.spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


def _comma(column: str) -> str:
    return (
        f"replace(regexp_replace(CAST(CAST({column} AS DECIMAL(38,6)) AS VARCHAR), '(\\.\\d+?)0+$', '\\1'), '.', ',')"
    )


register(
    "s20_csv_export",
    _export,
    f"""SELECT CO_NCM, CAST(CO_MES AS VARCHAR) AS CO_MES, {_comma('VL_FOB')} AS VL_FOB, {_comma('VL_FRETE')} AS VL_FRETE
FROM fact""",
    ("fact",),
)


def _export_heads(d: Data) -> DataFrame:
    """The first bytes of every exported part."""
    path = shared_folder(d.spark, "export")
    write_csv(d.tables.fact.select("CO_NCM", "VL_FOB"), path)
    parts = d.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return parts.select(F.hex(F.substring("content", 1, 3)).alias("MARCA"), F.decode(F.substring("content", 4, 13), "UTF-8").alias("CABECALHO")).distinct()


register(
    "s20_export_marks",
    _export_heads,
    "SELECT DISTINCT 'EFBBBF' AS MARCA, 'CO_NCM;VL_FOB' AS CABECALHO FROM fact",
    ("fact",),
)
