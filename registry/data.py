"""The views as Spark tables.

Queries run on tables that a load has stored, not on the raw inputs: the facts
are written once per session, partitioned by flow and year, and every query reads
the partitions it needs. They go to the folder that ``spark.checkpoint.dir``
names.
"""

from __future__ import annotations

from contextlib import nullcontext
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cargolens.model import TradeTables
from cargolens.operators.exemptions import consolidate_exemptions
from cargolens.plans.sizes import small_tasks
from cargolens.sources.keyed import KeyedTable, read_keyed
from cargolens.sources.references import write_exemptions
from cargolens.sources.storage import shared_folder
from registry.views import GIVEN, USES, VIEWS

PARTITIONED = {"fact": ("FLUXO", "CO_ANO")}


def _in_spark(sql: str) -> str:
    """Two spellings differ between the engines."""
    sql = sql.replace("sha256(SOURCE_FILE)", "sha2(SOURCE_FILE, 256)")
    return sql.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")


@dataclass
class Data:
    """Lazily stored views over one folder of given tables."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        self._stored: dict[str, DataFrame] = {}
        self._derived: dict[str, DataFrame] = {}

    @cached_property
    def folder(self) -> str:
        return shared_folder(self.spark, "tables")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        """A view straight from the given tables, not stored."""
        if name not in self._derived:
            for table in GIVEN:
                if table not in self._derived:
                    self._derived[table] = self.given(table)
                self._derived[table].createOrReplaceTempView(table)
            for used in USES[name]:
                # The facts cost a join of the largest tables; what builds on them reads the copy.
                source = self.stored(used) if used in PARTITIONED else self.derived(used)
                source.createOrReplaceTempView(used)
            self._derived[name] = self.spark.sql(_in_spark(VIEWS[name]))
        return self._derived[name]

    def stored(self, name: str) -> DataFrame:
        """A view written once and read back."""
        if name not in self._stored:
            path, keys = f"{self.folder}/{name}", PARTITIONED.get(name, ())
            frame = self.derived(name)
            if keys:
                # Rebalancing brings each folder's rows together and still splits a
                # folder that holds much of the data over many tasks.
                frame = frame.hint("rebalance", *keys).sortWithinPartitions(*keys, "CO_MES", "CO_NCM")
            with small_tasks(self.spark) if keys else nullcontext():
                frame.write.partitionBy(*keys).parquet(path)
            schema = frame.schema
            self._stored[name] = self.spark.read.schema(schema).parquet(path).select(*schema.names)
        return self._stored[name]

    @cached_property
    def tables(self) -> TradeTables:
        return TradeTables(
            fact=self.stored("fact"),
            ncm=self.stored("dim_ncm"),
            country=self.stored("dim_country"),
            unit=self.stored("dim_unit"),
            calendar=self.stored("dim_calendar_month"),
            loads=self.stored("loads"),
        )

    @cached_property
    def listed(self) -> KeyedTable:
        """The consolidated exemption list, stored with its key declared."""
        lines = self.derived("htsus_lines")
        found = consolidate_exemptions(lines, source="derived", annex="Anexo II", effective_date="2026-07-22")
        write_exemptions(found, f"{self.folder}/exemptions")
        return read_keyed(self.spark, f"{self.folder}/exemptions")

    @property
    def exemptions(self) -> DataFrame:
        return self.listed.frame


_open: dict[tuple[str, str], Data] = {}


def data(spark: SparkSession, sf_dir: str) -> Data:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Data(spark, sf_dir.rstrip("/"))
    return _open[key]
