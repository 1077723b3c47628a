"""A raw folder written from the facts, as the official files would look.

Exports are UTF-8; imports are Windows-1252 with headers in lower case, those of 2000 Latin-1.
Numbers have a decimal comma. An extra column carries accented text, in the exports of 1998 with
line breaks and separators inside quotes.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.model import EXPORT, EXPORT_COLUMNS, IMPORT, IMPORT_COLUMNS
from cargolens.sources import storage

CHARSETS = {EXPORT: "UTF-8", IMPORT: "ISO-8859-1"}
# Files with quoted line breaks are read whole by one task each.
ROWS_PER_FILE = 250_000


def write_raw_folder(spark: SparkSession, fact: DataFrame, folder: str) -> str:
    """Facts lie in folders by flow and year, so each year is written as it is read, unsorted.

    One year's job seldom fills the cluster, so all run at the same time.
    """
    years = [r for r in fact.select("FLUXO", "CO_ANO").distinct().collect() if r.FLUXO in CHARSETS and r.CO_ANO is not None]
    with ThreadPoolExecutor(max(1, len(years))) as jobs:
        list(jobs.map(lambda r: _write_year(spark, fact, folder, r.FLUXO, r.CO_ANO), years))
    return f"{folder}/raw"


def _write_year(spark: SparkSession, fact: DataFrame, folder: str, flow: str, year: int) -> None:
    columns = EXPORT_COLUMNS if flow == EXPORT else IMPORT_COLUMNS
    names = [*[c.lower() if flow == IMPORT else c for c in columns], "OBS"]
    texts = fact.where((F.col("FLUXO") == flow) & (F.col("CO_ANO") == year)).select(
        *[F.translate(F.col(c).cast("string"), ".", ",") for c in columns],
        F.when((F.lit(flow) == EXPORT) & (F.col("CO_ANO") == 1998) & (F.col("CO_MES") > 6), 'Operação\nem "duas"; linhas')
        .when((F.lit(flow) == IMPORT) & (F.col("CO_ANO") == 2000), "Operação \x81")
        .otherwise("Operação"),
    )
    parts = f"{folder}/parts/{flow.lower()}/{year}"
    (
        texts.toDF(*names)
        .write.option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("sep", ";")
        .option("header", True)
        .option("escape", '"')
        .option("encoding", CHARSETS[flow])
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(parts)
    )
    # Spark names the files of a folder itself; the official names carry flow and year. Its first
    # part may be a header alone.
    header = len(";".join(names)) + 1
    filled = sorted(name for name, size in storage.list_sizes(spark, parts) if name.endswith(".csv") and size > header)
    for number, name in enumerate(filled):
        storage.move(spark, f"{parts}/{name}", f"{folder}/raw/{flow.lower()}/{flow}_{year}_{number}.csv")
