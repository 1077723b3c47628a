from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cargolens.model import FACT_SCHEMA, TradeTables  # noqa: E402
from cargolens.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            # Plans are compared as text, so nothing may be cut off.
            "spark.sql.maxMetadataStringLength": "5000",
            "spark.sql.debug.maxToStringFields": "1000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


NCM_SCHEMA = (
    "CO_NCM string, SETOR string, CATEGORIA_USO string, CO_SH2 string, NO_SH2_POR string, CO_SH4 string, "
    "NO_SH4_POR string, CO_SH6 string, NO_SH6_POR string, NO_NCM_POR string, CO_ISIC_SECAO string, "
    "NO_ISIC_SECAO string"
)
COUNTRY_SCHEMA = "CO_PAIS string, PAIS string, CO_PAIS_ISOA3 string"
UNIT_SCHEMA = "CO_UNID string, UNIDADE string"
CALENDAR_SCHEMA = "ANO int, MES int, DIAS_UTEIS int"
LOADS_SCHEMA = (
    "source_file string, flow string, fingerprint string, rows_loaded bigint, loaded_at timestamp_ntz"
)
EXEMPTION_SCHEMA = (
    "CO_SH6 string, QTD_LINHAS_HTSUS bigint, QTD_HTSUS_8 bigint, QTD_HTSUS_10 bigint, QTD_SEM_LIMITACAO bigint, "
    "QTD_CONDICIONADAS bigint, LIMITACOES_ESCOPO string, CODIGOS_HTSUS string, DESCRICAO_HTSUS_EXEMPLO string, "
    "TIPO_ESCOPO_SH6 string"
)

PRODUCTS = [
    ("01010100", "Agropecuária", "Bens Intermediários", "01", "Animais vivos", "0101", "Animais", "010101",
     "Animais reprodutores", "Animal reprodutor", "A", "Agricultura"),
    ("02011000", "Indústria de Transformação", "Bens de Consumo", "02", "Carnes", "0201", "Carnes bovinas",
     "020110", "Carne bovina", "Carne bovina fresca", "C", "Indústrias de transformação"),
]
COUNTRIES = [("249", "Estados Unidos", "USA"), ("160", "China", "CHN"), ("063", "Argentina", "ARG")]


def fact(flow, year, month, ncm, country, uf, qt, kg, fob, unit="10"):
    freight = None if flow == "EXP" else fob
    return (flow, year, month, ncm, unit, country, uf, "01", "0000001",
            None if qt is None else float(qt), None if kg is None else float(kg),
            None if fob is None else float(fob),
            None if freight is None else float(freight) / 10, None, f"{flow}_{year}.csv")


SMALL_FACTS = [
    fact("EXP", 2026, 1, "01010100", "249", "SP", 2, 20, 100),
    fact("EXP", 2026, 1, "01010100", "249", "MG", 3, 30, 150),
    fact("EXP", 2026, 1, "01010100", "160", "SP", 4, 40, 200),
    fact("EXP", 2026, 1, "02011000", "249", "GO", 5, 50, 300),
]


def make_tables(spark, facts, products=PRODUCTS, countries=COUNTRIES, calendar=((2026, 1, 21),)):
    return TradeTables(
        fact=spark.createDataFrame(facts, FACT_SCHEMA),
        ncm=spark.createDataFrame(products, NCM_SCHEMA),
        country=spark.createDataFrame(countries, COUNTRY_SCHEMA),
        unit=spark.createDataFrame([("10", "Quilograma")], UNIT_SCHEMA),
        calendar=spark.createDataFrame(list(calendar), CALENDAR_SCHEMA),
        loads=spark.createDataFrame(
            [("EXP_2026.csv", "EXP", "abc", 4, datetime(2026, 7, 22))], LOADS_SCHEMA
        ),
    )


@pytest.fixture(scope="session")
def small(spark):
    return make_tables(spark, SMALL_FACTS)


@pytest.fixture(scope="session")
def exemptions(spark):
    """020110 exempt, 280410 conditioned, 300490 mixed; 010101 and 030101 not listed."""
    return spark.createDataFrame(
        [
            ("020110", 2, 2, 0, 2, 0, "", "02011005 | 02011010", "Beef", "Sem limitação explícita"),
            ("280410", 1, 1, 0, 0, 1, "Ex", "28041000", "Hydrogen", "Condicionado"),
            ("300490", 2, 1, 1, 1, 1, "Pharma | Other", "30049010 | 3004909290", "Medicine", "Misto"),
        ],
        EXEMPTION_SCHEMA,
    )


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def by(frame, *keys):
    """Rows by key."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows(frame)}
