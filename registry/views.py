"""The given tables seen as customs data.

Each view is one SQL text that Spark and the checking engine both run. Money and
weights are DECIMAL so that sums are exact. Gaps are deliberate: some parts have
no product row, one nation no country row, one unit no description, some heading
labels are NULL, some states are blank, one month has no calendar row.
"""

from __future__ import annotations

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

VIEWS: dict[str, str] = {}

VIEWS["fact"] = """
SELECT CASE WHEN l.l_linestatus = 'F' THEN 'EXP' ELSE 'IMP' END AS FLUXO,
       CAST(year(l.l_shipdate) AS INT) AS CO_ANO,
       CAST(month(l.l_shipdate) AS INT) AS CO_MES,
       lpad(CAST(l.l_partkey AS STRING), 8, '0') AS CO_NCM,
       lpad(CAST(l.l_linenumber AS STRING), 2, '0') AS CO_UNID,
       lpad(CAST(b.c_nationkey AS STRING), 3, '0') AS CO_PAIS,
       CASE WHEN l.l_suppkey % 13 = 0 THEN ' '
            ELSE substr('SPMGRJGORSPRSCBA', CAST(1 + 2 * (l.l_suppkey % 8) AS INT), 2)
       END AS SG_UF_NCM,
       '01' AS CO_VIA,
       lpad(CAST(l.l_suppkey AS STRING), 7, '0') AS CO_URF,
       CAST(l.l_quantity AS DECIMAL(18,2)) AS QT_ESTAT,
       CAST(CASE WHEN l.l_linenumber = 7 THEN 0 ELSE l.l_quantity * 10 END AS DECIMAL(18,2)) AS KG_LIQUIDO,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VL_FOB,
       CASE WHEN l.l_linestatus = 'F' THEN NULL ELSE CAST(l.l_quantity * 2 AS DECIMAL(18,2)) END AS VL_FRETE,
       CASE WHEN l.l_linestatus = 'F' THEN NULL ELSE CAST(l.l_quantity AS DECIMAL(18,2)) END AS VL_SEGURO,
       concat(CASE WHEN l.l_linestatus = 'F' THEN 'EXP_' ELSE 'IMP_' END,
              CAST(year(l.l_shipdate) AS STRING), '.csv') AS SOURCE_FILE
FROM lineitem l
JOIN (SELECT o.o_orderkey, c.c_nationkey
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) b
  ON l.l_orderkey = b.o_orderkey
"""

VIEWS["dim_ncm"] = """
SELECT CO_NCM, CO_ISIC_SECAO, NO_ISIC_SECAO, SETOR, CATEGORIA_USO,
       CO_SH2,
       CASE WHEN SZ % 7 = 0 THEN NULL ELSE concat('Capítulo ', CO_SH2) END AS NO_SH2_POR,
       concat(CO_SH2, C4) AS CO_SH4,
       concat('Posição ', CO_SH2, C4) AS NO_SH4_POR,
       concat(CO_SH2, C4, C6) AS CO_SH6,
       concat('Subposição ', CO_SH2, C4, C6) AS NO_SH6_POR,
       NO_NCM_POR
FROM (
  SELECT lpad(CAST(p_partkey AS STRING), 8, '0') AS CO_NCM,
         CASE p_type WHEN 'ECONOMY' THEN 'A' WHEN 'MEDIUM' THEN 'B' WHEN 'PROMO' THEN 'D' ELSE 'C' END AS CO_ISIC_SECAO,
         CASE p_type WHEN 'ECONOMY' THEN 'Agricultura' WHEN 'MEDIUM' THEN 'Indústrias extrativas'
                     WHEN 'PROMO' THEN 'Outros' ELSE 'Transformação' END AS NO_ISIC_SECAO,
         CASE p_type WHEN 'ECONOMY' THEN 'Agropecuária' WHEN 'MEDIUM' THEN 'Indústria Extrativa'
                     WHEN 'PROMO' THEN 'Outros Produtos' ELSE 'Indústria de Transformação' END AS SETOR,
         CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'Bens de Capital' WHEN 1 THEN 'Bens Intermediários'
                     WHEN 2 THEN 'Bens de Consumo' ELSE 'Combustíveis e Lubrificantes' END AS CATEGORIA_USO,
         lpad(CAST(p_size AS STRING), 2, '0') AS CO_SH2,
         lpad(CAST(p_partkey % 5 AS STRING), 2, '0') AS C4,
         lpad(CAST(p_partkey % 2 AS STRING), 2, '0') AS C6,
         p_size AS SZ,
         CASE WHEN p_partkey % 6 = 0 THEN concat(p_name, ', ', p_name, ', ', p_name, ', ', p_name, ', ', p_name) ELSE p_name END
           AS NO_NCM_POR
  FROM part
  WHERE p_partkey % 50 <> 49
) t
"""

VIEWS["dim_country"] = """
SELECT lpad(CAST(n_nationkey AS STRING), 3, '0') AS CO_PAIS,
       n_name AS PAIS,
       CASE WHEN n_nationkey = 3 THEN 'USA'
            ELSE concat('N', lpad(CAST(n_nationkey AS STRING), 2, '0')) END AS CO_PAIS_ISOA3
FROM nation
WHERE n_nationkey <> 24
"""

VIEWS["dim_unit"] = """
SELECT DISTINCT lpad(CAST(l_linenumber AS STRING), 2, '0') AS CO_UNID,
       concat('Unidade ', CAST(l_linenumber AS STRING)) AS UNIDADE
FROM lineitem
WHERE l_linenumber < 7
"""

VIEWS["calendar_days"] = """
SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS CO_ANO, CAST(month(l_shipdate) AS INT) AS CO_MES,
       CAST(day(l_shipdate) AS INT) AS CO_DIA,
       CASE WHEN CAST(extract(DOY FROM l_shipdate) AS INT) % 7 IN (0, 1) THEN 0 ELSE 1 END AS DIA_UTIL
FROM lineitem
"""

VIEWS["dim_calendar_month"] = """
SELECT CO_ANO AS ANO, CO_MES AS MES, CAST(sum(DIA_UTIL) AS INT) AS DIAS_UTEIS
FROM calendar_days
WHERE NOT (CO_ANO = 1996 AND CO_MES = 2)
GROUP BY CO_ANO, CO_MES
"""

# Products of chapters over 30 are listed under chapters 80 to 99 instead, so they have no entry
# of their own; chapters 98 and 99 stand for no goods.
VIEWS["htsus_lines"] = """
SELECT CAST(42 + p_partkey % 97 AS INT) AS PAGINA_PDF,
       concat(CO_SH6, lpad(CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 4 END, '0')) AS HTSUS,
       concat(CO_SH6, lpad(CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 4 END, '0')) AS HTSUS_DIGITOS,
       CO_SH6,
       p_name AS DESCRICAO_EN,
       CASE WHEN p_size % 3 = 0 THEN ''
            WHEN p_size % 3 = 1 THEN CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'Ex' WHEN 1 THEN 'Pharma'
                                          WHEN 2 THEN 'Aircraft' ELSE 'Other' END
            ELSE CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'Ex' WHEN 1 THEN 'Pharma' WHEN 2 THEN 'Aircraft | Other'
                                          ELSE '' END
       END AS LIMITACAO_ESCOPO,
       p_partkey AS LINHA
FROM (
  SELECT p_partkey, p_name, p_size,
         concat(lpad(CAST(CASE WHEN p_size <= 30 THEN p_size ELSE p_size + 49 END AS STRING), 2, '0'),
                lpad(CAST(p_partkey % 5 AS STRING), 2, '0'), lpad(CAST(p_partkey % 2 AS STRING), 2, '0')) AS CO_SH6
  FROM part
) t
"""

VIEWS["loads"] = """
SELECT SOURCE_FILE AS source_file, FLUXO AS flow, sha256(SOURCE_FILE) AS fingerprint,
       count(*) AS rows_loaded, CAST('2026-07-22 00:00:00' AS TIMESTAMP) AS loaded_at
FROM fact
GROUP BY SOURCE_FILE, FLUXO
"""

# Customs records as the raw files spell them: blanks, decimal commas, stray text.
VIEWS["raw_records"] = """
SELECT CASE WHEN l_linestatus = 'F' THEN 'EXP' ELSE 'IMP' END AS FLUXO,
       CASE CAST(l_partkey % 11 AS INT)
            WHEN 0 THEN concat(' ', CAST(year(l_shipdate) AS STRING), ' ')
            WHEN 1 THEN concat(CAST(year(l_shipdate) AS STRING), '.0')
            WHEN 2 THEN CASE WHEN l_linenumber = 3 THEN 'x' ELSE CAST(year(l_shipdate) AS STRING) END
            WHEN 3 THEN CASE WHEN l_linenumber = 4 THEN '1e3' ELSE CAST(year(l_shipdate) AS STRING) END
            WHEN 4 THEN CASE WHEN l_linenumber = 5 THEN '99999999999' ELSE CAST(year(l_shipdate) AS STRING) END
            ELSE CAST(year(l_shipdate) AS STRING) END AS CO_ANO,
       CASE CAST(l_suppkey % 9 AS INT)
            WHEN 0 THEN '13' WHEN 1 THEN concat('0', CAST(month(l_shipdate) AS STRING))
            WHEN 2 THEN concat(CAST(month(l_shipdate) AS STRING), '.4')
            ELSE CAST(month(l_shipdate) AS STRING) END AS CO_MES,
       CASE CAST(l_partkey % 13 AS INT) WHEN 0 THEN '  ' WHEN 1 THEN concat('1234', lpad(CAST(l_partkey AS STRING), 8, '0'))
            ELSE CAST(l_partkey AS STRING) END AS CO_NCM,
       CAST(l_linenumber AS STRING) AS CO_UNID,
       concat(' ', CAST(l_suppkey % 25 AS STRING)) AS CO_PAIS,
       CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN ' ' WHEN 1 THEN 'sp' WHEN 2 THEN ' Mg ' ELSE 'RJ' END AS SG_UF_NCM,
       '1' AS CO_VIA,
       CAST(l_suppkey AS STRING) AS CO_URF,
       CASE CAST(l_orderkey % 7 AS INT) WHEN 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ',5')
            WHEN 1 THEN concat(' ', CAST(CAST(l_quantity AS INT) AS STRING)) WHEN 2 THEN '1.234,5'
            WHEN 3 THEN '1d' WHEN 4 THEN '' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS QT_ESTAT,
       CASE CAST(l_orderkey % 5 AS INT) WHEN 0 THEN 'NaN' WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), 'e1')
            WHEN 2 THEN concat('-', CAST(CAST(l_quantity AS INT) AS STRING)) WHEN 3 THEN '.25'
            ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), '.') END AS KG_LIQUIDO,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS VL_FOB,
       CAST(CAST(l_quantity * 2 AS DECIMAL(18,2)) AS STRING) AS VL_FRETE,
       CAST(CAST(l_quantity AS DECIMAL(18,2)) AS STRING) AS VL_SEGURO,
       concat(CASE WHEN l_linestatus = 'F' THEN 'EXP_' ELSE 'IMP_' END,
              CAST(year(l_shipdate) AS STRING), '.csv') AS SOURCE_FILE
FROM lineitem
"""

# The auxiliary tables as workbooks deliver them: codes that look like numbers, gaps.
VIEWS["raw_isic"] = """
SELECT concat(CAST(p_partkey AS STRING), '.0') AS CO_NCM, p_name AS NO_NCM_POR,
       CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'A' WHEN 1 THEN ' b' WHEN 2 THEN 'C' WHEN 3 THEN 'Z'
            WHEN 4 THEN NULL WHEN 5 THEN 'G' ELSE 'D' END AS CO_ISIC_SECAO,
       CASE CAST(p_size % 6 AS INT) WHEN 0 THEN 'AGRICULTURA, pecuária' WHEN 1 THEN 'Pesca e  Aqüicultura'
            WHEN 2 THEN 'Indústrias EXTRATIVAS' WHEN 3 THEN 'Indústrias de TRANSFORMAÇÃO' WHEN 4 THEN NULL
            ELSE 'Serviços' END AS NO_ISIC_SECAO
FROM part WHERE p_partkey % 10 <> 0
"""

VIEWS["raw_cgce"] = """
SELECT CAST(p_partkey AS STRING) AS CO_NCM,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_partkey % 8 AS STRING) END AS CO_CGCE_N1,
       CASE CAST(p_size % 7 AS INT) WHEN 0 THEN 'BENS DE CAPITAL' WHEN 1 THEN 'Bens Intermediários'
            WHEN 2 THEN 'bens de consumo' WHEN 3 THEN 'COMBUSTÍVEIS' WHEN 4 THEN 'Lubrificantes'
            WHEN 5 THEN ' Outros bens ' ELSE NULL END AS NO_CGCE_N1
FROM part WHERE p_partkey % 10 <> 1
"""

VIEWS["raw_sh"] = """
SELECT lpad(CAST(p_partkey AS STRING), 8, '0') AS CO_NCM,
       concat(CAST(10000 + p_size * 100 + p_partkey % 5 AS STRING), '.00') AS CO_SH6,
       concat('Subposição ', CAST(p_size AS STRING)) AS NO_SH6_POR,
       CAST(100 + p_size AS STRING) AS CO_SH4, CAST(p_size AS STRING) AS CO_SH2,
       CASE WHEN p_size % 2 = 0 THEN concat('Capítulo próprio ', CAST(p_size AS STRING)) END AS NO_SH2_POR
FROM part WHERE p_partkey % 10 <> 2
"""

VIEWS["raw_sh2"] = """
SELECT DISTINCT CAST(p_size AS STRING) AS CO_SH2, concat('Capítulo ', CAST(p_size AS STRING)) AS NO_SH2_POR
FROM part WHERE p_size % 3 <> 0
"""

VIEWS["raw_sh4"] = """
SELECT DISTINCT concat(CAST(100 + p_size AS STRING), '.0') AS CO_SH4,
       concat('Posição ', CAST(p_size AS STRING)) AS NO_SH4_POR
FROM part WHERE p_size % 5 <> 0
"""

VIEWS["raw_country"] = """
SELECT CAST(n_nationkey AS STRING) AS CO_PAIS,
       CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_name END AS NO_PAIS,
       CASE WHEN n_nationkey = 3 THEN 'USA' ELSE concat('N', lpad(CAST(n_nationkey AS STRING), 2, '0')) END AS CO_PAIS_ISOA3
FROM nation
"""

VIEWS["raw_unit"] = """
SELECT DISTINCT concat(CAST(l_linenumber AS STRING), '.0') AS CO_UNID,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE concat('Unidade ', CAST(l_linenumber AS STRING)) END AS NO_UNID
FROM lineitem
"""

# One row per shipment, so that each calendar day is repeated many times.
VIEWS["raw_days"] = """
SELECT CAST(year(l_shipdate) AS STRING) AS CO_ANO,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE concat(CAST(month(l_shipdate) AS STRING), '.0') END AS CO_MES,
       CAST(day(l_shipdate) AS STRING) AS CO_DIA,
       CASE CAST(extract(DOY FROM l_shipdate) % 7 AS INT) WHEN 0 THEN 'Não' WHEN 1 THEN '0' WHEN 2 THEN 'feriado?'
            WHEN 3 THEN 'SIM' WHEN 4 THEN ' útil ' WHEN 5 THEN '1' ELSE 'Verdadeiro' END AS DIA_UTIL
FROM lineitem
"""

# Annex lines before extraction: continuation lines, dotted codes, notes without a code.
VIEWS["annex_cells"] = """
SELECT p_brand AS DOCUMENTO, p_partkey AS LINHA, CAST(42 + p_partkey % 97 AS INT) AS PAGINA_PDF,
       CASE WHEN p_partkey % 4 = 3 THEN ' ' WHEN p_partkey % 11 = 5 THEN 'Note'
            WHEN p_partkey % 9 = 2 THEN '1234.5'
            ELSE concat(lpad(CAST(p_size AS STRING), 2, '0'), '01.', lpad(CAST(p_partkey % 100 AS STRING), 2, '0'),
                        '.', lpad(CAST(p_size AS STRING), 2, '0'),
                        CASE WHEN p_partkey % 5 = 0 THEN '.10' ELSE '' END) END AS HTSUS,
       concat('  ', p_name, '  (', p_type, ')') AS DESCRICAO_EN,
       CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN ' Ex ' WHEN 1 THEN 'Pharma' WHEN 2 THEN 'Aircraft  ' ELSE '' END
         AS LIMITACAO_ESCOPO
FROM part
"""

# A tariff series per nation: months, imports and duties, with unusable and repeated rows.
VIEWS["tariff_raw"] = """
SELECT n_name AS PAIS, CAST(MES AS STRING) AS DATA,
       CAST(IMP AS STRING) AS IMPORTACOES_CONSUMO_USD, CAST(DIR AS STRING) AS DIREITOS_ADUANEIROS_USD,
       CASE WHEN n_nationkey = 4 AND MM = 6 THEN 'n/d' ELSE CAST(BAS AS STRING) END AS BASE_TRIBUTAVEL_USD,
       CAST(CAST(DIR AS DOUBLE) / CAST(IMP AS DOUBLE) * 100 AS STRING) AS TARIFA_EFETIVA_PCT,
       CAST(CAST(DIR AS DOUBLE) / CAST(BAS AS DOUBLE) * 100 AS STRING) AS TARIFA_BASE_TRIBUTAVEL_PCT
FROM (
  SELECT n_nationkey, n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS MES,
         CAST(month(min(o_orderdate)) AS INT) AS MM,
         CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) + 1 AS BIGINT) AS IMP,
         CAST(sum(CAST(floor(o_totalprice) AS BIGINT) % 9000) AS BIGINT) AS DIR,
         CAST(sum(CAST(floor(o_totalprice) AS BIGINT) % 90000) + 1 AS BIGINT) AS BAS
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_nationkey, n_name, CAST(date_trunc('month', o_orderdate) AS DATE)
) s
"""

VIEWS["star"] = """
SELECT fact.*, coalesce(product.SETOR, 'Não classificado') AS SETOR,
       coalesce(product.CATEGORIA_USO, 'Não classificado') AS CATEGORIA_USO,
       product.CO_SH2, product.NO_SH2_POR, product.CO_SH4, product.NO_SH4_POR, product.CO_SH6, product.NO_SH6_POR,
       product.NO_NCM_POR, country.CO_PAIS_ISOA3, coalesce(country.PAIS, 'País não identificado') AS PAIS,
       coalesce(unit.UNIDADE, 'Unidade não identificada') AS UNIDADE, calendar.DIAS_UTEIS
FROM fact
LEFT JOIN dim_ncm product ON product.CO_NCM = fact.CO_NCM
LEFT JOIN dim_country country ON country.CO_PAIS = fact.CO_PAIS
LEFT JOIN dim_unit unit ON unit.CO_UNID = fact.CO_UNID
LEFT JOIN dim_calendar_month calendar ON calendar.ANO = fact.CO_ANO AND calendar.MES = fact.CO_MES
"""

# What each view reads, in an order that defines a view before it is used.
USES = {
    "fact": (),
    "dim_ncm": (),
    "dim_country": (),
    "dim_unit": (),
    "calendar_days": (),
    "dim_calendar_month": ("calendar_days",),
    "htsus_lines": (),
    "loads": ("fact",),
    "raw_records": (),
    "raw_isic": (),
    "raw_cgce": (),
    "raw_sh": (),
    "raw_sh2": (),
    "raw_sh4": (),
    "raw_country": (),
    "raw_unit": (),
    "raw_days": (),
    "annex_cells": (),
    "tariff_raw": (),
    "star": ("fact", "dim_ncm", "dim_country", "dim_unit", "dim_calendar_month"),
}

# Views that only the checking side needs.
ORACLE_VIEWS = {
    "firsts_scope": (
        ("htsus_lines",),
        """SELECT CO_SH6, LIMITACAO_ESCOPO AS v, min(LINHA) AS l FROM htsus_lines
           WHERE LIMITACAO_ESCOPO <> '' GROUP BY 1, 2""",
    ),
    "firsts_code": (
        ("htsus_lines",),
        "SELECT CO_SH6, HTSUS AS v, min(LINHA) AS l FROM htsus_lines WHERE HTSUS <> '' GROUP BY 1, 2",
    ),
    "exemptions": (
        ("htsus_lines", "firsts_scope", "firsts_code"),
        """
SELECT h.CO_SH6, count(*) AS QTD_LINHAS_HTSUS,
       sum(CASE WHEN length(HTSUS_DIGITOS) = 8 THEN 1 ELSE 0 END)::BIGINT AS QTD_HTSUS_8,
       sum(CASE WHEN length(HTSUS_DIGITOS) = 10 THEN 1 ELSE 0 END)::BIGINT AS QTD_HTSUS_10,
       sum(CASE WHEN LIMITACAO_ESCOPO = '' THEN 1 ELSE 0 END)::BIGINT AS QTD_SEM_LIMITACAO,
       sum(CASE WHEN LIMITACAO_ESCOPO <> '' THEN 1 ELSE 0 END)::BIGINT AS QTD_CONDICIONADAS,
       coalesce((SELECT string_agg(v, ' | ' ORDER BY l) FROM firsts_scope s WHERE s.CO_SH6 = h.CO_SH6), '') AS LIMITACOES_ESCOPO,
       coalesce((SELECT string_agg(v, ' | ' ORDER BY l) FROM firsts_code s WHERE s.CO_SH6 = h.CO_SH6), '') AS CODIGOS_HTSUS,
       arg_min(DESCRICAO_EN, LINHA) AS DESCRICAO_HTSUS_EXEMPLO,
       min(PAGINA_PDF) AS PAGINA_INICIAL, max(PAGINA_PDF) AS PAGINA_FINAL,
       CASE WHEN sum(CASE WHEN LIMITACAO_ESCOPO = '' THEN 1 ELSE 0 END) = 0 THEN 'Condicionado'
            WHEN sum(CASE WHEN LIMITACAO_ESCOPO <> '' THEN 1 ELSE 0 END) > 0 THEN 'Misto'
            ELSE 'Sem limitação explícita' END AS TIPO_ESCOPO_SH6,
       'derived' AS FONTE, 'Anexo II' AS ANEXO, '2026-07-22' AS DATA_VIGENCIA_GERAL
FROM htsus_lines h
WHERE CAST(substr(h.CO_SH6, 1, 2) AS INT) <= 97
GROUP BY h.CO_SH6""",
    ),
}


def oracle(sql: str, *views: str, doubles: tuple[str, ...] = ()) -> str:
    """A complete statement: the views ``sql`` reads as CTEs, then ``sql``.

    ``doubles`` are rounded to six decimals, as the Spark side does.
    """
    ordered: list[str] = []
    texts = dict(VIEWS)
    uses = dict(USES)
    for name, (needs, text) in ORACLE_VIEWS.items():
        texts[name], uses[name] = text, needs

    def add(name: str) -> None:
        for used in uses[name]:
            add(used)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    prefix = ",\n".join(f"{name} AS ({texts[name].strip()})" for name in ordered)
    if doubles:
        rounded = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in doubles)
        sql = f"SELECT * REPLACE ({rounded}) FROM (\n{sql.strip()}\n) final"
    elif sql.strip().upper().startswith("WITH"):
        sql = f"SELECT * FROM (\n{sql.strip()}\n) final"
    return f"WITH {prefix}\n{sql.strip()}" if prefix else sql.strip()
