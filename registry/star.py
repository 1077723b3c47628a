"""The star itself, cleaning rules, and the dimensions from their raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions.cleaning import (
    CODE_WIDTHS,
    business_day,
    fold,
    macro_sector,
    normalize_code,
    normalize_columns,
    use_category,
)
from cargolens.functions.labels import month_year_label
from cargolens.functions.measures import per_nonzero, per_positive
from cargolens.model import FilterState
from cargolens.operators.dimensions import (
    calendar_dimension,
    country_dimension,
    key_conflicts,
    merge_rows,
    product_dimension,
    unit_dimension,
)
from cargolens.operators.trade import hierarchy_table
from cargolens.plans.filters import predicate
from cargolens.plans.star import star
from cargolens.sources.raw import clean_facts
from registry.core import register

_STAR_DOUBLES = ("QT_ESTAT", "KG_LIQUIDO", "VL_FOB", "VL_FRETE", "VL_SEGURO")

# --- the star and its filters --------------------------------------------------
register("j1_star_view", lambda d: star(d.tables), "SELECT * FROM star", ("star",), _STAR_DOUBLES)

_STATE = FilterState(
    flow="IMP",
    year=1997,
    months=(3, 4, 5),
    sectors=("Indústria de Transformação", "Não classificado"),
    sh2=("10", "11", "12", None),
)
register(
    "f1_filtered_star",
    lambda d: star(d.tables).where(predicate(_STATE)),
    """SELECT * FROM star WHERE FLUXO = 'IMP' AND CO_ANO = 1997 AND CO_MES IN (3, 4, 5)
AND SETOR IN ('Indústria de Transformação', 'Não classificado')
AND (CO_SH2 IN ('10', '11', '12') OR CO_SH2 IS NULL)""",
    ("star",),
    _STAR_DOUBLES,
)
register(
    "f1_filtered_by_year_range",
    lambda d: star(d.tables)
    .where(predicate(_STATE, year_range=(1996, 1997), exclude="sectors"))
    .groupBy("FLUXO", "CO_ANO")
    .agg(F.count(F.lit(1)).alias("REGISTROS"), F.sum("VL_FOB").alias("VL_FOB")),
    """SELECT FLUXO, CO_ANO, count(*) AS REGISTROS, sum(VL_FOB) AS VL_FOB FROM star
WHERE FLUXO = 'IMP' AND CO_ANO BETWEEN 1996 AND 1997 AND CO_MES IN (3, 4, 5)
AND (CO_SH2 IN ('10', '11', '12') OR CO_SH2 IS NULL) GROUP BY FLUXO, CO_ANO""",
    ("star",),
    ("VL_FOB",),
)
register(
    "f4_both_flows",
    lambda d: star(d.tables)
    .where(predicate(_STATE, include_flow=False, include_year=False))
    .groupBy("FLUXO")
    .agg(F.sum("KG_LIQUIDO").alias("KG_LIQUIDO")),
    """SELECT FLUXO, sum(KG_LIQUIDO) AS KG_LIQUIDO FROM star WHERE CO_MES IN (3, 4, 5)
AND SETOR IN ('Indústria de Transformação', 'Não classificado')
AND (CO_SH2 IN ('10', '11', '12') OR CO_SH2 IS NULL) GROUP BY FLUXO""",
    ("star",),
    ("KG_LIQUIDO",),
)
register(
    "f6_exports_to_usa",
    lambda d: star(d.tables).where(
        (F.col("FLUXO") == "EXP") & (F.col("CO_PAIS_ISOA3") == "USA") & F.col("CO_SH6").isNotNull()
    ),
    "SELECT * FROM star WHERE FLUXO = 'EXP' AND CO_PAIS_ISOA3 = 'USA' AND CO_SH6 IS NOT NULL",
    ("star",),
    _STAR_DOUBLES,
)
register(
    "f8_narrowed_selection",
    # Choosing another SH2 clears the SH6 and NCM choices that belonged to the old one.
    lambda d: hierarchy_table(
        d.tables,
        FilterState(flow="EXP", year=1998, sh2=("10",), sh6=("999999",), ncm=("x",)).narrowed_from("sh2"),
        "SH6",
    ).select("CODIGO", "VL_FOB"),
    """SELECT CO_SH6 AS CODIGO, sum(VL_FOB) AS VL_FOB FROM star
WHERE FLUXO = 'EXP' AND CO_ANO = 1998 AND CO_SH2 = '10' GROUP BY CO_SH6""",
    ("star",),
    ("VL_FOB",),
)
register(
    "n21_guarded_ratios",
    # Unit 07 has no weight, so both guards meet a zero denominator.
    lambda d: d.tables.fact.groupBy("CO_UNID")
    .agg(F.sum("VL_FOB").alias("fob"), F.sum("KG_LIQUIDO").alias("kg"))
    .select(
        "CO_UNID",
        per_positive("fob", "kg").alias("ACIMA_DE_ZERO"),
        per_nonzero("fob", "kg").alias("DIFERENTE_DE_ZERO"),
        per_positive("fob", -F.col("kg")).alias("NEGATIVO_POSITIVO"),
        per_nonzero("fob", -F.col("kg")).alias("NEGATIVO_NAO_ZERO"),
    ),
    """SELECT CO_UNID, f / nullif(k, 0) AS ACIMA_DE_ZERO, f / nullif(k, 0) AS DIFERENTE_DE_ZERO,
  CAST(NULL AS DOUBLE) AS NEGATIVO_POSITIVO, f / nullif(-k, 0) AS NEGATIVO_NAO_ZERO
FROM (SELECT CO_UNID, CAST(sum(VL_FOB) AS DOUBLE) AS f, CAST(sum(KG_LIQUIDO) AS DOUBLE) AS k FROM fact GROUP BY 1) t""",
    ("fact",),
    ("ACIMA_DE_ZERO", "DIFERENTE_DE_ZERO", "NEGATIVO_POSITIVO", "NEGATIVO_NAO_ZERO"),
)
register(
    "n16_month_labels",
    lambda d: d.given("orders")
    .select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("MES"))
    .distinct()
    .select("MES", month_year_label(F.col("MES")).alias("MES_LABEL")),
    """SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS MES,
  ['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][month(o_orderdate)] || '/' || year(o_orderdate) AS MES_LABEL
FROM orders""",
)

# --- cleaning of raw records ------------------------------------------------------


def _cleaned(d):
    raw = d.stored("raw_records")
    return clean_facts(raw.where("FLUXO = 'EXP'"), "EXP").unionByName(
        clean_facts(raw.where("FLUXO = 'IMP'"), "IMP")
    )


_YEAR = "try_cast(trim(CO_ANO) AS INTEGER)"
_MONTH = "try_cast(trim(CO_MES) AS INTEGER)"


def _number(column: str) -> str:
    value = f"try_cast(replace(trim({column}), ',', '.') AS DOUBLE)"
    return f"CASE WHEN NOT isnan({value}) THEN {value} END"


_VALID = f"{_YEAR} IS NOT NULL AND {_MONTH} IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12) AND length(trim(CO_NCM)) > 0"
CLEANED_SQL = (
    f"SELECT FLUXO, SOURCE_FILE, {_YEAR} AS CO_ANO, {_MONTH} AS CO_MES, upper(trim(SG_UF_NCM)) AS SG_UF_NCM, "
    + ", ".join(
        f"lpad(trim({c}), {CODE_WIDTHS[c]}, '0') AS {c}" for c in ("CO_NCM", "CO_UNID", "CO_PAIS", "CO_VIA", "CO_URF")
    )
    + ", "
    + ", ".join(f"{_number(c)} AS {c}" for c in ("QT_ESTAT", "KG_LIQUIDO", "VL_FOB"))
    + ", "
    + ", ".join(f"IF(FLUXO = 'IMP', {_number(c)}, NULL) AS {c}" for c in ("VL_FRETE", "VL_SEGURO"))
    + f"\nFROM raw_records WHERE {_VALID}"
)
register("n1_n7_cleaned_facts", _cleaned, CLEANED_SQL, ("raw_records",), _STAR_DOUBLES)
register(
    "f5_rejected_rows",
    lambda d: d.stored("raw_records").groupBy("SOURCE_FILE").agg(F.count(F.lit(1)).alias("LIDAS")).join(
        _cleaned(d).groupBy("SOURCE_FILE").agg(F.count(F.lit(1)).alias("VALIDAS")), "SOURCE_FILE", "left"
    ),
    f"""SELECT SOURCE_FILE, count(*) AS LIDAS,
  count_if({_VALID})::BIGINT AS VALIDAS
FROM raw_records GROUP BY SOURCE_FILE""",
    ("raw_records",),
)
register(
    "n8_normalized_headers",
    lambda d: normalize_columns(d.given("part").select("p_partkey", "p_size").toDF(" co  ncm", "Tamanho\tdo item ")),
    "SELECT p_partkey AS CO_NCM, p_size AS TAMANHO_DO_ITEM FROM part",
)
_CODE = """CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN concat(CAST(p_partkey AS STRING), '.0') WHEN 1 THEN concat(' ', CAST(p_partkey AS STRING), '.00')
  WHEN 2 THEN 'NaN' WHEN 3 THEN '' WHEN 4 THEN concat('12.345.', CAST(p_partkey AS STRING)) WHEN 5 THEN '<NA>'
  WHEN 6 THEN concat('-', CAST(p_partkey AS STRING)) WHEN 7 THEN 'sem codigo' ELSE CAST(p_partkey AS STRING) END"""
register(
    "n9_normalized_codes",
    lambda d: d.given("part").selectExpr("p_partkey", f"{_CODE} AS TEXTO").select(
        "p_partkey", "TEXTO", normalize_code(F.col("TEXTO"), 4).alias("CODIGO")
    ),
    f"""SELECT p_partkey, TEXTO, CASE WHEN length(g) < 4 THEN lpad(g, 4, '0') ELSE g END AS CODIGO
FROM (SELECT p_partkey, TEXTO, nullif(regexp_replace(regexp_replace(
        CASE WHEN lower(trim(TEXTO)) NOT IN ('nan', 'none', '<na>') THEN trim(TEXTO) END,
        '^([+-]?\\d+)\\.0+$', '\\1'), '\\D', '', 'g'), '') AS g
      FROM (SELECT p_partkey, {_CODE} AS TEXTO FROM part) t) u""",
)
_WORD = """CASE CAST(p_partkey % 12 AS INT) WHEN 0 THEN 'Sim' WHEN 1 THEN 'NÃO' WHEN 2 THEN ' útil ' WHEN 3 THEN 'Não Útil' WHEN 4 THEN '1'
  WHEN 5 THEN '0' WHEN 6 THEN '1.0' WHEN 7 THEN 'TRUE' WHEN 8 THEN 'Falso' WHEN 9 THEN 'talvez' WHEN 10 THEN NULL ELSE 'inutil' END"""
register(
    "n10_business_days",
    lambda d: d.given("part").selectExpr("p_partkey", f"{_WORD} AS TEXTO").select(
        "p_partkey", business_day(F.col("TEXTO")).alias("DIA_UTIL")
    ),
    f"""SELECT p_partkey, CASE WHEN t IN ('1','sim','s','true','verdadeiro','util','útil') THEN 1
  WHEN t IN ('0','nao','não','n','false','falso','inutil','não útil') THEN 0 END AS DIA_UTIL
FROM (SELECT p_partkey, lower(trim({_WORD})) AS t FROM part) w""",
)
register(
    "n11_folded_text",
    lambda d: d.derived("raw_isic").select("CO_NCM", fold(F.col("NO_ISIC_SECAO")).alias("TEXTO")),
    "SELECT CO_NCM, trim(regexp_replace(strip_accents(lower(NO_ISIC_SECAO)), '\\s+', ' ', 'g')) AS TEXTO FROM raw_isic",
    ("raw_isic",),
)
_SECTOR = """CASE WHEN upper(trim(CO_ISIC_SECAO)) = 'A' OR regexp_matches(strip_accents(lower(NO_ISIC_SECAO)), 'agricultura|agropec|pesca|aquicultura') THEN 'Agropecuária'
  WHEN upper(trim(CO_ISIC_SECAO)) = 'B' OR regexp_matches(strip_accents(lower(NO_ISIC_SECAO)), 'extrativ') THEN 'Indústria Extrativa'
  WHEN upper(trim(CO_ISIC_SECAO)) = 'C' OR regexp_matches(strip_accents(lower(NO_ISIC_SECAO)), 'transforma') THEN 'Indústria de Transformação'
  ELSE 'Outros Produtos' END"""
_CATEGORY = """CASE WHEN strip_accents(lower(NO_CGCE_N1)) LIKE '%capital%' THEN 'Bens de Capital'
  WHEN strip_accents(lower(NO_CGCE_N1)) LIKE '%intermed%' THEN 'Bens Intermediários'
  WHEN strip_accents(lower(NO_CGCE_N1)) LIKE '%consumo%' THEN 'Bens de Consumo'
  WHEN regexp_matches(strip_accents(lower(NO_CGCE_N1)), 'combust|lubrificant') THEN 'Combustíveis e Lubrificantes'
  WHEN trim(NO_CGCE_N1) <> '' THEN trim(NO_CGCE_N1)
  WHEN CO_CGCE_N1 IS NOT NULL THEN 'Categoria ' || trim(CO_CGCE_N1) ELSE 'Não classificado' END"""
register(
    "n12_macro_sectors",
    lambda d: d.derived("raw_isic").select(
        "CO_NCM", macro_sector(F.col("CO_ISIC_SECAO"), F.col("NO_ISIC_SECAO")).alias("SETOR")
    ),
    f"SELECT CO_NCM, {_SECTOR} AS SETOR FROM raw_isic",
    ("raw_isic",),
)
register(
    "n13_use_categories",
    lambda d: d.derived("raw_cgce").select(
        "CO_NCM", use_category(F.col("CO_CGCE_N1"), F.col("NO_CGCE_N1")).alias("CATEGORIA_USO")
    ),
    f"SELECT CO_NCM, {_CATEGORY} AS CATEGORIA_USO FROM raw_cgce",
    ("raw_cgce",),
)

# --- dimensions ---------------------------------------------------------------------
register(
    "d1_key_conflicts",
    lambda d: key_conflicts(d.given("part").select("p_name", "p_type", "p_size"), "p_name"),
    """SELECT p_name FROM part WHERE p_name IS NOT NULL GROUP BY p_name
HAVING count(DISTINCT p_type) > 1 OR count(DISTINCT p_size) > 1""",
)
register(
    "d1_one_row_per_key",
    # The same product twice, each time with another gap.
    lambda d: merge_rows(
        d.derived("raw_isic").withColumn("NO_NCM_POR", F.lit(None).cast("string")).unionByName(
            d.derived("raw_isic").withColumn("NO_ISIC_SECAO", F.lit(None).cast("string"))
        ),
        "CO_NCM",
    ),
    "SELECT * FROM raw_isic",
    ("raw_isic",),
)
_CODE8, _PAD = "lpad(replace(CO_NCM, '.0', ''), 8, '0')", "lpad(replace({c}, '.00', ''), {w}, '0')"
register(
    "d2_product_dimension",
    lambda d: product_dimension(*(d.derived(n) for n in ("raw_isic", "raw_cgce", "raw_sh", "raw_sh2", "raw_sh4"))),
    f"""WITH i AS (SELECT {_CODE8} AS CO_NCM, NO_NCM_POR, CO_ISIC_SECAO, NO_ISIC_SECAO FROM raw_isic),
c AS (SELECT lpad(CO_NCM, 8, '0') AS CO_NCM, CO_CGCE_N1, NO_CGCE_N1 FROM raw_cgce),
s AS (SELECT CO_NCM, lpad(replace(CO_SH6, '.00', ''), 6, '0') AS CO_SH6, NO_SH6_POR, lpad(CO_SH4, 4, '0') AS CO_SH4,
             lpad(CO_SH2, 2, '0') AS CO_SH2, NO_SH2_POR FROM raw_sh),
j AS (SELECT * FROM i FULL JOIN c USING (CO_NCM) FULL JOIN s USING (CO_NCM))
SELECT j.* EXCLUDE (NO_SH2_POR), coalesce(j.NO_SH2_POR, a.NO_SH2_POR) AS NO_SH2_POR, b.NO_SH4_POR,
  {_SECTOR} AS SETOR, {_CATEGORY} AS CATEGORIA_USO
FROM j LEFT JOIN raw_sh2 a ON j.CO_SH2 = lpad(a.CO_SH2, 2, '0')
LEFT JOIN raw_sh4 b ON j.CO_SH4 = lpad(replace(b.CO_SH4, '.0', ''), 4, '0')""",
    ("raw_isic", "raw_cgce", "raw_sh", "raw_sh2", "raw_sh4"),
)
register(
    "d4_country_dimension",
    lambda d: country_dimension(d.derived("raw_country")),
    """SELECT lpad(CO_PAIS, 3, '0') AS CO_PAIS, NO_PAIS, CO_PAIS_ISOA3,
  coalesce(NO_PAIS, 'País não identificado') AS PAIS FROM raw_country""",
    ("raw_country",),
)
register(
    "d5_unit_dimension",
    lambda d: unit_dimension(d.derived("raw_unit")),
    """SELECT lpad(replace(CO_UNID, '.0', ''), 2, '0') AS CO_UNID, NO_UNID,
  coalesce(NO_UNID, 'Unidade não identificada') AS UNIDADE FROM raw_unit""",
    ("raw_unit",),
)
register(
    "d6_business_day_calendar",
    lambda d: calendar_dimension(d.derived("raw_days")),
    """SELECT ANO, MES, CAST(sum(U) AS INT) AS DIAS_UTEIS FROM (
  SELECT CAST(CO_ANO AS INT) AS ANO, CAST(CAST(CO_MES AS DOUBLE) AS INT) AS MES, CO_DIA,
         max(CASE WHEN lower(trim(DIA_UTIL)) IN ('1', 'sim', 'útil', 'verdadeiro') THEN 1
                  WHEN lower(trim(DIA_UTIL)) IN ('0', 'não') THEN 0 END) AS U
  FROM raw_days WHERE CO_MES IS NOT NULL GROUP BY ALL) t GROUP BY ANO, MES""",
    ("raw_days",),
)
