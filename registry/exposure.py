"""Exposure to the tariff action, dependence on the United States, exemptions, tariff."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions.labels import chart_label, state_label, status_label, translate_scope
from cargolens.functions.measures import tonnes
from cargolens.model import (
    STATE_NAMES,
    STATUS_AFFECTED,
    STATUS_CONDITIONED,
    STATUS_MIXED,
    FilterState,
)
from cargolens.operators.exemptions import (
    clean_lines,
    consolidate_exemptions,
    duplicate_codes,
    merge_continuations,
)
from cargolens.operators.exposure import (
    category_summary,
    exposure_totals,
    product_exposure,
    sh6_summary,
    state_products,
    status_totals,
)
from cargolens.operators.impact import (
    impact_bands,
    sector_impact,
    state_headline,
    state_impact,
)
from cargolens.operators.select import largest, select_result
from cargolens.operators.tariff import (
    clean_tariff,
    tariff_headline,
    tariff_series,
    tariff_violations,
)
from registry.core import register

# The flow is set to imports on purpose: these operators always look at exports.
YEAR_1998 = FilterState(flow="IMP", year=1998)
_REF_COLUMNS = """r.QTD_HTSUS_8, r.QTD_HTSUS_10, r.QTD_SEM_LIMITACAO, r.QTD_CONDICIONADAS, r.LIMITACOES_ESCOPO,
  r.PAGINA_INICIAL, r.PAGINA_FINAL, r.TIPO_ESCOPO_SH6, r.FONTE, r.ANEXO, r.DATA_VIGENCIA_GERAL,
  CAST(coalesce(r.QTD_LINHAS_HTSUS, 0) AS BIGINT) AS QTD_LINHAS_HTSUS,
  coalesce(r.CODIGOS_HTSUS, '') AS CODIGOS_HTSUS, coalesce(r.DESCRICAO_HTSUS_EXEMPLO, '') AS DESCRICAO_HTSUS_EXEMPLO,
  coalesce(replace(replace(replace(r.LIMITACOES_ESCOPO, 'Ex', 'Somente o produto descrito no Anexo II'),
           'Pharma', 'Somente uso farmacêutico'), 'Aircraft', 'Somente aeronaves civis e artigos abrangidos'), '') AS LIMITACOES_PT,
  CASE WHEN r.CO_SH6 IS NULL THEN 'Sem correspondência - potencialmente afetado'
       WHEN r.TIPO_ESCOPO_SH6 = 'Condicionado' THEN 'Correspondência condicionada no SH6'
       WHEN r.TIPO_ESCOPO_SH6 = 'Misto' THEN 'Correspondência mista no SH6'
       ELSE 'Correspondência com isenção no SH6' END AS SITUACAO_301"""
_TO_USA = "FLUXO = 'EXP' AND CO_ANO = 1998 AND CO_PAIS_ISOA3 = 'USA' AND CO_SH6 IS NOT NULL"
_EXPOSURE = f"""WITH exporta AS (
  SELECT SETOR, CATEGORIA_USO, CO_NCM, coalesce(s.NO_NCM_POR, CO_NCM) AS NO_NCM_POR,
         CO_SH6, coalesce(s.NO_SH6_POR, CO_SH6) AS NO_SH6_POR,
         CAST(sum(VL_FOB) AS DOUBLE) AS VL_FOB, CAST(sum(KG_LIQUIDO) AS DOUBLE) AS KG_LIQUIDO
  FROM star s WHERE {_TO_USA}
  GROUP BY SETOR, CATEGORIA_USO, CO_NCM, s.NO_NCM_POR, CO_SH6, s.NO_SH6_POR),
exposicao AS (
  SELECT e.*, {_REF_COLUMNS},
         CASE WHEN sum(VL_FOB) OVER () > 0 THEN VL_FOB / sum(VL_FOB) OVER () END AS PARTICIPACAO_FOB_EUA
  FROM exporta e LEFT JOIN exemptions r ON e.CO_SH6 = r.CO_SH6)
"""
_VIEWS = ("star", "exemptions")


def _exposure(d):
    return product_exposure(d.tables, YEAR_1998, d.listed)


register(
    "q8_product_exposure",
    _exposure,
    _EXPOSURE + "SELECT * FROM exposicao",
    _VIEWS,
    ("VL_FOB", "KG_LIQUIDO", "PARTICIPACAO_FOB_EUA"),
)
for _level, _group, _head in (
    ("SH6", "CO_SH6, s.NO_SH6_POR", "CO_SH6 AS CODIGO, coalesce(s.NO_SH6_POR, CO_SH6) AS DESCRICAO, count(DISTINCT CO_NCM) AS NCMS"),
    ("NCM", "CO_SH6, s.NO_SH6_POR, CO_NCM, s.NO_NCM_POR", "CO_NCM AS CODIGO, coalesce(s.NO_NCM_POR, CO_NCM) AS DESCRICAO, CAST(1 AS BIGINT) AS NCMS"),
):
    _STATE_PRODUCTS = f"""WITH exporta AS (
  SELECT CO_SH6, coalesce(s.NO_SH6_POR, CO_SH6) AS NO_SH6_POR, {_head},
         string_agg(DISTINCT s.SETOR, ' / ' ORDER BY s.SETOR) AS SETOR,
         string_agg(DISTINCT s.CATEGORIA_USO, ' / ' ORDER BY s.CATEGORIA_USO) AS CATEGORIA_USO,
         CAST(sum(s.VL_FOB) AS DOUBLE) AS VL_FOB, CAST(sum(s.KG_LIQUIDO) AS DOUBLE) AS KG_LIQUIDO
  FROM star s WHERE {_TO_USA} AND coalesce(nullif(trim(SG_UF_NCM), ''), 'Não informado') = 'SP'
  GROUP BY {_group}),
situacao AS (
  SELECT e.*, {_REF_COLUMNS},
         CASE WHEN sum(VL_FOB) OVER () > 0 THEN VL_FOB / sum(VL_FOB) OVER () END AS PARTICIPACAO_FOB_EUA,
         KG_LIQUIDO / 1000 AS TONELADAS_EUA
  FROM exporta e LEFT JOIN exemptions r ON e.CO_SH6 = r.CO_SH6),
afetado AS (
  SELECT *, CASE WHEN SITUACAO_301 LIKE 'Sem%' THEN VL_FOB ELSE 0 END AS VALOR_POTENCIALMENTE_AFETADO,
         CASE WHEN SITUACAO_301 LIKE 'Sem%' THEN TONELADAS_EUA ELSE 0 END AS TONELADAS_POTENCIALMENTE_AFETADAS
  FROM situacao),
produtos AS (
SELECT *, CASE WHEN sum(VALOR_POTENCIALMENTE_AFETADO) OVER () > 0
  THEN VALOR_POTENCIALMENTE_AFETADO / sum(VALOR_POTENCIALMENTE_AFETADO) OVER () END AS PARTICIPACAO_NO_AFETADO_UF
FROM afetado)
"""
    _DOUBLES = (
        "VL_FOB", "KG_LIQUIDO", "PARTICIPACAO_FOB_EUA", "TONELADAS_EUA", "VALOR_POTENCIALMENTE_AFETADO",
        "TONELADAS_POTENCIALMENTE_AFETADAS", "PARTICIPACAO_NO_AFETADO_UF",
    )
    register(
        f"q9_state_products_{_level.lower()}",
        lambda d, v=_level: state_products(d.tables, YEAR_1998, d.listed, "SP", v),
        _STATE_PRODUCTS + "SELECT * FROM produtos",
        _VIEWS,
        _DOUBLES,
    )
    if _level == "SH6":
        register(
            "q22_affected_products_of_state",
            lambda d: select_result(
                state_products(d.tables, YEAR_1998, d.listed, "SP"),
                where=F.col("VALOR_POTENCIALMENTE_AFETADO") > 0,
                order_by="VALOR_POTENCIALMENTE_AFETADO",
                tiebreak=("CODIGO",),
            ).select(
                chart_label(F.col("DESCRICAO"), F.col("CODIGO")).alias("ROTULO"),
                "VALOR_POTENCIALMENTE_AFETADO",
                status_label(F.col("SITUACAO_301")).alias("SITUACAO"),
            ),
            _STATE_PRODUCTS
            + """SELECT concat(substr(DESCRICAO, 1, 58), ' · ', CODIGO) AS ROTULO, VALOR_POTENCIALMENTE_AFETADO,
  'Potencialmente afetado' AS SITUACAO FROM produtos WHERE VALOR_POTENCIALMENTE_AFETADO > 0""",
            _VIEWS,
            ("VALOR_POTENCIALMENTE_AFETADO",),
        )


def _impact_sql(group: str, keys: str) -> str:
    """One row per group, from its destinations and their rank."""
    return f"""WITH sales AS (
  SELECT {group}, CO_PAIS_ISOA3 = 'USA' AS to_usa, CO_PAIS_ISOA3, PAIS, sum(VL_FOB) AS fob, sum(KG_LIQUIDO) AS kg,
         coalesce(sum(VL_FOB) FILTER (CO_SH6 IS NULL OR CO_SH6 NOT IN (SELECT CO_SH6 FROM exemptions)), 0) AS hit_fob,
         coalesce(sum(KG_LIQUIDO) FILTER (CO_SH6 IS NULL OR CO_SH6 NOT IN (SELECT CO_SH6 FROM exemptions)), 0) AS hit_kg
  FROM star LEFT JOIN (SELECT CO_NCM, CO_ISIC_SECAO, NO_ISIC_SECAO FROM dim_ncm) section USING (CO_NCM)
  WHERE FLUXO = 'EXP' AND CO_ANO = 1998 GROUP BY ALL),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY {keys} ORDER BY fob DESC NULLS LAST) AS place FROM sales),
folded AS (
  SELECT {keys}, CAST(sum(fob) AS DOUBLE) AS world, CAST(sum(fob) FILTER (to_usa) AS DOUBLE) AS usa,
         CAST(sum(kg) FILTER (to_usa) AS DOUBLE) / 1000 AS usa_t, CAST(sum(hit_fob) FILTER (to_usa) AS DOUBLE) AS hit,
         CAST(sum(hit_kg) FILTER (to_usa) AS DOUBLE) / 1000 AS hit_t, CAST(min(place) FILTER (to_usa) AS INT) AS place_usa,
         string_agg(PAIS, ' / ' ORDER BY PAIS) FILTER (place = 1) AS first_place
  FROM placed GROUP BY {keys}),
impacto AS (
  SELECT {keys}, world AS EXPORTACOES_MUNDO, first_place AS PRINCIPAL_DESTINO, place_usa AS POSICAO_EUA,
         IF(place_usa = 1, 'Sim', 'Não') AS EUA_MAIOR_CLIENTE, usa AS EXPORTACOES_EUA, usa_t AS TONELADAS_EUA,
         usa / nullif(world, 0) AS PARTICIPACAO_EUA, hit AS VALOR_POTENCIALMENTE_AFETADO,
         hit_t AS TONELADAS_POTENCIALMENTE_AFETADAS, hit / nullif(usa, 0) AS PARTICIPACAO_AFETADA_NOS_EUA,
         hit / nullif(world, 0) AS EXPOSICAO
  FROM folded WHERE usa > 0)
"""


_IMPACT_DOUBLES = (
    "EXPORTACOES_MUNDO", "EXPORTACOES_EUA", "TONELADAS_EUA", "PARTICIPACAO_EUA",
    "VALOR_POTENCIALMENTE_AFETADO", "TONELADAS_POTENCIALMENTE_AFETADAS", "PARTICIPACAO_AFETADA_NOS_EUA",
)
_ISIC = """SETOR, coalesce(CO_ISIC_SECAO, 'N/C') AS CO_ISIC_SECAO,
  coalesce(NO_ISIC_SECAO, 'Não classificado') AS NO_ISIC_SECAO"""
for _level, _group, _keys in (
    ("SETOR", "SETOR", "SETOR"),
    ("ISIC", _ISIC, "SETOR, CO_ISIC_SECAO, NO_ISIC_SECAO"),
):
    register(
        f"q10_sector_impact_{_level.lower()}",
        lambda d, v=_level: sector_impact(d.tables, YEAR_1998, d.listed, v),
        _impact_sql(_group, _keys)
        + "SELECT * EXCLUDE (EXPOSICAO), EXPOSICAO AS EXPOSICAO_EXPORTACOES_SETOR FROM impacto",
        _VIEWS,
        (*_IMPACT_DOUBLES, "EXPOSICAO_EXPORTACOES_SETOR"),
    )
register(
    "q22_most_exposed_sector",
    lambda d: select_result(
        sector_impact(d.tables, YEAR_1998, d.listed, "SETOR"),
        order_by="VALOR_POTENCIALMENTE_AFETADO", tiebreak=("SETOR",), n=1,
    ).select("SETOR", "VALOR_POTENCIALMENTE_AFETADO", "PARTICIPACAO_EUA"),
    _impact_sql("SETOR", "SETOR")
    + """SELECT SETOR, VALOR_POTENCIALMENTE_AFETADO, PARTICIPACAO_EUA FROM impacto
ORDER BY VALOR_POTENCIALMENTE_AFETADO DESC NULLS LAST, SETOR LIMIT 1""",
    _VIEWS,
    ("VALOR_POTENCIALMENTE_AFETADO", "PARTICIPACAO_EUA"),
)
_UF = _impact_sql("coalesce(nullif(trim(SG_UF_NCM), ''), 'Não informado') AS UF", "UF") + """, estados AS (
SELECT * EXCLUDE (EXPOSICAO), EXPOSICAO AS EXPOSICAO_EXPORTACOES_UF,
  CASE WHEN sum(VALOR_POTENCIALMENTE_AFETADO) OVER () > 0
       THEN VALOR_POTENCIALMENTE_AFETADO / sum(VALOR_POTENCIALMENTE_AFETADO) OVER () END AS PARTICIPACAO_NO_AFETADO_BRASIL
FROM impacto)
"""
_UF_DOUBLES = (*_IMPACT_DOUBLES, "EXPOSICAO_EXPORTACOES_UF", "PARTICIPACAO_NO_AFETADO_BRASIL")


def _states(d):
    return state_impact(d.tables, YEAR_1998, d.listed)


register("q11_state_impact", _states, _UF + "SELECT * FROM estados", _VIEWS, _UF_DOUBLES)
_UF_LABELS = " ".join(f"WHEN '{code}' THEN '{name} ({code})'" for code, name in STATE_NAMES.items())
_BANDS = f""", faixas AS (
SELECT *, CASE UF {_UF_LABELS} ELSE UF END AS UF_LABEL,
  CAST(rank() OVER (ORDER BY VALOR_POTENCIALMENTE_AFETADO DESC NULLS LAST) AS INT) AS POSICAO_IMPACTO
FROM estados)
"""
_BAND = """CASE WHEN VALOR_POTENCIALMENTE_AFETADO <= 0 THEN 'Sem exposição identificada'
  WHEN POSICAO_IMPACTO <= 5 THEN 'Maior exposição potencial'
  WHEN POSICAO_IMPACTO <= 10 THEN 'Exposição relevante' ELSE 'Menor exposição relativa' END AS FAIXA_IMPACTO"""
register(
    "q32_impact_bands",
    lambda d: impact_bands(_states(d)),
    _UF + _BANDS + f"SELECT *, {_BAND} FROM faixas",
    _VIEWS,
    _UF_DOUBLES,
)
register(
    "q22_top_states",
    lambda d: largest(
        impact_bands(_states(d)).where((F.col("UF") != "Não informado") & (F.col("VALOR_POTENCIALMENTE_AFETADO") > 0)),
        "VALOR_POTENCIALMENTE_AFETADO", 3, "UF",
    ).select("UF_LABEL", "POSICAO_IMPACTO", "VALOR_POTENCIALMENTE_AFETADO"),
    _UF + _BANDS
    + """SELECT UF_LABEL, POSICAO_IMPACTO, VALOR_POTENCIALMENTE_AFETADO FROM faixas
WHERE UF <> 'Não informado' AND VALOR_POTENCIALMENTE_AFETADO > 0
ORDER BY VALOR_POTENCIALMENTE_AFETADO DESC, UF LIMIT 3""",
    _VIEWS,
    ("VALOR_POTENCIALMENTE_AFETADO",),
)
register(
    "q33_state_headline",
    lambda d: state_headline(d.tables, YEAR_1998, _states(d)),
    _UF
    + """SELECT n AS EXPORTACOES_BRASIL, e AS EXPORTACOES_EUA, a AS VALOR_POTENCIALMENTE_AFETADO, e / nullif(n, 0) AS PARTICIPACAO_EUA
FROM (SELECT sum(EXPORTACOES_EUA) AS e, sum(VALOR_POTENCIALMENTE_AFETADO) AS a,
             (SELECT CAST(sum(VL_FOB) AS DOUBLE) FROM star WHERE FLUXO = 'EXP' AND CO_ANO = 1998) AS n FROM estados) t""",
    _VIEWS,
    ("EXPORTACOES_BRASIL", "EXPORTACOES_EUA", "VALOR_POTENCIALMENTE_AFETADO", "PARTICIPACAO_EUA"),
)

# --- Q19-Q21, Q27 and the drill-downs -----------------------------------------
_AFFECTED = "CASE WHEN SITUACAO_301 LIKE 'Sem%' THEN {c} ELSE 0 END"
_SH6 = _EXPOSURE + f""", resumo AS (
  SELECT SETOR, CO_SH6, NO_SH6_POR, SITUACAO_301, sum(VL_FOB) AS EXPORTACOES_EUA,
         sum({_AFFECTED.format(c='VL_FOB')}) AS VALOR_POTENCIALMENTE_AFETADO, count(DISTINCT CO_NCM) AS NCMS,
         sum(KG_LIQUIDO) / 1000 AS TONELADAS_EUA,
         sum({_AFFECTED.format(c='KG_LIQUIDO')}) / 1000 AS TONELADAS_POTENCIALMENTE_AFETADAS
  FROM exposicao GROUP BY SETOR, CO_SH6, NO_SH6_POR, SITUACAO_301),
sh6 AS (
SELECT *, CASE WHEN sum(VALOR_POTENCIALMENTE_AFETADO) OVER () > 0
  THEN VALOR_POTENCIALMENTE_AFETADO / sum(VALOR_POTENCIALMENTE_AFETADO) OVER () END AS PARTICIPACAO_NO_AFETADO_BRASIL
FROM resumo)
"""
_SUMMARY_DOUBLES = (
    "EXPORTACOES_EUA", "VALOR_POTENCIALMENTE_AFETADO", "TONELADAS_EUA",
    "TONELADAS_POTENCIALMENTE_AFETADAS", "PARTICIPACAO_NO_AFETADO_BRASIL",
)
register(
    "q19_sh6_summary", lambda d: sh6_summary(_exposure(d)), _SH6 + "SELECT * FROM sh6", _VIEWS, _SUMMARY_DOUBLES
)
register(
    "q22_affected_sh6_of_sector",
    lambda d: select_result(
        sh6_summary(_exposure(d)),
        where=(F.col("SETOR") == "Indústria de Transformação") & (F.col("VALOR_POTENCIALMENTE_AFETADO") > 0),
        order_by="VALOR_POTENCIALMENTE_AFETADO", tiebreak=("CO_SH6",),
    ),
    _SH6 + "SELECT * FROM sh6 WHERE SETOR = 'Indústria de Transformação' AND VALOR_POTENCIALMENTE_AFETADO > 0",
    _VIEWS,
    _SUMMARY_DOUBLES,
)
register(
    "q20_category_summary",
    lambda d: category_summary(_exposure(d)),
    _EXPOSURE + f""", resumo AS (
  SELECT CATEGORIA_USO, sum(VL_FOB) AS EXPORTACOES_EUA,
         sum({_AFFECTED.format(c='VL_FOB')}) AS VALOR_POTENCIALMENTE_AFETADO,
         count(DISTINCT CO_SH6) AS SH6, count(DISTINCT CO_NCM) AS NCMS, sum(KG_LIQUIDO) / 1000 AS TONELADAS_EUA,
         sum({_AFFECTED.format(c='KG_LIQUIDO')}) / 1000 AS TONELADAS_POTENCIALMENTE_AFETADAS
  FROM exposicao GROUP BY CATEGORIA_USO)
SELECT *, VALOR_POTENCIALMENTE_AFETADO / nullif(EXPORTACOES_EUA, 0) AS PARTICIPACAO_AFETADA_NOS_EUA,
  CASE WHEN sum(VALOR_POTENCIALMENTE_AFETADO) OVER () > 0
  THEN VALOR_POTENCIALMENTE_AFETADO / sum(VALOR_POTENCIALMENTE_AFETADO) OVER () END AS PARTICIPACAO_NO_AFETADO_BRASIL
FROM resumo""",
    _VIEWS,
    (*_SUMMARY_DOUBLES, "PARTICIPACAO_AFETADA_NOS_EUA"),
)
register(
    "q21_exposure_totals",
    lambda d: exposure_totals(_exposure(d)),
    _EXPOSURE + f"""SELECT t AS EXPORTACOES_EUA, a AS VALOR_POTENCIALMENTE_AFETADO, k / 1000 AS TONELADAS_POTENCIALMENTE_AFETADAS,
  c AS VALOR_CONDICIONADO_OU_MISTO, t - a AS VALOR_ISENTO, a / nullif(t, 0) AS PARCELA_AFETADA
FROM (SELECT sum(VL_FOB) AS t, sum({_AFFECTED.format(c='VL_FOB')}) AS a, sum({_AFFECTED.format(c='KG_LIQUIDO')}) AS k,
      sum(CASE WHEN SITUACAO_301 LIKE '%condicionada%' OR SITUACAO_301 LIKE '%mista%' THEN VL_FOB ELSE 0 END) AS c
      FROM exposicao) x""",
    _VIEWS,
    (
        "EXPORTACOES_EUA", "VALOR_POTENCIALMENTE_AFETADO", "TONELADAS_POTENCIALMENTE_AFETADAS",
        "VALOR_CONDICIONADO_OU_MISTO", "VALOR_ISENTO", "PARCELA_AFETADA",
    ),
)
_STATUSES = """(VALUES (1, 'Sem correspondência - potencialmente afetado', 'Potencialmente afetado'),
  (2, 'Correspondência com isenção no SH6', 'Correspondência com isenção'),
  (3, 'Correspondência condicionada no SH6', 'Isenção condicionada'),
  (4, 'Correspondência mista no SH6', 'Correspondência mista')) s(ORDEM, SITUACAO_301, ROTULO)"""
register(
    "q27_status_totals",
    lambda d: status_totals(_exposure(d)),
    _EXPOSURE + f"""SELECT ORDEM, SITUACAO_301, ROTULO, VL_FOB, VL_FOB / sum(VL_FOB) OVER () AS PARTICIPACAO
FROM (SELECT s.ORDEM, s.SITUACAO_301, s.ROTULO, coalesce(sum(e.VL_FOB), 0) AS VL_FOB
      FROM {_STATUSES} LEFT JOIN exposicao e ON e.SITUACAO_301 = s.SITUACAO_301 GROUP BY ALL) t""",
    _VIEWS,
    ("VL_FOB", "PARTICIPACAO"),
)
register(
    "q28_largest_exposures",
    lambda d: largest(_exposure(d), "VL_FOB", 15, "CO_NCM").select(
        chart_label(F.col("NO_NCM_POR"), F.col("CO_NCM"), 46).alias("ROTULO"), "VL_FOB", "SITUACAO_301"
    ),
    _EXPOSURE
    + """SELECT concat(substr(NO_NCM_POR, 1, 46), ' · ', CO_NCM) AS ROTULO, VL_FOB, SITUACAO_301 FROM exposicao
WHERE VL_FOB IS NOT NULL ORDER BY exposicao.VL_FOB DESC, CO_NCM LIMIT 15""",
    _VIEWS,
    ("VL_FOB",),
)
register(
    "q22_category_products",
    lambda d: select_result(
        _exposure(d).where(F.col("CATEGORIA_USO") == "Bens de Consumo"),
        where=F.col("SITUACAO_301") == STATUS_AFFECTED, order_by="VL_FOB", tiebreak=("CO_NCM",),
    ).select("SETOR", "CO_NCM", "NO_NCM_POR", "VL_FOB", tonnes("KG_LIQUIDO").alias("TONELADAS")),
    _EXPOSURE
    + """SELECT SETOR, CO_NCM, NO_NCM_POR, VL_FOB, KG_LIQUIDO / 1000 AS TONELADAS FROM exposicao
WHERE CATEGORIA_USO = 'Bens de Consumo' AND SITUACAO_301 LIKE 'Sem%'""",
    _VIEWS,
    ("VL_FOB", "TONELADAS"),
)

register(
    "q22_most_affected_sh6",
    lambda d: select_result(
        sh6_summary(_exposure(d)), where=F.col("VALOR_POTENCIALMENTE_AFETADO") > 0,
        order_by="VALOR_POTENCIALMENTE_AFETADO", tiebreak=("CO_SH6", "SETOR"), n=1,
    ).select(
        chart_label(F.col("NO_SH6_POR"), F.col("CO_SH6"), 55).alias("ROTULO"), "VALOR_POTENCIALMENTE_AFETADO",
        "PARTICIPACAO_NO_AFETADO_BRASIL",
    ),
    _SH6
    + """SELECT concat(substr(NO_SH6_POR, 1, 55), ' · ', CO_SH6) AS ROTULO, VALOR_POTENCIALMENTE_AFETADO,
  PARTICIPACAO_NO_AFETADO_BRASIL FROM sh6 WHERE VALOR_POTENCIALMENTE_AFETADO > 0
ORDER BY sh6.VALOR_POTENCIALMENTE_AFETADO DESC, CO_SH6, SETOR LIMIT 1""",
    _VIEWS,
    ("VALOR_POTENCIALMENTE_AFETADO", "PARTICIPACAO_NO_AFETADO_BRASIL"),
)
register(
    "q22_products_by_status",
    lambda d: select_result(
        _exposure(d), where=F.col("SITUACAO_301").isin(STATUS_CONDITIONED, STATUS_MIXED), order_by="VL_FOB",
        tiebreak=("CO_NCM",),
    ).select(
        "CO_NCM", "CO_SH6", "VL_FOB", tonnes("KG_LIQUIDO").alias("TONELADAS"),
        status_label(F.col("SITUACAO_301")).alias("SITUACAO"), "LIMITACOES_PT", "CODIGOS_HTSUS",
    ),
    _EXPOSURE
    + """SELECT CO_NCM, CO_SH6, VL_FOB, KG_LIQUIDO / 1000 AS TONELADAS,
  CASE WHEN SITUACAO_301 LIKE '%mista%' THEN 'Correspondência mista' ELSE 'Isenção condicionada' END AS SITUACAO,
  LIMITACOES_PT, CODIGOS_HTSUS FROM exposicao WHERE SITUACAO_301 LIKE '%mista%' OR SITUACAO_301 LIKE '%condicionada%'""",
    _VIEWS,
    ("VL_FOB", "TONELADAS"),
)
register(
    "q22_states_by_dependence",
    lambda d: select_result(
        _states(d), where=F.col("VALOR_POTENCIALMENTE_AFETADO") > 0, order_by="PARTICIPACAO_EUA",
        tiebreak=("UF",), n=5,
    ).select("UF", "PARTICIPACAO_EUA", "EUA_MAIOR_CLIENTE"),
    _UF
    + """SELECT UF, PARTICIPACAO_EUA, EUA_MAIOR_CLIENTE FROM estados WHERE VALOR_POTENCIALMENTE_AFETADO > 0
ORDER BY estados.PARTICIPACAO_EUA DESC NULLS LAST, UF LIMIT 5""",
    _VIEWS,
    ("PARTICIPACAO_EUA",),
)

# --- Q45-Q47, N15, N23: the exemption annex ------------------------------------
register(
    "q45_consolidated_exemptions",
    lambda d: consolidate_exemptions(
        d.derived("htsus_lines"), source="derived", annex="Anexo II", effective_date="2026-07-22"
    ),
    "SELECT * FROM exemptions",
    ("exemptions",),
)
register(
    "q46_duplicate_codes",
    lambda d: duplicate_codes(d.derived("htsus_lines")),
    "SELECT HTSUS_DIGITOS, count(*) AS LINHAS FROM htsus_lines GROUP BY 1 HAVING count(*) > 1",
    ("htsus_lines",),
)
_CLEAN_CELLS = """WITH celulas AS (
  SELECT DOCUMENTO, LINHA, PAGINA_PDF, trim(regexp_replace(HTSUS, '\\s+', ' ', 'g')) AS HTSUS,
         trim(regexp_replace(DESCRICAO_EN, '\\s+', ' ', 'g')) AS DESCRICAO_EN,
         trim(regexp_replace(LIMITACAO_ESCOPO, '\\s+', ' ', 'g')) AS LIMITACAO_ESCOPO
  FROM annex_cells),
digitos AS (
  SELECT *, CASE WHEN length(regexp_replace(HTSUS, '\\D', '', 'g')) IN (8, 10) THEN regexp_replace(HTSUS, '\\D', '', 'g') END AS HTSUS_DIGITOS
  FROM celulas)
"""
register(
    "n23_clean_annex_lines",
    lambda d: clean_lines(d.stored("annex_cells")),
    _CLEAN_CELLS + "SELECT *, substr(HTSUS_DIGITOS, 1, 6) AS CO_SH6 FROM digitos",
    ("annex_cells",),
)
register(
    "q47_merged_annex_lines",
    lambda d: merge_continuations(clean_lines(d.stored("annex_cells"))),
    _CLEAN_CELLS
    + """, donos AS (
  SELECT *, max(CASE WHEN HTSUS_DIGITOS IS NOT NULL THEN LINHA END)
            OVER (PARTITION BY DOCUMENTO ORDER BY LINHA ROWS UNBOUNDED PRECEDING) AS DONO FROM digitos),
partes AS (SELECT * FROM donos WHERE DONO IS NOT NULL
           AND (HTSUS_DIGITOS IS NOT NULL OR (HTSUS = '' AND DESCRICAO_EN <> '')))
SELECT c.DOCUMENTO, c.LINHA, c.PAGINA_PDF, c.HTSUS, t.DESCRICAO_EN, c.LIMITACAO_ESCOPO, c.HTSUS_DIGITOS,
       substr(c.HTSUS_DIGITOS, 1, 6) AS CO_SH6
FROM digitos c JOIN (SELECT DOCUMENTO, DONO, string_agg(DESCRICAO_EN, ' ' ORDER BY LINHA) AS DESCRICAO_EN
                     FROM partes GROUP BY 1, 2) t ON c.DOCUMENTO = t.DOCUMENTO AND c.LINHA = t.DONO""",
    ("annex_cells",),
)
register(
    "n15_translated_scopes",
    lambda d: d.exemptions.select("CO_SH6", translate_scope(F.col("LIMITACOES_ESCOPO")).alias("LIMITACOES_PT")),
    """SELECT CO_SH6, replace(replace(replace(LIMITACOES_ESCOPO, 'Ex', 'Somente o produto descrito no Anexo II'),
       'Pharma', 'Somente uso farmacêutico'), 'Aircraft', 'Somente aeronaves civis e artigos abrangidos') AS LIMITACOES_PT
FROM exemptions""",
    ("exemptions",),
)
register(
    "n17_state_labels",
    lambda d: d.tables.fact.select("SG_UF_NCM").distinct().select(
        "SG_UF_NCM", state_label(F.col("SG_UF_NCM")).alias("UF_LABEL")
    ),
    f"SELECT DISTINCT SG_UF_NCM, CASE SG_UF_NCM {_UF_LABELS} ELSE SG_UF_NCM END AS UF_LABEL FROM fact",
    ("fact",),
)

# --- Q29, Q30: the effective tariff -------------------------------------------
_MONTHS = "['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez']"
_SERIES = """WITH serie AS (
  SELECT PAIS, CAST(DATA AS DATE) AS DATA, CAST(IMPORTACOES_CONSUMO_USD AS DOUBLE) AS IMPORTACOES_CONSUMO_USD,
         CAST(DIREITOS_ADUANEIROS_USD AS DOUBLE) AS DIREITOS_ADUANEIROS_USD,
         TRY_CAST(BASE_TRIBUTAVEL_USD AS DOUBLE) AS BASE_TRIBUTAVEL_USD,
         CAST(TARIFA_EFETIVA_PCT AS DOUBLE) AS TARIFA_EFETIVA_PCT,
         CAST(TARIFA_BASE_TRIBUTAVEL_PCT AS DOUBLE) AS TARIFA_BASE_TRIBUTAVEL_PCT
  FROM tariff_raw WHERE TRY_CAST(BASE_TRIBUTAVEL_USD AS DOUBLE) IS NOT NULL)
"""
_SERIES_DOUBLES = (
    "IMPORTACOES_CONSUMO_USD", "DIREITOS_ADUANEIROS_USD", "BASE_TRIBUTAVEL_USD", "TARIFA_EFETIVA_PCT",
    "TARIFA_BASE_TRIBUTAVEL_PCT",
)


def _repeated(d):
    """The raw series with every row twice: the duplicates must not matter."""
    raw = d.derived("tariff_raw")
    return raw.unionByName(raw)


register(
    "q29_tariff_series",
    lambda d: tariff_series(_repeated(d)),
    _SERIES + f"SELECT *, {_MONTHS}[month(DATA)] || '/' || year(DATA) AS MES_LABEL FROM serie",
    ("tariff_raw",),
    _SERIES_DOUBLES,
)
register(
    "q29_tariff_violations",
    # Rates of one nation are shifted, so that the report has something to find.
    lambda d: tariff_violations(
        clean_tariff(d.derived("tariff_raw")).withColumn(
            "TARIFA_EFETIVA_PCT",
            F.when(F.col("PAIS") == "NATION_5", F.col("TARIFA_EFETIVA_PCT") + 0.25).otherwise(
                F.col("TARIFA_EFETIVA_PCT")
            ),
        )
    ),
    _SERIES + """SELECT * REPLACE (TARIFA_EFETIVA_PCT + 0.25 AS TARIFA_EFETIVA_PCT), 0.25 AS DIFERENCA
FROM serie WHERE PAIS = 'NATION_5'""",
    ("tariff_raw",),
    (*_SERIES_DOUBLES, "DIFERENCA"),
)
register(
    "q30_tariff_headline",
    lambda d: tariff_headline(tariff_series(d.derived("tariff_raw"))),
    _SERIES + f""", ultimo AS (SELECT PAIS, max(DATA) AS DATA FROM serie GROUP BY PAIS),
passos AS (SELECT *, lag(TARIFA_EFETIVA_PCT) OVER (PARTITION BY PAIS ORDER BY DATA) AS ANTERIOR FROM serie),
pico AS (SELECT PAIS, DATA, TARIFA_EFETIVA_PCT FROM serie
         QUALIFY row_number() OVER (PARTITION BY PAIS ORDER BY TARIFA_EFETIVA_PCT DESC, DATA) = 1)
SELECT p.PAIS, p.DATA, {_MONTHS}[month(p.DATA)] || '/' || year(p.DATA) AS MES_LABEL, p.TARIFA_EFETIVA_PCT,
  p.TARIFA_EFETIVA_PCT - p.ANTERIOR AS VAR_MENSAL, p.TARIFA_EFETIVA_PCT - a.TARIFA_EFETIVA_PCT AS VAR_12_MESES,
  k.DATA AS DATA_PICO, k.TARIFA_EFETIVA_PCT AS PICO, {_MONTHS}[month(k.DATA)] || '/' || year(k.DATA) AS PICO_LABEL
FROM passos p JOIN ultimo u ON p.PAIS = u.PAIS AND p.DATA = u.DATA
LEFT JOIN serie a ON a.PAIS = p.PAIS AND a.DATA = CAST(p.DATA - INTERVAL 1 YEAR AS DATE)
JOIN pico k ON k.PAIS = p.PAIS""",
    ("tariff_raw",),
    ("TARIFA_EFETIVA_PCT", "VAR_MENSAL", "VAR_12_MESES", "PICO"),
)
