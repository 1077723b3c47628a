"""Options, headline figures, breakdowns, balance, months, ranking, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions.labels import balance_status_label, chart_label, classification_label
from cargolens.functions.measures import tonnes
from cargolens.model import LEVEL_BY_ATTRIBUTE, HIERARCHY, FilterState
from cargolens.operators.balance import (
    balance_extremes,
    balance_status_counts,
    balance_totals,
    trade_balance_by_country,
)
from cargolens.operators.monthly import (
    history_years_present,
    monthly_headline,
    monthly_history,
    monthly_profile,
)
from cargolens.operators.options import (
    all_filter_options,
    available_months,
    available_years,
    filter_options,
)
from cargolens.operators.quality import load_log, quality_report
from cargolens.operators.ranking import country_ranking
from cargolens.operators.select import largest, select_result
from cargolens.operators.trade import (
    classification_detail,
    country_composition,
    hierarchy_table,
    summary_metrics,
)
from registry.core import register

EXPORTS_1998 = FilterState(flow="EXP", year=1998)
IMPORTS_1999 = FilterState(flow="IMP", year=1999)
NARROW = FilterState(
    flow="EXP", year=1998, months=(1, 2, 3, 7), sectors=("Agropecuária", "Indústria de Transformação")
)
_NARROW_SQL = """FLUXO = 'EXP' AND CO_ANO = 1998 AND CO_MES IN (1, 2, 3, 7)
  AND SETOR IN ('Agropecuária', 'Indústria de Transformação')"""

# --- Q1-Q3: what can be selected --------------------------------------------
register(
    "q1_available_years",
    lambda d: available_years(d.tables, "EXP"),
    "SELECT DISTINCT CO_ANO FROM fact WHERE FLUXO = 'EXP'",
    ("fact",),
)
register(
    "q2_available_months",
    lambda d: available_months(d.tables, "IMP", 2001),
    "SELECT DISTINCT CO_MES FROM fact WHERE FLUXO = 'IMP' AND CO_ANO = 2001",
    ("fact",),
)
for _attribute, _level in LEVEL_BY_ATTRIBUTE.items():
    # The attribute's own choice is set too: it must not narrow its own options.
    register(
        f"q3_options_{_attribute}",
        lambda d, a=_attribute: filter_options(
            d.tables,
            FilterState(flow="EXP", year=1998, months=(1, 2), **{"categories": ("Bens de Capital",), a: ("x",)})
            if a != "categories"
            else FilterState(flow="EXP", year=1998, months=(1, 2), categories=("x",)),
            a,
        ),
        f"""SELECT DISTINCT {_level.code} AS CODIGO, coalesce({_level.label}, {_level.code}) AS DESCRICAO
FROM star WHERE FLUXO = 'EXP' AND CO_ANO = 1998 AND CO_MES IN (1, 2) AND {_level.code} IS NOT NULL"""
        + ("" if _attribute == "categories" else " AND CATEGORIA_USO = 'Bens de Capital'"),
        ("star",),
    )

_FACETS = {"sectors": ("Agropecuária", "Outros Produtos"), "categories": ("Bens de Capital", "Bens de Consumo"), "sh2": ("07", "08", "30")}
register(
    "q3_all_options",
    # Six lists from one scan; three of the filters are set.
    lambda d: all_filter_options(d.tables, FilterState(flow="EXP", year=1998, months=(1, 2, 5), **_FACETS)),
    "\nUNION ALL ".join(
        f"""SELECT DISTINCT '{attribute}' AS ATRIBUTO, {level.code} AS CODIGO, coalesce({level.label}, {level.code}) AS DESCRICAO
FROM star WHERE FLUXO = 'EXP' AND CO_ANO = 1998 AND CO_MES IN (1, 2, 5) AND {level.code} IS NOT NULL"""
        + "".join(
            f" AND {LEVEL_BY_ATTRIBUTE[a].code} IN ({', '.join(repr(v) for v in values)})"
            for a, values in _FACETS.items()
            if a != attribute
        )
        for attribute, level in LEVEL_BY_ATTRIBUTE.items()
    ),
    ("star",),
)

# --- Q4: headline ------------------------------------------------------------
_SUMMARY = """SELECT fob AS VL_FOB, kg AS KG_LIQUIDO, qt AS QT_ESTAT, IF(kg > 0, fob / kg, NULL) AS FOB_POR_KG,
  facts AS REGISTROS, products AS NCMS, countries AS PAISES
FROM (SELECT CAST(sum(VL_FOB) AS DOUBLE) AS fob, CAST(sum(KG_LIQUIDO) AS DOUBLE) AS kg, CAST(sum(QT_ESTAT) AS DOUBLE) AS qt,
             count(*) AS facts, count(DISTINCT CO_NCM) AS products, count(DISTINCT CO_PAIS) AS countries
      FROM star WHERE {where}) whole"""
_SUMMARY_DOUBLES = ("VL_FOB", "KG_LIQUIDO", "QT_ESTAT", "FOB_POR_KG")
for _name, _state, _where in (
    ("all_years", FilterState(flow="EXP"), "FLUXO = 'EXP'"),
    ("year", EXPORTS_1998, "FLUXO = 'EXP' AND CO_ANO = 1998"),
    ("narrow", NARROW, _NARROW_SQL),
    ("nothing", FilterState(flow="EXP", year=1901), "FLUXO = 'EXP' AND CO_ANO = 1901"),
):
    register(
        f"q4_summary_{_name}",
        lambda d, s=_state: summary_metrics(d.tables, s),
        _SUMMARY.format(where=_where),
        ("star",),
        _SUMMARY_DOUBLES,
    )

# --- Q5: breakdown by hierarchy level ----------------------------------------
# Shares are taken of a separate total over the selection.
_BREAKDOWN = """SELECT g.code AS CODIGO, g.label AS DESCRICAO, g.kg AS KG_LIQUIDO, g.fob AS VL_FOB, g.qt AS QT_ESTAT,
  IF(g.kg > 0, g.fob / g.kg, NULL) AS FOB_POR_KG, IF(whole.fob > 0, g.fob / whole.fob, NULL) AS PARTICIPACAO_FOB
FROM (SELECT {code} AS code, ifnull(ifnull({label}, {code}), 'Não classificado') AS label,
             CAST(sum(KG_LIQUIDO) AS DOUBLE) AS kg, CAST(sum(VL_FOB) AS DOUBLE) AS fob, CAST(sum(QT_ESTAT) AS DOUBLE) AS qt
      FROM star WHERE {where} GROUP BY ALL) g,
     (SELECT CAST(sum(VL_FOB) AS DOUBLE) AS fob FROM star WHERE {where}) whole
ORDER BY g.fob DESC NULLS LAST, g.code NULLS FIRST, g.label LIMIT 500"""
_BREAKDOWN_DOUBLES = ("KG_LIQUIDO", "VL_FOB", "QT_ESTAT", "FOB_POR_KG", "PARTICIPACAO_FOB")
for _title, _level in HIERARCHY.items():
    register(
        f"q5_breakdown_{_title.lower().replace(' ', '_')}",
        lambda d, t=_title: hierarchy_table(d.tables, EXPORTS_1998, t),
        _BREAKDOWN.format(code=_level.code, label=_level.label, where="FLUXO = 'EXP' AND CO_ANO = 1998"),
        ("star",),
        _BREAKDOWN_DOUBLES,
    )
register(
    "q5_breakdown_sh4_narrow",
    lambda d: hierarchy_table(d.tables, NARROW, "SH4"),
    _BREAKDOWN.format(code="CO_SH4", label="NO_SH4_POR", where=_NARROW_SQL),
    ("star",),
    _BREAKDOWN_DOUBLES,
)

# --- Q6, Q23, Q25, Q26: balance ----------------------------------------------
_BALANCE = """WITH sides AS (
  SELECT CO_PAIS, PAIS,
         CAST(coalesce(sum(VL_FOB) FILTER (FLUXO = 'EXP'), 0) AS DOUBLE) AS sold,
         CAST(coalesce(sum(VL_FOB) FILTER (FLUXO = 'IMP'), 0) AS DOUBLE) AS bought
  FROM star WHERE CO_ANO = 1998 GROUP BY ALL),
balanco AS (
  SELECT CO_PAIS, PAIS, sold AS EXPORTACOES, bought AS IMPORTACOES, sold - bought AS SALDO,
         sold + bought AS CORRENTE_COMERCIO,
         ['Déficit', 'Zerado', 'Superávit'][CAST(sign(sold - bought) AS INT) + 2] AS SITUACAO
  FROM sides WHERE NOT (sold = 0 AND bought = 0))
"""
_BALANCE_DOUBLES = ("EXPORTACOES", "IMPORTACOES", "SALDO", "CORRENTE_COMERCIO")


def _balance(d):
    return trade_balance_by_country(d.tables, EXPORTS_1998)


register("q6_trade_balance", _balance, _BALANCE + "SELECT * FROM balanco", ("star",), _BALANCE_DOUBLES)
register(
    "q23_balance_totals",
    lambda d: balance_totals(_balance(d)),
    _BALANCE
    + """SELECT *, CASE WHEN SALDO > 0 THEN 'Superávit' WHEN SALDO < 0 THEN 'Déficit' ELSE 'Zerado' END AS SITUACAO
FROM (SELECT sum(EXPORTACOES) AS EXPORTACOES, sum(IMPORTACOES) AS IMPORTACOES,
             sum(EXPORTACOES) - sum(IMPORTACOES) AS SALDO,
             sum(EXPORTACOES) + sum(IMPORTACOES) AS CORRENTE_COMERCIO FROM balanco) t""",
    ("star",),
    _BALANCE_DOUBLES,
)
register(
    "q25_balance_extremes",
    lambda d: balance_extremes(_balance(d), 4),
    _BALANCE
    + """SELECT * FROM (SELECT * FROM balanco WHERE SALDO < 0 ORDER BY SALDO, CO_PAIS LIMIT 4)
UNION SELECT * FROM (SELECT * FROM balanco WHERE SALDO > 0 ORDER BY SALDO DESC, CO_PAIS LIMIT 4)""",
    ("star",),
    _BALANCE_DOUBLES,
)
register(
    "q26_balance_status_counts",
    lambda d: balance_status_counts(_balance(d)),
    _BALANCE
    + """SELECT s.ORDEM, s.SITUACAO, count(b.CO_PAIS) AS PAISES
FROM (VALUES (1, 'Superávit'), (2, 'Déficit'), (3, 'Zerado')) s(ORDEM, SITUACAO)
LEFT JOIN balanco b ON b.SITUACAO = s.SITUACAO GROUP BY s.ORDEM, s.SITUACAO""",
    ("star",),
)
register(
    "q22_deficits_by_size",
    lambda d: select_result(
        _balance(d), where=F.col("SITUACAO") == "Déficit", order_by="SALDO", descending=False,
        tiebreak=("CO_PAIS",),
    ).withColumn("SITUACAO", balance_status_label(F.col("SITUACAO"))),
    _BALANCE + "SELECT * REPLACE ('▼ Déficit' AS SITUACAO) FROM balanco WHERE SITUACAO = 'Déficit'",
    ("star",),
    _BALANCE_DOUBLES,
)

for _name, _column, _descending in (
    ("largest_surplus", "SALDO", True),
    ("largest_trade_flow", "CORRENTE_COMERCIO", True),
    ("first_country_by_name", "PAIS", False),
):
    register(
        f"q22_balance_{_name}",
        lambda d, c=_column, down=_descending: select_result(
            _balance(d), order_by=c, descending=down, tiebreak=("CO_PAIS",), n=3
        ).withColumnsRenamed({"EXPORTACOES": "EXPORTAÇÕES", "IMPORTACOES": "IMPORTAÇÕES"}).drop("CO_PAIS"),
        _BALANCE
        + f"""SELECT PAIS, EXPORTACOES AS "EXPORTAÇÕES", IMPORTACOES AS "IMPORTAÇÕES", SALDO, CORRENTE_COMERCIO, SITUACAO
FROM balanco ORDER BY {_column} {"DESC" if _descending else ""} NULLS LAST, CO_PAIS LIMIT 3""",
        ("star",),
        ('"EXPORTAÇÕES"', '"IMPORTAÇÕES"', "SALDO", "CORRENTE_COMERCIO"),
    )

# --- Q12-Q14: months ---------------------------------------------------------
_MONTH_VALUES = {
    "fob": ("VL_FOB", False, "CAST(sum(VL_FOB) AS DOUBLE)"),
    "kg": ("KG_LIQUIDO", False, "CAST(sum(KG_LIQUIDO) AS DOUBLE)"),
    "fob_per_day": (
        "VL_FOB",
        True,
        "CASE WHEN max(DIAS_UTEIS) > 0 THEN CAST(sum(VL_FOB) AS DOUBLE) / max(DIAS_UTEIS) END",
    ),
    "price": (
        "FOB_POR_KG",
        True,
        "CASE WHEN sum(KG_LIQUIDO) > 0 THEN CAST(sum(VL_FOB) AS DOUBLE) / CAST(sum(KG_LIQUIDO) AS DOUBLE) END",
    ),
}
_HISTORY = """SELECT CO_ANO AS ANO, CO_MES AS MES, {value} AS VALOR, max(DIAS_UTEIS) AS DIAS_UTEIS
FROM star WHERE FLUXO = 'IMP' AND CO_ANO BETWEEN 1996 AND 2001 GROUP BY CO_ANO, CO_MES"""
IMPORTS_2001 = FilterState(flow="IMP", year=2001)


def _history(d, key, state=IMPORTS_2001):
    metric, daily, _ = _MONTH_VALUES[key]
    return monthly_history(d.tables, state, metric, daily)


_PROFILE = """WITH historia AS ({history}),
atual AS (SELECT MES, VALOR AS ATUAL FROM historia WHERE ANO = 2001),
anterior AS (SELECT MES, VALOR AS ANTERIOR FROM historia WHERE ANO = 2000),
banda AS (SELECT MES, min(VALOR) AS MIN_5A, max(VALOR) AS MAX_5A, avg(VALOR) AS MEDIA_5A,
                 count(DISTINCT ANO) AS N_ANOS_BANDA FROM historia WHERE ANO < 2001 GROUP BY MES),
perfil AS (
SELECT g.MES, ATUAL, ANTERIOR, MIN_5A, MAX_5A, MEDIA_5A, N_ANOS_BANDA,
  (ATUAL - ANTERIOR) / nullif(ANTERIOR, 0) AS VAR_1A,
  (ATUAL - MEDIA_5A) / nullif(MEDIA_5A, 0) AS DESVIO_MEDIA_5A,
  ['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][g.MES] AS MES_LABEL
FROM (SELECT CAST(unnest({months}) AS INT) AS MES) g
LEFT JOIN atual ON g.MES = atual.MES LEFT JOIN anterior ON g.MES = anterior.MES
LEFT JOIN banda ON g.MES = banda.MES)
"""
_PROFILE_DOUBLES = ("ATUAL", "ANTERIOR", "MIN_5A", "MAX_5A", "MEDIA_5A", "VAR_1A", "DESVIO_MEDIA_5A")
for _key, (_metric, _daily, _value) in _MONTH_VALUES.items():
    register(
        f"q12_monthly_history_{_key}",
        lambda d, k=_key: _history(d, k),
        _HISTORY.format(value=_value),
        ("star",),
        ("VALOR",),
    )
    register(
        f"q13_monthly_profile_{_key}",
        lambda d, k=_key: monthly_profile(_history(d, k), 2001),
        _PROFILE.format(history=_HISTORY.format(value=_value), months="range(1, 13)") + "SELECT * FROM perfil",
        ("star",),
        _PROFILE_DOUBLES,
    )
    _level = "avg" if _metric == "FOB_POR_KG" else "sum"
    register(
        f"q14_monthly_headline_{_key}",
        lambda d, k=_key, m=_metric: monthly_headline(monthly_profile(_history(d, k), 2001), m),
        _PROFILE.format(history=_HISTORY.format(value=_value), months="range(1, 13)")
        + f"""SELECT a AS VALOR_ATUAL, p AS VALOR_ANTERIOR, (a - p) / nullif(p, 0) AS VAR_ANUAL,
  m AS MES_PICO, v AS VALOR_PICO,
  ['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][m] AS MES_PICO_LABEL
FROM (SELECT {_level}(ATUAL) AS a, {_level}(ANTERIOR) AS p, arg_max(MES, ATUAL) AS m, max(ATUAL) AS v FROM perfil) t""",
        ("star",),
        ("VALOR_ATUAL", "VALOR_ANTERIOR", "VAR_ANUAL", "VALOR_PICO"),
    )
register(
    "q12_years_present",
    lambda d: history_years_present(_history(d, "fob"), 2001),
    "SELECT DISTINCT CO_ANO AS ANO FROM star WHERE FLUXO = 'IMP' AND CO_ANO BETWEEN 1996 AND 2000",
    ("star",),
)
register(
    "q13_monthly_profile_selected_months",
    lambda d: monthly_profile(
        _history(d, "fob", FilterState(flow="IMP", year=2001, months=(12, 2, 11))), 2001, (12, 2, 11)
    ),
    _PROFILE.format(
        history=_HISTORY.format(value="CAST(sum(VL_FOB) AS DOUBLE)").replace(
            "GROUP BY", "AND CO_MES IN (12, 2, 11) GROUP BY"
        ),
        months="[12, 2, 11]",
    )
    + "SELECT * FROM perfil",
    ("star",),
    _PROFILE_DOUBLES,
)
register(
    "q22_months_with_change",
    lambda d: select_result(
        monthly_profile(_history(d, "fob"), 2001), where=F.col("VAR_1A").isNotNull(), order_by="MES",
        descending=False,
    ),
    _PROFILE.format(history=_HISTORY.format(value="CAST(sum(VL_FOB) AS DOUBLE)"), months="range(1, 13)")
    + "SELECT * FROM perfil WHERE VAR_1A IS NOT NULL",
    ("star",),
    _PROFILE_DOUBLES,
)

# --- Q15, Q16: countries ------------------------------------------------------
_RANKING = """WITH by_country AS (
  SELECT CO_PAIS, any_value(PAIS) AS PAIS,
         CAST(sum(ifnull({metric}, 0)) FILTER (CO_ANO = {year}) AS DOUBLE) AS now,
         CAST(sum(ifnull({metric}, 0)) FILTER (CO_ANO = {year} - 1) AS DOUBLE) AS one,
         CAST(sum(ifnull({metric}, 0)) FILTER (CO_ANO = {year} - 2) AS DOUBLE) AS two
  FROM star WHERE FLUXO = '{flow}' AND CO_ANO >= {year} - 2 AND CO_ANO <= {year} AND CO_PAIS IS NOT NULL {more}
  GROUP BY CO_PAIS)
SELECT CO_PAIS, PAIS, now AS VALOR, IF(sum(now) OVER () > 0, now / sum(now) OVER (), NULL) AS PARTICIPACAO,
  (now - one) / nullif(one, 0) AS VAR_1A, (now - two) / nullif(two, 0) AS VAR_2A
FROM by_country ORDER BY now DESC NULLS LAST, CO_PAIS LIMIT {n}"""
_RANKING_DOUBLES = ("VALOR", "PARTICIPACAO", "VAR_1A", "VAR_2A")
for _name, _state, _metric, _n, _more in (
    ("fob", EXPORTS_1998, "VL_FOB", 15, ""),
    ("kg", FilterState(flow="IMP", year=1995), "KG_LIQUIDO", 250, ""),
    # So few products that some countries occur only in earlier years.
    (
        "sparse",
        FilterState(flow="EXP", year=1998, sh2=("10",), months=(1, 2)),
        "VL_FOB",
        250,
        "AND CO_SH2 = '10' AND CO_MES IN (1, 2)",
    ),
):
    register(
        f"q15_country_ranking_{_name}",
        lambda d, s=_state, m=_metric, n=_n: country_ranking(d.tables, s, m, n),
        _RANKING.format(metric=_metric, flow=_state.flow, year=_state.year, n=_n, more=_more),
        ("star",),
        _RANKING_DOUBLES,
    )
register(
    "q22_one_country_of_ranking",
    lambda d: select_result(
        country_ranking(d.tables, EXPORTS_1998, "VL_FOB", 250), where=F.col("CO_PAIS") == "003",
        order_by="VALOR", tiebreak=("CO_PAIS",), n=1,
    ),
    "SELECT * FROM ("
    + _RANKING.format(metric="VL_FOB", flow="EXP", year=1998, n=250, more="")
    + ") r WHERE CO_PAIS = '003'",
    ("star",),
    _RANKING_DOUBLES,
)
_COMPOSITION = """SELECT g.code AS CODIGO, g.label AS DESCRICAO, g.fob AS VL_FOB, g.kg / 1000 AS TONELADAS,
  g.products AS NCMS, g.fob / nullif(whole.fob, 0) AS PARTICIPACAO
FROM (SELECT ifnull({code}, 'Não classificado') AS code, ifnull(ifnull({label}, {code}), 'Não classificado') AS label,
             CAST(sum(VL_FOB) AS DOUBLE) AS fob, CAST(sum(KG_LIQUIDO) AS DOUBLE) AS kg, count(DISTINCT CO_NCM) AS products
      FROM star WHERE FLUXO = 'EXP' AND CO_ANO = 1998 AND CO_PAIS = '003' GROUP BY ALL) g,
     (SELECT CAST(sum(VL_FOB) AS DOUBLE) AS fob FROM star WHERE FLUXO = 'EXP' AND CO_ANO = 1998 AND CO_PAIS = '003') whole
ORDER BY g.fob DESC NULLS LAST, g.code, g.label LIMIT 100"""
for _level, _code, _label in (
    ("SETOR", "SETOR", "SETOR"),
    ("CATEGORIA_USO", "CATEGORIA_USO", "CATEGORIA_USO"),
    ("NCM", "CO_NCM", "NO_NCM_POR"),
):
    register(
        f"q16_composition_{_level.lower()}",
        lambda d, v=_level: country_composition(d.tables, EXPORTS_1998, "003", v),
        _COMPOSITION.format(code=_code, label=_label),
        ("star",),
        ("VL_FOB", "TONELADAS", "PARTICIPACAO"),
    )

# --- Q17, Q18: quality ---------------------------------------------------------
_INDICATORS = (
    ("NCM sem classificação", "SETOR = 'Não classificado'"),
    ("País sem descrição", "PAIS = 'País não identificado'"),
    ("Registros sem dias úteis", "DIAS_UTEIS IS NULL OR DIAS_UTEIS <= 0"),
    ("Registros SH2 sem descrição", "CO_SH2 IS NOT NULL AND NO_SH2_POR IS NULL"),
    ("Registros SH4 sem descrição", "CO_SH4 IS NOT NULL AND NO_SH4_POR IS NULL"),
    ("Registros SH6 sem descrição", "CO_SH6 IS NOT NULL AND NO_SH6_POR IS NULL"),
)
QUALITY = (
    "WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n, "
    + ", ".join(f"CAST(count_if({test}) AS DOUBLE) AS c{i}" for i, (_, test) in enumerate(_INDICATORS))
    + " FROM star)\nSELECT 'Registros na fato' AS INDICADOR, n AS VALOR, CAST(NULL AS DOUBLE) AS PERCENTUAL FROM c\n"
    + "\n".join(
        f"UNION ALL SELECT '{name}', c{i}, c{i} / n FROM c" for i, (name, _) in enumerate(_INDICATORS)
    )
    + "\nUNION ALL SELECT 'Arquivos processados', CAST(count(*) AS DOUBLE), NULL FROM loads"
)
register("q17_quality_report", lambda d: quality_report(d.tables), QUALITY, ("star", "loads"), ("VALOR", "PERCENTUAL"))
register(
    "q18_load_log",
    lambda d: load_log(d.tables.loads),
    """SELECT flow AS FLUXO, source_file AS ARQUIVO, rows_loaded AS LINHAS, loaded_at AS CARREGADO_EM FROM loads""",
    ("loads",),
)

# --- Q28, Q41 and the labels around a breakdown --------------------------------
register(
    "q28_largest_products",
    lambda d: largest(hierarchy_table(d.tables, EXPORTS_1998, "NCM"), "VL_FOB", 15, "CODIGO").select(
        chart_label(F.col("DESCRICAO"), F.col("CODIGO")).alias("ROTULO"),
        "VL_FOB",
        tonnes("KG_LIQUIDO").alias("TONELADAS"),
    ),
    "SELECT concat(substr(DESCRICAO, 1, 58), ' · ', CODIGO) AS ROTULO, VL_FOB, CAST(KG_LIQUIDO AS DOUBLE) / 1000 AS TONELADAS FROM ("
    + _BREAKDOWN.format(code="CO_NCM", label="NO_NCM_POR", where="FLUXO = 'EXP' AND CO_ANO = 1998")
    + ") b WHERE VL_FOB IS NOT NULL ORDER BY b.VL_FOB DESC, CODIGO LIMIT 15",
    ("star",),
    ("VL_FOB", "TONELADAS"),
)
for _title in ("Setor", "SH2", "SH6"):
    _level = HIERARCHY[_title]
    register(
        f"n18_classification_label_{_title.lower()}",
        lambda d, t=_title: hierarchy_table(d.tables, IMPORTS_1999, t).select(
            "CODIGO", classification_label(t, F.col("CODIGO"), F.col("DESCRICAO")).alias("CLASSIFICACAO")
        ),
        f"""SELECT CODIGO, {"DESCRICAO" if _title == "Setor" else f'''CASE WHEN coalesce(DESCRICAO, '') IN ('', coalesce(CODIGO, ''))
  THEN '{_title} ' || coalesce(CODIGO, '') || ' — descrição não localizada'
  ELSE trim(DESCRICAO) || ' ({_title} ' || coalesce(CODIGO, '') || ')' END'''} AS CLASSIFICACAO FROM ("""
        + _BREAKDOWN.format(
            code=_level.code, label=_level.label, where="FLUXO = 'IMP' AND CO_ANO = 1999"
        )
        + ") b",
        ("star",),
    )
register(
    "q41_detail_products",
    lambda d: classification_detail(d.tables, EXPORTS_1998, "SH2", "10")[0],
    _BREAKDOWN.format(
        code="CO_NCM", label="NO_NCM_POR", where="FLUXO = 'EXP' AND CO_ANO = 1998 AND CO_SH2 = '10'"
    ),
    ("star",),
    _BREAKDOWN_DOUBLES,
)
register(
    "q41_detail_countries",
    lambda d: classification_detail(d.tables, EXPORTS_1998, "SH2", "10")[1],
    _RANKING.format(metric="VL_FOB", flow="EXP", year=1998, n=25, more="AND CO_SH2 = '10'"),
    ("star",),
    _RANKING_DOUBLES,
)
register(
    "q41_detail_of_missing_code",
    lambda d: classification_detail(d.tables, EXPORTS_1998, "SH2", None)[0],
    _BREAKDOWN.format(
        code="CO_NCM", label="NO_NCM_POR", where="FLUXO = 'EXP' AND CO_ANO = 1998 AND CO_SH2 IS NULL"
    ),
    ("star",),
    _BREAKDOWN_DOUBLES,
)
