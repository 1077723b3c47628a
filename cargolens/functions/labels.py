"""Readable texts derived from codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolens.model import (
    BALANCED,
    DEFICIT,
    MONTH_ABBREVIATIONS,
    SCOPE_TRANSLATIONS,
    STATE_NAMES,
    STATUS_SHORT_LABELS,
    SURPLUS,
    UNCLASSIFIED,
)


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a fixed mapping, NULL for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*mapping.items())]), key)


def month_label(month: Column) -> Column:
    return lookup({i: name for i, name in enumerate(MONTH_ABBREVIATIONS, start=1)}, month)


def month_year_label(date: Column) -> Column:
    return F.concat_ws("/", month_label(F.month(date)), F.year(date).cast("string"))


def state_label(code: Column) -> Column:
    """"Name (UF)" for a known state, the code itself otherwise."""
    return F.coalesce(F.concat(lookup(STATE_NAMES, code), F.lit(" ("), code, F.lit(")")), code)


def status_label(status: Column) -> Column:
    return lookup(STATUS_SHORT_LABELS, status)


def balance_status(balance: Column) -> Column:
    return F.when(balance > 0, SURPLUS).when(balance < 0, DEFICIT).otherwise(BALANCED)


def balance_status_label(status: Column) -> Column:
    # The marks shown before a balance status.
    marks = {SURPLUS: "▲ Superávit", DEFICIT: "▼ Déficit", BALANCED: "● Zerado"}
    return lookup(marks, status)


def classification_label(level: str, code: Column, description: Column) -> Column:
    """How a hierarchy row is called at ``level``."""
    code_text = F.coalesce(code, F.lit(""))
    text = F.trim(F.coalesce(description, F.lit("")), F.lit(" \t\r\n"))
    if level in ("Setor", "Categoria de uso"):
        return F.coalesce(F.nullif(text, F.lit("")), F.nullif(code_text, F.lit("")), F.lit(UNCLASSIFIED))
    missing = (text == "") | (text == code_text)
    return F.when(
        missing, F.concat(F.lit(f"{level} "), code_text, F.lit(" — descrição não localizada"))
    ).otherwise(F.concat(text, F.lit(f" ({level} "), code_text, F.lit(")")))


def chart_label(description: Column, code: Column, length: int = 58) -> Column:
    return F.concat(F.substring(description, 1, length), F.lit(" · "), code)


def translate_scope(scopes: Column) -> Column:
    """A "|"-joined scope list in plain words; unknown scopes stay as they are."""
    parts = F.filter(F.transform(F.split(scopes, r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    named = F.transform(parts, lambda s: F.coalesce(lookup(SCOPE_TRANSLATIONS, s), s))
    return F.coalesce(F.array_join(named, " | "), F.lit(""))


def yes_no(condition: Column) -> Column:
    return F.when(condition, "Sim").otherwise("Não")
