"""Cleaning and classification of raw customs text.

All rules are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.model import UNCLASSIFIED, UNINFORMED_STATE

# Numbers are matched before they are cast: a failing cast costs an exception per
# value, Spark's parser takes Java suffixes ("1d"), and it rejects "1.5" as an integer.
# Casts ignore outer blanks, so the patterns allow them and nothing is trimmed first.
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?\d+)?"
# A whole number with the ".0" that a spreadsheet adds to it.
_WHOLE_WITH_ZEROS = r"^\s*[+-]?(\d+)\.0+\s*$"

# --- fixed values -----------------------------------------------------------
BUSINESS_DAY_WORDS = ("1", "sim", "s", "true", "verdadeiro", "util", "útil")
DAY_OFF_WORDS = ("0", "nao", "não", "n", "false", "falso", "inutil", "não útil")
CODE_WIDTHS = {
    "CO_NCM": 8, "CO_SH6": 6, "CO_SH4": 4, "CO_SH2": 2,
    "CO_PAIS": 3, "CO_UNID": 2, "CO_VIA": 2, "CO_URF": 7,
}
# --- end of fixed values ----------------------------------------------------


def _without_separators(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(""))


def parse_integer(text: Column) -> Column:
    """Year or month text to INT; decimals round, anything unreadable is NULL.

    Whole numbers, as nearly all are, are cast at once; only the rest meets a pattern. Hexadecimal
    (0x) and binary (0b) spellings are read as well.
    """
    rounded = F.round(_without_separators(text).try_cast("double"))
    # Any number of digits; conv() stops at 64 bits, which no year or month reaches.
    digits = F.substring(F.trim(text), 3, 2**31 - 1)
    other = (
        F.when(text.rlike(rf"^\s*{_NUMBER}\s*$"), rounded.try_cast("int"))
        .when(text.rlike(r"^ *0[xX][0-9a-fA-F]+ *$"), F.conv(digits, 16, 10).try_cast("int"))
        .when(text.rlike(r"^ *0[bB][01]+ *$"), F.conv(digits, 2, 10).try_cast("int"))
    )
    return F.coalesce(text.try_cast("int"), other)


def plain_numbers(*texts: Column) -> Column:
    """Whether all of ``texts`` are digits with one decimal mark at most, empty or NULL."""
    return F.concat_ws(";", *texts).rlike(r"^(?:(?:\d++(?:[.,]\d*+)?)?+(?:;|$))*+$")


def parse_measure(text: Column, plain: Column | None = None) -> Column:
    """Measure text to DOUBLE, with a comma or a dot as the decimal mark.

    "NaN" becomes NULL like all text that is no number: NaN would poison sums. Where ``plain``
    holds, the text is cast without being matched by itself; see ``plain_numbers``.
    """
    dotted = F.replace(text, F.lit(","), F.lit("."))
    number = dotted.rlike(rf"^\s*(?:{_NUMBER}|[+-]?(?i:inf(?:inity)?))\s*$")
    if plain is not None:
        number = plain | number
    return F.when(number, _without_separators(dotted).try_cast("double"))


def pad_code(text: Column, width: int) -> Column:
    """Fact codes: trimmed, left-padded with zeros, cut at ``width``."""
    return F.lpad(F.trim(text), width, "0")


def state_code(text: Column) -> Column:
    return F.upper(F.trim(text))


def state_or_default(code: Column) -> Column:
    """The exporting state, with blanks and NULLs gathered under one name."""
    trimmed = F.trim(code)
    return F.when(trimmed != "", trimmed).otherwise(UNINFORMED_STATE)


def normalize_code(value: Column, width: int) -> Column:
    """Dimension codes as spreadsheets deliver them: "123.0" is 123, only digits
    count, shorter codes are zero-padded and longer ones stay whole.

    Text without a digit, such as "nan" or "<NA>", is no code.
    """
    text = F.trim(value.cast("string"))
    whole = F.when(text.rlike(_WHOLE_WITH_ZEROS), F.regexp_extract(text, _WHOLE_WITH_ZEROS, 1))
    digits = F.coalesce(whole, F.regexp_replace(text, r"\D", ""))
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
    return F.when(text.rlike(r"\d"), padded)


def business_day(value: Column) -> Column:
    """1 for a business day, 0 for a day off, NULL when the text says neither."""
    word = F.lower(F.trim(value.cast("string"), F.lit(" \t\r\n")))
    return F.when(word.isin(*BUSINESS_DAY_WORDS), 1).when(word.isin(*DAY_OFF_WORDS), 0)


def business_day_number(value: Column) -> Column:
    """The same for a column that is numeric already: positive means business day."""
    return F.when(value.isNotNull(), (value.cast("double") > 0).cast("int"))


def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one ASCII letter or sign, these, and those that give several."""
    marked, plain, several = [], [], {}
    for point in range(0x0080, 0x20000):
        base = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode().lower()
        if len(base) == 1:
            marked.append(chr(point))
            plain.append(base)
        elif base:
            several[chr(point)] = base
    return "".join(marked), "".join(plain), several


_MARKED, _PLAIN, _SEVERAL = _accent_tables()
_PAIRS = "\x01".join(f"{c}\x02{base}" for c, base in _SEVERAL.items())
_ANY_OF_SEVERAL = f"[{''.join(_SEVERAL)}]"


def fold(text: Column) -> Column:
    """Lower case without accents, runs of blanks collapsed; other characters above ASCII go."""
    single = F.translate(text, _MARKED, _PLAIN)
    table = F.str_to_map(F.lit(_PAIRS), F.lit("\x01"), F.lit("\x02"))
    letters = F.transform(F.split(single, ""), lambda c: F.coalesce(F.element_at(table, c), c))
    spelled = F.when(single.rlike(_ANY_OF_SEVERAL), F.array_join(letters, "")).otherwise(single)
    ascii_text = F.regexp_replace(F.lower(spelled), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(ascii_text, r"\s+", " "))


def _mentions(text: Column, words: Iterable[str]) -> Column:
    return F.coalesce(text.rlike("|".join(words)), F.lit(False))


def macro_sector(isic_code: Column, isic_name: Column) -> Column:
    """Macro sector of an ISIC section; the first rule that applies wins."""
    code = F.upper(F.trim(isic_code.cast("string")))
    name = fold(isic_name)
    # Sector names and the words that point at them.
    return (
        F.when(code.eqNullSafe("A") | _mentions(name, ("agricultura", "agropec", "pesca", "aquicultura")),
               "Agropecuária")
        .when(code.eqNullSafe("B") | _mentions(name, ("extrativ",)), "Indústria Extrativa")
        .when(code.eqNullSafe("C") | _mentions(name, ("transforma",)), "Indústria de Transformação")
        .otherwise("Outros Produtos")
    )


def use_category(category_code: Column, category_name: Column) -> Column:
    """Use category of a broad economic class, by its name and else by its code."""
    name = fold(category_name)
    # Category names and the words that point at them.
    return (
        F.when(_mentions(name, ("capital",)), "Bens de Capital")
        .when(_mentions(name, ("intermed",)), "Bens Intermediários")
        .when(_mentions(name, ("consumo",)), "Bens de Consumo")
        .when(_mentions(name, ("combust", "lubrificant")), "Combustíveis e Lubrificantes")
        .when(F.length(name) > 0, F.trim(category_name, F.lit(" \t\r\n")))
        .when(category_code.isNotNull(), F.concat(F.lit("Categoria "), F.trim(category_code.cast("string"))))
        .otherwise(UNCLASSIFIED)
    )


def collapse_blanks(text: Column) -> Column:
    """Cell text on one line: blanks collapsed, ends trimmed, NULL as ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def normalize_header(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().upper())


def normalize_columns(frame: DataFrame) -> DataFrame:
    """The frame with its column names in the normalised spelling."""
    return frame.toDF(*(normalize_header(name) for name in frame.columns))


def as_constant(value: str | None, data_type: str = "string") -> Column:
    """A literal of a stated type; ``None`` gives a typed NULL column."""
    return F.lit(value).cast(data_type)
