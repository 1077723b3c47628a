"""Result tables as CSV for spreadsheets in a comma-decimal locale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)


def with_decimal_comma(frame: DataFrame) -> DataFrame:
    """Fractional columns as text with a decimal comma, all their digits kept.

    Numbers from 10^28 up and below 10^-20 keep an exponent, which spreadsheets read.
    """
    texts = {}
    for f in frame.schema:
        if isinstance(f.dataType, _FRACTIONAL):
            value, size = F.col(f.name), F.abs(F.col(f.name))
            # Java writes an exponent outside 10^-3 to 10^7; a wide enough decimal does not.
            plain = (
                F.when((size >= 1e7) & (size < 1e28), value.try_cast("decimal(38,10)").cast("string"))
                .when((size > 1e-20) & (size < 1e-3), value.try_cast("decimal(38,37)").cast("string"))
                .otherwise(value.cast("string"))
            )
            texts[f.name] = F.translate(F.regexp_replace(plain, r"(\.\d+?)0+$", "$1"), ".", ",")
    return frame.withColumns(texts)


BYTE_ORDER_MARK = "\ufeff"


def write_csv(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """";"-separated UTF-8 with a header, as a folder of part files.

    Every part begins with a byte-order mark, so spreadsheets read its accents; the mark stands
    before the first column's name. A result without rows is one part with the header alone.
    """
    texts = with_decimal_comma(frame)
    first, *others = texts.columns
    marked = texts.select(F.col(first).alias(BYTE_ORDER_MARK + first), *others)
    (
        marked.write.mode(mode)
        .options(sep=";", header=True, escape='"', emptyValue="")
        .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )
