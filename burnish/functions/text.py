"""Column expressions for text cells: strip, snake_case, missing tests, priorities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 29 code points that count as whitespace.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

# Cells a delimited file may use for "missing" (exact, case-sensitive).
FILE_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Configurable missing tokens (compared stripped and lower-cased).
CONFIG_NULL_TOKENS = (
    "n/a", "na", "null", "none", "-", "--", "", "n.a.", "nil", "missing", "not available",
    "not provided", "blank", "#n/a", "nan", "tbd",
)

# Cells the fill action replaces by FILL_VALUE (stripped and lower-cased).
PLACEHOLDERS = ("", "null", "na", "n/a", "-", "unknown")
FILL_VALUE = "N/A"


def leading_whitespace(text: Column) -> Column:
    """The first character is whitespace."""
    return (text != "") & F.lit(WHITESPACE).contains(F.substring(text, 1, 1))


def edge_whitespace(text: Column, edge: str = "both") -> Column:
    """The cell starts (or, for edge='both', ends) with whitespace.

    Looks at the first and last character only, so long texts cost nothing extra.
    """
    if edge == "leading":
        return leading_whitespace(text)
    if edge != "both":
        raise ValueError("edge must be 'both' or 'leading'")
    last = F.lit(WHITESPACE).contains(F.substring(text, -1, 1))
    return leading_whitespace(text) | ((text != "") & last)


def strip(text: Column) -> Column:
    """Unicode strip. ``trim`` alone removes only U+0020."""
    return F.btrim(text, F.lit(WHITESPACE))


def normal_form(text: Column) -> Column:
    """Stripped and lower-cased: equal for values that differ in casing or outer spacing only."""
    return F.lower(strip(text))


def snake_case(text: Column) -> Column:
    """Lower-case words joined by single underscores."""
    words = F.regexp_replace(strip(text), "[^0-9a-zA-Z]+", "_")
    return F.lower(F.btrim(words, F.lit("_")))


def is_missing(column: Column, data_type: T.DataType) -> Column:
    """Null, or NaN for floating point columns."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def nan_to_null(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def null_tokens_to_null(text: Column, tokens=FILE_NULL_TOKENS, folded: bool = False) -> Column:
    """Null for a missing token; ``folded`` compares stripped and lower-cased text."""
    compared = normal_form(text) if folded else text
    return F.when(~compared.isin(*tokens), text)


def filled(text: Column, fill: str = FILL_VALUE, placeholders=PLACEHOLDERS) -> Column:
    """``fill`` for null, blank and placeholder cells; other cells as they are."""
    return F.when(text.isNull() | normal_form(text).isin(*placeholders), fill).otherwise(text)


def priority_from_ratio(ratio: Column, medium: float, high: float) -> Column:
    return F.when(ratio >= high, "High").when(ratio >= medium, "Medium").otherwise("Low")


def percent_text(ratio: Column) -> Column:
    """0.0625 -> '6.2%', ties to even."""
    return F.format_string("%.1f%%", F.bround(ratio * 100, 1))


def snake_case_name(name: str) -> str:
    """``snake_case`` for one column name held by the driver."""
    return re.sub("[^0-9a-zA-Z]+", "_", name.strip(WHITESPACE)).strip("_").lower()


def header_issue(name: str) -> bool:
    """The name is not snake_case. Outer spaces alone are not an issue."""
    return snake_case_name(name) != name.strip(WHITESPACE)
