"""Cell normalizers: dates, percentages, phone numbers. Unreadable cells are kept as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.functions.text import strip

# Output formats.
DATE_FORMAT = "yyyy-MM-dd"
DATETIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"

# Dates have few words, so long texts fail this early.
_FEW_WORDS = r"^[\w:./-]+([\s,]+[\w:./-]+){0,4}[\s,]*$"

# Every shape below contains one of these; a single search spares other cells the rest.
_PLAUSIBLE = r"(?i)\d[-/.]\d{1,2}[-/.]\d|[a-z]{3}\s+\d|\d(st|nd|rd|th)?,?\s+[a-z]{3}"

# Shape of the text, then the pattern that reads it. A shape test first keeps one parse per cell.
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
)
DATETIME_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
)


def _readable(text: Column) -> Column:
    """Stripped, inner spaces single, without commas and ordinal endings ('Feb 3rd, 2023')."""
    plain = F.regexp_replace(strip(text), r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    plain = F.regexp_replace(plain, ",", " ")
    return F.regexp_replace(plain, r"\s+", " ")


def _first_match(text: Column, shapes, output: str) -> Column:
    result = F
    for shape, pattern in shapes:
        day = F.try_to_timestamp(text, F.lit(pattern))
        result = result.when(text.rlike(shape), F.date_format(day, output))
    return result.otherwise(F.lit(None).cast("string"))


def parse_date_text(text: Column, day_first: bool = False) -> Column:
    """ISO text of a date or datetime cell, null if it is neither.

    '01/02/2023' is January 2nd unless ``day_first``.
    """
    dates, times = DATE_SHAPES, DATETIME_SHAPES
    if day_first:
        dates = tuple((s, p.replace("M/d/yyyy", "d/M/yyyy")) for s, p in dates)
        times = tuple((s, p.replace("M/d/yyyy", "d/M/yyyy")) for s, p in times)
    stripped = strip(text)
    candidate = F.when(stripped.rlike(_FEW_WORDS) & stripped.rlike(_PLAUSIBLE), stripped)
    plain = _readable(candidate)
    spaced = F.regexp_replace(plain, r"(\d)T(\d)", "$1 $2")
    return F.coalesce(
        _first_match(plain, dates, DATE_FORMAT), _first_match(spaced, times, DATETIME_FORMAT)
    )


def normalize_date(text: Column, day_first: bool = False) -> Column:
    return F.coalesce(parse_date_text(text, day_first), text)


def percent_to_fraction(text: Column) -> Column:
    """'12.5%' -> 0.125 as DOUBLE; null for cells that are not a percentage."""
    stripped = strip(text)
    digits = F.regexp_extract(stripped, r"^([+-]?[0-9]+(?:\.[0-9]+)?) ?%$", 1)
    return digits.try_cast("double") / 100


def normalize_phone(text: Column, country_code: str | None = None) -> Column:
    """'+' and digits for numbers with a country code; others get ``country_code`` if one is set.

    Cells with letters or with fewer than 7 or more than 15 digits are kept as they are.
    """
    stripped = strip(text)
    digits = F.regexp_replace(stripped, "[^0-9]", "")
    looks_like_phone = stripped.rlike(r"^\+?[0-9 ().\-/]+$") & F.length(digits).between(7, 15)
    result = F.when(looks_like_phone & stripped.startswith("+"), F.concat(F.lit("+"), digits))
    result = result.when(
        looks_like_phone & digits.startswith("00"),
        F.concat(F.lit("+"), F.regexp_replace(digits, "^00", "")),
    )
    if country_code:
        code = country_code.lstrip("+")
        local = F.regexp_replace(digits, "^0", "")
        result = result.when(looks_like_phone, F.concat(F.lit("+" + code), local))
    return result.otherwise(text)
