"""Recover, unwrap and validate JSON in free-text responses, as column expressions.

All functions take and return JSON *text*; null means "no valid payload". Parsing is strict
(``try_parse_json`` inside a wrapper array), so trailing text and repeated keys are refused. Bare NaN and
Infinity become null first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.functions.text import strip

_END_MARK = "\u0001end of candidate\u0001"

# What any JSON text looks like from outside. Spares the parser, whose refusal costs an exception.
_OUTSIDE = r'(?s)^(\{.*\}|\[.*\]|".*"|-?[0-9][0-9.eE+-]*|true|false|null)$'

# A JSON string, a bare NaN or infinity, or what lies between. Possessive, so no text is searched twice.
_TOKEN = r'(?s)"(?:[^"\\]|\\.)*+"|-?(?:NaN|Infinity)|[^"NI-]++|.'

# The parser refuses longer strings, which must not pass for an answer without JSON.
PARSER_LIMIT = 20_000_000

SUGGESTIONS_TYPE = (
    "array<struct<issue_description:string,priority:string,resolution_prompt:string>>"
)


def is_strict_json(text: Column) -> Column:
    """The whole text is exactly one JSON value.

    ``try_parse_json`` alone accepts trailing text; here the candidate must be followed by a
    second array element that we know.
    """
    shaped = F.when(text.rlike(_OUTSIDE), text)
    wrapped = F.concat(F.lit("["), shaped, F.lit(',"\\u0001end of candidate\\u0001"]'))
    second = F.try_variant_get(F.try_parse_json(wrapped), "$[1]", "string")
    message = F.lit(f"JSON with a string of more than {PARSER_LIMIT} characters cannot be checked")
    too_long = second.isNull() & (F.length(shaped) > PARSER_LIMIT) & shaped.rlike(f'"[^"]{{{PARSER_LIMIT},}}')
    return F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(F.coalesce(second == _END_MARK, F.lit(False)))


def numbers_to_null(text: Column) -> Column:
    """NaN and Infinity outside of strings replaced by null; other texts as they are."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    plain = F.transform(tokens, lambda t: F.when(t.isin("NaN", "-NaN", "Infinity", "-Infinity"), "null").otherwise(t))
    return F.when(text.rlike("NaN|Infinity"), F.array_join(plain, "")).otherwise(text)


def extract_json(raw: Column) -> Column:
    """First valid payload: json fence, any fence, whole text, widest [...], widest {...}."""
    candidates = [
        F.regexp_extract(raw, r"(?is)```json(.*?)```", 1),
        F.regexp_extract(raw, r"(?is)```(.*?)```", 1),
        raw,
        F.regexp_extract(raw, r"(?s)(\[.*\])", 1),
        F.regexp_extract(raw, r"(?s)(\{.*\})", 1),
    ]
    stripped = [numbers_to_null(strip(candidate)) for candidate in candidates]
    return F.coalesce(*[F.when(is_strict_json(text), text) for text in stripped])


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def unwrap_json_list(payload: Column) -> Column:
    """For an object: its first value that is a list, in document order; else unchanged.

    Numbers keep all their digits; keys of objects inside the list come out sorted.
    """
    values = F.map_values(F.from_json(payload, "map<string,variant>"))
    lists = F.filter(values, lambda value: F.startswith(_kind(value), F.lit("ARRAY<")))
    first = F.when(F.startswith(strip(payload), F.lit("{")), F.to_json(F.try_element_at(lists, F.lit(1))))
    return F.coalesce(first, payload)


def array_items(payload: Column) -> Column:
    """The items of a JSON array as an array of JSON texts."""
    items = F.try_variant_get(F.try_parse_json(payload), "$", "array<variant>")
    return F.transform(items, lambda item: F.to_json(item))


def unwrap_json_object(payload: Column, expected_key: str = "suggestions") -> Column:
    """For an object with one key that is not the expected one: that key's value."""
    values = F.from_json(payload, "map<string,string>")
    keys = F.json_object_keys(payload)
    wrapped = (F.size(keys) == 1) & (F.try_element_at(keys, F.lit(1)) != expected_key)
    return F.when(wrapped, F.try_element_at(F.map_values(values), F.lit(1))).otherwise(payload)


def validate_batch(payload: Column, expected_rows: Column) -> Column:
    """The payload is a JSON array of the expected length."""
    return F.coalesce(F.json_array_length(payload) == expected_rows, F.lit(False))


def validate_analysis(parsed: Column) -> Column:
    """Struct ``(quality_score, suggestions)`` of a valid analysis payload (a variant), else null.

    The score must be a whole number from 0 to 100 (number, whole decimal, boolean or digits in
    a string); suggestions must be a list of objects with three string fields; no list means none.
    """
    score_value = F.try_variant_get(parsed, "$.quality_score", "variant")
    score_text = strip(F.try_variant_get(parsed, "$.quality_score", "string"))
    number = F.when(_kind(score_value) == "BOOLEAN", F.when(score_text == "true", 1.0).otherwise(0.0))
    number = number.when(
        score_text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), score_text.try_cast("double")
    )
    score = F.when((number == F.floor(number)) & number.between(0, 100), number.cast("int"))

    listed = F.try_variant_get(parsed, "$.suggestions", "variant")
    items = F.try_variant_get(parsed, "$.suggestions", "array<variant>")

    def all_strings(item: Column) -> Column:
        fields = ("issue_description", "priority", "resolution_prompt")
        tests = [
            F.coalesce(_kind(F.try_variant_get(item, f"$.{name}", "variant")) == "STRING", F.lit(False))
            for name in fields
        ]
        return tests[0] & tests[1] & tests[2]

    list_ok = F.when(listed.isNull(), True).otherwise(
        F.coalesce(F.forall(items, all_strings), F.lit(False))
    )
    suggestions = F.coalesce(
        F.try_variant_get(parsed, "$.suggestions", SUGGESTIONS_TYPE),
        F.array().cast(SUGGESTIONS_TYPE),
    )
    return F.when(
        score.isNotNull() & list_ok,
        F.struct(score.alias("quality_score"), suggestions.alias("suggestions")),
    )
