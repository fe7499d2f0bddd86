"""Native cleaning actions. All but deduplication and canonical casing are plain projections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions import text
from burnish.operators import lookup
from burnish.operators.bloom import bloom_filter, may_be_in
from burnish.operators.columns import col, comparable, groups_of, stacked, text_fields
from burnish.operators.lookup import attach, measured_bytes
from burnish.operators.quality import cell_record, fingerprint, record_groups
from burnish.sources.shared import written

FORM_BYTES = 100  # upper bound of one fingerprint in a broadcast table


def map_text(df: DataFrame, change: Callable[[Column], Column], columns: list[str] | None = None) -> DataFrame:
    """Apply an expression to every text column (or the named ones), others untouched."""
    names = set(columns) if columns is not None else {f.name for f in text_fields(df)}
    return df.select(*[change(col(c)).alias(c) if c in names else col(c) for c in df.columns])


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip every text cell; blank cells become ''."""
    return map_text(df, text.strip)


def trim_to_missing(df: DataFrame) -> DataFrame:
    """Strip every text cell; blank cells become null."""
    return map_text(df, lambda c: F.nullif(text.strip(c), F.lit("")))


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[text.nan_to_null(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def null_tokens_to_null(df: DataFrame, tokens=text.FILE_NULL_TOKENS, folded: bool = False) -> DataFrame:
    return map_text(df, lambda c: text.null_tokens_to_null(c, tokens, folded))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each row, with null equal to null (NaN counts as null and comes out as null).

    Copies combine before the shuffle, so a row copied many times does not load one task.
    """
    plain = nan_to_null(df)
    maps = [f for f in plain.schema.fields if isinstance(f.dataType, T.MapType)]
    if not maps:
        return plain.dropDuplicates()
    helpers = {f"_entries{i}": comparable(f) for i, f in enumerate(maps)}
    mapped = {f.name for f in maps}
    keys = [c for c in plain.columns if c not in mapped] + list(helpers)
    return plain.withColumns(helpers).dropDuplicates(keys).drop(*helpers)


def fill_missing(df: DataFrame, fill: str = text.FILL_VALUE, placeholders=text.PLACEHOLDERS) -> DataFrame:
    """Null, blank and placeholder text cells become ``fill``; other types keep their nulls."""
    return map_text(df, lambda c: text.filled(c, fill, placeholders))


def unique_snake_names(names: list[str]) -> list[str]:
    """snake_case names, made unique by _2, _3, ...; names without letters become column_<n>."""
    taken: set[str] = set()
    result = []
    for position, name in enumerate(names):
        base = text.snake_case_name(name) or f"column_{position + 1}"
        unique, suffix = base, 2
        while unique in taken:
            unique, suffix = f"{base}_{suffix}", suffix + 1
        taken.add(unique)
        result.append(unique)
    return result


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_snake_names(df.columns))


def mixed_forms(df: DataFrame, names: list[str]) -> DataFrame:
    """(slot, k1, k2): fingerprints of the normal forms that are spelled in more than one way."""
    records = [cell_record(slot, name, "both") for slot, name in enumerate(names)]
    parts = [record_groups(df, group) for group in groups_of(records)]
    return reduce(DataFrame.unionByName, parts).where(F.col("low") != F.col("high")).select("slot", "k1", "k2")


def canonical_map(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(slot, form, new_value) for every normal form that is spelled in more than one way.

    All values with the same stripped lower-case form belong together; the canonical spelling is
    the most frequent one, ties going to the smallest. ``slot`` is the position in ``columns``.
    A first pass over fingerprints finds the forms in question, so texts are shuffled for these
    only (if the list is too large to broadcast, for those that pass a Bloom filter of it). All groupings combine in each task
    first, so neither a frequent value nor a form with many spellings loads one task.
    """
    names = columns if columns is not None else [f.name for f in text_fields(df)]
    forms = written(mixed_forms(df, names), "forms")
    found = {row["slot"]: row["count"] for row in forms.groupBy("slot").count().collect()}  # one per column
    cells = [F.struct(F.lit(i).alias("slot"), col(names[i]).alias("v")) for i in sorted(found)]
    if not cells:
        return df.sparkSession.createDataFrame([], "slot int, form string, new_value string")
    long = reduce(DataFrame.unionByName, [stacked(df, group, "slot:int,v:string") for group in groups_of(cells)])
    long = long.where(F.col("v").isNotNull())
    first, second = fingerprint(text.normal_form(F.col("v")))
    keyed = long.withColumns({"k1": first, "k2": second})
    if sum(found.values()) * FORM_BYTES <= lookup.BROADCAST_BYTES:
        long = keyed.join(F.broadcast(forms), ["slot", "k1", "k2"], "left_semi")
    else:
        slotted = ["h1", "h2"]
        hashes = {h: F.xxhash64("slot", k) for h, k in zip(slotted, ("k1", "k2"), strict=True)}
        filtered = bloom_filter(forms.withColumns(hashes), sum(found.values()), slotted)
        long = may_be_in(keyed.withColumns(hashes), slotted, *filtered)
    counted = long.groupBy("slot", "v").agg(F.count(F.lit(1)).alias("n"))
    most_frequent = F.min_by("v", F.struct((-F.col("n")).alias("rare"), "v"))
    return (
        counted.groupBy("slot", text.normal_form(F.col("v")).alias("form"))
        .agg(most_frequent.alias("new_value"), F.count(F.lit(1)).alias("spellings"))
        .where(F.col("spellings") > 1)
        .drop("spellings")
    )


def canonical_case(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every spelling replaced by its group's canonical one.

    The replacements are computed first (Spark jobs), written to the shared folder and measured.
    Columns without variants are not joined at all.
    """
    names = columns if columns is not None else [f.name for f in text_fields(df)]
    if not names:
        return df
    mapping = written(canonical_map(df, names), "canonical")
    sizes = {row["slot"]: row["bytes"] for row in measured_bytes(mapping).collect()}  # one row per column
    result = df
    for slot, size in sorted(sizes.items()):
        replacements = mapping.where(F.col("slot") == slot).select(F.col("form").alias("_burnish_key"), "new_value")
        result = attach(result, text.normal_form(col(names[slot])), replacements, size, f"_new{slot}")
    changed = {names[slot]: F.col(f"_new{slot}")["new_value"] for slot in sizes}
    return result.select(*[_replaced(changed, c) for c in df.columns])


def _replaced(changed: dict[str, Column], name: str) -> Column:
    return F.coalesce(changed[name], col(name)).alias(name) if name in changed else col(name)


# Issue class -> native action.
ACTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "missing": fill_missing,
    "duplicate": drop_exact_duplicates,
    "header": normalize_headers,
    "whitespace": trim_to_missing,
    "casing": canonical_case,
}


def apply_actions(df: DataFrame, actions: list[str]) -> DataFrame:
    """The named actions in the given order."""
    for name in actions:
        df = ACTIONS[name](df)
    return df
