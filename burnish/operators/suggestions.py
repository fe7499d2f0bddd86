"""Normalize and merge suggestions, one analysis per row. No shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.operators.columns import col
from burnish.functions.jsontext import (
    SUGGESTIONS_TYPE,
    extract_json,
    unwrap_json_object,
    validate_analysis,
)
from burnish.functions.routing import instruction_for, issue_class
from burnish.functions.text import normal_form, strip

MAX_SUGGESTIONS = 5


def normalized(suggestion: Column) -> Column:
    """Stripped fields; the prompt is replaced by the general instruction of the issue's class."""
    issue = suggestion["issue_description"]
    kind = issue_class(issue, suggestion["resolution_prompt"])
    return F.struct(
        strip(issue).alias("issue_description"),
        strip(suggestion["priority"]).alias("priority"),
        instruction_for(kind, issue).alias("resolution_prompt"),
    )


def suggestion_key(suggestion: Column) -> Column:
    return F.concat_ws(
        "|",
        normal_form(suggestion["issue_description"]),
        normal_form(suggestion["priority"]),
        normal_form(suggestion["resolution_prompt"]),
    )


def merged_suggestions(opinion: Column, own: Column) -> Column:
    """Opinion first, then own; the first per key stays; at most five."""
    together = F.transform(F.concat(opinion, own), normalized)
    keyed = F.transform(together, lambda s: F.struct(suggestion_key(s).alias("key"), s.alias("s")))
    empty = F.slice(keyed, 1, 0)
    kept = F.aggregate(
        keyed,
        empty,
        lambda done, item: F.when(
            (F.size(done) >= MAX_SUGGESTIONS) | F.exists(done, lambda d: d["key"] == item["key"]), done
        ).otherwise(F.array_append(done, item)),
    )
    return F.transform(kept, lambda item: item["s"])


def merged_score(own: Column, opinion: Column) -> Column:
    """Mean of two scores, ties to even, clamped to 0..100; null if one is null."""
    mean = F.rint((own + opinion) / 2)
    return F.when(mean > 100, 100).when(mean < 0, 0).otherwise(mean.cast("int"))


def with_opinion(df: DataFrame, raw: str, out: str = "opinion") -> DataFrame:
    """Replace the raw response by struct (quality_score, suggestions), null if it holds no valid one.

    One step per projection, so that every text is searched and parsed once.
    """
    found = df.withColumn("_payload", extract_json(F.col(raw))).drop(raw)
    unwrapped = found.withColumn("_payload", unwrap_json_object(F.col("_payload")))
    parsed = unwrapped.withColumn("_parsed", F.try_parse_json("_payload"))
    return parsed.withColumn(out, validate_analysis(F.col("_parsed"))).drop("_payload", "_parsed")


def merge_analyses(df: DataFrame, opinion: str = "opinion") -> DataFrame:
    """Merge column ``opinion`` (struct or null) into ``quality_score`` and ``suggestions``.

    Rows without an opinion keep their own score; their suggestions are normalized all the same.
    """
    other = F.col(opinion)
    none = F.array().cast(SUGGESTIONS_TYPE)
    return df.select(
        *[col(c) for c in df.columns if c not in (opinion, "quality_score", "suggestions")],
        F.coalesce(merged_score(F.col("quality_score"), other["quality_score"]), F.col("quality_score")).alias(
            "quality_score"
        ),
        F.when(other.isNull(), F.transform("suggestions", normalized))
        .otherwise(merged_suggestions(F.coalesce(other["suggestions"], none), F.col("suggestions")))
        .alias("suggestions"),
    )


def route_issues(df: DataFrame) -> DataFrame:
    """Adds ``issue_class`` and ``instruction`` to rows of (issue_description, resolution_prompt)."""
    kind = issue_class(F.col("issue_description"), F.col("resolution_prompt"))
    routed = df.withColumn("issue_class", kind)
    return routed.withColumn("instruction", instruction_for(F.col("issue_class"), F.col("issue_description")))


def normalize_suggestions(df: DataFrame) -> DataFrame:
    """Flat form of ``normalized`` for rows of (issue_description, priority, resolution_prompt)."""
    fields = ("issue_description", "priority", "resolution_prompt")
    struct = normalized(F.struct(*[F.col(f) for f in fields]))
    kept = [c for c in df.columns if c not in fields]
    return df.select(*[col(c) for c in kept], struct.alias("_s")).select(*[col(c) for c in kept], "_s.*")
