"""Whole analysis of a table: own checks, an optional second opinion, profile and sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.operators.actions import nan_to_null
from burnish.operators.columns import col
from burnish.operators.profile import profile, sample_rows
from burnish.operators.quality import suggest
from burnish.operators.suggestions import merge_analyses, with_opinion

SAMPLE_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def profile_json(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """The profile as one JSON document."""
    found = profile(df, order_by)
    return found.select(F.to_json(F.struct(*found.columns)).alias("profile"))


def sample_json(df: DataFrame, key: list[str] | None = None, portable: bool = False) -> DataFrame:
    """The row sample as one JSON array. At most 50 rows are gathered."""
    picked = sample_rows(df, key, portable)
    rows = nan_to_null(picked)
    names = df.columns
    options = {"ignoreNullFields": "false", "timestampFormat": SAMPLE_TIME_FORMAT}
    item = F.struct("sample_rank", F.to_json(F.struct(*[col(n) for n in names]), options).alias("row"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"])
    return rows.agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("sample"))


def analyze(df: DataFrame, raw_opinion: str | None = None, edge: str = "both", exact: bool = False) -> DataFrame:
    """One row (quality_score, suggestions), merged with a raw second opinion if it holds a valid one."""
    own = suggest(df, edge, exact).withColumn("raw", F.lit(raw_opinion).cast("string"))
    return merge_analyses(with_opinion(own, "raw"))


def opinion_request(df: DataFrame, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What a second opinion is asked about: (profile document, row sample)."""
    return profile_json(df, key), sample_json(df, key)

