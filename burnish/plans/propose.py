"""Proposals for the values of a table: a transformer sees distinct values instead of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.operators.batches import Transformer, transform_batches
from burnish.operators.columns import col, text_fields
from burnish.operators.kinds import column_kinds

PROPOSED_KINDS = ("category_text", "name")
_ANSWER = "old_value string, new_value string, confidence double"


def propose_values(
    df: DataFrame, fn: Transformer, instruction: str, kinds: tuple[str, ...] = PROPOSED_KINDS, batch_size: int = 20,
    answers: str | None = None,
) -> DataFrame:
    """(column, old_value, new_value, confidence) for the text columns of the given kinds.

    ``fn`` gets JSON lists of {"old_value"} and answers with lists of the same length that add "new_value" and
    "confidence". Each distinct value is sent once. Batches that fail and values without a change, a new
    value or a confidence give no proposal; ``answers`` keeps what was answered (see ``transform_batches``). Feed the result to ``attach_proposals`` or ``apply_value_map``,
    and the table before and after to ``audit_log``.
    """
    texts = {f.name for f in text_fields(df)}
    chosen = column_kinds(df).where(F.col("kind").isin(*kinds)).select("column").collect()  # one row per column
    parts = []
    for name in sorted(row["column"] for row in chosen if row["column"] in texts):
        values = df.select(col(name).alias("old_value")).where(F.col("old_value").isNotNull()).distinct()
        answered = transform_batches(values, fn, instruction, batch_size=batch_size, schema=_ANSWER, answers=answers)
        good = (F.col("_batch_status") == "ok") & F.col("new_value").isNotNull() & F.col("confidence").isNotNull()
        proposed = answered.where(good & (F.col("new_value") != F.col("old_value")))
        parts.append(proposed.select(F.lit(name).alias("column"), "old_value", "new_value", "confidence"))
    if not parts:
        return df.sparkSession.createDataFrame([], f"column string, {_ANSWER}")
    return reduce(DataFrame.unionByName, parts)
