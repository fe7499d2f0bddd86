"""Whole cleaning run: trim, deduplicate if asked, then a transformer or a native action."""

from __future__ import annotations

from pyspark.sql import DataFrame

from burnish.functions.routing import route_text, text_asks_for_dedup
from burnish.operators.actions import apply_actions, drop_exact_duplicates, trim_strings
from burnish.operators.batches import Transformer, transform_batches


def clean(df: DataFrame, instruction: str, fn: Transformer | None = None, **batch_options) -> DataFrame:
    """Trim all text, drop exact duplicates if the instruction asks for it, then apply it.

    With ``fn`` the rows go through :func:`transform_batches`. Without it the instruction is routed
    to one of the native actions; an instruction of no known class changes nothing more.
    """
    trimmed = trim_strings(df)
    if text_asks_for_dedup(instruction):
        trimmed = drop_exact_duplicates(trimmed)
    if fn is not None:
        return transform_batches(trimmed, fn, instruction, **batch_options)
    kind = route_text(instruction)
    if kind in ("other", "duplicate"):
        return trimmed
    return apply_actions(trimmed, [kind])
