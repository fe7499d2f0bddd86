"""One cleaning run with what it leaves behind: the cleaned table, the rows to review, and the audit log."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions import text
from burnish.operators.actions import map_text, unique_snake_names
from burnish.operators.batches import Transformer
from burnish.operators.columns import text_fields
from burnish.operators.review import ACCEPT, REVIEW, apply_accepted, attach_proposals, audit_log, review_queue
from burnish.plans.propose import PROPOSED_KINDS, propose_values
from burnish.sources.shared import written


class Artifacts(NamedTuple):
    cleaned: DataFrame
    review: DataFrame  # rows with a proposal that needs a decision, with these in ``review``
    audit: DataFrame  # a row for each changed cell; source: rules or proposals


def tidy_cell(cell):
    """Stripped, and null for blanks and for the tokens that stand for missing values."""
    return F.nullif(text.strip(text.null_tokens_to_null(cell, text.CONFIG_NULL_TOKENS, True)), F.lit(""))


def clean_with_artifacts(
    df: DataFrame, key: list[str], fn: Transformer | None = None, instruction: str = "",
    kinds: tuple[str, ...] = PROPOSED_KINDS, accept: float = ACCEPT, review: float = REVIEW,
) -> Artifacts:
    """Clean by rules and then by proposals, and account for every change.

    Headers become snake_case. Text cells outside of ``key`` are stripped, and blanks and null tokens become
    null. With ``fn``, distinct values of the columns of ``kinds`` are sent to it (:func:`propose_values`), once each:
    proposals of confidence ``accept`` or more are applied, those from ``review`` on are listed for review, the others are
    dropped. The audit log has the old and new value of every changed cell by key (:func:`audit_log`), first for the
    rules, then for the proposals.

    The table is stored before, between and after the two steps, so that neither the input nor ``fn`` is asked again.
    """
    names = unique_snake_names(df.columns)
    keys = [names[df.columns.index(k)] for k in key]
    before = written(df.toDF(*names), "before")
    texts = [f.name for f in text_fields(before) if f.name not in keys]
    tidy = written(map_text(before, tidy_cell, texts), "tidy")
    by_rules = audit_log(before, tidy, keys, "rules", stored=True)
    if fn is None:
        return Artifacts(tidy, attach_no_review(tidy), by_rules)
    proposals = propose_values(tidy.drop(*keys), fn, instruction, kinds)
    proposed = written(attach_proposals(tidy, proposals, accept, review), "proposed")
    cleaned = written(apply_accepted(proposed), "cleaned")
    return Artifacts(cleaned, review_queue(proposed), by_rules.unionByName(audit_log(tidy, cleaned, keys, "proposals", stored=True)))


def attach_no_review(table: DataFrame) -> DataFrame:
    """The review table of a run without proposals: no rows."""
    nothing = table.sparkSession.createDataFrame([], "column string, old_value string, new_value string, confidence double")
    return review_queue(attach_proposals(table, nothing))
