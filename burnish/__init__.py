"""Profile, score and clean tables of any size with Spark."""

from burnish.functions.routing import asks_for_dedup, issue_class
from burnish.functions.text import normal_form, snake_case, strip
from burnish.functions.values import normalize_date, normalize_phone, percent_to_fraction
from burnish.operators.actions import (
    apply_actions,
    canonical_case,
    drop_exact_duplicates,
    fill_missing,
    nan_to_null,
    normalize_headers,
    null_tokens_to_null,
    trim_strings,
    trim_to_missing,
)
from burnish.operators.batches import (
    batch_payloads,
    explode_payloads,
    extra_columns,
    to_json_records,
    transform_batches,
    union_by_name,
)
from burnish.operators.kinds import column_kinds
from burnish.operators.profile import (
    dtype_counts,
    duplicate_stats,
    header_issues,
    missing_by_column,
    numeric_ranges,
    profile,
    profile_columns,
    sample_rows,
    table_profile,
    text_samples,
)
from burnish.operators.quality import check_quality, edge_whitespace_cells, quality_score, suggest
from burnish.operators.review import (
    apply_value_map,
    attach_proposals,
    audit_log,
    audit_projection,
    review_queue,
)
from burnish.operators.suggestions import merge_analyses, normalize_suggestions, route_issues, with_opinion
from burnish.plans.analyze import analyze, profile_json, sample_json
from burnish.plans.clean import clean
from burnish.sources.delimited import infer_types, inspect_files, read_delimited, write_delimited

__all__ = [name for name in dir() if not name.startswith("_")]
