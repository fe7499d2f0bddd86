"""Registered queries: routing, suggestions, JSON recovery, batches, whole cleaning runs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from burnish.functions import jsontext, routing
from burnish.operators import batches, suggestions
from burnish.plans.clean import clean
from workload.checksql import literal
from burnish.sources.shared import new_path
from workload.registry import query
from workload.views import view

# Class of each issue by issue_id % 6, see the view.
_CLASSES = ["missing", "duplicate", "header", "whitespace", "casing", "other"]


def _by_class(issue: str, kind: str) -> str:
    """The instruction of an issue class as a SQL expression."""
    if kind == "other":
        return f"{literal(routing.OTHER_BEFORE)} || trim({issue}, {{WS}}) || {literal(routing.OTHER_AFTER)}"
    return literal(routing.INSTRUCTIONS[kind])


_INSTRUCTION = "CASE issue_id % 6 " + " ".join(
    f"WHEN {i} THEN {_by_class('issue_description', kind)}" for i, kind in enumerate(_CLASSES)
) + " END"
_CLASS = "CASE issue_id % 6 " + " ".join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(_CLASSES)) + " END"


@query("route_issues", "issues", f"SELECT issue_id, {_CLASS} AS issue_class, {_INSTRUCTION} AS instruction FROM issues")
def route_issues(spark, sf_dir):
    return suggestions.route_issues(view(spark, sf_dir, "issues")).select("issue_id", "issue_class", "instruction")


@query("normalize_suggestions", "issues", f"""
SELECT issue_id, trim(issue_description, {{WS}}) AS issue_description, trim(priority, {{WS}}) AS priority,
       {_INSTRUCTION} AS resolution_prompt FROM issues""")
def normalize_suggestions(spark, sf_dir):
    return suggestions.normalize_suggestions(view(spark, sf_dir, "issues"))


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(prompt), '{w}')" for w in words) + ")"


@query("dedup_intent", "prompts", f"""
SELECT prompt_id, {_any(["duplicate", "duplicates", "deduplicate", "dedup", "redundant copies"])}
  AND {_any(["remove", "drop", "delete", "keep one", "canonical"])} OR {_any(["exact duplicate"])} AS wanted FROM prompts""")
def dedup_intent(spark, sf_dir):
    return view(spark, sf_dir, "prompts").select("prompt_id", routing.asks_for_dedup(F.col("prompt")).alias("wanted"))


_FOUND = """CASE response_id % 6 WHEN 2 THEN '{"rows":[{"k":' || response_id || '}]}'
  WHEN 4 THEN '[{"k":' || response_id || '},{"k":0}]' WHEN 5 THEN NULL ELSE '[{"k":' || response_id || '}]' END"""
_LISTED = """CASE response_id % 6 WHEN 4 THEN '[{"k":' || response_id || '},{"k":0}]' WHEN 5 THEN NULL
  ELSE '[{"k":' || response_id || '}]' END"""


@query("extract_json", "raw_responses", f"SELECT response_id, {_FOUND} AS payload FROM raw_responses")
def extract_json(spark, sf_dir):
    return view(spark, sf_dir, "raw_responses").select(
        "response_id", jsontext.extract_json(F.col("raw")).alias("payload")
    )


@query("unwrap_json_list", "raw_responses", f"SELECT response_id, {_LISTED} AS rows FROM raw_responses")
def unwrap_json_list(spark, sf_dir):
    found = view(spark, sf_dir, "raw_responses").withColumn("payload", jsontext.extract_json(F.col("raw")))
    return found.select("response_id", jsontext.unwrap_json_list(F.col("payload")).alias("rows"))


@query("validate_batches", "raw_responses", f"""
SELECT response_id, coalesce(json_array_length({_LISTED}) = 1, false) AS valid FROM raw_responses""")
def validate_batches(spark, sf_dir):
    found = view(spark, sf_dir, "raw_responses").withColumn("payload", jsontext.extract_json(F.col("raw")))
    listed = jsontext.unwrap_json_list(F.col("payload"))
    return found.select("response_id", jsontext.validate_batch(listed, F.lit(1)).alias("valid"))


@query("unwrap_json_object", "opinions", """
SELECT dataset_id, CASE dataset_id % 8 WHEN 1 THEN '{"quality_score":70,"suggestions":[]}' WHEN 7 THEN NULL ELSE raw END AS payload
FROM opinions""")
def unwrap_json_object(spark, sf_dir):
    found = view(spark, sf_dir, "opinions").withColumn("payload", jsontext.extract_json(F.col("raw")))
    return found.select("dataset_id", jsontext.unwrap_json_object(F.col("payload")).alias("payload"))


@query("validate_payload", "opinions", """
SELECT dataset_id, CASE dataset_id % 8 WHEN 0 THEN 85 WHEN 1 THEN 70 WHEN 3 THEN 85 WHEN 6 THEN 41 END::INT AS quality_score,
  CASE dataset_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 3 THEN 0 WHEN 6 THEN 2 END::INT AS n_suggestions FROM opinions""")
def validate_payload(spark, sf_dir):
    found = suggestions.with_opinion(view(spark, sf_dir, "opinions").select("dataset_id", "raw"), "raw", "o")
    counted = F.when(F.col("o").isNotNull(), F.size("o.suggestions"))
    return found.select("dataset_id", "o.quality_score", counted.alias("n_suggestions"))


_OWN = [
    ("Some cells are blank", "High", "x"),
    ("Casing differs", "Low", "x"),
    ("units are mixed", "Low", "x"),
    ("Duplicate rows found", "Low", "x"),
    ("Leading or trailing characters", "Low", "x"),
]
# Issues that stay, by dataset_id % 8: the opinion first, one per key, at most five.
_ALL = "Some cells are blank;Casing differs;units are mixed;Duplicate rows found;Leading or trailing characters"


@query("merge_analysis", "opinions", f"""
SELECT dataset_id, CASE dataset_id % 8 WHEN 0 THEN round_even((quality_score + 85) / 2.0, 0) WHEN 1 THEN round_even((quality_score + 70) / 2.0, 0)
    WHEN 3 THEN round_even((quality_score + 85) / 2.0, 0) WHEN 6 THEN round_even((quality_score + 41) / 2.0, 0) ELSE quality_score END::INT AS quality_score,
  CASE dataset_id % 8 WHEN 6 THEN 'Units are mixed;Some cells are blank;Casing differs;Duplicate rows found;Leading or trailing characters'
    ELSE {literal(_ALL)} END AS issues FROM opinions""")
def merge_analysis(spark, sf_dir):
    own = F.array(
        *[
            F.struct(
                F.lit(issue).alias("issue_description"),
                F.lit(rank).alias("priority"),
                F.lit(prompt).alias("resolution_prompt"),
            )
            for issue, rank, prompt in _OWN
        ]
    )
    analyses = view(spark, sf_dir, "opinions").withColumn("suggestions", own)
    merged = suggestions.merge_analyses(suggestions.with_opinion(analyses, "raw"))
    issues = F.transform("suggestions", lambda s: s["issue_description"])
    return merged.select("dataset_id", "quality_score", F.array_join(issues, ";").alias("issues"))


_ORDER_JSON = """'{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"OrderStatus":'
  || coalesce('"' || replace(OrderStatus, chr(9), '\\t') || '"', 'null') || ',"order_priority":"' || order_priority
  || '","total_price":' || coalesce(total_price::VARCHAR, 'null') || '}'"""


@query("batch_payloads", "dirty_orders", f"""
SELECT batch_id, part::INT AS part, count(*)::INT AS n_rows, '[' || string_agg(record, ',' ORDER BY record) || ']' AS payload FROM (
  SELECT batch_id, record, (row_number() OVER (PARTITION BY batch_id ORDER BY record) - 1) // 20 AS part
  FROM (SELECT o_orderkey // 20 AS batch_id, {_ORDER_JSON} AS record FROM dirty_orders)) GROUP BY batch_id, part""")
def batch_payloads(spark, sf_dir):
    return batches.batch_payloads(view(spark, sf_dir, "dirty_orders"), "o_orderkey")


@query("batch_payloads_skewed", "", """
SELECT batch_id, part::INT AS part, count(*)::INT AS n_rows, '[' || string_agg(record, ',' ORDER BY record) || ']' AS payload FROM (
  SELECT batch_id, record, (row_number() OVER (PARTITION BY batch_id ORDER BY record) - 1) // 20 AS part
  FROM (SELECT k // 20 AS batch_id, '{"k":' || coalesce(k::VARCHAR, 'null') || ',"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || '}' AS record
    FROM (SELECT CASE l_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN l_orderkey END AS k, l_orderkey, l_linenumber FROM lineitem))) GROUP BY batch_id, part""")
def batch_payloads_skewed(spark, sf_dir):
    """A third of the rows have one key and a third have none."""
    key = F.when(F.col("l_orderkey") % 3 == 0, 7).when(F.col("l_orderkey") % 3 == 1, F.col("l_orderkey"))
    items = view(spark, sf_dir, "lineitem").select(key.cast("long").alias("k"), "l_orderkey", "l_linenumber")
    return batches.batch_payloads(items, "k")


@query("explode_payloads", "dirty_orders", "SELECT * FROM dirty_orders")
def explode_payloads(spark, sf_dir):
    orders = view(spark, sf_dir, "dirty_orders")
    return batches.explode_payloads(batches.batch_payloads(orders, "o_orderkey"), orders.schema)


def unreliable_upper(payload: str, instruction: str) -> str:
    """A transformer that upper-cases a column, needs a second try at times, and fails at times."""
    rows = json.loads(payload)
    batch_id = rows[0]["o_orderkey"] // 20
    if batch_id % 7 == 0:
        raise RuntimeError("not available")
    if batch_id % 3 == 0 and instruction == "upper":
        return "I could not do that."
    for row in rows:
        row["order_priority"] = row["order_priority"].upper() + "!"
    return "Here you are:\n```json\n" + json.dumps({"rows": rows}) + "\n```"


_STATUS = """CASE WHEN o_orderkey // 20 % 7 = 0 THEN 'passed' ELSE 'ok' END AS _batch_status,
  CASE WHEN o_orderkey // 20 % 7 = 0 OR o_orderkey // 20 % 3 = 0 THEN 2 ELSE 1 END::INT AS _attempts,
  CASE WHEN o_orderkey // 20 % 7 = 0 THEN 'RuntimeError: not available' END AS _error, NULL::VARCHAR AS _unparsed"""
_UPPER = "CASE WHEN o_orderkey // 20 % 7 = 0 THEN order_priority ELSE upper(order_priority) || '!' END AS order_priority"


@query("batch_transform", "dirty_orders", f"""
SELECT o_orderkey, o_custkey, OrderStatus, {_UPPER}, total_price, {_STATUS} FROM dirty_orders""")
def batch_transform(spark, sf_dir):
    return batches.transform_batches(
        view(spark, sf_dir, "dirty_orders"), unreliable_upper, "upper", key="o_orderkey"
    ).drop("_extra")


def sold_out(payload: str, instruction: str) -> str:
    raise AssertionError("sold out")


@query("batch_transform_kept", "dirty_orders", f"""
SELECT o_orderkey, o_custkey, OrderStatus, CASE WHEN o_orderkey // 20 % 7 = 0 THEN order_priority ELSE upper(order_priority) || '!' END AS order_priority,
  total_price, CASE WHEN o_orderkey // 20 % 7 = 0 THEN 'passed' ELSE 'ok' END AS _batch_status,
  CASE WHEN o_orderkey // 20 % 7 = 0 OR o_orderkey // 20 % 3 = 0 THEN 2 ELSE 1 END::INT AS _attempts,
  CASE WHEN o_orderkey // 20 % 7 = 0 THEN 'AssertionError: sold out' END AS _error, NULL::VARCHAR AS _unparsed FROM dirty_orders""")
def batch_transform_kept(spark, sf_dir):
    """A second run that asks nothing: all that was answered in the first one comes from the kept answers."""
    orders, folder = view(spark, sf_dir, "dirty_orders"), new_path(spark, "answers")
    first = batches.transform_batches(orders, unreliable_upper, "upper", key="o_orderkey", answers=folder)
    first.write.format("noop").mode("overwrite").save()
    return batches.transform_batches(orders, sold_out, "upper", key="o_orderkey", answers=folder).drop("_extra")


@query("batch_transform_fallback", "dirty_orders", """
SELECT o_orderkey, o_custkey, OrderStatus, order_priority, total_price, 'passed' AS _batch_status, 2::INT AS _attempts,
  'no JSON in the answer' AS _error, NULL::VARCHAR AS _unparsed FROM dirty_orders""")
def batch_transform_fallback(spark, sf_dir):
    passed = batches.transform_batches(view(spark, sf_dir, "dirty_orders"), lambda payload, note: "no", "any")
    return passed.drop("_extra")


def flag_cheap(payload: str, instruction: str) -> str:
    """A transformer that adds a key to some rows and drops one from all."""
    rows = json.loads(payload)
    for row in rows:
        del row["o_custkey"]
        if row["total_price"] is not None and row["total_price"] < 100000:
            row["cheap"] = "yes"
    return json.dumps(rows)


@query("batch_union_keys", "dirty_orders", """
SELECT o_orderkey, NULL::BIGINT AS o_custkey, OrderStatus, order_priority, total_price,
  CASE WHEN total_price < 100000 THEN 'yes' END AS cheap FROM dirty_orders""")
def batch_union_keys(spark, sf_dir):
    flagged = batches.transform_batches(view(spark, sf_dir, "dirty_orders"), flag_cheap, "flag")
    return batches.extra_columns(flagged).drop("_batch_status", "_attempts", "_error", "_unparsed")


@query("clean_table", "dirty_orders", f"""
SELECT o_orderkey, o_custkey, trim(OrderStatus, {{WS}}) AS OrderStatus,
  CASE WHEN o_orderkey // 20 % 7 = 0 THEN trim(order_priority, {{WS}}) ELSE upper(trim(order_priority, {{WS}})) || '!' END AS order_priority,
  total_price, CASE WHEN o_orderkey // 20 % 7 = 0 THEN 'passed' ELSE 'ok' END AS _batch_status
FROM (SELECT DISTINCT * FROM dirty_orders)""")
def clean_table(spark, sf_dir):
    cleaned = clean(
        view(spark, sf_dir, "dirty_orders"), "Remove exact duplicate rows", unreliable_upper, key="o_orderkey"
    )
    return cleaned.drop("_attempts", "_error", "_unparsed", "_extra")


@query("clean_native", "dirty_orders", """
SELECT o_orderkey, o_custkey, CASE WHEN s IS NULL OR s IN ('', '-') THEN 'N/A' ELSE s END AS OrderStatus,
  CASE WHEN p IS NULL OR p IN ('', '-', 'N/A') THEN 'N/A' ELSE p END AS order_priority, total_price
FROM (SELECT *, trim(OrderStatus, {WS}) AS s, trim(order_priority, {WS}) AS p FROM dirty_orders)""")
def clean_native(spark, sf_dir):
    """An instruction of a known class runs as a native action."""
    return clean(view(spark, sf_dir, "dirty_orders"), routing.INSTRUCTIONS["missing"])
