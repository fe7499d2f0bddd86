"""Registered queries: quality checks, score, profile, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.functions.text import priority_from_ratio, snake_case
from burnish.operators import profile, quality
from burnish.plans import analyze, growing
from burnish.sources.shared import new_path
from workload.checksql import facts_sql, score_sql
from workload.registry import query
from workload.views import view

ORDERS = ["o_orderkey", "o_custkey", "OrderStatus", "order_priority", "total_price"]
ORDERS_TEXT = ["OrderStatus", "order_priority"]
DOCUMENTS = ["doc_id", "text", "Lang", "source", "n_chars"]
LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query("quality_score", "dirty_orders", score_sql("dirty_orders", ORDERS, ORDERS_TEXT))
def quality_score(spark, sf_dir):
    return quality.quality_score(view(spark, sf_dir, "dirty_orders"))


@query("quality_score_growing", "dirty_orders", score_sql("dirty_orders", ORDERS, ORDERS_TEXT))
def quality_score_growing(spark, sf_dir):
    """The score after each of three appends; the last one comes from stored counts and the newest files."""
    folder, store, orders = new_path(spark, "growing"), new_path(spark, "counts"), view(spark, sf_dir, "dirty_orders")
    for part in range(3):
        orders.where(F.col("o_orderkey") % 3 == part).write.mode("append").parquet(folder)
        score = growing.quality_score(spark, folder, store)
    return score


@query("quality_score_exact", "dirty_orders", score_sql("dirty_orders", ORDERS, ORDERS_TEXT))
def quality_score_exact(spark, sf_dir):
    return quality.quality_score(view(spark, sf_dir, "dirty_orders"), exact=True)


@query("quality_score_leading", "dirty_customer", score_sql(
    "dirty_customer", ["c_custkey", "FullName", "mkt_segment", "c_acctbal", "c_nationkey"], ["FullName", "mkt_segment"], "leading"))
def quality_score_leading(spark, sf_dir):
    return quality.quality_score(view(spark, sf_dir, "dirty_customer"), edge="leading")


@query("quality_score_skewed", "skewed_orders", score_sql("skewed_orders", ["order_id", "status"], ["status"]))
def quality_score_skewed(spark, sf_dir):
    return quality.quality_score(view(spark, sf_dir, "skewed_orders"))


@query("quality_score_documents", "dirty_documents", score_sql("dirty_documents", DOCUMENTS, ["text", "Lang", "source"]))
def quality_score_documents(spark, sf_dir):
    return quality.quality_score(view(spark, sf_dir, "dirty_documents"))


@query("quality_score_lineitem", "", score_sql("lineitem", LINEITEM, ["l_returnflag", "l_linestatus"]))
def quality_score_lineitem(spark, sf_dir):
    return quality.quality_score(view(spark, sf_dir, "lineitem"))


@query("quality_score_nested", "", score_sql("embeddings", ["vec_id", "embedding", "label"], []).replace(
    "marks AS ()", "marks AS (SELECT false AS edge, false AS varies)"))
def quality_score_nested(spark, sf_dir):
    """A table with an array column is compared row by row."""
    return quality.quality_score(view(spark, sf_dir, "embeddings"))


@query("check_quality", "dirty_orders", f"""
WITH {facts_sql("dirty_orders", ORDERS, ORDERS_TEXT)}
SELECT (row_number() OVER (ORDER BY ord) - 1)::INT AS position, check_id, columns, ratio, priority, penalty FROM (
  SELECT 0 AS ord, 'missing' AS check_id, '' AS columns, missing_ratio AS ratio, p_missing AS penalty,
    CASE WHEN missing_ratio >= 0.15 THEN 'High' WHEN missing_ratio >= 0.05 THEN 'Medium' ELSE 'Low' END AS priority FROM scored
  UNION ALL SELECT 1, 'duplicate', '', duplicate_ratio, p_duplicate,
    CASE WHEN duplicate_ratio >= 0.10 THEN 'High' WHEN duplicate_ratio >= 0.02 THEN 'Medium' ELSE 'Low' END FROM scored
  UNION ALL SELECT 2, 'header', (SELECT names FROM heads), NULL, p_header, 'Medium' FROM scored
  UNION ALL SELECT 3, 'whitespace', (SELECT string_agg(name, ',' ORDER BY position) FROM marks WHERE edge), NULL, p_whitespace, 'Medium' FROM scored
  UNION ALL SELECT 4, 'casing', (SELECT string_agg(name, ',' ORDER BY position) FROM marks WHERE varies), NULL, p_case,
    CASE WHEN n_case = 1 THEN 'Low' ELSE 'Medium' END FROM scored) WHERE penalty > 0""")
def check_quality(spark, sf_dir):
    found = quality.check_quality(view(spark, sf_dir, "dirty_orders"))
    return found.select(
        "position", "check_id", F.array_join("columns", ",").alias("columns"), "ratio", "priority", "penalty"
    )


@query("whitespace_columns", "dirty_orders", f"""
WITH {facts_sql("dirty_orders", ORDERS, ORDERS_TEXT)}
SELECT name AS "column", filled AS filled_cells FROM marks WHERE edge""")
def whitespace_columns(spark, sf_dir):
    flags = quality.column_flags(view(spark, sf_dir, "dirty_orders"))
    return flags.where("edge_whitespace").select("column", "filled_cells")


@query("case_inconsistent_columns", "dirty_documents", f"""
WITH {facts_sql("dirty_documents", DOCUMENTS, ["text", "Lang", "source"])}
SELECT name AS "column", filled AS filled_cells, forms AS normal_forms FROM marks WHERE varies""")
def case_inconsistent_columns(spark, sf_dir):
    flags = quality.column_flags(view(spark, sf_dir, "dirty_documents"))
    return flags.where("mixed_casing").select("column", "filled_cells", "normal_forms")


@query("edge_whitespace_cells", "dirty_orders", """
SELECT o_orderkey, 'OrderStatus' AS "column", OrderStatus AS cell FROM dirty_orders WHERE OrderStatus <> trim(OrderStatus, {WS})
UNION ALL
SELECT o_orderkey, 'order_priority', order_priority FROM dirty_orders WHERE order_priority <> trim(order_priority, {WS})""")
def edge_whitespace_cells(spark, sf_dir):
    return quality.edge_whitespace_cells(view(spark, sf_dir, "dirty_orders"), ["o_orderkey"])


@query("header_issues", "dirty_orders", """
SELECT 2::INT AS position, 'OrderStatus' AS "column", 'orderstatus' AS snake_name, count(OrderStatus) AS filled_cells
FROM dirty_orders""")
def header_issues(spark, sf_dir):
    return profile.header_issues(view(spark, sf_dir, "dirty_orders"))


@query("snake_case", "", """
SELECT page_id, lower(trim(regexp_replace(trim(url, {WS}), '[^0-9a-zA-Z]+', '_', 'g'), '_')) AS name FROM pages""")
def snake_case_names(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", snake_case(F.col("url")).alias("name"))


@query("priority_from_ratio", "dirty_orders", """
SELECT o_custkey, ratio, CASE WHEN ratio >= 0.15 THEN 'High' WHEN ratio >= 0.05 THEN 'Medium' ELSE 'Low' END AS priority
FROM (SELECT o_custkey, (count(*) - count(OrderStatus))::DOUBLE / count(*) AS ratio FROM dirty_orders GROUP BY o_custkey)""")
def priority(spark, sf_dir):
    missing = F.count_if(F.col("OrderStatus").isNull()) / F.count(F.lit(1))
    per_customer = view(spark, sf_dir, "dirty_orders").groupBy("o_custkey").agg(missing.alias("ratio"))
    return per_customer.withColumn("priority", priority_from_ratio(F.col("ratio"), 0.05, 0.15))


_MISSING_CELLS = "sum((OrderStatus IS NULL)::INT + (order_priority IS NULL)::INT + (total_price IS NULL)::INT)"


@query("table_profile", "dirty_orders", f"""
SELECT count(*) AS row_count, 5::BIGINT AS column_count, count(*) * 5 AS total_cells,
       {_MISSING_CELLS}::BIGINT AS missing_cells, round({_MISSING_CELLS}::DOUBLE / (count(*) * 5), 4) AS missing_cell_ratio,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS duplicate_rows,
       round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)))::DOUBLE / count(*), 4) AS duplicate_row_ratio
FROM dirty_orders""")
def table_profile(spark, sf_dir):
    return profile.table_profile(view(spark, sf_dir, "dirty_orders"))


_DUPLICATES = """SELECT n AS row_count, d AS distinct_rows, n - d AS duplicate_rows, (n - d)::DOUBLE / greatest(n, 1) AS duplicate_ratio
FROM (SELECT (SELECT count(*) FROM {0}) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {0})) AS d)"""


@query("duplicate_stats", "dirty_orders", _DUPLICATES.format("dirty_orders"))
def duplicate_stats(spark, sf_dir):
    return profile.duplicate_stats(view(spark, sf_dir, "dirty_orders"))


@query("duplicate_stats_skewed", "skewed_orders", _DUPLICATES.format("skewed_orders"))
def duplicate_stats_skewed(spark, sf_dir):
    return profile.duplicate_stats(view(spark, sf_dir, "skewed_orders"))


@query("profile_columns", "dirty_orders", """
SELECT position::INT AS position, "column", dtype, n AS row_count, missing AS missing_cells, missing::DOUBLE / n AS missing_ratio, lo AS min, hi AS max FROM (
  SELECT 0 AS position, 'o_orderkey' AS "column", 'int64' AS dtype, count(*) AS n, 0 AS missing, min(o_orderkey)::DOUBLE AS lo, max(o_orderkey)::DOUBLE AS hi FROM dirty_orders
  UNION ALL SELECT 1, 'o_custkey', 'int64', count(*), 0, min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE FROM dirty_orders
  UNION ALL SELECT 2, 'OrderStatus', 'object', count(*), count(*) - count(OrderStatus), NULL, NULL FROM dirty_orders
  UNION ALL SELECT 3, 'order_priority', 'object', count(*), count(*) - count(order_priority), NULL, NULL FROM dirty_orders
  UNION ALL SELECT 4, 'total_price', 'float64', count(*), count(*) - count(total_price), min(total_price), max(total_price) FROM dirty_orders)""")
def profile_columns(spark, sf_dir):
    found = profile.profile_columns(view(spark, sf_dir, "dirty_orders"))
    return found.drop("header_issue", "snake_name")


@query("missing_by_column", "dirty_orders", """
SELECT position::INT AS position, "column", round(ratio, 4) AS missing_ratio FROM (
  SELECT 2 AS position, 'OrderStatus' AS "column", (count(*) - count(OrderStatus))::DOUBLE / count(*) AS ratio FROM dirty_orders
  UNION ALL SELECT 3, 'order_priority', (count(*) - count(order_priority))::DOUBLE / count(*) FROM dirty_orders
  UNION ALL SELECT 4, 'total_price', (count(*) - count(total_price))::DOUBLE / count(*) FROM dirty_orders)
WHERE ratio > 0""")
def missing_by_column(spark, sf_dir):
    return profile.missing_by_column(view(spark, sf_dir, "dirty_orders"))


@query("dtype_counts", "dirty_orders", """
SELECT dtype, count(*) AS columns FROM (
  SELECT CASE WHEN count(*) > count(o_orderkey) THEN 'float64' ELSE 'int64' END AS dtype FROM dirty_orders
  UNION ALL SELECT CASE WHEN count(*) > count(o_custkey) THEN 'float64' ELSE 'int64' END FROM dirty_orders
  UNION ALL SELECT 'object' UNION ALL SELECT 'object' UNION ALL SELECT 'float64') GROUP BY dtype""")
def dtype_counts(spark, sf_dir):
    return profile.dtype_counts(view(spark, sf_dir, "dirty_orders"))


_RANGES = " UNION ALL ".join(
    f"SELECT {i}::INT AS position, '{c}' AS \"column\", CASE WHEN min({c}) = 0 THEN 0.0::DOUBLE ELSE min({c})::DOUBLE END AS min, "
    f"max({c})::DOUBLE AS max FROM lineitem"
    for i, c in enumerate(LINEITEM[:8])
)


@query("numeric_ranges", "", _RANGES)
def numeric_ranges(spark, sf_dir):
    return profile.numeric_ranges(view(spark, sf_dir, "lineitem"))


_EXAMPLES = " UNION ALL ".join(
    f"SELECT {i}::INT AS position, '{c}' AS \"column\", string_agg({c}, '|' ORDER BY o_orderkey, {c}) AS examples "
    f"FROM (SELECT o_orderkey, {c} FROM dirty_orders WHERE {c} IS NOT NULL ORDER BY o_orderkey, {c} LIMIT 3)"
    for i, c in enumerate(ORDERS_TEXT)
)


@query("text_samples", "dirty_orders", _EXAMPLES)
def text_samples(spark, sf_dir):
    found = profile.text_samples(view(spark, sf_dir, "dirty_orders"), ["o_orderkey"])
    return found.withColumn("examples", F.array_join("examples", "|"))


_SAMPLE = "SELECT *, row_number() OVER (ORDER BY md5('42|' || c_custkey))::INT AS sample_rank FROM customer"


@query("sample_rows", "", f"SELECT * FROM ({_SAMPLE}) WHERE sample_rank <= 20")
def sample_rows(spark, sf_dir):
    return profile.sample_rows(view(spark, sf_dir, "customer"), ["c_custkey"], portable=True)


@query("sample_rows_small", "", """
SELECT *, row_number() OVER (ORDER BY md5('42|' || n_nationkey))::INT AS sample_rank FROM nation""")
def sample_rows_small(spark, sf_dir):
    """Up to 50 rows are all in the sample."""
    return profile.sample_rows(view(spark, sf_dir, "nation"), ["n_nationkey"], portable=True)


@query("sample_json", "", f"""
SELECT '[' || string_agg('{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey
  || ',"c_acctbal":' || c_acctbal || ',"c_mktsegment":"' || c_mktsegment || '"}}', ',' ORDER BY sample_rank) || ']' AS sample
FROM ({_SAMPLE}) WHERE sample_rank <= 20""")
def sample_json(spark, sf_dir):
    return analyze.sample_json(view(spark, sf_dir, "customer"), ["c_custkey"], portable=True)


@query("profile_json", "dirty_orders", f"""
WITH e AS ({_EXAMPLES}),
m AS (SELECT count(*) AS n, {_MISSING_CELLS} AS missing, (count(*) - count(OrderStatus))::DOUBLE / count(*) AS m2,
  (count(*) - count(total_price))::DOUBLE / count(*) AS m4, min(o_orderkey)::DOUBLE AS a0, max(o_orderkey)::DOUBLE AS b0,
  min(o_custkey)::DOUBLE AS a1, max(o_custkey)::DOUBLE AS b1, min(total_price) AS a4, max(total_price) AS b4 FROM dirty_orders),
d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM dirty_orders))
SELECT '{{"row_count":' || n || ',"column_count":5,"missing_cell_ratio":' || round(missing::DOUBLE / (n * 5), 4)
  || ',"duplicate_row_ratio":' || round((n - k)::DOUBLE / n, 4) || ',"dtype_counts":{{"int64":2,"object":2,"float64":1}}'
  || ',"highest_missing_columns":[{{"column":"OrderStatus","missing_ratio":' || round(m2, 4) || '}},{{"column":"total_price","missing_ratio":' || round(m4, 4) || '}}]'
  || ',"text_column_samples":[' || (SELECT string_agg('{{"column":"' || "column" || '","examples":["' || replace(examples, '|', '","') || '"]}}', ',' ORDER BY position) FROM e) || ']'
  || ',"numeric_column_ranges":[{{"column":"o_orderkey","min":' || a0 || ',"max":' || b0 || '}},{{"column":"o_custkey","min":' || a1 || ',"max":' || b1
  || '}},{{"column":"total_price","min":' || a4 || ',"max":' || b4 || '}}]}}' AS profile FROM m, d""".replace("{{", "{").replace("}}", "}"))
def profile_json(spark, sf_dir):
    return analyze.profile_json(view(spark, sf_dir, "dirty_orders"), ["o_orderkey"])


_FOUND = f"""WITH {facts_sql("dirty_orders", ORDERS, ORDERS_TEXT)},
found AS (SELECT 1 AS ord, printf('%.1f%%', round_even(missing_ratio * 100, 1)) || ' of the cells in ' || n || ' rows and 5 columns are missing.' AS issue, p_missing AS p FROM scored
  UNION ALL SELECT 2, printf('%.1f%%', round_even(duplicate_ratio * 100, 1)) || ' of the rows are exact duplicates.', p_duplicate FROM scored
  UNION ALL SELECT 3, 'Some column names are not in snake_case.', p_header FROM scored
  UNION ALL SELECT 4, 'Some text columns have leading or trailing whitespace.', p_whitespace FROM scored
  UNION ALL SELECT 5, 'Some text columns use more than one casing for the same value.', p_case FROM scored)"""


def _issues(frame):
    issues = F.transform("suggestions", lambda s: s["issue_description"])
    return frame.select("quality_score", F.array_join(issues, "|").alias("issues"))


@query("suggest", "dirty_orders", _FOUND + """
SELECT quality_score, (SELECT string_agg(issue, '|' ORDER BY ord) FROM found WHERE p > 0) AS issues FROM scored""")
def suggest(spark, sf_dir):
    return _issues(quality.suggest(view(spark, sf_dir, "dirty_orders")))


@query("analyze", "dirty_orders", _FOUND + """
SELECT round_even((quality_score + 51) / 2.0, 0)::INT AS quality_score,
  'Units are mixed|' || (SELECT string_agg(issue, '|' ORDER BY ord) FROM (SELECT * FROM found WHERE p > 0 ORDER BY ord LIMIT 4)) AS issues FROM scored""")
def analysis(spark, sf_dir):
    """Own checks merged with a second opinion."""
    opinion = (
        'My view:\n```json\n{"quality_score": 51, "suggestions": [{"issue_description": " Units are mixed ", '
        '"priority": "Low", "resolution_prompt": "Convert them"}]}\n```'
    )
    return _issues(analyze.analyze(view(spark, sf_dir, "dirty_orders"), opinion))
