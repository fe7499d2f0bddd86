"""Input views: the given tables made dirty, each in Spark SQL and in the SQL of the check engine.

Both texts say the same; they differ where the engines name a function differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burnish.functions.text import WHITESPACE

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

_ORDER_CELLS = """
  o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL
       WHEN o_orderkey % 13 = 0 THEN ' ' || o_orderstatus
       WHEN o_orderkey % 17 = 0 THEN lower(o_orderstatus) || chr(9)
       ELSE o_orderstatus END AS OrderStatus,
  CASE WHEN o_orderkey % 19 = 0 THEN 'N/A'
       WHEN o_orderkey % 23 = 0 THEN '-'
       WHEN o_orderkey % 37 = 0 THEN '   '
       ELSE o_orderpriority END AS order_priority,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END AS total_price
"""

# Every 29th row comes twice.
_SPARK = {
    "dirty_orders": f"""
SELECT {_ORDER_CELLS} FROM orders
LATERAL VIEW explode(CASE WHEN o_orderkey % 29 = 0 THEN array(1, 2) ELSE array(1) END) c AS copy
""",
    # One row makes up a third of the table, and a third of the keys are the same.
    "skewed_orders": """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END AS order_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Pending' WHEN o_orderkey % 7 = 0 THEN 'PENDING '
            ELSE o_orderstatus END AS status
FROM orders
""",
    "dirty_customer": """
SELECT c_custkey, c_name AS FullName,
  CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment)
       WHEN c_custkey % 11 = 0 THEN chr(160) || c_mktsegment
       WHEN c_custkey % 13 = 0 THEN c_mktsegment || ' '
       ELSE c_mktsegment END AS mkt_segment,
  c_acctbal, c_nationkey
FROM customer
""",
    "raw_responses": """
SELECT o_orderkey AS response_id,
  CASE o_orderkey % 6
    WHEN 0 THEN '[{"k":' || o_orderkey || '}]'
    WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '[{"k":' || o_orderkey || '}]' || chr(10) || '```'
    WHEN 2 THEN '```' || chr(10) || '{"rows":[{"k":' || o_orderkey || '}]}' || chr(10) || '```'
    WHEN 3 THEN 'Result [{"k":' || o_orderkey || '}] done'
    WHEN 4 THEN 'Result {"n":1,"rows":[{"k":' || o_orderkey || '},{"k":0}]} done'
    ELSE 'no payload ' || o_orderkey END AS raw
FROM orders
""",
    "issues": """
SELECT o_orderkey AS issue_id,
  CASE o_orderkey % 6
    WHEN 0 THEN ' Some cells are blank' WHEN 1 THEN 'Duplicate rows found'
    WHEN 2 THEN 'Column names are messy' WHEN 3 THEN 'Leading or trailing characters'
    WHEN 4 THEN 'Casing differs ' ELSE 'Units are mixed' END AS issue_description,
  CASE o_orderkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN ' medium' ELSE 'Low' END AS priority,
  'Fix it' AS resolution_prompt
FROM orders
""",
    "mixed_dates": """
SELECT o_orderkey AS row_id,
  CASE o_orderkey % 6
    WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd')
    WHEN 1 THEN 'TBD'
    WHEN 2 THEN ' n/a '
    WHEN 3 THEN date_format(o_orderdate, 'MM/dd/yyyy')
    WHEN 4 THEN ' ' || date_format(o_orderdate, 'MMM d') || 'th, ' || date_format(o_orderdate, 'yyyy')
    ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END AS date_text
FROM orders
""",
    # Every cell as text, some missing, some with a token or padding.
    "text_lineitem": """
SELECT CASE WHEN l_orderkey % 10 = 0 THEN ' ' || CAST(l_orderkey AS STRING) ELSE CAST(l_orderkey AS STRING) END AS order_id,
       CASE WHEN l_partkey % 9 = 0 THEN 'NA' ELSE CAST(l_partkey AS STRING) END AS part_id,
       CAST(l_quantity AS STRING) AS quantity,
       CASE WHEN l_linenumber = 3 THEN '' WHEN l_linenumber = 4 THEN 'nan' ELSE CAST(l_discount AS STRING) END AS discount,
       CASE WHEN l_returnflag = 'A' THEN 'True' WHEN l_returnflag = 'N' THEN 'FALSE' ELSE 'false' END AS is_returned,
       CASE WHEN l_linestatus = 'F' THEN 'NULL' ELSE 'true' END AS is_open,
       CASE WHEN l_suppkey % 2 = 0 THEN 'n/a' ELSE 'None' END AS nothing,
       date_format(l_shipdate, 'yyyy-MM-dd') AS ship_date,
       CASE WHEN l_tax = 0 THEN 'exempt' ELSE CAST(l_tax AS STRING) END AS tax,
       CAST(l_extendedprice AS STRING) AS price
FROM lineitem
""",
    # Whole texts of documents, some padded with Unicode spaces or written in capitals.
    "dirty_documents": """
SELECT doc_id,
  CASE WHEN doc_id % 5 = 0 THEN '\\u3000' || text WHEN doc_id % 7 = 0 THEN text || chr(10) ELSE text END AS text,
  CASE WHEN doc_id % 4 = 0 THEN upper(lang) ELSE lang END AS Lang,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE source END AS source,
  n_chars
FROM documents
""",
    # A second opinion per customer, of changing form and validity.
    "opinions": """
SELECT c_custkey AS dataset_id, CAST(60 + c_custkey % 41 AS INT) AS quality_score,
  CASE c_custkey % 8
    WHEN 0 THEN '{"quality_score": 85, "suggestions": [{"issue_description": " Some cells are blank", "priority": "High", "resolution_prompt": "fix"}]}'
    WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || '{"analysis": {"quality_score": 70, "suggestions": []}}' || chr(10) || '```'
    WHEN 2 THEN '{"quality_score": 101, "suggestions": []}'
    WHEN 3 THEN '{"quality_score": "85", "note": "text number, no list"}'
    WHEN 4 THEN '{"quality_score": 85.5, "suggestions": []}'
    WHEN 5 THEN '{"quality_score": 40, "suggestions": [{"issue_description": "Units are mixed", "priority": 1, "resolution_prompt": "fix"}]}'
    WHEN 6 THEN '{"quality_score": 41, "suggestions": [{"issue_description": "Units are mixed", "priority": "Low", "resolution_prompt": "fix"},{"issue_description": "units are MIXED ", "priority": "low", "resolution_prompt": "fix"}]}'
    ELSE 'the model is busy' END AS raw
FROM customer
""",
    "prompts": """
SELECT c_custkey AS prompt_id,
  CASE c_custkey % 7
    WHEN 0 THEN 'Remove duplicates from ' || c_name
    WHEN 1 THEN 'Fix EXACT DUPLICATE rows of ' || c_name
    WHEN 2 THEN 'Deduplicate ' || c_name
    WHEN 3 THEN 'Keep one canonical row, no redundant copies of ' || c_name
    WHEN 4 THEN 'do not remove duplicates of ' || c_name
    WHEN 5 THEN 'Drop empty rows of ' || c_name
    ELSE 'Trim ' || c_name END AS prompt
FROM customer
""",
    "contact_cells": """
SELECT c_custkey AS row_id,
  CASE c_custkey % 4
    WHEN 0 THEN '(0' || CAST(100 + c_nationkey AS STRING) || ') 555-' || lpad(CAST(c_custkey AS STRING), 6, '0')
    WHEN 1 THEN '+49 30 ' || lpad(CAST(c_custkey AS STRING), 6, '0')
    WHEN 2 THEN '0044.20.' || lpad(CAST(c_custkey AS STRING), 6, '0')
    ELSE 'ask ' || c_name END AS phone,
  CASE c_custkey % 3
    WHEN 0 THEN CAST(c_nationkey AS STRING) || '.5%'
    WHEN 1 THEN ' ' || CAST(c_custkey AS STRING) || ' % '
    ELSE CAST(c_custkey AS STRING) END AS share
FROM customer
""",
}

# Spark function text -> check engine function text.
_RENAMED = (
    ("LATERAL VIEW explode(CASE WHEN o_orderkey % 29 = 0 THEN array(1, 2) ELSE array(1) END) c AS copy",
     ", unnest(CASE WHEN o_orderkey % 29 = 0 THEN [1, 2] ELSE [1] END) AS c(copy)"),
    ("'\\u3000'", "chr(12288)"),
    ("date_format(", "strftime("),
    ("'yyyy-MM-dd HH:mm:ss'", "'%Y-%m-%d %H:%M:%S'"),
    ("'yyyy-MM-dd'", "'%Y-%m-%d'"),
    ("'MM/dd/yyyy'", "'%m/%d/%Y'"),
    ("'MMM d'", "'%b %-d'"),
    ("'yyyy'", "'%Y'"),
    ("AS STRING", "AS VARCHAR"),
)


def check_sql(view: str) -> str:
    """The view in the check engine's SQL."""
    text = _SPARK[view]
    for ours, theirs in _RENAMED:
        text = text.replace(ours, theirs)
    return text


def with_views(select: str, *views: str) -> str:
    """``select`` over the named views; {WS} stands for the whitespace characters."""
    parts = [f"{v} AS ({check_sql(v)})" for v in views]
    body = select.replace("{WS}", whitespace_sql())
    if not parts:
        return body
    head = "WITH " + ", ".join(parts)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return head + ", " + stripped[5:]
    return head + " " + body


def whitespace_sql() -> str:
    return "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dirty view, or a given table by its name."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = _SPARK[name]
    base = next(t for t in TABLES if f"FROM {t}" in text)
    return spark.sql(text.replace(f"FROM {base}", f"FROM parquet.`{sf_dir}/{base}.parquet`"))
