"""Registered queries: cleaning actions, normalizers, column kinds, review and audit."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from burnish.functions import text, values
from burnish.operators import actions, batches, kinds, lookup, review
from burnish.operators.columns import col
from burnish.plans import artifacts, propose
from burnish.sources.shared import written
from workload.registry import query
from workload.views import view


@query("trim_strings", "dirty_documents", """
SELECT doc_id, trim(text, {WS}) AS text, trim(Lang, {WS}) AS Lang, trim(source, {WS}) AS source, n_chars FROM dirty_documents""")
def trim_strings(spark, sf_dir):
    return actions.trim_strings(view(spark, sf_dir, "dirty_documents"))


@query("nan_to_null", "", """
SELECT l_orderkey, l_linenumber, nullif(l_tax, 0)::DOUBLE AS tax_left, l_quantity / nullif(l_tax, 0) AS per_tax FROM lineitem""")
def nan_to_null(spark, sf_dir):
    rate = F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax"))
    rows = view(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", rate.alias("tax_left"), (F.col("l_quantity") / rate).alias("per_tax")
    )
    return actions.nan_to_null(rows)


@query("drop_exact_duplicates", "dirty_orders", "SELECT DISTINCT * FROM dirty_orders")
def drop_exact_duplicates(spark, sf_dir):
    return actions.drop_exact_duplicates(view(spark, sf_dir, "dirty_orders"))


@query("drop_exact_duplicates_skewed", "skewed_orders", "SELECT DISTINCT * FROM skewed_orders")
def drop_exact_duplicates_skewed(spark, sf_dir):
    return actions.drop_exact_duplicates(view(spark, sf_dir, "skewed_orders"))


def _filled(column: str) -> str:
    tokens = "'', 'null', 'na', 'n/a', '-', 'unknown'"
    return f"CASE WHEN {column} IS NULL OR lower(trim({column}, {{WS}})) IN ({tokens}) THEN 'N/A' ELSE {column} END"


@query("action_fill_missing", "dirty_orders", f"""
SELECT o_orderkey, o_custkey, {_filled("OrderStatus")} AS OrderStatus, {_filled("order_priority")} AS order_priority, total_price
FROM dirty_orders""")
def action_fill_missing(spark, sf_dir):
    return actions.fill_missing(view(spark, sf_dir, "dirty_orders"))


@query("action_headers", "dirty_orders", """
SELECT o_orderkey, o_custkey, OrderStatus AS orderstatus, order_priority, total_price FROM dirty_orders""")
def action_headers(spark, sf_dir):
    return actions.normalize_headers(view(spark, sf_dir, "dirty_orders"))


@query("action_trim", "dirty_orders", """
SELECT o_orderkey, o_custkey, nullif(trim(OrderStatus, {WS}), '') AS OrderStatus,
       nullif(trim(order_priority, {WS}), '') AS order_priority, total_price FROM dirty_orders""")
def action_trim(spark, sf_dir):
    return actions.trim_to_missing(view(spark, sf_dir, "dirty_orders"))


def _canonical(source: str, column: str) -> str:
    """CTE bodies that map every spelling of a column to its group's canonical one."""
    return f"""
n_{column} AS (SELECT {column} AS v, lower(trim({column}, {{WS}})) AS form, count(*) AS n FROM {source}
              WHERE {column} IS NOT NULL GROUP BY ALL),
c_{column} AS (SELECT v, first_value(v) OVER (PARTITION BY form ORDER BY n DESC, v) AS best FROM n_{column})"""


_CUSTOMER_CANONICAL = f"""WITH {_canonical("dirty_customer", "FullName")}, {_canonical("dirty_customer", "mkt_segment")},
fixed AS (SELECT c_custkey, a.best AS FullName, b.best AS mkt_segment, c_acctbal, c_nationkey FROM dirty_customer
  LEFT JOIN c_FullName a ON FullName = a.v LEFT JOIN c_mkt_segment b ON mkt_segment = b.v)"""


@query("action_canonical_case", "dirty_customer", _CUSTOMER_CANONICAL + " SELECT * FROM fixed")
def action_canonical_case(spark, sf_dir):
    return actions.canonical_case(view(spark, sf_dir, "dirty_customer"))


@query("action_canonical_case_skewed", "skewed_orders", f"""
WITH {_canonical("skewed_orders", "status")}
SELECT order_id, best AS status FROM skewed_orders LEFT JOIN c_status ON status = v""")
def action_canonical_case_skewed(spark, sf_dir):
    return actions.canonical_case(view(spark, sf_dir, "skewed_orders"))


@query("apply_actions", "dirty_orders", f"""
SELECT DISTINCT o_orderkey, o_custkey, {_filled("s")} AS orderstatus, {_filled("p")} AS order_priority, total_price FROM (
  SELECT *, nullif(trim(OrderStatus, {{WS}}), '') AS s, nullif(trim(order_priority, {{WS}}), '') AS p FROM dirty_orders)""")
def apply_actions(spark, sf_dir):
    return actions.apply_actions(
        view(spark, sf_dir, "dirty_orders"), ["whitespace", "missing", "duplicate", "header"]
    )


@query("json_records", "dirty_orders", """
SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey
  || ',"OrderStatus":' || coalesce('"' || replace(OrderStatus, chr(9), '\\t') || '"', 'null')
  || ',"order_priority":' || coalesce('"' || order_priority || '"', 'null')
  || ',"total_price":' || coalesce(total_price::VARCHAR, 'null') || '}' AS record FROM dirty_orders""")
def json_records(spark, sf_dir):
    return batches.to_json_records(view(spark, sf_dir, "dirty_orders"), keep=["o_orderkey"])


@query("union_by_name", "", """
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::INT AS nationkey FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier""")
def union_by_name(spark, sf_dir):
    customers = view(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = view(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")
    )
    return batches.union_by_name(customers, suppliers)


_FILE_TOKENS = ", ".join("'" + t + "'" for t in text.FILE_NULL_TOKENS)
_TEXT_COLUMNS = ("order_id", "part_id", "quantity", "discount", "is_returned", "is_open", "nothing", "ship_date", "tax", "price")
_TOKENS_TO_NULL = "SELECT " + ", ".join(
    f"CASE WHEN {c} NOT IN ({_FILE_TOKENS}) THEN {c} END AS {c}" for c in _TEXT_COLUMNS
) + " FROM text_lineitem"


@query("null_tokens_default", "text_lineitem", _TOKENS_TO_NULL)
def null_tokens_default(spark, sf_dir):
    return actions.null_tokens_to_null(view(spark, sf_dir, "text_lineitem"))


@query("null_tokens_config", "mixed_dates", """
SELECT row_id, CASE WHEN lower(trim(date_text, {WS})) NOT IN ('n/a', 'na', 'null', 'none', '-', '--', '', 'n.a.', 'nil', 'missing',
  'not available', 'not provided', 'blank', '#n/a', 'nan', 'tbd') THEN date_text END AS date_text FROM mixed_dates""")
def null_tokens_config(spark, sf_dir):
    return actions.null_tokens_to_null(
        view(spark, sf_dir, "mixed_dates"), text.CONFIG_NULL_TOKENS, folded=True
    )


@query("normalize_dates", "mixed_dates", """
SELECT row_id, CASE row_id % 6 WHEN 1 THEN 'TBD' WHEN 2 THEN ' n/a '
  WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text
FROM mixed_dates JOIN orders ON row_id = o_orderkey""")
def normalize_dates(spark, sf_dir):
    return actions.map_text(view(spark, sf_dir, "mixed_dates"), values.normalize_date)


_PERCENT = "regexp_extract(trim(share, {WS}), '^([+-]?[0-9]+(?:\\.[0-9]+)?) ?%$', 1)"


@query("percent_to_fraction", "contact_cells", f"""
SELECT row_id, share, try_cast(nullif({_PERCENT}, '') AS DOUBLE) / 100 AS fraction FROM contact_cells""")
def percent_to_fraction(spark, sf_dir):
    cells = view(spark, sf_dir, "contact_cells")
    return cells.select("row_id", "share", values.percent_to_fraction(F.col("share")).alias("fraction"))


@query("normalize_phone", "contact_cells", """
SELECT row_id, CASE row_id % 4 WHEN 3 THEN phone WHEN 1 THEN '+' || digits WHEN 2 THEN '+' || substr(digits, 3)
  ELSE '+49' || substr(digits, 2) END AS phone
FROM (SELECT row_id, phone, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM contact_cells)""")
def normalize_phone(spark, sf_dir):
    cells = view(spark, sf_dir, "contact_cells")
    return cells.select("row_id", values.normalize_phone(F.col("phone"), "49").alias("phone"))


def _kind_sql(source: str, position: int, column: str, dates: str = "0") -> str:
    cell = f"trim({column}::VARCHAR, {{WS}})"
    number = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return f"""SELECT {position}::INT AS position, '{column}' AS "column", count(*) AS row_count, count(*) - count({column}) AS missing_cells,
  count(DISTINCT {column}) AS distinct_values, min(length({cell}))::INT AS min_length, max(length({cell}))::INT AS max_length,
  CASE WHEN count({column}) = 0 THEN 'empty' WHEN {dates} >= count({column}) * 0.95 THEN 'date'
    WHEN count(DISTINCT {column}) >= count({column}) * 0.98 AND count(*) = count({column}) AND NOT bool_or(contains({cell}, ' ')) AND NOT bool_or(regexp_full_match({cell}, '[+-]?[0-9]*\\.[0-9]+')) THEN 'identifier'
    WHEN count(*) FILTER (regexp_matches({cell}, '{number}')) >= count({column}) * 0.95 THEN 'float'
    WHEN count(DISTINCT {column}) <= count({column}) * 0.05 THEN 'category_text'
    WHEN max(length({cell})) <= 60 THEN 'name' ELSE 'text' END AS kind FROM {source}"""


@query("column_kinds", "dirty_documents", " UNION ALL ".join(
    _kind_sql("dirty_documents", i, c) for i, c in enumerate(["doc_id", "text", "Lang", "source", "n_chars"])))
def column_kinds(spark, sf_dir):
    return kinds.column_kinds(view(spark, sf_dir, "dirty_documents"), exact=True, rule="share")


_BY_DEFAULT = ("position", "column", "row_count", "missing_cells", "min_length", "max_length", "kind")


@query("column_kinds_default", "dirty_documents", f"SELECT {', '.join(chr(34) + c + chr(34) for c in _BY_DEFAULT)} FROM (" + " UNION ALL ".join(
    _kind_sql("dirty_documents", i, c) for i, c in enumerate(["doc_id", "text", "Lang", "source", "n_chars"])) + ")")
def column_kinds_default(spark, sf_dir):
    """Without the counts of distinct values, which are estimates where they are far from a threshold."""
    return kinds.column_kinds(view(spark, sf_dir, "dirty_documents"), rule="share").select(*_BY_DEFAULT)


_ORDER_KIND_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "day"]


@query("column_kinds_dates", "", "WITH days AS (SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders) "
    + " UNION ALL ".join(_kind_sql("days", i, c, "count(*)" if c == "day" else "0") for i, c in enumerate(_ORDER_KIND_COLUMNS)))
def column_kinds_dates(spark, sf_dir):
    days = view(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return kinds.column_kinds(days.select(*_ORDER_KIND_COLUMNS), exact=True, rule="share")


def _drawn_kinds_sql(source: str, columns: list[str]) -> str:
    """The kinds with categories told by what 100 drawn cells are expected to hold, straight from the counts."""
    cells = " UNION ALL ".join(f"SELECT {i} AS position, {c}::VARCHAR AS v FROM {source} WHERE {c} IS NOT NULL" for i, c in enumerate(columns))
    return f"""SELECT k.* EXCLUDE (kind, distinct_values), CASE WHEN kind NOT IN ('category_text', 'name', 'text') THEN kind
    WHEN expected <= 0.5 * least(100, cells) + 1e-9 THEN 'category_text' WHEN max_length <= 60 THEN 'name' ELSE 'text' END AS kind
  FROM ({" UNION ALL ".join(_kind_sql(source, i, c) for i, c in enumerate(columns))}) k LEFT JOIN (
    SELECT position, any_value(cells) AS cells, sum(1 - list_reduce(list_prepend(1.0::DOUBLE,
      list_transform(range(least(100, cells)::BIGINT), lambda i: greatest(cells - n - i, 0)::DOUBLE / (cells - i)::DOUBLE)), lambda a, b: a * b)) AS expected
    FROM (SELECT position, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY position)::BIGINT AS cells FROM ({cells}) GROUP BY position, v)
    GROUP BY position) e ON k.position = e.position"""


@query("column_kinds_drawn", "dirty_documents", _drawn_kinds_sql("dirty_documents", ["doc_id", "text", "Lang", "source", "n_chars"]))
def column_kinds_drawn(spark, sf_dir):
    """The rule that does not depend on the number of rows; counts of distinct values are estimates and left out."""
    return kinds.column_kinds(view(spark, sf_dir, "dirty_documents")).drop("distinct_values")


@query("column_kinds_drawn_customer", "dirty_customer", _drawn_kinds_sql("dirty_customer", ["c_custkey", "FullName", "mkt_segment"]))
def column_kinds_drawn_customer(spark, sf_dir):
    customers = view(spark, sf_dir, "dirty_customer").select("c_custkey", "FullName", "mkt_segment")
    return kinds.column_kinds(customers, exact=True).drop("distinct_values")


# One proposal per lower-case segment: accept, review and reject.
_PROPOSALS_SQL = """
proposals AS (SELECT DISTINCT mkt_segment AS old_value, upper(left(mkt_segment, 1)) || substr(mkt_segment, 2) AS new_value,
  CASE ascii(mkt_segment) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.99::DOUBLE ELSE 0.8::DOUBLE END AS confidence
  FROM dirty_customer WHERE mkt_segment = lower(mkt_segment))"""


def value_map(customers):
    segment = F.col("mkt_segment")
    confidence = F.when(F.ascii(segment) % 3 == 0, 0.5).when(F.ascii(segment) % 3 == 1, 0.99).otherwise(0.8)
    new_value = F.concat(F.upper(F.left(segment, F.lit(1))), F.substring(segment, F.lit(2), F.length(segment)))
    return customers.where(segment == F.lower(segment)).select(
        F.lit("mkt_segment").alias("column"),
        segment.alias("old_value"),
        new_value.alias("new_value"),
        confidence.alias("confidence"),
    ).distinct()


@query("apply_value_map", "dirty_customer", f"""
WITH {_PROPOSALS_SQL}
SELECT c_custkey, FullName, CASE WHEN confidence >= 0.95 THEN new_value ELSE mkt_segment END AS mkt_segment, c_acctbal, c_nationkey
FROM dirty_customer LEFT JOIN proposals ON mkt_segment = old_value""")
def apply_value_map(spark, sf_dir):
    customers = view(spark, sf_dir, "dirty_customer")
    return review.apply_value_map(customers, value_map(customers))


@query("attach_skewed", "skewed_orders", """
SELECT s.order_id, s.status, p.priority FROM skewed_orders s LEFT JOIN (
  SELECT o_orderkey::VARCHAR AS key, o_orderpriority AS priority FROM orders WHERE o_orderkey % 2 = 0) p ON s.order_id::VARCHAR = p.key""")
def attach_skewed(spark, sf_dir):
    """A third of the rows has one key; joined the way that is taken where the replacements are too large to broadcast."""
    keyed = F.col("o_orderkey").cast("string").alias("_burnish_key")
    mapping = view(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(keyed, F.col("o_orderpriority").alias("priority"))
    rows = view(spark, sf_dir, "skewed_orders")
    joined = lookup.attach(rows, F.col("order_id").cast("string"), mapping, lookup.BROADCAST_BYTES + 1, "found")
    return joined.select("order_id", "status", "found.priority")


@query("review_queue", "dirty_customer", f"""
WITH {_PROPOSALS_SQL}
SELECT c_custkey, FullName, mkt_segment, c_acctbal, c_nationkey, 'mkt_segment: ' || old_value || ' -> ' || new_value AS review
FROM dirty_customer JOIN proposals ON mkt_segment = old_value WHERE confidence >= 0.75 AND confidence < 0.95""")
def review_queue(spark, sf_dir):
    customers = view(spark, sf_dir, "dirty_customer")
    queue = review.review_queue(review.attach_proposals(customers, value_map(customers)))
    described = F.transform(
        "review", lambda p: F.concat(p["column"], F.lit(": "), p["old_value"], F.lit(" -> "), p["new_value"])
    )
    return queue.withColumn("review", F.array_join(described, "; "))


@query("apply_value_map_numeric", "", """
SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey, o_orderpriority FROM orders""")
def apply_value_map_numeric(spark, sf_dir):
    """Proposals for a number column: some hold, some cannot be a number and are rejected."""
    orders = view(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    key = F.col("o_custkey")
    new_value = F.when(key % 5 == 0, (key + 1000000).cast("string")).otherwise("unknown")
    proposals = orders.select(
        F.lit("o_custkey").alias("column"), key.cast("string").alias("old_value"), new_value.alias("new_value"), F.lit(0.99).alias("confidence")
    ).where(key % 5 < 2).distinct()
    return review.apply_value_map(orders, proposals)


# Segments that a plain function would write in capitals; the short ones with less confidence.
@query("propose_and_apply", "dirty_customer", """
SELECT c_custkey, FullName, CASE WHEN length(trim(mkt_segment, {WS})) > 8 THEN upper(trim(mkt_segment, {WS})) ELSE mkt_segment END AS mkt_segment, c_acctbal, c_nationkey
FROM dirty_customer""")
def propose_and_apply(spark, sf_dir):
    customers = view(spark, sf_dir, "dirty_customer")
    proposals = propose.propose_values(customers, _capitals, "Write segments in capitals", kinds=("category_text",))
    return review.apply_value_map(customers, proposals)


def _capitals(payload: str, instruction: str) -> str:
    """Stands for a model: answers each {"old_value"} with a new value and a confidence."""
    items = [i["old_value"].strip() for i in json.loads(payload)]
    return json.dumps([{"old_value": i["old_value"], "new_value": v.upper(), "confidence": 0.99 if len(v) > 8 else 0.9} for i, v in zip(json.loads(payload), items, strict=True)])


@query("audit_log", "dirty_customer", _CUSTOMER_CANONICAL + """
SELECT b.c_custkey, 'cell' AS change, 'mkt_segment' AS "column", b.mkt_segment AS old_value, a.mkt_segment AS new_value, 'casing' AS source
FROM dirty_customer b JOIN fixed a USING (c_custkey) WHERE b.mkt_segment IS DISTINCT FROM a.mkt_segment
UNION ALL
SELECT b.c_custkey, 'cell', 'FullName', b.FullName, a.FullName, 'casing'
FROM dirty_customer b JOIN fixed a USING (c_custkey) WHERE b.FullName IS DISTINCT FROM a.FullName""")
def audit_log(spark, sf_dir):
    before = view(spark, sf_dir, "dirty_customer")
    return review.audit_log(before, actions.canonical_case(before), ["c_custkey"], "casing")


_SKEWED_AUDIT = """
SELECT order_id, 'ambiguous' AS change, NULL::VARCHAR AS "column", count(*)::VARCHAR AS old_value, count(DISTINCT status)::VARCHAR AS new_value, 'dedup' AS source
FROM skewed_orders GROUP BY order_id HAVING count(DISTINCT status) > 1
UNION ALL
SELECT order_id, 'copies', NULL, count(*)::VARCHAR, '1', 'dedup' FROM skewed_orders GROUP BY order_id
HAVING count(DISTINCT status) = 1 AND count(*) > 1"""


@query("audit_log_stored", "skewed_orders", _SKEWED_AUDIT)
def audit_log_stored(spark, sf_dir):
    """The same in two passes: fingerprints first, then the rows of changed keys."""
    before = view(spark, sf_dir, "skewed_orders")
    after = written(actions.drop_exact_duplicates(before), "deduplicated")
    return review.audit_log(before, after, ["order_id"], "dedup", stored=True)


@query("audit_log_skewed", "skewed_orders", _SKEWED_AUDIT)
def audit_log_skewed(spark, sf_dir):
    """A third of the rows have the same key: no pairs of copies are formed."""
    before = view(spark, sf_dir, "skewed_orders")
    return review.audit_log(before, actions.drop_exact_duplicates(before), ["order_id"], "dedup")


@query("audit_projection", "dirty_orders", f"""
SELECT o_orderkey, 'OrderStatus' AS "column", OrderStatus AS old_value, {_filled("OrderStatus")} AS new_value, 'missing' AS source
FROM dirty_orders WHERE OrderStatus IS DISTINCT FROM {_filled("OrderStatus")}
UNION ALL
SELECT o_orderkey, 'order_priority', order_priority, {_filled("order_priority")}, 'missing'
FROM dirty_orders WHERE order_priority IS DISTINCT FROM {_filled("order_priority")}""")
def audit_projection(spark, sf_dir):
    orders = view(spark, sf_dir, "dirty_orders")
    changes = {c: text.filled(col(c)) for c in ("OrderStatus", "order_priority")}
    return review.audit_projection(orders, ["o_orderkey"], changes, "missing")


_TIDY_SEGMENTS = """
WITH tidy AS (SELECT c_custkey, FullName AS fullname, mkt_segment AS old, trim(mkt_segment, {WS}) AS new, c_acctbal, c_nationkey FROM dirty_customer)
"""


def _artifacts(spark, sf_dir):
    return artifacts.clean_with_artifacts(view(spark, sf_dir, "dirty_customer"), ["c_custkey"], _capitals, "Write segments in capitals", ("category_text",))


@query("clean_artifacts_table", "dirty_customer", _TIDY_SEGMENTS + """
SELECT c_custkey, fullname, CASE WHEN length(new) > 8 THEN upper(new) ELSE new END AS mkt_segment, c_acctbal, c_nationkey FROM tidy""")
def clean_artifacts_table(spark, sf_dir):
    return _artifacts(spark, sf_dir).cleaned


@query("clean_artifacts_review", "dirty_customer", _TIDY_SEGMENTS + """
SELECT c_custkey, fullname, new AS mkt_segment, c_acctbal, c_nationkey, 'mkt_segment: ' || new || ' -> ' || upper(new) AS review
FROM tidy WHERE length(new) <= 8 AND new <> upper(new)""")
def clean_artifacts_review(spark, sf_dir):
    described = F.transform("review", lambda p: F.concat(p["column"], F.lit(": "), p["old_value"], F.lit(" -> "), p["new_value"]))
    return _artifacts(spark, sf_dir).review.withColumn("review", F.array_join(described, "; "))


@query("clean_artifacts_audit", "dirty_customer", _TIDY_SEGMENTS + """
SELECT c_custkey, 'cell' AS change, 'mkt_segment' AS "column", old AS old_value, new AS new_value, 'rules' AS source FROM tidy WHERE old <> new
UNION ALL
SELECT c_custkey, 'cell', 'mkt_segment', new, upper(new), 'proposals' FROM tidy WHERE length(new) > 8 AND new <> upper(new)""")
def clean_artifacts_audit(spark, sf_dir):
    return _artifacts(spark, sf_dir).audit
