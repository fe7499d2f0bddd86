"""Apply a user's text-to-text transformer to rows in batches, with validation and retry.

Spark encodes rows as JSON, the Python worker only joins up to 20 of them and calls the transformer,
and Spark extracts, checks and decodes the answer. Everything is one pass without a shuffle, unless
batches must be formed by a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count, groupby, islice
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from burnish.functions.jsontext import array_items, extract_json, unwrap_json_list, validate_batch
from burnish.operators.actions import nan_to_null
from burnish.operators.answers import AnswerLog, answer_log
from burnish.operators.columns import col, quoted
from burnish.sources.shared import written

BATCH_SIZE = 20  # fixed value: rows per call
CALLS_PER_PACK = 32  # answers per Arrow batch that leaves a worker
HOT_BATCHES = 1000  # rows of an id with more batches than this are ranked across tasks; batches are the same
MOST_EXTRA = 500  # returned keys that become columns of their own
RETRY_NOTE = "The last answer could not be used. Answer with one JSON list that has {n} items."

# Microseconds and an offset, so passed-through rows come back unchanged.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "dateFormat": "yyyy-MM-dd",
}

Transformer = Callable[[str, str], str]

_BATCH_SCHEMA = (
    "rows array<string>, n int, raw string, failure string, payload string, attempts int"
)
_ARROW = pa.schema(
    [
        ("rows", pa.list_(pa.string())),
        ("n", pa.int32()),
        ("raw", pa.string()),
        ("failure", pa.string()),
        ("payload", pa.string()),
        ("attempts", pa.int32()),
    ]
)


def row_json(df: DataFrame) -> Column:
    """The row as a JSON object, nulls kept."""
    return F.to_json(F.struct(*[col(c) for c in df.columns]), JSON_OPTIONS)


def to_json_records(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One JSON object per row in ``record``, next to the columns in ``keep``; NaN becomes null."""
    clean = nan_to_null(df)
    return clean.select(*[col(k) for k in keep or []], row_json(clean).alias("record"))


def batch_payloads(df: DataFrame, key: str, batch_size: int = BATCH_SIZE) -> DataFrame:
    """(batch_id, part, n_rows, payload): JSON arrays of at most ``batch_size`` rows.

    ``batch_id`` is ``key div batch_size``, null for null keys. The rows of an id, in the order of their
    JSON, are cut into parts of ``batch_size``; so batches depend neither on the size of the table nor on
    how it is stored. Each task reads its rows in order and holds one batch at a time.
    """
    return _keyed_rows(df, key, batch_size).mapInArrow(
        _chunker(batch_size), "batch_id long, part int, n_rows int, payload string"
    )


def _keyed_rows(df: DataFrame, key: str, batch_size: int) -> DataFrame:
    # Whole-number division that rounds down, exact for all keys.
    number = f"cast({quoted(key)} as bigint)"
    batch_id = F.expr(f"({number} - pmod({number}, {batch_size}L)) div {batch_size}L")
    records = to_json_records(df, [key]).select(batch_id.alias("batch_id"), "record")
    counts = df.select(batch_id.alias("batch_id")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    large = written(counts.where(F.col("n") > HOT_BATCHES * batch_size).select("batch_id"), "large-ids")
    rows = records.withColumn("cut", F.lit(0).cast("long"))
    if not large.isEmpty():
        other = large.withColumnRenamed("batch_id", "_large")
        same = F.col("batch_id").eqNullSafe(F.col("_large"))
        ranked = _ranked(records.join(other, same, "left_semi"), batch_size)
        rows = rows.join(other, same, "left_anti").unionByName(ranked)
    return rows.repartition("batch_id", "cut").sortWithinPartitions("batch_id", "cut", "record")


def _ranked(records: DataFrame, batch_size: int) -> DataFrame:
    """Rows of ids that may fill many tasks, with the number of their batch in ``cut``.

    Ranges of (id, record) are sorted by different tasks. A row's rank is its place in its range plus the
    rows of its id in the ranges before.
    """
    order = ["batch_id", "record"]
    ordered = records.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ordered.withColumn("place", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("range", F.shiftright("place", 33))
    starts = placed.groupBy("batch_id", "range").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("batch_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    starts = written(starts.withColumnRenamed("batch_id", "_id").withColumnRenamed("range", "_range"), "starts")
    same = F.col("batch_id").eqNullSafe(F.col("_id")) & (F.col("range") == F.col("_range"))
    rank = F.col("before") + F.col("place") - F.col("start")
    return placed.join(starts, same).select("batch_id", "record", F.floor(rank / batch_size).alias("cut"))


def _keyed_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    for batch in batches:
        records = batch.column("record").to_pylist()
        if "batch_id" in batch.schema.names:
            ids = zip(batch.column("batch_id").to_pylist(), batch.column("cut").to_pylist(), strict=True)
        else:
            ids = ((None, None) for _ in records)
        yield from zip(ids, records, strict=True)


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[tuple, int, list[str]]]:
    """(id, part, rows) in input order; a new batch starts at a new id or after ``size`` rows."""
    for batch_id, group in groupby(_keyed_records(batches), key=itemgetter(0)):
        records = (record for _, record in group)
        for part in count():
            rows = list(islice(records, size))
            if not rows:
                break
            yield batch_id, part, rows


def _chunker(size: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (batch_id, cut), part, rows in _grouped(batches, size):
            yield pa.RecordBatch.from_pydict(
                {
                    "batch_id": pa.array([batch_id], pa.int64()),
                    "part": pa.array([cut + part], pa.int32()),
                    "n_rows": pa.array([len(rows)], pa.int32()),
                    "payload": pa.array([_as_array(rows)], pa.string()),
                }
            )

    return chunks


def _as_array(rows: list[str]) -> str:
    return "[" + ",".join(rows) + "]"


def _call(fn: Transformer, rows: list[str], instruction: str, attempt: int, log: AnswerLog | None) -> tuple[str | None, str | None]:
    """(answer, failure) of one call. Any error of the transformer is a failed attempt, which is not kept."""
    payload = _as_array(rows)
    if log and (kept := log.find(payload, instruction, attempt)) is not None:
        return kept, None
    try:
        answer = str(fn(payload, instruction))
    except Exception as error:  # noqa: BLE001
        return None, f"{type(error).__name__}: {error}"
    if log:
        log.keep(payload, instruction, attempt, answer)
    return answer, None


def _table(calls: list[tuple]) -> pa.RecordBatch:
    """Arrow batch of (rows, raw, failure, payload, attempts)."""
    rows, raw, failure, payload, attempts = map(list, zip(*calls, strict=True))
    values = {
        "rows": rows, "n": [len(r) for r in rows], "raw": raw, "failure": failure, "payload": payload,
        "attempts": attempts,
    }
    return pa.RecordBatch.from_pydict(values, schema=_ARROW)


def _packed(calls: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Answers leave the worker in packs, as they come."""
    while pack := list(islice(calls, CALLS_PER_PACK)):
        yield _table(pack)


def _first_call(fn: Transformer, instruction: str, size: int, log: AnswerLog | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def calls():
            for _, _, rows in _grouped(batches, size):
                raw, failure = _call(fn, rows, instruction, 1, log)
                yield rows, raw, failure, None, 1

        yield from _packed(calls())

    return run


def _next_call(fn: Transformer, instruction: str, log: AnswerLog | None):
    def again(item: dict) -> tuple:
        stricter = f"{instruction}\n\n{RETRY_NOTE.format(n=item['n'])}"
        raw, failure = _call(fn, item["rows"], stricter, item["attempts"] + 1, log)
        return item["rows"], raw, failure, None, item["attempts"] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_calls = batch.column("payload").is_null()
            done = batch.filter(pc.invert(open_calls))
            if done.num_rows:
                yield done.cast(_ARROW)
            yield from _packed(again(item) for item in batch.filter(open_calls).to_pylist())

    return run


def _checked(calls: DataFrame) -> DataFrame:
    """Fill ``payload`` where the last answer holds a JSON array of the right length, else ``failure``."""
    found = calls.withColumn("_found", extract_json(F.col("raw")))
    found = found.withColumn("_list", unwrap_json_list(F.col("_found")))
    fits = validate_batch(F.col("_list"), F.col("n"))
    length = F.json_array_length("_list")
    problem = (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("_found").isNull(), F.lit("no JSON in the answer"))
        .when(length.isNull(), F.lit("the answer is not a list"))
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(" rows expected, got "), length.cast("string")))
    )
    done = F.col("payload").isNotNull()
    return found.select(
        "rows",
        "n",
        F.lit(None).cast("string").alias("raw"),
        F.when(~done & ~fits, problem).alias("failure"),
        F.when(done, F.col("payload")).when(fits, F.col("_list")).alias("payload"),
        "attempts",
    )


def transform_batches(
    df: DataFrame,
    fn: Transformer,
    instruction: str,
    *,
    batch_size: int = BATCH_SIZE,
    retries: int = 1,
    key: str | None = None,
    schema: T.StructType | str | None = None,
    on_failure: str = "pass",
    answers: str | None = None,
) -> DataFrame:
    """``fn(json_array_of_rows, instruction) -> text`` for batches of rows.

    The text may wrap the JSON in prose or fences. It must hold a list with as many items as the
    batch; otherwise the call is repeated up to ``retries`` times with a stricter instruction. A
    batch that still fails keeps its rows unchanged (``on_failure='pass'``) or fails the query
    ('fail'). Added columns: ``_batch_status`` (ok, passed), ``_attempts``, ``_error``, ``_unparsed``,
    the JSON of rows in which a value does not fit ``schema`` (default: the input's schema), and
    ``_extra``, a map of returned keys that ``schema`` does not have (see :func:`extra_columns`).

    Batches are cut from each partition as it is read. With ``key``, an integer column, rows with
    the same ``key div batch_size`` form a batch, which makes batches repeatable at the price of
    one shuffle. Spark may run a task again, so ``fn`` should give equal answers to equal calls; if
    answers depend on which rows share a batch and the input comes out of a shuffle, use ``key``.

    ``answers`` is a folder that all executors reach. Each answer is kept there at once, under a hash of the batch,
    the instruction and the number of the attempt, so a batch that was answered is not sent again when its task, the
    job or a later run repeats it; equal batches share an answer. Errors are not kept, unusable answers are. A folder
    belongs to one transformer; take a new one for fresh answers.
    """
    if on_failure not in ("pass", "fail"):
        raise ValueError("on_failure must be 'pass' or 'fail'")
    log = answer_log(df.sparkSession, answers) if answers else None
    rows = to_json_records(df) if key is None else _keyed_rows(df, key, batch_size)
    calls = rows.mapInArrow(_first_call(fn, instruction, batch_size, log), _BATCH_SCHEMA)
    state = _checked(calls)
    for _ in range(retries):
        state = _checked(state.mapInArrow(_next_call(fn, instruction, log), _BATCH_SCHEMA))
    passed = F.col("payload").isNull()
    items = F.when(passed, F.col("rows")).otherwise(array_items(F.col("payload")))
    if on_failure == "fail":
        items = F.when(passed, F.raise_error(F.col("failure")).cast("array<string>")).otherwise(items)
    exploded = state.select(
        F.explode(items).alias("record"),
        F.when(passed, "passed").otherwise("ok").alias("_batch_status"),
        F.col("attempts").alias("_attempts"),
        F.col("failure").alias("_error"),
    )
    return _decoded(exploded, _result_schema(df, schema))


def _result_schema(df: DataFrame, schema: T.StructType | str | None) -> T.StructType:
    if schema is None:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _decoded(exploded: DataFrame, schema: T.StructType) -> DataFrame:
    with_rest = T.StructType([*schema.fields, T.StructField("_unparsed", T.StringType(), True)])
    options = {**JSON_OPTIONS, "columnNameOfCorruptRecord": "_unparsed"}
    parsed = F.from_json("record", with_rest, options).alias("_row")
    status = ["_batch_status", "_attempts", "_error"]
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    has_more = F.size(F.array_except(F.json_object_keys("record"), known)) > 0
    extra = F.map_filter(
        F.from_json("record", "map<string,string>"), lambda k, _: ~F.array_contains(known, k)
    )
    return exploded.select(parsed, *status, F.when(has_more, extra).alias("_extra")).select(
        *[F.col("_row")[f.name].alias(f.name) for f in schema.fields],
        *status,
        F.col("_row")["_unparsed"].alias("_unparsed"),
        "_extra",
    )


def extra_columns(result: DataFrame, keys: list[str] | None = None, most: int = MOST_EXTRA) -> DataFrame:
    """Turn the keys in ``_extra`` into text columns, null where a row has no such key.

    Without ``keys`` they are found first; the result is written to the shared folder for that, so the
    transformer is not called again. If there are more than ``most`` different keys, as a transformer may invent
    them, the frequent ones become columns and all others stay in ``_extra``, so nothing is lost. A sketch of
    10 * ``most`` keys tells which keys are frequent for certain, at most ``most`` of them. The driver gets
    at most ``most`` + 1 keys.
    """
    if keys is not None:
        return result.withColumns({k: F.try_element_at("_extra", F.lit(k)) for k in keys}).drop("_extra")
    result = written(result, "batches")
    each = result.select(F.explode(F.map_keys("_extra")).alias("key"))
    some = [row["key"] for row in each.distinct().limit(most + 1).collect()]
    if len(some) <= most:
        return extra_columns(result, sorted(some))
    top = each.agg(F.expr(f"approx_top_k(key, {most}, {10 * most})").alias("top")).select(F.inline("top")).collect()
    keys = sorted(row["item"] for row in top)
    made = result.withColumns({k: F.try_element_at("_extra", F.lit(k)) for k in keys})
    rest = F.map_filter("_extra", lambda k, _: ~k.isin(*keys) if keys else F.lit(True))
    return made.withColumn("_extra", F.when(F.size(rest) > 0, rest))


def explode_payloads(payloads: DataFrame, schema: T.StructType | str, column: str = "payload") -> DataFrame:
    """Rows of JSON arrays as a table."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    listed = F.from_json(F.col(column), T.ArrayType(target), JSON_OPTIONS)
    return payloads.select(F.inline(listed))


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all tables; columns are the union in first-seen order, absent cells are null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
