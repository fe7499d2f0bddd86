import json

import pytest
from pyspark.sql import functions as F

from burnish.operators import actions, lookup, review
from burnish.operators.kinds import column_kinds
from burnish.operators.suggestions import normalize_suggestions
from burnish.sources import shared

PEOPLE = [("  Alice  ", " Engineer ", 10), ("\tBob\n", "   ", 20), (None, "Manager", 30)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "name string, title string, score long")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_trim_keeps_blanks_nulls_and_numbers(people):
    assert rows(actions.trim_strings(people)) == rows_of(("Alice", "Engineer", 10), ("Bob", "", 20), (None, "Manager", 30))
    assert rows(actions.trim_to_missing(people)) == rows_of(
        ("Alice", "Engineer", 10), ("Bob", None, 20), (None, "Manager", 30)
    )


def rows_of(*values):
    return sorted(values, key=repr)


def test_idempotent(people):
    for action in (actions.trim_to_missing, actions.drop_exact_duplicates, actions.fill_missing):
        once = action(people)
        assert rows(action(once)) == rows(once)


def test_fill_missing(spark):
    frame = spark.createDataFrame([(None, None), (" Unknown ", 1), ("-", 2), ("x ", 3)], "s string, n int")
    assert rows(actions.fill_missing(frame)) == rows_of(("N/A", None), ("N/A", 1), ("N/A", 2), ("x ", 3))


def test_duplicates_with_nulls_and_maps(spark):
    frame = spark.createDataFrame(
        [(None, {"a": 1, "b": 2}), (None, {"b": 2, "a": 1}), ("x", None), ("x", None)],
        "s string, m map<string,int>",
    )
    assert actions.drop_exact_duplicates(frame).count() == 2


def test_headers_are_unique():
    names = [" Full Name ", "Full-Name", "full_name", "!!!", "Full Name_2"]
    assert actions.unique_snake_names(names) == ["full_name", "full_name_2", "full_name_3", "column_4", "full_name_2_2"]


def test_odd_column_names(spark):
    frame = spark.createDataFrame([(" a", 1.0)], "`a.b` string, `c``d` double")
    assert actions.trim_strings(frame).first()[0] == "a"
    assert actions.normalize_headers(frame).columns == ["a_b", "c_d"]
    assert actions.canonical_case(frame).first()[0] == " a"


@pytest.fixture(params=["broadcast", "spread"])
def join_way(request, monkeypatch):
    if request.param == "spread":
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", -1)
    return request.param


def test_canonical_case(spark, join_way):
    # 'Hot' fills a third of the table, null another part.
    cells = ["Hot"] * 100 + ["HOT "] * 5 + ["b", "B"] + ["c"] * 3 + [None] * 60
    frame = spark.createDataFrame(list(enumerate(cells)), "id int, v string")
    result = actions.canonical_case(frame)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert ("_salt" in plan) == (join_way == "spread")
    expected = [(i, {"HOT ": "Hot", "b": "B"}.get(c, c)) for i, c in enumerate(cells)]
    assert rows(result) == rows_of(*expected)


def test_clean_columns_are_not_joined(spark):
    frame = spark.createDataFrame([("a", "x"), ("b", "X")], "p string, q string")
    plan = actions.canonical_case(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1


def test_value_map_review_and_audit(spark, join_way):
    frame = spark.createDataFrame(
        [(1, "ux", "rome"), (2, "uix", "rome"), (3, "dev", None), (4, None, "oslo")], "id int, job string, city string"
    )
    proposals = spark.createDataFrame(
        [
            ("job", "ux", "UX", 0.98), ("job", "ux", "Ux", 0.80), ("job", "uix", "UI", 0.95),
            ("city", "rome", "Rome", 0.80), ("city", "oslo", "Oslo", 0.5), ("gone", "x", "y", 1.0),
        ],
        "column string, old_value string, new_value string, confidence double",
    )
    proposed = review.attach_proposals(frame, proposals)
    after = review.apply_accepted(proposed)
    assert rows(after) == rows_of((1, "UX", "rome"), (2, "UI", "rome"), (3, "dev", None), (4, None, "oslo"))
    queue = review.review_queue(proposed).orderBy("id").collect()
    assert [(r.id, [(p.column, p.new_value) for p in r.review]) for r in queue] == [
        (1, [("city", "Rome")]), (2, [("city", "Rome")])
    ]
    log = review.audit_log(frame, after, ["id"], "map")
    assert rows(log.drop("source")) == rows_of((1, "cell", "job", "ux", "UX"), (2, "cell", "job", "uix", "UI"))


@pytest.mark.parametrize("stored", [False, True])
def test_audit_of_keys(spark, stored, join_way):
    before = spark.createDataFrame(
        [(1, "a"), (2, "b"), (2, "b"), (3, "c"), (3, "d"), (4, None), (6, "f"), (None, "n")], "k int, v string"
    )
    after = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "c"), (4, "x"), (5, "e"), (6, "f"), (None, "m")], "k int, v string"
    )
    assert rows(review.audit_log(before, after, ["k"], stored=stored).drop("source")) == rows_of(
        (2, "copies", None, "2", "1"),
        (3, "ambiguous", None, "2", "1"),
        (4, "cell", "v", None, "x"),
        (5, "added", None, "0", "1"),
        (None, "cell", "v", "n", "m"),
    )
    gone = review.audit_log(before.where("k = 1"), before.where("k = 9"), ["k"]).drop("source")
    assert rows(gone) == [(1, "removed", None, "1", "0")]


def test_audit_projection(people):
    changes = {"name": F.trim("name"), "title": F.col("title")}
    log = review.audit_projection(people, ["score"], changes, "trim")
    assert rows(log) == [(10, "name", "  Alice  ", "Alice", "trim")]


def test_column_kinds(spark):
    frame = spark.range(200).selectExpr(
        "id AS user_id", "'2024-01-05' AS day", "concat('Person Name ', id) AS person",
        "if(id % 2 = 0, 'paid', 'open') AS status", "id / 7 AS amount", "CAST(NULL AS string) AS nothing",
        "concat(repeat('word ', 30), id) AS story",
    )
    for exact in (False, True):
        kinds = {r.column: r.kind for r in column_kinds(frame, exact).collect()}
        assert kinds == {
            "user_id": "identifier", "day": "date", "person": "name", "status": "category_text",
            "amount": "float", "nothing": "empty", "story": "text",
        }


def test_normalize_suggestions_strips(spark):
    frame = spark.createDataFrame(
        [(" Odd units ", " Low", "x")], "issue_description string, priority string, resolution_prompt string"
    )
    row = normalize_suggestions(frame).first()
    assert (row.issue_description, row.priority) == ("Odd units", "Low")
    assert "Odd units" in row.resolution_prompt


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared.new_path(spark, "test").startswith(f"{folder}/burnish-{shared.RUN}-test-")
    assert shared.written(spark.range(3), "test").count() == 3


def test_row_actions_work_on_streams(spark, tmp_path, people):
    people.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(people.schema).parquet(f"{tmp_path}/in")
    run = (
        actions.fill_missing(actions.trim_strings(stream))
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/progress")
        .trigger(availableNow=True)
        .start(f"{tmp_path}/out")
    )
    run.awaitTermination(120)
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows_of(
        ("Alice", "Engineer", 10), ("Bob", "N/A", 20), ("N/A", "Manager", 30)
    )
    assert json.dumps(run.lastProgress["numInputRows"]) in ("3", "0")
