import json

import pytest
from pyspark.sql import functions as F

from burnish.functions.jsontext import extract_json
from burnish.functions import jsontext
from burnish.functions.routing import INSTRUCTIONS
from burnish.operators import batches, lookup, suggestions
from burnish.plans.clean import clean


def one(spark, expression, *cells):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[1] for r in frame.select("i", expression(F.col("c"))).orderBy("i").collect()]


EXTRACTED = {
    '[{"k": 1}]': '[{"k": 1}]',
    '  {"k": 1}\n': '{"k": 1}',
    'Sure:\n```json\n[1, 2]\n```\n```json\n[3]\n```': "[1, 2]",
    "```\n{\"rows\": []}\n```": '{"rows": []}',
    "```JSON [5] ```": "[5]",
    "```json\nnot json\n``` but [1] here": "[1]",
    'Result {"n": 1, "rows": [{"k": 2}]} done': '[{"k": 2}]',
    'Result {"n": 1} done': '{"n": 1}',
    "5 apples": None,
    "5 apples [1]": "[1]",
    "[1] and [2]": None,
    '"text"': '"text"',
    "-1.5e3": "-1.5e3",
    "null": "null",
    "nothing": None,
    "": None,
    "[1,]": None,
    "1][2": None,
    '[NaN]': '[null]',
    '["a\nb"]': None,
    None: None,
}


def test_extract_json(spark):
    assert one(spark, jsontext.extract_json, *EXTRACTED) == list(EXTRACTED.values())


def test_strict_json_agrees_with_the_json_module(spark):
    texts = ['{"a": [1, {"b": null}]}', "[", "]", "{}", "[]", "true", "tru", '"a" "b"', "01", "1 2", "{'a': 1}", '"\\u00e9"']

    def valid(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    assert one(spark, jsontext.is_strict_json, *texts) == [valid(t) for t in texts]


def test_unwrap_list(spark):
    cells = ['{"z": 1, "b": [1, {"q": 2}], "a": [3]}', '[1, 2]', '{"a": 1}', '{"s": "[1]", "t": [2]}', "{}", None]
    assert one(spark, jsontext.unwrap_json_list, *cells) == ['[1,{"q":2}]', "[1, 2]", '{"a": 1}', "[2]", "{}", None]


def test_unwrap_object(spark):
    cells = ['{"analysis": {"quality_score": 1}}', '{"suggestions": []}', '{"a": 1, "b": 2}', "[1]"]
    assert one(spark, jsontext.unwrap_json_object, *cells) == ['{"quality_score":1}', *cells[1:]]


def test_validate_batch(spark):
    check = lambda c: jsontext.validate_batch(c, F.lit(2))
    assert one(spark, check, "[1, 2]", "[1]", '{"a": 1}', None) == [True, False, False, False]


S = '{"issue_description": "a", "priority": "Low", "resolution_prompt": "b"}'


@pytest.mark.parametrize(
    ("payload", "score"),
    [
        (f'{{"quality_score": 85, "suggestions": [{S}]}}', 85),
        ('{"quality_score": 85.0, "suggestions": []}', 85),
        ('{"quality_score": "85", "more": 1}', 85),
        ('{"quality_score": true, "more": 1}', 1),
        ('{"quality_score": 85.5, "suggestions": []}', None),
        ('{"quality_score": -1, "suggestions": []}', None),
        ('{"quality_score": 101, "suggestions": []}', None),
        ('{"quality_score": null, "suggestions": []}', None),
        ('{"suggestions": []}', None),
        ('{"quality_score": 5, "suggestions": null}', None),
        ('{"quality_score": 5, "suggestions": [1]}', None),
        ('{"quality_score": 5, "suggestions": [{"issue_description": "a"}]}', None),
        (f'{{"quality_score": 5, "suggestions": [{S.replace(chr(34) + "Low" + chr(34), "1")}]}}', None),
        ('{"quality_score": 5}', None),  # one key: taken for a wrapper
        ("[1]", None),
    ],
)
def test_opinions(spark, payload, score):
    frame = spark.createDataFrame([(payload,)], "raw string")
    row = suggestions.with_opinion(frame, "raw").select("opinion.quality_score").first()
    assert row[0] == score


def test_merge_keeps_the_first_five_per_key(spark):
    item = lambda t, p="Low": (t, p, "x")
    own = [item("Casing differs"), item("Some are blank", "HIGH "), item("d"), item("e"), item("f")]
    opinion = (41, [item("some are BLANK", "high"), item("z"), item(" Z ")])
    frame = spark.createDataFrame(
        [(1, 86, own, opinion), (2, 86, own, None)],
        f"id int, quality_score int, suggestions {jsontext.SUGGESTIONS_TYPE}, "
        f"opinion struct<quality_score:int,suggestions:{jsontext.SUGGESTIONS_TYPE}>",
    )
    first, second = suggestions.merge_analyses(frame).orderBy("id").collect()
    assert first.quality_score == 64  # 63.5 to even
    # ' Z ' and 'z' differ in the instruction, which quotes the issue, only by casing: one key.
    assert [s.issue_description for s in first.suggestions] == ["some are BLANK", "z", "Casing differs", "d", "e"]
    assert (second.quality_score, len(second.suggestions)) == (86, 5)
    assert second.suggestions[1].priority == "HIGH"


PEOPLE = [("  Alice  ", " Engineer ", 10), ("\tBob\n", "   ", 20), (None, "Manager", 30)]


def test_transformer_sees_trimmed_rows(spark, tmp_path):
    frame = spark.createDataFrame(PEOPLE, "name string, title string, score long").coalesce(1)
    seen = tmp_path / "seen"

    def keep(payload, instruction):
        with open(seen, "a") as log:
            log.write(payload + "\n")
        assert instruction == "normalize titles"
        return payload

    expected = [
        {"name": "Alice", "title": "Engineer", "score": 10},
        {"name": "Bob", "title": "", "score": 20},
        {"name": None, "title": "Manager", "score": 30},
    ]
    result = clean(frame, "normalize titles", keep).select("name", "title", "score").collect()
    assert [r.asDict() for r in result] == expected
    assert json.loads(seen.read_text()) == expected  # one batch, called once


def test_duplicates_go_before_the_transformer(spark):
    row = ("John Doe", "john.doe@example.com", "₹12,500")
    frame = spark.createDataFrame([row, row], "` Full Name ` string, `Email Address` string, `Amount / Score` string")
    result = clean(frame, INSTRUCTIONS["duplicate"], lambda payload, note: payload)
    assert result.columns[:3] == [" Full Name ", "Email Address", "Amount / Score"]
    assert [tuple(r)[:4] for r in result.collect()] == [(*row, "ok")]
    # No negation: this text also asks for deduplication.
    assert clean(frame, "do not remove duplicates").count() == 1
    assert clean(frame, "leave it").count() == 2


def test_batches_retry_and_pass_through(spark):
    frame = spark.range(0, 95, 1, 3)

    def moody(payload, instruction):
        rows = json.loads(payload)
        kind = rows[0]["id"] // 20
        if kind == 1 and "could not be used" not in instruction:
            return "[1]"
        if kind == 2:
            return '{"note": "no list"}'
        if kind == 3:
            raise ValueError("boom")
        return f"```json\n{json.dumps({'rows': [{'id': r['id'] + 1000} for r in rows]})}\n```"

    result = batches.transform_batches(frame, moody, "add", key="id").collect()
    found = {r.id: (r._batch_status, r._attempts, r._error) for r in result}
    assert len(found) == 95
    assert found[1000] == ("ok", 1, None) and found[1094] == ("ok", 1, None)
    assert found[1025] == ("ok", 2, None)
    assert found[45] == ("passed", 2, "the answer is not a list")
    assert found[65] == ("passed", 2, "ValueError: boom")
    with pytest.raises(Exception, match="boom|not a list"):
        batches.transform_batches(frame, moody, "add", key="id", on_failure="fail").collect()
    once = batches.transform_batches(frame, moody, "add", key="id", retries=0).collect()
    assert {r._error for r in once if 20 <= r.id < 40} == {"20 rows expected, got 1"}


def test_pass_through_changes_no_value(spark):
    frame = spark.sql(
        "SELECT timestamp'2020-01-02 03:04:05.678901' AS t, date'1999-12-31' AS d, 9007199254740993 AS big, 0.1D AS x, "
        "cast(12345678901234567890.123 as decimal(30,3)) AS dec, array(1, null) AS xs, cast('ab' as binary) AS b, "
        "true AS ok, cast(null as string) AS nothing, 'q\"\\\\u2028' AS s"
    )
    passed = batches.transform_batches(frame, lambda payload, note: None, "x")
    assert passed.select(*frame.columns).collect() == frame.collect()
    same = batches.transform_batches(frame, lambda payload, note: payload, "x")
    assert same.first()._batch_status == "ok"
    assert same.select(*frame.columns).collect() == frame.collect()


def test_values_that_do_not_fit_and_new_keys_are_kept(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string").coalesce(1)

    def change(payload, instruction):
        return '[{"n": "one", "s": 5}, {"n": 2, "extra": {"deep": [1]}}]'

    first, second = batches.transform_batches(frame, change, "x").collect()
    assert (first.n, first.s, first._unparsed, first._extra) == (None, "5", '{"n":"one","s":5}', None)
    assert (second.n, second.s, second._unparsed, second._extra) == (2, None, None, {"extra": '{"deep":[1]}'})
    wide = batches.extra_columns(batches.transform_batches(frame, change, "x"))
    assert [r.extra for r in wide.collect()] == [None, '{"deep":[1]}']
    odd = frame.toDF(" N, (1) ", "s;=")
    add = lambda payload, note: payload.replace("{", '{"new key": 1, ')
    named = batches.extra_columns(batches.transform_batches(odd, add, "x"))
    assert [tuple(r)[:2] + (r["new key"],) for r in named.collect()] == [(1, "a", "1"), (2, "b", "1")]


def test_payloads_round_trip_and_hot_ids(spark, monkeypatch):
    # A third of the rows have the same key and a third have none.
    frame = spark.range(3000).selectExpr("CASE id % 3 WHEN 0 THEN id WHEN 1 THEN 7 END AS k", "id")
    found = []
    for large, parts in ((1000, 4), (1, 1), (1, 3), (1, 8)):
        monkeypatch.setattr(batches, "HOT_BATCHES", large)
        made = batches.batch_payloads(frame.repartition(parts, "id"), "k")
        rows = made.collect()
        assert sum(r.n_rows for r in rows) == 3000 and max(r.n_rows for r in rows) == 20
        assert len({(r.batch_id, r.part) for r in rows}) == len(rows)
        found.append(sorted(str(r) for r in rows))
        back = batches.explode_payloads(made, frame.schema)
        assert back.exceptAll(frame).count() == 0 and frame.exceptAll(back).count() == 0
    assert all(f == found[0] for f in found)


def test_batch_ids_are_exact_for_large_and_negative_keys(spark):
    keys = [9007199254740993, -1, -20, -21, 0, 19]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    found = {r.batch_id: r.n_rows for r in batches.batch_payloads(frame, "k").collect()}
    expected = {}
    for k in keys:
        expected[k // 20] = expected.get(k // 20, 0) + 1
    assert found == expected


def test_large_maps_are_not_broadcast():
    assert lookup.BROADCAST_BYTES == 64 * 1024 * 1024


def test_numbers_that_json_lacks(spark):
    cases = {
        'x [{"id":NaN,"t":"NaN, \\"Infinity\\" -5"},{"id":-Infinity}]': '[{"id":null,"t":"NaN, \\"Infinity\\" -5"},{"id":null}]',
        '{"a":-5,"b":"Infinity"}': '{"a":-5,"b":"Infinity"}',
    }
    frame = spark.createDataFrame(list(cases.items()), "raw string, want string")
    for row in frame.select(extract_json("raw").alias("got"), "want").collect():
        assert row.got == row.want
