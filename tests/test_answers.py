"""Answers that are kept as they come, and found by whoever asks the same."""

import json
import os
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError

from burnish.operators.batches import transform_batches
from burnish.plans.propose import propose_values


def asked(folder: Path) -> list[str]:
    return sorted(p.read_text() for p in folder.iterdir())


def counted(folder: Path, dies_at: int | None = None):
    """A transformer that notes each call, and whose worker is gone at a certain row of the first run."""

    def answer(payload, instruction):
        rows = json.loads(payload)
        fatal = folder.with_name("fatal")
        if dies_at is not None and rows[0]["id"] == dies_at and not fatal.exists():
            fatal.touch()
            os._exit(1)
        (folder / os.urandom(8).hex()).write_text(f"{len(instruction)} {rows[0]['id']}")
        if rows[0]["id"] % 20 == 0 and instruction == "upper":
            return "not today"
        return json.dumps([r | {"name": r["name"].upper()} for r in rows])

    return answer


def test_a_lost_worker_costs_no_finished_call(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    frame = spark.range(100).selectExpr("id", "concat('n', id % 7, 'é') AS name").coalesce(1)
    made = transform_batches(frame, counted(calls, dies_at=70), "upper", batch_size=10, answers=str(tmp_path / "kept"))
    with pytest.raises(Py4JJavaError):
        made.collect()
    before = asked(calls)
    assert len(before) >= 7
    rows = made.collect()
    after = asked(calls)
    assert len(after) == len(set(after)) == 15  # ten batches, five of them with a second attempt
    assert {(r.id, r.name, r._batch_status) for r in rows} == {(i, f"N{i % 7}É", "ok") for i in range(100)}
    assert {r._attempts for r in rows if r.id // 10 % 2 == 0} == {2} and set(before) <= set(after)
    assert sorted(made.collect()) == sorted(rows) and asked(calls) == after  # a further action asks nothing
    transform_batches(frame, counted(calls), "other", batch_size=10, answers=str(tmp_path / "kept")).count()
    assert len(asked(calls)) > len(after)  # another instruction is another question


def test_errors_are_asked_again(spark, tmp_path):
    frame = spark.range(3).selectExpr("id", "'a' AS name").coalesce(1)

    def broken(payload, instruction):
        raise RuntimeError("away")

    folder = (tmp_path / "kept").as_uri()
    assert {r._batch_status for r in transform_batches(frame, broken, "any", answers=folder).collect()} == {"passed"}
    again = transform_batches(frame, lambda payload, note: payload.replace('"a"', '"b"'), "any", answers=folder)
    assert [(r.name, r._attempts) for r in again.collect()] == [("b", 1)] * 3
    assert transform_batches(frame.limit(0), broken, "any", answers=folder).count() == 0
    # Nothing but whole answers is left.
    names = [p.name for p in (tmp_path / "kept").rglob("*") if p.is_file()]
    assert names and all(len(n) == 64 or n.endswith(".crc") for n in names)


def test_an_unknown_store_is_refused_at_once(spark):
    with pytest.raises(Exception, match="nostore"):
        transform_batches(spark.range(1), lambda p, n: p, "any", answers="nostore://a/b")


def test_proposals_are_not_asked_twice(spark, tmp_path):
    frame = spark.createDataFrame([(i, ["ann", "Ann", "bob", "Bob"][i % 4]) for i in range(200)], "id int, name string")
    calls = tmp_path / "calls"
    calls.mkdir()

    def answer(payload, instruction):
        (calls / os.urandom(8).hex()).write_text(payload)
        return json.dumps([r | {"new_value": r["old_value"].title(), "confidence": 0.9} for r in json.loads(payload)])

    # All values fit into one batch whatever the tasks, so that both runs ask the same.
    one = frame.coalesce(1)
    folder = str(tmp_path / "kept")
    first = propose_values(one, answer, "titles", answers=folder).collect()
    n = len(asked(calls))
    assert sorted(propose_values(one, answer, "titles", answers=folder).collect()) == sorted(first) and first
    assert len(asked(calls)) == n > 0
