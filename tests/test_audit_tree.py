"""The audit log by ranges of the key against a plain comparison of whole tables."""

import datetime
import random
from collections import defaultdict

import pytest

from burnish.operators import lookup, review

DAY = datetime.date(2024, 1, 1)
KEYS = {
    "long": lambda i: (i * 3 - 500,), "string": lambda i: (f"key {i}",), "date": lambda i: (DAY + datetime.timedelta(days=i),),
    "int, string": lambda i: (i % 50, f"k{i}"), "double": lambda i: (i / 7,),
}


def plain(before, after, width):
    """(key, change) of all keys that do not hold the same rows, and the changed cells of single ones."""
    sides = [defaultdict(list), defaultdict(list)]
    for side, rows in zip(sides, (before, after), strict=True):
        for r in rows:
            side[r[:width]].append(r[width:])
    found = set()
    for key in {*sides[0], *sides[1]}:
        old, new = (sorted(s[key], key=str) for s in sides)
        if old == new:
            continue
        if not old or not new:
            found.add((*key, "removed" if old else "added", None, str(len(old)), str(len(new))))
        elif len({*old}) > 1 or len({*new}) > 1:
            found.add((*key, "ambiguous", None, str(len(old)), str(len(new))))
        else:
            if len(old) != len(new):
                found.add((*key, "copies", None, str(len(old)), str(len(new))))
            found |= {(*key, "cell", f"c{i}", a, b) for i, (a, b) in enumerate(zip(old[0], new[0], strict=True)) if a != b}
    return found


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("way", ["small", "large", "shuffled", "stored"])
def test_changes_are_those_of_whole_tables(spark, kind, way, monkeypatch):
    draw = random.Random(f"{kind} {way}")
    monkeypatch.setattr(review, "RANGE_ROWS", (256, 16, 4))
    if way == "large":
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", -1)
    make = KEYS[kind]
    before = [(*make(i), f"a{i % 9}", None if i % 5 == 0 else f"b{i}") for i in range(1500)]
    before += [(*make(7), "a7", "b7")] * 300 + [(*make(8), "x", "y"), (*[None] * len(make(0)), "n", "n")]
    after = []
    for r in before:
        odds = draw.random()
        cells = (draw.choice([None, "new"]), r[-1]) if odds < 0.005 else (r[-1], r[-2]) if odds < 0.008 else r[-2:]
        after += [] if 0.008 < odds < 0.012 else [(*r[:-2], *cells)] * (2 if 0.012 < odds < 0.016 else 1)
    # cells that change places between two keys
    after = [(*r[:-2], *before[101][-2:]) if r[:-2] == make(100) else (*r[:-2], *before[100][-2:]) if r[:-2] == make(101) else r for r in after]
    types = kind.split(", ")
    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(types)), "c0 string", "c1 string"])
    frames = [spark.createDataFrame(rows, schema) for rows in (before, after)]
    if way == "shuffled":
        frames = [f.repartition(5, "c0") for f in frames]
    keys = [f"k{i}" for i in range(len(types))]
    log = review.audit_log(*frames, keys, stored=way == "stored").select(*keys, "change", "column", "old_value", "new_value")
    assert {tuple(r) for r in log.collect()} == plain(before, after, len(types))


def test_no_rows_and_no_changes(spark):
    frame = spark.range(1000).selectExpr("id", "id % 7 AS c")
    assert review.audit_log(frame, frame, ["id"]).count() == 0
    assert review.audit_log(frame.where("id < 0"), frame.where("id < 0"), ["id"]).count() == 0
    assert review.audit_log(frame.where("id < 0"), frame, ["id"]).count() == 1000


def test_only_small_ranges_go_on(spark):
    """Five changed rows of 40,000, in files by ranges of the key: what is left to compare is a few ranges."""
    before = spark.range(0, 40_000, 1, 8).selectExpr("id", "sha2(string(id), 256) AS c")
    after = before.selectExpr("id", "if(id % 8000 = 77, 'new', c) AS c")
    digests = review.written(review._digests(before, after, ["id"], ["c"]), "digests")
    assert 10 <= review._differing_rows(digests).count() <= 5 * 2 * 2 * 16
    assert review.audit_log(before, after, ["id"]).count() == 5
