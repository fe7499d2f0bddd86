"""Cases that once gave wrong results."""

import pytest
from pyspark.sql import functions as F

from burnish.functions.values import normalize_date
from burnish.operators import actions, bloom, kinds, lookup, profile, review
from burnish.plans import analyze
from burnish.sources.delimited import read_delimited


def test_padded_dates(spark):
    cells = [" " * 100 + "2024-01-02", "01/02/2023" + " " * 100, "Feb" + " " * 80 + "3rd, 2023", "a 2024-01-02 b"]
    frame = spark.createDataFrame([(c,) for c in cells], "c string")
    found = [r[0] for r in frame.select(normalize_date(F.col("c"))).collect()]
    assert found == ["2024-01-02", "2023-01-02", "2023-02-03", "a 2024-01-02 b"]


@pytest.mark.parametrize("n", [30, 150, 999, 5000])
def test_unique_columns_are_identifiers(spark, n):
    frame = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"), (F.col("id") % 7).alias("few"))
    found = {r.column: r.kind for r in kinds.column_kinds(frame).collect()}
    assert (found["id"], found["h"]) == ("identifier", "identifier") and found["few"] != "identifier"


@pytest.mark.parametrize("exact", [False, True])
def test_kinds_do_not_depend_on_the_number_of_rows(spark, exact):
    """The same columns at three sizes: twenty or forty values, skewed ones, a pool of thousands, unique text."""
    found = []
    for n in (150, 1500, 60_000):
        frame = spark.range(n).selectExpr(
            "concat('segment ', pmod(xxhash64(id), 20)) AS twenty", "concat('v ', pmod(xxhash64(id, 1), 40)) AS forty",
            "if(id % 10 < 7, 'usual', concat('other ', id)) AS skewed", "concat('n ', pmod(xxhash64(id, 2), 4000)) AS pool",
            "concat('Person ', id) AS person", "concat(repeat('word ', 30), pmod(id, 3)) AS long_few",
        )
        found.append({r.column: r.kind for r in kinds.column_kinds(frame, exact).collect()})
    assert found[0] == found[1] == found[2] == {
        "twenty": "category_text", "forty": "category_text", "skewed": "category_text", "pool": "name",
        "person": "name", "long_few": "category_text",
    }


def test_expected_distinct_is_that_of_all_draws(spark):
    from itertools import combinations

    cells = "aaabbcdd"
    want = [len({cells[i] for i in d}) for d in combinations(range(8), 3)]
    counted = spark.createDataFrame([(0, v, cells.count(v)) for v in set(cells)], "position int, h string, n long")
    assert kinds.expected_distinct(counted, 3).first().expected == pytest.approx(sum(want) / len(want))
    assert kinds.expected_distinct(counted, 100).first().expected == pytest.approx(4)


def test_proposals_for_other_types(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    rows = [("id", "1", "999", 0.99), ("id", "2", "abc", 0.99), ("t", "b", "B", 0.99), ("id", "x", "1", 0.99)]
    proposals = spark.createDataFrame(rows, "column string, old_value string, new_value string, confidence double")
    proposed = review.attach_proposals(frame, proposals)
    decisions = {(p.column, p.old_value): p.decision for r in proposed.collect() for p in r["_proposals"]}
    assert decisions == {("id", "1"): "accept", ("id", "2"): "reject", ("t", "b"): "accept"}
    assert sorted(tuple(r) for r in review.apply_accepted(proposed).collect()) == [(2, "B"), (999, "a")]


def test_reserved_and_dotted_names(spark):
    with pytest.raises(ValueError):
        profile.sample_rows(spark.range(3).withColumnRenamed("id", "sample_rank"))
    dotted = spark.createDataFrame([(1, "x")], "`a.b` int, c string")
    assert analyze.sample_json(dotted).first().sample == '[{"a.b":1,"c":"x"}]'


def test_sample_by_a_repeated_key_is_mixed(spark):
    frame = spark.range(5000).select((F.col("id") % 25).alias("nation"), "id")
    assert len({r.nation for r in profile.sample_rows(frame, ["nation"]).collect()}) > 5


def test_headers_with_blanks_in_two_orders(spark, tmp_path):
    (tmp_path / "a 1.csv").write_text("x,,y\n1,2,3\n")
    (tmp_path / "b [2].csv").write_text("y,,x\n30,20,10\n")
    (tmp_path / "c 3.csv").write_text("x;y\n7;9\n")
    rows = read_delimited(spark, str(tmp_path)).select("x", "y").collect()
    assert sorted(tuple(r) for r in rows) == [("1", "3"), ("10", "30"), ("7", "9")]


@pytest.mark.parametrize("share", [0.33, 0.9])
def test_a_hot_key_is_spread_evenly(spark, share):
    """A value and null with a large part of the rows: tasks of the join come out even, copies of rows included."""
    n = 60_000
    cell = f"CASE WHEN id < {n * share / 2} THEN 'hot' WHEN id < {n * share} THEN NULL ELSE concat('v', id) END"
    frame = spark.range(n).selectExpr(f"{cell} AS v", "id DIV 4 AS twice")
    mapping = spark.range(n).selectExpr("concat('v', id) AS _burnish_key", "id AS new").union(spark.createDataFrame([("hot", -1)], "a string, b long"))
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(x) for x in names]
    try:
        spark.conf.set(names[0], "12")
        spark.conf.set(names[1], "false")
        joined = lookup.attach(frame, F.col("v"), mapping, lookup.BROADCAST_BYTES + 1, "found")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        facts = joined.agg(F.count(F.lit(1)), F.count_if(F.col("found.new") == -1), F.count("found.new")).first()
    finally:
        for x, value in zip(names, before, strict=True):
            spark.conf.set(x, value)
    hot = sum(1 for i in range(n) if i < n * share / 2)
    nulls = sum(1 for i in range(n) if n * share / 2 <= i < n * share)
    assert tuple(facts) == (n, hot, n - nulls)
    assert len(sizes) == 12 and max(sizes) < 1.8 * n / 12


@pytest.mark.parametrize("most_bits", [1 << 29, 1 << 15])
def test_bloom_filter_loses_none(spark, most_bits):
    """All keys pass; of others few, or more where the filter may not grow."""
    hashed = spark.range(50_000).select("id", F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"))
    keys = hashed.where("id % 25 = 0")
    made, n_bits = bloom.bloom_filter(keys, 2000, ["h1", "h2"], most_bits)
    passed = [r.id for r in bloom.may_be_in(hashed, ["h1", "h2"], made, n_bits).collect()]
    assert len(set(passed)) == len(passed) and {i for i in range(0, 50_000, 25)} <= set(passed)
    assert len(passed) < 2000 + 48_000 * 0.03 and made.count() * bloom.PAGE_BITS >= n_bits
    assert made.selectExpr("max(octet_length(bits)) AS n").first().n == bloom.PAGE_BITS // 8


def test_texts_are_shuffled_for_candidate_forms_only(spark, monkeypatch):
    """Past the size of a broadcast the mixed forms still cut down what is grouped; the answer is the same."""
    rows = spark.range(20_000).selectExpr("if(id % 100 = 0, if(id % 200 = 0, 'Blue ', 'blue'), concat('Own ', id)) AS c")
    want = sorted(map(tuple, actions.canonical_map(rows).collect()))
    seen = []

    def kept(df, *args):
        found = bloom.may_be_in(df, *args)
        seen.append(found.count())
        return found

    monkeypatch.setattr(lookup, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(actions, "may_be_in", kept)
    assert sorted(map(tuple, actions.canonical_map(rows).collect())) == want and want[0][1] == "blue"
    assert 200 <= seen[0] < 1200


def test_many_files_of_three_headers(spark, tmp_path):
    """Files are parted by their headers on the executors; blank lines go as they do in one reader."""
    heads = [["a", "", "b"], ["b", "", "a"], ["", "a", "c,c"]]
    for i in range(60):
        head = heads[i % 3]
        cells = [{"a": f"a{i}", "b": f"b{i}", "": f"u{i}", "c,c": f"c{i}"}[h] for h in head]
        quoted = [f'"{h}"' if "," in h else h for h in head]
        (tmp_path / f"{i}.csv").write_text(",".join(quoted) + "\n   \n" + ",".join(cells) + "\n\n")
    rows = read_delimited(spark, str(tmp_path), ",", "UTF-8", multi_line=False)
    assert set(rows.columns) == {"a", "b", "c,c", "Unnamed: 0", "Unnamed: 1"}
    got = {(r["a"], r["b"], r["c,c"], r["Unnamed: 0"], r["Unnamed: 1"]) for r in rows.collect()}
    assert got == {
        (f"a{i}", None, f"c{i}", f"u{i}", None) if i % 3 == 2 else (f"a{i}", f"b{i}", None, None, f"u{i}") for i in range(60)
    }


def test_writes_of_two_threads_leave_the_setting(spark):
    from concurrent.futures import ThreadPoolExecutor

    from burnish.sources import shared

    before = spark.conf.get(shared._CLEANUP, "false")
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: shared.written(spark.range(50 + i).repartition(2), "threads").count(), range(8)))
    assert made == [50 + i for i in range(8)] and spark.conf.get(shared._CLEANUP, "false") == before
