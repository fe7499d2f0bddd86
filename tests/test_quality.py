import random

import pytest
from pyspark.sql import functions as F

from burnish.functions.text import header_issue
from burnish.operators import profile, quality
from burnish.operators.actions import apply_actions
from burnish.plans.analyze import analyze

SAMPLE = [
    (1, "  John Doe  ", "2023-01-01", " ACTIVE"),
    (2, "Jane ", "01/02/2023", "inactive"),
    (3, "Bob Builder", "Feb 3rd 2023", " PENDING"),
    (4, "Alice", "2023-04-01", "active"),
]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(SAMPLE, "id long, name string, join_date string, status string")


def test_sample_scores_94(sample):
    for edge in ("both", "leading"):
        for exact in (False, True):
            row = quality.quality_score(sample, edge, exact).first()
            assert (row.n_header, row.n_whitespace, row.n_case, row.quality_score) == (0, 2, 1, 94)


def test_sample_checks(sample):
    rows = quality.check_quality(sample).orderBy("position").collect()
    assert [(r.check_id, r.columns, r.priority) for r in rows] == [
        ("whitespace", ["name", "status"], "Medium"),
        ("casing", ["status"], "Low"),
    ]


def test_padded_headers_score_84(spark):
    names = ["User ID ", " First   Name", " Email Address       ", " Job Title      ", " Age "]
    rows = [
        (1, " John        ", " john@example.com    ", " ui/ux designer ", " 29"),
        (2, " Jane        ", " jane@test.com       ", " UI UX Desginer ", " 31"),
        (3, " N/A         ", " null                ", " Manager        ", " -  "),
    ]
    frame = spark.createDataFrame(rows, "a long, b string, c string, d string, e string").toDF(*names)
    row = quality.quality_score(frame).first()
    assert (row.missing_ratio, row.n_header, row.n_whitespace, row.n_case, row.quality_score) == (0, 5, 4, 0, 84)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "a long, b string")
    row = quality.quality_score(frame).first()
    assert (row.row_count, row.missing_ratio, row.duplicate_ratio, row.quality_score) == (0, 0.0, 0.0, 100)
    assert quality.check_quality(frame).count() == 0
    assert profile.table_profile(frame).first().total_cells == 0
    assert profile.text_samples(frame, ["a"]).count() == 0


def test_table_without_text_columns(spark):
    frame = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "a long, b double")
    row = quality.quality_score(frame).first()
    assert (row.row_count, row.duplicate_ratio, row.missing_ratio) == (3, 1 / 3, 2 / 6)


def test_null_positions_matter_and_nan_is_missing(spark):
    nan = float("nan")
    frame = spark.createDataFrame(
        [(None, "a", 1.0), ("a", None, 1.0), ("a", "a", nan), ("a", "a", None), ("a", "a", 0.0), ("a", "a", -0.0)],
        "x string, y string, d double",
    )
    row = profile.duplicate_stats(frame).first()
    assert (row.distinct_rows, row.duplicate_rows) == (4, 2)
    assert profile.duplicate_stats(frame, exact=True).first() == row
    assert profile.table_profile(frame).first().missing_cells == 4


def test_nested_columns_are_compared_exactly(spark):
    frame = spark.createDataFrame(
        [([1, None], {"a": 1, "b": 2}), ([None, 1], {"b": 2, "a": 1}), ([1, None], {"b": 2, "a": 1})],
        "xs array<int>, m map<string,int>",
    )
    assert profile.duplicate_stats(frame).first().duplicate_rows == 1


def by_hand(rows, names):
    """The checks over Python rows, straight from their definitions."""
    n, width = len(rows), len(names)
    missing = sum(v is None for r in rows for v in r) / max(n * width, 1)
    duplicates = (n - len(set(rows))) / n
    whitespace = casing = 0
    for i in range(width):
        cells = [r[i] for r in rows if isinstance(r[i], str)]
        whitespace += any(c != c.strip() for c in cells)
        casing += len(set(cells)) > len({c.strip().lower() for c in cells})
    headers = sum(map(header_issue, names))
    penalty = min(35, missing * 100) + min(20, duplicates * 120)
    penalty += min(8, 2 * headers) + min(10, 2 * whitespace) + min(12, 2 * casing)
    return missing, duplicates, headers, whitespace, casing, max(0, min(100, round(100 - penalty)))


@pytest.mark.parametrize("seed", range(4))
def test_random_tables_against_brute_force(spark, seed):
    chance = random.Random(seed)
    names = ["Key", "first_name", "City", "note"]
    pools = [["a", "A", " a", "b", None], ["x\t", "x", "X", None], ["Rome", "Oslo", None], ["q", None, ""]]
    rows = [tuple(chance.choice(pool) for pool in pools) for _ in range(chance.randint(1, 60))]
    frame = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    for exact in (False, True):
        row = quality.quality_score(frame, exact=exact).first()
        found = (row.missing_ratio, row.duplicate_ratio, row.n_header, row.n_whitespace, row.n_case, row.quality_score)
        assert found == pytest.approx(by_hand(rows, names))


def test_wide_table_is_split_into_groups(spark):
    width = 150
    columns = [F.when(F.col("id") == i, F.lit(" a")).otherwise(F.lit("A")).alias(f"c{i}") for i in range(width)]
    frame = spark.range(20).select(*columns)
    row = quality.quality_score(frame).first()
    assert (row.row_count, row.n_whitespace, row.n_case) == (20, 20, 20)
    stats = profile.profile_columns(frame)
    assert stats.count() == width


def test_one_row_as_a_third_of_the_table(spark):
    frame = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 0, id) AS k", "if(id % 3 = 0, 'Hot', concat('v', id)) AS v"
    )
    row = profile.duplicate_stats(frame).first()
    assert (row.row_count, row.duplicate_rows) == (3000, 999)


def test_score_uses_one_data_shuffle(spark, sample):
    plan = quality.quality_score(sample)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(slot") == 2  # records, then one row per slot
    assert "Join" not in plan and "Window" not in plan


def test_cleaning_never_lowers_the_score(spark, sample):
    dirty = sample.unionByName(sample.where("id > 2")).withColumnRenamed("name", "Full Name")
    before = quality.quality_score(dirty).first().quality_score
    cleaned = apply_actions(dirty, ["whitespace", "casing", "duplicate", "header"])
    after = quality.quality_score(cleaned).first().quality_score
    assert before < after == 100


def test_profile(spark):
    frame = spark.createDataFrame(
        [(1, "a", None, 1.5), (None, "b", None, 2.5), (3, None, None, float("nan"))],
        "n int, s string, e string, d double",
    )
    columns = {r.column: r for r in profile.profile_columns(frame).collect()}
    assert columns["n"].dtype == "float64" and columns["s"].dtype == "object"
    assert (columns["d"].min, columns["d"].max, columns["d"].missing_cells) == (1.5, 2.5, 1)
    assert [r.column for r in profile.missing_by_column(frame).collect()] == ["e", "n", "s", "d"]
    samples = {r.column: r.examples for r in profile.text_samples(frame, ["n"]).collect()}
    assert samples == {"s": ["b", "a"]}
    assert profile.text_samples(frame).count() == 1
    whole = profile.profile(frame, ["n"]).first()
    assert whole.dtype_counts == {"float64": 2, "object": 2}
    assert [r.column for r in whole.numeric_column_ranges] == ["n", "d"]


def test_sample_sizes(spark):
    small, large = spark.range(50), spark.range(51)
    assert profile.sample_rows(small).count() == 50
    assert profile.sample_rows(large).count() == 20
    assert profile.sample_size(100) == 12 and profile.sample_size(1000) == 5
    first = [r.id for r in profile.sample_rows(large).collect()]
    again = [r.id for r in profile.sample_rows(large.repartition(7)).collect()]
    assert sorted(first) == sorted(again)


def test_analyze_with_and_without_a_valid_opinion(spark, sample):
    alone = analyze(sample).first()
    assert alone.quality_score == 94 and len(alone.suggestions) == 2
    assert analyze(sample, "the model is busy").first() == alone
    # An array is looked for before an object, so prose around an object with a list hides the object.
    assert analyze(sample, 'x {"quality_score": 10, "suggestions": []} y').first() == alone
    merged = analyze(sample, '{"quality_score": 51, "suggestions": []}').first()
    assert merged.quality_score == 72  # 72.5 to even
    assert merged.suggestions == alone.suggestions
