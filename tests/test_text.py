from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions import routing, text, values

NAMES = ["User ID ", " First   Name", "Amount / Score", "already_snake", "__x__", "Ünï", "", "a.b", "9 lives!"]


def one(spark, expression, *rows):
    frame = spark.createDataFrame([(r,) for r in rows], "c string")
    return [r[0] for r in frame.select(expression(F.col("c"))).collect()]


def test_whitespace_has_29_code_points():
    assert len(text.WHITESPACE) == 29
    assert all(c.isspace() for c in text.WHITESPACE)


def test_strip_like_python(spark):
    cells = ["  a b ", "\t\n", "　x ", "\x1cq\x85", "", "plain", None]
    assert one(spark, text.strip, *cells) == [c if c is None else c.strip() for c in cells]


def test_edge_whitespace(spark):
    cells = [" a", "a ", "\xa0", "", "a b", None]
    assert one(spark, text.edge_whitespace, *cells) == [True, True, True, False, False, None]
    leading = lambda c: text.edge_whitespace(c, "leading")
    assert one(spark, leading, *cells) == [True, False, True, False, False, None]


def test_snake_case_column_and_name_agree(spark):
    assert one(spark, text.snake_case, *NAMES) == [text.snake_case_name(n) for n in NAMES]
    assert text.snake_case_name(" First   Name") == "first_name"


def test_outer_spaces_alone_are_no_header_issue():
    assert not text.header_issue("  city ")
    assert text.header_issue("City")


def test_priority_thresholds_are_inclusive(spark):
    frame = spark.createDataFrame([(0.05,), (0.049,), (0.15,)], "r double")
    found = [r[0] for r in frame.select(text.priority_from_ratio(F.col("r"), 0.05, 0.15)).collect()]
    assert found == ["Medium", "Low", "High"]


def test_percent_ties_to_even(spark):
    frame = spark.createDataFrame([(0.0625,), (0.5,)], "r double")
    assert [r[0] for r in frame.select(text.percent_text(F.col("r"))).collect()] == ["6.2%", "50.0%"]


def test_missing_and_nan(spark):
    frame = spark.createDataFrame([(float("nan"), None), (1.0, "x")], "d double, s string")
    found = frame.select(
        text.is_missing(F.col("d"), T.DoubleType()), text.is_missing(F.col("s"), T.StringType())
    )
    assert [tuple(r) for r in found.collect()] == [(True, True), (False, False)]


def test_null_tokens(spark):
    found = one(spark, text.null_tokens_to_null, "NA", "na", " NA", "", "None", "ok")
    assert found == [None, "na", " NA", None, None, "ok"]
    config = lambda c: text.null_tokens_to_null(c, text.CONFIG_NULL_TOKENS, folded=True)
    assert one(spark, config, " TBD ", "--", "Missing", "ok") == [None, None, None, "ok"]


def test_instructions_route_to_their_own_class(spark):
    for kind, instruction in routing.INSTRUCTIONS.items():
        assert routing.route_text(instruction) == kind
    frame = spark.createDataFrame([(i,) for i in routing.INSTRUCTIONS.values()], "c string")
    found = [r[0] for r in frame.select(routing.issue_class(F.lit(""), F.col("c"))).collect()]
    assert found == list(routing.INSTRUCTIONS)
    assert routing.text_asks_for_dedup(routing.INSTRUCTIONS["duplicate"])


def test_whitespace_suggestion_gets_the_general_instruction(spark):
    frame = spark.createDataFrame(
        [("Some text columns contain leading or trailing whitespace.", "Trim whitespace in name and city.")],
        "issue string, prompt string",
    )
    kind = routing.issue_class(F.col("issue"), F.col("prompt"))
    found = frame.select(kind, routing.instruction_for(kind, F.col("issue"))).first()
    assert found[0] == "whitespace"
    assert "text cells" in found[1] and "name and city" not in found[1]


def test_dedup_intent_column_and_text_agree(spark):
    prompts = ["remove duplicates", "Exact Duplicate", "dedup", "drop rows", "keep one, redundant copies", "no"]
    assert one(spark, routing.asks_for_dedup, *prompts) == [routing.text_asks_for_dedup(p) for p in prompts]


def test_dates(spark):
    cells = ["2023-01-01", "01/02/2023", "Feb 3rd 2023", "2023-04-01T05:06:07", " 3.4.2023 ", "2023-02-30", "soon"]
    expected = [
        "2023-01-01", "2023-01-02", "2023-02-03", "2023-04-01T05:06:07", "2023-04-03", "2023-02-30", "soon"
    ]
    assert one(spark, values.normalize_date, *cells) == expected
    day_first = lambda c: values.normalize_date(c, day_first=True)
    assert one(spark, day_first, "01/02/2023") == ["2023-02-01"]


def test_percent_and_phone(spark):
    assert one(spark, values.percent_to_fraction, "12.5%", " 50 % ", "50", "x%") == [0.125, 0.5, None, None]
    german = lambda c: values.normalize_phone(c, "+49")
    cells = ["(030) 123-4567", "+44 20 1234567", "0044 20 1234567", "ask Bob", "123"]
    expected = ["+49301234567", "+44201234567", "+44201234567", "ask Bob", "123"]
    assert one(spark, german, *cells) == expected
    assert one(spark, values.normalize_phone, "030 1234567") == ["030 1234567"]
