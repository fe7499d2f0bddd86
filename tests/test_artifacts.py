"""A cleaning run with its review table and audit log."""

import json

from burnish.plans.artifacts import clean_with_artifacts

ROWS = [
    (1, " Ann ", "ui/ux designer", "N/A", 31.0), (2, "Bob", "UI UX Desginer", "null", None), (3, "Cy", " - ", "x ", 2.5),
    (4, "Di", "UI/UX Designer", None, 1.0),
]


def transformer():
    """Confident about one spelling, unsure about the other."""
    sure = {"ui/ux designer": 0.98, "UI UX Desginer": 0.8}

    def answer(payload, instruction):
        return json.dumps([i | {"new_value": "UI/UX Designer", "confidence": sure.get(i["old_value"], 0.1)} for i in json.loads(payload)])

    return answer


def test_all_artifacts(spark):
    frame = spark.createDataFrame(ROWS, "` User ID ` int, `First   Name` string, `Job Title` string, note string, Age double")
    made = clean_with_artifacts(frame, [" User ID "], transformer(), "Write titles alike", ("category_text", "name"))
    assert made.cleaned.columns == ["user_id", "first_name", "job_title", "note", "age"]
    assert sorted(map(tuple, made.cleaned.collect())) == [
        (1, "Ann", "UI/UX Designer", None, 31.0), (2, "Bob", "UI UX Desginer", None, None), (3, "Cy", None, "x", 2.5),
        (4, "Di", "UI/UX Designer", None, 1.0),
    ]
    waiting = [(r.user_id, [(p.column, p.old_value, p.new_value) for p in r.review]) for r in made.review.collect()]
    assert waiting == [(2, [("job_title", "UI UX Desginer", "UI/UX Designer")])]
    assert {tuple(r) for r in made.audit.collect()} == {
        (1, "cell", "first_name", " Ann ", "Ann", "rules"), (1, "cell", "note", "N/A", None, "rules"), (2, "cell", "note", "null", None, "rules"),
        (3, "cell", "job_title", " - ", None, "rules"), (3, "cell", "note", "x ", "x", "rules"),
        (1, "cell", "job_title", "ui/ux designer", "UI/UX Designer", "proposals"),
    }


def test_without_proposals_and_rows(spark):
    frame = spark.createDataFrame(ROWS, "id int, a string, b string, c string, d double")
    made = clean_with_artifacts(frame, ["id"])
    assert made.review.count() == 0 and made.review.columns[-1] == "review" and made.audit.where("source != 'rules'").count() == 0
    nothing = clean_with_artifacts(frame.where("id < 0"), ["id"], transformer())
    assert [t.count() for t in nothing] == [0, 0, 0]
