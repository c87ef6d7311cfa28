import re

from strandmill.operators.exams import GENERAL, file_meta, matches, pair_sheets

SUBJECTS, LEVELS = (("數學", "math"), ("國語", "language")), (("國中", "middle_school"), ("高中", "high_school"))


def brute(names):
    subject = lambda n: next((v for k, v in SUBJECTS if k in n), GENERAL)
    year = lambda n: (re.search(r"(?<!\d)(1\d{2})(?!\d)", n) or [None, ""])[1]
    sheet = lambda n: any(w in n.lower() for w in ("答案", "解答", "answer"))
    fits = lambda p, a: not (year(p) and year(a) and year(p) != year(a)) and (subject(p) == GENERAL or subject(a) == subject(p))
    return {p: next((a for a in names if sheet(a) and fits(p, a)), None) for p in names if not sheet(p)}


def test_pairs_as_by_brute_force(spark):
    names = ["105數學.pdf", "105國語.pdf", "106數學.pdf", "數學.pdf", "105自然.pdf", "105數學答案.pdf", "國語解答.pdf", "106 Answer 數學.pdf", "107國語答案.pdf", "108社會.pdf", "11059數學.pdf"]
    df = spark.createDataFrame([(n, i, "x") for i, n in enumerate(names)] + [(None, 99, "x"), (names[0], 50, "x")], "name string, place int, paper string")
    assert {r.paper: r.sheet for r in pair_sheets(df, "name", "place", SUBJECTS).collect()} == brute(names)
    assert pair_sheets(df.limit(0), "name", "place", SUBJECTS).count() == 0


def test_metadata_and_filters(spark):
    df = spark.createDataFrame([("a/105國中數學3年.pdf",), ("b\\小六國語答案.pdf",), ("高中自然.pdf",), (None,)], "file string")
    m = {r.file: r for r in file_meta(df, "file", SUBJECTS, LEVELS).collect()}
    assert (m["a/105國中數學3年.pdf"].subject, m["a/105國中數學3年.pdf"].grade, m["a/105國中數學3年.pdf"].level, m["a/105國中數學3年.pdf"].label) == ("math", "3", "middle_school", "105國中數學3年")
    assert m["b\\小六國語答案.pdf"].grade == "6" and m["b\\小六國語答案.pdf"].is_sheet and m["b\\小六國語答案.pdf"].level == "elementary"
    both = file_meta(df.filter("file is not null"), "file", SUBJECTS, LEVELS)
    assert both.filter(matches("both")).count() == 2 and both.filter(matches("high_school")).count() == 1 and both.filter(matches("both", ["math"], ["3"])).count() == 1 and both.filter(matches("both", [], ["5"])).count() == 0
