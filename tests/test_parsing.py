from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factfeed.functions.parsing import is_refusal, parse_grade, parse_verdict, with_extraction

ONE = ">> Sentence 1: A b.\n* A b.\n"
CASES = {
    "plain": (ONE, "ok", [("A b.", "A b.")]),
    "two sentences": (
        ">> Sentence 1: A.\n* a1\n- a2\n>> Sentence 2: B.\n* b1",
        "ok",
        [("A.", "a1"), ("A.", "a2"), ("B.", "b1")],
    ),
    "blank lines": ("\n\n" + ONE + "\n\n* more\n", "ok", [("A b.", "A b."), ("A b.", "more")]),
    "text before marker": ("Sure. " + ONE, "ok", [("A b.", "A b.")]),
    "text after run": (ONE + "That is all.\n", "ok", [("A b.", "A b.")]),
    "statements after the end": (ONE + "text\n* lost\n", "ok", [("A b.", "A b.")]),
    "blank-only line ends run": (ONE + "   \n* lost\n", "ok", [("A b.", "A b.")]),
    "two runs": (ONE + "Note:\n" + ONE, "malformed", None),
    "run after mid-line marker": (ONE + "x >> Sentence 2: C.\n* c\n", "malformed", None),
    "marker inside statement": (
        ONE + "* see >> Sentence 2: C.\n* c\n",
        "ok",
        [("A b.", "A b."), ("A b.", "see >> Sentence 2: C."), ("A b.", "c")],
    ),
    "statement line opens a run": ("* see >> Sentence 2: C.\n* c\n", "ok", [("C.", "c")]),
    "two markers, one text": (">> Sentence 1: >> Sentence 2: C.\n* c\n", "ok", [("C.", "c")]),
    "two markers, two texts": (">> Sentence 1: B. >> Sentence 2: C.\n* c\n", "malformed", None),
    "marker with blanks only": (">> Sentence 1:   \n* c\n", "malformed", None),
    "last sentence without break": (ONE + ">> Sentence 2: C.", "ok", [("A b.", "A b.")]),
    "single line": (">> Sentence 1: A b.", "malformed", None),
    "no statements": ("No statements", "empty", []),
    "none in lower case": ("there is no such sentence", "empty", []),
    "no of nothing": ("no idea", "malformed", None),
    "empty text": ("", "malformed", None),
    "sentences without statements": (">> Sentence 1: A.\n>> Sentence 2: B.\n* b\n", "ok", [("B.", "b")]),
    "only sentences": (">> Sentence 1: A.\n>> Sentence 2: B.\n", "ok", []),
    "repeated statement": (ONE + "* A b.\n", "ok", [("A b.", "A b."), ("A b.", "A b.")]),
    "blank statement": (">> Sentence 1: A.\n*  \n", "ok", [("A.", "")]),
    "bare star ends run": (">> Sentence 1: A.\n*\n* b\n", "ok", []),
    "two digits": (">> Sentence 12: A.\n* b\n", "ok", [("A.", "b")]),
    "accents": (">> Sentence 1: Été là.\n* Été\n", "ok", [("Été là.", "Été")]),
}


def test_extraction_grammar(spark):
    rows = [(name, text) for name, (text, _, _) in CASES.items()]
    df = with_extraction(spark.createDataFrame(rows, "name string, text string"))
    got = {r["name"]: r for r in df.collect()}
    for name, (_, status, pairs) in CASES.items():
        assert got[name]["status"] == status, name
        have = got[name]["pairs"]
        assert (have if have is None else [tuple(p) for p in have]) == pairs, name


def test_null_text(spark):
    row = with_extraction(spark.sql("SELECT CAST(NULL AS STRING) AS text")).first()
    assert row["status"] == "malformed" and row["pairs"] is None


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("Correct", "Correct"),
        ("It is incorrect.", "Correct"),
        ("vague, or wrong", "Vague"),
        ("WRONG", "Wrong"),
        ("I need more context", "Vague"),
        ("Need more context", None),
        ("this is not supported", "Vague"),
        ("", None),
    ],
)
def test_verdict(spark, text, verdict):
    assert spark.range(1).select(parse_verdict(F.lit(text)).alias("v")).first()["v"] == verdict


@pytest.mark.parametrize(
    ("text", "grade"), [("5", "5"), ("5 out of 10", "1"), ("4 or 3", "3"), ("70", None), ("none", None)]
)
def test_grade(spark, text, grade):
    assert spark.range(1).select(parse_grade(F.lit(text)).alias("v")).first()["v"] == grade


def test_refusals(spark):
    cases = {
        "Well, i'm sorry for that.": True,
        "I'm sorry for that.": False,
        "Is it so?": True,
        "Is it so? Yes.": False,
        "They doesn't have any information.": True,
        "A plain claim.": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["r"] for r in df.select("s", is_refusal(F.col("s")).alias("r")).collect()}
    assert got == cases
    low = df.select("s", is_refusal(F.col("s"), ignore_case=True).alias("r")).collect()
    assert {r["s"]: r["r"] for r in low}["I'm sorry for that."]
