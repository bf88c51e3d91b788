"""Formulas, fonts, JSON, and document decisions."""

import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import markup, school
from quillspark.operators import documents
from quillspark.operators.text import section_kind


def one(spark, column, *rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_marks_in_words(spark):
    assert one(spark, markup.marks_words, 4.0, 8.5, None, 0.0, 42.0, 215.0, 12.25, kind="double") == ["FOUR", "EIGHT POINT FIVE", "ZERO", "ZERO", "FORTY TWO", "TWO HUNDRED AND FIFTEEN", "TWELVE POINT TWO"]


def test_formulas_are_cleaned(spark):
    rows = {"$$x^2$$": "x^2", r"a=b \qquad(7.3)": "a=b", r"\left[x\right]": "[x]", r"x{": "x{}", r"y}}": "y", r"\end{array} z": "z", "A → B": r"A \rightarrow  B", r"\left( x": "( x", None: ""}
    assert one(spark, markup.clean_formula, *rows) == list(rows.values())


def test_formulas_are_judged(spark):
    rows = {r"\frac{a}{b}": True, "": False, None: False, r"\left( x": False, "{": False, "the reaction and the substance and the element": False, r"\end{array}": False, r"\Omega\Omega\Omega\Omega": False, r"\frac{\alpha}{\alpha}\frac{\beta}{\beta}": False}
    assert one(spark, markup.is_formula, *rows) == list(rows.values())


def test_fonts(spark):
    assert one(spark, markup.unshift, "tKH FRQFHQWUDWHG fdw", None) == ["The concentrated cat", None]
    assert one(spark, markup.single_marks, "केे काा", "अतः ः", "ोे") == ["के का", "अतः", "ो"]


def test_inline_math(spark):
    got = one(spark, markup.inline_math, "माना समय t 1 पर", "समयांतराल (t 2 - t 1)", "$x 1$ stays", None)
    assert got == ["माना समय $t_{1}$ पर", "समयांतराल $(t_{2} - t_{1})$", "$x 1$ stays", None]


@pytest.mark.parametrize("raw,want", [('[{"a": 1}]', [{"a": 1}]), ('[{"a": 1}, {"b":', [{"a": 1}]), ("no json", None), (None, None)])
def test_json(raw, want):
    got = markup.repair_json_text(raw)
    assert (got and json.loads(got)) == want if want is not None or got is None else "lpha" in got


def test_drafts(spark):
    answer = '{"questions": [{"question_text": "What is force?", "marks": 2}, {"question_text": "x"}, {"question_text": "cut'
    got = one(spark, markup.drafts, answer, "[]", "nothing")
    assert [q.question_text for q in got[0]] == ["What is force?"] and got[1] == [] and got[2] is None


def test_kinds(spark):
    base = {"total_pages": 20, "broadsheet": False, "dateline": False, "volume_stamp": False, "opener": False, "running_headers": False, "multi_toc": False, "scanned": False, "newspaper_words": 0, "exam_words": 0, "book_words": 0, "chapter_words": 0, "pedagogy_words": 0}
    cases = [({"broadsheet": True, "dateline": True, "newspaper_words": 3}, "NEWSPAPER"), ({"exam_words": 4, "total_pages": 3}, "WORKSHEET_OR_EXAM"), ({"chapter_words": 2, "opener": True}, "SINGLE_CHAPTER"), ({"total_pages": 200, "book_words": 2, "multi_toc": True}, "FULL_BOOK"), ({"scanned": True}, "NOTES"), ({}, "UNKNOWN")]
    df = spark.createDataFrame([{**base, **c, "i": i} for i, (c, _) in enumerate(cases)])
    got = documents.classify(df).orderBy("i").collect()
    assert [r.kind for r in got] == [k for _, k in cases]
    assert all(0.2 <= r.confidence <= 0.96 for r in got) and got[-1].confidence == 0.2


def test_gate_and_prose(spark):
    df = spark.createDataFrame([(1, ["x", "{"], 0.9, False, ["a"]), (2, ["x"], 0.9, False, [])], "id int, formulas array<string>, quality double, needs_review boolean, flags array<string>")
    assert [(r.quality, r.needs_review, r.flags) for r in documents.formula_gate(df).orderBy("id").collect()] == [(0.6, True, ["a", "corrupted_formula_detected"]), (0.9, False, [])]
    assert one(spark, documents.formula_or_prose, "x = 1", "consider the following example of a reaction in the compound now") == ["FORMULA", "PARAGRAPH"]


def test_boxes(spark):
    box = lambda b: documents.bounding_box(b, F.lit(100.0), F.lit(200.0), True)
    assert one(spark, box, [10.0, 20.0, 5.0, 250.0], [1.0], kind="array<double>") == [[5.0, 0.0, 10.0, 180.0], [0.0] * 4]


def test_excerpts(spark):
    long = "First sentence here. " * 40
    df = spark.createDataFrame([("short",), (long,)], "t string").select(documents.excerpt(F.col("t"), F.lit(50), F.lit(0.5)).alias("x")).collect()
    assert df[0].x == "short" and 100 < len(df[1].x) <= 200 and df[1].x.endswith(".")


def test_batches(spark):
    tiers = spark.createDataFrame([(1.0, 23), (2.0, 10), (3.0, 0)], "marks double, count int")
    got = sorted((r.marks, r.batch, r.quantity) for r in documents.plan_batches(tiers).collect())
    assert got == [(1.0, 0, 10), (1.0, 1, 10), (1.0, 2, 3), (2.0, 0, 10)]


def test_passages(spark):
    passage = "Read the following passage with care and answer the questions below it."
    rows = [(1, 0, passage + "\n\nWhat is A?"), (1, 1, passage + "\nWhat is B?"), (1, 2, "Plain"), (2, 0, passage + "\n\nAlone?")]
    got = documents.shared_passages(spark.createDataFrame(rows, "version_id long, position long, question_text string")).orderBy("version_id", "position").collect()
    assert [(r.question_text, r.passage) for r in got] == [("What is A?", passage), ("What is B?", None), ("Plain", None), (rows[3][2], None)]


def test_pictures(spark):
    flat, step = [1] * 72, [9 - i % 9 for i in range(72)]
    assert one(spark, documents.difference_hash, flat, step, kind="array<int>") == ["0" * 16, "f" * 16]
    df = spark.createDataFrame([(1, 0, "00000000000000ff"), (1, 1, "00000000000000fe"), (1, 2, "ffffffff00000000")], "doc_id long, position long, dhash string")
    assert [r.kept for r in documents.first_pictures(df).orderBy("position").collect()] == [True, False, True]


def test_signatures(spark):
    now = dt.datetime(2024, 1, 1)
    sign = lambda b: hmac.new(b"k", b.encode(), hashlib.sha256).hexdigest()
    rows = [("a", now, sign("a")), ("b", now - dt.timedelta(seconds=700), sign("b")), ("c", now, sign("x"))]
    df = spark.createDataFrame([(t, b, s) for b, t, s in rows], "sent_at timestamp, body string, signature string")
    assert [r.body for r in documents.fresh_signature(df, b"k", F.lit(now).cast("timestamp")).collect()] == ["a"]


def test_roles_and_sections(spark):
    df = spark.createDataFrame([("deo", [], None), (None, ["VALIDATOR", "DATA_ENTRY_OPERATOR"], 1), (None, ["CREATE_STUDENT"], 1), (None, ["CREATE_STUDENT"], None)], "r string, c array<string>, s int")
    assert [r[0] for r in df.select(documents.role_label(F.col("r"), F.col("c"), F.col("s"))).collect()] == ["Data Entry Operator", "DEO & Validator", "Teacher", "Custom"]
    assert one(spark, section_kind, "Example 1.2 x", "Activity: y", "Lawful", "Law 3") == ["SOLVED_EXAMPLE", "ACTIVITY", "PARAGRAPH", "DEFINITION"]
    assert one(spark, school.audit_category, "exam.proctoring_warning", "delivery.made", "capability.x", "z") == ["PROCTORING", "PAPERS", "USERS", "SYSTEM"]


def test_snapshot_answers(spark):
    items = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "attempt_id long, question_id long, position long")
    answers = spark.createDataFrame([(1, 10, 5, "by id", 1.0), (1, 99, 1, "by place", 2.0)], "attempt_id long, question_id long, position long, response string, marks double")
    assert [r.answer.response for r in documents.attach_answers(items, answers).orderBy("position").collect()] == ["by id", "by place"]
