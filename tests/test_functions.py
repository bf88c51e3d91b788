"""Literal cases of the text and school functions."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import school, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", *columns).orderBy("i").drop("i").collect()]


def one(spark, column, *rows):
    return [r[0] for r in values(spark, [(x,) for x in rows], "x string", column(F.col("x")))]


def test_standards(spark):
    got = one(spark, school.standard, "6", "10.0", "Std. 6", "Grade 8", "10th", "VI", "iv", None, "", "13", "Class 10 B", "abc")
    assert got == [6, 10, 6, 8, 10, 6, 4, None, None, None, 10, None]


def test_divisions(spark):
    assert one(spark, school.division, "b", "Section C", "Division D", None, "", "12", "ab") == ["B", "C", "D", None, None, None, None]


def test_class_assignments(spark):
    got = one(spark, school.class_assignment, "Standard 6 — A", "Std 10-B", "Class 9 A", "10A", "None", None, "-", "6th - B")
    assert [r and (r.standard, r.section) for r in got] == [(6, "A"), (10, "B"), (9, "A"), (10, "A"), None, None, None, (6, "B")]


def test_phones(spark):
    assert one(spark, school.phone, "98765 43210", "+91-9876543210", "09876543210", "1234567890", None, "") == ["+919876543210"] * 3 + [None] * 3


ANSWERS = [
    (("MCQ", 2.0, "B", "B", None, 0.0), (True, 2.0, "MCQ_LETTER")),
    (("MCQ", 1.0, "C", "Oxygen", {"C": "Oxygen"}, 0.0), (True, 1.0, "MCQ_TEXT")),
    (("MCQ", 1.0, "Oxygen", "c", {"C": "Oxygen"}, 0.0), (True, 1.0, "MCQ_KEY_FROM_TEXT")),
    (("MCQ", 4.0, "C", "A", {"C": "Oxygen"}, 1.0), (False, -1.0, "MCQ_INCORRECT")),
    (("MCQ", 4.0, "C", " ", None, 1.0), (False, 0.0, "UNANSWERED")),
    (("SHORT_ANSWER", 3.0, "9.8 m/s^2", "9.80 m/s^2", None, 0.0), (True, 3.0, "NUMERICAL")),
    (("SHORT_ANSWER", 3.0, "10", "12", None, 0.0), (False, 0.0, "NUMERICAL_INCORRECT")),
    (("SHORT_ANSWER", 3.0, "Photosynthesis", "photosynthesis", None, 0.0), (True, 3.0, "CANONICAL_TEXT")),
    (("SHORT_ANSWER", 3.0, "one two three four", "one two three four", None, 0.0), (None, None, "MANUAL_PENDING")),
    (("LONG_ANSWER", 5.0, "x", "x", None, 0.0), (None, None, "MANUAL_PENDING")),
    (("LONG_ANSWER", 5.0, "x", None, None, 0.0), (None, None, "MANUAL_PENDING")),
    (("MCQ", None, "B", "b", None, 0.0), (True, 1.0, "MCQ_LETTER")),
]


def test_answers(spark):
    schema = "kind string, marks double, correct string, response string, options map<string,string>, penalty double"
    got = values(spark, [a for a, _ in ANSWERS], schema, school.evaluate(*(F.col(c) for c in ("kind", "marks", "correct", "response", "options", "penalty"))).alias("r"))
    assert [tuple(r[0]) for r in got] == [w for _, w in ANSWERS]


def test_drop_caps(spark):
    assert one(spark, text.merge_drop_caps, "T he Congress", "A ll students", "A cat sat", "I saw him") == ["The Congress", "All students", "A cat sat", "I saw him"]


def test_hyphens(spark):
    assert one(spark, text.rejoin_hyphens, "com-\nmand", "inter-\n  national", "well-known", "word - another") == ["command", "international", "well-known", "word - another"]


def test_glyphs(spark):
    assert one(spark, text.strip_glyphs, "trianglertSouthern", "squarebulletReport", "a b") == ["Southern", "Report", "a b"]


def test_short_lines(spark):
    assert one(spark, text.drop_short_lines, "q\n12\nRs\n(a)\nDr\nx#\nlong line", "$x$\n\nab") == ["12\nRs\n(a)\nDr\nlong line", "$x$\n"]


def test_glued(spark):
    got = one(spark, text.glued_words, "the commandhas commandhas been", "basis analysis whereas crisis")
    assert got == [["commandhas"], []]


def test_garbage(spark):
    got = one(spark, text.garbage, "A clean English text.", "यह एक साफ पाठ है", "આ સાફ પાઠ છે", "� cid:12 x|y \x07", "abcकखग", "$αक$ word", None)
    assert [r.garbage for r in got][:3] == [0, 0, 0] and got[3].rate > 0.15 and got[4].rate > 0.05 and got[6].total == 0
    assert got[3].garbage == 3 + 5 + 2 + 2


def test_scripts(spark):
    got = one(spark, text.scripts, "abc १", "", "अब ab")
    assert got[0].latin == 1.0 and got[1].latin == 0.0 and got[2].latin == 0.5 and got[2].devanagari == 0.5


def test_normal_forms(spark):
    assert one(spark, text.normalize_question, "What is Newton's First Law?", "a\\, $x^2$", None) == ["what is newton s first law", "a $x^2$", ""]
    assert one(spark, text.stem, "calculations", "running", "his", "studies") == ["calcul", "runn", "his", "stud"]
    assert one(spark, lambda c: text.ngrams(F.split(c, " "), 2), "a b c", "a") == [["a b", "b c"], []]


def test_numbers(spark):
    assert one(spark, school.ocr_number, "१५", "૨૩", "lO", "l2", "IO5", "o", "iv", "IV") == [15, 23, 10, 12, 105, 0, 4, None]


def test_grades(spark):
    got = values(spark, [(x,) for x in (95.0, 90.0, 33.0, 32.9, None)], "x double", school.grade(F.col("x")), school.board_grade(F.col("x")))
    assert got == [("A+", "A1"), ("A+", "A2"), ("D", "D"), ("F", "E1"), ("—", "—")]


def test_board_grades_round_the_double(spark):
    assert one(spark, school.board_grade, 32.995, 33.0, 40.995, 90.995, 90.99) == ["E1", "D", "C2", "A1", "A2"]


def test_shift(spark):
    assert one(spark, text.is_shifted, "wkh fdw dqg wkh grj zlwk vrph", "the cat and the dog with some", "wkh dqg") == [True, False, False]


@pytest.mark.parametrize("value,want", [("", 0), ("abcd", 1), ("abcde", 2), ("{}", 1)])
def test_tokens(spark, value, want):
    assert one(spark, text.tokens_estimate, value) == [want]


def test_scripts_list_no_characters(spark):
    df = spark.createDataFrame([("ab कખ日 1",), ("",), (None,)], "t string").select(text.scripts(F.col("t")).alias("s"))
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r.s) for r in df.collect()] == [(0.4, 0.2, 0.2, 0.2), (0.0,) * 4, (0.0,) * 4]


def test_words_are_lexed_whole():
    from quillspark.functions.markup import _LEXER, mark_math

    assert len(_LEXER.findall("several words here")) == 5
    assert mark_math("so x = y1 + 2 holds, ab_c 12b (a+b) x 3 é1") == "so $x = y_{1} + 2$ holds, ab_c 12b $(a + b)$ $x_{3}$ é1"


def test_only_suspect_pages_go_to_python(spark):
    pages = spark.createDataFrame([("plain words that are not shifted",)], "text string")
    plan = text.clean_pages(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "unshift(CASE WHEN" in plan and "single_marks(CASE WHEN" in plan
    assert one(spark, text.is_shifted, "Wkh fdw DQG more plain words here", "wkhx dqgx and more plain words here", "wkh[ dqg] and more plain words here") == [True, False, False]


def test_clean_page(spark):
    page = "T he com-\nmand trianglertSouthern\nq\nthe commandhas been"
    shifted = "wkh fdw dqg wkh grj zlwk vrph"
    df = spark.createDataFrame([(0, page), (1, "A clean page."), (2, None), (3, shifted), (4, "so x = y + 2 holds")], "k long, text string")
    got = text.clean_pages(df).orderBy("k").collect()
    assert got[0].text == "The command Southern\nthe commandhas been" and got[0].glued == ["commandhas"] and len(got[0].flags) == 5
    assert [(r.flags, r.quality) for r in got[1:3]] == [([], 1.0)] * 2
    assert (got[3].text, got[3].flags) == ("the cat and the dog with some", ["caesar_font_unshifted"])
    assert got[4].flags == ["math_normalized"] and "$" in got[4].text


def test_legacy_fonts(spark):
    assert one(spark, text.is_legacy_font, "KrutiDev010", "APS-DV-Prakash", "xAPSx", "SmallCaps", None, "Arial") == [True, True, True, False, False, False]
    assert one(spark, text.is_legacy_text, "izse vksj osq gsa " * 3, "plain english text that is long enough to be tested", "izse vksj") == [True, False, False]
