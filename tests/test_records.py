"""Items, budgets, drafts, figures, names, page figures and paging as literal cases."""

import decimal

import pytest
from pyspark.sql import functions as F

from quillspark.operators import records


def test_items(spark):
    pages = spark.createDataFrame([(1, [("TABLE", "h", "t", None), ("Table", None, "", "seen"), (None, "", None, None)]), (2, []), (3, None)], "page long, sections array<struct<type:string,heading:string,text:string,image_description:string>>")
    assert [tuple(r) for r in records.flat_items(pages, ["page"]).collect()] == [(1, 0, "TABLE", "h", "t"), (1, 1, "PARAGRAPH", "", "seen"), (1, 2, "PARAGRAPH", "", "")]


@pytest.mark.parametrize(
    "model,prompt,questions,window,output,want",
    [
        ("models/Gemini-2.0-Flash", "x" * 400, 5, None, None, ("gemini-2.0-flash", 32768, 100, 1500, 32768 - 100 - 1500 - 1638)),
        (None, "", 50, None, None, ("default", 8192, 0, 2048, 8192 - 2048 - 409)),
        ("gemini-3.5-flash-lite", None, 0, 1000, 5000, ("gemini-3.5-flash-lite", 1000, 0, 4096, 200)),
        ("unknown", "a$b", 1, 0, 900, ("default", 8192, 1, 900, 8192 - 1 - 900 - 409)),
    ],
)
def test_budgets(spark, model, prompt, questions, window, output, want):
    row = spark.createDataFrame([(model, prompt, questions, window, output)], "m string, p string, q int, w int, o int")
    assert tuple(row.select(records.model_budget(*map(F.col, "mpqwo")).alias("b")).first().b) == want


def test_drafts(spark):
    said = [
        '[{"question_text": " What is force? ", "marks": 2.5, "options": {"A": "x", "B": "y"}}, {"question_text": "tiny"}, "text", 7]',
        '{"questions": [{"question_text": "Draw the map", "question_type": "map_work", "marks": "2", "difficulty": "easy", "options": {"A": "x", "B": "y"}, "correct_answer": " see "}]}',
        '{"other": []}', "no json", None, '[{"question_text": "Name the gas", "question_type": "ESSAY", "marks": "many", "options": ["x", "y"]}]',
    ]
    rows = spark.createDataFrame(list(enumerate(said)), "id int, answer string")
    got = {(r.id, r.position): r for r in records.valid_drafts(rows, "id").collect()}
    assert sorted(got) == [(0, 0), (1, 0), (5, 0)]
    assert tuple(got[0, 0])[2:] == ("What is force?", "MCQ", decimal.Decimal("2.50"), "MEDIUM", "INTERMEDIATE", "See explanation", {"A": "x", "B": "y"})
    assert tuple(got[1, 0])[2:] == ("Draw the map", "MAP_WORK", decimal.Decimal("2.00"), "EASY", "INTERMEDIATE", "see", None)
    assert tuple(got[5, 0])[2:5] == ("Name the gas", "MCQ", decimal.Decimal("1.00")) and got[5, 0].options == {"A": "True", "B": "False"}
    short = records.valid_drafts(rows.withColumn("question_type", F.lit("SHORT_ANSWER")).withColumn("marks", F.lit(4)), "id").where("id = 5").first()
    assert (short.question_type, short.marks, short.options) == ("SHORT_ANSWER", 4, None)


def test_figures_of_batches(spark):
    tiers = spark.createDataFrame([(1, 0, 1.0, 12, ["MCQ"]), (1, 1, 3.0, 25, ["LONG_ANSWER"]), (1, 2, 1.0, 3, ["DIAGRAM_BASED"]), (2, 0, 1.0, 4, ["MCQ"]), (2, 1, 2.0, 2, ["MCQ"]), (3, 0, 5.0, 0, ["MCQ"])], "paper_id int, tier int, marks double, count int, question_types array<string>")
    papers = spark.createDataFrame([(1, 11), (2, 9)], "paper_id int, figures int")
    got = sorted(tuple(r) for r in records.figure_batches(tiers, papers).collect())
    assert got == [(1, 0, 0, 10, 0, 0), (1, 1, 0, 2, 0, 0), (1, 2, 1, 10, 0, 5), (1, 3, 1, 10, 5, 5), (1, 4, 1, 5, 10, 1), (1, 5, 2, 3, 11, 0), (2, 0, 0, 4, 0, 0), (2, 1, 1, 2, 0, 1)]


def test_names(spark):
    rows = spark.createDataFrame([("st_a", k) for k in range(5)] + [("st_b", 0)], "base string, k int")
    taken = spark.createDataFrame([("st_a",), ("st_a_2",), ("st_a_3",), ("st_a_3",), ("st_c",), ("st_a_03",)], "username string")
    got = {(r.base, r.k): r.username for r in records.unique_names(rows, taken, "base", ["k"]).collect()}
    assert [got["st_a", k] for k in range(5)] == ["st_a_1", "st_a_4", "st_a_5", "st_a_6", "st_a_7"] and got["st_b", 0] == "st_b"


def test_figures_of_documents(spark):
    box = lambda x, y: (0.0, 0.0, x, y)
    rows = [(1, "text of a page that reads well", None, None, 0.9, [box(59.0, 100.0), box(60.0, 60.0), box(0.0, 9.0)]), (1, " \n", None, False, 0.9, None), (1, "", "blank", False, 0.9, []), (1, "", "image_only", True, 0.9, [box(5.0, 5.0)]), (None, "fine text", "mixed", False, 0.5, None)]
    pages = spark.createDataFrame(rows, "doc_id long, raw_text string, page_kind string, needs_review boolean, confidence double, pictures array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = {r.doc_id: r for r in records.document_figures(pages).collect()}
    assert (got[1].pages, got[1].empty_pages, got[1].review_rate, got[1].tiny_pictures, got[1].kinds) == (4, 1, 0.5, 2, {"digital_text": 2, "blank": 1, "image_only": 1})
    assert got[1].avg_garbage == pytest.approx(0.25, abs=0.01) and got[None].review_rate == 1


def test_pages_of_lists(spark):
    rows = spark.range(205)
    ids = lambda out: [r.id for r in out[0].collect()]
    paged = lambda **p: records.paged(rows, ["id"], p, asked=p.pop("asked", False))
    assert ids(paged()) == list(range(20)) and paged()[1] == 205
    assert ids(paged(page="3", page_size="7")) == list(range(14, 21)) and len(ids(paged(page_size=500))) == 100
    assert len(ids(paged(all="true"))) == 205 and paged(paginate="no")[1] is None and len(ids(paged(asked=True))) == 205
    assert len(ids(paged(asked=True, paginate="true"))) == 20 and len(ids(paged(asked=True, page=11))) == 5 and ids(paged(page="x", page_size="0")) == list(range(20))
