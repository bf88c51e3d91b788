"""Scores, snapshots, specifications, duplicates with options, and the other operators on papers and pages."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quillspark.operators import documents, grading, relational, select
from quillspark.operators import text as texts
from quillspark.streaming import jobs

ANSWER = "attempt_id long, answer_id long, question_type string, marks double, correct_answer string, response string, options map<string,string>"


def test_scores_and_reevaluation(spark):
    rows = [(1, 1, "MCQ", 2.0, "B", "b", None), (1, 2, "MCQ", 2.0, "B", "c", None), (2, 3, "MCQ", 1.0, "A", "d", None), (3, 4, "LONG_ANSWER", 5.0, "", "essay", None), (3, 5, "MCQ", 1.0, "A", "", None)]
    answers = spark.createDataFrame(rows, ANSWER)
    graded = grading.graded_answers(answers, F.lit(1.0))
    assert {r.answer_id: (r.marks_awarded, r.raw_marks) for r in graded.collect()} == {1: (2.0, 2.0), 2: (0.0, -1.0), 3: (0.0, -1.0), 4: (None, None), 5: (0.0, 0.0)}
    score = lambda df: {r.attempt_id: (r.score, r.status, r.pending) for r in df.collect()}
    assert score(grading.attempt_scores(answers, F.lit(1.0))) == {1: (1.0, "EVALUATED", 0), 2: (0.0, "EVALUATED", 0), 3: (0.0, "SUBMITTED", 1)}
    # stored marks are clamped, so running again raises the score of attempt 1
    assert score(grading.reevaluated_scores(graded.drop("raw_marks"), F.lit(1.0)))[1] == (2.0, "EVALUATED", 0)
    grades = spark.createDataFrame([(4, 4.0, None), (5, 9.0, None)], "answer_id long, given double, given_correct boolean")
    marked = grading.manual_grades(graded.drop("raw_marks"), grades)
    assert {r.answer_id: (r.is_correct, r.marks_awarded, r.refused) for r in marked.where("attempt_id = 3").collect()} == {4: (True, 4.0, False), 5: (False, 0.0, True)}
    attempts = spark.createDataFrame([(3, "SUBMITTED")], "attempt_id long, status string")
    assert [(r.score, r.status) for r in grading.manual_scores(marked, attempts).collect()] == [(4.0, "EVALUATED")]
    stats = grading.batch_stats(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, 3.0)], "d long, score double"), "d", F.lit(5)).first()
    assert (stats["mean"], stats["median"], stats.highest, stats.lowest, stats.pass_rate) == (2.5, 3.0, 4.0, 1.0, 75.0)
    seen = grading.student_results(marked, attempts).collect()
    assert all(r.pending and r.correct_answer is None for r in seen) and len(seen) == 2


def test_snapshots(spark):
    questions = spark.createDataFrame([(1, 2, 20, 3.0), (1, 1, 10, 2.0)], "version_id long, position long, question_id long, marks double")
    versions = grading.snapshots(questions)
    attempts = spark.createDataFrame([(7, 1)], "attempt_id long, version_id long")
    assert [(r.position, r.question_id, r.response, r.marks_awarded) for r in grading.blank_answers(attempts, versions).orderBy("position").collect()] == [(0, 10, "", None), (1, 20, "", None)]
    assert grading.changed_snapshots(versions, versions).count() == 0
    assert grading.changed_snapshots(versions, grading.snapshots(questions.withColumn("marks", F.lit(1.0)))).count() == 1
    log = spark.sql("select array(1, 2) a, cast(null as array<int>) b").select(grading.append_event(F.col("a"), F.lit(3)), grading.append_event(F.col("b"), F.lit(3)), grading.last_events(F.sequence(F.lit(1), F.lit(12))), grading.last_events(F.col("a"))).first()
    assert list(log) == [[1, 2, 3], [3], list(range(3, 13)), [1, 2]]
    assert grading.merged_spec({"a": 1, "b": 2}, {"a": None, "b": 3}) == {"a": 1, "b": 3}


POOL = "id long, topic_id long, difficulty string, marks double, question_type string, subject string, position long"


def test_specifications(spark):
    rows = [(1, 1, "EASY", 1.0, "MCQ", "Physics", 0), (2, 1, "HARD", 2.0, "MCQ", "Physics", 1), (3, 2, "EASY", 2.0, "SHORT_ANSWER", "Chemistry", 2), (4, 2, "EASY", 3.0, "LONG_ANSWER", "Chemistry", 3), (5, 3, "MEDIUM", 2.0, "MCQ", "", 4)]
    pool = spark.createDataFrame(rows, POOL)

    def chosen(spec):
        got, error = select.select_for_specification(pool, spec)
        return sorted(r.id for r in got.collect()), error

    assert chosen({"subject_breakdown": [{"subject": "physics", "marks": 3}, {"subject": "chem", "marks": 2}]}) == ([1, 2, 3], None)
    assert chosen({"subject_breakdown": [{"subject": "biology", "marks": 3}]}) == ([], "no_questions:biology")
    assert chosen({"difficulty_distribution": {"easy": 2, "hard": 1}}) == ([1, 2, 3], None)
    assert chosen({"difficulty_distribution": {"easy": 50, "hard": 25}, "quantity": 4}) == ([1, 2, 3], None)
    assert chosen({"difficulty_distribution": {"hard": 3}}) == ([], "too_few:HARD:3:1")
    assert chosen({"difficulty_distribution": {"easy": 0}, "mark_distribution": [{"marks": 2, "count": 1, "formats": "MCQ"}, {"marks": 2, "count": 2}]}) == ([2, 3, 5], None)
    assert chosen({"mark_distribution": [{"marks": 9, "count": 1}]}) == ([], "too_few:9:1:0")
    assert chosen({"total_marks": 999}) == ([], "pool_too_small")
    assert sum(r[3] for r in rows if r[0] in chosen({"total_marks": 5})[0]) == 5
    assert chosen({"quantity": 3}) == ([1, 3, 5], None)
    assert chosen({})[0] == [1, 2, 3, 4, 5]


def test_labels(spark):
    got = spark.range(0, 20000).select(select.version_label(F.col("id")).alias("v")).collect()
    assert [got[i].v for i in (0, 25, 26, 701, 702, 18277, 18278)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"] and len({r.v for r in got}) == 20000


Q = "id long, t string, question_type string, options map<string,string>"


def test_questions_with_options(spark):
    metals = {"A": "Iron and steel", "B": "Gold", "C": "Helium", "D": "Copper wire"}
    turned = {"A": "Gold", "B": "copper wire!", "C": "iron and steel", "D": "helium"}
    bank = spark.createDataFrame([(1, "Which of these is a noble gas?", "MCQ", metals), (2, "State Ohm's law for a conductor.", "SHORT_ANSWER", None), (3, "", "MCQ", None)], Q)
    asked = spark.createDataFrame([(10, "Pick the element that reacts least", "MCQ", turned), (11, "state ohm s law for a conductor", "SHORT_ANSWER", None), (12, "Explain cellular respiration steps", "SHORT_ANSWER", None), (13, None, "MCQ", turned)], Q)
    pairs = lambda **k: {(r.x, r.y): r.reason for r in texts.similar_pairs(asked.withColumnRenamed("id", "x"), bank.withColumnRenamed("id", "y"), "t", "x", "y", options="options", **k).collect()}
    assert pairs(stored=False) == {(10, 1): "MCQ_OPTION_MATCH", (11, 2): "EXACT_NORMALIZED"}
    assert pairs() == {(11, 2): "EXACT_NORMALIZED"}
    batch = asked.unionByName(bank).withColumn("g", F.lit(1))
    got = {r.id: (r.duplicate_of, r.reason) for r in texts.greedy_unique(batch, "g", "id", "t", options="options").collect()}
    assert got[10] == (1, "MCQ_OPTION_MATCH") and got[11] == (2, "EXACT_NORMALIZED") and got[12] == (None, None)


def test_pairs_are_those_of_brute_force(spark):
    words = "force mass acceleration state define light current law energy motion heat atoms".split()
    rows = [(i, " ".join(words[(i * k + k * k) % 12] for k in range(1, 4 + i % 6))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r.x, r.y): r.score for r in texts.similar_pairs(df.withColumnRenamed("id", "x"), df.withColumnRenamed("id", "y"), "t", "x", "y").collect()}
    ready = {r.id: texts._Question(r.id, r.t, r.n, list(r.s), None) for r in df.select("id", "t", texts.normalize_question(F.col("t")).alias("n"), texts.stems(F.col("t")).alias("s")).collect()}
    want = {(a, b): texts._alike(x.normal, y.normal, x.stems, y.stems) for a, x in ready.items() for b, y in ready.items()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.8} and len(got) > 200
    best = texts.best_match(texts.similar_pairs(df.withColumnRenamed("id", "x"), df.withColumnRenamed("id", "y"), "t", "x", "y"), "x", "y")
    assert all(ready[r.x].normal == ready[r.y].normal for r in best.collect())


def test_ranges(spark):
    points = spark.createDataFrame([(k, float(p)) for k, p in enumerate([0, 5, 10, 12, 55, 99, -3, 400])], "k long, p double")
    ranges = spark.createDataFrame([(1, 0.0, 10.0), (2, 8.0, 60.0), (3, -5.0, -1.0), (4, 5.0, 5.0)], "n int, low double, high double")
    got = {r.k: r.hit and r.hit.n for r in relational.first_range(points, ranges, "p", "low", "high", ["n"], ["k"]).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: None, 6: 3, 7: None}
    pool = spark.createDataFrame([("Applied Physics", 0), ("physics", 1), ("Math", 2)], "subject string, position long")
    wanted = spark.createDataFrame([("Physics",), ("Mathematics",), ("Art",)], "subject string")
    assert {r.subject: r.pool_subject for r in documents.subject_pool(wanted, pool).collect()} == {"Physics": "physics", "Mathematics": "math", "Art": None}
    plan = relational.first_range(points, ranges, "p", "low", "high", ["n"], ["k"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pages_and_captions(spark):
    images = spark.createDataFrame([(1, 1, 100.0, 200.0), (1, 2, 500.0, 600.0), (2, 3, 0.0, 50.0)], "page long, image_id long, y0 double, y1 double")
    captions = spark.createDataFrame([(1, 1, "Fig. 3: A lens", 210.0, 220.0), (1, 2, "above", 60.0, 80.0), (1, 3, "far", 700.0, 710.0), (2, 4, "other", 100.0, 110.0)], "page long, caption_id long, text string, y0 double, y1 double")
    got = {r.image_id: r.caption and r.caption.caption_id for r in texts.nearest_caption(images, captions, ["page"]).collect()}
    assert got == {1: 1, 2: None, 3: None}
    assert [r[0] for r in captions.select(texts.bare_caption(F.col("text"))).collect()][0] == "A lens"
    boxes = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (1, [0.0, 3.0, 2.0, 9.0])], "k long, bbox array<double>")
    assert texts.enclosing_box(boxes, ["k"]).first().bbox == [0.0, 2.0, 3.0, 9.0]
    figures = spark.createDataFrame([(1, "F1", "A lens", "x.png"), (1, "F2", "F1", "y.png")], "doc_id long, figure_id string, title string, path string")
    wanted = spark.createDataFrame([(1, "f1"), (1, "a LENS"), (1, "none")], "doc_id long, figure string")
    assert {r.figure: r.found and r.found.path for r in texts.attached_figures(wanted, figures).collect()} == {"f1": "x.png", "a LENS": "x.png", "none": None}
    page = spark.createDataFrame([(1, "# Motion\n\nExample 2: a car\nmoves\n\n$$F = ma$$\n\nplain $x$ text that goes on for more than twelve words so it is prose = yes")], "page long, markdown string")
    got = [(r.section_type, r.heading, r.formulas) for r in texts.markdown_sections(page).orderBy("position").collect()]
    assert got == [("PARAGRAPH", "Motion", []), ("SOLVED_EXAMPLE", "Example 2", []), ("FORMULA", "Formula", ["F = ma"]), ("PARAGRAPH", "", ["x"])]
    short = spark.createDataFrame([(1, 2, "b", 9), (1, 2, "a", 5), (1, 3, "c", 7)], "doc long, chapter_number long, title string, start_page long")
    assert {(r.chapter_number, r.title) for r in texts.unique_chapters(short, "doc").collect()} == {(2, "a"), (3, "c")}


def test_full_width_blocks_come_first(spark):
    rows = [(1, 10.0, 590.0, 20.0, 40.0), (1, 10.0, 590.0, 300.0, 340.0), (1, 20.0, 170.0, 100.0, 200.0), (1, 220.0, 370.0, 90.0, 200.0), (1, 10.0, 590.0, 700.0, 720.0), (2, 0.0, 600.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "page long, x0 double, x1 double, y0 double, y1 double")
    placed = texts.page_columns(df, ["page"], F.lit(600.0))
    got = texts.reading_order(placed, ["page"], F.lit(800.0)).orderBy("page", "reading").collect()
    assert [(r.y0, r.column_no) for r in got] == [(20.0, 0), (300.0, 0), (100.0, 1), (90.0, 2), (700.0, 0), (5.0, 1)]


def test_contents(spark):
    pages = spark.createDataFrame([(1, "Table of Contents\n1. Real Numbers ...... 1\nChapter IV: Light  25\nXX - Sound\t\t30"), (2, "1. Real Numbers ...... 1")], "doc long, t string")
    assert [(r.doc, r.number, r.title, r.page) for r in texts.toc_lines(pages, "doc", "t").collect()] == [(1, 1, "Real Numbers", 1), (1, 4, "Light", 25), (1, 1, "Sound", 30)]
    span = "doc long, number long, title string, start_page long, end_page long"
    want, found = spark.createDataFrame([(1, 1, "Motion", 1, 15), (1, 2, "Light", 16, 30), (3, 1, "A", 1, 2)], span), spark.createDataFrame([(1, 1, "Motion", 1, 16), (1, 2, "Light", 17, 30), (2, 1, "X", 1, 2)], span)
    docs = spark.createDataFrame([(k, 30) for k in (1, 2, 3, 4)], "doc long, total_pages long")
    scores = texts.match_scores(texts.match_chapters(want, found, "doc"), want, found, docs, "doc")
    got = {r.doc: (r.precision, r.recall, r.range_accuracy and round(r.range_accuracy, 4)) for r in scores.collect()}
    assert got == {1: (1.0, 1.0, round(1 - 1 / 30, 4)), 2: (0.0, None, 0.0), 3: (0.0, 0.0, 0.0), 4: (None, None, None)}


def test_chunk_ends_and_headings(spark):
    text = "# One\n" + "Is it so?\n" * 12 + "Yes! " * 20 + "# Two\n" + "word " * 60
    assert texts.cut_places("a. b! c?\nd e", 0) == [9, 6, 3, 11]
    got = texts.chunks(spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "Just $x$.")], "doc_id long, text string"), size=120, overlap=20).collect()
    first = [r for r in got if r.doc_id == 1]
    assert all(r.chunks == len(first) for r in first) and first[0].heading == "#" and first[-1].heading == "#" and [r.overlap for r in first][:2] == [0, 20]
    assert [r.formulas for r in got if r.doc_id == 4] == [["$x$"]]


def test_signatures(spark):
    body, secret = '{"job": 1, "é": 2}', b"k" * 70
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(now, body, hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()), (now, body, "0" * 64), (now - dt.timedelta(hours=1), body, hmac.new(secret, body.encode(), hashlib.sha256).hexdigest())]
    assert documents.fresh_signature(spark.createDataFrame(rows, "sent_at timestamp, body string, signature string"), secret, F.lit(now)).count() == 1


def test_scope_edits_and_hierarchy(spark):
    students = spark.createDataFrame([(1, 5, 2, 7), (2, 5, 9, 8), (3, 6, 2, 7), (4, 5, 9, 9)], "id long, school_id long, created_by_id long, class_section_id long")
    wanted = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 99)], "id long")
    mine = spark.createDataFrame([(8,)], "class_section_id long")
    scope = lambda u, **k: {r.id for r in grading.assignable(students, wanted, u, mine, **k).where("in_scope").collect()}
    assert scope({"school_id": 5, "id": 2}) == {1, 2} and scope({"school_id": 5, "id": 2}, target_class=9) == {1, 2, 4}
    assert scope({"school_id": 5, "id": 2, "school_wide": True}) == {1, 2, 4} and scope({"school_id": None, "id": 1}) == {1, 2, 3, 4}
    questions = spark.createDataFrame([(1, "EASY", 2.0), (2, "HARD", 1.0)], "id long, difficulty string, marks double")
    variants = spark.createDataFrame([(10, 1, "EASY"), (11, 2, "HARD")], "id long, question_id long, difficulty string")
    made, cascade, changes = grading.edited_metadata(questions, variants, spark.createDataFrame([(1, "HARD", 2.0), (2, None, 3.0)], "id long, difficulty string, marks double"))
    assert {(r.id, r.difficulty, r.marks) for r in made.collect()} == {(1, "HARD", 2.0), (2, "HARD", 3.0)} and {r.difficulty for r in cascade.collect()} == {"HARD"}
    assert {(r.id, r.field, r.old, r.new) for r in changes.collect()} == {(1, "difficulty", "EASY", "HARD"), (2, "marks", "1.0", "3.0")}
    row = spark.createDataFrame([(" ", None, "Physics", "9", "Optics", "Lens"), ("CBSE", "Old", "Physics", "9", "", "")], "board string, book_title string, subject string, grade string, chapter_title string, topic_name string")
    old = spark.createDataFrame([("CBSE", "Old", "Physics", "9", "Waves")], "board string, book_title string, subject string, grade string, chapter_title string")
    books, chapters, topics = grading.missing_hierarchy(row, old, old, old.withColumn("topic_name", F.lit("t")))
    assert {r.book_title for r in books.collect()} == {"Physics (9)"} and {(r.chapter_title, r.chapter_order) for r in chapters.collect()} == {("Optics", 1), ("Chapter 1", 2)} and topics.count() == 2
    duties = grading.teacher_duties(spark.createDataFrame([(1, 7, "9-A", ["Maths"]), (2, 8, "9-A", ["Maths", "Art"])], "row long, teacher_id long, class_section string, subjects array<string>"))
    assert {(r.subject, r.teacher_id) for r in duties.collect()} == {(None, 8), ("Maths", 8), ("Art", 8)}


def test_final_payload_and_durations(spark):
    stored = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "job_id long, page_number long, raw_text string")
    final = spark.createDataFrame([(1, 1, "new")], "job_id long, page_number long, raw_text string")
    assert {tuple(r) for r in jobs.replace_jobs(stored, final).collect()} == {(1, 1, "new"), (2, 1, "c")}
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, t + dt.timedelta(seconds=3725), None), (2, t, None, t + dt.timedelta(seconds=60)), (3, t, t, None)]
    got = jobs.durations(spark.createDataFrame(rows, "id long, started_at timestamp, completed_at timestamp, updated_at timestamp"))
    assert {r.id: (r.seconds, r.took) for r in got.collect()} == {1: (3725, "1h 2m 5s"), 2: (60, "1m"), 3: (0, "0s")}


def test_answers_of_one_version_are_dealt_over_all_tasks(spark):
    questions = spark.range(600).select(F.lit(1).alias("version_id"), F.col("id").alias("position"), F.col("id").alias("question_id"))
    attempts = spark.range(500).select(F.when(F.col("id") > 0, F.col("id")).alias("attempt_id"), F.lit(1).alias("version_id"))
    rows = grading.blank_answers(attempts, grading.snapshots(questions))
    held = {r.p: r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    assert sum(held.values()) == 300000 and max(held.values()) < 150000
    assert rows.where("position = question_id").select("attempt_id", "position").distinct().count() == 300000


def test_captions_meet_images_page_by_page_over_all_tasks(spark):
    images = spark.range(200).selectExpr("id AS page", "1 AS image_id", "200.0D AS y0", "250.0D AS y1")
    captions = spark.range(600).selectExpr("id % 150 AS page", "id AS caption_id", "'t' AS text", "(id div 150) * 30.0D + 240 AS y0", "(id div 150) * 30.0D + 248 AS y1")
    got = texts.nearest_caption(images, captions, ["page"])
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.page: r.caption and r.caption.caption_id for r in got.collect()} == {p: p + 150 if p < 150 else None for p in range(200)}
