"""Marks of answers, scores of attempts, and the figures of deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.school import evaluate
from quillspark.functions.text import let
from quillspark.operators.assess import BATCH_PASS
from quillspark.shared import LIST, dealt, listed

#: Kinds of questions that a teacher marks (fixed values).
WRITTEN = ("SHORT_ANSWER", "LONG_ANSWER")


def _graded(answers: DataFrame, penalty: Column) -> DataFrame:
    """answers with `grade`: (is_correct, marks, rule) as the rules give it; a null is_correct waits for a teacher."""
    c = F.col
    return answers.withColumn("grade", evaluate(c("question_type"), c("marks"), c("correct_answer"), c("response"), c("options"), penalty))


def _totals(rows: DataFrame) -> DataFrame:
    """(attempt_id, score, status, pending): raw marks added up, not under 0; SUBMITTED while an answer waits."""
    pending = F.count_if(F.col("raw_marks").isNull())
    score = F.greatest(F.lit(0.0), F.coalesce(F.sum("raw_marks"), F.lit(0.0)))
    return rows.groupBy("attempt_id").agg(score.alias("score"), F.when(pending > 0, "SUBMITTED").otherwise("EVALUATED").alias("status"), pending.alias("pending"))


def graded_answers(answers: DataFrame, penalty: Column | None = None) -> DataFrame:
    """Answers with is_correct, marks_awarded (what is stored: never under 0) and raw_marks (what the score adds up).

    answers: (attempt_id, question_type, marks, correct_answer, response, options, ...). penalty: marks that a wrong
    choice costs.
    """
    rows = _graded(answers, F.lit(0.0) if penalty is None else penalty)
    raw = F.when(F.col("grade.is_correct").isNotNull(), F.coalesce("grade.marks", F.lit(0.0)))
    return rows.select(*answers.columns, F.col("grade.is_correct").alias("is_correct"), F.when(raw.isNotNull(), F.greatest(F.lit(0.0), raw)).alias("marks_awarded"), raw.alias("raw_marks"))


def attempt_scores(answers: DataFrame, penalty: Column | None = None) -> DataFrame:
    """(attempt_id, score, status, pending) when attempts are handed in: penalties lower a score, though stored marks are
    never negative."""
    return _totals(graded_answers(answers, penalty))


def reevaluated_scores(answers: DataFrame, penalty: Column | None = None) -> DataFrame:
    """Scores of another run over answers that have is_correct and marks_awarded already: stored marks stay as they are,
    so a penalty that was clamped when it was stored no longer counts; answers without marks are evaluated."""
    given = answers.withColumnsRenamed({"is_correct": "_correct", "marks_awarded": "_marks"})
    stored = F.when(F.col("_marks").isNotNull() & F.col("_correct").isNotNull(), F.col("_marks").cast("double"))
    return _totals(graded_answers(given, penalty).withColumn("raw_marks", F.coalesce(stored, "raw_marks")))


def manual_grades(answers: DataFrame, grades: DataFrame) -> DataFrame:
    """Answers with the grades that teachers gave.

    answers: (attempt_id, answer_id, marks, is_correct, marks_awarded, ...); grades: (answer_id, given, given_correct), one
    for an answer. A grade over the question's marks is refused (`refused`), and the answer stays as it was. Where
    given_correct is null, marks over 0 count as correct.
    """
    rows = answers.join(grades, "answer_id", "left")
    refused = F.coalesce(F.col("given") > F.col("marks"), F.lit(False))
    taken = F.col("given").isNotNull() & ~refused
    correct = F.when(taken, F.coalesce("given_correct", F.col("given") > 0)).otherwise(F.col("is_correct"))
    return rows.withColumn("refused", refused).withColumn("is_correct", correct).withColumn("marks_awarded", F.when(taken, F.col("given")).otherwise(F.col("marks_awarded"))).drop("given", "given_correct").select(*answers.columns, "refused")


def manual_scores(answers: DataFrame, attempts: DataFrame) -> DataFrame:
    """(attempt_id, score, status) after manual grading: the marks that there are, EVALUATED once none is missing."""
    sums = answers.groupBy("attempt_id").agg(F.coalesce(F.sum("marks_awarded"), F.lit(0.0)).alias("score"), F.count_if(F.col("marks_awarded").isNull()).alias("_open"))
    return attempts.select("attempt_id", "status").join(sums, "attempt_id").select("attempt_id", "score", F.when(F.col("_open") == 0, "EVALUATED").otherwise(F.col("status")).alias("status"))


def batch_stats(scores: DataFrame, delivery: str, total_marks: Column) -> DataFrame:
    """Figures of each delivery's scores: mean, upper median, highest, lowest and the share that reaches 40 % of the marks.

    scores: (<delivery>, score, and what total_marks names, which is one value for a delivery).
    """
    w = Window.partitionBy(delivery)
    ranked = scores.withColumn("_limit", total_marks.cast("double") * (BATCH_PASS / 100)).withColumn("_r", F.row_number().over(w.orderBy("score"))).withColumn("_n", F.count("*").over(w))
    n = F.count("*")
    return ranked.groupBy(delivery).agg(
        n.alias("attempts"), F.round(F.avg("score"), 2).alias("mean"), F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("score"))).alias("median"),
        F.max("score").alias("highest"), F.min("score").alias("lowest"), F.round(F.count_if(F.col("score") >= F.col("_limit")) / n * 100, 1).alias("pass_rate"),
    )


def roster_counts(deliveries: DataFrame, assigned: DataFrame, attempts: DataFrame) -> DataFrame:
    """Deliveries with how many students are assigned, have begun, handed in and been evaluated; none counts as 0.

    assigned: (delivery_id, student_id), distinct; attempts: (delivery_id, status).
    """
    students = assigned.groupBy("delivery_id").agg(F.count("*").alias("assigned"))
    begun = attempts.groupBy("delivery_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "SUBMITTED").alias("submitted"), F.count_if(F.col("status") == "EVALUATED").alias("evaluated"))
    return deliveries.join(students, "delivery_id", "left").join(begun, "delivery_id", "left").na.fill(0, ["assigned", "attempts", "submitted", "evaluated"])


def student_results(answers: DataFrame, attempts: DataFrame) -> DataFrame:
    """What a student sees of the answers: correctness, marks and key only once the attempt is EVALUATED."""
    rows = answers.join(attempts.select("attempt_id", "status"), "attempt_id")
    done = F.col("status") == "EVALUATED"
    waits = ~done | (F.col("question_type").isin(*WRITTEN) & F.col("marks_awarded").isNull())
    hidden = {c: F.when(done, F.col(c)).alias(c) for c in ("is_correct", "marks_awarded", "correct_answer")}
    return rows.select("attempt_id", "answer_id", "question_type", "marks", "response", *hidden.values(), waits.alias("pending"))


def teacher_results(answers: DataFrame) -> DataFrame:
    """What a teacher sees: everything, and which answers need a grade."""
    return answers.withColumn("needs_grading", F.col("question_type").isin(*WRITTEN) & F.col("marks_awarded").isNull())


# --- snapshots ------------------------------------------------------------------------------------------------------


def snapshots(questions: DataFrame, version: str = "version_id", position: str = "position") -> DataFrame:
    """(version, snapshot): the questions of each paper version as one ordered list, as they are now."""
    fields = [c for c in questions.columns if c not in (version, position)]
    listed = F.sort_array(F.collect_list(F.struct(position, F.struct(*fields).alias("q"))))
    return questions.groupBy(version).agg(F.transform(listed, lambda x: x["q"]).alias("snapshot"))


def blank_answers(attempts: DataFrame, versions: DataFrame, version: str = "version_id") -> DataFrame:
    """One empty answer for each question of an attempt's snapshot, in its order.

    Attempts of a version meet parts of its snapshot as lists, and what they give is dealt over all tasks by lists: rows are
    made where they are used.
    """
    starts = F.sequence(F.lit(0), F.size("snapshot") - 1, F.lit(LIST))
    parts = versions.where(F.size("snapshot") > 0).select(version, F.explode(F.transform(starts, lambda k: F.struct(k.alias("k"), F.slice("snapshot", k + 1, F.lit(LIST)).alias("q")))).alias("part"))
    met = dealt(listed(attempts, version, "attempt_id", "attempts").join(parts, version).select("attempts", "part"))
    rows = met.select("attempts", F.col("part.k").alias("k"), F.posexplode("part.q").alias("at", "q")).select((F.col("k") + F.col("at")).alias("position"), "q", F.explode("attempts").alias("attempt_id"))
    return rows.select("attempt_id", "position", "q.*", F.lit("").alias("response"), F.lit(None).cast("boolean").alias("is_correct"), F.lit(None).cast("double").alias("marks_awarded"))


def changed_snapshots(before: DataFrame, after: DataFrame, version: str = "version_id") -> DataFrame:
    """Versions whose snapshot is no longer what it was, though it must not change once finalized."""
    both = before.select(version, F.to_json("snapshot").alias("_a")).join(after.select(version, F.to_json("snapshot").alias("_b")), version)
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(version)


def student_paper(questions: DataFrame) -> DataFrame:
    """A paper without its key: neither answers nor difficulty nor sources."""
    return questions.drop("correct_answer", "correct_option_text", "difficulty", "source_reference", "topic_name")


def teacher_paper(questions: DataFrame) -> DataFrame:
    """A paper with the text of the right option, empty where there is none."""
    option = F.try_element_at(F.col("options"), F.col("correct_answer"))
    return questions.withColumn("correct_option_text", F.when(F.col("question_type") == "MCQ", F.coalesce(option, F.lit(""))).otherwise(""))


def section_totals(questions: DataFrame, version: str = "version_id", section: str = "section") -> DataFrame:
    """Questions and marks of each section, and the distinct marks in order; a question without marks counts 1."""
    marks = F.coalesce(F.nullif(F.col("marks").cast("double"), F.lit(0.0)), F.lit(1.0))
    return questions.groupBy(version, section).agg(F.count("*").alias("questions"), F.sum(marks).alias("total"), F.sort_array(F.collect_set(marks)).alias("marks"))


def append_event(log: Column, event: Column) -> Column:
    """An event list with one more event; a null list is empty."""
    return F.when(log.isNull(), F.array(event)).otherwise(F.concat(log, F.array(event)))


def last_events(log: Column, n: int = 10) -> Column:
    return let(F.size(log), lambda m: F.slice(log, F.greatest(F.lit(1), m - (n - 1)), F.lit(n)))


def merged_spec(stored: dict, request: dict) -> dict:
    """A specification in which what a request names, other than None, replaces what is stored."""
    return stored | {k: v for k, v in request.items() if v is not None}


def assignable(students: DataFrame, wanted: DataFrame, user: dict, classes: DataFrame, target_class: int | None = None) -> DataFrame:
    """`in_scope` for each wanted student id: whether the user may assign a test to them.

    students: (id, school_id, created_by_id, class_section_id); wanted: (id); classes: (class_section_id) of the user. Users
    without a school may assign to anyone, those with a school-wide role to their school, and teachers to their own
    students, their classes and the target class. Ids that name no student are out of scope.
    """
    rows = wanted.select("id").distinct().join(students.withColumn("_known", F.lit(True)), "id", "left")
    rows = rows.join(classes.select("class_section_id").distinct().withColumn("_mine", F.lit(True)), "class_section_id", "left")
    scope = F.col("_known")
    if user.get("school_id") is not None:
        scope = scope & (F.col("school_id") == user["school_id"])
        if not user.get("school_wide"):
            near = F.coalesce(F.col("created_by_id") == user["id"], F.lit(False)) | F.coalesce("_mine", F.lit(False))
            if target_class is not None:
                near = near | F.coalesce(F.col("class_section_id") == target_class, F.lit(False))
            scope = scope & near
    return rows.select("id", F.coalesce(scope, F.lit(False)).alias("in_scope"))


def chosen_students(explicit: DataFrame, of_class: DataFrame) -> DataFrame:
    """(student_id): those named and those of a class, each once."""
    return explicit.select("student_id").unionByName(of_class.select("student_id")).distinct()


# --- users and imports ----------------------------------------------------------------------------------------------


def user_counts(users: DataFrame, label: str = "role_label") -> DataFrame:
    """Users by role; who enters and validates counts in both of these."""
    is_ = lambda *names: F.count_if(F.col(label).isin(*names))
    return users.agg(
        F.count("*").alias("total"), is_("Super Admin").alias("super_admin"), is_("School Admin").alias("school_admin"), is_("Teacher").alias("teacher"), is_("Student").alias("student"),
        is_("Question Bank Manager").alias("qbm"), is_("Data Entry Operator", "DEO & Validator").alias("deo"), is_("Validator", "DEO & Validator").alias("validator"),
    )


def upload_policy(users: DataFrame, grants: DataFrame, capability: str, group: str = "role_group") -> DataFrame:
    """(group, total, with_permission): active users of each role group, and those of them who hold a capability."""
    held = grants.where(F.col("capability") == capability).select(F.col("user_id").alias("id")).distinct().withColumn("_held", F.lit(True))
    return users.where("is_active").join(held, "id", "left").groupBy(group).agg(F.count("*").alias("total"), F.count("_held").alias("with_permission"))


def import_summary(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    return rows.groupBy(outcome).agg(F.count("*").alias("n"))


def teacher_duties(rows: DataFrame) -> DataFrame:
    """(class_section, teacher_id, subject): what an import of teachers (teacher_id, class_section, subjects) sets up: the
    class teacher of a class (null subject; the last row wins) and the teacher of each of its subjects."""
    own = rows.where("class_section is not null").groupBy("class_section").agg(F.max_by("teacher_id", "row").alias("teacher_id")).withColumn("subject", F.lit(None).cast("string"))
    taught = rows.where("class_section is not null").select("class_section", "teacher_id", F.explode("subjects").alias("subject"), "row")
    taught = taught.groupBy("class_section", "subject").agg(F.max_by("teacher_id", "row").alias("teacher_id"))
    return own.unionByName(taught.select("class_section", "teacher_id", "subject"))


def edited_metadata(questions: DataFrame, variants: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, variants and changes after validators' edits (id, difficulty, marks; null: as it was).

    A question's new difficulty goes to all its variants. Changes are (id, field, old, new).
    """
    wanted = edits.select("id", F.col("difficulty").alias("_d"), F.col("marks").cast("double").alias("_m"))
    rows = questions.join(wanted, "id", "left")
    fields = F.array(F.struct(F.lit("difficulty").alias("field"), F.col("difficulty").alias("old"), F.col("_d").alias("new")), F.struct(F.lit("marks").alias("field"), F.col("marks").cast("double").cast("string").alias("old"), F.col("_m").cast("string").alias("new")))
    changes = rows.select("id", F.explode(fields).alias("c")).select("id", "c.*").where("new is not null and not (old <=> new)")
    made = rows.withColumn("difficulty", F.coalesce("_d", "difficulty")).withColumn("marks", F.coalesce(F.col("_m").cast(questions.schema["marks"].dataType), "marks")).select(*questions.columns)
    cascade = variants.join(made.select(F.col("id").alias("question_id"), F.col("difficulty").alias("_d")), "question_id", "left")
    return made, cascade.withColumn("difficulty", F.coalesce("_d", "difficulty")).select(*variants.columns), changes


def missing_hierarchy(rows: DataFrame, books: DataFrame, chapters: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books, chapters and topics that ingested rows name and that do not exist yet.

    rows: (board, book_title, subject, grade, chapter_title, topic_name), blanks filled with defaults. New chapters are
    numbered after those of their book, by title.
    """
    fill = lambda c, rest: F.coalesce(F.nullif(F.trim(c), F.lit("")), rest)
    named = rows.select(fill("board", F.lit("CBSE")).alias("board"), fill("subject", F.lit("General")).alias("subject"), fill("grade", F.lit("Standard")).alias("grade"), "book_title", fill("chapter_title", F.lit("Chapter 1")).alias("chapter_title"), fill("topic_name", F.lit("General Topic")).alias("topic_name"))
    named = named.withColumn("book_title", fill("book_title", F.concat("subject", F.lit(" ("), "grade", F.lit(")")))).distinct()
    book, chapter = ["board", "book_title", "subject", "grade"], ["board", "book_title", "subject", "grade", "chapter_title"]
    new_books = named.select(*book).distinct().join(books.select(*book), book, "left_anti")
    new_chapters = named.select(*chapter).distinct().join(chapters.select(*chapter), chapter, "left_anti")
    known = chapters.groupBy(*book).agg(F.count("*").alias("_n"))
    order = F.row_number().over(Window.partitionBy(*book).orderBy("chapter_title"))
    new_chapters = new_chapters.withColumn("_r", order).join(known, book, "left").withColumn("chapter_order", (F.coalesce("_n", F.lit(0)) + F.col("_r")).cast("long")).drop("_n", "_r")
    new_topics = named.join(topics.select(*chapter, "topic_name"), [*chapter, "topic_name"], "left_anti").select(*chapter, "topic_name")
    return new_books, new_chapters, new_topics


def deliverable(versions: DataFrame) -> DataFrame:
    """Versions that may be delivered: drafts may not."""
    return versions.where(F.col("status") != "DRAFT")


def next_job(jobs: DataFrame, dispatched: DataFrame) -> DataFrame:
    """The job that a worker takes next: the oldest in extraction, or else the oldest that waits; not one that has been
    dispatched elsewhere."""
    rows = jobs.where(F.col("status").isin("EXTRACTING", "PENDING")).join(dispatched.select("id"), "id", "left_anti")
    return rows.orderBy(F.col("status") != "EXTRACTING", "created_at", "id").limit(1)
