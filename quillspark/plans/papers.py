"""Registered queries on grading, snapshots, users and the curriculum, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import grading
from quillspark.plans.queries import query
from quillspark.sources.tables import read_table


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Lines as answers of attempts (orders): choices, numbers and essays with responses that are right, wrong or blank."""
    c, line = F.col, read_table(spark, d, "lineitem")
    kind = F.when(c("l_returnflag") == "N", "MCQ").when(c("l_returnflag") == "R", "SHORT_ANSWER").otherwise("LONG_ANSWER")
    letter, number = F.chr(65 + c("l_partkey") % 4), c("l_quantity").cast("int").cast("string")
    choice = F.when(c("l_suppkey") % 7 == 0, "").otherwise(F.chr(97 + c("l_suppkey") % 5))
    said = F.when(c("l_suppkey") % 11 == 0, "").otherwise((c("l_quantity").cast("int") + (c("l_linenumber") % 2) * 3).cast("string"))
    return line.select(
        c("l_orderkey").alias("attempt_id"), c("l_linenumber").alias("number"), kind.alias("question_type"), (1.0 + c("l_linenumber") % 4).alias("marks"), F.when(kind == "MCQ", letter).otherwise(number).alias("correct_answer"),
        F.when(kind == "MCQ", choice).when(kind == "SHORT_ANSWER", said).otherwise("an essay").alias("response"), F.lit(None).cast("map<string,string>").alias("options"),
    )


_ANSWERS = """WITH a AS (SELECT l_orderkey AS attempt_id, l_linenumber AS number, CASE l_returnflag WHEN 'N' THEN 'MCQ' WHEN 'R' THEN 'SHORT_ANSWER' ELSE 'LONG_ANSWER' END AS question_type,
  CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_suppkey % 7 = 0 THEN 0.0 WHEN l_suppkey % 5 = l_partkey % 4 THEN 1.0 + l_linenumber % 4 ELSE -0.25 END
    WHEN l_returnflag = 'R' AND l_suppkey % 11 <> 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 1.0 + l_linenumber % 4 ELSE 0.0 END END AS raw FROM lineitem),
s AS (SELECT attempt_id, CAST(greatest(0, coalesce(sum(raw), 0)) AS DOUBLE) AS score, CASE WHEN count(*) FILTER (raw IS NULL) > 0 THEN 'SUBMITTED' ELSE 'EVALUATED' END AS status, count(*) FILTER (raw IS NULL) AS pending FROM a GROUP BY 1)
"""


@query(_ANSWERS + "SELECT * FROM s")
def attempt_scores(spark: SparkSession, d: str) -> DataFrame:
    return grading.attempt_scores(_answers(spark, d), F.lit(0.25))


@query(_ANSWERS + """SELECT attempt_id, CAST(greatest(0, coalesce(sum(CASE WHEN number % 2 = 0 THEN greatest(0, raw) ELSE raw END), 0)) AS DOUBLE) AS score,
CASE WHEN count(*) FILTER (raw IS NULL) > 0 THEN 'SUBMITTED' ELSE 'EVALUATED' END AS status, count(*) FILTER (raw IS NULL) AS pending FROM a GROUP BY 1""")
def reevaluated_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every second answer has its marks already, clamped when they were stored."""
    stored = grading.graded_answers(_answers(spark, d), F.lit(0.25)).drop("raw_marks")
    even = F.col("number") % 2 == 0
    known = stored.withColumn("is_correct", F.when(even, F.col("is_correct"))).withColumn("marks_awarded", F.when(even, F.col("marks_awarded")))
    return grading.reevaluated_scores(known, F.lit(0.25))


@query(_ANSWERS + """, r AS (SELECT attempt_id % 50 AS delivery_id, score, row_number() OVER (PARTITION BY attempt_id % 50 ORDER BY score) AS r, count(*) OVER (PARTITION BY attempt_id % 50) AS n FROM s)
SELECT delivery_id, count(*) AS attempts, round(avg(score) + 1e-9, 2) AS mean, max(score) FILTER (r = n // 2 + 1) AS median, max(score) AS highest, min(score) AS lowest, round(count(*) FILTER (score >= 8) * 100.0 / count(*) + 1e-9, 1) AS pass_rate FROM r GROUP BY 1""")
def batch_stats(spark: SparkSession, d: str) -> DataFrame:
    scores = grading.attempt_scores(_answers(spark, d), F.lit(0.25)).withColumn("delivery_id", F.col("attempt_id") % 50)
    return grading.batch_stats(scores, "delivery_id", F.lit(20.0))


def _marked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as answers of attempts (customers), those that are F marked already; and the grades that teachers give."""
    k, done = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    orders = read_table(spark, d, "orders")
    answers = orders.select(F.col("o_custkey").alias("attempt_id"), k.alias("answer_id"), F.when(k % 4 == 0, "MCQ").otherwise("LONG_ANSWER").alias("question_type"), F.lit(5.0).alias("marks"), F.when(done, F.lit(True)).alias("is_correct"), F.when(done, F.lit(3.0)).alias("marks_awarded"), F.lit("r").alias("response"), F.lit("k").alias("correct_answer"))
    grades = orders.where(k % 3 == 0).select(k.alias("answer_id"), (k % 8).cast("double").alias("given"), F.when(k % 9 == 0, F.lit(False)).alias("given_correct"))
    return answers, grades


_MARKED = """WITH a AS (SELECT o_custkey AS attempt_id, o_orderkey AS answer_id, CASE WHEN o_orderkey % 4 = 0 THEN 'MCQ' ELSE 'LONG_ANSWER' END AS question_type, CASE WHEN o_orderstatus = 'F' THEN true END AS c, CASE WHEN o_orderstatus = 'F' THEN 3.0 END AS m,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 8 AS DOUBLE) END AS g FROM orders),
m AS (SELECT attempt_id, answer_id, question_type, CASE WHEN g <= 5 THEN CASE WHEN answer_id % 9 = 0 THEN false ELSE g > 0 END ELSE c END AS is_correct, CASE WHEN g <= 5 THEN g ELSE m END AS marks_awarded, coalesce(g > 5, false) AS refused FROM a)
"""


@query(_MARKED + "SELECT answer_id, is_correct, CAST(marks_awarded AS DOUBLE) AS marks_awarded, refused FROM m")
def manual_grades(spark: SparkSession, d: str) -> DataFrame:
    return grading.manual_grades(*_marked(spark, d)).select("answer_id", "is_correct", "marks_awarded", "refused")


@query(_MARKED + "SELECT attempt_id, CAST(coalesce(sum(marks_awarded), 0) AS DOUBLE) AS score, CASE WHEN count(*) = count(marks_awarded) THEN 'EVALUATED' ELSE 'SUBMITTED' END AS status FROM m GROUP BY 1")
def manual_scores(spark: SparkSession, d: str) -> DataFrame:
    attempts = read_table(spark, d, "customer").select(F.col("c_custkey").alias("attempt_id"), F.lit("SUBMITTED").alias("status"))
    return grading.manual_scores(grading.manual_grades(*_marked(spark, d)), attempts)


@query(_MARKED + """SELECT answer_id, CASE WHEN attempt_id % 2 = 0 THEN is_correct END AS is_correct, CASE WHEN attempt_id % 2 = 0 THEN CAST(marks_awarded AS DOUBLE) END AS marks_awarded, CASE WHEN attempt_id % 2 = 0 THEN 'k' END AS correct_answer,
attempt_id % 2 <> 0 OR (question_type = 'LONG_ANSWER' AND marks_awarded IS NULL) AS pending FROM m""")
def student_results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    attempts = read_table(spark, d, "customer").select(k.alias("attempt_id"), F.when(k % 2 == 0, "EVALUATED").otherwise("SUBMITTED").alias("status"))
    return grading.student_results(grading.manual_grades(*_marked(spark, d)), attempts).select("answer_id", "is_correct", "marks_awarded", "correct_answer", "pending")


@query(_MARKED + "SELECT needs_grading, count(*) AS n FROM (SELECT question_type = 'LONG_ANSWER' AND marks_awarded IS NULL AS needs_grading FROM m) GROUP BY 1")
def teacher_results(spark: SparkSession, d: str) -> DataFrame:
    return grading.teacher_results(grading.manual_grades(*_marked(spark, d))).groupBy("needs_grading").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS delivery_id, coalesce(c, 0) AS assigned, coalesce(n, 0) AS attempts, coalesce(s, 0) AS submitted, coalesce(e, 0) AS evaluated FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) ON k = n_nationkey
LEFT JOIN (SELECT c_nationkey AS j, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS s, count(*) FILTER (o_orderstatus = 'F') AS e FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON j = n_nationkey""")
def roster_counts(spark: SparkSession, d: str) -> DataFrame:
    customers = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("delivery_id"), F.col("c_custkey").alias("student_id"))
    status = F.when(F.col("o_orderstatus") == "O", "SUBMITTED").when(F.col("o_orderstatus") == "F", "EVALUATED").otherwise("IN_PROGRESS")
    attempts = read_table(spark, d, "orders").select(F.col("o_custkey").alias("student_id"), status.alias("status")).join(customers, "student_id")
    return grading.roster_counts(read_table(spark, d, "nation").select(F.col("n_nationkey").alias("delivery_id")), customers, attempts)


@query("""SELECT s_suppkey AS attempt_id, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY p_partkey) - 1 AS INTEGER) AS position, p_partkey AS question_id, CAST(p_size AS DOUBLE) AS marks, '' AS response FROM supplier JOIN part ON s_suppkey % 100 = p_partkey % 100""")
def blank_answers(spark: SparkSession, d: str) -> DataFrame:
    """A version for every hundredth part; each supplier attempts one."""
    part = read_table(spark, d, "part")
    versions = grading.snapshots(part.select((F.col("p_partkey") % 100).alias("version_id"), F.col("p_partkey").alias("position"), F.col("p_partkey").alias("question_id"), F.col("p_size").cast("double").alias("marks")))
    attempts = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("attempt_id"), (F.col("s_suppkey") % 100).alias("version_id"))
    return grading.blank_answers(attempts, versions).select("attempt_id", "position", "question_id", "marks", "response")


@query("SELECT p_partkey % 100 AS version_id FROM part GROUP BY 1 HAVING count(*) FILTER (p_size = 7) > 0")
def changed_snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "part").select((F.col("p_partkey") % 100).alias("version_id"), F.col("p_partkey").alias("position"), F.col("p_size").alias("marks"))
    edited = rows.withColumn("marks", F.when(F.col("marks") == 7, 8).otherwise(F.col("marks")))
    return grading.changed_snapshots(grading.snapshots(rows), grading.snapshots(edited))


@query("""SELECT o_custkey AS version_id, o_orderpriority AS section, count(*) AS questions, CAST(sum(1 + o_orderkey % 3) AS DOUBLE) AS total, array_to_string(list_sort(list_distinct(list(1 + o_orderkey % 3))), ',') AS marks FROM orders GROUP BY 1, 2""")
def section_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").select(F.col("o_custkey").alias("version_id"), F.col("o_orderpriority").alias("section"), (1 + F.col("o_orderkey") % 3).alias("marks"))
    return grading.section_totals(rows).withColumn("marks", F.array_join(F.transform("marks", lambda m: m.cast("int").cast("string")), ","))


_LABELS = {"AUTOMOBILE": "Teacher", "BUILDING": "Student", "FURNITURE": "DEO & Validator", "HOUSEHOLD": "Validator", "MACHINERY": "Data Entry Operator"}


@query("""SELECT count(*) AS total, count(*) FILTER (s = 'none') AS super_admin, count(*) FILTER (s = 'none') AS school_admin, count(*) FILTER (s = 'AUTOMOBILE') AS teacher, count(*) FILTER (s = 'BUILDING') AS student, count(*) FILTER (s = 'none') AS qbm,
count(*) FILTER (s IN ('FURNITURE', 'MACHINERY')) AS deo, count(*) FILTER (s IN ('FURNITURE', 'HOUSEHOLD')) AS validator FROM (SELECT c_mktsegment AS s FROM customer)""")
def user_counts(spark: SparkSession, d: str) -> DataFrame:
    label = F.try_element_at(F.create_map(*(F.lit(x) for kv in _LABELS.items() for x in kv)), F.col("c_mktsegment"))
    return grading.user_counts(read_table(spark, d, "customer").select(label.alias("role_label")))


@query("""SELECT c_mktsegment AS role_group, count(*) AS total, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS with_permission FROM customer WHERE c_acctbal > 0 GROUP BY 1""")
def upload_policy(spark: SparkSession, d: str) -> DataFrame:
    users = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("role_group"), (F.col("c_acctbal") > 0).alias("is_active"))
    grants = read_table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("capability"))
    return grading.upload_policy(users, grants, "1-URGENT")


@query("""WITH w AS (SELECT DISTINCT CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS id FROM orders)
SELECT id, coalesce(c_nationkey = 3 AND (id % 7 = 2 OR id % 40 IN (5, 6, 9)), false) AS in_scope FROM w LEFT JOIN customer ON c_custkey = id""")
def assignable(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    students = read_table(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").alias("school_id"), (k % 7).alias("created_by_id"), (k % 40).alias("class_section_id"))
    wanted = read_table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 50 == 0, F.col("o_custkey") + 100000000).otherwise(F.col("o_custkey")).alias("id"))
    classes = spark.createDataFrame([(5,), (6,)], "class_section_id long")
    return grading.assignable(students, wanted, {"school_id": 3, "id": 2}, classes, 9)


def _edits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("p_partkey")
    part = read_table(spark, d, "part")
    questions = part.select(k.alias("id"), F.col("p_brand").alias("difficulty"), F.col("p_size").cast("decimal(5,2)").alias("marks"))
    variants = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3000).alias("question_id"), F.lit("EASY").alias("difficulty"))
    edits = part.where("p_partkey % 5 = 0 or p_partkey % 7 = 0").select(k.alias("id"), F.when(k % 5 == 0, "Brand#1").alias("difficulty"), F.when(k % 7 == 0, F.col("p_size") + k % 2).alias("marks"))
    return questions, variants, edits


@query("""SELECT p_partkey AS id, 'difficulty' AS field, p_brand AS "old", 'Brand#1' AS "new" FROM part WHERE p_partkey % 5 = 0 AND p_brand <> 'Brand#1'
UNION ALL SELECT p_partkey, 'marks', CAST(CAST(p_size AS DOUBLE) AS VARCHAR), CAST(CAST(p_size + 1 AS DOUBLE) AS VARCHAR) FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 2 = 1""")
def metadata_changes(spark: SparkSession, d: str) -> DataFrame:
    return grading.edited_metadata(*_edits(spark, d))[2]


@query("""SELECT o_orderkey AS id, o_orderkey % 3000 AS question_id, CASE WHEN p_partkey IS NULL THEN 'EASY' WHEN p_partkey % 5 = 0 THEN 'Brand#1' ELSE p_brand END AS difficulty FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 3000""")
def variant_cascade(spark: SparkSession, d: str) -> DataFrame:
    return grading.edited_metadata(*_edits(spark, d))[1]


@query("""WITH r AS (SELECT DISTINCT p_brand AS board, p_type AS subject, 'Standard' AS grade, p_type || ' (Standard)' AS book_title, 'Size ' || p_size AS chapter_title FROM part),
k AS (SELECT * FROM r WHERE length(chapter_title) = 6), n AS (SELECT board, book_title, count(*) AS n FROM k GROUP BY ALL)
SELECT r.board, r.book_title, r.chapter_title, coalesce(n.n, 0) + row_number() OVER (PARTITION BY r.board, r.book_title ORDER BY r.chapter_title) AS chapter_order FROM r LEFT JOIN n USING (board, book_title) WHERE length(r.chapter_title) <> 6""")
def new_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters for all sizes of parts; those of one digit exist."""
    title = F.concat(F.lit("Size "), F.col("p_size").cast("string"))
    rows = read_table(spark, d, "part").select(F.col("p_brand").alias("board"), F.lit(" ").alias("book_title"), F.col("p_type").alias("subject"), F.lit(None).cast("string").alias("grade"), title.alias("chapter_title"), F.lit("").alias("topic_name"))
    full = rows.withColumn("grade", F.lit("Standard")).withColumn("book_title", F.concat("subject", F.lit(" (Standard)")))
    known = full.where(F.length("chapter_title") == 6).select("board", "book_title", "subject", "grade", "chapter_title").distinct()
    return grading.missing_hierarchy(rows, full.limit(0), known, full.limit(0))[1].select("board", "book_title", "chapter_title", "chapter_order")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey % 10 <> 0 ORDER BY o_orderstatus <> 'P', o_orderdate, o_orderkey LIMIT 1""")
def next_job(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "EXTRACTING").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("COMPLETED")
    jobs = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    return grading.next_job(jobs, jobs.where("id % 10 = 0")).select("id")
