"""Registered queries on scopes, states, small text rules and page parts, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import markup, school, text
from quillspark.operators import assess, documents, grading, relational, select
from quillspark.operators import text as texts
from quillspark.plans.papers import _answers
from quillspark.plans.queries import query
from quillspark.sources.tables import read_table
from quillspark.streaming import jobs

# --- who sees what --------------------------------------------------------------------------------------------------


def _users(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    role = F.when(F.col("c_mktsegment") == "BUILDING", "Student").when(F.col("c_mktsegment") == "MACHINERY", "Teacher").otherwise("")
    return read_table(spark, d, "customer").select(k.alias("id"), role.alias("role"), F.when(F.col("c_nationkey") > 0, F.col("c_nationkey")).alias("school_id"), (k % 7).alias("created_by_id"))


@query("""SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3 AND (c_custkey % 7 = 2 OR c_mktsegment = 'BUILDING')""")
def user_scope(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d).where(relational.user_scope({"id": 2, "school_id": 3, "role": "Teacher"})).select("id")


@query("""SELECT c_custkey AS id, 'school' AS who FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, 'teacher' FROM customer WHERE c_custkey % 7 = 2""")
def paper_scope(spark: SparkSession, d: str) -> DataFrame:
    users = _users(spark, d)
    wide = users.where(relational.paper_scope({"id": 2, "school_id": 3, "school_wide": True})).select("id", F.lit("school").alias("who"))
    return wide.unionByName(users.where(relational.paper_scope({"id": 2, "school_id": 3, "role": "Teacher"})).select("id", F.lit("teacher").alias("who")))


@query("""SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_suppkey = 5""")
def delivery_scope(spark: SparkSession, d: str) -> DataFrame:
    assigned = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("delivery_id"), F.col("l_suppkey").alias("user_id"))
    deliveries = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return relational.delivery_scope(deliveries, assigned, {"id": 5, "role": "Student"})


@query("""SELECT o_orderkey AS id, 'queue' AS kind FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'approved' FROM orders WHERE o_orderstatus = 'F'""")
def validation_queue(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "P", "CORRECTION_REQUIRED").otherwise("SUBMITTED")
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("validation_status"))
    waiting = relational.validation_queue(rows).select("id", F.lit("queue").alias("kind"))
    return waiting.unionByName(relational.approved_only(rows, True).select("id", F.lit("approved").alias("kind")))


@query("""WITH g AS (SELECT o_custkey AS id, bool_or(o_orderpriority = '1-URGENT') AS a, bool_or(o_orderpriority = '5-LOW') AS b FROM orders GROUP BY 1)
SELECT c_custkey AS id FROM customer LEFT JOIN g ON g.id = c_custkey WHERE c_mktsegment = 'MACHINERY' OR (coalesce(a, false) AND NOT coalesce(b, false) AND c_nationkey > 0)""")
def role_or_capability(spark: SparkSession, d: str) -> DataFrame:
    grants = read_table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("capability"))
    return relational.role_or_capability(_users(spark, d), grants, ["Teacher"], "1-URGENT", lacks="5-LOW", in_school=True).select("id")


_ACTION = """CASE event_type WHEN 'click' THEN 'exam.proctoring_warning' WHEN 'view' THEN 'exam.submit' WHEN 'purchase' THEN 'paper.create' ELSE 'user.' || event_type END"""


def _actions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "click", "exam.proctoring_warning").when(kind == "view", "exam.submit").when(kind == "purchase", "paper.create").otherwise(F.concat(F.lit("user."), kind))
    return read_table(spark, d, "events").withColumn("action", action)


@query(f"""SELECT event_id, CASE WHEN contains(a, 'proctoring') THEN 'PROCTORING' WHEN a LIKE 'exam.%' THEN 'EXAMS' WHEN a LIKE 'paper.%' THEN 'PAPERS' ELSE 'USERS' END AS category, a LIKE 'exam.%' AS exam FROM (SELECT event_id, {_ACTION} AS a FROM events)""")
def audit_categories(spark: SparkSession, d: str) -> DataFrame:
    return _actions(spark, d).select("event_id", school.audit_category(F.col("action")).alias("category"), relational.audit_filter("EXAMS").alias("exam"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'TABLE' WHEN doc_id % 4 = 1 THEN 'FORMULA' ELSE 'PARAGRAPH' END AS kind, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS content FROM documents""")
def item_content(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    raw = F.when(k % 4 == 0, "table").when(k % 4 == 1, "Formula").otherwise("sidebar")
    return read_table(spark, d, "documents").select("doc_id", relational.item_type(raw).alias("kind"), relational.first_text(F.when(k % 3 == 1, F.lit("")), F.when(k % 3 == 0, F.col("lang")), F.col("source")).alias("content"))


@query("""WITH p AS (SELECT user_id AS job_id, event_id AS page_number FROM events WHERE event_type <> 'click' AND (value < 0.85 OR event_id % 5 = 0)) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY page_number) <= 20""")
def rescue_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("page_number"), F.when(F.col("event_type") == "click", "blank").otherwise("text").alias("page_kind"), F.col("value").alias("quality"), (F.col("event_id") % 5 == 0).alias("needs_review"), F.lit("x").alias("raw_text"), F.array().cast("array<string>").alias("flags"))
    return relational.rescue_pages(pages).select("job_id", "page_number")


# --- states ---------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey FROM (SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS used, p_retailprice FROM part) ORDER BY used, p_retailprice, p_partkey LIMIT 50""")
def fresh_first(spark: SparkSession, d: str) -> DataFrame:
    used = read_table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return select.fresh_first(read_table(spark, d, "part"), used, "p_partkey", [F.col("p_retailprice"), F.col("p_partkey")], 50).select("p_partkey")


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'new' ELSE 'old' END AS v FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_acctbal < 0""")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "customer")
    owing = rows.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    new = owing.unionByName(owing.select((F.col("id") + 1000000).alias("id"))).withColumn("v", F.lit("new"))
    return relational.upsert(rows.select(F.col("c_custkey").alias("id"), F.lit("old").alias("v")), new, ["id"])


@query("""SELECT user_id, page_number FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(1, 31)) AS page_number) WHERE (user_id, page_number) NOT IN (SELECT (user_id, day(ts)) FROM events)""")
def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    wanted = events.select(F.col("user_id").alias("job_id")).distinct().withColumn("total_pages", F.lit(30))
    stored = events.select(F.col("user_id").alias("job_id"), F.dayofmonth("ts").alias("page_number"))
    return jobs.missing_pages(wanted, stored).select(F.col("job_id").alias("user_id"), F.col("page_number").cast("long").alias("page_number"))


@query("""WITH l AS (SELECT user_id AS job_id, max(day(ts)) AS last FROM events GROUP BY 1) SELECT job_id, CAST(greatest(20, last) AS INTEGER) AS processed_pages, CAST(floor(greatest(20, last) / 40 * 100) AS BIGINT) AS percent FROM l""")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    table = events.select(F.col("user_id").alias("job_id")).distinct().withColumn("total_pages", F.lit(40)).withColumn("processed_pages", F.lit(20))
    return jobs.progress(table, events.select(F.col("user_id").alias("job_id"), F.dayofmonth("ts").alias("page_number")))


@query("""SELECT event_id AS id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'FAILED' WHEN event_type = 'click' THEN 'EXTRACTING' ELSE 'PENDING' END AS status FROM events""")
def stalled_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "EXTRACTING").otherwise("PENDING").alias("status"), F.col("ts").alias("updated_at"))
    return jobs.stalled(rows, F.to_timestamp_ntz(F.lit("2024-01-15 00:45:00"))).select("id", "status")


@query("""SELECT user_id AS attempt_id, event_type AS question_id, arg_max(event_id, (ts, event_id)) AS answer FROM events GROUP BY ALL""")
def last_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select(F.col("user_id").alias("attempt_id"), F.col("event_type").alias("question_id"), F.struct("ts", "event_id").alias("written_at"), F.col("event_id").alias("answer"))
    return jobs.last_answers(rows).select("attempt_id", "question_id", "answer")


@query("""SELECT user_id AS attempt_id, min(ts) AS submitted_at FROM events GROUP BY 1""")
def first_submit(spark: SparkSession, d: str) -> DataFrame:
    return jobs.first_submit(read_table(spark, d, "events").select(F.col("user_id").alias("attempt_id"), F.col("ts").alias("submitted_at")))


@query("""WITH h AS (SELECT user_id AS question_id, ts, event_id, CASE WHEN event_id % 4 = 0 THEN 'APPROVED' WHEN event_id % 4 = 1 AND event_id % 3 > 0 THEN 'REJECTED' WHEN event_id % 4 = 2 THEN 'SUBMITTED' END AS s FROM events)
SELECT question_id, arg_max(s, (ts, event_id)) AS status, 1 + count(*) FILTER (s = 'SUBMITTED') AS revision FROM h WHERE s IS NOT NULL GROUP BY 1""")
def review_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    action = F.when(k % 4 == 0, "APPROVE").when(k % 4 == 1, "REJECT").when(k % 4 == 2, "RESUBMIT").otherwise("COMMENT")
    return jobs.review_status(read_table(spark, d, "events").select(k.alias("id"), F.col("user_id").alias("question_id"), action.alias("action"), F.when(k % 3 > 0, "why").otherwise(" ").alias("comment"), F.col("ts").alias("created_at")))


@query("""SELECT c_custkey AS user_id, 'A' AS capability FROM customer WHERE c_nationkey < 12 AND c_acctbal >= 0 UNION ALL SELECT c_custkey, 'B' FROM customer WHERE c_nationkey < 5""")
def grants(spark: SparkSession, d: str) -> DataFrame:
    """A to nations under 12, some of whom hold it already, and then not to those who owe."""
    users = read_table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    held = users.where("c_nationkey < 5").select(F.col("id").alias("user_id"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("capability"))
    return jobs.revoke(jobs.grant(held, users.where("c_nationkey < 12"), "A"), users.where("c_acctbal < 0"), "A")


@query("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'PENDING' ELSE 'DONE' END AS status, CASE WHEN o_orderstatus <> 'F' THEN 'e' END AS error FROM orders""")
def requeued(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("DONE").alias("status"), F.lit("e").alias("error"))
    return jobs.requeue(rows)


@query("""SELECT o_custkey AS job_id, o_orderkey AS page_number FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def replaced_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("page_number"), "o_orderstatus")
    return jobs.replace_jobs(rows.drop("o_orderstatus"), rows.where("o_orderstatus = 'P'"))


@query("""SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderstatus <> 'P', o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus IN ('P', 'O') QUALIFY o_orderstatus = 'O'""")
def queue_position(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "EXTRACTING").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("DONE")
    return assess.queue_position(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))).select("id", "position")


# --- figures --------------------------------------------------------------------------------------------------------


@query("""SELECT event_type AS model, count(*) AS runs, count(*) FILTER (event_id % 3 > 0) AS valid, round(count(*) FILTER (event_id % 3 > 0) / count(*) * 100, 6) AS success, round(avg(value), 6) AS tokens_per_sec, max(user_id) AS peak_vram FROM events GROUP BY 1""")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    runs = read_table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 3 > 0).alias("is_valid_json"), F.col("value").alias("eval_tokens_per_sec"), F.col("value").alias("client_wall_time_sec"), F.col("value").alias("compliance_pct"), F.col("user_id").alias("vram_mb"))
    return assess.leaderboard(runs).select("model", "runs", "valid", F.round("success", 6).alias("success"), F.round("tokens_per_sec", 6).alias("tokens_per_sec"), "peak_vram")


@query("""SELECT user_id AS doc_id, round(avg(value), 6) AS avg_garbage, count(*) FILTER (event_id % 9 = 0) AS empty_pages, round(least(1, (count(*) FILTER (event_id % 5 = 0) + max(CASE WHEN event_id % 100 = 7 THEN 1 ELSE 0 END)) / count(*)), 6) AS review_rate, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1""")
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    pages = read_table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("value").alias("garbage_rate"), F.when(k % 9 == 0, " ").otherwise("t").alias("raw_text"), (k % 5 == 0).alias("needs_review"), F.when(k % 100 == 7, 0.5).otherwise(0.9).alias("confidence"), F.col("event_type").alias("page_kind"))
    out = assess.page_quality(pages)
    return out.select("doc_id", F.round("avg_garbage", 6).alias("avg_garbage"), "empty_pages", F.round("review_rate", 6).alias("review_rate"), F.size("kinds").cast("long").alias("kinds"))


@query("""WITH m AS (SELECT CAST(p_size AS DOUBLE) AS marks, count(*) AS made FROM part GROUP BY 1) SELECT CAST(s AS DOUBLE) AS marks, coalesce(made, 0) AS made, greatest(0, 45 - coalesce(made, 0)) AS missing FROM (SELECT unnest(range(1, 61)) AS s) LEFT JOIN m ON m.marks = s""")
def tier_deficit(spark: SparkSession, d: str) -> DataFrame:
    spec = spark.range(1, 61).select(F.col("id").cast("double").alias("marks"), F.lit(45).cast("long").alias("required"))
    return assess.tier_deficit(spec, read_table(spark, d, "part").select(F.col("p_size").cast("double").alias("marks"))).drop("required")


@query("""SELECT question_type, rule, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'N' THEN 'MCQ' WHEN 'R' THEN 'SHORT_ANSWER' ELSE 'LONG_ANSWER' END AS question_type,
CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_suppkey % 7 = 0 THEN 'UNANSWERED' WHEN l_suppkey % 5 = l_partkey % 4 THEN 'MCQ_LETTER' ELSE 'MCQ_INCORRECT' END WHEN l_returnflag = 'R' AND l_suppkey % 11 > 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'NUMERICAL' ELSE 'NUMERICAL_INCORRECT' END ELSE 'MANUAL_PENDING' END AS rule FROM lineitem) GROUP BY ALL""")
def answer_rules(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rule = school.evaluate(c("question_type"), c("marks"), c("correct_answer"), c("response"), c("options"), F.lit(0.25))["rule"]
    return _answers(spark, d).groupBy("question_type", rule.alias("rule")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS doc, o_orderpriority AS chapter_number, min(o_orderkey) AS start_page FROM orders GROUP BY ALL""")
def unique_chapters(spark: SparkSession, d: str) -> DataFrame:
    return texts.unique_chapters(read_table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("chapter_number"), F.col("o_orderkey").alias("start_page")), "doc")


@query("""SELECT l_orderkey, min(l_tax) AS x0, min(l_discount) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1""")
def enclosing_box(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select("l_orderkey", F.array("l_tax", "l_discount", "l_quantity", "l_extendedprice").alias("bbox"))
    return texts.enclosing_box(rows, ["l_orderkey"]).select("l_orderkey", *(F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query("""SELECT c_custkey AS student_id FROM customer WHERE c_nationkey = 4 UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH'""")
def chosen_students(spark: SparkSession, d: str) -> DataFrame:
    named = read_table(spark, d, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("student_id"))
    return grading.chosen_students(named, read_table(spark, d, "customer").where("c_nationkey = 4").select(F.col("c_custkey").alias("student_id")))


@query("""SELECT p_partkey AS job_id, n_nationkey AS chapter_id FROM part JOIN nation ON contains('book of ' || CASE WHEN p_partkey % 2 = 0 THEN 'nation ' ELSE '' END || lower(p_brand) || ' ' || (SELECT lower(n_name) FROM nation WHERE n_nationkey = p_partkey % 25), lower(n_name))""")
def titled_items(spark: SparkSession, d: str) -> DataFrame:
    nation = read_table(spark, d, "nation")
    part = read_table(spark, d, "part").withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int")).join(F.broadcast(nation), "n_nationkey")
    title = F.concat(F.lit("Book of "), F.when(F.col("p_partkey") % 2 == 0, "Nation ").otherwise(""), F.col("p_brand"), F.lit(" "), F.col("n_name"))
    return documents.titled_items(part.select(F.col("p_partkey").alias("job_id"), title.alias("title")), nation.select(F.col("n_nationkey").alias("chapter_id"), F.col("n_name").alias("title")))


@query("""WITH c AS (SELECT l_orderkey AS page, l_linenumber AS caption_id, l_quantity * 10 AS y FROM lineitem),
n AS (SELECT o_orderkey AS page, c.caption_id, CASE WHEN c.y >= 250 AND c.y - 250 <= 45 THEN c.y - 250 WHEN 200 - c.y - 8 >= 0 AND 200 - c.y - 8 <= 45 THEN 200 - c.y - 8 END AS dist FROM orders LEFT JOIN c ON c.page = o_orderkey)
SELECT page, arg_min(caption_id, (dist, caption_id)) FILTER (dist IS NOT NULL) AS caption_id FROM n GROUP BY 1""")
def nearest_caption(spark: SparkSession, d: str) -> DataFrame:
    images = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.lit(1).alias("image_id"), F.lit(200.0).alias("y0"), F.lit(250.0).alias("y1"))
    y = F.col("l_quantity") * 10
    captions = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("caption_id"), F.lit("t").alias("text"), y.alias("y0"), (y + 8).alias("y1"))
    return texts.nearest_caption(images, captions, ["page"]).select("page", F.col("caption.caption_id").alias("caption_id"))


# --- small rules of texts and values --------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'user' ELSE regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') END AS username, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE c_mktsegment || ' ' || c_custkey END AS full_name FROM customer""")
def user_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    blank = k % 5 == 0
    return read_table(spark, d, "customer").select("c_custkey", school.username(F.when(k % 9 == 0, "--").otherwise(F.col("c_name"))).alias("username"), school.full_name(F.when(~blank, F.col("c_mktsegment")), F.when(~blank, k.cast("string")), F.col("c_name")).alias("full_name"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS INTEGER) WHEN c_custkey % 4 = 1 THEN CAST(c_custkey % 10 * 10 + 1 AS INTEGER) WHEN c_custkey % 4 = 2 THEN 4 END AS page FROM customer""")
def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Digits of another script, digits misread as letters, roman numerals, and what is no number."""
    k = F.col("c_custkey")
    read = F.when(k % 4 == 0, F.translate(k.cast("string"), "0123456789", "०१२३४५६७८९")).when(k % 4 == 1, F.concat((k % 10).cast("string"), F.lit("l"))).when(k % 4 == 2, "iv").otherwise("page")
    return read_table(spark, d, "customer").select("c_custkey", school.ocr_number(read).alias("page"))


@query(r"""SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS safe, contains(text, 'thing') AS has FROM documents""")
def safe_text(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.md5(text.pdf_safe(F.col("text"))).alias("safe"), F.col("text").contains("thing").alias("has"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)^\s*(Activity|Task|Experiment|Project|Lab Activity|Try This|Do It Yourself)\b') THEN 'ACTIVITY' WHEN regexp_matches(t, '(?i)^\s*(Example|Solved Example|Illustration|Sample Problem)\b') THEN 'SOLVED_EXAMPLE' ELSE 'PARAGRAPH' END AS kind
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' task: ' WHEN 1 THEN 'Example 2 ' ELSE 'The ' END || lang AS t FROM documents)""")
def section_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    said = F.concat(F.when(k % 3 == 0, " task: ").when(k % 3 == 1, "Example 2 ").otherwise("The "), F.col("lang"))
    return read_table(spark, d, "documents").select("doc_id", texts.section_kind(said).alias("kind"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS t FROM conversations),
g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM w), o AS (SELECT conv_id, turn, g, lag(g) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM g)
SELECT conv_id, turn, len(g) AS n, round(CASE WHEN len(g) + len(b) = 0 OR b IS NULL THEN 0 ELSE len(list_intersect(g, b)) / len(list_distinct(list_concat(g, b))) END, 6) AS alike FROM o""")
def bigram_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much each turn repeats of the one before, in pairs of words."""
    from pyspark.sql import Window

    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    rows = read_table(spark, d, "conversations").select("conv_id", "turn", text.ngrams(words, 2).alias("g"))
    before = F.lag("g").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("b", before).select("conv_id", "turn", F.size("g").cast("long").alias("n"), F.round(F.when(F.col("b").isNull(), 0.0).otherwise(text.jaccard(F.col("g"), F.col("b"))), 6).alias("alike"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'formul' WHEN p_partkey % 3 = 1 THEN 'calcul' ELSE 'bus' END AS stem FROM part""")
def word_stems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    word = F.when(k % 3 == 0, "Formulations").when(k % 3 == 1, "calculation").otherwise("bus")
    return read_table(spark, d, "part").select("p_partkey", text.stem(word).alias("stem"))


@query("""SELECT p_partkey, CAST(least(2048, p_size * 220 + 400) AS INTEGER) AS output, CAST(greatest(200, 8192 - 409 - p_partkey % 500 - least(2048, p_size * 220 + 400)) AS BIGINT) AS context FROM part""")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    made = documents.budget(F.col("p_partkey") % 500, F.col("p_size"))
    return read_table(spark, d, "part").select("p_partkey", made["output"].alias("output"), made["context"].alias("context"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x = y + ' || doc_id ELSE '\frac{' || doc_id END AS formula, doc_id % 2 = 0 AS sound FROM documents""")
def formula_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    formula = F.when(k % 2 == 0, F.concat(F.lit("x = y + "), k.cast("string"))).otherwise(F.concat(F.lit(r"\frac{"), k.cast("string")))
    return read_table(spark, d, "documents").select("doc_id", formula.alias("formula"), markup.is_formula(formula).alias("sound"))
