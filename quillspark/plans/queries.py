"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import markup, school, text
from quillspark.operators import assess, documents, relational, select
from quillspark.operators import text as texts
from quillspark.sources.tables import read_table
from quillspark.streaming import jobs

REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


@query("""SELECT doc_id, source, n_chars FROM documents WHERE upper(lang) = 'EN' AND contains(lower(text), 'thing') ORDER BY n_chars DESC, doc_id DESC LIMIT 50""")
def question_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").withColumn("lang_code", F.upper("lang"))
    found = relational.filter_rows(docs, {"lang": "en", "search": "thing", "difficulty": "ALL"}, equal={"lang": "lang_code"}, searched=["text"])
    return relational.sort_rows(found, "newest", created="n_chars", ident="doc_id").limit(50).select("doc_id", "source", "n_chars")


@query("""SELECT doc_id, source FROM documents WHERE source = 'src0' OR source = 'src7'""")
def tenant_scope(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    shared = F.when(F.col("source") == "src0", "GLOBAL").otherwise("SCHOOL")
    return docs.where(relational.tenant_scope(False, "src7", shared, F.col("source"))).select("doc_id", "source")


@query("""SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, n_name""")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: read_table(spark, d, n)
    geo = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows at any scale
    # lines are added up by order and then by customer before the wide joins
    by_order = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("p"))
    by_customer = by_order.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    rows = by_customer.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_lines"), F.round(F.sum("p"), 2).alias("revenue"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def bridge_semi(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return read_table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_semi")


@query("""SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "lang").join(read_table(spark, d, "labels"), "doc_id", "left_anti")


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, count(o_orderkey) FILTER (o_totalprice > 200000) AS n_large, count(DISTINCT o_orderpriority) AS n_priorities
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""")
def child_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").where("o_orderstatus = 'F'")
    return relational.child_counts(read_table(spark, d, "customer"), orders, "c_custkey", "o_custkey", [F.count("*").alias("n_orders"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"), F.count_distinct("o_orderpriority").alias("n_priorities")])


@query("""SELECT count(*) AS total, count(DISTINCT l.doc_id) AS labelled, CASE WHEN count(*) FILTER (d.lang = 'xx') = 0 THEN 28 ELSE count(*) FILTER (d.lang = 'xx') END AS boards
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def stats_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    labels = read_table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    rows = read_table(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    n = F.count_if(F.col("lang") == "xx")
    return rows.agg(F.count("*").alias("total"), F.count("has").alias("labelled"), F.when(n == 0, 28).otherwise(n).cast("long").alias("boards"))


@query("""SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 1 AND toxic = 1) AS both_labels, count(*) FILTER (quality = 0 AND toxic = 0) AS neither FROM labels""")
def role_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    return read_table(spark, d, "labels").agg(F.count_if(good).alias("good"), F.count_if(bad).alias("toxic"), F.count_if(good & bad).alias("both_labels"), F.count_if(~good & ~bad).alias("neither"))


@query("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3 ELSE 2 END AS weight
FROM orders ORDER BY weight, o_totalprice DESC, o_orderkey DESC LIMIT 100""")
def weighted_sort(spark: SparkSession, d: str) -> DataFrame:
    levels = ("3-MEDIUM", "1-URGENT", "5-LOW")
    top = relational.sort_rows(read_table(spark, d, "orders"), "difficulty_asc", created="o_totalprice", ident="o_orderkey", difficulty="o_orderpriority", levels=levels).limit(100)
    return top.select("o_orderkey", "o_orderpriority", relational.rank(F.col("o_orderpriority"), levels, 2).alias("weight"))


@query("""SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 20""")
def paginate_page2(spark: SparkSession, d: str) -> DataFrame:
    return relational.page(read_table(spark, d, "part").select("p_partkey", "p_name", "p_size"), [F.col("p_size").desc(), F.col("p_partkey")], 2)


@query("""SELECT p.p_partkey, w.position, p.p_brand FROM part p JOIN (VALUES (17, 0), (3, 1), (99, 2), (3000000, 3), (42, 4)) w(k, position) ON p.p_partkey = w.k""")
def ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    return relational.ordered_lookup([17, 3, 99, 3000000, 42], read_table(spark, d, "part"), "p_partkey").select("p_partkey", "position", "p_brand")


_BANDS = [(1, 1.0, 12.0), (2, 10.0, 25.0), (3, 24.0, 60.0)]


@query("""SELECT o_orderkey, CASE WHEN q BETWEEN 1 AND 12 THEN 1 WHEN q BETWEEN 10 AND 25 THEN 2 WHEN q BETWEEN 24 AND 60 THEN 3 ELSE 0 END AS band
FROM (SELECT o_orderkey, floor(o_totalprice / 10000) AS q FROM orders)""")
def range_first_match(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame(_BANDS, "band int, low double, high double")
    points = read_table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 10000).cast("double").alias("q"))
    return relational.first_range(points, bands, "q", "low", "high", ["band"], ["o_orderkey"]).select("o_orderkey", F.coalesce("hit.band", F.lit(0)).alias("band"))


@query("""SELECT event_id, user_id, event_id AS start_page, greatest(event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, 1000000)) AS end_page FROM events""")
def chapter_bounds(spark: SparkSession, d: str) -> DataFrame:
    starts = read_table(spark, d, "events").select("event_id", "user_id", F.col("event_id").alias("start_page"))
    return texts.chapter_bounds(starts, "user_id", "start_page", ["event_id"], F.lit(1000000))


@query("""WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_partkey) AS p FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p) AS k, min(p) OVER (PARTITION BY p_brand) AS f FROM p)
SELECT p_partkey, p_brand, row_number() OVER (ORDER BY k, f) AS turn FROM k""")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    return select.interleave(read_table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"])


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 5 AS admitted FROM orders""")
def admission_limit(spark: SparkSession, d: str) -> DataFrame:
    return select.admit(read_table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.lit(5)).select("o_orderkey", "o_custkey", "admitted")


@query("""SELECT conv_id, arg_max(text, turn) AS last_text FROM conversations WHERE role = 'user' AND text <> '' AND turn % 3 <> 2 GROUP BY conv_id""")
def latest_nonempty(spark: SparkSession, d: str) -> DataFrame:
    blank = F.when(F.col("turn") % 3 == 2, "").otherwise(F.col("text"))
    rows = read_table(spark, d, "conversations").where("role = 'user'").withColumn("text", blank).where("text <> ''")
    return rows.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return assess.majority(read_table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("""SELECT o_custkey, o_totalprice AS median FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) = floor(count(*) OVER (PARTITION BY o_custkey) / 2) + 1""")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return assess.upper_median("o_totalprice", ["o_custkey"], read_table(spark, d, "orders"))


@query("""SELECT c_custkey, p AS percent, CASE WHEN p >= 90 THEN 'A+' WHEN p >= 80 THEN 'A' WHEN p >= 70 THEN 'B+' WHEN p >= 60 THEN 'B' WHEN p >= 50 THEN 'C' WHEN p >= 33 THEN 'D' ELSE 'F' END AS grade,
CASE WHEN round(p, 2) >= 91 THEN 'A1' WHEN round(p, 2) >= 81 THEN 'A2' WHEN round(p, 2) >= 71 THEN 'B1' WHEN round(p, 2) >= 61 THEN 'B2' WHEN round(p, 2) >= 51 THEN 'C1' WHEN round(p, 2) >= 41 THEN 'C2' WHEN round(p, 2) >= 33 THEN 'D' ELSE 'E1' END AS board_grade
FROM (SELECT c_custkey, round((c_acctbal + 1000) / 110, 6) AS p FROM customer)""")
def grade_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "customer").select("c_custkey", F.round((F.col("c_acctbal") + 1000) / 110, 6).alias("percent"))
    return rows.withColumn("grade", school.grade(F.col("percent"))).withColumn("board_grade", school.board_grade(F.col("percent")))


@query("""SELECT count(*) FILTER (abs(l_extendedprice - p) <= greatest(0.015 * greatest(abs(l_extendedprice), abs(p)), 0.05)) AS n_close, count(*) AS n FROM (SELECT l_extendedprice, l_extendedprice * (1 + l_discount / 4) AS p FROM lineitem)""")
def numeric_tolerance(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_extendedprice") * (1 + F.col("l_discount") / 4)).alias("p"))
    return rows.agg(F.count_if(school.close(F.col("l_extendedprice"), F.col("p"))).alias("n_close"), F.count("*").alias("n"))


def _book(spark: SparkSession, d: str) -> DataFrame:
    roster = read_table(spark, d, "customer").select(F.col("c_custkey").alias("student_id"))
    orders = read_table(spark, d, "orders").where("o_orderstatus = 'F'")
    first = orders.groupBy(F.col("o_custkey").alias("student_id")).agg(F.min("o_orderkey").alias("attempt_id"))
    attempts = first.withColumn("status", F.when(F.col("attempt_id") % 3 == 0, "SUBMITTED").otherwise("EVALUATED")).withColumn("score", F.lit(None).cast("double"))
    lines = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.when(F.col("l_returnflag") == "N", "MCQ").otherwise("LONG_ANSWER").alias("question_type"), F.when(F.col("l_quantity") < 48, F.col("l_quantity")).alias("marks_awarded"))
    return assess.gradebook(roster, attempts, lines, 250.0)


_BOOK = """WITH a AS (SELECT o_custkey AS s, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
m AS (SELECT l_orderkey AS k, coalesce(sum(CASE WHEN l_quantity < 48 THEN l_quantity END) FILTER (l_returnflag = 'N'), 0) AS mcq, coalesce(sum(CASE WHEN l_quantity < 48 THEN l_quantity END) FILTER (l_returnflag <> 'N'), 0) AS wr,
  bool_or(l_returnflag <> 'N' AND l_quantity >= 48) AS pend, bool_or(l_returnflag <> 'N') AS hasw FROM lineitem GROUP BY 1),
b AS (SELECT c_custkey AS student_id, CASE WHEN a.k IS NULL THEN 'ABSENT' WHEN a.k % 3 = 0 THEN 'SUBMITTED' ELSE 'EVALUATED' END AS status,
  CASE WHEN a.k IS NOT NULL THEN coalesce(mcq, 0.0) END AS mcq_marks, CASE WHEN a.k IS NOT NULL THEN coalesce(wr, 0.0) END AS written_marks, coalesce(pend, false) AS pend, coalesce(hasw, false) AS hasw FROM customer LEFT JOIN a ON a.s = c_custkey LEFT JOIN m ON m.k = a.k),
book AS (SELECT student_id, status, mcq_marks, written_marks, mcq_marks + written_marks AS total, (mcq_marks + written_marks) / 250.0 * 100 AS percentage, pend, hasw FROM b)
"""


@query(_BOOK + """SELECT student_id, status, mcq_marks, written_marks, total, round(percentage, 6) AS percentage,
CASE WHEN status = 'ABSENT' THEN 'AB' WHEN percentage >= 90 THEN 'A+' WHEN percentage >= 80 THEN 'A' WHEN percentage >= 70 THEN 'B+' WHEN percentage >= 60 THEN 'B' WHEN percentage >= 50 THEN 'C' WHEN percentage >= 33 THEN 'D' ELSE 'F' END AS grade,
CASE WHEN status = 'ABSENT' THEN 'Absent' WHEN status = 'EVALUATED' THEN CASE WHEN percentage >= 33 THEN 'Passed' ELSE 'Needs Improvement' END WHEN hasw AND pend THEN 'Pending Descriptive Review' ELSE 'In Progress' END AS remarks FROM book""")
def gradebook(spark: SparkSession, d: str) -> DataFrame:
    return _book(spark, d).withColumn("percentage", F.round("percentage", 6))


@query(_BOOK + """SELECT count(*) AS assigned, count(total) AS appeared, count(*) - count(total) AS absent, round(coalesce(avg(percentage), 0), 6) AS avg_percentage, coalesce(max(total), 0) AS max_total, coalesce(min(total), 0) AS min_total,
round(count(*) FILTER (percentage >= 33) * 100.0 / count(total), 6) AS pass_percentage, round(avg(mcq_marks), 6) AS avg_mcq, round(avg(written_marks), 6) AS avg_written, round(avg(total), 6) AS avg_total FROM book""")
def cohort_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = assess.cohort_stats(_book(spark, d))
    return stats.select(*(F.round(c, 6).alias(c) if c.startswith(("avg", "pass")) else c for c in stats.columns))


@query("""SELECT b AS bucket, count(*) AS n FROM (SELECT CASE WHEN contains(event_type, 'tab') OR contains(event_type, 'switch') THEN 'tab_switch' WHEN contains(event_type, 'blur') OR contains(event_type, 'focus') THEN 'window_blur' WHEN contains(event_type, 'fullscreen') THEN 'fullscreen_exit' ELSE 'other' END AS b
FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'tab_switch' WHEN event_id % 4 = 1 THEN 'window_blur' WHEN event_id % 7 = 2 THEN 'fullscreen' ELSE lower(event_type) END AS event_type FROM events)) GROUP BY 1""")
def event_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _proctor_events(spark, d).groupBy(assess.event_bucket(F.col("event_type")).alias("bucket")).agg(F.count("*").alias("n"))


def _proctor_events(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "tab_switch").when(e % 4 == 1, "window_blur").when(e % 7 == 2, "fullscreen").otherwise(F.lower("event_type"))
    return read_table(spark, d, "events").withColumn("event_type", kind)


@query("""WITH e AS (SELECT user_id * 100 + day(ts) AS attempt_id, CASE WHEN event_id % 4 = 0 THEN 't' WHEN event_id % 4 = 1 THEN 'w' WHEN event_id % 7 = 2 THEN 'f' ELSE 'o' END AS k FROM events),
a AS (SELECT attempt_id, count(*) FILTER (k = 't') AS tab_switch, count(*) FILTER (k = 'w') AS window_blur, count(*) FILTER (k = 'f') AS fullscreen_exit, count(*) FILTER (k = 'o') AS other, count(*) // 4 AS warnings FROM e GROUP BY 1)
SELECT *, CASE WHEN warnings >= 3 THEN 'HIGH' WHEN warnings >= 1 OR tab_switch >= 3 OR fullscreen_exit >= 2 THEN 'MODERATE' ELSE 'CLEAN' END AS risk FROM a""")
def risk_roster(spark: SparkSession, d: str) -> DataFrame:
    logs = _proctor_events(spark, d).withColumn("attempt_id", F.col("user_id") * 100 + F.dayofmonth("ts"))  # a user's day is an attempt
    logs = logs.withColumn("event_type", F.when(assess.event_bucket(F.col("event_type")).isin("tab_switch", "window_blur", "fullscreen_exit"), F.col("event_type")).otherwise("other"))
    attempts = logs.groupBy("attempt_id").agg(F.floor(F.count("*") / 4).alias("warnings"), F.min("ts").alias("started_at"), (F.max("ts") + F.expr("interval 2 days")).alias("submitted_at")).withColumn("percentage", F.lit(50.0))
    roster = assess.risk_roster(attempts, logs, F.timestamp_seconds(F.lit(0)), 3600.0)
    return roster.select("attempt_id", "tab_switch", "window_blur", "fullscreen_exit", "other", "warnings", "risk")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE contains(props, '7') AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50""")
def json_filter(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").where(relational.contains("props", "7"))
    return events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k >= 50")


@query("""SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return assess.confusion(read_table(spark, d, "labels"), "quality", "toxic")


@query("""WITH h AS (SELECT event_type AS sample, day(ts) > 15 AS late, count(*) AS n, avg(value) AS v FROM events GROUP BY ALL), x AS (SELECT a.sample, unnest(['n', 'v']) AS metric, unnest([CAST(b.n AS DOUBLE), b.v]) AS before, unnest([CAST(a.n AS DOUBLE), a.v]) AS now FROM h a JOIN h b USING (sample) WHERE a.late AND NOT b.late)
SELECT sample, metric, round(before, 6) AS before, round(now, 6) AS now FROM x WHERE (metric = 'n' AND before - now > 0) OR (metric = 'v' AND now - before > 0.05)""")
def regression_diff(spark: SparkSession, d: str) -> DataFrame:
    late = F.dayofmonth("ts") > 15
    halves = read_table(spark, d, "events").groupBy(F.col("event_type").alias("sample"), late.alias("late")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    out = assess.regressions(halves.where("late"), halves.where("not late"), {"n": ("drop", 0), "v": ("rise", 0.05)})
    return out.withColumn("before", F.round("before", 6)).withColumn("now", F.round("now", 6))


@query(r"""SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil((length(text) - s) / 4 + s / 2)) END AS BIGINT) AS tokens FROM (SELECT doc_id, text, length(regexp_replace(text, '[^$\\{}_^&=+\-*/<>\[\]]', '', 'g')) AS s FROM documents)""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.tokens_estimate(F.col("text")).alias("tokens"))


@query(r"""WITH m AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, '?? ' || lower(text) || ' !!' FROM documents WHERE doc_id % 10 = 0),
n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '\\[,;! ]', '', 'g'), '[^\p{L}\p{N}_\s$\\^{}]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM m)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS "first" FROM n""")
def norm_exact_dups(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    mangled = docs.where("doc_id % 10 = 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.concat(F.lit("?? "), F.lower("text"), F.lit(" !!")).alias("text"))
    return texts.exact_duplicates(docs.unionByName(mangled), "doc_id", "text")


@query()
def garbage_rate(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.garbage(F.col("text")).alias("g")).select("doc_id", "g.*")


@query(r"""SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE latin / n END, 3) AS latin FROM (SELECT doc_id, length(b) AS n, length(regexp_replace(b, '[^A-Za-z\x{c0}-\x{ff}]', '', 'g')) AS latin FROM (SELECT doc_id, regexp_replace(text, '[\s\p{Nd}]', '', 'g') AS b FROM documents))""")
def script_mix(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.scripts(F.col("text"))["latin"].alias("latin"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\b([B-HJ-Z])\s+([a-z]{2,})\b', '\1\2', 'g'), '\b([AI])\s+(ll|nd|n|f|t|s|nto|ts)\b', '\1\2', 'g')) AS cleaned FROM (SELECT doc_id, regexp_replace(text, '[^\x01-\x7f]', ' ', 'g') AS t FROM documents)""")
def drop_caps(spark: SparkSession, d: str) -> DataFrame:
    """Every text, with a space for each character that is not ASCII: word borders mean the same there in both engines."""
    plain = F.regexp_replace("text", r"[^\x01-\x7f]", " ")
    return read_table(spark, d, "documents").select("doc_id", F.md5(text.merge_drop_caps(plain)).alias("cleaned"))


@query(r"""SELECT doc_id, length(text) AS n_before, md5(regexp_replace(text, '([A-Za-z\x{0900}-\x{097f}\x{0a80}-\x{0aff}]+)[-\x{ad}]\s*\n\s*([A-Za-z\x{0900}-\x{097f}\x{0a80}-\x{0aff}]+)', '\1\2', 'g')) AS cleaned FROM documents""")
def hyphen_rejoin(spark: SparkSession, d: str) -> DataFrame:
    """A hyphen and a line break are put into every plain word of four letters or more, and must go again."""
    broken = F.regexp_replace("text", r"(?<![\p{L}\p{M}\p{N}_-])([a-z]{2})([a-z]{2,})(?= )", "$1-\n$2")
    return read_table(spark, d, "documents").select("doc_id", F.length("text").alias("n_before"), F.md5(text.rejoin_hyphens(broken)).alias("cleaned"))


_SPECIAL = r"length(text) - length(regexp_replace(text, '[$\\{}_^&=+\-*/<>\[\]]', '', 'g'))"


@query(f"""WITH RECURSIVE t AS (SELECT source, doc_id AS position, doc_id % 3 AS priority, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil((length(text) - ({_SPECIAL})) / 4 + ({_SPECIAL}) / 2)) END AS BIGINT) AS tokens
  FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority, position) AS i FROM t),
w AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS i, CAST(2000 AS BIGINT) AS room, CAST(NULL AS BIGINT) AS position, CAST(NULL AS BIGINT) AS priority, CAST(NULL AS BIGINT) AS tokens, false AS kept FROM o
  UNION ALL SELECT w.source, o.i, CASE WHEN o.tokens <= room THEN room - o.tokens ELSE room END, o.position, o.priority, o.tokens, o.tokens <= room FROM w JOIN o ON o.source IS NOT DISTINCT FROM w.source AND o.i = w.i + 1)
SELECT source, position, priority, tokens, kept FROM w WHERE position IS NOT NULL""")
def budget_greedy(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    items = docs.select("source", F.col("doc_id").alias("position"), (F.col("doc_id") % 3).alias("priority"), text.tokens_estimate(F.col("text")).alias("tokens"))
    return select.fill_budget(items, "source", 2000)


@query()
def quota_select(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    pool = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("topic_id"), F.col("p_type").alias("difficulty"), F.col("p_size").alias("marks"))
    return select.select_quota(pool, "brand", 60.0)


@query()
def near_dups(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of all documents that repeat a benchmark item, in its words or nearly so."""
    said = F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("place", "text")
    sentences = read_table(spark, d, "documents").select((F.col("doc_id") * 1000000).alias("_d"), said).select((F.col("_d") + F.col("place")).alias("sentence_id"), "text")
    return texts.similar_pairs(read_table(spark, d, "benchmark"), sentences, "text", "item_id", "sentence_id")


@query()
def chunk(spark: SparkSession, d: str) -> DataFrame:
    return texts.chunks(read_table(spark, d, "documents")).drop("formulas")


_TOC_TEXT = """SELECT page_id, 'Contents' || chr(10) || 'Chapter ' || (page_id % 20 + 1) || ': Part ' || page_id || ' .... ' || (page_id * 3 + 1) || chr(10) || regexp_replace(html, '<[^>]*>', chr(10), 'g') AS t FROM pages"""


@query(rf"""WITH p AS ({_TOC_TEXT}), e AS (SELECT page_id, unnest(regexp_extract_all(t, '(?m){texts.TOC_LINE[4:].replace("'", "''")}', 1)) AS n, unnest(regexp_extract_all(t, '(?m){texts.TOC_LINE[4:].replace("'", "''")}', 2)) AS title, unnest(regexp_extract_all(t, '(?m){texts.TOC_LINE[4:].replace("'", "''")}', 3)) AS page FROM p)
SELECT page_id, CAST(coalesce(try_cast(n AS INTEGER), nullif(list_position(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'], n), 0), 1) AS INTEGER) AS number, trim(title) AS title, try_cast(page AS INTEGER) AS page FROM e WHERE try_cast(page AS INTEGER) IS NOT NULL""")
def toc_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whole page texts after one line of contents."""
    k = F.col("page_id")
    line = F.concat(F.lit("Contents\nChapter "), (k % 20 + 1).cast("string"), F.lit(": Part "), k.cast("string"), F.lit(" .... "), (k * 3 + 1).cast("string"), F.lit("\n"))
    pages = read_table(spark, d, "pages").select("page_id", F.concat(line, F.regexp_replace("html", "<[^>]*>", "\n")).alias("text"))
    return texts.toc_lines(pages, "page_id", "text")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def proctor_stream(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts, as the streaming job computes them on a batch."""
    return jobs.event_counts(read_table(spark, d, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("""SELECT user_id AS job_id, event_id % 20 AS page_number, arg_max(event_type, (ts, event_id)) AS raw_text FROM events GROUP BY ALL""")
def ingest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Pages of two batches, the second merged into the first."""
    rows = read_table(spark, d, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 20).alias("page_number"), F.col("event_type").alias("raw_text"), F.struct("ts", "event_id").alias("event_time"))
    old, new = rows.where("event_time.event_id % 2 = 0"), rows.where("event_time.event_id % 2 = 1")
    merged = jobs.merge_pages(relational.latest(old, ["job_id", "page_number"], ["event_time"]), relational.latest(new, ["job_id", "page_number"], ["event_time"]))
    return merged.select("job_id", "page_number", "raw_text")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice < 50000 THEN 1 WHEN o_totalprice < 150000 THEN 2 WHEN o_totalprice < 250000 THEN 3 ELSE 4 END AS b FROM orders)
SELECT o_orderkey AS id, chr(CAST(64 + dense_rank() OVER (PARTITION BY o_custkey ORDER BY b) AS INTEGER)) AS section, row_number() OVER (PARTITION BY o_custkey ORDER BY b, o_orderkey) AS number FROM s""")
def paper_sections(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    kind, marks = F.when(p < 50000, "MCQ").otherwise("SHORT_ANSWER"), F.when(p < 150000, 2.0).when(p < 250000, 3.0).otherwise(5.0)
    questions = read_table(spark, d, "orders").select(F.col("o_custkey").alias("version_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("position"), kind.alias("question_type"), marks.alias("marks"))
    return select.sections(questions).select("id", "section", "number")


@query("""SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12') QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) <= CASE p_brand WHEN 'Brand#1' THEN 3 WHEN 'Brand#2' THEN 2 WHEN 'Brand#11' THEN 4 ELSE 1 END""")
def tier_select(spark: SparkSession, d: str) -> DataFrame:
    counts = {"Brand#1": 3, "Brand#2": 2, "Brand#11": 4, "Brand#12": 1}
    return select.select_tiers(read_table(spark, d, "part"), "p_brand", counts, ["p_retailprice", "p_partkey"]).select("p_partkey", "p_brand")


@query("""SELECT c_custkey, '+91' || (7000000000 + c_custkey) AS phone, CAST(c_custkey % 12 + 1 AS INTEGER) AS standard, chr(CAST(65 + c_custkey % 4 AS INTEGER)) AS section FROM customer""")
def school_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    roman = F.element_at(F.array(*map(F.lit, school.ROMAN)), (k % 12 + 1).cast("int"))
    letter = F.chr(97 + k % 4)
    entry = F.when(k % 3 == 0, F.concat(F.lit("Std. "), (k % 12 + 1).cast("string"), F.lit(" — "), letter)).when(k % 3 == 1, F.concat(roman, F.lit(" - "), letter)).otherwise(F.concat((k % 12 + 1).cast("string"), F.lit("th - Section "), letter))
    number = F.concat(F.lit("0"), F.substring((7000000000 + k).cast("string"), 1, 5), F.lit("-"), F.substring((7000000000 + k).cast("string"), 6, 5))
    made = school.class_assignment(entry)
    return read_table(spark, d, "customer").select("c_custkey", school.phone(number).alias("phone"), made["standard"].alias("standard"), made["section"].alias("section"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Garbage statistics and label shares by language."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang", text.garbage(F.col("text")).alias("g"))
    rows = docs.join(read_table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.sum("toxic").alias("toxic"), F.sum("g.garbage").alias("garbage"), F.round(F.avg("g.rate"), 6).alias("rate"))




@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 AND p_size >= 20 THEN ['TWENTY', 'THIRTY', 'FORTY', 'FIFTY'][p_size // 10 - 1] WHEN p_size < 20 THEN ['ONE','TWO','THREE','FOUR','FIVE','SIX','SEVEN','EIGHT','NINE','TEN','ELEVEN','TWELVE','THIRTEEN','FOURTEEN','FIFTEEN','SIXTEEN','SEVENTEEN','EIGHTEEN','NINETEEN'][p_size]
ELSE ['TWENTY', 'THIRTY', 'FORTY', 'FIFTY'][p_size // 10 - 1] || ' ' || ['ONE','TWO','THREE','FOUR','FIVE','SIX','SEVEN','EIGHT','NINE'][p_size % 10] END AS words FROM part""")
def marks_in_words(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", markup.marks_words(F.col("p_size")).alias("words"))


@query("""SELECT o_orderkey, coalesce(o_orderdate <= TIMESTAMP '1996-06-01', true) AND coalesce(TIMESTAMP '1996-06-01' <= CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + INTERVAL 400 DAY END, true) AS is_open FROM orders""")
def open_window(spark: SparkSession, d: str) -> DataFrame:
    until = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate") + F.expr("interval 400 days"))
    return read_table(spark, d, "orders").select("o_orderkey", relational.open_window(F.col("o_orderdate"), until, F.to_timestamp(F.lit("1996-06-01"))).alias("is_open"))


@query("""SELECT event_id, user_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-21' AND event_type = 'click')""")
def audit_retention(spark: SparkSession, d: str) -> DataFrame:
    return relational.retained(read_table(spark, d, "events"), 10, F.to_timestamp(F.lit("2024-01-31")), "ts", "click", "event_type").select("event_id", "user_id")


@query("""SELECT k AS paper_id, CASE WHEN n < 26 THEN chr(65 + n) ELSE chr(64 + n // 26) || chr(65 + n % 26) END AS version_label FROM (SELECT c_custkey AS k, CAST(CASE WHEN c_custkey % 29 < c_custkey % 30 THEN c_custkey % 29 ELSE c_custkey % 30 END AS INTEGER) AS n FROM customer)""")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    """Papers with the first labels in use, one of them missing."""
    papers = read_table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"))
    used = papers.where("paper_id % 30 > 0").select("paper_id", F.explode(F.sequence(F.lit(0), F.col("paper_id") % 30 - 1)).alias("i")).where("i <> paper_id % 29")
    return select.next_label(used.select("paper_id", select.version_label(F.col("i")).alias("version_label")), papers)


@query("""SELECT c_nationkey, count(*) AS members, count(*) FILTER (c_mktsegment = 'BUILDING') AS builders, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1""")
def filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("members"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("builders"), F.count_distinct("c_mktsegment").alias("segments"))


@query("""SELECT l_orderkey, CAST(round_even(sum(l_tax * 50), 0) AS INTEGER) AS total_marks FROM lineitem GROUP BY 1""")
def version_totals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versions, whose lines are questions in the order of the files: a sum of doubles depends on it."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    lines = read_table(spark, d, "lineitem").select("l_orderkey", F.struct(place.alias("place"), (F.col("l_tax") * 50).alias("marks")).alias("line"))
    snapshots = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("snapshot"))
    return snapshots.select("l_orderkey", assess.version_total(F.col("snapshot")).alias("total_marks"))


@query("""SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE text <> '' GROUP BY 1""")
def chapter_context(spark: SparkSession, d: str) -> DataFrame:
    return documents.chapter_context(read_table(spark, d, "conversations").withColumnRenamed("turn", "position"), "conv_id")


@query("""SELECT p_partkey, batch, CAST(least(10, p_size - batch * 10) AS INTEGER) AS quantity FROM (SELECT p_partkey, p_size, unnest(range(0, (p_size + 9) // 10)) AS batch FROM part)""")
def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    return documents.plan_batches(read_table(spark, d, "part").select("p_partkey", F.col("p_size").alias("count"))).select("p_partkey", F.col("batch").cast("long").alias("batch"), F.col("quantity").cast("int").alias("quantity"))


@query("""SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS changed_n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""")
def capability_semi(spark: SparkSession, d: str) -> DataFrame:
    grants = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("capability"))
    users = relational.with_capability(read_table(spark, d, "orders").withColumnRenamed("o_custkey", "id"), grants, "BUILDING")
    return users.groupBy(F.col("id").alias("o_custkey")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("changed_n"))


@query("""SELECT brand AS value, CASE brand WHEN 'Brand#31' THEN 0 WHEN 'Custom' THEN 1 ELSE 2 END AS position FROM (SELECT DISTINCT p_brand AS brand FROM part UNION SELECT 'Brand#31' UNION SELECT 'Custom')""")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return relational.union_distinct(["Brand#31", "Custom"], read_table(spark, d, "part").select("p_brand"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS "count" FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def broken_keys(spark: SparkSession, d: str) -> DataFrame:
    return relational.duplicate_keys(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query()
def page_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return text.clean_pages(read_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "flags", "glued", "quality", F.md5("text").alias("cleaned"))
