"""Registered queries of items, budgets, drafts, figures, names and page figures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import records
from quillspark.plans.queries import query
from quillspark.sources.tables import read_table


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, CASE role WHEN 'user' THEN 'HEADING' ELSE 'PARAGRAPH' END AS item_type, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS heading,
CASE WHEN turn % 2 = 0 AND coalesce(text, '') <> '' THEN text ELSE 'picture of ' || turn END AS content FROM conversations""")
def flat_items(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as pages whose turns are their sections."""
    t = F.col("turn")
    section = F.struct(t.alias("turn"), F.when(F.col("role") == "user", "HEADING").otherwise("BUBBLE").alias("type"), F.when(t % 3 != 0, F.col("role")).alias("heading"), F.when(t % 2 == 0, F.col("text")).otherwise("").alias("text"), F.concat(F.lit("picture of "), t.cast("string")).alias("image_description"))
    pages = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    return records.flat_items(pages, ["conv_id"])


_MODELS = ("gemini-2.0-flash-exp", " GPT-4o-mini ", "some claude-3-haiku-2", "gemini-3.5-flash-lite", "gemini-3.5-flash-x", "other")


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 14 AS q, (ARRAY{list(_MODELS)})[doc_id % {len(_MODELS)} + 1] AS model, CASE WHEN doc_id % 5 = 0 THEN 6000 END AS own FROM documents),
p AS (SELECT *, CASE WHEN contains(lower(model), 'gemini-3.5-flash-lite') THEN 'gemini-3.5-flash-lite' WHEN contains(lower(model), 'gemini-3.5-flash') THEN 'gemini-3.5-flash' WHEN contains(lower(model), 'gemini-2.0-flash') THEN 'gemini-2.0-flash' WHEN contains(lower(model), 'gpt-4o-mini') THEN 'gpt-4o-mini' WHEN contains(lower(model), 'claude-3-haiku') THEN 'claude-3-haiku' ELSE 'default' END AS profile,
  length(text) - length(regexp_replace(text, '[$\\\\{{}}_^&=+\\-*/<>\\[\\]]', '', 'g')) AS s FROM t),
w AS (SELECT *, coalesce(own, CASE profile WHEN 'default' THEN 8192 WHEN 'gpt-4o-mini' THEN 16384 WHEN 'claude-3-haiku' THEN 16384 ELSE 32768 END) AS w, least(CASE profile WHEN 'default' THEN 2048 ELSE 4096 END, q * 220 + 400) AS o, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil((length(text) - s) / 4 + s / 2)) END AS y FROM p)
SELECT doc_id, profile, CAST(w AS BIGINT) AS "window", CAST(y AS BIGINT) AS system, CAST(o AS BIGINT) AS output, CAST(greatest(200, w - y - o - floor(w * 0.05)) AS BIGINT) AS context FROM w""")
def model_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Every document as the prompt of a model."""
    k = F.col("doc_id")
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (k % len(_MODELS) + 1).cast("int"))
    made = records.model_budget(model, F.col("text"), k % 14, F.when(k % 5 == 0, 6000))
    return read_table(spark, d, "documents").select("doc_id", made.alias("b")).select("doc_id", "b.*")


@query("""WITH a AS (SELECT conv_id, turn, replace(replace(coalesce(text, ''), chr(92), ' '), '"', ' ') AS said, turn % 4 AS form FROM conversations), b AS (SELECT *, trim(replace(replace(replace(said, chr(10), ' '), chr(9), ' '), chr(13), ' ')) AS q FROM a)
SELECT conv_id * 1000 + turn AS answer_id, CAST(0 AS INTEGER) AS position, q AS question_text, CASE form WHEN 0 THEN 'MCQ' WHEN 1 THEN 'SHORT_ANSWER' ELSE 'LONG_ANSWER' END AS question_type, CASE form WHEN 0 THEN 2.0 WHEN 1 THEN 3.0 ELSE 3.0 END AS marks,
CASE form WHEN 0 THEN 'HARD' ELSE 'MEDIUM' END AS difficulty, CASE form WHEN 0 THEN 2 ELSE -1 END AS options FROM b WHERE length(q) >= 5 AND form < 3""")
def valid_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Turns as the questions of a model's answers: in a fence, in an object, with an unknown type, or no JSON at all."""
    t = F.col("turn")
    q = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), '\\"', "  "), r"[\n\t\r]", " "))
    item = lambda rest: F.concat(F.lit('{"question_text": "'), q, F.lit(f'"{rest}}}'))
    answer = (
        F.when(t % 4 == 0, F.concat(F.lit("```json\n["), item(', "marks": "2", "difficulty": "hard", "options": {"A": 1}'), F.lit(', "no object"]\n```')))
        .when(t % 4 == 1, F.concat(F.lit('{"questions": ['), item(', "question_type": "short_answer", "marks": "many", "options": {"A": "x", "B": "y"}'), F.lit("]}")))
        .when(t % 4 == 2, F.concat(F.lit("["), item(', "question_type": "ESSAY"'), F.lit("]"))).otherwise("sorry")
    )
    rows = read_table(spark, d, "conversations").select((F.col("conv_id") * 1000 + t).alias("answer_id"), answer.alias("answer"), F.when(t % 4 == 0, "MCQ").otherwise("LONG_ANSWER").alias("question_type"), F.lit(3).alias("marks"))
    made = records.valid_drafts(rows, "answer_id")
    return made.select("answer_id", "position", "question_text", "question_type", F.col("marks").cast("double").alias("marks"), "difficulty", F.when(F.col("options").isNull(), -1).otherwise(F.size("options")).alias("options"))


@query("""WITH t AS (SELECT p_brand AS paper, p_partkey AS tier, CAST(p_size % 4 + 1 AS DOUBLE) AS marks, p_size % 23 AS n, p_partkey % 7 = 0 AND p_brand <> 'Brand#3' AS diagram FROM part WHERE p_brand <> 'Brand#4' OR p_size % 4 < 2),
f AS (SELECT *, bool_or(diagram OR marks >= 3) OVER (PARTITION BY paper) AS has_drawn, max(marks) OVER (PARTITION BY paper) AS top FROM t),
b AS (SELECT *, unnest(range(0, CAST(ceil(n / 10) AS BIGINT))) AS k FROM f WHERE n > 0), q AS (SELECT *, least(10, n - k * 10) AS quantity, row_number() OVER (PARTITION BY paper ORDER BY tier, k) - 1 AS batch FROM b),
w AS (SELECT *, CASE WHEN diagram OR marks >= 3 OR (NOT has_drawn AND marks = top) THEN greatest(1, quantity // 2) ELSE 0 END AS want, length(paper) * 9 AS figs FROM q),
c AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY paper ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT paper AS paper_id, CAST(batch AS INTEGER) AS batch, tier, CAST(quantity AS INTEGER) AS quantity, CAST(least(before, figs) AS BIGINT) AS first_figure, CAST(least(want, figs - least(before, figs)) AS BIGINT) AS figures FROM c""")
def figure_batches(spark: SparkSession, d: str) -> DataFrame:
    """Brands as papers whose parts are their tiers."""
    part = read_table(spark, d, "part").where("p_brand <> 'Brand#4' or p_size % 4 < 2")
    size = F.col("p_size")
    drawn = (F.col("p_partkey") % 7 == 0) & (F.col("p_brand") != "Brand#3")
    tiers = part.select(F.col("p_brand").alias("paper_id"), F.col("p_partkey").alias("tier"), (size % 4 + 1).cast("double").alias("marks"), (size % 23).alias("count"), F.when(drawn, F.array(F.lit("MCQ"), F.lit("DIAGRAM_BASED"))).otherwise(F.array(F.lit("MCQ"))).alias("question_types"))
    papers = part.select(F.col("p_brand").alias("paper_id"), (F.length("p_brand") * 9).alias("figures")).distinct()
    return records.figure_batches(tiers, papers).withColumn("quantity", F.col("quantity").cast("int"))


@query("""WITH n AS (SELECT c_custkey, 'st_' || lower(c_mktsegment) AS base, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer),
k AS (SELECT DISTINCT 'st_' || lower(c_mktsegment) AS base, c_nationkey * 2 AS n FROM customer), s AS (SELECT base, unnest(range(0, 100000)) AS n FROM (SELECT base, max(r) AS most FROM n GROUP BY base)),
f AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) AS r FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.base = s.base AND k.n = s.n))
SELECT c_custkey, CASE WHEN f.n = 0 THEN base ELSE base || '_' || f.n END AS username FROM n JOIN f USING (base, r)""")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Customers named by their segments, beside names that are taken."""
    base = F.concat(F.lit("st_"), F.lower("c_mktsegment"))
    table = read_table(spark, d, "customer")
    taken = table.select(F.when(F.col("c_nationkey") == 0, base).otherwise(F.concat(base, F.lit("_"), (F.col("c_nationkey") * 2).cast("string"))).alias("username"))
    return records.unique_names(table.select("c_custkey", base.alias("base")), taken, "base", ["c_custkey"]).select("c_custkey", "username")


@query("""WITH l AS (SELECT doc_id, unnest(x) AS text, unnest(range(1, len(x) + 1)) AS n FROM (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, n % 3 AS b, CASE WHEN n % 5 = 0 THEN 'blank' ELSE 'digital_text' END AS kind, regexp_replace(text, '[\\s\\x0b]', '', 'g') = '' AS bare FROM l)
SELECT doc_id, count(*) AS pages, count(*) FILTER (bare AND kind <> 'blank') AS empty_pages, CAST(sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS BIGINT) AS tiny_pictures, CAST(count(DISTINCT kind) AS INTEGER) AS kinds FROM k GROUP BY doc_id""")
def document_figures(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its lines as pages."""
    docs = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "raw_text")).withColumn("n", F.col("p") + 1)
    box = lambda x, y: F.struct(F.lit(5.0).alias("x0"), F.lit(5.0).alias("y0"), F.lit(x).alias("x1"), F.lit(y).alias("y1"))
    pictures = F.when(F.col("n") % 3 == 1, F.array(box(200.0, 64.9), box(300.0, 300.0))).when(F.col("n") % 3 == 2, F.array(box(2.0, 90.0), box(5.0, 9.0))).otherwise(F.array(box(65.0, 65.0)))
    pages = docs.select("doc_id", "raw_text", F.when(F.col("n") % 5 == 0, "blank").alias("page_kind"), F.lit(False).alias("needs_review"), F.lit(0.9).alias("confidence"), pictures.alias("pictures"))
    out = records.document_figures(pages)
    return out.select("doc_id", "pages", "empty_pages", "tiny_pictures", F.size("kinds").alias("kinds"))
