"""Records of extraction and generation: items of pages, budgets of models, drafts, figures, names, and page figures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.markup import repair_json
from quillspark.functions.text import garbage, tokens_estimate

# fixed values: kinds of items; windows and output limits of models by parts of their names, the first that fits counting;
# types of questions; the least side of a picture
ITEM_TYPES = ("PARAGRAPH", "HEADING", "TABLE", "FORMULA", "IMAGE", "DIAGRAM", "EXERCISE_QUESTION", "SOLVED_EXAMPLE", "ACTIVITY", "DEFINITION", "SUMMARY", "CAPTION")
PROFILES = (
    ("gemini-3.5-flash-lite", 32768, 4096), ("gemini-3.5-flash", 32768, 4096), ("gemini-2.0-flash", 32768, 4096), ("gemini-1.5-flash", 16384, 3072), ("gemini-3.8-flash", 32768, 4096), ("gpt-4o-mini", 16384, 4096),
    ("claude-3-haiku", 16384, 4096), ("default", 8192, 2048),
)
QUESTION_TYPES = ("MCQ", "SHORT_ANSWER", "LONG_ANSWER", "DIAGRAM_BASED", "MAP_WORK")
LEAST_SIDE = 60
#: Tokens of a question's answer and of the envelope of all, and the share of a window that is spared.
A_QUESTION, ENVELOPE, SPARED = 220, 400, 0.05


def flat_items(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys ..., position, item_type, heading, content): one row for each section of a page, in order.

    pages: (keys ..., sections: array of type, heading, text, image_description). Unknown types are PARAGRAPH; the content
    is the text, or else the description of the picture; nulls are empty. Pages without sections give no row.
    """
    s = F.col("s")
    kind = F.when(s["type"].isin(*ITEM_TYPES), s["type"]).otherwise("PARAGRAPH")
    text = F.coalesce(F.nullif(s["text"], F.lit("")), s["image_description"], F.lit(""))
    rows = pages.select(*keys, F.posexplode("sections").alias("position", "s"))
    return rows.select(*keys, "position", kind.alias("item_type"), F.coalesce(s["heading"], F.lit("")).alias("heading"), text.alias("content"))


def model_budget(model: Column, prompt: Column, questions: Column, window: Column | None = None, output: Column | None = None) -> Column:
    """(profile, window, system, output, context): how the tokens of a model's window are shared out.

    The profile is the first whose name is part of the model's; a window of its own may be given, and a wish for the output,
    which the profile's limit cuts. The context is what is left, five per cent spared, 200 at least.
    """
    named = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    made = None
    for name, size, most in PROFILES:
        row = F.struct(F.lit(name).alias("name"), F.lit(size).alias("window"), F.lit(most).alias("most"))
        made = F.when(named.contains(name), row) if made is None else made.when(named.contains(name), row)
    profile = made.otherwise(F.struct(*(F.lit(v).alias(n) for v, n in zip(PROFILES[-1], ("name", "window", "most"), strict=True))))
    given = lambda c: F.when(c > 0, c.cast("int")) if c is not None else F.lit(None).cast("int")
    total = F.coalesce(given(window), profile["window"])
    needed = F.greatest(F.coalesce(given(output), F.lit(0)), questions * A_QUESTION + ENVELOPE)
    reserved, system = F.least(needed, profile["most"]).cast("long"), tokens_estimate(prompt)
    left = total - system - reserved - F.floor(total * SPARED)
    return F.struct(profile["name"].alias("profile"), total.cast("long").alias("window"), system.alias("system"), reserved.alias("output"), F.greatest(F.lit(200), left).cast("long").alias("context"))


def valid_drafts(answers: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """(key, position, question_text, question_type, marks, difficulty, learner_level, correct_answer, options) of the
    drafts in a model's answers.

    An answer is a list, or an object with `questions`. Items that are no objects, and texts under five characters, fall
    away. What a draft lacks comes from the columns question_type, marks, difficulty and learner_level of answers, or else
    is MCQ, 1, MEDIUM and INTERMEDIATE; so does an unknown type. A choice with fewer than two options is true or false, and
    other types have none. Marks that are no number are the default.
    """
    asked = {n: F.coalesce(F.col(n).cast("string"), F.lit(v)) if n in answers.columns else F.lit(v) for n, v in (("question_type", "MCQ"), ("marks", "1"), ("difficulty", "MEDIUM"), ("learner_level", "INTERMEDIATE"))}
    fixed = repair_json(F.col(answer))
    listed = F.coalesce(F.from_json(F.when(fixed.startswith("["), fixed), "array<string>"), F.from_json(F.get_json_object(F.when(fixed.startswith("{"), fixed), "$.questions"), "array<string>"))
    rows = answers.select(key, *(v.alias(f"_{n}") for n, v in asked.items()), F.posexplode(listed).alias("position", "d")).where("d like '{%'")
    said = lambda n: F.trim(F.get_json_object("d", f"$.{n}"))
    full = lambda n: F.nullif(said(n), F.lit(""))
    rows = rows.withColumn("question_text", said("question_text")).where("length(question_text) >= 5")
    kind = F.upper(F.coalesce(full("question_type"), F.col("_question_type")))
    rows = rows.withColumn("question_type", F.when(kind.isin(*QUESTION_TYPES), kind).otherwise(F.col("_question_type")))
    options = F.from_json(F.get_json_object("d", "$.options"), "map<string,string>")
    options = F.when(F.col("question_type") == "MCQ", F.when(F.size(options) >= 2, options).otherwise(F.create_map(F.lit("A"), F.lit("True"), F.lit("B"), F.lit("False"))))
    marks = F.coalesce(said("marks").try_cast("decimal(8,2)"), F.col("_marks").try_cast("decimal(8,2)"), F.lit(1).cast("decimal(8,2)"))
    up = lambda n: F.upper(F.coalesce(full(n), F.col(f"_{n}"))).alias(n)
    return rows.select(key, "position", "question_text", "question_type", marks.alias("marks"), up("difficulty"), up("learner_level"), F.coalesce(full("correct_answer"), F.lit("See explanation")).alias("correct_answer"), options.alias("options"))


def figure_batches(tiers: DataFrame, papers: DataFrame, most: int = 10) -> DataFrame:
    """(paper_id, batch, tier, quantity, first_figure, figures): tiers in batches of ten questions at most, with the range
    of a paper's figures that each batch gets.

    tiers: (paper_id, tier, marks, count, question_types), tried by `tier`; papers: (paper_id, figures: how many there are).
    Batches of tiers with diagrams, or of three marks or more, take a figure for every two questions, and one at least,
    while there are any; if a paper has no such tier, those of its highest marks do.
    """
    w = Window.partitionBy("paper_id")
    worth = F.coalesce(F.col("marks").cast("double"), F.lit(1.0))
    drawn = F.coalesce(F.array_contains("question_types", "DIAGRAM_BASED"), F.lit(False)) | (worth >= 3)
    fits = drawn | (~F.max(drawn).over(w) & (worth == F.max(worth).over(w)))
    rows = tiers.withColumn("_fits", fits).where("count > 0").select("paper_id", "tier", "_fits", F.col("count").alias("_n"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("count") / most).cast("int") - 1)).alias("_k"))
    rows = rows.withColumn("quantity", F.least(F.lit(most), F.col("_n") - F.col("_k") * most)).withColumn("batch", F.row_number().over(w.orderBy("tier", "_k")) - 1)
    want = F.when(F.col("_fits"), F.greatest(F.lit(1), F.floor(F.col("quantity") / 2))).otherwise(0)
    rows = rows.join(papers.select("paper_id", F.col("figures").alias("_all")), "paper_id", "left").withColumn("_want", want)
    before = F.coalesce(F.sum("_want").over(w.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("first_figure", F.least(before, F.coalesce("_all", F.lit(0))).cast("long"))
    return rows.select("paper_id", "batch", "tier", "quantity", "first_figure", F.least(F.col("_want"), F.coalesce("_all", F.lit(0)) - F.col("first_figure")).cast("long").alias("figures"))


def unique_names(rows: DataFrame, taken: DataFrame, base: str, order: list[str], name: str = "username") -> DataFrame:
    """rows with `name`: its base, or the base with the first of _1, _2, ... that is free, in order.

    taken: (name) of those there are. Rows of one base get its free names one after the other, by joining ranks, so none
    is probed. Bases must not end in a number of this form themselves.
    """
    known = taken.select(F.regexp_extract(name, r"^(.*?)(?:_([1-9][0-9]*))?$", 1).alias("_base"), F.coalesce(F.regexp_extract(name, r"_([1-9][0-9]*)$", 1).try_cast("long"), F.lit(0)).alias("_n")).distinct()
    new = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(base).orderBy(*order)))
    sizes = new.groupBy(F.col(base).alias("_base")).agg(F.max("_rank").alias("_new")).join(known.groupBy("_base").agg(F.count("*").alias("_old")), "_base", "left")
    free = sizes.select("_base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_new") + F.coalesce("_old", F.lit(0)))).alias("_n")).join(known, ["_base", "_n"], "left_anti")
    free = free.withColumn("_rank", F.row_number().over(Window.partitionBy("_base").orderBy("_n")))
    named = new.join(free, (F.col(base) == F.col("_base")) & (new["_rank"] == free["_rank"]))
    return named.select(*(rows[c] for c in rows.columns), F.when(F.col("_n") == 0, F.col(base)).otherwise(F.concat(base, F.lit("_"), F.col("_n").cast("string"))).alias(name))


def document_figures(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(<doc>, pages, avg_garbage, empty_pages, review_rate, tiny_pictures, kinds) of extracted documents.

    pages: (<doc>, raw_text, page_kind, needs_review, confidence of the document's kind, pictures: boxes). A page without
    text is empty, and all garbage, unless it is blank or one picture; it counts as reviewed, as do pages with over a fifth
    of garbage, and one more page where the kind is unsure. Pictures are tiny with a side under 60.
    """
    text, kind = F.coalesce("raw_text", F.lit("")), F.coalesce("page_kind", F.lit("digital_text"))
    bare, still = F.regexp_replace(text, r"\s", "") == "", kind.isin("image_only", "blank")
    rate = F.when(bare & still, 0.0).when(bare, 1.0).otherwise(garbage(text)["rate"])
    side = lambda b, x, y: F.abs(b[y] - b[x])
    tiny = F.size(F.filter(F.coalesce("pictures", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")), lambda b: (side(b, "x0", "x1") > 0) & (side(b, "y0", "y1") > 0) & (F.least(side(b, "x0", "x1"), side(b, "y0", "y1")) < LEAST_SIDE)))
    rows = pages.select(doc, rate.alias("_rate"), (bare & ~still).alias("_empty"), kind.alias("page_kind"), F.coalesce("needs_review", F.lit(False)).alias("_review"), "confidence", tiny.alias("_tiny"))
    seen = F.count_if(F.col("_review") | F.col("_empty") | (F.col("_rate") > 0.2)) + F.max(F.when(F.col("confidence") < 0.6, 1).otherwise(0))
    base = rows.groupBy(doc).agg(F.count("*").alias("pages"), F.avg("_rate").alias("avg_garbage"), F.count_if("_empty").alias("empty_pages"), F.least(F.lit(1.0), seen / F.count("*")).alias("review_rate"), F.sum("_tiny").alias("tiny_pictures"))
    kinds = rows.groupBy(doc, "page_kind").count().groupBy(F.col(doc).alias("_doc")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("page_kind", "count")))).alias("kinds"))
    return base.join(kinds, F.col(doc).eqNullSafe(F.col("_doc"))).drop("_doc")


def paged(df: DataFrame, order: list, params: dict, size: int = 20, most: int = 100, asked: bool = False) -> tuple[DataFrame, int | None]:
    """(rows, total): the page that the parameters page and page_size ask for, and how many rows there are.

    all=true, or paginate=false, gives all rows and no total; so does a list that is only paged when `asked` to (by page,
    page_size or paginate=true). A page or size that is no number counts as the first page, and as the usual size.
    """
    said = {k: str(v).strip().lower() for k, v in params.items()}
    whole = said.get("paginate") in ("false", "0", "no") or said.get("all") in ("true", "1", "yes")
    if whole or (asked and not (params.keys() & {"page", "page_size"} or said.get("paginate") in ("true", "1", "yes"))):
        return df.orderBy(*order), None
    number = lambda k, usual: int(said[k]) if re.fullmatch("[0-9]+", said.get(k, "")) and int(said[k]) else usual
    n = min(number("page_size", size), most)
    return df.orderBy(*order).offset((number("page", 1) - 1) * n).limit(n), df.count()
