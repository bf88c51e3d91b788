"""Document decisions from page features: kinds, routes, gates, budgets, batches, passages and pictures."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quillspark.functions.markup import PROSE, _Signs
from quillspark.functions.text import let, tokens_estimate
from quillspark.operators.duplicates import first_kept
from quillspark.shared import materialize

KINDS = ("NEWSPAPER", "MAGAZINE", "WORKSHEET_OR_EXAM", "FULL_BOOK", "SINGLE_CHAPTER", "NOTES", "UNKNOWN")


def sampled_pages(pages: DataFrame, total: str = "total_pages") -> DataFrame:
    """Pages that stand for a document: the first five, the middle of more than eight, the last of more than five."""
    n, p = F.col(total), F.col("page_number")
    return pages.where((p <= 5) | ((n > 8) & (p == F.floor(n / 2) + 1)) | ((n > 5) & (p == n)))


def classify(features: DataFrame) -> DataFrame:
    """`kind`, `confidence` and `evidence` (names of the signs that were seen) of each document from its counted evidence.

    features: total_pages, broadsheet, dateline, volume_stamp, opener, running_headers, multi_toc, scanned (booleans) and
    newspaper_words, exam_words, book_words, chapter_words, pedagogy_words (counts); and, where they are known, masthead,
    brand, publisher, named_masthead, chapter_file (booleans) and stated_kind, which goes before all evidence.
    """
    # the weights and limits below are fixed values
    c, zero = F.col, F.lit(0.0)
    known = lambda name: F.coalesce(c(name), F.lit(False)) if name in features.columns else F.lit(False)
    flag = lambda name, v: F.when(known(name), v).otherwise(0.0)
    part = lambda test, v: F.when(test, v).otherwise(0.0)
    pages, chapter, book = c("total_pages"), c("chapter_words") >= 1, c("book_words") >= 1
    taught, file_hint = c("pedagogy_words") >= 2, known("chapter_file") & ~known("named_masthead")
    single = part(file_hint, 0.08) + F.least(0.4 * F.lit(1.0), c("book_words") * 0.2) + part(chapter, F.least(F.lit(0.45), c("chapter_words") * 0.25)) + flag("opener", 0.25) + flag("running_headers", 0.2) + part(taught, 0.25)
    full = F.least(0.5 * F.lit(1.0), c("book_words") * 0.2) + flag("running_headers", 0.1) + part(taught, 0.2)
    unit = pages.between(5, 45) & ~c("multi_toc") & ((single > 0.2) | (full > 0.2))
    branded = flag("named_masthead", 0.08) + flag("publisher", 0.15) + flag("masthead", 0.5) + flag("brand", 0.3)
    scores = {
        "NEWSPAPER": branded + flag("broadsheet", 0.4) + flag("dateline", 0.25) + flag("volume_stamp", 0.15) + part(c("newspaper_words") >= 2, F.least(F.lit(0.35), c("newspaper_words") * 0.08)),
        "MAGAZINE": flag("volume_stamp", 0.1),
        "WORKSHEET_OR_EXAM": part(c("exam_words") >= 2, F.least(F.lit(0.8), 0.35 + c("exam_words") * 0.1)) + part((pages <= 5) & (c("exam_words") >= 1), 0.3),
        "FULL_BOOK": full + part(pages > 60, 0.35) + flag("multi_toc", 0.45),
        "SINGLE_CHAPTER": single + part(unit, 0.35) - flag("multi_toc", 0.3),
        "NOTES": flag("scanned", 0.65),
        "UNKNOWN": zero,
    }
    few = pages <= 5
    seen = {
        "NEWSPAPER": [known("publisher"), c("broadsheet"), c("dateline"), c("volume_stamp"), c("newspaper_words") >= 2],
        "MAGAZINE": [c("volume_stamp")],
        "WORKSHEET_OR_EXAM": [c("exam_words") >= 2, few & (c("exam_words") >= 1)],
        "FULL_BOOK": [book, c("running_headers"), taught, (pages > 60) & ~unit, c("multi_toc")],
        "SINGLE_CHAPTER": [book, chapter, c("opener"), c("running_headers"), taught, unit],
        "NOTES": [c("scanned")],
        "UNKNOWN": [],
    }
    count = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    ranked = F.array(*(F.struct(scores[k].alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("kind"), count(seen[k]).alias("n")) for i, k in enumerate(KINDS)))
    rows = features.withColumn("_r", F.reverse(F.array_sort(ranked)))
    top, margin = F.col("_r")[0], F.greatest(zero, F.col("_r")[0]["score"] - F.col("_r")[1]["score"])
    by_n = F.when(top["n"] >= 4, 0.88 + 0.08 * F.least(F.lit(1.0), margin / 0.6)).when(top["n"] == 3, 0.8 + 0.1 * F.least(F.lit(1.0), margin / 0.5)).when(top["n"] == 2, 0.7 + 0.12 * F.least(F.lit(1.0), margin / 0.4)).otherwise(0.58 + 0.12 * F.least(F.lit(1.0), margin / 0.3))
    hinted = ((top["kind"] == "NEWSPAPER") & known("named_masthead")) | ((top["kind"] == "SINGLE_CHAPTER") & file_hint)
    by_n = F.when(hinted, F.least(F.lit(0.96), by_n + 0.02)).otherwise(by_n)
    sure, likely = (top["score"] >= 0.45) & (top["n"] >= 1), top["score"] >= 0.25
    confidence = F.when(sure, F.round(F.least(F.lit(0.96), F.greatest(F.lit(0.6), by_n)), 3)).when(likely, F.round(0.4 + 0.15 * F.least(F.lit(1.0), top["score"] / 0.4), 3)).otherwise(0.2)
    stated = F.upper(F.trim("stated_kind")) if "stated_kind" in features.columns else F.lit(None).cast("string")
    stated = F.when(~stated.isin("", "AUTO", "UNKNOWN", "NONE"), stated)
    signs = {name: known(name) for name in ("named_masthead", "chapter_file", "publisher", "masthead", "brand", "broadsheet", "dateline", "volume_stamp")}
    signs |= {"newspaper_words": c("newspaper_words") >= 2, "exam_words": c("exam_words") >= 2, "book_words": book, "chapter_words": chapter, "opener": known("opener"), "running_headers": known("running_headers"), "lesson_words": taught, "length_of_a_chapter": unit, "length_of_a_book": (pages > 60) & ~unit, "outline": c("multi_toc"), "scanned": known("scanned")}
    named = F.filter(F.array(*(F.when(test, name) for name, test in signs.items()), F.when(~likely, "insufficient")), lambda x: x.isNotNull())
    rows = rows.withColumn("kind", F.coalesce(stated, F.when(likely, top["kind"]).otherwise("UNKNOWN"))).withColumn("confidence", F.when(stated.isNotNull(), 1.0).otherwise(confidence))
    return rows.withColumn("evidence", F.when(stated.isNotNull(), F.array(F.lit("stated"))).otherwise(named)).drop("_r")


def page_route(chars: Column, images: Column, image_share: Column, script: Column, legacy: Column) -> Column:
    """How a page is read: blank, image_only, scanned (needs OCR), legacy (needs a font map), mixed or text."""
    return (
        F.when((chars == 0) & (images == 0), "blank").when((chars < 20) & (image_share >= 0.8), "scanned").when((chars < 20) & (images > 0), "image_only")
        .when(legacy, "legacy").when((image_share >= 0.4) | (script == "mixed"), "mixed").otherwise("text")
    )


@F.pandas_udf(BooleanType())
def _all_sound(formulas: pd.Series) -> pd.Series:
    return formulas.map(lambda fs: fs is None or all(f and f.strip() and _Signs(f.strip()).sound() for f in fs))


def formula_gate(pages: DataFrame) -> DataFrame:
    """Pages with an unsound formula go to review with a quality of 0.60 at most; pages: (..., formulas, quality, needs_review, flags)."""
    bad = ~_all_sound("formulas")
    return pages.withColumn("flags", F.when(bad, F.array_union("flags", F.array(F.lit("corrupted_formula_detected")))).otherwise(F.col("flags"))).withColumn("quality", F.when(bad, F.least("quality", F.lit(0.6))).otherwise(F.col("quality"))).withColumn("needs_review", F.col("needs_review") | bad)


def formula_or_prose(text: Column) -> Column:
    """`PARAGRAPH` for text that was read as a formula: many prose words, or many lines."""
    words = F.filter(F.split(F.lower(text), r"[^a-z]+"), lambda w: F.length(w) > 0)
    prose = F.size(F.filter(words, lambda w: w.isin(PROSE)))
    fused = F.regexp_count(F.lower(text), F.lit("|".join(PROSE)))
    return F.when(((F.size(words) > 8) & (prose >= 3)) | (fused >= 3) | (F.regexp_count(text, F.lit("\n")) >= 3), "PARAGRAPH").otherwise("FORMULA")


def two_columns(boxes: Column, width: Column) -> Column:
    """Whether two boxes or more end left of 55 % of the width and two or more start right of 45 %."""
    return (F.size(F.filter(boxes, lambda b: b["x1"] <= 0.55 * width)) >= 2) & (F.size(F.filter(boxes, lambda b: b["x0"] >= 0.45 * width)) >= 2)


def model_sections(items: DataFrame, page: str = "page_number") -> DataFrame:
    """Items of a layout model with their section type and the running chapter, which starts at `Chapter 1`."""
    from pyspark.sql import Window

    label = F.lower("label")
    kind = F.when(label.contains("picture"), "IMAGE").when(label.contains("table"), "TABLE").when(label.contains("formula"), "FORMULA").when(label.contains("header"), "HEADING").otherwise("PARAGRAPH")
    order = Window.partitionBy("job_id").orderBy(page, "position").rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.last(F.when(label.contains("header") & F.col("text").rlike(r"(?i)^\s*chapter\s+\d+"), F.col("text")), ignorenulls=True).over(order)
    return items.withColumn("section_type", kind).withColumn("chapter", F.coalesce(chapter, F.lit("Chapter 1")))


def bounding_box(box: Column, width: Column, height: Column, bottom_left: bool = False) -> Column:
    """[x0, y0, x1, y1] from the top left, inside the page; zeros for anything but four numbers."""
    y = F.array(height - box[1], height - box[3]) if bottom_left else F.array(box[1], box[3])
    clamp = lambda v, most: F.round(F.greatest(F.lit(0.0), F.least(v, most)), 2)
    x0, x1 = F.least(box[0], box[2]), F.greatest(box[0], box[2])
    made = F.array(clamp(x0, width), clamp(F.array_min(y), height), clamp(x1, width), clamp(F.array_max(y), height))
    return F.when(F.size(box) == 4, made).otherwise(F.array(*[F.lit(0.0)] * 4))


def budget(system_tokens: Column, questions: Column, window: int = 8192, most_output: int = 2048) -> Column:
    """(output, context) tokens of a model's window: 220 for each question and 400 for the envelope, 5 % to spare."""
    output = F.least(F.lit(most_output), questions * 220 + 400)
    return F.struct(output.alias("output"), F.greatest(F.lit(200), F.lit(window - int(window * 0.05)) - system_tokens - output).alias("context"))


def excerpt(text: Column, tokens: Column, ratio: Column) -> Column:
    """A part of a text for a token budget, at a relative offset, cut at paragraphs and sentences where that keeps half."""
    size = (tokens * 4).cast("int")
    first = F.floor(F.greatest(F.lit(0), F.length(text) - size) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio))).cast("int")

    def begin(s: Column) -> Column:
        gap = F.locate("\n\n", F.substring(text, s + 1, F.lit(500)))
        return F.when((s > 0) & (gap > 0), s + gap + 1).otherwise(s)

    def tidy(part: Column) -> Column:
        rest = F.regexp_extract(part, r"(?s)(?:\. |\n\n|\.\n)(?!.*(?:\. |\n\n|\.\n))(.*)$", 1)
        last = F.length(part) - F.length(rest)
        return F.when((last > F.length(part) / 2) & (last < F.length(part)), F.trim(F.substring(part, F.lit(1), last))).otherwise(F.rtrim(part))

    part = let(let(first, begin), lambda s: F.substring(text, s + 1, size))
    return F.when(tokens_estimate(text) <= tokens, text).otherwise(let(part, tidy))


def plan_batches(tiers: DataFrame, most: int = 10) -> DataFrame:
    """(tier columns, batch, quantity): each tier in batches of ten questions at most. tiers: (..., count)."""
    parts = F.sequence(F.lit(0), F.ceil(F.col("count") / most).cast("int") - 1)
    return tiers.where("count > 0").select("*", F.explode(parts).alias("batch")).withColumn("quantity", F.least(F.lit(most), F.col("count") - F.col("batch") * most))


def chapter_context(items: DataFrame, key: str = "chapter_id") -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("position", "text")))
    return items.where("text <> ''").groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("context"))


#: Words that announce a passage that questions share (fixed values).
PASSAGE_WORDS = ("read", "case", "study", "passage", "following", "comprehension", "संदर्भ", "गद्यांश", "عبارت", "مطالعہ")


def shared_passages(questions: DataFrame, version: str = "version_id", position: str = "position") -> DataFrame:
    """`passage` and what is left of each question where consecutive questions of a version start with one passage.

    A passage is the first paragraph of a question, of 50 characters or more and with a word that announces it; it is
    shared if the next question begins with it too.
    """

    def opening(text: str) -> tuple[str, str] | None:
        """The paragraph that may be shared, and the rest of its own question."""
        head, mark, rest = text.partition("\n\n" if "\n\n" in text else "\n")
        head = head.strip()
        said = head.lower()
        return (head, rest.strip()) if mark and len(head) >= 50 and any(w in said for w in PASSAGE_WORDS) else None

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position).reset_index(drop=True)
        runs: list[list] = []  # opening of the first question, and the rows of the run
        for row, text in enumerate(pdf["question_text"]):
            if runs and runs[-1][0] and text.startswith(runs[-1][0][0]):
                runs[-1][1].append(row)
            else:
                runs.append([opening(text), [row]])
        texts, passage = pdf["question_text"].tolist(), [None] * len(pdf)
        for head, rows in runs:
            if len(rows) > 1:
                passage[rows[0]] = head[0]
                for row in rows:
                    rest = head[1] if row == rows[0] else texts[row][len(head[0]) :].strip().lstrip(":\n- ")
                    texts[row] = rest or texts[row]
        return pdf.assign(question_text=texts, passage=passage)

    return questions.groupBy(version).applyInPandas(part, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in questions.schema)}, passage string")


def difference_hash(pixels: Column) -> Column:
    """64 bits of a 9 x 8 grey image (72 values by rows): is each pixel brighter than the one to its right?"""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.element_at(pixels, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int")) > F.element_at(pixels, (F.floor(i / 8) * 9 + i % 8 + 2).cast("int")), F.lit("1")).otherwise("0"))
    return F.lpad(F.lower(F.conv(F.array_join(bits, ""), 2, 16)), 16, "0")


def near_hashes(images: DataFrame, group: str = "doc_id", hashed: str = "dhash", near: int = 4) -> DataFrame:
    """(group, a, b, distance) of the distinct hashes of a group, a < b, that differ in `near` bits or fewer.

    Hashes are 16 hexadecimal digits. They are cut into near + 1 bands of bits, one of which is equal in near hashes, so
    they meet by band and value; a pair is listed by the first band that it shares.
    """
    bits = F.lpad(F.conv(F.col(hashed), 16, 2), 64, "0")
    edges = [64 * k // (near + 1) for k in range(near + 2)]
    bands = F.array(*(F.substring("bits", a + 1, b - a) for a, b in zip(edges, edges[1:], strict=False)))
    one = images.where(F.col(hashed).isNotNull()).select(F.col(group).alias("group"), F.lower(hashed).alias("h"), bits.alias("bits")).distinct().withColumn("bands", bands)
    rows = one.select("group", "h", "bands", F.posexplode("bands").alias("band", "value"))
    left, right = (rows.select("group", "band", "value", F.col("h").alias(n), F.col("bands").alias(f"bands_{n}")) for n in "ab")
    met = left.join(right, ["group", "band", "value"]).where("a < b")
    first = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True) - 1
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    apart = sum((F.bit_count(half("a", at).bitwiseXOR(half("b", at))) for at in (1, 9)), F.lit(0))
    return met.where(first == F.col("band")).select("group", "a", "b", apart.alias("distance")).where(F.col("distance") <= near)


def first_pictures(images: DataFrame, doc: str = "doc_id", hashed: str = "dhash", near: int = 4) -> DataFrame:
    """`kept` for pictures whose hash is more than `near` bits from every kept picture before it in the document.

    images: (doc, position, hash); positions are distinct in a document. Equal hashes decide alike, so the first of them
    stands for all; a picture without a hash is kept. Null documents are one document.
    """
    rows = materialize(images.select(F.coalesce(F.col(doc).cast("string"), F.lit("\x00")).alias("g"), F.col("position").cast("long").alias("k"), F.lower(hashed).alias("h")), "pictures")
    firsts = materialize(rows.where("h is not null").groupBy("g", "h").agg(F.min("k").alias("k")), "hashes")
    pairs = near_hashes(firsts, "g", "h", near)
    one, two = (firsts.select(F.col("g").alias("group"), F.col("h").alias(n), F.struct(F.col("g").alias("w"), "k").alias(f"at_{n}")) for n in "ab")
    edges = pairs.join(one, ["group", "a"]).join(two, ["group", "b"]).select(F.greatest("at_a", "at_b").alias("later"), F.least("at_a", "at_b").alias("earlier"))
    kept = first_kept(firsts.select(F.struct(F.col("g").alias("w"), "k").alias("node")), edges)
    bare = rows.where("h is null").select("g", "k")
    found = kept.select(F.col("node.w").alias("g"), F.col("node.k").alias("k")).unionByName(bare).select(F.col("g").alias("_g"), F.col("k").alias("_k"), F.lit(True).alias("_kept"))
    keys = images.withColumn("_g", F.coalesce(F.col(doc).cast("string"), F.lit("\x00"))).withColumn("_k", F.col("position").cast("long"))
    return keys.join(found, ["_g", "_k"], "left").select(*images.columns, F.col("_kept").isNotNull().alias("kept"))


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """The keyed hash of a text as lower-case hex (RFC 2104), by two hashes over padded keys."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def fresh_signature(requests: DataFrame, secret: bytes, as_of: Column, past: int = 600, ahead: int = 60) -> DataFrame:
    """Requests whose time is near enough and whose body is signed; requests: (sent_at, body, signature)."""
    age = as_of.cast("double") - F.col("sent_at").cast("double")
    return requests.where(age.between(-ahead, past)).where(hmac_sha256(secret, F.col("body")) == F.col("signature"))


def attach_answers(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Snapshot items with their answers by question id, or else by position."""
    by_id = answers.select("attempt_id", "question_id", F.struct("response", "marks").alias("a"))
    by_place = answers.select("attempt_id", "position", F.struct("response", "marks").alias("b"))
    joined = items.join(by_id, ["attempt_id", "question_id"], "left").join(by_place, ["attempt_id", "position"], "left")
    return joined.select(*items.columns, F.coalesce("a", "b").alias("answer"))


def containing(names: DataFrame, parts: DataFrame, name: str, part: str) -> DataFrame:
    """(name, part): each short name with every part that it contains, by an equi-join on its substrings.

    Only substrings as long as some part are made; the lengths that occur are as few as the longest part has characters.
    An empty part is in no name.
    """
    parts = parts.select(part).where(F.length(part) > 0).distinct()
    sizes = sorted(r.n for r in parts.select(F.length(part).alias("n")).distinct().collect())
    if not sizes:
        return names.select(name, F.lit(None).cast("string").alias(part)).limit(0)
    size = F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length(name))).alias("_n")
    pieces = names.select(name).distinct().select(name, size)
    pieces = pieces.select(name, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - F.col("_n") + 1), lambda i: F.substring(F.col(name), i, F.col("_n"))))).alias(part))
    return pieces.join(parts, part).select(name, part)


def titled_items(jobs: DataFrame, chapters: DataFrame) -> DataFrame:
    """(job_id, chapter_id): jobs with the chapters whose title is part of theirs, whatever its case."""
    j = jobs.select("job_id", F.lower("title").alias("_job"))
    c = chapters.select("chapter_id", F.lower("title").alias("_chapter"))
    return containing(j, c, "_job", "_chapter").join(j, "_job").join(c, "_chapter").select("job_id", "chapter_id")


def subject_pool(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """(subject, pool_subject): the pool's subject of the same name, or the first one that holds or is part of it."""
    names = pool.groupBy(F.lower(F.trim("subject")).alias("pool_subject")).agg(F.min("position").alias("first"))
    asked = wanted.select("subject", F.lower(F.trim("subject")).alias("_w")).distinct()
    pairs = containing(asked, names, "_w", "pool_subject").unionByName(containing(names, asked, "pool_subject", "_w")).distinct().join(names, "pool_subject")
    best = pairs.groupBy("_w").agg(F.min_by("pool_subject", F.struct((F.col("_w") != F.col("pool_subject")).alias("other"), "first")).alias("pool_subject"))
    return asked.join(best, "_w", "left").select("subject", "pool_subject")


def role_label(role: Column, capabilities: Column, school: Column) -> Column:
    """The name of a role, or what a user's capabilities amount to."""
    # fixed values: codes and their names
    names = {"super_admin": "Super Admin", "school_admin": "School Admin", "teacher": "Teacher", "student": "Student", "qbm": "Question Bank Manager", "deo": "Data Entry Operator", "DEO": "Data Entry Operator", "validator": "Validator", "deo_validator": "DEO & Validator"}
    named = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), role), role)
    has = lambda c: F.coalesce(F.array_contains(capabilities, c), F.lit(False))
    member = school.isNotNull()
    return (
        F.when(F.coalesce(role, F.lit("")) != "", named).when(has("CREATE_SCHOOL"), "Super Admin").when(has("INGEST_GLOBAL_QUESTIONS"), "Question Bank Manager")
        .when(has("DATA_ENTRY_OPERATOR") & has("VALIDATOR"), "DEO & Validator").when(has("VALIDATOR"), "Validator").when(has("DATA_ENTRY_OPERATOR"), "Data Entry Operator")
        .when(has("VIEW_SCHOOL_WIDE_CONTROLS") & member, "School Admin").when(has("CREATE_STUDENT") & member, "Teacher").when(has("ATTEMPT_TEST"), "Student").otherwise("Custom")
    )
