"""Pages from their spans and pictures: features, routes, evidence of a document's kind, and newspaper articles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import dominant_script, let, scripts
from quillspark.operators.documents import classify, sampled_pages

# fixed values: parts of the names of 8-bit Hindi fonts and of typesetting fonts, words and signs that text in such a font
# shows, and words of a handwritten page
LEGACY_FONTS = "kruti devlys chanakya walkman shree-dev shreedev shivaji bilingual aps- aps_ akruti kundli dv- dv_".split()
TYPESET_FONTS = "poynter nimrod griffith caslon times arial helvetica georgia garamond myriad minion franklin frutiger".split()
LEGACY_WORDS = "izse osq fkka gsa muhksaus if=kdk bznxkg x|&[kam f=k vksj gksrk rkfd".split()
LEGACY_SIGNS = r"\|&\[|f=k|x\|"
HAND_WORDS = "dear wifey|love from|hubby|homework|student notes|handwritten|rough work|my solution"
#: Letters, digits and "_" of any script, as they end words.
_WORD = r"[\p{L}\p{N}_]"
#: Where a word begins or ends.
_BORDER = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _whole(words: str) -> str:
    return rf"(?<!{_WORD})(?:{words})(?!{_WORD})"


def page_features(pages: DataFrame) -> DataFrame:
    """Pages with what a route is chosen by: chars, scripts, script, legacy, fonts_seen, pictures_seen, picture_share,
    strokes_seen, low_strokes, broadsheet, typeset, hand_words.

    pages: (page_number, width, height, text, fonts, pictures, strokes, ...): names of fonts, boxes (x0, y0, x1, y1) of
    pictures, and the upper edges of drawn paths. Null text, fonts, pictures and strokes count as empty. picture_share adds
    up the boxes, 1 at most. Strokes are looked at on a first page that is large and has little text, as nowhere else.
    """
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    fonts = F.transform(F.coalesce("fonts", none), lambda f: F.lower(F.coalesce(f, F.lit(""))))
    has = lambda parts: F.exists(fonts, lambda f: f.rlike("|".join(map(re.escape, parts))))
    bare = F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))
    low = F.lower(text)
    # a plain search for the word goes before that for its borders
    shown = sum(((low.contains(w) & low.rlike(_whole(re.escape(w)))).cast("int") for w in LEGACY_WORDS), F.lit(0))
    boxes = F.coalesce("pictures", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    side = lambda a, b: F.greatest(F.lit(0.0), b - a)
    area = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + F.coalesce(side(b["x0"], b["x1"]) * side(b["y0"], b["y1"]), F.lit(0.0)))
    rows = pages.withColumn("chars", bare).withColumn("scripts", scripts(text))
    looked = (F.col("page_number") == 1) & (F.col("chars") < 700) & (F.col("height") > 1000)
    strokes = F.coalesce("strokes", F.array().cast("array<double>"))
    in_font = (F.col("scripts.devanagari") == 0) & (F.col("chars") > 40) & ((shown >= 2) | (F.regexp_count(text, F.lit(LEGACY_SIGNS)) >= 2))
    return rows.withColumns(
        {
            "script": F.when((dominant_script(F.col("scripts")) == "none") & (F.col("chars") > 0), "mixed").otherwise(dominant_script(F.col("scripts"))),
            "legacy": has(LEGACY_FONTS) | in_font,
            "fonts_seen": F.size(fonts),
            "pictures_seen": F.size(boxes),
            "picture_share": F.least(F.lit(1.0), area / F.greatest(F.lit(1.0), F.col("width") * F.col("height"))),
            "strokes_seen": F.when(looked, F.size(strokes)).otherwise(0),
            "low_strokes": F.when(looked, F.size(F.filter(strokes, lambda y: y > F.col("height") * 0.1))).otherwise(0),
            "broadsheet": (F.col("width") > 700) & (F.col("height") > 1000),
            "typeset": has(TYPESET_FONTS),
            "hand_words": low.rlike(_whole(HAND_WORDS)),
        }
    )


def route_pages(features: DataFrame, vision: bool = False, layout_model: bool = True) -> DataFrame:
    """Pages with `page_kind`, `engine`, `reason`, `detected_script`, `ocr_language`, `needs_review`, `quality`.

    features: what `page_features` gives. The first route that fits is taken: handwriting, blank, a full-page picture, an
    8-bit font, a scan, a drawn page without text, and clean text. vision: whether a model that reads handwriting is there.
    """
    c = F.col
    hand = (c("broadsheet") & (c("page_number") == 1) & (c("chars") < 50) & (c("low_strokes") > 200) & ~c("typeset")) | ((c("chars") < 100) & (c("low_strokes") > 150) & c("hand_words"))
    blank = (c("chars") < 15) & (c("pictures_seen") == 0) & (c("strokes_seen") < 5)
    spread = (c("broadsheet") & ((c("strokes_seen") >= 15) | (c("picture_share") > 0.85))) | ((c("strokes_seen") >= 15) & (c("pictures_seen") > 1)) | (c("broadsheet") & (c("fonts_seen") > 0) & (c("picture_share") > 0.5))
    advert = (c("chars") < 60) & ((c("pictures_seen") >= 1) | (c("strokes_seen") >= 10)) & spread
    bare = (c("chars") < 80) & ((c("picture_share") > 0.4) | (c("fonts_seen") == 0))
    drawn = bare & c("broadsheet") & (c("chars") == 0) & ((c("strokes_seen") > 50) | (c("pictures_seen") > 20))
    mix = c("scripts")
    by_hand = F.when(mix["latin"] > 0.3, "latin").when(mix["devanagari"] > 0.3, "devanagari").otherwise("mixed")
    tongue = F.when((c("script") == "gujarati") | (mix["gujarati"] > 0.2), "guj").when((c("script") == "devanagari") | (mix["devanagari"] > 0.2), "hin").otherwise("eng")
    nothing = F.lit(None).cast("string")
    picture = ("image_only", "Image/Ad Classifier", "one picture or drawing fills the page", F.lit("none"), nothing, False, 1.0)
    routes = [
        (hand, ("handwriting", "Gemini Flash AI (Handwriting)" if vision else "Fallback (Review Required)", "written by hand", by_hand, F.lit("eng"), not vision, 0.9 if vision else 0.4)),
        (blank, ("blank", "Blank Page Detector", "neither text nor pictures", F.lit("none"), nothing, False, 1.0)),
        (advert, picture),
        (c("legacy"), ("digital_text", "Legacy Remap / Tesseract OCR (-l hin)", "text in an 8-bit font", F.lit("devanagari"), F.lit("hin"), False, 0.88)),
        (drawn, picture),
        (bare, ("scanned_printed", F.concat(F.lit("Google Tesseract OCR (-l "), tongue, F.lit(")")), "a scan with hardly any text", c("script"), tongue, False, 0.88)),
        (F.lit(True), ("digital_text", "Docling AI (DocLayNet)" if layout_model else "TextbookPipeline (Rule-Based Fallback)", "a clean text layer", c("script"), nothing, False, 0.98)),
    ]
    names = ("page_kind", "engine", "reason", "detected_script", "ocr_language", "needs_review", "quality")
    as_struct = lambda values: F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(n) for v, n in zip(values, names, strict=True)))
    taken = None
    for test, values in routes:
        taken = F.when(test, as_struct(values)) if taken is None else taken.when(test, as_struct(values))
    read_by_font = (c("page_kind") == "digital_text") & (c("reason") == "text in an 8-bit font")
    return features.withColumn("_route", taken).select(*(x for x in features.columns if x not in names), "_route.*").withColumn("legacy", read_by_font)


# --- evidence of a document's kind ----------------------------------------------------------------------------------

# fixed values: names of newspapers, what their first pages say, and words that newspapers, examinations, textbooks,
# chapters and lessons hold, in English, Hindi and Gujarati
MASTHEADS = (
    "times of india", "hindustan times", "the hindu", "indian express", "dainik jagran", "divya bhaskar", "dainik bhaskar", "amar ujala", "navbharat times", "the telegraph", "deccan herald", "the tribune",
    "economic times", "financial express", "lokmat", "mint", "business standard", "the statesman", "deccan chronicle", "pioneer", "new indian express",
)
BRANDS = ("largest english newspaper", "epaper", "city edition", "late city")
PUBLISHERS = ("newsgate", "woodwing", "quarkxpress", "panchayat")
NEWSPAPER_WORDS = (
    "epaper", "city edition", "late city", "vol.", "volume", "invitation price", "rni no", "regd no", "air surcharge", "bureau", "correspondent", "times nation", "times city", "editorial page", "op-ed",
    "sports desk", "pti", "ians", "reuters", "ani", "classifieds",
)
EXAM_WORDS = (
    "time allowed", "maximum marks", "max marks", "general instructions", "question paper", "all questions are compulsory", "sample question paper", "marking scheme", "section a", "section b", "section c", "roll no",
    "પ્રશ્નપત્ર", "કુલ ગુણ", "સમય :", "સામાન્ય સૂચનાઓ", "प्रश्न-पत्र", "अधिकतम अंक", "कुल अंक", "सामान्य निर्देश", "अनुक्रमांक",
)
BOOK_WORDS = (
    "table of contents", "contents", "national council of educational research", "ncert", "cbse", "textbook for class", "prescribed by", "foreword", "preface", "rationalised", "isbn", "all rights reserved",
    "reprint 202", "reprint 20", "rationalised 20", "not to be republished", "राष्ट्रीय शैक्षिक अनुसंधान और प्रशिक्षण परिषद्", "एनसीईआरटी", "सीबीएसई", "पाठ्यपुस्तक", "कक्षा", "पुनर्मुद्रण", "प्रस्तावना", "आमुख", "विषय-सूची",
    "ગુજરાત રાજ્ય શાળા પાઠ્યપુસ્તક મંડળ", "જીએસઈબી", "ધોરણ", "પ્રસ્તાવના", "અનુક્રમણિકા",
)
CHAPTER_WORDS = ("chapter", "unit", "lesson", "theme", "module", "section", "अध्याय", "पाठ", "इकाई", "प्रकरण", "खंड", "गद्य-खंड", "काव्य-खंड", "विषय", "पाठः", "अध्यायः", "પ્રકરણ", "પાઠ", "એકમ", "વિભાગ")
LESSON_WORDS = (
    "exercise", "solved example", "activity", "summary", "questions", "formula", "theorem", "lemma", "key terms", "points to remember", "अभ्यास", "प्रश्नावली", "प्रश्नोत्तरी", "प्रश्न", "उत्तर", "गतिविधि", "उदाहरण", "सारंश",
    "महत्वपूर्ण बिंदु", "हल सहित उदाहरण", "સ્વાધ્યાય", "પ્રશ્નોત્તરી", "પ્રશ્નો", "ઉદાહરણ", "પ્રવૃત્તિ", "સારાંશ", "મુદ્દાઓ",
)
DATELINE = r"(?i)(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)[,\s]+[a-z]+\s+\d{1,2}(?:,\s*\d{4})?"
VOLUME = rf"(?i)(?<!{_WORD})(?:vol\.?|volume|issue|no\.)\s*\d+"
RUNNING = (rf"(?m)^\s*([^\n/]{{2,30}})\s*/\s*(\d{{1,3}}){_BORDER}", rf"(?m)^\s*(\d{{1,3}})\s*/\s*([^\n/]{{2,30}}){_BORDER}")
CHAPTER_FILE = r"(?i)^[a-z]{2,5}\d{1,2}(?:0[1-9]|[1-9]\d)\.pdf$"
#: How many times the middle size the largest letters of a first page are where a chapter opens, and their least size.
OPENER, OPENER_SIZE = 1.6, 16.0


def _chapter_line() -> str:
    return rf"(?im)^\s*(?:{'|'.join(map(re.escape, CHAPTER_WORDS))})\s*(?:\d+|[ivxlcdm]+|[०-९]+|[૦-૯]+)?{_BORDER}"


def document_evidence(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """What `classify` asks for, counted over the pages that stand for each document.

    pages: (<doc>, page_number, total_pages, width, height, text, fonts, pictures, sizes, ...): the sizes of the letters of
    each span; and, if there, outline (entries of the first level), title, file_name, made_by and stated_kind, which hold
    for the document. A word counts once for each page that has it. Null texts and lists count as empty.
    """
    c, text = F.col, F.coalesce("text", F.lit(""))
    rows = sampled_pages(pages).withColumn("_low", F.lower(text))
    held = lambda words, where="_low": F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c(where), w)))
    count = lambda x: F.sum(x.cast("long"))
    once = lambda test: F.max(F.coalesce(test, F.lit(False)))
    many = lambda name, kind: F.size(F.coalesce(name, F.array().cast(kind)))
    first = c("page_number") == 1
    sizes = F.array_sort(F.filter(F.coalesce("sizes", F.array().cast("array<double>")), lambda s: s.isNotNull()))
    largest, middle = F.get(sizes, F.size(sizes) - 1), F.get(sizes, F.floor(F.size(sizes) / 2).cast("int"))
    named = lambda name: F.lower(F.coalesce(F.max(name), F.lit(""))) if name in pages.columns else F.lit("")
    large = ((c("width") >= 700) & (c("height") >= 950)) | ((c("width") >= 900) & (c("height") >= 1400))
    out = rows.groupBy(doc).agg(
        F.max("total_pages").alias("total_pages"), once(large).alias("broadsheet"), once(text.rlike(DATELINE)).alias("dateline"), once(text.rlike(VOLUME)).alias("volume_stamp"),
        once(first & (largest >= OPENER * middle) & (largest >= OPENER_SIZE)).alias("opener"), once(text.rlike(RUNNING[0]) | text.rlike(RUNNING[1])).alias("running_headers"),
        count(held(NEWSPAPER_WORDS)).alias("newspaper_words"), count(held(EXAM_WORDS)).alias("exam_words"), count(held(BOOK_WORDS)).alias("book_words"), count(text.rlike(_chapter_line())).alias("chapter_words"), count(held(LESSON_WORDS)).alias("pedagogy_words"),
        once(first & (held(MASTHEADS) > 0)).alias("masthead"), once(first & (held(BRANDS) > 0)).alias("brand"),
        F.sum(F.length(text)).alias("_chars"), F.count("*").alias("_sampled"), F.sum(many("pictures", "array<struct<x0:double,y0:double,x1:double,y1:double>>")).alias("_pictures"), F.sum(many("fonts", "array<string>")).alias("_fonts"),
        (F.max("outline") if "outline" in pages.columns else F.lit(0)).alias("_outline"), named("title").alias("_title"), named("file_name").alias("_file"), named("made_by").alias("_maker"),
        (F.max("stated_kind") if "stated_kind" in pages.columns else F.lit(None).cast("string")).alias("stated_kind"),
    )
    out = out.withColumn("_name", F.concat_ws(" ", "_file", "_title"))
    out = out.withColumns(
        {
            "multi_toc": F.coalesce(c("_outline") >= 2, F.lit(False)),
            "scanned": (c("_chars") / c("_sampled") < 100) & (c("_pictures") >= c("_sampled")) & (c("_fonts") == 0),
            "named_masthead": held(MASTHEADS, "_name") > 0,
            "chapter_file": c("_file").rlike(CHAPTER_FILE),
            "publisher": held(PUBLISHERS, "_maker") > 0,
        }
    )
    return out.drop("_chars", "_sampled", "_pictures", "_fonts", "_outline", "_title", "_file", "_maker", "_name")


def document_kinds(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(<doc>, kind, confidence, evidence) of each document, from its pages (see `document_evidence`)."""
    return classify(document_evidence(pages, doc)).select(doc, "kind", "confidence", "evidence")


# --- newspaper articles -----------------------------------------------------------------------------------------------

# fixed values: notices that an article goes on elsewhere, and lines that name an author
GOES_ON = (r"(?i)(?:continued|contd|cont'?d|see)\s+(?:on\s+)?page\s+(\d+)", r"(?i)turn\s+to\s+page\s+(\d+)", r"(?i)p(?:age)?\s*(\d+)\s*(?:,\s*col|\s*$)")
BYLINES = (
    r"(?i)^((?:by\s+)(?:[A-Z][a-zA-Z\s\.]+))",
    r"(?i)^([A-Z][a-zA-Z\s]+(?:Krishnan|Sharma|Verma|Gupta|Singh|Choudhury|Times News Network|TNN|PTI|IANS|Reuters|AFP))",
    r"(?i)^([A-Z\s]{3,30}\s*\|\s*(?:NEW DELHI|MUMBAI|DELHI|BENGALURU|CHENNAI|KOLKATA))",
)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0))


def articles(sections: DataFrame, page: list[str]) -> DataFrame:
    """(page ..., article, article_id, headline, byline, body, column_index, continues_on_page, sections, box) of newspaper
    pages.

    sections: (page ..., reading, section_type, heading, text, column_index, bbox), read in the order of `reading`, ties by
    heading and text; the last of `page` is the page number. bbox: an array of four numbers, or null. A headline, or an
    author's line, that follows a headline and some text begins the next article. An article without a headline is named
    by the first 60 characters of its text. sections are the places, from 0, of the sections that make it up. DIAGRAM
    sections are left out. article_id depends on the page number and the headline alone.
    """
    order = F.struct("reading", "heading", "text", "section_type", "column_index", "bbox")
    whole = sections.groupBy(*page).agg(F.array_sort(F.collect_list(order)).alias("s"))
    opened = whole.select(*page, F.posexplode("s").alias("place", "s")).where("coalesce(s.section_type, '') <> 'DIAGRAM'")
    rows = opened.select(*page, "place", "s.column_index", "s.bbox", _stripped(F.col("s.heading")).alias("heading"), _stripped(F.col("s.text")).alias("text"))

    found = lambda pattern: F.coalesce(*(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")) for x in ("text", "heading")))
    notice = F.coalesce(*(found(p) for p in reversed(GOES_ON))).try_cast("int")
    byline = F.coalesce(*(F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in BYLINES))
    text = F.col("text")
    shouted = (text == F.upper(text)) & (text != F.lower(text))
    short = F.length(text).between(5, 139) & (shouted | (_words(text) <= 10)) & ~text.rlike(r"[.:;]$") & ~text.rlike("|".join(GOES_ON))
    titled = F.when(_words(F.col("heading")) >= 2, "always").when(short & shouted, "always").when(short, "first")
    rows = rows.withColumn("_on", notice).withColumn("_by", byline).withColumn("_titled", titled)

    # the walk over a page: which article a section belongs to, and as what
    start = F.struct(F.lit(0).alias("article"), F.lit(False).alias("titled"), F.lit(False).alias("named"), F.lit(False).alias("told"), F.array().cast("array<struct<article:int,role:string,ends:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        title = (x["_titled"] == "always") | ((x["_titled"] == "first") & ~acc["titled"])
        title, by = F.coalesce(title, F.lit(False)), x["_by"].isNotNull()
        flush = (title | by) & acc["titled"] & acc["told"]

        def go(f: Column) -> Column:
            before = {n: acc[n] & ~f for n in ("titled", "named", "told")}
            article = acc["article"] + f.cast("int")
            role = F.when(title & ~before["titled"], "headline").when(by & ~before["named"], "byline").when(F.length(x["text"]) > 0, "body").otherwise("none")
            more = (role == "body") | ((role == "headline") & (F.length(x["heading"]) > 0) & (F.length(x["text"]) > 0) & (x["text"] != x["heading"])) | ((role == "byline") & (F.length(x["_rest"]) > 0))
            mark = F.struct(article.cast("int").alias("article"), role.alias("role"), acc["article"].cast("int").alias("ends"))
            return F.struct(article.alias("article"), (before["titled"] | (role == "headline")).alias("titled"), (before["named"] | (role == "byline")).alias("named"), (before["told"] | more).alias("told"), F.concat(acc["out"], F.array(mark)).alias("out"))

        return let(flush, go)

    rest = F.regexp_replace(F.substring(text, F.length("_by") + 1, F.length(text)), r"^[ \-|,\n]+|[ \-|,\n]+$", "")
    rows = rows.withColumn("_by", _stripped(F.col("_by"))).withColumn("_by", F.nullif("_by", F.lit(""))).withColumn("_rest", F.coalesce(rest, F.lit("")))
    item = F.struct("place", "heading", "text", "_by", "_rest", "_titled", "_on", "column_index", "bbox")
    walked = rows.groupBy(*page).agg(F.array_sort(F.collect_list(item)).alias("x")).withColumn("m", F.aggregate("x", start, step)["out"])
    parts = walked.select(*page, F.explode(F.arrays_zip("x", "m")).alias("z")).select(*page, "z.x.*", "z.m.*")

    # a notice holds for the article that was open when it was read; if its section begins the next one, a row of its own
    # takes it there, so that nothing is joined
    apart = F.col("_on").isNotNull() & (F.col("ends") != F.col("article"))
    parts = parts.withColumn("_apart", apart).withColumn("_sent", F.explode(F.when(F.col("_apart"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    parts = parts.withColumns({"article": F.when(F.col("_sent"), F.col("ends")).otherwise(F.col("article")), "role": F.when(F.col("_sent"), "none").otherwise(F.col("role")), "_on": F.when(~F.col("_apart") | F.col("_sent"), F.col("_on"))})
    told = F.when(F.col("role") == "body", F.col("text")).when((F.col("role") == "headline") & (F.length("heading") > 0) & (F.length("text") > 0) & (F.col("text") != F.col("heading")), F.col("text")).when((F.col("role") == "byline") & (F.length("_rest") > 0), F.col("_rest"))
    of = lambda value, when: F.min_by(F.when(when, value), F.when(when, F.col("place")))
    corner = lambda k, f: f(F.when(F.col("role") != "none", F.get("bbox", F.lit(k))))
    made = parts.groupBy(*page, "article").agg(
        of(F.when(F.length("heading") > 0, F.col("heading")).otherwise(F.col("text")), F.col("role") == "headline").alias("title"), of(F.col("_by"), F.col("role") == "byline").alias("byline"),
        F.transform(F.array_sort(F.collect_list(F.when(told.isNotNull(), F.struct("place", told.alias("t"))))), lambda x: x["t"]).alias("told"),
        of(F.col("column_index"), F.col("role") == "headline").alias("column_index"), F.array_sort(F.collect_list(F.when(F.col("role") != "none", F.col("place")))).alias("sections"),
        corner(0, F.min).alias("x0"), corner(1, F.min).alias("y0"), corner(2, F.max).alias("x1"), corner(3, F.max).alias("y1"),
        F.max_by("_on", F.when(F.col("_on").isNotNull(), F.col("place"))).alias("continues_on_page"),
    )
    made = made.where("title is not null or size(told) > 0")
    body = _stripped(F.array_join("told", "\n\n"))
    named = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.substring(F.col("body"), 1, 60), F.lit("...")))
    made = made.withColumn("body", body).withColumn("headline", F.coalesce(named, F.concat(F.substring(F.col("body"), 1, 60), F.lit("..."))))
    number = F.col(page[-1]).cast("string")
    key = F.substring(F.sha2(F.concat(F.lit("p"), number, F.lit("_"), "headline").cast("binary"), 256), 1, 8)
    place = F.row_number().over(Window.partitionBy(*page).orderBy("article"))
    box = F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1"))
    column = F.coalesce("column_index", F.last("column_index", ignorenulls=True).over(Window.partitionBy(*page).orderBy("article").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    return made.select(*page, place.alias("article"), F.concat(F.lit("art_p"), number, F.lit("_"), key).alias("article_id"), "headline", F.coalesce("byline", F.lit("")).alias("byline"), "body", column.alias("column_index"), "continues_on_page", "sections", box.alias("box"))
