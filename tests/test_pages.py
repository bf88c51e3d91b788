"""Page features, routes, evidence and articles as literal cases."""

import random

from quillspark.operators import pages

PAGE = "name string, page_number int, width double, height double, text string, fonts array<string>, pictures array<struct<x0:double,y0:double,x1:double,y1:double>>, strokes array<double>"
A4, SHEET = (595.0, 842.0), (820.0, 1160.0)
PROSE = "The benchmark index rose sharply following strong corporate earnings in the second quarter of the year."
LEGACY = "izsepan dk tUe lu~ 1880 esa fkka osq ikl gqvk gsa vksj muhksaus fy[kk fd ;g gksrk gS"


def route(spark, rows, **options):
    made = spark.createDataFrame([(n, p, *size, text, fonts, boxes, strokes) for n, p, size, text, fonts, boxes, strokes in rows], PAGE)
    return {r.name: r for r in pages.route_pages(pages.page_features(made), **options).collect()}


def test_routes(spark):
    whole = [(0.0, 0.0, 820.0, 1160.0)]
    rows = [
        ("masthead", 1, SHEET, "BENNETT, COLEMAN & CO. " * 25, ["PoynterAgateOne", "RupeeET"], [(0.0, 0.0, 600.0, 100.0)] * 4, [300.0] * 489),
        ("advert", 2, SHEET, "Diamonds", ["Caslon"], whole, None),
        ("legacy by name", 3, A4, PROSE, ["ABCDEF+Walkman-Chanakya905"], None, None),
        ("legacy by text", 3, A4, LEGACY, ["F1"], None, None),
        ("scan", 1, A4, "", [], [(50.0, 50.0, 545.0, 792.0)], None),
        ("gujarati scan", 4, A4, "ગુજરાતી પાઠ", [], [(0.0, 0.0, 595.0, 842.0)], None),
        ("letter", 1, SHEET, "dear", ["Hand"], None, [400.0] * 250),
        ("set letter", 1, SHEET, "dear", ["Times"], None, [400.0] * 250),
        ("note", 1, (500.0, 1200.0), "My homework", [], None, [500.0] * 160),
        ("blank", 7, A4, " \n ", ["F1"], None, None),
        ("null", 7, A4, None, None, None, None),
        ("drawn", 1, SHEET, "", ["Times"], [(0.0, 0.0, 10.0, 10.0)] * 30, None),
        ("bare drawn", 2, SHEET, "", [], [(0.0, 0.0, 1.0, 1.0)] * 21, None),
        ("prose", 9, A4, PROSE, ["F1"], None, None),
        ("hindi", 9, A4, "यह एक पाठ है और इसमें बहुत सारे शब्द हैं जो साफ़ लिखे गए हैं और पढ़े जा सकते हैं। " * 2, ["F1"], None, None),
        ("digits", 9, A4, "1 2 3 4 5 6 7 8 9 " * 9, ["F1"], None, None),
        ("overlapping", 2, SHEET, "x", ["F"], [(0.0, 0.0, 820.0, 1160.0)] * 3, None),
    ]
    got = route(spark, rows)
    kinds = {n: r.page_kind for n, r in got.items()}
    assert kinds == {
        "masthead": "digital_text", "advert": "image_only", "legacy by name": "digital_text", "legacy by text": "digital_text", "scan": "scanned_printed", "gujarati scan": "scanned_printed", "letter": "handwriting", "set letter": "image_only",
        "note": "handwriting", "blank": "blank", "null": "blank", "drawn": "digital_text", "bare drawn": "image_only", "prose": "digital_text", "hindi": "digital_text", "digits": "digital_text", "overlapping": "image_only",
    }
    assert got["masthead"].chars > 100 and got["masthead"].typeset and not got["masthead"].needs_review
    assert [(got[n].legacy, got[n].ocr_language, got[n].detected_script, got[n].quality) for n in ("legacy by name", "legacy by text")] == [(True, "hin", "devanagari", 0.88)] * 2
    assert (got["gujarati scan"].ocr_language, got["gujarati scan"].engine) == ("guj", "Google Tesseract OCR (-l guj)") and got["scan"].ocr_language == "eng"
    assert got["letter"].needs_review and got["letter"].quality == 0.4 and got["overlapping"].picture_share == 1
    assert [got[n].detected_script for n in ("prose", "hindi", "digits", "blank")] == ["latin", "devanagari", "mixed", "none"]
    seen = route(spark, rows, vision=True, layout_model=False)
    assert not seen["letter"].needs_review and seen["letter"].quality == 0.9 and seen["prose"].engine.startswith("TextbookPipeline")


DOC = "doc_id long, page_number int, total_pages int, width double, height double, text string, fonts array<string>, pictures array<struct<x0:double,y0:double,x1:double,y1:double>>, sizes array<double>, outline int, title string, file_name string, made_by string, stated_kind string"


def doc(i, texts, size=A4, fonts=("F",), pictures=None, sizes=None, outline=0, title=None, file=None, maker=None, stated=None):
    return [(i, p, len(texts), *size, t, list(fonts), pictures, sizes if p == 1 else None, outline, title, file, maker, stated) for p, t in enumerate(texts, 1)]


def test_kinds_from_pages(spark):
    paper = ["The Hindu\nlate city edition, Monday, March 4, 2024\nVol. 12 PTI bureau", *["Correspondent of Reuters\n" + PROSE] * 11]
    chapter = ["Chapter 4\nMotion and Rest\nExercise: solved example of the theorem", *["20 / Motion\nactivity and summary " + PROSE] * 9]
    book = ["Table of contents\nforeword NCERT isbn", *["Author / 12\nexercise, questions"] * 70]
    exam = ["Maximum marks 80. Time allowed 3 hours.\nGeneral instructions: all questions are compulsory. Section A", "Section B"]
    rows = [
        *doc(1, paper, SHEET), *doc(2, chapter, sizes=[10.0, 10.0, 18.0]), *doc(3, book, outline=9), *doc(4, exam), *doc(5, ["", "", ""], fonts=(), pictures=[(0.0, 0.0, 5.0, 5.0)]),
        *doc(6, ["Project status meeting minutes. We discussed quarterly goals and team allocations."]), *doc(7, exam, stated=" notes "), *doc(8, exam, stated="auto"), *doc(9, [None, None]), *doc(10, [PROSE] * 8, file="khat101.pdf", title="The Hindu weekly", maker="QuarkXPress 9"),
    ]
    frame = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in pages.document_kinds(frame).collect()}
    assert {i: r.kind for i, r in got.items()} == {1: "NEWSPAPER", 2: "SINGLE_CHAPTER", 3: "FULL_BOOK", 4: "WORKSHEET_OR_EXAM", 5: "NOTES", 6: "UNKNOWN", 7: "NOTES", 8: "WORKSHEET_OR_EXAM", 9: "UNKNOWN", 10: "UNKNOWN"}
    assert all(0.75 <= got[i].confidence <= 0.96 for i in (1, 2, 3, 4)) and got[6].confidence == 0.2 and got[6].evidence == ["insufficient"]
    assert got[7].confidence == 1 and got[7].evidence == ["stated"] and {"masthead", "brand", "broadsheet", "dateline", "volume_stamp", "newspaper_words"} <= set(got[1].evidence)
    assert {"opener", "running_headers", "chapter_words", "lesson_words", "length_of_a_chapter"} <= set(got[2].evidence)
    counts = {r.doc_id: r for r in pages.document_evidence(frame).collect()}
    # the first five pages, the middle one and the last one count
    assert counts[1].newspaper_words == 5 + 6 * 2 and counts[2].chapter_words == 1 and counts[2].running_headers and counts[3].multi_toc
    assert counts[10].chapter_file and counts[10].named_masthead and counts[10].publisher and counts[5].scanned and not counts[9].scanned


SECTIONS = "doc string, page int, reading int, section_type string, heading string, text string, column_index int, bbox array<double>"


def test_articles(spark):
    said = [
        ("SENSEX SURGES 500 POINTS", "", 1, [10.0, 10.0, 100.0, 20.0]), ("", "By Ramesh Sharma", 1, None), ("", "Mumbai: The benchmark index rose sharply following strong corporate earnings.", 1, [8.0, 20.0, 90.0, 60.0]),
        ("", "Foreign institutional investors remained net buyers. Continued on page 14", 1, None), ("TECH GIANTS ANNOUNCE PARTNERSHIP", "", 2, None), ("", "New Delhi: Two major technology firms announced a multi-year cloud collaboration today.", 2, None),
    ]
    rows = [("a", 1, k, "PARAGRAPH", h, t, c, b) for k, (h, t, c, b) in enumerate(said)]
    rows += [("a", 1, 2, "DIAGRAM", "NOT A HEADLINE HERE", "", 1, [0.0, 0.0, 999.0, 999.0])]
    # text without a headline, a headline of its own line, an author's line that begins an article, text behind a name
    more = ["no headline stands above this text, which goes on for long enough to be cut behind its sixtieth character.", "A SHORT SHOUT", "body of it", "By Asha Verma | and her text", "not a headline, since one is open", "ANOTHER SHOUT"]
    rows += [("b", 3, k, "PARAGRAPH", None, t, k, None) for k, t in enumerate(more)]
    rows += [("c", 5, 0, "PARAGRAPH", None, "  ", 1, None), ("c", 6, 0, "PARAGRAPH", "One", None, 1, None)]
    made = []
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        made.append(sorted(map(tuple, pages.articles(spark.createDataFrame(rows, SECTIONS), ["doc", "page"]).collect())))
    assert made[0] == made[1]  # whatever the order of rows
    got = {(r[0], r[1], r[2]): r for r in made[0]}
    fields = {k: r[4:] for k, r in got.items()}
    assert fields["a", 1, 1] == ("SENSEX SURGES 500 POINTS", "By Ramesh Sharma", f"{said[2][1]}\n\n{said[3][1]}", 1, 14, [0, 1, 2, 4], [8.0, 10.0, 100.0, 60.0])
    assert fields["a", 1, 2] == ("TECH GIANTS ANNOUNCE PARTNERSHIP", "", said[5][1], 2, None, [5, 6], None)
    assert [fields["b", 3, k][:5] for k in (1, 2, 3)] == [("A SHORT SHOUT", "", f"{more[0]}\n\nbody of it", 1, None), (more[4], "By Asha Verma", "and her text", 4, None), (more[5], "", "", 5, None)]
    bare = spark.createDataFrame([("d", 2, 0, "PARAGRAPH", "", more[0], 1, None)], SECTIONS)
    assert [tuple(r)[4:7] for r in pages.articles(bare, ["doc", "page"]).collect()] == [(more[0][:60] + "...", "", more[0])]
    assert all(r[3].startswith(f"art_p{k[1]}_") and len(r[3]) == 15 for k, r in got.items())
    assert ("c", 5, 1) not in got and ("c", 6, 1) not in got


def test_articles_move_their_texts_once(spark):
    columns = "doc_id long, reading int, section_type string, heading string, text string, column_index int, bbox array<double>"
    said = ["ONE HEADLINE HERE", "Some text of it. See page 4", "ANOTHER HEADLINE", "More text, continued on page 7.", "By Asha Sharma", "The end."]
    got = pages.articles(spark.createDataFrame([(3, k, "PARAGRAPH", "", t, 1, None) for k, t in enumerate(said)], columns), ["doc_id"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.article, r.headline, r.continues_on_page) for r in got.orderBy("article").collect()][:2] == [(1, "ONE HEADLINE HERE", 4), (2, "ANOTHER HEADLINE", 7)]
