"""Specifications of many papers, imports, and workbooks, against plain walks."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import select
from quillspark.sources import workbooks

POOL = "pool_id long, id long, topic_id long, difficulty string, marks double, question_type string, subject string, position long"


def plain_quota(pool, target, most):
    """The rules of a sum of marks, by whole lists."""
    if not target or target <= 0:
        turns = {}
        keyed = []
        for q in sorted(pool, key=lambda q: (q["difficulty"], q["id"])):
            turns[q["topic_id"]] = turns.get(q["topic_id"], 0) + 1
            keyed.append((turns[q["topic_id"]], q["topic_id"], q["id"]))
        ids = [k[2] for k in sorted(keyed)]
        return ids[:most] if most else ids, None
    units = lambda x: int(round(x * 2))
    goal = units(target)
    if sum(units(q["marks"]) for q in pool) < goal:
        return [], "pool_too_small"
    topics = {}
    for q in sorted(pool, key=lambda q: (q["topic_id"], q["difficulty"], q["id"])):
        topics.setdefault(q["topic_id"], []).append(q)
    tried = [t[i] for i in range(max(map(len, topics.values()))) for t in topics.values() if i < len(t)]

    def reach(cap):
        best = {0: []}
        for q in tried:
            new = dict(best)
            for total, chosen in best.items():
                more = total + units(q["marks"])
                if more <= goal and not (cap and len(chosen) + 1 > cap) and (more not in new or len(chosen) + 1 < len(new[more])):
                    new[more] = [*chosen, q]
            best = new
        return best

    best = reach(most)
    if goal in best:
        return [q["id"] for q in best[goal]], None
    if most and goal in reach(None):
        return [], "needs_more_than_max"
    return [], f"closest:{min(sorted(best), key=lambda x: abs(x - goal)) / 2:g}"


def plain_selection(pool, spec):
    if not pool:
        return [], None
    total = spec["quantity"]
    if spec["subject_breakdown"]:
        out, named = [], {}
        for q in sorted(pool, key=lambda q: q["position"]):
            named.setdefault((q["subject"] or "").strip().lower() or "general", []).append(q)
        for subject, marks, count in spec["subject_breakdown"]:
            w = subject.strip().lower()
            own = named.get(w) or next((v for k, v in named.items() if w in k or k in w), None)
            if not own:
                return [], f"no_questions:{subject}"
            ids, error = plain_quota(own, marks, count)
            if error:
                return [], f"{subject}:{error}"
            out += ids
        return out, None
    levels = spec["difficulty_distribution"]
    if levels and total and sum(n for _, n in levels) <= 100 and any(n > 10 for _, n in levels):
        levels = [(k, int(round(total * n / 100))) for k, n in levels]
    out = []
    for level, n in levels:
        there = sorted((q for q in pool if q["difficulty"] == level.upper()), key=lambda q: q["position"])
        if len(there) < n:
            return [], f"too_few:{level.upper()}:{n}:{len(there)}"
        out += [q["id"] for q in there[:n]]
    if out:
        return out, None
    for marks, n, formats in spec["mark_distribution"]:
        if marks is None or n <= 0:
            continue
        there = sorted((q for q in pool if q["id"] not in out and q["marks"] == marks and (not formats or q["question_type"] in formats)), key=lambda q: (q["topic_id"], q["difficulty"], q["id"]))
        if len(there) < n:
            return [], f"too_few:{marks:g}:{n}:{len(there)}"
        out += [q["id"] for q in there[:n]]
    if out:
        return out, None
    return plain_quota(pool, spec["total_marks"], total)


def test_specifications_like_plain_rules(spark):
    rng = random.Random(6)
    pools = [{"pool_id": i % 4, "id": i, "topic_id": rng.randrange(5), "difficulty": rng.choice(["EASY", "MEDIUM", "HARD"]), "marks": rng.choice([0.5, 1.0, 1.0, 2.0, 3.0, 5.0]), "question_type": rng.choice(["MCQ", "SHORT", "LONG"]), "subject": rng.choice(["Physics", "physics ", "Organic Chemistry", "Math", "", None]), "position": i * 7 % 160} for i in range(160)]
    names = ["subject_breakdown", "difficulty_distribution", "mark_distribution", "total_marks", "quantity"]
    specs = []
    for p in range(140):
        spec = {"paper_id": p, "pool_id": rng.choice([0, 1, 2, 3, 9]), "subject_breakdown": [], "difficulty_distribution": [], "mark_distribution": [], "total_marks": None, "quantity": rng.choice([None, 3, 8])}
        kind = p % 5
        if kind == 0:
            spec["subject_breakdown"] = [(rng.choice(["physics", "Chemistry", "MATH", "biology", "general"]), rng.choice([None, 4.0, 7.5, 400.0]), rng.choice([None, 2, 6])) for _ in range(rng.randrange(1, 4))]
        elif kind == 1:
            spec["difficulty_distribution"] = [(k, rng.choice([0, 2, 4, 50, 25])) for k in ("easy", "Medium", "HARD")]
        elif kind == 2:
            spec["mark_distribution"] = [(rng.choice([1.0, 2.0, 5.0, None]), rng.choice([0, 1, 3, 5]), rng.choice([[], ["MCQ"], ["SHORT", "LONG"], ["SHORT", "SHORT"]])) for _ in range(rng.randrange(1, 5))]
        elif kind == 3:
            spec["total_marks"] = rng.choice([5.0, 10.5, 20.0, 33.0, 500.0, 0.0])
        specs.append(spec)
    got = select.select_for_specifications(spark.createDataFrame([tuple(s[c] for c in ("paper_id", "pool_id", *names)) for s in specs], f"paper_id long, pool_id long, {select.SPEC}"), spark.createDataFrame([tuple(q.values()) for q in pools], POOL)).collect()
    by_paper = {}
    for r in got:
        by_paper.setdefault(r.paper_id, []).append(r)
    outcomes = set()
    for s in specs:
        rows = by_paper.get(s["paper_id"], [])
        ids, error = plain_selection([q for q in pools if q["pool_id"] == s["pool_id"]], s)
        assert sorted(r.id for r in rows if r.id is not None) == sorted(ids), s
        assert [r.outcome for r in rows if r.id is None] == ([error] if error else []), s
        outcomes |= {(error or "ok").split(":")[0]}
    assert outcomes >= {"ok", "pool_too_small", "too_few", "no_questions"}


def test_imports_like_a_walk(spark):
    rng, rows, there = random.Random(4), [], []
    for school in (1, 2, 3):
        for k in range(120):
            rows.append((school, k, rng.choice([None, "", *(f"G{rng.randrange(50)}" for _ in range(6))]), rng.choice([None, *(f"9{rng.randrange(70)}" for _ in range(6))]), {1: 20, 2: 500, 3: 0}[school]))
        there += [(school, f"G{k}", f"9{k + school}") for k in range(3)]
    phones = {p for _, _, p in there}
    want = {}
    for school, seats in ((1, 20), (2, 500), (3, 0)):
        seen = {("g", g) for s, g, _ in there if s == school} | {("p", p) for p in phones}
        for s, k, gr, phone, _ in rows:
            if s == school:
                keys = {("g", gr)} - {("g", None), ("g", "")} | {("p", phone)} - {("p", None)}
                want[s, k] = "duplicate" if keys & seen else "created" if seats > 0 else "over_limit"
                if want[s, k] == "created":
                    seats, seen = seats - 1, seen | keys
    frame = spark.createDataFrame(rows, "school_id long, row long, gr_number string, phone string, seats long")
    got = select.import_students(frame, F.col("seats"), existing=spark.createDataFrame(there, "school_id long, gr_number string, phone string"))
    assert {(r.school_id, r.row): r.outcome for r in got.collect()} == want and set(want.values()) == {"created", "duplicate", "over_limit"}


HEADERS = ["Student Name", "GR Number", "Roll Number", "Standard", "Division", "Phone Number"]


def workbook(rows, shared=True, active=0):
    """A workbook as spreadsheets write it: texts shared or in their cells, numbers as numbers, gaps left out."""
    texts, out = [], []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            at = f"{chr(65 + c) if c < 26 else 'A' + chr(65 + c - 26)}{r}"
            if v is None:
                continue
            if isinstance(v, (int, float)):
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
            elif shared:
                texts.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(texts) - 1}</v></c>')
            else:
                cells.append(f'<c r="{at}" t="inlineStr"><is><r><t>{v[:2]}</t></r><r><t>{v[2:]}</t></r></is></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        sheets = "".join(f'<sheet name="s{k}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k in range(2))
        z.writestr("xl/workbook.xml", f'<workbook {ns}><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k + 1}" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(2))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k in range(2):
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'<worksheet {ns}><sheetData>{"".join(out) if k == active else ""}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{t}</t></si>' for t in texts)}</sst>")
    return data.getvalue()


def test_workbooks(spark, tmp_path):
    first = [HEADERS, ["Student Alpha", "GR-101", 1, "Standard 10", "A", "+919876543111"], ["Student Beta", "GR-102", "2", "10th", "A", 919876543112], [None] * 6, ["Student Gamma", "GR-103", 3.0, "VI", "B", "+919876543113"], ["Student Alpha Dup", "GR-101", "4", 10, "A", "+919876543114"], [None, "GR-9", None, "X", "A", "+919876543119"], ["Long Standard", "GR-8", None, "15", "A", "+919876543118"]]
    (tmp_path / "a.xlsx").write_bytes(workbook(first))
    (tmp_path / "b.xlsx").write_bytes(workbook([["Name", "Class Name", "Section", "Mobile", "GR", "Phone"], ["Zeta", "5", "c", None, "G1", "9876543210"]], shared=False, active=1))
    (tmp_path / "c.xlsx").write_bytes(workbook([["Name", "Phone"], ["x", "y"]]))
    (tmp_path / "d.xlsx").write_bytes(b"no workbook")
    (tmp_path / "e.xlsx").write_bytes(workbook([HEADERS]))
    sheets = workbooks.read_workbooks(spark, str(tmp_path))
    rows = workbooks.checked_students(workbooks.by_headers(sheets))
    got = {(r.path[-6:-5], r.row): r for r in rows.collect()}
    assert sorted(got) == [("a", 2), ("a", 3), ("a", 5), ("a", 6), ("a", 7), ("a", 8), ("b", 2), ("c", 1), ("d", 0), ("e", 1)]
    assert [(r.name, r.roll_number, r.standard, r.division, r.error) for k, r in sorted(got.items()) if k[0] == "a"][:4] == [("Student Alpha", "1", 10, "A", None), ("Student Beta", "2", 10, "A", None), ("Student Gamma", "3", 6, "B", None), ("Student Alpha Dup", "4", 10, "A", None)]
    assert got["a", 7].error == "name" and got["a", 8].error == "standard"
    assert (got["b", 2].name, got["b", 2].standard, got["b", 2].division, got["b", 2].phone, got["b", 2].gr_number) == ("Zeta", 5, "C", "+919876543210", "G1")
    assert got["c", 1].error == "missing columns: gr_number, standard, division" and got["d", 0].error.startswith("BadZipFile") and got["e", 1].error == "no data rows"
    good = rows.where("error is null and path like '%a.xlsx'").withColumn("school_id", F.lit(1))
    done = select.import_students(good, 2)
    assert [r.outcome for r in done.sort("row").collect()] == ["created", "created", "over_limit", "duplicate"]


def test_teacher_workbook(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(workbook([["Teacher Name", "Teacher Mobile Number", "Subject", "Class Teacher"], ["Teacher Raman", "+919876543222", "Mathematics", "Standard 10 — A"], ["Teacher Two", "12", "Music", None]]))
    rows = workbooks.by_headers(workbooks.read_workbooks(spark, str(tmp_path)), workbooks.TEACHER_COLUMNS, workbooks.TEACHER_NEEDS)
    one, two = workbooks.checked_teachers(rows).sort("row").collect()
    assert (one.name, one.subject, one.assignment.standard, one.assignment.section, one.error) == ("Teacher Raman", "Mathematics", 10, "A", None) and two.error == "phone"


@pytest.mark.parametrize("headers", [HEADERS, ["name", "Student name", "NAME", "Class Name", "gr", "grade", "sec", "div", "mobile"], ["Teacher Name", "Name", "in-charge", "Class Teacher Name", "subject"], [None, ""]])
@pytest.mark.parametrize("rules", [workbooks.STUDENT_COLUMNS, workbooks.TEACHER_COLUMNS])
def test_header_rules_agree(spark, headers, rules):
    got = spark.createDataFrame([(headers,)], "h array<string>").select(workbooks._columns(F.col("h"), rules).alias("m")).first().m
    assert got == workbooks.columns_of(headers, rules)


def test_whole_pools_are_not_written_on_their_way(spark, monkeypatch):
    written = []

    def counted(df, label, kept=select.materialize):
        out = kept(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(select, "materialize", counted)
    pool = spark.range(300).selectExpr("0 AS pool_id", "id", "id % 3 AS topic_id", "'EASY' AS difficulty", "1.0D AS marks", "'MCQ' AS question_type", "'s' AS subject", "id AS position")
    specs = spark.createDataFrame([(p, 0, None, None, [(1.0, 2, []), (1.0, 3 if p else 400, ["MCQ"])] if p < 2 else None, None, None) for p in range(202)], f"paper_id long, pool_id int, {select.SPEC}")
    got = select.select_for_specifications(specs, pool)
    assert got.where("paper_id > 1").distinct().count() == got.where("paper_id > 1").count() == 60000
    assert got.where("paper_id = 0").collect() == [(0, None, "too_few:1:400:298")]
    assert sorted(r.id for r in got.where("paper_id = 1").collect()) == [0, 3, 6, 9, 12]
    assert sum(written) < 5000
