"""Operators on small tables: selection, grading, layout, filters, streams."""

import datetime as dt
import random

import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import assess, relational, select
from quillspark.operators import text as texts
from quillspark.plans.queries import REGISTRY
from quillspark.streaming import jobs


def pool(spark, marks, group="g"):
    return spark.createDataFrame([(group, i, i % 2, "EASY", m) for i, m in enumerate(marks)], "grp string, id long, topic_id long, difficulty string, marks double")


def test_quota(spark):
    ok = select.select_quota(pool(spark, [2.0, 3.0]), "grp", 5.0).collect()
    assert sorted(r.id for r in ok) == [0, 1]
    assert select.select_quota(pool(spark, [2.0, 3.0]), "grp", 999.0).first().outcome == "pool_too_small"
    assert select.select_quota(pool(spark, [1.0] * 6), "grp", 5.0, most=3).first().outcome == "needs_more_than_max"
    assert select.select_quota(pool(spark, [4.0, 4.0]), "grp", 5.0).first().outcome == "closest:4"
    few = select.select_quota(pool(spark, [1.0, 1.0, 2.5, 2.5, 3.0]), "grp", 5.0).collect()
    assert len(few) == 2


def test_tier_counts():
    assert select.tier_counts({"EASY": 50, "HARD": 25}, 10) == {"EASY": 5, "HARD": 2}
    assert select.tier_counts({"EASY": 5, "HARD": 2}, 10) == {"EASY": 5, "HARD": 2}


def test_imports(spark):
    rows = spark.createDataFrame([(1, i, g, None) for i, g in enumerate(["GR-101", "GR-102", "GR-103", "GR-101"])], "school_id long, row long, gr_number string, phone string")
    got = [r.outcome for r in select.import_students(rows, 2).orderBy("row").collect()]
    assert got == ["created", "created", "over_limit", "duplicate"]


def test_budget(spark):
    items = spark.createDataFrame([("a", 0, 2, 50), ("a", 1, 1, 40), ("a", 2, 1, 70), ("a", 3, 3, 30)], "g string, position long, priority long, tokens long")
    assert [r.kept for r in select.fill_budget(items, "g", 80).orderBy("position").collect()] == [False, True, False, True]


def plain_budget(rows, budget):
    """(group, position) of the kept items, by one plain loop over each group."""
    left, kept = {}, set()
    for g, position, _, tokens in sorted(rows, key=lambda r: (r[2], r[1])):
        if tokens is not None and tokens <= left.setdefault(g, budget):
            left[g] -= tokens
            kept.add((g, position))
    return kept


def test_budget_equals_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(4), rng.choice([None, 0, 1, 3, 7, 7, 20, 90, 400])) for i in range(900)]
    items = spark.createDataFrame(rows, "g string, position long, priority long, tokens long")
    for budget in (0, 60, 399, 5000):
        got = {(r.g, r.position): r.kept for r in select.fill_budget(items, "g", budget).collect()}
        assert len(got) == len(rows)
        assert {k for k, kept in got.items() if kept} == plain_budget(rows, budget)


def test_budget_query_has_one_budget_for_each_source(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = REGISTRY["budget_greedy"][0](spark, f"{DATA}/sf0.001").collect()
    assert len(got) == docs.count()
    assert {r.source for r in got} == {r.source for r in docs.select("source").distinct().collect()}
    assert {(r.source, r.position) for r in got if r.kept} == plain_budget([(r.source, r.position, r.priority, r.tokens) for r in got], 2000)


def plain_quota(pool, units, most):
    """(ids, outcome) of one group by the plain loop over all candidates."""
    pool = sorted(pool, key=lambda q: (q[1], q[2], q[0]))
    turns: dict = {}
    order = []
    for i, q in enumerate(pool):
        turns[q[1]] = turns.get(q[1], -1) + 1
        order.append((turns[q[1]], q[1], i))
    worth = [round(q[3] * 2) for q in pool]

    def reach(cap):
        sums = {0: ()}
        for _, _, i in sorted(order):
            grown = dict(sums)
            for total, picked in sums.items():
                to = total + worth[i]
                if to <= units and not (cap and len(picked) >= cap) and (to not in grown or len(picked) + 1 < len(grown[to])):
                    grown[to] = (*picked, i)
            sums = grown
        return sums

    if sum(worth) < units:
        return {None}, "pool_too_small"
    sums = reach(most)
    if units in sums:
        return {pool[i][0] for i in sums[units]}, "ok"
    if most and units in reach(None):
        return {None}, "needs_more_than_max"
    return {None}, f"closest:{min(sorted(sums), key=lambda s: abs(s - units)) / 2:g}"


def test_quota_equals_the_plain_loop(spark):
    rng = random.Random(8)
    pools = {f"g{k}": [(1000 * k + i, rng.randrange(3), rng.choice("abc"), rng.choice(marks)) for i in range(n)] for k, (n, marks) in enumerate([(60, [1, 2, 2.5, 4]), (40, [3]), (50, [0, 30]), (5, [1, 0.5]), (80, [0.5, 1]), (30, [2, 7, 9]), (3, [0.0])])}
    rows = [(g, *q) for g, pool in pools.items() for q in pool]
    pool = spark.createDataFrame([(g, i, t, d, float(m)) for g, i, t, d, m in rows], "g string, id long, topic_id long, difficulty string, marks double")
    for target, most in ((10.0, None), (10.0, 4), (25.5, 8)):
        got: dict = {}
        for r in select.select_quota(pool, "g", target, most).collect():
            ids, _ = got.setdefault(r.g, (set(), r.outcome))
            ids.add(r.id if r.id is None or r.id == r.id else None)
        assert got == {g: plain_quota(p, round(target * 2), most) for g, p in pools.items()}


def test_quota_query_has_one_pool_for_each_brand(spark):
    got = {r.brand for r in REGISTRY["quota_select"][0](spark, f"{DATA}/sf0.001").collect()}
    assert got == {r.p_brand for r in spark.read.parquet(f"{DATA}/sf0.001/part.parquet").select("p_brand").distinct().collect()}


def test_interleave_without_a_single_partition(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in rng.sample(range(1000), 300)]
    out = select.interleave(spark.createDataFrame(rows, "id long, topic string").repartition(5), "topic", ["id"])
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    turns: dict = {}
    first: dict = {}
    keys = []
    for i, topic in sorted(rows):
        turns[topic] = turns.get(topic, 0) + 1
        keys.append((turns[topic], first.setdefault(topic, i), i))
    want = {i: k for k, (_, _, i) in enumerate(sorted(keys), 1)}
    assert out.columns == ["id", "topic", "turn"]
    assert {r.id: r.turn for r in out.collect()} == want
    assert select.interleave(spark.createDataFrame([], "id long, topic string"), "topic", ["id"]).count() == 0


def test_labels(spark):
    papers = spark.createDataFrame([(1,), (2,), (3,)], "paper_id long")
    versions = spark.createDataFrame([(1, "A"), (1, "C"), (2, "A"), (2, "B")], "paper_id long, version_label string")
    assert {r.paper_id: r.version_label for r in select.next_label(versions, papers).collect()} == {1: "B", 2: "C", 3: "A"}


def test_next_label_joins_nothing(spark):
    """A join with all labels was planned as a broadcast, since the plan counts rows before they are exploded."""
    papers = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (None,)], "paper_id long")
    versions = papers.select("paper_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i")).where("paper_id < 3 and i <> 28 or paper_id = 3 and i < 26")
    got = select.next_label(versions.select("paper_id", select.version_label(F.col("i")).alias("version_label")).unionByName(spark.createDataFrame([(1, "ac"), (1, "A"), (4, "A1"), (4, None), (9, "A")], "paper_id long, version_label string")), papers)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.paper_id: r.version_label for r in got.collect()} == {1: "AC", 2: "AC", 3: "AA", 4: "A", None: "A"}
    back = spark.range(0, 475254, 997).withColumn("i", F.col("id").cast("int"))
    assert back.where(~select.label_index(select.version_label(F.col("i"))).eqNullSafe(F.col("i"))).count() == 0



def test_gradebook(spark):
    roster = spark.createDataFrame([(1,), (2,), (3,), (4,)], "student_id long")
    attempts = spark.createDataFrame([(10, 1, "EVALUATED", None), (20, 2, "SUBMITTED", 5.0), (30, 3, "NOT_STARTED", None)], "attempt_id long, student_id long, status string, score double")
    answers = spark.createDataFrame([(10, "MCQ", 4.0), (10, "LONG_ANSWER", 2.0), (20, "LONG_ANSWER", None)], "attempt_id long, question_type string, marks_awarded double")
    book = assess.gradebook(roster, attempts, answers, 10.0)
    got = {r.student_id: (r.total, r.grade, r.remarks) for r in book.collect()}
    assert got == {1: (6.0, "B", "Passed"), 2: (5.0, "C", "Pending Descriptive Review"), 3: (None, "—", "Not Started"), 4: (None, "AB", "Absent")}
    stats = assess.cohort_stats(book).first()
    assert (stats.assigned, stats.appeared, stats.avg_total, stats.pass_percentage) == (4, 2, 5.5, 100.0)
    assert assess.cohort_stats(book.limit(0)).first().avg_total == 0.0


@pytest.mark.parametrize("key,risk", [("action", "HIGH"), ("event_type", "HIGH")])
def test_risk(spark, key, risk):
    logs = spark.createDataFrame([(1, "tab_switch"), (1, "window_blur"), (1, "x")], f"attempt_id long, {key} string")
    t = dt.datetime(2024, 1, 1)
    attempts = spark.createDataFrame([(1, t, t + dt.timedelta(hours=1), 50.0, 3), (2, t, None, 90.0, 0)], "attempt_id long, started_at timestamp, submitted_at timestamp, percentage double, warnings int")
    got = assess.risk_roster(attempts, logs, F.lit(t + dt.timedelta(seconds=30)), 3600.0, key).collect()
    assert [(r.attempt_id, r.risk) for r in got] == [(1, risk), (2, "HIGH")]
    assert (got[0].tab_switch, got[0].window_blur, got[0].other) == (1, 1, 1) and got[1].flags == ["ABNORMAL_SPEED"]


def test_version_total(spark):
    row = spark.createDataFrame([([(2.5,), (None,)],), ([],)], "s array<struct<marks: double>>").select(assess.version_total(F.col("s")).alias("t")).collect()
    assert [r.t for r in row] == [2, 0]


def test_filters(spark):
    q = spark.createDataFrame([(1, 7, "100% sure", "EASY", "2.00", "CBSE"), (2, 8, "other", "HARD", "3.00", "ICSE"), (3, 9, None, None, None, None)], "id long, topic_id long, question_text string, difficulty string, marks string, board string")
    run = lambda **p: sorted(r.id for r in relational.filter_rows(q, p, {"difficulty": "difficulty"}, {"board": "board"}, {"marks": "marks"}, ["question_text", "board"]).collect())
    assert run() == run(difficulty="ALL") == run(marks="abc") == run(unknown="x") == [1, 2, 3]
    assert (run(difficulty="easy"), run(board="icse"), run(marks="2"), run(search="0% S"), run(q="_")) == ([1], [2], [1], [1], [])
    bridge = spark.createDataFrame([(2, 7), (2, 7), (1, 7)], "question_id long, topic_id long")
    assert sorted(r.id for r in relational.topic_filter(q, bridge, "7, x,9").collect()) == [1, 2, 3]
    found = lambda s: sorted(r.id for r in q.where(relational.web_search("question_text", s)).collect())
    assert (found("sure -other"), found('"100 sure" or other'), found("100 -sure")) == ([1], [1, 2], [])


def test_scopes(spark):
    users = spark.createDataFrame([(1, "Teacher", 5, None), (2, "Student", 5, 9), (3, "Teacher", 6, 1)], "id long, role string, school_id long, created_by_id long")
    who = lambda u: sorted(r.id for r in users.where(relational.user_scope(u)).collect())
    assert who({"school_id": None}) == [1, 2, 3] and who({"school_id": 5, "school_wide": True}) == [1, 2]
    assert who({"school_id": 5, "role": "Teacher", "id": 1}) == [2] and who({"school_id": 5, "role": "Student", "id": 2}) == [2]
    grants = spark.createDataFrame([(1, "x"), (3, "x"), (3, "y")], "user_id long, capability string")
    assert sorted(r.id for r in relational.role_or_capability(users, grants, ["Student"], "x", lacks="y").collect()) == [1, 2]


def test_duplicates(spark):
    drafts = spark.createDataFrame([(0, 0, "State Ohm's law for a conductor."), (0, 1, "state ohm s law for a conductor"), (0, 2, "Define electric current.")], "g long, position long, t string")
    assert [r.duplicate_of for r in texts.greedy_unique(drafts, "g", "position", "t", 0.75).orderBy("position").collect()] == [None, 0, None]
    score = spark.sql("select 'Calculate the acceleration of a car' a, 'Find the acceleration of the automobile car' b, 'Explain photosynthesis' c, 'Explain cellular respiration steps' d").select(texts.similarity(F.col("a"), F.col("b")).alias("x"), texts.similarity(F.col("c"), F.col("d")).alias("y")).first()
    assert score.x > 0.75 and score.y < 0.5


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab $.\n#", min_size=0, max_size=4000), st.integers(80, 600))
def test_chunks_cover_the_text(value, size):
    bounds = texts.chunk_bounds(value, size, size // 5, size // 4)
    assert (not value) == (not bounds)
    if bounds:
        assert bounds[0][0] == 0 and bounds[-1][1] == len(value)
        assert all(a[0] < b[0] <= a[1] <= b[1] for a, b in zip(bounds, bounds[1:], strict=False))


def test_formulas_stay_whole():
    value = "word " * 10 + "$$a + b = c + d$$" + " word" * 20
    bounds = texts.chunk_bounds(value, 70, 20, 10)
    assert all(value[a:b].count("$$") % 2 == 0 for a, b in bounds) and any("$$a + b = c + d$$" in value[a:b] for a, b in bounds)


def test_layout(spark):
    blocks = [(1, float(x), float(x + 150), float(y), y + 20.0) for y in (200, 300) for x in (20, 220, 420)] + [(1, 10.0, 590.0, 20.0, 40.0), (1, 10.0, 590.0, 700.0, 720.0)]
    df = spark.createDataFrame(blocks, "page long, x0 double, x1 double, y0 double, y1 double")
    got = texts.reading_order(texts.page_columns(df, ["page"], F.lit(600.0)), ["page"], F.lit(800.0)).orderBy("reading").collect()
    assert [r.column_no for r in got] == [0, 1, 1, 2, 2, 3, 3, 0] and got[0].y0 == 20.0


def test_chapters(spark):
    starts = spark.createDataFrame([(1, 5), (1, 9), (1, 9), (1, 13)], "doc long, start_page long")
    assert [r.end_page for r in texts.chapter_bounds(starts, "doc", "start_page", ["start_page"], F.lit(16)).orderBy("start_page", "end_page").collect()] == [8, 9, 12, 16]
    ex = spark.createDataFrame([(1, 1, "Motion and Rest"), (1, 2, "Light")], "doc long, number long, title string")
    got = spark.createDataFrame([(1, 1, "Motion & Rest"), (1, 9, "Lights"), (1, 7, "Zebra")], "doc long, number long, title string")
    assert {(r.expected, r.found) for r in texts.match_chapters(ex, got, "doc").collect()} == {(1, 1), (2, 9)}


def test_ingest_stream(spark, tmp_path):
    schema = "job_id long, idempotency_key string, event_time timestamp, pages array<struct<page_number: int, raw_text: string>>"
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(1, "a", t(1), [(1, "one"), (2, "two")]), (1, "a", t(1), [(1, "one"), (2, "two")])]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(land)
    jobs.ingest(jobs.file_stream(spark, land, schema), out, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(1, "b", t(5), [(2, "TWO"), (3, "three")]), (1, "c", t(0), [(1, "old")]), (1, "a", t(9), [(1, "again")])], schema).coalesce(1).write.mode("append").parquet(land)
    jobs.ingest(jobs.file_stream(spark, land, schema), out, str(tmp_path / "c")).awaitTermination()
    got = {r.page_number: r.raw_text for r in jobs.stored_pages(spark, out).collect()}
    assert got == {1: "one", 2: "TWO", 3: "three"}
    table = spark.createDataFrame([(1, 4, 0)], "job_id long, total_pages int, processed_pages int")
    jobs.compact(spark, out, str(tmp_path / "compact"))
    stored = jobs.stored_pages(spark, str(tmp_path / "compact"))
    assert {r.page_number: r.raw_text for r in stored.collect()} == got
    assert [r.page_number for r in jobs.missing_pages(table, stored).collect()] == [4]
    assert jobs.progress(table, stored).first().percent == 75


def test_warning_stream(spark, tmp_path):
    land = str(tmp_path / "in")
    spark.createDataFrame([(1,)] * 5 + [(2,)] * 2, "attempt_id long").coalesce(1).write.parquet(land)
    events = jobs.file_stream(spark, land, "attempt_id long")
    q = jobs.warnings(events).writeStream.outputMode("update").format("memory").queryName("warned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.attempt_id, r.warnings, r.submitted) for r in spark.table("warned").collect()} == {(1, 5, True), (2, 2, False)}


def test_history(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, 1, "SEND_FOR_CORRECTION", "fix", t(1)), (2, 1, "RESUBMIT", None, t(2)), (3, 1, "REJECT", " ", t(3)), (4, 2, "APPROVE", None, t(1))]
    got = jobs.review_status(spark.createDataFrame(rows, "id long, question_id long, action string, comment string, created_at timestamp"))
    assert {r.question_id: (r.status, r.revision) for r in got.collect()} == {1: ("SUBMITTED", 2), 2: ("APPROVED", 1)}


def test_contents_on_pages(spark):
    toc = spark.createDataFrame([(1, 0, "Motion Laws", 1), (1, 1, "Light Rays", 5), (1, 2, "Sound", 9)], "doc long, position long, title string, page int")
    marks = {5: "The laws of motion", 9: "rays of light", 13: "On sound", 17: "\n Appendix A"}
    pages = spark.createDataFrame([(1, p, marks.get(p, "text")) for p in range(1, 21)], "doc long, page_number int, text string")
    assert texts.page_offset(toc, pages, "doc").first().offset == 4
    starts = toc.select("doc", (F.col("page") + 4).alias("start_page"))
    got = texts.last_chapter_end(starts, pages, "doc").orderBy("start_page").collect()
    assert [(r.start_page, r.end_page) for r in got] == [(5, 8), (9, 12), (13, 16)]
