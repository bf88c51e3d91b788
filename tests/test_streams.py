"""Streams with state: jobs that stall, attempts that are handed in, and the page log, batch by batch."""

import datetime as dt
import os

from pyspark.sql import functions as F

from quillspark.streaming import jobs, timers


def t(minute, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute, seconds=second)


def play(spark, folder, schema, batches, run):
    """Lands each batch and runs the stream over what is new."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        run()


def test_stalled_jobs_fail_once(spark, tmp_path):
    schema, land, out = "job_id long, status string, updated_at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [(1, "EXTRACTING", t(0)), (2, "EXTRACTING", t(1)), (3, "PENDING", t(1)), (4, "EXTRACTING", t(2))],
        [(2, "EXTRACTING", t(40)), (4, "COMPLETED", t(30)), (2, "EXTRACTING", t(20))],  # one update comes late
        [(9, "PENDING", t(56))],  # 45 minutes and the lateness behind the last update of job 1
        [(9, "PENDING", t(58))],
        [(1, "EXTRACTING", t(60)), (9, "PENDING", t(100))],  # job 2 stalls, job 1 goes on
        [(9, "PENDING", t(200))],  # job 1 stalls again
        [(9, "PENDING", t(300))],
    ]

    def run():
        found = timers.stalls(jobs.file_stream(spark, land, schema))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    play(spark, land, schema, batches, run)
    got = sorted((r.job_id, r.status, r.updated_at, r.failed_at) for r in spark.read.parquet(out).collect())
    assert got == [(1, "FAILED", t(0), t(45)), (1, "FAILED", t(60), t(105)), (2, "FAILED", t(40), t(85))]


EVENTS = "attempt_id long, kind string, event_type string, details string, ts timestamp"
ANSWERS = "attempt_id long, question_type string, marks double, correct_answer string, response string, options map<string,string>"


def warn(attempt, *minutes):
    return [(attempt, "WARNING", None, None, t(m)) for m in minutes]


def test_the_fifth_warning_hands_in(spark, tmp_path):
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    answers = spark.createDataFrame([(1, "MCQ", 2.0, "A", "A", None), (1, "MCQ", 2.0, "A", "B", None), (3, "MCQ", 1.0, "A", "A", None), (3, "LONG_ANSWER", 5.0, None, "words", None)], ANSWERS)
    batches = [
        [(1, "START", None, None, t(0)), *warn(1, 3, 1, 2), *warn(2, 1, 2, 3, 4), (2, "SUBMIT", None, None, t(5))],
        [*warn(1, 4), *warn(2, 6), *warn(3, 1, 2, 3, 4, 5)],
        [*warn(1, 5, 6), *warn(2, 7), *warn(4, 1)],
        [*warn(1, 7)],
    ]

    def run():
        timers.proctor(jobs.file_stream(spark, land, EVENTS), answers, out, str(tmp_path / "c")).awaitTermination()

    play(spark, land, EVENTS, batches, run)
    log = spark.read.parquet(f"{out}/log").collect()
    assert sorted((r.attempt_id, r.warning_number) for r in log) == [(1, k) for k in range(1, 8)] + [(2, k) for k in range(1, 7)] + [(3, k) for k in range(1, 6)] + [(4, 1)]
    assert {(r.attempt_id, r.warning_number, r.ts) for r in log if r.auto_submitted} == {(1, 5, t(5)), (3, 5, t(5))}
    assert {r.event_type for r in log} == {"TAB_SWITCH"}
    # a wrong choice costs nothing here; a written answer waits for a teacher
    got = {(r.attempt_id, r.submitted_at, r.score, r.status) for r in spark.read.parquet(f"{out}/attempts").collect()}
    assert got == {(1, t(5), 2.0, "EVALUATED"), (3, t(5), 1.0, "SUBMITTED")}


def test_warnings_of_a_table(spark):
    rows = spark.createDataFrame(warn(1, 5, 4, 3, 2, 1, 6) + [(1, "SUBMIT", None, None, t(7)), (2, "SUBMIT", None, None, t(0)), *warn(2, 1, 2, 3, 4, 5), (2, "START", None, None, t(6)), *warn(2, 7)], EVENTS)
    got = timers.proctored(rows).collect()
    assert {(r.attempt_id, r.warning_number) for r in got if r.auto_submitted} == {(1, 5), (2, 6)}
    assert timers.proctored(rows.limit(0)).collect() == []


def test_a_log_stays_small(spark, tmp_path):
    """After many micro-batches a read of one job opens a bounded number of files."""
    schema = "job_id long, idempotency_key string, event_time timestamp, pages array<struct<page_number: int, raw_text: string>>"
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(20):
        rows = [(k % 3, f"k{k}", t(k), [(k % 5, f"v{k}"), (7, f"w{k}")]), (k % 3, f"k{max(k - 3, 0)}", t(k, 30), [(9, "replayed")] if k > 2 else [(k, "x")])]
        spark.createDataFrame(rows[:1] if k <= 2 else rows, schema).coalesce(1).write.mode("append").parquet(land)
        jobs.ingest(jobs.file_stream(spark, land, schema), out, str(tmp_path / "c")).awaitTermination()
    want = {}
    for k in range(20):
        want |= {(k % 3, k % 5): f"v{k}", (k % 3, 7): f"w{k}"}
    stored = jobs.stored_pages(spark, out)
    assert {(r.job_id, r.page_number): r.raw_text for r in stored.collect()} == want
    runs = [r for r in os.listdir(out) if r.startswith("run=")]
    assert len(runs) <= 2 * jobs.MERGED
    one = jobs.stored_pages(spark, out, [1])
    assert {(r.job_id, r.page_number): r.raw_text for r in one.collect()} == {k: v for k, v in want.items() if k[0] == 1}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_run_counts_once_it_is_whole(spark, tmp_path):
    out = str(tmp_path)
    rows = spark.createDataFrame([(1, 1, "a", t(0), "k")], "job_id long, page_number int, raw_text string, event_time timestamp, idempotency_key string")
    for k in range(3):
        jobs._write_run(rows.withColumn("raw_text", F.lit(f"v{k}")).withColumn("event_time", F.lit(t(k))), out, k, k)
    os.remove(f"{out}/run=2-2/_SUCCESS")
    assert jobs._runs(spark, out) == [(0, 0), (1, 1)]
    assert jobs.stored_pages(spark, out).first().raw_text == "v1"
    jobs._write_run(rows.withColumn("raw_text", F.lit("merged")), out, 0, 1)
    assert jobs._runs(spark, out) == [(0, 1)]
