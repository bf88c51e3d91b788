"""Gradebooks, cohorts, proctoring, leaderboards and evaluation metrics as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.school import grade, roll_key
from quillspark.shared import numbered

PASS, BATCH_PASS = 33.0, 40.0


def gradebook(roster: DataFrame, attempts: DataFrame, answers: DataFrame, paper_max: float) -> DataFrame:
    """One row for each assigned student: marks by part, total, percentage, grade, remarks.

    roster: (student_id, ...); attempts: (attempt_id, student_id, status, score); answers: (attempt_id, question_type,
    marks_awarded). Students without an attempt are ABSENT; null marks of a written answer wait for review.
    """
    mcq = F.col("question_type") == "MCQ"
    parts = answers.groupBy("attempt_id").agg(
        F.coalesce(F.sum(F.when(mcq, F.col("marks_awarded").cast("double"))), F.lit(0.0)).alias("mcq"),
        F.coalesce(F.sum(F.when(~mcq, F.col("marks_awarded").cast("double"))), F.lit(0.0)).alias("written"),
        F.coalesce(F.bool_or(~mcq & F.col("marks_awarded").isNull()), F.lit(False)).alias("pending"),
        F.coalesce(F.bool_or(~mcq), F.lit(False)).alias("has_written"),
    )
    rows = roster.join(attempts, "student_id", "left").join(parts, "attempt_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    status = F.coalesce("status", F.lit("ABSENT"))
    started = ~status.isin("ABSENT", "NOT_STARTED")
    total = F.when(started, F.coalesce(F.col("score").cast("double"), zero("mcq") + zero("written")))
    percent = F.when(started, total / paper_max * 100 if paper_max else F.lit(0.0))
    remarks = (
        F.when(status == "ABSENT", "Absent").when(status == "NOT_STARTED", "Not Started")
        .when(status == "EVALUATED", F.when(percent >= PASS, "Passed").otherwise("Needs Improvement"))
        .when((status == "SUBMITTED") & F.col("has_written") & F.col("pending"), "Pending Descriptive Review").otherwise("In Progress")
    )
    return rows.select(
        *roster.columns, status.alias("status"), F.when(started, zero("mcq")).alias("mcq_marks"), F.when(started, zero("written")).alias("written_marks"),
        total.alias("total"), percent.alias("percentage"), F.when(status == "ABSENT", "AB").otherwise(grade(percent)).alias("grade"), remarks.alias("remarks"),
    )


def cohort_stats(book: DataFrame) -> DataFrame:
    """Counts and averages over a gradebook; zeros if nobody appeared."""
    there = F.col("total").isNotNull() & (F.col("status") != "ABSENT")
    of = lambda f, c: F.coalesce(f(F.when(there, F.col(c))), F.lit(0.0))
    passed = F.count_if(there & (F.col("percentage") >= PASS)) / F.nullif(F.count_if(there), F.lit(0)) * 100
    return book.agg(
        F.count("*").alias("assigned"), F.count_if(there).alias("appeared"), F.count_if(~there).alias("absent"), of(F.avg, "percentage").alias("avg_percentage"),
        of(F.max, "total").alias("max_total"), of(F.min, "total").alias("min_total"), F.coalesce(passed, F.lit(0.0)).alias("pass_percentage"),
        of(F.avg, "mcq_marks").alias("avg_mcq"), of(F.avg, "written_marks").alias("avg_written"), of(F.avg, "total").alias("avg_total"),
    )


def sort_gradebook(book: DataFrame, by: str = "roll") -> DataFrame:
    roll = roll_key(F.col("roll_number"))
    orders = {"roll": [roll], "name": [F.lower("full_name"), F.lower("username")], "score": [F.col("total").isNotNull().desc(), F.col("total").desc(), roll.desc()]}
    return book.orderBy(*orders[by])


def upper_median(value: str, of: list[str], df: DataFrame) -> DataFrame:
    """For each group the element in the upper middle of its sorted values, by rank, without collecting the group."""
    w = Window.partitionBy(*of)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*of, F.col(value).alias("median"))


def event_bucket(key: Column) -> Column:
    low = F.lower(F.coalesce(key, F.lit("")))
    return (
        F.when(low.contains("tab") | low.contains("switch"), "tab_switch").when(low.contains("blur") | low.contains("focus"), "window_blur")
        .when(low.contains("fullscreen"), "fullscreen_exit").otherwise("other")
    )


def risk_roster(attempts: DataFrame, logs: DataFrame, as_of: Column, paper_seconds: float, event_key: str = "event_type") -> DataFrame:
    """Integrity profile of each attempt, with `rank` to list the riskiest first.

    attempts: (attempt_id, started_at, submitted_at, percentage, warnings); logs: (attempt_id, <event_key>). The writer
    of the logs uses `event_type`; pass `action` to read logs that hold it instead.
    """
    kinds = ("tab_switch", "window_blur", "fullscreen_exit", "other")
    bucket = event_bucket(F.col(event_key))
    counts = logs.groupBy("attempt_id").agg(*(F.count_if(bucket == k).alias(k) for k in kinds))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    rows = attempts.join(counts, "attempt_id", "left").na.fill(0, list(kinds))
    spent = F.round(F.coalesce(seconds("submitted_at"), F.unix_micros(as_of) / 1e6) - seconds("started_at"), 1)
    rows = rows.withColumn("duration", spent)
    fast = F.coalesce((F.col("duration") != 0) & (F.col("duration") < max(60.0, 0.12 * paper_seconds)) & (F.col("percentage") >= 80), F.lit(False))
    flags = F.filter(
        F.array(F.when(fast, "ABNORMAL_SPEED"), F.when((F.col("warnings") >= 3) | (F.col("tab_switch") >= 3), "FREQUENT_FOCUS_LOSS"), F.when(F.col("fullscreen_exit") >= 2, "PERSISTENT_FULLSCREEN_EXIT")),
        lambda f: f.isNotNull(),
    )
    level = F.when((F.col("warnings") >= 3) | fast, "HIGH").when((F.col("warnings") >= 1) | (F.size("flags") > 0), "MODERATE").otherwise("CLEAN")
    rank = F.when(F.col("risk") == "HIGH", 0).when(F.col("risk") == "MODERATE", 1).otherwise(2)
    return rows.withColumn("flags", flags).withColumn("risk", level).withColumn("rank", F.struct(rank.alias("risk"), (-F.col("warnings")).alias("warnings"), "attempt_id"))


def integrity(roster: DataFrame) -> DataFrame:
    return roster.agg(F.count("*").alias("attempts"), F.coalesce(F.round(F.count_if(F.col("risk") == "CLEAN") / F.nullif(F.count("*"), F.lit(0)) * 100, 1), F.lit(100.0)).alias("integrity"))


def leaderboard(runs: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Runs by model; failed runs are part of the averages. models: their order."""
    out = runs.groupBy("model").agg(
        F.count("*").alias("runs"), F.count_if("is_valid_json").alias("valid"), (F.count_if("is_valid_json") / F.count("*") * 100).alias("success"),
        F.avg("eval_tokens_per_sec").alias("tokens_per_sec"), F.avg("client_wall_time_sec").alias("latency"), F.avg("compliance_pct").alias("compliance"), F.max("vram_mb").alias("peak_vram"),
    )
    return out.orderBy(F.array_position(F.array(*map(F.lit, models)), F.col("model"))) if models else out.orderBy("model")


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    return df.groupBy(expected, predicted).agg(F.count("*").alias("n"))


def regressions(now: DataFrame, before: DataFrame, limits: dict[str, tuple[str, float]], key: str = "sample") -> DataFrame:
    """(sample, metric, before, now): metrics that got worse by more than allowed.

    limits: metric to (direction, tolerance), direction `drop`, `rise`, or `ratio` for a relative rise.
    """
    both = now.alias("n").join(before.alias("b"), key)
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").cast("double").alias("before"), F.col(f"n.{m}").cast("double").alias("now"), F.lit(d).alias("d"), F.lit(float(t)).alias("t")) for m, (d, t) in limits.items()))
    x = both.select(key, F.explode(rows).alias("x")).select(key, "x.*")
    worse = F.when(F.col("d") == "drop", F.col("before") - F.col("now") > F.col("t")).when(F.col("d") == "rise", F.col("now") - F.col("before") > F.col("t")).otherwise(F.col("now") > F.col("before") * (1 + F.col("t")))
    return x.where(worse).select(key, "metric", "before", "now")


def page_quality(pages: DataFrame) -> DataFrame:
    """Garbage, empty pages, review rate and kinds by document."""
    review = F.count_if("needs_review") + F.max(F.when(F.col("confidence") < 0.6, 1).otherwise(0))
    base = pages.groupBy("doc_id").agg(F.avg("garbage_rate").alias("avg_garbage"), F.count_if(F.trim(F.coalesce("raw_text", F.lit(""))) == "").alias("empty_pages"), F.least(F.lit(1.0), review / F.count("*")).alias("review_rate"))
    kinds = pages.groupBy("doc_id", "page_kind").count().groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("page_kind", "count")))).alias("kinds"))
    return base.join(kinds, "doc_id")


def majority(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The commonest value of each key; ties go to the one seen first."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return n.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), (-F.col("first")).alias("f"))).alias("x")).select(*keys, f"x.{value}", "x.n")


def tier_deficit(spec: DataFrame, drafts: DataFrame) -> DataFrame:
    made = drafts.groupBy(F.round("marks", 1).alias("marks")).agg(F.count("*").alias("made"))
    return spec.join(made, "marks", "left").select("marks", "required", F.coalesce("made", F.lit(0)).alias("made"), F.greatest(F.lit(0), F.col("required") - F.coalesce("made", F.lit(0))).alias("missing"))


def version_total(snapshot: Column) -> Column:
    """Marks of a paper version, rounded half to even."""
    return F.bround(F.aggregate(snapshot, F.lit(0.0), lambda a, q: a + F.coalesce(q["marks"].cast("double"), F.lit(0.0)))).cast("int")


def queue_position(jobs: DataFrame) -> DataFrame:
    """Position of each pending job: jobs in extraction and earlier pending ones come first."""
    waiting = jobs.where(F.col("status").isin("EXTRACTING", "PENDING")).withColumn("_late", F.col("status") != "EXTRACTING")
    return numbered(waiting, ["_late", "created_at", "id"], "position").where(F.col("status") == "PENDING").drop("_late")
