"""Structured Streaming jobs: page ingestion, proctoring, progress, audit, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.relational import latest

#: Warnings at which a running attempt is handed in by itself, and minutes without progress after which a job has failed.
AUTO_SUBMIT, STALL_MINUTES = 5, 45


def page_rows(batches: DataFrame) -> DataFrame:
    """(job_id, page_number, raw_text, event_time, idempotency_key): pages of batch events, the last event of a page
    winning; of events with one key the first counts."""
    events = batches.select("job_id", "idempotency_key", "event_time", "pages")
    first = events.groupBy("job_id", "idempotency_key").agg(F.min_by("pages", "event_time").alias("pages"), F.min("event_time").alias("event_time"))
    rows = first.select("job_id", "idempotency_key", "event_time", F.explode("pages").alias("p")).select("job_id", F.col("p.page_number").alias("page_number"), F.col("p.raw_text").alias("raw_text"), "event_time", "idempotency_key")
    return latest(rows, ["job_id", "page_number"], ["event_time"])


def merge_pages(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored pages with those of a batch put in or replaced; an older event never replaces a newer one."""
    return latest(stored.unionByName(batch), ["job_id", "page_number"], ["event_time"])


#: Buckets of jobs in a log, runs that are merged to one, and how long a key is remembered (in event time).
BUCKETS, MERGED, REMEMBERED = 64, 8, "7 days"


def _bucket() -> Column:
    return F.pmod(F.xxhash64(F.col("job_id").cast("long")), F.lit(BUCKETS)).cast("int")


def _runs(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """The finished runs (first, last micro-batch) of a log that no larger one holds."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    found = [tuple(int(x) for x in p.getName()[4:].split("-")) for p in names if p.getName().startswith("run=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(r for r in found if not any(o[0] <= r[0] and r[1] <= o[1] for o in found if o != r))


def _write_run(rows: DataFrame, folder: str, first: int, last: int) -> None:
    rows.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/run={first}-{last}")


def _read_runs(spark: SparkSession, folder: str, runs: list[tuple[int, int]]) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(*(f"{folder}/run={a}-{b}" for a, b in runs)).drop("run")


def ingest(events: DataFrame, folder: str, checkpoint: str, remembered: str = REMEMBERED) -> StreamingQuery:
    """Adds the pages of each micro-batch to a log that `stored_pages` reads.

    Of events with one (job_id, idempotency_key) the first to come counts; keys are remembered for as long in event time
    as `remembered` says, and events that are later than that are dropped, so the state stays bounded. A micro-batch is
    one run of the log, parted by buckets of jobs. MERGED runs that follow each other are merged to one, and so many of
    those to a larger one: after n micro-batches a read opens (MERGED - 1) * log(n) runs at most, and of these only the
    buckets of its jobs. A micro-batch that is run again writes the same runs again; a run counts once it is whole.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        _write_run(page_rows(batch), folder, number, number)
        size = MERGED
        while (number + 1) % size == 0:
            parts = [r for r in _runs(spark, folder) if r[0] > number - size]
            if len(parts) > 1:
                _write_run(latest(_read_runs(spark, folder, parts).drop("bucket"), ["job_id", "page_number"], ["event_time"]), folder, parts[0][0], number)
                _clear(spark, folder, parts)
            size *= MERGED

    keyed = events.withWatermark("event_time", remembered).dropDuplicatesWithinWatermark(["job_id", "idempotency_key"])
    return keyed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _clear(spark: SparkSession, folder: str, runs: list[tuple[int, int]]) -> None:
    jvm = spark.sparkContext._jvm
    for a, b in runs:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/run={a}-{b}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_pages(spark: SparkSession, folder: str, jobs: list[int] | None = None) -> DataFrame:
    """The pages of a log, the last event of each page; of the given jobs only, whose buckets alone are read."""
    rows = _read_runs(spark, folder, _runs(spark, folder))
    if jobs is not None:
        wanted = spark.range(1).select(F.explode(F.array(*(F.lit(int(j)).cast("long") for j in jobs))).alias("job_id")).select(_bucket().alias("b"))
        rows = rows.where(F.col("bucket").isin([r.b for r in wanted.distinct().collect()]) & F.col("job_id").isin(list(jobs)))
    return latest(rows.drop("bucket"), ["job_id", "page_number"], ["event_time"])


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """Writes the stored pages of a log as the one run of another folder."""
    runs = _runs(spark, folder)
    _write_run(stored_pages(spark, folder), to, runs[0][0], runs[-1][1])


def replace_jobs(stored: DataFrame, final: DataFrame) -> DataFrame:
    """Stored rows with those of each job in a final payload replaced as a whole, pages that it leaves out included."""
    return stored.join(final.select("job_id").distinct(), "job_id", "left_anti").select(*stored.columns).unionByName(final.select(*stored.columns))


def missing_pages(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """(job_id, page_number) that a resumed job still has to deliver."""
    wanted = jobs.select("job_id", F.explode(F.sequence(F.lit(1), "total_pages")).alias("page_number"))
    return wanted.join(stored, ["job_id", "page_number"], "left_anti")


def progress(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Processed pages of each job, never fewer than before, and their share in percent."""
    n = stored.groupBy("job_id").agg(F.max("page_number").alias("last"))
    done = F.greatest(F.col("processed_pages"), F.coalesce("last", F.lit(0)))
    return jobs.join(n, "job_id", "left").select("job_id", done.alias("processed_pages"), F.when(F.col("total_pages") > 0, F.floor(done / F.col("total_pages") * 100)).otherwise(0).alias("percent"))


def stalled(jobs: DataFrame, as_of: Column, minutes: int = STALL_MINUTES) -> DataFrame:
    """Jobs with those FAILED that are in extraction and had no update for too long."""
    late = (F.col("status") == "EXTRACTING") & (F.col("updated_at") < as_of - F.make_interval(mins=F.lit(minutes)))
    return jobs.withColumn("status", F.when(late, "FAILED").otherwise(F.col("status")))


def warnings(events: DataFrame, limit: int = AUTO_SUBMIT) -> DataFrame:
    """(attempt_id, warnings, submitted) as events arrive (update mode); submitted once the limit is met.

    events: a stream of (attempt_id, ...).
    """
    n = F.count("*")
    return events.groupBy("attempt_id").agg(n.alias("warnings"), (n >= limit).alias("submitted"))


def durations(jobs: DataFrame) -> DataFrame:
    """Jobs with `seconds` from start to end (or the last update), and `took` as 1h 2m 3s without leading zeros."""
    seconds = (F.unix_timestamp(F.coalesce("completed_at", "updated_at")) - F.unix_timestamp("started_at")).cast("long")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("long").cast("string"), F.lit(unit)))
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return jobs.withColumn("seconds", seconds).withColumn("took", F.when(seconds == 0, "0s").when(seconds > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s"))))


def event_counts(events: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "2 hours", keys: tuple = ("event_type",)) -> DataFrame:
    """Counts and sums by window and keys; rows later than `late` are dropped by a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def last_answers(answers: DataFrame) -> DataFrame:
    """The last write of each answer, whatever order a client that was offline sends them in."""
    return latest(answers, ["attempt_id", "question_id"], ["written_at"])


def first_submit(submits: DataFrame) -> DataFrame:
    return submits.groupBy("attempt_id").agg(F.min("submitted_at").alias("submitted_at"))


def review_status(history: DataFrame) -> DataFrame:
    """(question_id, status, revision): the fold of a question's actions; a refusal without a comment does not count."""
    needs = F.col("action").isin("SEND_FOR_CORRECTION", "REJECT") & (F.trim(F.coalesce("comment", F.lit(""))) == "")
    known = F.create_map(*(F.lit(x) for x in ("APPROVE", "APPROVED", "SEND_FOR_CORRECTION", "CORRECTION_REQUIRED", "REJECT", "REJECTED", "RESUBMIT", "SUBMITTED")))
    valid = history.where(~needs).withColumn("status", F.try_element_at(known, F.col("action"))).where("status is not null")
    return valid.groupBy("question_id").agg(F.max_by("status", F.struct("created_at", "id")).alias("status"), (1 + F.count_if(F.col("action") == "RESUBMIT")).alias("revision"))


def grant(old: DataFrame, users: DataFrame, capability: str) -> DataFrame:
    """Grants with those of `users` added; those held before stay as they are."""
    new = users.select(F.col("id").alias("user_id"), F.lit(capability).alias("capability"))
    return old.unionByName(new.join(old, ["user_id", "capability"], "left_anti").select(*old.columns))


def revoke(old: DataFrame, users: DataFrame, capability: str) -> DataFrame:
    gone = users.select(F.col("id").alias("user_id"), F.lit(capability).alias("capability"))
    return old.join(gone, ["user_id", "capability"], "left_anti")


def requeue(jobs: DataFrame) -> DataFrame:
    failed = F.col("status") == "FAILED"
    return jobs.withColumn("error", F.when(~failed, F.col("error"))).withColumn("status", F.when(failed, "PENDING").otherwise(F.col("status")))


def file_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A landing folder of parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)
