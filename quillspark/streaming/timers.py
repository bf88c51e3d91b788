"""Keyed state with timers: jobs that stall, and attempts that are handed in at the fifth warning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillspark.operators import grading
from quillspark.streaming.jobs import AUTO_SUBMIT, STALL_MINUTES

_STORE = "spark.sql.streaming.stateStore.providerClass"


def keep_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers asks for, and starts what finds the stores, also for a table."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _ = spark.streams.active


class _Stall(StatefulProcessor):
    """The time of a job's last update while it is in extraction, with one timer behind it."""

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long, due long")

    def _rest(self) -> None:
        if self.last.exists():
            due = self.last.get()[1]
            if due >= 0:
                self.handle.deleteTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows), ignore_index=True)
        seen["at"] = seen["updated_at"].map(lambda t: round(t.timestamp() * 1000))
        newest = seen.sort_values(["at", "status"]).iloc[-1]
        at = int(newest["at"])
        if self.last.exists() and at < self.last.get()[0]:
            return  # an update that was overtaken on its way
        self._rest()
        due = at + self.wait if newest["status"] == "EXTRACTING" else -1
        if due >= 0:
            self.handle.registerTimer(due)
        self.last.update((at, due))
        return
        yield  # a generator without rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, due = self.last.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.last.update((at, -1))
        stamp = lambda ms: pd.Timestamp(ms, unit="ms", tz="UTC")
        yield pd.DataFrame({"job_id": [key[0]], "status": ["FAILED"], "updated_at": [stamp(at)], "failed_at": [stamp(due)], "message": [f"no update for {self.wait // 60_000} minutes"]})

    def close(self) -> None:
        pass


def stalls(updates: DataFrame, minutes: int = STALL_MINUTES, late: str = "10 minutes") -> DataFrame:
    """(job_id, status, updated_at, failed_at, message): one row for each time that a job in extraction stalls.

    updates: a stream of (job_id, status, updated_at). Each update moves the job's one timer; a status other than
    EXTRACTING stops it, and an update older than the last changes nothing. Time is that of the events: a job stalls once
    updates of any job are `late` and `minutes` past its last one. A job that goes on after that can stall again. Updates
    without a time are left out; one without a status stops the timer.
    """
    keep_state(updates.sparkSession)
    rows = updates.where("updated_at is not null").select("job_id", F.coalesce("status", F.lit("")).alias("status"), "updated_at").withWatermark("updated_at", late)
    schema = f"job_id {updates.schema['job_id'].dataType.simpleString()}, status string, updated_at timestamp, failed_at timestamp, message string"
    return rows.groupBy("job_id").transformWithStateInPandas(_Stall(minutes), schema, "Append", "EventTime")


class _Warnings(StatefulProcessor):
    """The number of an attempt's warnings, and whether it is still running."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "warnings int, running boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, running = self.state.get() if self.state.exists() else (0, True)
        out = []
        for kind, event, details, at in pd.concat(list(rows), ignore_index=True).sort_values(["ts", "kind", "event_type", "details"], kind="stable")[["kind", "event_type", "details", "ts"]].itertuples(index=False, name=None):
            if kind != "WARNING":
                running = kind == "START"
                continue
            n += 1
            handed_in = running and n >= self.limit
            out.append((key[0], n, event, details, at, handed_in))
            running = running and not handed_in
        self.state.update((n, bool(running)))
        yield pd.DataFrame(out, columns=["attempt_id", "warning_number", "event_type", "details", "ts", "auto_submitted"])

    def close(self) -> None:
        pass


def proctored(events: DataFrame, limit: int = AUTO_SUBMIT) -> DataFrame:
    """(attempt_id, warning_number, event_type, details, ts, auto_submitted): the log of warnings as they come.

    events: (attempt_id, kind, event_type, details, ts), a stream or a table; kind is WARNING, or START or SUBMIT for
    what a student does. An attempt without either counts as running. The warning that meets the limit while the attempt
    runs hands it in, once: auto_submitted is true for that one alone. Rows of one micro-batch are taken in order of time
    (ties: by kind, type and details).
    """
    keep_state(events.sparkSession)
    schema = f"attempt_id {events.schema['attempt_id'].dataType.simpleString()}, warning_number int, event_type string, details string, ts timestamp, auto_submitted boolean"
    rows = events.select("attempt_id", "kind", F.coalesce("event_type", F.lit("TAB_SWITCH")).alias("event_type"), F.coalesce("details", F.lit("")).alias("details"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("attempt_id").transformWithStateInPandas(_Warnings(limit), schema, "Append", "None")


def handed_in(log: DataFrame, answers: DataFrame) -> DataFrame:
    """(attempt_id, submitted_at, score, status) of the attempts that a log of warnings hands in.

    Answers are graded as they stand, without a penalty for wrong ones; an attempt without answers scores 0.
    """
    gone = log.where("auto_submitted").select("attempt_id", F.col("ts").alias("submitted_at"))
    scores = grading.attempt_scores(answers.join(gone.select("attempt_id"), "attempt_id", "left_semi"))
    return gone.join(scores, "attempt_id", "left").select("attempt_id", "submitted_at", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("status", F.lit("EVALUATED")).alias("status"))


def proctor(events: DataFrame, answers: DataFrame, folder: str, checkpoint: str, limit: int = AUTO_SUBMIT) -> StreamingQuery:
    """Writes the log of a stream of events to folder/log and the attempts that it hands in, graded, to folder/attempts.

    Each micro-batch writes its own part of both, and writes the same part again if it is run again.
    """

    def write(log: DataFrame, number: int) -> None:
        log.persist()
        log.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        handed_in(log, answers).write.mode("overwrite").parquet(f"{folder}/attempts/batch={number}")
        log.unpersist()

    return proctored(events, limit).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
