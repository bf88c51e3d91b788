"""Scans and sinks: tables, student and teacher sheets, benchmark runs, JSON trees, dumps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.school import class_assignment, division, phone, standard


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table, its zoneless times as TIMESTAMP (which watermarks need)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in df.schema))


def with_parent(child: DataFrame, parent: DataFrame, key: str, parent_key: str, nullable: bool) -> DataFrame:
    """A foreign key join: left for a nullable key, inner otherwise."""
    return child.join(parent.withColumnRenamed(parent_key, key), key, "left" if nullable else "inner")


def with_children(parent: DataFrame, child: DataFrame, key: str, child_key: str, name: str, order: list[str]) -> DataFrame:
    """Children of each parent as an ordered array column; empty where there are none."""
    rest = [c for c in child.columns if c != child_key and c not in order]
    kept = child.groupBy(F.col(child_key).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))
    return parent.join(kept, key, "left").withColumn(name, F.coalesce(name, F.array()))


#: Header words and the columns they name, tried in this order (fixed values).
STUDENT_HEADERS = (("gr", "gr_number"), ("roll", "roll_number"), ("mobile", "phone"), ("phone", "phone"), ("standard", "standard"), ("class", "standard"), ("division", "division"), ("section", "division"), ("name", "full_name"))
#: `name` comes before `class teacher`, and so does `subject`.
TEACHER_HEADERS = (("name", "full_name"), ("subject", "subject"), ("class", "class_teacher"), ("mobile", "phone"), ("phone", "phone"), ("email", "email"))


def header_map(headers: list[str], words: tuple) -> dict[str, str]:
    """Each header with the column it names; the first header for a column counts."""
    out: dict[str, str] = {}
    for h in headers:
        low = re.sub(r"[^a-z]+", " ", h.lower())
        name = next((column for word, column in words if word in low), None)
        if name and name not in out.values():
            out[h] = name
    return out


def read_sheet(spark: SparkSession, path: str, words: tuple = STUDENT_HEADERS) -> DataFrame:
    """A CSV export of a class list: known columns as strings, `row` in file order, empty rows left out."""
    raw = spark.read.csv(path, header=True, multiLine=True)
    names = header_map(raw.columns, words)
    rows = raw.select(*(F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")).alias(c) for h, c in names.items()), F.monotonically_increasing_id().alias("row"))
    return rows.where(F.coalesce(*(F.col(c) for c in names.values())).isNotNull())


def students(sheet: DataFrame) -> DataFrame:
    return sheet.withColumn("standard", standard(F.col("standard"))).withColumn("division", division(F.col("division"))).withColumn("phone", phone(F.col("phone")))


def teachers(sheet: DataFrame) -> DataFrame:
    return sheet.withColumn("phone", phone(F.col("phone"))).withColumn("assignment", class_assignment(F.col("class_teacher")))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark runs from JSON files of one run each, with the file slug of their model."""
    return spark.read.json(path, multiLine=True).withColumn("slug", F.translate("model", ":.", "__"))


def json_tree(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """(job_id, json): a job with its pages in order."""
    listed = pages.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("page_number", *(c for c in pages.columns if c not in ("job_id", "page_number"))))).alias("pages"))
    return jobs.join(listed, "job_id", "left").select("job_id", F.to_json(F.struct(*jobs.columns, "pages")).alias("json"))


def dump(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Every table as JSON lines, and its rows as read back."""
    out = {}
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
        out[name] = df.sparkSession.read.text(f"{folder}/{name}").count()
    return out


def extractor(handwritten: Column, has_text: Column, forced: str | None = None) -> Column:
    """Which extractor a document goes to."""
    return F.lit(forced) if forced else F.when(handwritten | ~has_text, "vision").otherwise("digital")


def unknown_to_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests without a cached result; keys are hashes of file, page and prompt."""
    key = F.sha2(F.concat_ws(":", "file", F.col("page").cast("string"), "prompt"), 256)
    return requests.withColumn("cache_key", key).join(cache, "cache_key", "left_anti")
