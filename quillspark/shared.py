"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where none may be set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write `df` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quill_path = path
    return out


def materialize_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """`materialize`, in buckets of the key: a join on it moves only the other side. For this the table is in the catalog."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(f"spark_catalog.default.{name}")
    out = spark.table(f"spark_catalog.default.{name}")
    out.quill_path, out.quill_table = path, f"spark_catalog.default.{name}"
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a table made by `materialize` or `materialize_bucketed` that nothing reads any more."""
    path, name = getattr(df, "quill_path", None), getattr(df, "quill_table", None)
    if name:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in the order: by its place in a range of it, after the counts of the ranges before.

    No task sees more than its range; the driver gets one count for each range.
    """
    ranges = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], 0
    for r in sorted(ranges.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(before, "_part long, _start long")
    return ranges.withColumn("_part", part.cast("long")).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + place + 1).drop("_at", "_part", "_start")


#: Values of a list in `listed`, on average. What two lists give together is held at once, so it is a few thousand rows.
LIST = 128


def listed(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the values of each key (nulls too) as arrays of about LIST of them each."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / LIST).alias("_lists"))
    rows = df.join(counts, F.col(key) == F.col("_key")).withColumn("_list", F.pmod(F.xxhash64(value), "_lists"))
    # values inside structs, since a list leaves nulls out
    return rows.groupBy(key, "_list").agg(F.transform(F.collect_list(F.struct(F.col(value).alias("x"))), lambda v: v["x"]).alias(name)).drop("_list")


def dealt(lists: DataFrame) -> DataFrame:
    """Rows of lists dealt evenly over as many tasks as shuffles have, however few bytes they are: each stands for many."""
    return lists.repartition(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))
