"""The audit log as a stream: windowed counts, late and repeated rows, index upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.operators.graph import last_wins


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Audit rows as they arrive as Parquet files in folder."""
    return spark.readStream.schema(schema.AUDIT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(rows: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, action, n) of each window; rows later than `late` behind the newest are dropped. Works on batches, too."""
    timed = rows.where("timestamp is not null").withColumn("at", F.col("timestamp").cast("timestamp"))
    timed = timed.withColumn("action", F.lower(F.trim("action")))
    if rows.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "action", "n")


def deduplicated(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Each row once by its id; state is kept for `late` only."""
    timed = rows.where("timestamp is not null").withColumn("at", F.col("timestamp").cast("timestamp"))
    if not rows.isStreaming:
        return timed.dropDuplicates(["uuid"])
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["uuid"])


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last version that upsert_into wrote whole; no rows if there is none."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(jvm_path(path))] if fs.exists(jvm_path(path)) else []
    whole = [int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(jvm_path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/v{max(whole)}") if whole else spark.createDataFrame([], schema.AUDIT)


def upsert_into(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row per key in versions under path; a batch that is run again gives the
    same version."""

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch_", F.lit(n))
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        old = n - 1
        while old >= 0 and not fs.exists(jvm_path(f"{path}/v{old}/_SUCCESS")):
            old -= 1
        if old >= 0:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v{old}"))
        last_wins(rows, keys, [F.desc("timestamp"), F.desc("batch_"), F.desc("uuid")]).write.mode("overwrite").parquet(f"{path}/v{n}")

    return sink
