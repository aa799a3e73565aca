"""Session factory and the few session-wide decisions every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CODELOOM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names.

    A session on one machine (a test, the bench) without one gets a folder of its own, removed at the end; on a cluster a
    missing folder is an error, as one on a single machine is lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(named or own)
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the files: survives lost executors, ends the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return _forgetful(df.checkpoint(eager=True))


def _forgetful(df: DataFrame) -> DataFrame:
    """A checkpoint without what the optimizer remembers of the plan it came from.

    In a loop that joins a state with itself, the constraints and the estimated sizes (products of those of the round
    before) double in length each round, until planning takes longer than the work. Partitioning, order and a size of
    ordinary length are kept.
    """
    spark = df.sparkSession
    jvm, session = spark._jvm, spark._jsparkSession
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return df
    none = jvm.scala.Option.apply(None)
    stats = plan.computeStats()
    known = jvm.scala.Option.apply(stats) if int(stats.sizeInBytes()).bit_length() < 63 else none
    scan = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, known, none
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, scan), spark)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work at least one partition per core.

    A scan of a large table already has more partitions than cores and is left as it is; only a table of a few
    files, which would otherwise run on a few cores, is shuffled round-robin.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, spread over at least one partition per core.

    The number of partitions is fixed, so that row work that follows isn't put into a few tasks because the bytes are few.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys).dropDuplicates(keys)
