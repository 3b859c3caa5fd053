"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Bytes up to which a join side is broadcast, by the planner's guess and as measured.
GUESSED_BROADCAST, MEASURED_BROADCAST = 64 << 10, 2 << 20


def builder(app: str = "wayfold") -> SparkSession.Builder:
    """Session settings the jobs are written for; the master and sizes are the caller's."""
    return (SparkSession.builder.appName(app)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.autoBroadcastJoinThreshold", str(GUESSED_BROADCAST))
            .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(MEASURED_BROADCAST))
            # Plans have thousands of column expressions; recording a call site for each would
            # dominate the time to build them.
            .config("spark.python.sql.dataFrameDebugging.enabled", "false"))


def measured_broadcasts(spark: SparkSession) -> SparkSession:
    """Joins broadcast a side that was measured, not one that was guessed small.

    The planner guesses from file sizes: a column of rising keys takes 1.5 bytes a row, and rows that
    ``explode`` adds don't count, so a guess of some megabytes can be a gigabyte on the driver. What
    is guessed larger than a dimension of a few thousand rows is shuffled; adaptive execution then
    knows the rows and still broadcasts the sides that are small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(GUESSED_BROADCAST))
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(MEASURED_BROADCAST))
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """All timestamps are UTC instants; local days always use an explicit zone argument."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch folder in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return named or current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it back.

    Iterative operators keep a short plan, a lost executor never restarts them from the first
    round, and the files' sizes tell the optimizer which sides are small enough to broadcast."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/wayfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
