"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings every query here assumes (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tarnlake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package by telling them where it lies.

    The path is added to the environment that Spark sends with every Python function, so it also
    reaches executors that share the file system; elsewhere the package must be installed.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (PACKAGE_ROOT, known) if p)


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only a local master without that setting
    (as in tests) gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tarnlake-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, rows_hint: int | None = None) -> DataFrame:
    """Give Python-heavy steps at least one partition per core when the input is a single small file.

    Round-robin repartitioning happens only where the scan has fewer partitions than the cluster has
    cores; a large input already has more splits and is left as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def small_side(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """The side of a join, marked for broadcast where a count shows at most ``most_rows`` rows; else left to the planner."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
