"""Tables as snapshots: written aside, then swapped in; message publication; inline and file sources."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_NUMBERED = re.compile(r"SNAPSHOT-(\d{12})")


def _file_system(spark: SparkSession, folder: str):  # noqa: ANN202
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the pointer files, which are written once and never changed."""
    path, fs = _file_system(spark, folder)
    if not fs.exists(path(folder)):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path(folder)))
    return sorted(int(m[1]) for n in names if (m := _NUMBERED.fullmatch(n)))


def swap_in(tables: dict[str, DataFrame], folder: str) -> str:
    """Write all tables of one snapshot, then give it the next number in a single rename.

    Readers take the highest number, so they see the snapshot before or this one, all of it, at every moment
    and after every crash.  Of two writers at once the later one takes the number after.
    """
    name = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}/{table}")
    path, fs = _file_system(spark, folder)
    fresh = path(f"{folder}/NEXT-{name}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(json.dumps({"snapshot": name}).encode()))
    stream.close()
    for _ in range(100):
        numbered = path(f"{folder}/SNAPSHOT-{max(_numbers(spark, folder), default=0) + 1:012d}")
        if not fs.exists(numbered) and fs.rename(fresh, numbered):
            return name
    raise OSError(f"cannot point {folder} to the new snapshot")


def snapshot(spark: SparkSession, folder: str) -> str | None:
    """Name of the snapshot in force; None before the first."""
    numbers = _numbers(spark, folder)
    return json.loads(spark.read.text(f"{folder}/SNAPSHOT-{numbers[-1]:012d}").first()["value"])["snapshot"] if numbers else None


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    name = snapshot(spark, folder)
    if name is None:
        raise FileNotFoundError(f"{folder} holds no snapshot")
    return spark.read.parquet(f"{folder}/{name}/{table}")


def publish(messages: DataFrame, folder: str) -> None:
    """Append messages as JSON lines, one folder per tenant, for the stream to read."""
    messages.write.mode("append").partitionBy("tenant_id").json(folder)


def resolved(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Content of each message, inline or from its file, and the reason where there is none.

    ``messages``: job_id, payload (base64), source_uri.  ``files``: path, content.
    """
    bare = F.regexp_replace("source_uri", "^file:/+", "/")
    inline, named = F.col("payload").isNotNull(), F.col("source_uri").isNotNull()
    rows = messages.withColumn("_path", F.when(F.col("source_uri").startswith("file:"), bare))
    held = files.select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), F.col("content").alias("_content"))
    joined = rows.join(held, "_path", "left").drop("_path")
    body = F.try_to_binary("payload", F.lit("base64"))
    error = (
        F.when(inline & named, "two sources")
        .when(~inline & ~named, "no source")
        .when(inline & body.isNull(), "payload is not base64")
        .when(named & ~F.col("source_uri").startswith("file:"), "scheme not supported")
        .when(named & F.col("_content").isNull(), "file not found")
    )
    return joined.withColumn("error", error).withColumn("content", F.when(error.isNull(), F.coalesce(body, F.col("_content")))).drop("_content")
