"""Streaming ingestion: validated submissions, dead letters, job states, idempotent batches.

A stream of JSON submissions is read with a closed schema; rows that break a rule go to the dead-letter
folder with the reason, the rest are written once per batch.  Batches are named by their id, so a batch
that is run again after a failure overwrites itself instead of adding rows twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = (
    "job_id string, tenant_id string, doc_id string, filename string, media_type string, lang string, title string, text string, "
    "payload string, source_uri string, valid_from timestamp, correction boolean, published_at timestamp, received_at timestamp, attempts int"
)
MOST_BYTES = 768 * 1024
MOST_ATTEMPTS = 3


def problem() -> Column:
    """First rule a submission breaks; null where it breaks none."""
    inline = F.coalesce(F.length("text") > 0, F.lit(False)) | F.col("payload").isNotNull()
    return (
        F.when(F.col("_corrupt").isNotNull(), "malformed")
        .when(F.col("job_id").isNull() | F.col("tenant_id").isNull() | F.col("doc_id").isNull(), "no identity")
        .when(inline & F.col("source_uri").startswith("file:"), "two sources")
        .when(~inline & F.col("source_uri").isNull(), "no source")
        .when(F.col("payload").isNotNull() & F.try_to_binary("payload", F.lit("base64")).isNull(), "payload is not base64")
        .when(F.octet_length(F.coalesce("text", F.lit(""))) > MOST_BYTES, "too large")
        .when(F.coalesce("attempts", F.lit(1)) > MOST_ATTEMPTS, "too many attempts")
    )


def submissions(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The stream of submissions with column problem."""
    rows = (
        spark.readStream.schema(f"{SCHEMA}, _corrupt string")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )
    return rows.withColumn("text", F.coalesce("text", F.decode(F.try_to_binary("payload", F.lit("base64")), "UTF-8"))).withColumn("problem", problem())


def start(stream: DataFrame, out: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run over what is there and stop: accepted rows, dead letters and job states under ``out``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            good = batch.filter(F.col("problem").isNull()).drop("problem", "_corrupt", "payload")
            good.dropDuplicates(["job_id"]).write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
            bad = batch.filter(F.col("problem").isNotNull()).select("job_id", "tenant_id", "doc_id", "problem", "_corrupt")
            bad.write.mode("overwrite").parquet(f"{out}/dead/batch={number}")
            states = batch.select("job_id", "attempts", F.when(F.col("problem").isNull(), "accepted").otherwise("failed").alias("state"), F.col("problem").alias("error"), "received_at")
            states.filter(F.col("job_id").isNotNull()).write.mode("overwrite").parquet(f"{out}/jobs/batch={number}")
            if on_batch:
                on_batch(good, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(spark: SparkSession, out: str) -> DataFrame:
    """Latest state of every job, with the attempts it took."""
    rows = spark.read.parquet(f"{out}/jobs")
    return rows.groupBy("job_id").agg(F.max_by("state", F.struct("received_at", "batch")).alias("state"), F.max_by("error", F.struct("received_at", "batch")).alias("error"), F.max("attempts").alias("attempts"))


def accepted(spark: SparkSession, out: str) -> DataFrame:
    """Accepted submissions of all batches, each once."""
    return spark.read.parquet(f"{out}/accepted").drop("batch").dropDuplicates(["job_id"])
