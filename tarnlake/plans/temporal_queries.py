"""Bitemporal queries over chunks and ingest_messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.functions.running import running
from tarnlake.operators import temporal
from tarnlake.session import read

MOMENT = "2023-01-01 00:00:00"
KNOWN = "2023-03-01 00:00:00"
TENANT = "karar_bulteni"


def _moment(text: str = MOMENT):  # noqa: ANN202
    return F.lit(text).cast("timestamp_ntz")


def _shown(column: str):  # noqa: ANN202
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _submissions(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["job_id", "tenant_id", "doc_id", "valid_from", "correction", "published_at", "received_at", "attempts"]
    return temporal.first_delivery(read(spark, sf, "ingest_messages").select(*columns, F.sha2("text", 256).alias("content_hash")))


def as_of_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks in force at a moment."""
    rows = temporal.as_of(read(spark, sf, "chunks"), _moment())
    return rows.select("tenant_id", "doc_id", "version", "chunk_id").distinct()


def current_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose period is open."""
    return temporal.current(read(spark, sf, "chunks")).select("tenant_id", "chunk_id").distinct()


def documents_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each tenant in force, newest first."""
    rows = temporal.current(temporal.versions_of(read(spark, sf, "chunks")))
    placed = running(rows, ["tenant_id"], F.date_trunc("week", "valid_from"), [F.desc("valid_from"), F.asc("doc_id")], descending=True)
    return placed.select("tenant_id", "doc_id", "version", "place")


def version_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Periods rebuilt from the starts of the versions."""
    rows = temporal.close_periods(temporal.versions_of(read(spark, sf, "chunks")).select("tenant_id", "doc_id", "version", "valid_from"))
    return rows.select("tenant_id", "doc_id", "version", _shown("valid_from"), _shown("valid_to"))


def overlap_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Versions that overlap another one, as stored and after every period is widened by four hundred days."""
    rows = temporal.versions_of(read(spark, sf, "chunks"))
    widened = rows.withColumn("valid_to", F.col("valid_to") + F.expr("INTERVAL 400 DAY"))
    found = temporal.overlaps(rows).select("tenant_id", "doc_id", "version", F.lit("as stored").alias("state"))
    return found.unionByName(temporal.overlaps(widened).select("tenant_id", "doc_id", "version", F.lit("widened").alias("state")))


def asof_join_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The version in force when each submission was published."""
    probes = _submissions(spark, sf).select("job_id", "tenant_id", "doc_id", "published_at")
    joined = temporal.as_of_join(probes, temporal.versions_of(read(spark, sf, "chunks")), "published_at")
    return joined.select("job_id", "tenant_id", "doc_id", "version")


def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    """Highest version of every submitted document, 0 where nothing is stored."""
    documents = read(spark, sf, "ingest_messages").select("tenant_id", "doc_id").distinct()
    stored = read(spark, sf, "chunks").groupBy("tenant_id", "doc_id").agg(F.max("version").alias("top"))
    return documents.join(stored, ["tenant_id", "doc_id"], "left").select("tenant_id", "doc_id", F.coalesce("top", F.lit(0)).cast("bigint").alias("latest"))


def retire_close(spark: SparkSession, sf: str) -> DataFrame:
    """All versions after one tenant's documents were retired at a moment."""
    rows = temporal.retire(temporal.versions_of(read(spark, sf, "chunks")), TENANT, _moment("2025-01-01 00:00:00"))
    return rows.select("tenant_id", "doc_id", "version", _shown("valid_from"), _shown("valid_to"))


def retire_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks after the first document of every tenant was retired at a moment."""
    chunks = read(spark, sf, "chunks").select("chunk_id", "tenant_id", "doc_id", "version", "valid_from", "valid_to").distinct()
    first = chunks.groupBy("tenant_id").agg(F.min("doc_id").alias("doc_id"))
    return temporal.retire_documents(chunks, first, _moment("2025-01-01 00:00:00")).select("chunk_id", "version", _shown("valid_from"), _shown("valid_to"))


def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of each submission in a linear history, by content hash."""
    return temporal.linear_outcomes(_submissions(spark, sf)).select("job_id", "tenant_id", "doc_id", "outcome")


def corpus_event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each tenant by kind: every outcome but unchanged is one."""
    rows = change_detection(spark, sf).filter(F.col("outcome") != "unchanged")
    return rows.groupBy("tenant_id", "outcome").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("doc_id").alias("n_docs"))


def corpus_changes_since(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each tenant that changed after a snapshot."""
    rows = read(spark, sf, "ingest_messages").filter(F.col("published_at") > _moment())
    return rows.groupBy("tenant_id").agg(F.count_distinct("doc_id").alias("changed"))


def bitemporal_two_axis(spark: SparkSession, sf: str) -> DataFrame:
    """What was known at one moment about another: the submission that then stood for each document."""
    rows = _submissions(spark, sf).withColumn("valid_from", F.coalesce("valid_from", "published_at"))
    w = Window.partitionBy("tenant_id", "doc_id", "valid_from").orderBy("published_at", "job_id")
    facts = rows.select(
        "tenant_id", "doc_id", "job_id", "valid_from", F.col("published_at").alias("recorded_at"), F.lead("published_at").over(w).alias("superseded_at")
    )
    known = facts.filter(temporal.covers("recorded_at", "superseded_at", _moment(KNOWN)) & (F.col("valid_from") <= _moment()))
    best = known.groupBy("tenant_id", "doc_id").agg(F.max_by("job_id", F.struct("valid_from", "recorded_at", "job_id")).alias("job_id"))
    return best


def correction_supersede(spark: SparkSession, sf: str) -> DataFrame:
    """Every correction with the submission published before it."""
    w = Window.partitionBy("tenant_id", "doc_id").orderBy("published_at", "job_id")
    rows = _submissions(spark, sf).select("tenant_id", "doc_id", "job_id", "correction", F.lag("job_id").over(w).alias("supersedes"))
    return rows.filter("correction").select("tenant_id", "doc_id", "job_id", "supersedes")


def ingest_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Strict ingestion of all submissions: outcomes by tenant."""
    rows = _submissions(spark, sf).select(
        "tenant_id", "doc_id", "job_id", F.unix_micros(F.col("published_at").cast("timestamp")).alias("published"),
        F.unix_micros(F.col("valid_from").cast("timestamp")).alias("valid_from"), "correction", "content_hash",
    )
    return temporal.ingest(rows).groupBy("tenant_id", "outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid_to").isNotNull()).alias("closed"))


def chunk_id_format(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk ids spelled from document, version and ordinal, with those that differ."""
    rows = read(spark, sf, "chunks").distinct()
    made = F.format_string("%s:v%d:chunk_%04d", F.col("doc_id"), F.col("version"), F.col("ordinal"))
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(made != F.col("chunk_id")).alias("n_differ"))


def queries() -> dict:
    listed = (
        as_of_snapshot, current_chunks, documents_in_force, version_chain, overlap_violations, asof_join_versions, latest_version, retire_close, retire_chunks,
        change_detection, corpus_event_log, corpus_changes_since, bitemporal_two_axis, correction_supersede, ingest_outcomes, chunk_id_format,
    )
    return {f.__name__: f for f in listed}


_VERSIONS = "(SELECT DISTINCT tenant_id, doc_id, version, valid_from, valid_to FROM chunks)"
_JOBS = "(SELECT job_id, any_value(tenant_id) AS tenant_id, any_value(doc_id) AS doc_id, any_value(valid_from) AS valid_from, any_value(correction) AS correction, any_value(published_at) AS published_at, any_value(text) AS text FROM ingest_messages GROUP BY job_id)"
_LINEAR = f"""
    SELECT job_id, tenant_id, doc_id,
           CASE WHEN before IS NULL THEN 'created' WHEN correction THEN 'corrected' WHEN before = h THEN 'unchanged' ELSE 'amended' END AS outcome
    FROM (SELECT *, lag(h) OVER (PARTITION BY tenant_id, doc_id ORDER BY published_at, job_id) AS before
          FROM (SELECT *, sha256(text) AS h FROM {_JOBS}))"""
_T = "'%Y-%m-%d %H:%M:%S'"


def oracle_sql() -> dict[str, str]:
    moment, known = f"TIMESTAMP '{MOMENT}'", f"TIMESTAMP '{KNOWN}'"
    overlap = """SELECT tenant_id, doc_id, version, '{state}' AS state FROM {v} a WHERE EXISTS (
        SELECT 1 FROM {v} b WHERE a.tenant_id = b.tenant_id AND a.doc_id = b.doc_id AND a.version <> b.version
        AND (a.valid_to IS NULL OR b.valid_from < a.valid_to {plus}) AND (b.valid_to IS NULL OR a.valid_from < b.valid_to {plus}))"""
    return {
        "as_of_snapshot": f"SELECT DISTINCT tenant_id, doc_id, version, chunk_id FROM chunks WHERE valid_from <= {moment} AND (valid_to IS NULL OR valid_to > {moment})",
        "current_chunks": "SELECT DISTINCT tenant_id, chunk_id FROM chunks WHERE valid_to IS NULL",
        "documents_in_force": f"SELECT tenant_id, doc_id, version, row_number() OVER (PARTITION BY tenant_id ORDER BY valid_from DESC, doc_id) AS place FROM {_VERSIONS} WHERE valid_to IS NULL",
        "version_chain": f"SELECT tenant_id, doc_id, version, strftime(valid_from, {_T}) AS valid_from, strftime(lead(valid_from) OVER (PARTITION BY tenant_id, doc_id ORDER BY version), {_T}) AS valid_to FROM (SELECT DISTINCT tenant_id, doc_id, version, valid_from FROM chunks)",
        "overlap_violations": overlap.format(state="as stored", plus="", v=_VERSIONS) + " UNION ALL " + overlap.format(state="widened", plus="+ INTERVAL 400 DAY", v=_VERSIONS),
        "asof_join_versions": f"SELECT j.job_id, tenant_id, doc_id, v.version FROM {_JOBS} j JOIN {_VERSIONS} v USING (tenant_id, doc_id) WHERE v.valid_from <= j.published_at AND (v.valid_to IS NULL OR v.valid_to > j.published_at)",
        "latest_version": "SELECT tenant_id, doc_id, coalesce(max(c.version), 0)::BIGINT AS latest FROM (SELECT DISTINCT tenant_id, doc_id FROM ingest_messages) LEFT JOIN chunks c USING (tenant_id, doc_id) GROUP BY ALL",
        "retire_close": f"SELECT tenant_id, doc_id, version, strftime(valid_from, {_T}) AS valid_from, strftime(CASE WHEN tenant_id = '{TENANT}' AND valid_to IS NULL AND valid_from < TIMESTAMP '2025-01-01' THEN TIMESTAMP '2025-01-01' ELSE valid_to END, {_T}) AS valid_to FROM {_VERSIONS}",
        "retire_chunks": f"""WITH c AS (SELECT DISTINCT chunk_id, tenant_id, doc_id, version, valid_from, valid_to FROM chunks), f AS (SELECT tenant_id, min(doc_id) AS doc_id FROM chunks GROUP BY tenant_id)
            SELECT chunk_id, version, strftime(valid_from, {_T}) AS valid_from, strftime(CASE WHEN (tenant_id, doc_id) IN (FROM f) AND valid_to IS NULL AND valid_from < TIMESTAMP '2025-01-01' THEN TIMESTAMP '2025-01-01' ELSE valid_to END, {_T}) AS valid_to FROM c""",
        "change_detection": _LINEAR,
        "corpus_event_log": f"SELECT tenant_id, outcome, count(*) AS n_events, count(DISTINCT doc_id) AS n_docs FROM ({_LINEAR}) WHERE outcome <> 'unchanged' GROUP BY ALL",
        "corpus_changes_since": f"SELECT tenant_id, count(DISTINCT doc_id) AS changed FROM ingest_messages WHERE published_at > {moment} GROUP BY tenant_id",
        "bitemporal_two_axis": f"""
            WITH f AS (SELECT tenant_id, doc_id, job_id, coalesce(valid_from, published_at) AS vf, published_at AS rec FROM {_JOBS}),
            g AS (SELECT *, lead(rec) OVER (PARTITION BY tenant_id, doc_id, vf ORDER BY rec, job_id) AS sup FROM f)
            SELECT tenant_id, doc_id, job_id FROM (
                SELECT *, row_number() OVER (PARTITION BY tenant_id, doc_id ORDER BY vf DESC, rec DESC, job_id DESC) AS k
                FROM g WHERE rec <= {known} AND (sup IS NULL OR sup > {known}) AND vf <= {moment}) WHERE k = 1""",
        "correction_supersede": f"SELECT tenant_id, doc_id, job_id, supersedes FROM (SELECT *, lag(job_id) OVER (PARTITION BY tenant_id, doc_id ORDER BY published_at, job_id) AS supersedes FROM {_JOBS}) WHERE correction",
        "chunk_id_format": "SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE doc_id || ':v' || version || ':chunk_' || lpad(ordinal::VARCHAR, 4, '0') <> chunk_id) AS n_differ FROM (SELECT DISTINCT * FROM chunks) GROUP BY tenant_id",
    }
