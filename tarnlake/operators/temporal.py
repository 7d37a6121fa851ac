"""Bitemporal tables: half-open periods on valid and transaction time, nothing is deleted.

A null end means open.  All predicates are plain column expressions, so they reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.folds import fold_groups


def covers(start: str, end: str, moment: Column) -> Column:
    """start <= moment < end, a null end being open."""
    return (F.col(start) <= moment) & (F.col(end).isNull() | (F.col(end) > moment))


def as_of(rows: DataFrame, valid_at: Column, known_at: Column | None = None) -> DataFrame:
    """Rows in force at a moment, as known at another one (where the table records transaction time)."""
    kept = rows.filter(covers("valid_from", "valid_to", valid_at))
    return kept if known_at is None else kept.filter(covers("recorded_at", "superseded_at", known_at))


def current(rows: DataFrame) -> DataFrame:
    """Open rows; not the same as those in force now, where a later change is already recorded."""
    kept = rows.filter(F.col("valid_to").isNull())
    return kept.filter(F.col("superseded_at").isNull()) if "superseded_at" in rows.columns else kept


def versions_of(chunks: DataFrame) -> DataFrame:
    """One row per version of each document of a chunk table."""
    return chunks.select("tenant_id", "doc_id", "version", "valid_from", "valid_to").distinct()


def close_periods(versions: DataFrame, keys: Sequence[str] = ("tenant_id", "doc_id")) -> DataFrame:
    """Each version ends where the next one starts."""
    w = Window.partitionBy(*keys).orderBy("version")
    return versions.withColumn("valid_to", F.lead("valid_from").over(w))


def overlaps(versions: DataFrame, keys: Sequence[str] = ("tenant_id", "doc_id")) -> DataFrame:
    """Versions whose period shares a moment with another version's, whichever of them starts first.

    A version reaches into a later one if it reaches into the next, and lies in an earlier one if the latest end
    before it does.  Superseded rows and empty periods are passed over.
    """
    live = versions.filter(F.col("superseded_at").isNull()) if "superseded_at" in versions.columns else versions
    live = live.filter(F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))
    w = Window.partitionBy(*keys).orderBy("valid_from", "version")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    reaches = F.lead("valid_from").over(w) < F.coalesce("valid_to", F.lead("valid_from").over(w) + F.expr("INTERVAL 1 SECOND"))
    within = F.coalesce(F.bool_or(F.col("valid_to").isNull()).over(earlier), F.lit(False)) | (F.max("valid_to").over(earlier) > F.col("valid_from"))
    marked = live.withColumns({"_reaches": reaches, "_within": within})
    return marked.filter(F.coalesce("_reaches", F.lit(False)) | F.coalesce("_within", F.lit(False))).drop("_reaches", "_within")


def retire(versions: DataFrame, tenant: str, moment: Column) -> DataFrame:
    """Close the open versions of a tenant; others stay as they are."""
    hit = (F.col("tenant_id") == tenant) & F.col("valid_to").isNull() & (F.col("valid_from") < moment)
    return versions.withColumn("valid_to", F.when(hit, moment).otherwise(F.col("valid_to")))


def retire_documents(rows: DataFrame, documents: DataFrame, moment: Column) -> DataFrame:
    """Close the open rows of named documents; works on a document table and on its chunks alike.

    ``documents``: tenant_id, doc_id.  Rows of other documents, closed rows and rows that start later stay as they are.
    """
    named = documents.select("tenant_id", "doc_id", F.lit(True).alias("_named")).distinct()
    hit = F.coalesce("_named", F.lit(False)) & F.col("valid_to").isNull() & (F.col("valid_from") < moment)
    return rows.join(named, ["tenant_id", "doc_id"], "left").withColumn("valid_to", F.when(hit, moment).otherwise(F.col("valid_to"))).drop("_named")


def retired(rows: DataFrame, documents: DataFrame, moment: Column) -> DataFrame:
    """For each named document whether there is anything to retire: tenant_id, doc_id, retired."""
    current_ = rows.filter(F.col("valid_to").isNull() & (F.col("valid_from") < moment)).select("tenant_id", "doc_id", F.lit(True).alias("retired")).distinct()
    named = documents.select("tenant_id", "doc_id").distinct()
    return named.join(current_, ["tenant_id", "doc_id"], "left").withColumn("retired", F.coalesce("retired", F.lit(False)))


def as_of_join(probes: DataFrame, versions: DataFrame, moment: str, keys: Sequence[str] = ("tenant_id", "doc_id")) -> DataFrame:
    """Each probe with the version in force at its moment: an equi-join with a range as residual."""
    v = versions.select(*keys, "version", "valid_from", "valid_to")
    return probes.join(v, list(keys)).filter(covers("valid_from", "valid_to", F.col(moment)))


def first_delivery(messages: DataFrame, job: str = "job_id") -> DataFrame:
    """One row per submission: re-deliveries differ in receipt only, so the earliest stands for all.

    Deduplicated by the submission's id with partial aggregation before the shuffle; give hashes of long
    texts instead of the texts, so that the shuffle stays small.
    """
    others = [c for c in messages.columns if c not in (job, "received_at", "attempts")]
    return messages.groupBy(job).agg(*[F.first(c).alias(c) for c in others], F.min("received_at").alias("received_at"), F.max("attempts").alias("attempts"))


def linear_outcomes(submissions: DataFrame) -> DataFrame:
    """created, unchanged, corrected or amended, each submission compared with the one published before it."""
    w = Window.partitionBy("tenant_id", "doc_id").orderBy("published_at", "job_id")
    before = F.lag("content_hash").over(w)
    outcome = (
        F.when(before.isNull(), "created")
        .when(F.col("correction"), "corrected")
        .when(before == F.col("content_hash"), "unchanged")
        .otherwise("amended")
    )
    return submissions.withColumn("outcome", outcome)


@dataclass
class _Document:
    rows: list[dict] = field(default_factory=list)
    versions: int = 0


def ingest(submissions: DataFrame) -> DataFrame:
    """Strict ingestion of submissions in the order of publication: the full bitemporal table.

    A submission with the current content changes nothing; a correction supersedes the current row and
    takes over its period; an ordinary one must start strictly later than the current row, whose period
    it closes; anything else is rejected.  ``submissions``: tenant_id, doc_id, job_id, published (us),
    valid_from (us, may be null), correction, content_hash.

    Result: tenant_id, doc_id, version, job_id, outcome, valid_from, valid_to, recorded_at,
    superseded_at (microseconds, null: open or, for outcomes that store nothing, unset).
    """

    def start(_: tuple) -> _Document:
        return _Document()

    def step(doc: _Document, row: tuple) -> Iterator[tuple]:
        tenant, name, job, published, valid_from, correction, content = row
        now = next((r for r in reversed(doc.rows) if r["valid_to"] is None and r["superseded_at"] is None), None)
        start_at = published if valid_from is None else valid_from
        if now is None and correction:
            outcome = "rejected"
        elif now is None:
            outcome = "created"
        elif now["content"] == content and not correction:
            outcome = "unchanged"
        elif correction:
            outcome, start_at = "corrected", now["valid_from"]
            now["superseded_at"] = published
        elif start_at <= now["valid_from"]:
            outcome = "rejected"
        else:
            outcome = "amended"
            now["valid_to"] = start_at
        if outcome in ("created", "corrected", "amended"):
            doc.versions += 1
            doc.rows.append({"version": doc.versions, "job": job, "outcome": outcome, "valid_from": start_at, "valid_to": None, "recorded_at": published, "superseded_at": None, "content": content})
            return iter(())
        return iter([(tenant, name, None, job, outcome, None, None, published, None)])

    def finish(doc: _Document, key: tuple) -> Iterator[tuple]:
        for r in doc.rows:
            yield (*key, r["version"], r["job"], r["outcome"], r["valid_from"], r["valid_to"], r["recorded_at"], r["superseded_at"])

    text, big, small = ("string", pa.string()), ("bigint", pa.int64()), ("int", pa.int32())
    schema = [
        ("tenant_id", *text), ("doc_id", *text), ("version", *small), ("job_id", *text), ("outcome", *text),
        ("valid_from", *big), ("valid_to", *big), ("recorded_at", *big), ("superseded_at", *big),
    ]
    rows = submissions.select("tenant_id", "doc_id", "job_id", "published", "valid_from", "correction", "content_hash")
    return fold_groups(rows, ["tenant_id", "doc_id"], ["published", "job_id"], schema, start, step, finish)
