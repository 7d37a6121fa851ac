"""Which guarantee is in force, and what each request may be told under it.

Facts are joined to the requests first (the calibration that applies, what changed in the corpus since, whether the
drift monitor has alarmed); the verdict is then one chain of conditions.  Calibrations, keys and changed documents
are counted before they are joined, so no join multiplies requests.

Defined results: a request without a certified calibration for its own tenant and its very alpha is refused, never
served under another one's threshold; null facts count as not given; of several runs at one moment the one with the
greater id applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ("calibration_id", "threshold", "created_at", "corpus_known_at")


def calibrations_in_force(calibrations: DataFrame) -> DataFrame:
    """The latest certified run of every tenant and alpha: tenant_id, alpha and the columns of RUN."""
    certified = calibrations.filter(F.col("certified") & F.col("tenant_id").isNotNull() & F.col("alpha").isNotNull())
    last = F.max_by(F.struct(*RUN), F.struct("created_at", "calibration_id")).alias("r")
    return certified.groupBy("tenant_id", "alpha").agg(last).select("tenant_id", "alpha", "r.*")


def with_facts(runs: DataFrame, changes: DataFrame, now: Column, max_age_hours: float) -> DataFrame:
    """Runs with stale (older than the age allowed) and n_changed, the documents that changed since the run saw the corpus.

    ``changes``: tenant_id, doc_id, published_at.
    """
    latest = changes.groupBy("tenant_id", "doc_id").agg(F.max("published_at").alias("at"))  # a document changed since if its last change did
    known = runs.filter(F.col("corpus_known_at").isNotNull()).select("calibration_id", "tenant_id", "corpus_known_at")
    counts = known.join(latest, "tenant_id").filter(F.col("at") > F.col("corpus_known_at")).groupBy("calibration_id").agg(F.count(F.lit(1)).alias("n_changed"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = runs.join(counts, "calibration_id", "left").withColumn("n_changed", F.coalesce("n_changed", F.lit(0)))
    return rows.withColumn("stale", age > F.lit(int(max_age_hours * 3_600_000_000)))


def status(runs: DataFrame, alarms: DataFrame) -> DataFrame:
    """For every run whether its guarantee is in force, and the first reason why not: stale, corpus changed, drift.

    ``runs`` as from with_facts; ``alarms``: calibration_id, alarmed (any row of a monitor).
    """
    fired = alarms.groupBy("calibration_id").agg(F.bool_or("alarmed").alias("alarmed"))
    reason = F.when(F.col("stale"), "stale").when(F.col("n_changed") > 0, "corpus_changed").when(F.coalesce("alarmed", F.lit(False)), "drift_detected").otherwise("")
    return runs.join(fired, "calibration_id", "left").withColumn("reason", reason).withColumn("in_force", F.col("reason") == "").drop("alarmed")


def decided(requests: DataFrame, runs: DataFrame, alarms: DataFrame) -> DataFrame:
    """Requests with gate, decision, reason, degraded and guaranteed.

    ``requests``: request_id, tenant_id, alpha, statistic, n_claims, n_kept (claims not removed), edited (a claim was removed or flagged),
    unsupported (a claim that is returned as it is lacks support).  ``runs`` as from with_facts.  ``alarms``: calibration_id,
    request_id, alarmed, where a request that tips the monitor over is itself alarmed.
    """
    rows = requests.join(runs, ["tenant_id", "alpha"], "left").join(alarms.select("calibration_id", "request_id", "alarmed"), ["calibration_id", "request_id"], "left")
    gate = (
        F.when(F.col("calibration_id").isNull(), "no calibration")
        .when(F.col("stale"), "stale calibration")
        .when(F.col("n_changed") > 0, "corpus changed")
        .when((F.coalesce("n_claims", F.lit(0)) > 0) & F.coalesce("alarmed", F.lit(False)), "drift alarm")
        .when(F.coalesce("n_kept", F.lit(0)) == 0, "no claim left")
        .when(F.coalesce("statistic", F.lit(1.0)) > F.col("threshold"), "risk too high")
        .otherwise("served")
    )
    served = F.col("gate") == "served"
    void = F.col("gate").isin("no calibration", "stale calibration", "corpus changed", "drift alarm")
    flags = F.coalesce("edited", F.lit(False))
    return (
        rows.withColumn("gate", gate)
        .withColumn("decision", F.when(served & flags, "answer_with_flags").when(served, "answer").otherwise("abstain"))
        .withColumn(
            "reason",
            F.when(F.col("gate").isin("no calibration", "stale calibration"), "stale_calibration").when(void, "drift_detected").when(served, "").otherwise("insufficient_evidence"),
        )
        .withColumn("degraded", void)
        .withColumn("guaranteed", ~void & ~(served & F.coalesce("unsupported", F.lit(False))))
    )


def stage_outcome(retrieval_ok: Column, n_chunks: Column, generation_ok: Column, verifier_ok: Column, risk_ok: Column) -> Column:
    """What becomes of a request whose stages failed: a struct of outcome, reason and degraded; the first failed stage decides.

    Without a draft there is nothing to refuse or to serve, so that alone is an error.
    """
    ok = lambda c: F.coalesce(c, F.lit(False))
    named = lambda outcome, reason, degraded: F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"), F.lit(degraded).alias("degraded"))
    return (
        F.when(~ok(retrieval_ok), named("abstain", "out_of_corpus", True))
        .when(F.coalesce(n_chunks, F.lit(0)) == 0, named("abstain", "out_of_corpus", False))
        .when(~ok(generation_ok), named("error", "generation_failed", True))
        .when(~ok(verifier_ok), named("abstain", "insufficient_evidence", True))
        .when(~ok(risk_ok), named("abstain", "stale_calibration", True))
        .otherwise(named("decided", "", False))
    )


def tenant_of_key(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests with the tenant of their API key; null where the key is unknown.

    ``keys``: key_hash (SHA-256 in hex), tenant_id.  Keys themselves are compared nowhere and dropped; of a key that two tenants
    claim neither gets the request.
    """
    owners = keys.filter(F.col("key_hash").isNotNull()).groupBy(F.lower("key_hash").alias("_hash")).agg(F.min("tenant_id").alias("tenant_id"), F.count_distinct("tenant_id").alias("_n"))
    rows = requests.drop("tenant_id").withColumn("_hash", F.sha2(F.col("api_key"), 256)).drop("api_key")
    return rows.join(owners.filter(F.col("_n") == 1).drop("_n"), "_hash", "left").drop("_hash")


def drift_alarms(statistics: DataFrame, monitored: DataFrame) -> DataFrame:
    """Alarms per request from a monitored stream: calibration_id, request_id, alarmed.

    ``statistics``: key (the calibration), seq, request_id; ``monitored``: key, seq, alarmed.
    """
    each = monitored.join(statistics.select("key", "seq", "request_id"), ["key", "seq"])
    return each.select(F.col("key").alias("calibration_id"), "request_id", "alarmed")


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with seq, their place within the key; the order in which a monitor sees them."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("bigint"))
