"""Drift, decision and monitoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import decisions as decisions_of
from tarnlake.operators import drift, monitoring, risk
from tarnlake.session import read

BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)
LIVE_FROM = "2024-01-06 00:00:00"
SNAPSHOT, RUN_AT, NOW = "2027-01-01 00:00:00", "2027-01-01 00:00:00", "2027-02-11 00:00:00"
ALPHA, DELTA, MAX_AGE_HOURS, ALARM = 0.3, 0.05, 24 * 30, 1.02


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as statistics in [0, 1]: the first days calibrate, the rest is live."""
    rows = _events(spark, sf)
    return rows.select(
        F.col("event_type").alias("key"),
        F.col("event_id").alias("seq"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("statistic"),
        (F.col("ts") < F.lit(LIVE_FROM).cast("timestamp_ntz")).alias("is_calibration"),
    )


def theta_uniform(spark: SparkSession, sf: str) -> DataFrame:
    """Hash-uniform number of every event."""
    return _events(spark, sf).select("event_id", F.round(drift.uniform_of(F.col("event_type"), F.col("event_id")), 9).alias("theta"))


def drift_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """p-value, log wealth and alarm after every live event of each type."""
    rows = drift.monitored(_stream(spark, sf))
    return rows.select("key", "seq", F.round("p_value", 9).alias("p_value"), (F.round("log_wealth", 6) + 0.0).alias("log_wealth"), "alarmed")


def conformal_p(spark: SparkSession, sf: str) -> DataFrame:
    """The p-values alone."""
    return drift.monitored(_stream(spark, sf)).select("key", "seq", F.round("p_value", 9).alias("p_value"))


def drift_state(spark: SparkSession, sf: str) -> DataFrame:
    """Last state of every monitor; alarmed_at is -1 where it never alarmed."""
    rows = drift.monitored(_stream(spark, sf))
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.max_by("log_wealth", "seq"), 6).alias("log_wealth"),
        F.round(F.max("log_wealth"), 6).alias("highest"),
        F.coalesce(F.min(F.when(F.col("alarmed"), F.col("seq"))), F.lit(-1)).alias("alarmed_at"),
    )


def _calibrations(spark: SparkSession, sf: str) -> DataFrame:
    obs = risk.observations(read(spark, sf, "response_records").dropDuplicates(["query_id"]), "nli", "strict")
    return risk.select_threshold(risk.threshold_candidates(obs, ["category"]), ALPHA, DELTA, ["category"])


def calibration_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold of every category, certified or not."""
    rows = _calibrations(spark, sf)
    return rows.select("category", "certified", "threshold", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"), "n")


def _gate_facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs with their facts, requests, and drift alarms; a category of responses stands for a calibration's tenant.

    Every category has a run of its own date; the first half of its responses by hash fills the monitor's bag, the
    others are live.
    """
    records = read(spark, sf, "response_records").dropDuplicates(["query_id"])
    day = F.make_dt_interval(F.length("category"))
    runs = _calibrations(spark, sf).select(
        F.col("category").alias("tenant_id"), F.lit(ALPHA).alias("alpha"), "certified", "threshold", F.col("category").alias("calibration_id"),
        (F.lit(RUN_AT).cast("timestamp_ntz") + day).alias("created_at"), F.lit(SNAPSHOT).cast("timestamp_ntz").alias("corpus_known_at"),
    )
    asked = read(spark, sf, "eval_queries").select("tenant_id", F.col("category")).distinct()
    changes = read(spark, sf, "ingest_messages").filter("correction").join(asked, "tenant_id").select(F.col("category").alias("tenant_id"), F.concat("tenant_id", F.lit("/"), "doc_id").alias("doc_id"), "published_at")
    facts = decisions_of.with_facts(decisions_of.calibrations_in_force(runs), changes, F.lit(NOW), MAX_AGE_HOURS)
    judged = risk.judged_claims(records, "nli", "permissive").select("query_id", F.size("claims").alias("n_claims"), F.exists("claims", lambda c: c["score"] < risk.SUPPORT).alias("unsupported"))
    obs = risk.observations(records, "nli", "permissive")
    requests = obs.join(judged, "query_id").select(
        F.col("query_id").alias("request_id"), F.col("category").alias("tenant_id"), F.lit(ALPHA).alias("alpha"), "statistic", "n_claims",
        F.when(F.col("answered"), F.col("n_claims")).otherwise(0).alias("n_kept"), F.lit(False).alias("edited"), "unsupported",
    )
    stream = decisions_of.numbered(requests.select(F.col("tenant_id").alias("key"), "request_id", "statistic"), "key", "request_id")
    stream = stream.withColumn("is_calibration", F.substring(F.md5("request_id"), 1, 1) < "8")
    alarms = decisions_of.drift_alarms(stream, drift.monitored(stream.select("key", "seq", "statistic", "is_calibration"), level=ALARM))
    return facts, requests, alarms


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every response in permissive mode: the first gate that refuses it, or what it is served with."""
    runs, requests, alarms = _gate_facts(spark, sf)
    return decisions_of.decided(requests, runs, alarms).select(F.col("request_id").alias("query_id"), "gate", "decision", "reason", "degraded", "guaranteed")


def calibration_status(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the guarantee of each run in force still holds, and the first reason why not."""
    runs, _, alarms = _gate_facts(spark, sf)
    return decisions_of.status(runs, alarms).select("calibration_id", "threshold", "n_changed", "stale", "in_force", "reason")


def stage_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of requests whose stages failed, events standing for requests and the digits of their ids for the stages."""
    digit = lambda k: F.floor(F.col("event_id") / k) % 10
    outcome = decisions_of.stage_outcome(digit(1) > 0, digit(10), digit(100) > 1, digit(1000) > 2, F.col("event_type") != "error")
    rows = _events(spark, sf).select(outcome.alias("o"))
    return rows.groupBy("o.outcome", "o.reason", "o.degraded").agg(F.count(F.lit(1)).alias("n"))


def tenants_of_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Requests per tenant by API key; every source has a key, and keys of other numbers are unknown."""
    names = read(spark, sf, "chunk_configs").select("tenant_id")
    keys = names.select(F.sha2(F.concat(F.lit("key-"), "tenant_id"), 256).alias("key_hash"), "tenant_id")
    asked = read(spark, sf, "eval_queries").select("query_id", F.concat(F.lit("key-"), F.when(F.col("category") != "unanswerable", F.col("tenant_id")).otherwise("none")).alias("api_key")).distinct()
    return decisions_of.tenant_of_key(asked, keys).groupBy(F.coalesce("tenant_id", F.lit("unknown")).alias("tenant_id")).agg(F.count(F.lit(1)).alias("n"))


def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank quantiles of every event type's values."""
    return monitoring.nearest_rank(_events(spark, sf), ["event_type"], "value", [0.5, 0.9, 0.95, 0.99]).select("event_type", "q", "at", "n")


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative histogram of every event type's values."""
    rows = monitoring.histogram(_events(spark, sf), ["event_type"], "value", BOUNDS)
    return rows.select("event_type", "le", "upto", "n", F.round("total", 2).alias("total"))


def metric_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The histogram as text lines for scraping."""
    rows = monitoring.histogram(_events(spark, sf), ["event_type"], "value", BOUNDS)
    return monitoring.exposition(rows, "value", "event_type").select("line")


def answer_rate_window(spark: SparkSession, sf: str) -> DataFrame:
    """Share of purchases among the events of every six hours."""
    window = F.window("ts", "6 hours")
    rows = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("hits"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round(F.col("hits") / F.col("n"), 6).alias("rate"))


def sliding_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Errors per second over five minutes, every minute in which the window holds one."""
    rows = _events(spark, sf).filter("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    per = rows.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round(F.col("n") / 300, 6).alias("per_second"))


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user, closed by an hour without events (an addition to the monitored rates)."""
    rows = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def refusals_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on all responses by gate and decision."""
    return decisions(spark, sf).groupBy("gate", "decision").agg(F.count(F.lit(1)).alias("n"))


def load_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: requests, share served, throughput, and whether the report counts (nine tenths served)."""
    served = F.col("event_type") != "error"
    rows = _events(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(served).alias("served"),
        F.round(F.avg(F.when(served, F.col("value"))), 4).alias("mean_value"),
        (F.max("event_id") - F.min("event_id")).alias("spread"),
    )
    return rows.select("user_id", "n", "served", "mean_value", "spread", (F.col("served") / F.col("n") >= 0.9).alias("is_valid"))


def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """Admission of every event, its user as the tenant: verdicts by user."""
    rows = _events(spark, sf).select(
        F.col("user_id").cast("string").alias("tenant"),
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0).alias("t"),
        F.when(F.col("event_type") == "signup", "release").otherwise("acquire").alias("event"),
    )
    return monitoring.admitted(rows, rate=0.0001, burst=3.0, most=4).groupBy("tenant", "verdict").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    listed = (
        theta_uniform, conformal_p, drift_monitor, drift_state, calibration_in_force, calibration_status, decisions, stage_failures, tenants_of_keys, latency_quantiles, latency_histogram, metric_lines,
        answer_rate_window, sliding_rate, user_sessions, refusals_by_reason, load_report, token_bucket,
    )
    return {f.__name__: f for f in listed}


_HIST = "SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS upto, count(value) AS n, sum(value) AS total FROM events, (SELECT unnest([" + ", ".join(map(str, BOUNDS)) + "]::DOUBLE[]) AS le) GROUP BY event_type, le"
_THETA = "('0x' || substr(sha256({k} || ':' || {n}), 1, 16))::UBIGINT::DOUBLE / pow(2, 64)"


def _p_values(source: str) -> str:
    return f"""s AS ({source}),
    l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS n FROM s WHERE NOT cal),
    b AS (SELECT l.key, l.seq, l.n, count(*) FILTER (WHERE o.x > l.x) AS above, count(*) FILTER (WHERE o.x = l.x) AS equal_, count(o.x) AS size
          FROM l LEFT JOIN s o ON o.key = l.key AND (o.cal OR o.seq < l.seq) GROUP BY ALL),
    p AS (SELECT key, seq, n, (above + {_THETA.format(k='key', n='n')} * (equal_ + 1)) / (size + 1) AS pv FROM b)"""


_P_VALUES = _p_values(f"SELECT event_type AS key, event_id AS seq, least(value / 500, 1.0)::DOUBLE AS x, ts < TIMESTAMP '{LIVE_FROM}' AS cal FROM events")
# the martingale as a recursion: weights mix, each strategy bets, the total is the gain
_MIX = "((1 - {j}::DOUBLE) * {w} + {j}::DOUBLE / 3)"
_A, _B, _C = (_MIX.format(j=drift.JUMP, w=w) + f" * (1 + ({e}) * (pv - 0.5::DOUBLE))" for w, e in zip("abc", drift.BETS, strict=True))


def _wealth(p_values: str, level: float) -> str:
    return f"""{p_values},
    j AS (SELECT DISTINCT key, -1::BIGINT AS n, NULL::BIGINT AS seq, NULL::DOUBLE AS pv, 1 / 3::DOUBLE AS a, 1 / 3::DOUBLE AS b, 1 / 3::DOUBLE AS c, 0::DOUBLE AS lw FROM p
          UNION ALL
          SELECT key, n, seq, pv, x / (x + y + z), y / (x + y + z), z / (x + y + z), lw + ln(x + y + z) FROM (
              SELECT p.key, p.n, p.seq, p.pv, lw, {_A.replace("pv", "p.pv")} AS x, {_B.replace("pv", "p.pv")} AS y, {_C.replace("pv", "p.pv")} AS z FROM j JOIN p ON p.key = j.key AND p.n = j.n + 1)),
    m AS (SELECT *, max(lw) OVER (PARTITION BY key ORDER BY n) >= ln({level}::DOUBLE) AS alarmed FROM j WHERE n >= 0)"""


_WEALTH = _wealth(_P_VALUES, drift.LEVEL)


def _gates_sql() -> str:
    from tarnlake.plans import risk_queries as Q

    chosen = Q._select("category", "cd", False).replace(Q._A, f"{ALPHA}::DOUBLE")
    live = _p_values("SELECT category AS key, row_number() OVER (PARTITION BY category ORDER BY query_id) AS seq, statistic AS x, substr(md5(query_id), 1, 1) < '8' AS cal, query_id FROM rq")
    return f"""WITH RECURSIVE {Q._OBS}, {Q._GRID}, st AS (SELECT * FROM o WHERE variant = 'nli' AND mode = 'strict'), cd AS ({Q._cand('st', 'category')}),
        ch AS (SELECT *, TIMESTAMP '{NOW}' - (TIMESTAMP '{RUN_AT}' + to_days(length(category)::INTEGER)) > INTERVAL {MAX_AGE_HOURS} HOURS AS stale FROM ({chosen}) WHERE certified),
        nc AS (SELECT category, count(DISTINCT tenant_id || '/' || doc_id) AS n_changed FROM (SELECT DISTINCT tenant_id, category FROM eval_queries) JOIN ingest_messages USING (tenant_id)
               WHERE correction AND published_at > TIMESTAMP '{SNAPSHOT}' GROUP BY category),
        rq AS (SELECT * FROM o WHERE variant = 'nli' AND mode = 'permissive'),
        un AS (SELECT query_id, coalesce(bool_or(coalesce(c.scores['nli'], 0) < 0.5::DOUBLE), false) AS unsupported FROM c0 GROUP BY query_id),
        {_wealth(live, ALARM)},
        al AS (SELECT s.query_id, m.alarmed FROM m JOIN s USING (key, seq)),
        g AS (SELECT rq.query_id, CASE WHEN ch.category IS NULL THEN 'no calibration' WHEN stale THEN 'stale calibration' WHEN coalesce(n_changed, 0) > 0 THEN 'corpus changed'
                WHEN un.query_id IS NOT NULL AND coalesce(alarmed, false) THEN 'drift alarm' WHEN NOT answered THEN 'no claim left' WHEN statistic > threshold THEN 'risk too high' ELSE 'served' END AS gate,
              coalesce(unsupported, false) AS unsupported FROM rq LEFT JOIN ch USING (category) LEFT JOIN nc USING (category) LEFT JOIN un ON un.query_id = rq.query_id LEFT JOIN al ON al.query_id = rq.query_id)"""


def _decision_sql() -> str:
    return f"""{_gates_sql()} SELECT query_id, gate, CASE WHEN gate = 'served' THEN 'answer' ELSE 'abstain' END AS decision,
        CASE WHEN gate IN ('no calibration', 'stale calibration') THEN 'stale_calibration' WHEN gate IN ('corpus changed', 'drift alarm') THEN 'drift_detected' WHEN gate = 'served' THEN '' ELSE 'insufficient_evidence' END AS reason,
        gate IN ('no calibration', 'stale calibration', 'corpus changed', 'drift alarm') AS degraded,
        gate NOT IN ('no calibration', 'stale calibration', 'corpus changed', 'drift alarm') AND NOT (gate = 'served' AND unsupported) AS guaranteed FROM g"""


def _calibration_sql() -> str:
    from tarnlake.plans import risk_queries as Q

    return f"""WITH {Q._OBS}, {Q._GRID}, s AS (SELECT * FROM o WHERE variant = 'nli' AND mode = 'strict'), cd AS ({Q._cand('s', 'category')})
        SELECT category, certified, threshold, round(coverage, 6) AS coverage, round(risk, 6) AS risk, n FROM ({Q._select('category', 'cd', False)}) JOIN (SELECT category, count(*) AS n FROM s GROUP BY category) USING (category)"""


def oracle_sql() -> dict[str, str]:
    return {
        "theta_uniform": f"SELECT event_id, round({_THETA.format(k='event_type', n='event_id')}, 9) AS theta FROM events",
        "conformal_p": f"WITH {_P_VALUES} SELECT key, seq, round(pv, 9) AS p_value FROM p",
        "drift_monitor": f"WITH RECURSIVE {_WEALTH} SELECT key, seq, round(pv, 9) AS p_value, round(lw, 6) + 0.0::DOUBLE AS log_wealth, alarmed FROM m",
        "drift_state": f"""WITH RECURSIVE {_WEALTH} SELECT key, count(*) AS n, round(arg_max(lw, seq), 6) AS log_wealth, round(max(lw), 6) AS highest, coalesce(min(seq) FILTER (WHERE alarmed), -1) AS alarmed_at FROM m GROUP BY key""",
        "calibration_in_force": _calibration_sql(),
        "decisions": _decision_sql(),
        "refusals_by_reason": f"SELECT gate, decision, count(*) AS n FROM ({_decision_sql()}) GROUP BY ALL",
        "calibration_status": f"""{_gates_sql()} SELECT category AS calibration_id, threshold, coalesce(n_changed, 0) AS n_changed, stale, reason = '' AS in_force, reason FROM (
            SELECT *, CASE WHEN stale THEN 'stale' WHEN coalesce(n_changed, 0) > 0 THEN 'corpus_changed' WHEN coalesce(fired, false) THEN 'drift_detected' ELSE '' END AS reason
            FROM ch LEFT JOIN nc USING (category) LEFT JOIN (SELECT key AS category, bool_or(alarmed) AS fired FROM m GROUP BY key) USING (category))""",
        "stage_failures": """SELECT outcome, reason, degraded, count(*) AS n FROM (SELECT unnest(CASE WHEN event_id % 10 = 0 THEN {'outcome': 'abstain', 'reason': 'out_of_corpus', 'degraded': true}
            WHEN event_id // 10 % 10 = 0 THEN {'outcome': 'abstain', 'reason': 'out_of_corpus', 'degraded': false} WHEN event_id // 100 % 10 <= 1 THEN {'outcome': 'error', 'reason': 'generation_failed', 'degraded': true}
            WHEN event_id // 1000 % 10 <= 2 THEN {'outcome': 'abstain', 'reason': 'insufficient_evidence', 'degraded': true} WHEN event_type = 'error' THEN {'outcome': 'abstain', 'reason': 'stale_calibration', 'degraded': true}
            ELSE {'outcome': 'decided', 'reason': '', 'degraded': false} END) FROM events) GROUP BY ALL""",
        "tenants_of_keys": "SELECT CASE WHEN category <> 'unanswerable' AND t.tenant_id IS NOT NULL THEN t.tenant_id ELSE 'unknown' END AS tenant_id, count(*) AS n FROM (SELECT DISTINCT query_id, tenant_id, category FROM eval_queries) q LEFT JOIN (SELECT DISTINCT tenant_id FROM chunk_configs) t USING (tenant_id) GROUP BY 1",
        "latency_quantiles": """SELECT event_type, q, value AS at, n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
            (SELECT unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS q) WHERE k = least(floor(q * n) + 1, n)""",
        "latency_histogram": f"SELECT event_type, le, upto, n, round(total, 2) AS total FROM ({_HIST})",
        "metric_lines": f"""SELECT 'value_bucket{{event_type="' || event_type || '",le="' || le::VARCHAR || '"}} ' || upto::VARCHAR AS line FROM ({_HIST})""",
        "answer_rate_window": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY 1",
        "sliding_rate": """SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(count(*) / 300.0::DOUBLE, 6) AS per_second FROM (
            SELECT unnest(list_transform(range(0, 5), lambda i: date_trunc('minute', ts) - to_minutes(i))) AS start FROM events WHERE event_type = 'error') GROUP BY start""",
        "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events),
            s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g), c AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY ALL)
            SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
        "load_report": """SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS served, round(avg(value) FILTER (WHERE event_type <> 'error'), 4) AS mean_value,
            max(event_id) - min(event_id) AS spread, count(*) FILTER (WHERE event_type <> 'error') / count(*)::DOUBLE >= 0.9::DOUBLE AS is_valid FROM events GROUP BY user_id""",
    }
