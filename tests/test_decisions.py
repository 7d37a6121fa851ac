"""The gates of a decision in their order, what is in force, and stages that fail."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tarnlake.operators import decisions as D

NOW = datetime(2025, 3, 1)
RUNS = "calibration_id string, tenant_id string, alpha double, certified boolean, threshold double, created_at timestamp, corpus_known_at timestamp"
ASKED = "request_id string, tenant_id string, alpha double, statistic double, n_claims int, n_kept int, edited boolean, unsupported boolean"
ALARMS = "calibration_id string, request_id string, alarmed boolean"


def facts(spark, runs, changes=(), hours=48):
    changed = spark.createDataFrame(list(changes), "tenant_id string, doc_id string, published_at timestamp")
    return D.with_facts(D.calibrations_in_force(spark.createDataFrame(runs, RUNS)), changed, F.lit(NOW), hours)


def ago(hours):
    return NOW - timedelta(hours=hours)


def test_latest_certified_run_of_the_very_alpha(spark):
    runs = [("old", "t", 0.1, True, 0.3, ago(9), None), ("new", "t", 0.1, True, 0.4, ago(5), None), ("newest", "t", 0.1, False, 0.9, ago(1), None), ("looser", "t", 0.2, True, 0.8, ago(1), None), ("other", "u", 0.1, True, 0.5, ago(1), None), ("none", None, 0.1, True, 0.5, ago(1), None)]
    got = {(r.tenant_id, r.alpha): r.calibration_id for r in D.calibrations_in_force(spark.createDataFrame(runs, RUNS)).collect()}
    assert got == {("t", 0.1): "new", ("t", 0.2): "looser", ("u", 0.1): "other"}


def test_gates_in_order(spark):
    runs = [
        ("fresh", "fresh", 0.1, True, 0.4, ago(48), ago(60)), ("aged", "aged", 0.1, True, 0.4, ago(48.001), ago(60)), ("moved", "moved", 0.1, True, 0.4, ago(5), ago(10)), ("alarm", "alarm", 0.1, True, 0.4, ago(5), None),
    ]
    changes = [("moved", "d", ago(10)), ("moved", "d", ago(9)), ("moved", "d", ago(3)), ("moved", "e", ago(20)), ("aged", "d", ago(1)), ("fresh", "d", ago(60)), ("alarm", "d", ago(1))]
    rows = [
        ("1", "fresh", 0.1, 0.4, 2, 2, False, False), ("2", "fresh", 0.1, 0.41, 2, 2, False, False), ("3", "fresh", 0.1, 1.0, 2, 0, True, False), ("4", "fresh", 0.1, 0.2, 2, 1, True, False),
        ("5", "fresh", 0.1, 0.2, 2, 2, False, True), ("6", "fresh", 0.05, 0.0, 2, 2, False, False), ("7", "aged", 0.1, 0.0, 2, 2, False, False), ("8", "moved", 0.1, 0.0, 2, 2, False, False),
        ("9", "alarm", 0.1, 0.0, 2, 2, False, False), ("10", "alarm", 0.1, 1.0, 0, 0, False, False), ("11", "alarm", 0.1, 0.0, 2, 2, False, False), ("12", None, None, None, None, None, None, None),
    ]
    f = facts(spark, runs, changes)
    assert {r.calibration_id: (r.stale, r.n_changed) for r in f.collect()} == {"fresh": (False, 0), "aged": (True, 1), "moved": (False, 1), "alarm": (False, 0)}
    alarms = spark.createDataFrame([("alarm", "9", True), ("alarm", "10", True), ("alarm", "11", False)], ALARMS)
    got = {r.request_id: (r.gate, r.decision, r.reason, r.degraded, r.guaranteed) for r in D.decided(spark.createDataFrame(rows, ASKED), f, alarms).collect()}
    assert got["1"] == ("served", "answer", "", False, True)  # a statistic at the threshold passes
    assert got["2"] == ("risk too high", "abstain", "insufficient_evidence", False, True)
    assert got["3"][0] == "no claim left" and got["4"] == ("served", "answer_with_flags", "", False, True)
    assert got["5"] == ("served", "answer", "", False, False)  # what is returned unsupported has no guarantee
    assert got["6"] == got["12"] == ("no calibration", "abstain", "stale_calibration", True, False)
    assert got["7"][:3] == ("stale calibration", "abstain", "stale_calibration")  # staleness is told before the corpus
    assert got["8"] == ("corpus changed", "abstain", "drift_detected", True, False)
    assert got["9"] == ("drift alarm", "abstain", "drift_detected", True, False)
    assert got["10"][0] == "no claim left" and got["11"][0] == "served" and len(got) == 12
    empty = D.decided(spark.createDataFrame([], ASKED), f, alarms)
    assert empty.count() == 0


def test_status_names_the_first_reason(spark):
    runs = [(n, n, 0.1, True, 0.4, ago(a), ago(9)) for n, a in (("stale", 99), ("moved", 1), ("drift", 1), ("good", 1))]
    changes = [("stale", "d", ago(1)), ("moved", "d", ago(1))]
    alarms = spark.createDataFrame([("stale", "a", True), ("moved", "a", True), ("drift", "a", False), ("drift", "b", True), ("good", "a", False)], ALARMS)
    got = {r.calibration_id: (r.in_force, r.reason) for r in D.status(facts(spark, runs, changes), alarms).collect()}
    assert got == {"stale": (False, "stale"), "moved": (False, "corpus_changed"), "drift": (False, "drift_detected"), "good": (True, "")}


def test_failed_stages(spark):
    rows = [("a", False, 5, True, True, True), ("b", True, 0, True, True, True), ("c", True, 5, False, False, True), ("d", True, 5, True, None, True), ("e", True, 5, True, True, False), ("f", True, 5, True, True, True), ("g", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, r boolean, n int, g boolean, v boolean, k boolean")
    got = {x.id: tuple(x.o) for x in df.select("id", D.stage_outcome(F.col("r"), F.col("n"), F.col("g"), F.col("v"), F.col("k")).alias("o")).collect()}
    assert got == {
        "a": ("abstain", "out_of_corpus", True), "b": ("abstain", "out_of_corpus", False), "c": ("error", "generation_failed", True), "d": ("abstain", "insufficient_evidence", True),
        "e": ("abstain", "stale_calibration", True), "f": ("decided", "", False), "g": ("abstain", "out_of_corpus", True),
    }


def test_keys(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "k string").select(F.sha2("k", 256).alias("key_hash"), F.when(F.col("k") == "a", "t").otherwise(F.concat(F.lit("u"), F.monotonically_increasing_id())).alias("tenant_id"))
    asked = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x"), ("3", "c", "x"), ("4", None, "x")], "id string, api_key string, tenant_id string")
    got = D.tenant_of_key(asked, keys)
    assert got.columns == ["id", "tenant_id"] and {r.id: r.tenant_id for r in got.collect()} == {"1": "t", "2": None, "3": None, "4": None}
