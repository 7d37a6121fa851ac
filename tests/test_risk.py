"""Binomial tails, threshold selection, curves and the guarantee itself."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions.binomial import least_sample, ln_factorial, lower_tail
from tarnlake.operators import risk as R

CLAIM = "struct<text:string,citations:array<string>,corrupted:boolean,kind:string,on_evidence:boolean,scores:map<string,double>>"
RECORD = f"query_id string, answerable boolean, category string, claims array<{CLAIM}>"


def claim(score, corrupted=False, on=True, kind=""):
    return ("c", [], corrupted, kind, on, {"nli": score})


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.05), (10, 3, 0.05), (50, 2, 0.1), (100, 7, 0.05), (200, 20, 0.15), (5, 5, 0.3), (5, -1, 0.3), (2000, 90, 0.05), (2000, 100, 0.05), (2000, 130, 0.05), (7000, 2050, 0.3), (300, 0, 0.02), (300, 299, 0.9), (1, 0, 0.5)])
def test_tail_against_direct_sum(spark, n, k, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n < 1000 else None
    got = spark.range(1).select(lower_tail(F.lit(k), F.lit(n), F.lit(p)).alias("t")).first().t
    if exact is None:
        exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert got == pytest.approx(exact, rel=1e-9, abs=1e-12)


def test_ln_factorial(spark):
    rows = spark.range(0, 200).select("id", ln_factorial(F.col("id")).alias("v")).collect()
    assert all(r.v == pytest.approx(math.lgamma(r.id + 1), rel=1e-10, abs=1e-10) for r in rows)


def test_least_sample():
    assert least_sample(0.05, 0.05) == 59
    assert least_sample(0.05 / 50, 0.05) == 135


def test_observation_goldens(spark):
    rows = [
        ("a", True, "x", [claim(0.99), claim(0.97, corrupted=True)]),
        ("b", True, "x", [claim(0.99), claim(0.05, corrupted=True)]),
        ("c", True, "x", [claim(0.1), claim(0.2)]),
        ("d", False, "x", []),
        ("e", None, None, None),
        ("f", True, "x", [("c", None, None, None, None, None)]),
    ]
    df = spark.createDataFrame(rows, RECORD)
    strict = {r.query_id: r for r in R.observations(df, "nli", "strict").collect()}
    assert strict["a"].loss and not {r.query_id: r for r in R.observations(df, "nli", "strict", loss="verifier").collect()}["a"].loss
    assert not strict["b"].loss and strict["b"].statistic == pytest.approx(0.01)
    assert {r.query_id: r for r in R.observations(df, "nli", "flagged").collect()}["b"].loss
    for q in "cdef":
        assert not strict[q].answered and strict[q].statistic == 1.0 and not strict[q].loss
    assert R.observations(df.limit(0), "nli", "strict").count() == 0


def obs_frame(spark, rows):
    return spark.createDataFrame(rows, "query_id string, statistic double, loss boolean, answered boolean, useful boolean, answerable boolean")


def test_operating_point_and_curve(spark):
    df = obs_frame(spark, [("a", 0.1, False, True, True, True), ("b", 0.2, True, True, False, True), ("c", 0.9, True, True, False, True), ("d", 0.3, False, True, False, False)])
    point = R.operating_point(df, F.lit(0.5)).first()
    assert (point.answer_rate, round(point.risk, 6), point.useful_rate, point.unanswerable_answered) == (0.75, 0.333333, 0.25, 1.0)
    curve = R.risk_coverage(obs_frame(spark, [("a", 0.1, False, True, True, True), ("b", 0.2, True, True, True, True), ("c", 0.3, False, True, True, True), ("z", 1.0, False, False, False, True)]).withColumn("k0", F.lit(1)), ["k0"]).orderBy("k").collect()
    assert [(r.coverage, round(r.risk, 4)) for r in curve] == [(0.25, 0.0), (0.5, 0.5), (0.75, 0.3333)]


def test_selection(spark):
    grid = [(i, round(0.02 * i, 2), 1000, 0, 0) for i in range(1, 51)]
    spots = {5: (300, 2), 15: (800, 20), 45: (1000, 90)}
    rows = [(p, lam, n, *spots.get(p, (0, 0))) for p, lam, n, _, _ in grid]
    df = spark.createDataFrame(rows, "place int, lambda double, n bigint, answered bigint, failures bigint")
    best = R.select_threshold(df, 0.05, 0.05).first()
    assert best.certified and best.threshold == 0.3 and best.coverage == 0.8 and best.risk == 0.025
    none = R.select_threshold(df.withColumn("failures", F.col("answered")), 0.05, 0.05).first()
    assert (none.certified, none.threshold, none.coverage, none.risk) == (False, 0.0, 0.0, 1.0)


def test_grid_is_one_pass_and_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), float(round(x, 3)), bool(rng.random() < x), bool(rng.random() < 0.9), True, True) for i, x in enumerate(rng.random(400))]
    got = R.threshold_candidates(obs_frame(spark, rows)).orderBy("place").collect()
    for r in got:
        inside = [x for x in rows if x[3] and x[1] <= r["lambda"]]
        assert (r.n, r.answered, r.failures) == (400, len(inside), sum(x[2] for x in inside))


def test_guarantee_holds(spark):
    rng = np.random.default_rng(3)
    rows = []
    for run in range(24):
        for i, s in enumerate(rng.random(1500)):
            rows.append((f"{run}", f"{run}-{i}", float(s), bool(rng.random() < min(1, 0.3 * s)), True))
    df = spark.createDataFrame(rows, "run string, query_id string, statistic double, loss boolean, answered boolean")
    chosen = R.select_threshold(R.threshold_candidates(df, ["run"]), 0.1, 0.05, ["run"]).collect()
    wrong = sum(1 for r in chosen if r.certified and 0.15 * r.threshold > 0.1)  # the true risk up to lambda is 0.15 lambda
    assert wrong <= 4 and sum(r.certified for r in chosen) > 15


def test_auroc_with_ties(spark):
    rows = [("v", 0.9, True), ("v", 0.5, True), ("v", 0.5, False), ("v", 0.1, False), ("w", 0.5, True)]
    got = {r.variant: r.auroc for r in R.auroc(spark.createDataFrame(rows, "variant string, score double, is_clean boolean"), ["variant"]).collect()}
    assert got["v"] == pytest.approx(0.875) and got["w"] is None


def test_trial_summary_figures(spark):
    schema = "certified boolean, threshold double, answered bigint, failures bigint, n_test bigint, useful bigint, unanswerable bigint, unanswerable_answered bigint"
    rows = [(True, 0.2, 10, 1, 20, 8, 5, 1), (True, 0.4, 10, 3, 20, 4, 0, 0), (True, 0.6, 0, 0, 20, 0, 4, 0), (False, 0.0, 0, 0, 20, 0, 5, 0)]
    got = R.trial_summary(spark.createDataFrame(rows, schema), 0.2).first()
    assert (got.n_trials, got.certified_rate, got.mean_threshold, got.mean_risk, got.answer_rate) == pytest.approx((4, 0.75, 0.4, 0.2, 0.25))
    assert got.risk_ci95 == pytest.approx(1.96 * math.sqrt(0.02 / 2)) and got.useful_rate == pytest.approx(0.15) and got.unanswerable_answered == pytest.approx(0.1)


def test_trials_carry_useful_and_unanswerable(spark):
    from tarnlake.plans.risk_queries import TRIALS

    assert TRIALS == 200
    rng = np.random.default_rng(5)
    rows = [(str(i), float(round(x, 3)), bool(rng.random() < 0.05 * x), bool(rng.random() < 0.9), bool(rng.random() < 0.7), bool(rng.random() < 0.8)) for i, x in enumerate(rng.random(900))]
    for r in R.repeated_trials(obs_frame(spark, rows), 3, 0.3, 0.05).collect():
        side = [x for x in rows if int(hashlib.sha256(f"{r.trial}:{x[0]}".encode()).hexdigest()[:8], 16) / 2**32 >= 0.6]
        served = [x for x in side if r.certified and x[3] and x[1] <= r.threshold]
        assert r.certified and (r.n_test, r.answered, r.unanswerable) == (len(side), len(served), sum(not x[5] for x in side))
        assert (r.useful, r.unanswerable_answered) == (sum(x[4] for x in served), sum(not x[5] for x in served))


def test_guarantees_transfer_missing_scores_and_evidence(spark):
    rows = [(f"q{i}", lang, [claim(0.9 if i % 10 else 0.2, corrupted=(lang == "en" and i % 3 == 0))], True, "x") for lang in ("tr", "en") for i in range(200)]
    df = spark.createDataFrame([(f"{r[1]}{r[0]}", *r[1:]) for r in rows], f"query_id string, lang string, claims array<{CLAIM}>, answerable boolean, category string")
    obs = R.observations(df, "nli", "strict").join(df.select("query_id", "lang"), "query_id")
    table = {r.alpha: r for r in R.guarantees(R.threshold_candidates(obs.filter("lang = 'tr'")), [0.01, 0.1, 0.3], 0.05).collect()}
    assert not table[0.01].certified and table[0.1].certified and table[0.3].certified and table[0.3].coverage == table[0.1].coverage
    moved = {(r.learned_on, r.tested_on): r for r in R.transfer(obs, "lang", 0.1, 0.05).collect()}
    assert set(moved) == {("tr", "en"), ("en", "tr")} and not moved["tr", "en"].holds and moved["tr", "en"].failures > 0
    assert moved["en", "tr"].threshold == 0 and not moved["en", "tr"].holds  # nothing was certified there
    assert {r.variant: (r.n_claims, r.n_missing) for r in R.missing_scores(df, ["nli", "hits"]).collect()} == {"nli": (400, 0), "hits": (400, 400)}
    quote = "The Board  decides\nwithin thirty days " + "x" * 100
    chunks = spark.createDataFrame([("c1", "before. the board decides within thirty days " + "x" * 60), ("c1", None), ("c2", "other")], "chunk_id string, text string")
    got = spark.createDataFrame([("a", "c1"), ("b", "c2"), ("d", "c1"), ("e", None)], "query_id string, chunk_id string")
    asked = spark.createDataFrame([("a", [quote]), ("b", [quote]), ("d", None), ("e", [" ", None, "x"]), ("f", [])], "query_id string, evidence array<string>")
    assert {r.query_id: r.found for r in R.evidence_retrieved(got, asked, chunks).collect()} == {"a": True, "b": False, "d": None, "e": False, "f": None}
