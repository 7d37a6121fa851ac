"""Drift monitors, quantiles, admission control and their streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import drift, monitoring


def test_uniform_is_the_same_on_both_sides(spark):
    got = spark.range(20).select(drift.uniform_of(F.lit("k"), F.col("id")).alias("u"), "id").collect()
    assert all(r.u == drift.uniform("k", r.id) for r in got)


def test_monitor_matches_plain_counting(spark):
    rng = random.Random(1)
    rows = [("k", i, round(rng.random(), 2), i < 30) for i in range(120)] + [("k", 500, None, False)]
    got = {r.seq: r for r in drift.monitored(spark.createDataFrame(rows, "key string, seq long, statistic double, is_calibration boolean")).collect()}
    bag = [r[2] for r in rows if r[3]]
    for n, r in enumerate(x for x in rows if not x[3] and x[2] is not None):
        bigger, same = sum(b > r[2] for b in bag), sum(b == r[2] for b in bag) + 1
        assert got[r[1]].p_value == pytest.approx((bigger + drift.uniform("k", n) * same) / (len(bag) + 1))
        bag.append(r[2])
    assert 500 not in got


def test_first_step_is_neutral():
    m = drift.Monitor()
    m.bet(0.9)
    assert m.log_wealth == pytest.approx(0.0)


def test_false_alarms_and_detection():
    rng = np.random.default_rng(5)
    false = late = 0
    delays = []
    for run in range(60):
        m = drift.Monitor(values=sorted(rng.beta(2, 5, 150)))
        for x in rng.beta(2, 5, 300):
            m.observe(f"s{run}", float(x), level=20)
        false += m.alarmed
        m = drift.Monitor(values=sorted(rng.beta(2, 5, 150)))
        for i, x in enumerate(rng.beta(5, 2, 200)):
            m.observe(f"d{run}", float(x))
            if m.alarmed:
                delays.append(i + 1)
                break
        else:
            late += 1
    assert false / 60 <= 0.1 and late == 0 and np.median(delays) <= 60


def test_stream_equals_batch(spark, tmp_path):
    from tarnlake.streaming.live import drift_monitors

    rng = random.Random(4)
    rows = [("ab"[i % 2], i, rng.random(), i < 20) for i in range(80)]
    schema = "key string, seq long, statistic double, is_calibration boolean"
    for part in range(4):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
    query = drift_monitors(stream).writeStream.format("memory").queryName("monitors").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    live = {(r.key, r.seq): r for r in spark.sql("select * from monitors").collect()}
    batch = {(r.key, r.seq): r for r in drift.monitored(spark.createDataFrame(rows, schema)).collect()}
    assert live.keys() == batch.keys()
    assert all(live[k].log_wealth == pytest.approx(batch[k].log_wealth) for k in batch)


def test_nearest_rank(spark):
    values = [5.0, 1.0, 3.0, 3.0, 9.0, None]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = {r.q: r["at"] for r in monitoring.nearest_rank(df, ["k"], "v", [0.0, 0.5, 0.99, 1.0]).collect()}
    ordered = sorted(v for v in values if v is not None)
    assert got == {q: ordered[min(int(q * 5), 4)] for q in (0.0, 0.5, 0.99, 1.0)}


def verdicts(spark, rows, **limits):
    df = spark.createDataFrame(rows, "tenant string, seq long, t double, event string")
    return [r.verdict for r in monitoring.admitted(df, **limits).orderBy("seq").collect()]


def test_admission(spark):
    burst = [("t", i, 0.0, "acquire") for i in range(4)]
    assert verdicts(spark, burst, rate=1.0, burst=3.0, most=99) == ["admitted"] * 3 + ["too fast"]
    assert verdicts(spark, [*burst, ("t", 9, 1.0, "acquire")], rate=1.0, burst=3.0, most=99)[-1] == "admitted"
    capped = [("t", 0, 0.0, "acquire"), ("t", 1, 0.0, "acquire"), ("t", 2, 0.0, "release"), ("t", 3, 0.0, "acquire")]
    assert verdicts(spark, capped, rate=1.0, burst=2.0, most=1) == ["admitted", "too many at once", "admitted"]
    assert verdicts(spark, burst + [("u", 20, 0.0, "acquire")], rate=1.0, burst=3.0, most=99)[-1] == "admitted"
    assert math.isclose(drift.uniform("x", 0), drift.uniform("x", 0))
