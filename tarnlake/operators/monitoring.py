"""Monitoring aggregates over request logs: histograms, quantiles, windowed rates, admission control."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.folds import fold_groups


def nearest_rank(rows: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """The value at place floor(q n) + 1 (at most n) of each group, per quantile.

    Equal values are counted before they are ordered; the window holds distinct values only.
    """
    levels = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("here"))
    w = Window.partitionBy(*keys).orderBy(value)
    seen = levels.withColumn("upto", F.sum("here").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = levels.groupBy(*keys).agg(F.sum("here").alias("n"))
    asked = seen.join(total, list(keys)).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    place = F.least(F.floor(F.col("q") * F.col("n")) + 1, F.col("n"))
    return asked.filter(F.col("upto") >= place).groupBy(*keys, "q").agg(F.min(value).alias("at"), F.max("n").alias("n"))


def histogram(rows: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts per bound, with sum and count: one aggregation over all bounds."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*keys).agg(*sums, F.count(value).alias("n"), F.sum(value).alias("total"))
    points = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("upto")) for i, b in enumerate(bounds)])
    return wide.select(*keys, "n", "total", F.explode(points).alias("p")).select(*keys, "p.le", "p.upto", "n", "total")


def exposition(hist: DataFrame, name: str, label: str) -> DataFrame:
    """Text lines of a histogram in the Prometheus format."""
    tag = F.concat(F.lit(f'{name}_bucket{{{label}="'), F.col(label), F.lit('",le="'), F.col("le").cast("string"), F.lit('"} '), F.col("upto").cast("string"))
    return hist.select(label, "le", tag.alias("line"))


@dataclass
class _Bucket:
    tokens: float
    at: float
    running: int = 0


def admitted(requests: DataFrame, rate: float = 10.0, burst: float = 20.0, most: int = 20) -> DataFrame:
    """tenant, seq, t (seconds), event (acquire or release) -> the verdict on each acquire.

    A tenant starts with a full bucket; tokens come back with time up to the burst; the concurrency
    cap is tested before a token is taken, so a refusal for concurrency costs none.  Rows without a time
    are void.
    """

    def start(_: tuple) -> _Bucket:
        return _Bucket(burst, float("-inf"))

    def step(b: object, row: tuple) -> Iterator[tuple]:
        tenant, seq, t, event = row
        assert isinstance(b, _Bucket)
        if t is None:
            return
        if t > b.at:
            b.tokens = burst if b.at == float("-inf") else min(burst, b.tokens + (t - b.at) * rate)
            b.at = t
        if event == "release":
            b.running = max(0, b.running - 1)
            return
        if b.running >= most:
            verdict = "too many at once"
        elif b.tokens < 1:
            verdict = "too fast"
        else:
            b.tokens -= 1
            b.running += 1
            verdict = "admitted"
        yield tenant, seq, verdict

    schema = [("tenant", "string", pa.string()), ("seq", "bigint", pa.int64()), ("verdict", "string", pa.string())]
    return fold_groups(requests.select("tenant", "seq", "t", "event"), ["tenant"], ["t", "seq"], schema, start, step)
