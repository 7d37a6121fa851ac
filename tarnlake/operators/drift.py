"""Sequential drift tests over keyed streams of statistics.

Each new value gets a randomised conformal p-value: its rank among the calibration values, all earlier
live values and itself, ties broken by a hash-uniform number.  A mixture of three betting strategies
(the simple jumper) turns p-values into a test martingale whose logarithm alarms at a level and stays
alarmed.  Keys are independent; values of one key are folded in arrival order.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.folds import fold_groups

# Alarm level, share of wealth that jumps between strategies, and the strategies.
LEVEL, JUMP, BETS = 100.0, 0.01, (-1.0, 0.0, 1.0)


def uniform_of(key: Column, n: Column) -> Column:
    """A uniform number in [0, 1) from the SHA-256 of key and count."""
    head = F.substring(F.sha2(F.concat(key, F.lit(":"), n.cast("string")), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def uniform(key: str, n: int) -> float:
    return int(hashlib.sha256(f"{key}:{n}".encode()).hexdigest()[:16], 16) / 2**64


@dataclass
class Monitor:
    """State of one key: sorted values, strategy weights, log wealth and the alarm."""

    values: list[float] = field(default_factory=list)
    n: int = 0
    weights: list[float] = field(default_factory=lambda: [1 / 3] * 3)
    log_wealth: float = 0.0
    alarmed: bool = False

    def p_value(self, key: str, x: float) -> float:
        theta = uniform(key, self.n)
        above = len(self.values) - bisect_right(self.values, x)
        equal = bisect_right(self.values, x) - bisect_left(self.values, x) + 1
        return (above + theta * equal) / (len(self.values) + 1)

    def bet(self, p: float, level: float = LEVEL, jump: float = JUMP) -> None:
        mixed = [(1 - jump) * w + jump / 3 for w in self.weights]
        won = [w * (1 + e * (p - 0.5)) for w, e in zip(mixed, BETS, strict=True)]
        total = sum(won)
        self.log_wealth += math.log(total)
        self.weights = [w / total for w in won]
        self.alarmed = self.alarmed or self.log_wealth >= math.log(level)

    def observe(self, key: str, x: float, level: float = LEVEL, jump: float = JUMP) -> float:
        p = self.p_value(key, x)
        insort(self.values, x)
        self.n += 1
        self.bet(p, level, jump)
        return p


def monitored(stream: DataFrame, level: float = LEVEL, jump: float = JUMP) -> DataFrame:
    """key, seq, statistic, is_calibration -> key, seq, p_value, log_wealth, alarmed of the live values.

    Calibration values of a key only fill its bag; the order is calibration first, then seq.
    """

    def start(key: tuple) -> tuple[str, Monitor]:
        return key[0], Monitor()

    def step(state: object, row: tuple) -> Iterator[tuple]:
        key, monitor = state  # type: ignore[misc]
        _, _, seq, x, calibration = row
        if x is None:
            return
        if calibration:
            insort(monitor.values, x)
            return
        p = monitor.observe(key, x, level, jump)
        yield key, seq, p, monitor.log_wealth, monitor.alarmed

    rows = stream.select("key", (~F.col("is_calibration")).cast("int").alias("live"), "seq", F.col("statistic").cast("double").alias("statistic"), "is_calibration")
    schema = [("key", "string", pa.string()), ("seq", "bigint", pa.int64()), ("p_value", "double", pa.float64()), ("log_wealth", "double", pa.float64()), ("alarmed", "boolean", pa.bool_())]
    return fold_groups(rows, ["key"], ["live", "seq"], schema, start, step)
