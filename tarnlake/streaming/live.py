"""Live monitoring: windowed rates with watermarks, and drift monitors as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnlake.operators.drift import JUMP, LEVEL, Monitor


def event_rates(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and mean value per type and window; rows later than ``late`` are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, deliveries within ``late`` of one another."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drift_monitors(stream: DataFrame, level: float = LEVEL, jump: float = JUMP) -> DataFrame:
    """key, seq, statistic, is_calibration -> the monitor's verdict after every live value.

    The state of a key is its monitor; within a batch values are taken calibration first, then by seq, so
    a stream that is cut into batches in the order of seq gives what the batch operator gives.
    """
    schema = "key string, seq bigint, p_value double, log_wealth double, alarmed boolean"
    state_schema = "monitor string"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        monitor = Monitor()
        if state.exists:
            kept = json.loads(state.get[0])
            monitor = Monitor(kept["values"], kept["n"], kept["weights"], kept["log_wealth"], kept["alarmed"])
        rows = pd.concat(list(batches)).dropna(subset=["statistic"]).sort_values(["is_calibration", "seq"], ascending=[False, True])
        out = []
        for row in rows.itertuples(index=False):
            if row.is_calibration:
                from bisect import insort

                insort(monitor.values, row.statistic)
                continue
            p = monitor.observe(key[0], row.statistic, level, jump)
            out.append((key[0], row.seq, p, monitor.log_wealth, monitor.alarmed))
        state.update((json.dumps(monitor.__dict__),))
        yield pd.DataFrame(out, columns=["key", "seq", "p_value", "log_wealth", "alarmed"])

    return stream.groupBy("key").applyInPandasWithState(update, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
