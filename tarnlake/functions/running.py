"""Running counts and sums over long ordered groups, without one task per group.

Rows of a group are cut into buckets that follow the order (a truncated time, a coarse score).  Inside a
bucket a window counts; across buckets the totals, one row per bucket, are summed; a join brings both
together.  A group with a third of all rows is then ordered by as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(
    rows: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], sums: dict[str, Column] | None = None, place: str = "place", descending: bool = False
) -> DataFrame:
    """Adds the place of each row in its group from 1, and the running sum of each of ``sums`` up to it.

    ``bucket`` must rise (or fall, if descending) with ``order``.
    """
    keys = list(keys)
    parts = {place: F.lit(1), **(sums or {})}
    cut = rows.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy(F.desc("_bucket") if descending else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_{n}") for n, c in parts.items()])
    offsets = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_{n}").over(across), F.lit(0)).alias(f"_{n}") for n in parts])
    within = cut.withColumns({n: F.sum(c).over(inner) for n, c in parts.items()})
    joined = within.join(offsets, [*keys, "_bucket"])
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in parts}).drop("_bucket", *[f"_{n}" for n in parts])
