"""One ranking from several differently-scaled scores (problem 4): weighted Borda count.

Each score ranks the items of its group by competition ranks with averaged ties; an item without a
score takes the middle rank; the points (number of items less rank) are weighted and summed, and
items are sorted by points with the identifier as tie-break.  Only ranks matter, so no score prevails
through its range.

Skew: groups with more than ``hot`` items are split by score quantiles, so a group with a third of
all rows is ranked in ``slices`` tasks; equal scores are counted before anything is ordered.

Defined results: null and not-a-number scores count as missing; repeated rows count once; of several
different scores of one item in one arm the highest counts; rows with a null group, item or arm are
void; a group in which no arm scores anything is ranked by identifier.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_GROUP = 50_000
SLICES = 64


def borda_ranking(
    scores: DataFrame,
    group: list[str],
    item: str,
    arm: str = "arm",
    score: str = "score",
    weights: Mapping[str, float] | None = None,
    hot: int = HOT_GROUP,
    slices: int = SLICES,
) -> DataFrame:
    """Points of the items of each group: group columns, item, points, n_items, arms_present."""
    value = F.col(score).cast("double")
    rows = scores.select(
        *[F.col(c).alias(f"g{i}") for i, c in enumerate(group)],
        F.col(item).alias("item"),
        F.col(arm).alias("arm"),
        F.when(~F.isnan(value), value).alias("score"),
    )
    keys = [f"g{i}" for i in range(len(group))]
    valid = F.col("item").isNotNull() & F.col("arm").isNotNull()
    for k in keys:
        valid = valid & F.col(k).isNotNull()
    # one row per item: a map from arm to score, so that missing arms need no join
    items = (
        rows.filter(valid)
        .groupBy(*keys, "item", "arm")
        .agg(F.max("score").alias("score"))
        .groupBy(*keys, "item")
        .agg(F.map_from_entries(F.collect_list(F.struct("arm", "score"))).alias("scores"))
    )
    # arms and size of each group
    totals = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_distinct(F.flatten(F.collect_set(F.map_keys("scores")))).alias("arms"),
    )
    spread = items.join(totals, keys).withColumn("arm", F.explode("arms"))
    long = spread.select(*keys, "item", "arm", "n_items", F.try_element_at("scores", F.col("arm")).alias("score"))
    scored = long.filter(F.col("score").isNotNull())
    # ties counted once; big groups sliced by score quantile
    levels = scored.groupBy(*keys, "arm", "score").agg(F.count(F.lit(1)).alias("ties"), F.max("n_items").alias("n_items"))
    cuts = (
        levels.filter(F.col("n_items") > hot)
        .groupBy(*keys, "arm")
        .agg(F.percentile_approx("score", [i / slices for i in range(1, slices)], 1000).alias("cuts"))
    )
    levels = levels.join(cuts, [*keys, "arm"], "left").withColumn(
        "slice", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c >= F.col("score"))))
    )
    per_slice = levels.groupBy(*keys, "arm", "slice").agg(F.sum("ties").alias("in_slice"))
    order = Window.partitionBy(*keys, "arm").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slice.withColumn("before", F.coalesce(F.sum("in_slice").over(order), F.lit(0))).drop("in_slice")
    inner = Window.partitionBy(*keys, "arm", "slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.drop("cuts").withColumn("above", F.coalesce(F.sum("ties").over(inner), F.lit(0)))
    levels = levels.join(before, [*keys, "arm", "slice"]).withColumn("above", F.col("above") + F.col("before"))
    ranks = levels.select(*keys, "arm", "score", (F.col("above") + (F.col("ties") + 1) / 2).alias("rank_in_arm"))
    weight = F.lit(1.0)
    if weights:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weight = F.coalesce(F.try_element_at(table, F.col("arm")), F.lit(1.0))
    # a missing score matches no level and takes the middle rank
    joined = long.join(ranks, [*keys, "arm", "score"], "left")
    middle = (F.col("n_items") + 1) / 2
    points = joined.groupBy(*keys, "item").agg(
        F.sum(weight * (F.col("n_items") - F.coalesce(F.col("rank_in_arm"), middle))).alias("points"),
        F.max("n_items").alias("n_items"),
        F.count("score").alias("arms_present"),
    )
    named = points.withColumnsRenamed({f"g{i}": c for i, c in enumerate(group)} | {"item": item})
    return named


def top_items(ranked: DataFrame, group: list[str], item: str, k) -> DataFrame:  # noqa: ANN001
    """The first k items of each group; k may be a column.

    Splits every group by a hash before ranking, keeps the first of each part, then ranks what is
    left, so no task sorts a whole hot group.
    """
    order = [F.desc("points"), F.asc(item)]
    parts = ranked.withColumn("part", F.pmod(F.xxhash64(item), F.lit(32)))
    first = Window.partitionBy(*group, "part").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    limit = k if not isinstance(k, int) else F.lit(k)
    kept = parts.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)
    return kept.drop("part").withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= limit)
