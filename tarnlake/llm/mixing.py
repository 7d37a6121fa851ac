"""Mixing sources to target weights along a curriculum (problem 9).

A schedule gives each source's weight at knots of training time, straight lines between them; it is an
input table, and where only constant targets are known ``schedule_of_targets`` makes one that starts near
equal weights and integrates to the targets.  Integrating a schedule gives the source's cumulative token
demand.  Every copy of every document stands at the time at which the demand reaches the tokens drawn
before it, found by inverting the integral in closed form; a copy that begins beyond the whole demand is
not drawn.  Sorting by that time gives the training order.

Shares reached and shortfalls are sums over the drawn copies.  A source that is too small even when
repeated ``max_repeats`` times runs out before its demand ends; ``stretch`` slows its schedule so that
what there is lasts to the end of training.

Tokens are counted once per document with a public byte-pair tokenizer in one Arrow pass.  Running sums
are taken in two levels (hash buckets of a source, then within a bucket), with as many buckets as the
largest source needs, so a source with a third of all rows is spread over many tasks.

Defined results: null texts count no tokens; documents without tokens or source are not drawn; sources
without documents reach share 0; targets and knots with a null mix, source, share, time or weight, a
negative weight or a time outside 0 to 1 are void; a null max_repeats means once; repeated targets and
knots count once, and of several weights at one time the largest holds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import prepare, small_side, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pre-tokenizer pattern these ranks were made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoder(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Every row without its text, with a column tokens."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "tokens")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode_ordinary
        for b in batches:
            counts = [len(encode(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(counts, pa.int64())], names=[*kept, "tokens"])

    return spread(docs).mapInArrow(run, f"{fields}, tokens bigint")


def source_totals(counted: DataFrame) -> DataFrame:
    return counted.groupBy("source").agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs"))


def _targets(targets: DataFrame) -> DataFrame:
    named = F.col("mix_id").isNotNull() & F.col("source").isNotNull() & F.col("target_share").isNotNull()
    return targets.filter(named).select("mix_id", "source", "target_share", "max_repeats")


def schedule_of_targets(targets: DataFrame) -> DataFrame:
    """Schedules (mix_id, source, time, weight) for targets that name no time.

    Every mix starts as near to equal weights as its smallest target allows and moves in a straight line
    to the mirror image, so the weights add up to the same at every time and each integral is the target.
    """
    rows = _targets(targets).groupBy("mix_id", "source").agg(F.max("target_share").alias("share"))
    mix = Window.partitionBy("mix_id")
    equal = F.sum("share").over(mix) / F.count(F.lit(1)).over(mix)
    rows = rows.withColumn("equal", equal)
    # the end weight share - lean * (equal - share) must not be negative
    lean = F.least(F.lit(1.0), F.min(F.when(F.col("share") < F.col("equal"), F.col("share") / (F.col("equal") - F.col("share")))).over(mix))
    rows = rows.withColumn("step", F.coalesce(lean, F.lit(1.0)) * (F.col("equal") - F.col("share")))
    start, end = F.col("share") + F.col("step"), F.greatest(F.col("share") - F.col("step"), F.lit(0.0))
    knots = F.array(F.struct(F.lit(0.0).alias("time"), start.alias("weight")), F.struct(F.lit(1.0).alias("time"), end.alias("weight")))
    return rows.select("mix_id", "source", F.explode(knots).alias("k")).select("mix_id", "source", "k.time", "k.weight")


def demand_curves(schedules: DataFrame) -> DataFrame:
    """Integrated schedules: mix_id, source, share (the whole integral) and curve.

    ``curve`` holds a struct for each stretch between knots: its times t0 and t1, weights w0 and w1, and the
    integral up to its ends, c0 and c1.  Before the first and after the last knot a weight stays as it is.
    """
    usable = F.col("mix_id").isNotNull() & F.col("source").isNotNull() & (F.col("weight") >= 0) & F.col("time").between(0.0, 1.0)
    knots = schedules.filter(usable).groupBy("mix_id", "source", F.col("time").cast("double").alias("time")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
    along = Window.partitionBy("mix_id", "source").orderBy("time")
    around = {"before": F.lag("time").over(along), "t1": F.coalesce(F.lead("time").over(along), F.lit(1.0)), "w1": F.coalesce(F.lead("weight").over(along), F.col("weight"))}
    part = lambda t0, t1, w0, w1: F.struct(t0.alias("t0"), t1.alias("t1"), w0.alias("w0"), w1.alias("w1"))
    early = part(F.lit(0.0), F.col("time"), F.col("weight"), F.col("weight"))
    parts = F.array(F.when(F.col("before").isNull(), early), part(F.col("time"), F.col("t1"), F.col("weight"), F.col("w1")))
    lines = knots.withColumns(around).select("mix_id", "source", F.inline(parts)).filter(F.col("t1") > F.col("t0"))
    lines = lines.withColumn("area", (F.col("t1") - F.col("t0")) * (F.col("w0") + F.col("w1")) / 2)
    upto = F.sum("area").over(Window.partitionBy("mix_id", "source").orderBy("t0").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.withColumn("c1", upto).withColumn("c0", F.col("c1") - F.col("area"))
    curve = F.array_sort(F.collect_list(F.struct("t0", "t1", "w0", "w1", "c0", "c1")))
    return lines.groupBy("mix_id", "source").agg(curve.alias("curve"), F.max("c1").alias("share"))


def with_time(rows: DataFrame, reached: Column, curve: str = "curve", name: str = "position") -> DataFrame:
    """Rows with the time at which a curve's integral comes to ``reached``; rows whose curve never passes it fall away.

    Within a stretch the integral is c0 + w0 x + s x² / 2 with slope s, which is inverted in closed form.
    """
    rows = rows.withColumn("_reached", reached)
    rows = rows.withColumn("_at", F.get(F.filter(curve, lambda s: s["c1"] > F.col("_reached")), F.lit(0))).filter(F.col("_at").isNotNull())
    t0, w0 = F.col("_at.t0"), F.col("_at.w0")
    rest = F.greatest(F.col("_reached") - F.col("_at.c0"), F.lit(0.0))
    slope = (F.col("_at.w1") - w0) / (F.col("_at.t1") - t0)
    step = 2 * rest / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))))
    return rows.withColumn(name, F.least(t0 + F.when(rest > 0, step).otherwise(0.0), F.col("_at.t1"))).drop("_reached", "_at")


def mixture_demand(totals: DataFrame, targets: DataFrame, schedules: DataFrame | None = None) -> DataFrame:
    """Every source of every mix with its curve, supply and demand in tokens.

    The mix is to be as large as all documents of all sources.  ``totals`` has a row per source.
    """
    wanted = _targets(targets).groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    curves = demand_curves(schedule_of_targets(targets) if schedules is None else schedules)
    size = totals.agg(F.sum("supply").alias("n")).first()  # a single number
    mix_tokens = F.lit((size and size["n"]) or 0).cast("bigint")
    rows = wanted.join(curves, ["mix_id", "source"], "left").join(totals.select("source", "supply"), "source", "left")
    share = F.coalesce("share", F.lit(0.0))
    return rows.select(
        "mix_id",
        "source",
        "target_share",
        F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"),
        F.coalesce("curve", F.array().cast(curves.schema["curve"].dataType)).alias("curve"),
        F.coalesce("supply", F.lit(0)).alias("supply"),
        mix_tokens.alias("mix_tokens"),
        (share * mix_tokens).alias("demand"),
    )


def _running(counted: DataFrame, id_col: str, rows_per_bucket: int) -> DataFrame:
    """id, source, tokens, and the tokens of the source before each document, in the order of a hash of its id."""
    keyed = counted.filter(F.col("source").isNotNull() & (F.col("tokens") > 0)).select(id_col, "source", "tokens", F.xxhash64(id_col).alias("h"))
    largest = keyed.groupBy("source").count().agg(F.max("count").alias("n")).first()  # a single number
    buckets = max(1, -(-((largest and largest["n"]) or 0) // rows_per_bucket))
    keyed = keyed.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", id_col, "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(over), F.lit(0)).alias("offset"))
    return placed.join(offsets, ["source", "bucket"]).select(id_col, "source", "tokens", (F.col("within") + F.col("offset")).alias("before"))


def curriculum(counted: DataFrame, demand: DataFrame, id_col: str = "doc_id", stretch: bool = False, rows_per_bucket: int = 200_000) -> DataFrame:
    """Drawn copies with their training positions: mix_id, source, id, copy, tokens, drawn, position.

    ``drawn`` is the part of the copy's tokens that falls inside the demand.  ``demand`` is the result of
    mixture_demand; it holds a row per mix and source and is broadcast only where it has few rows.
    """
    mixes = demand.filter((F.col("max_repeats") > 0) & (F.col("supply") > 0) & (F.col("demand") > 0))
    rows = _running(counted, id_col, rows_per_bucket).join(small_side(mixes), "source")
    copies = F.least(F.col("max_repeats").cast("double"), F.ceil(F.col("demand") / F.col("supply"))).cast("int")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    rows = rows.withColumn("done", (F.col("before") + (F.col("copy") - 1) * F.col("supply")).cast("double"))
    reached = F.col("done") / F.col("mix_tokens")
    if stretch:
        available = F.col("supply") * F.col("max_repeats")
        reached = reached * F.greatest(F.lit(1.0), F.col("demand") / available)
    rows = with_time(rows, reached)
    drawn = F.least(F.col("tokens").cast("double"), F.col("demand") - F.col("done"))
    return rows.select("mix_id", "source", id_col, "copy", "tokens", drawn.alias("drawn"), "position")


def shares_reached(demand: DataFrame, positions: DataFrame) -> DataFrame:
    """Per mix and source, from the drawn copies: tokens drawn, copies, share reached, shortfall, and where the source ends."""
    sums = positions.groupBy("mix_id", "source").agg(F.sum("drawn").alias("drawn"), F.max("copy").alias("copies"), F.max("position").alias("ends_at"))
    mix = Window.partitionBy("mix_id")
    rows = demand.drop("curve").join(sums, ["mix_id", "source"], "left").withColumns({"drawn": F.coalesce("drawn", F.lit(0.0)), "copies": F.coalesce("copies", F.lit(0))})
    whole = F.sum("drawn").over(mix)
    return rows.select("*", (F.col("demand") - F.col("drawn")).alias("shortfall"), F.when(whole > 0, F.col("drawn") / whole).otherwise(0.0).alias("actual_share"))


def in_training_order(positions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Range-sorted by mix and position: each output file is one stretch of training time."""
    return positions.orderBy("mix_id", "position", "source", id_col, "copy")
