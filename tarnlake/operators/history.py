"""Full history of changing entity attributes from submissions (problem 2).

Submissions are folded in the order of publication into versions with validity periods; the result
is kept as a checkpoint-delta store: every ``every``-th version holds all attributes, the versions
between hold a patch of what changed.  ``reconstruct`` folds the patches forward from the nearest
checkpoint, inside blocks that never grow beyond ``every`` rows, so even one entity with a third of
all rows is rebuilt by many tasks.

The store names attribute values by their hash; ``attribute_values`` keeps each value of an entity once
under that hash, and ``as_of`` reads the values that held at a moment.  ``append`` folds new submissions,
late ones too, by rebuilding the entities they touch and carrying all others over.

Only keys, times and hashes of the attributes are shuffled for the store, never the texts.  The fold streams
over sorted partitions and holds the versions of one entity at a time.

Defined results: null attributes count as empty; rows with a null key or a null publication time
are void; re-deliveries of a submission act once; equal publication times are ordered by the
submission id; an empty table gives an empty history.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import prepare

BLOCK = 1024  # versions that a block of a timeline holds at most
OPEN_END = "9999-12-31 23:59:59"


def squeezed(text: Column) -> Column:
    """Trimmed text with each run of white space read as one space; null reads as empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)[\s\u001c-\u001f]+", " ")), F.lit(""))


class _Timeline:
    """Versions of one entity in order of their start, in blocks, so that inserting into a long history stays cheap."""

    __slots__ = ("firsts", "blocks", "first_job")

    def __init__(self) -> None:
        self.firsts: list[int] = []  # start of the first version of each block
        self.blocks: list[tuple[list[int], list[tuple]]] = []
        self.first_job: dict[tuple, str] = {}

    def versions(self) -> Iterator[tuple[int, tuple]]:
        for starts, contents in self.blocks:
            yield from zip(starts, contents, strict=True)

    def apply(self, content: tuple, valid_from: int | None, correction: bool, published: int, job: str) -> None:
        self.first_job.setdefault(content, job)
        if correction and valid_from is None:
            b, at = len(self.blocks) - 1, len(self.blocks[-1][0]) - 1 if self.blocks else -1
        else:
            start = published if valid_from is None else valid_from
            b = bisect_right(self.firsts, start) - 1
            at = bisect_right(self.blocks[b][0], start) - 1 if b >= 0 else -1
        if correction:
            if at >= 0:
                self.blocks[b][1][at] = content
                self._join(b, at)
            return
        if at >= 0 and self.blocks[b][0][at] == start:
            self.blocks[b][1][at] = content
        elif at >= 0 and self.blocks[b][1][at] == content:
            return
        else:
            b, at = max(b, 0), at + 1
            self._insert(b, at, start, content)
            if len(self.blocks[b][0]) > BLOCK:
                b, at = self._halve(b, at)
        self._join(b, at)

    def _insert(self, b: int, at: int, start: int, content: tuple) -> None:
        if not self.blocks:
            self.blocks.append(([], []))
            self.firsts.append(start)
        starts, contents = self.blocks[b]
        starts.insert(at, start)
        contents.insert(at, content)
        self.firsts[b] = starts[0]

    def _halve(self, b: int, at: int) -> tuple[int, int]:
        starts, contents = self.blocks[b]
        half = len(starts) // 2
        self.blocks[b : b + 1] = [(starts[:half], contents[:half]), (starts[half:], contents[half:])]
        self.firsts[b : b + 1] = [starts[0], starts[half]]
        return (b, at) if at < half else (b + 1, at - half)

    def _delete(self, b: int, at: int) -> None:
        starts, contents = self.blocks[b]
        del starts[at], contents[at]
        if starts:
            self.firsts[b] = starts[0]
        else:
            del self.blocks[b], self.firsts[b]

    def _join(self, b: int, at: int) -> None:
        """Neighbours with equal content become one version; the earlier start stays."""
        contents = self.blocks[b][1]
        after = (b, at + 1) if at + 1 < len(contents) else (b + 1, 0)
        before = (b, at - 1) if at else (b - 1, -1)
        if after[0] < len(self.blocks) and self.blocks[after[0]][1][after[1]] == contents[at]:
            self._delete(*after)
        if before[0] >= 0 and self.blocks[before[0]][1][before[1]] == contents[at]:
            self._delete(b, at)


def build_store(
    submissions: DataFrame,
    keys: Sequence[str] = ("tenant_id", "doc_id"),
    attributes: Sequence[str] = ("title", "text"),
    job: str = "job_id",
    valid_from: str = "valid_from",
    correction: str = "correction",
    published: str = "published_at",
    every: int = 8,
) -> DataFrame:
    """The checkpoint-delta store of all entities.

    Columns: the keys, version, valid_from and valid_to (microseconds since 1970, null: open),
    is_checkpoint, patch (attribute name to its content hash; job_id is carried as an attribute).
    """
    spark = submissions.sparkSession
    prepare(spark)
    keys, attributes = list(keys), list(attributes)
    rows = submissions.select(
        *[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)],
        F.unix_micros(F.col(published).cast("timestamp")).alias("published"),
        F.col(job).cast("string").alias("job"),
        F.unix_micros(F.col(valid_from).cast("timestamp")).alias("valid_from"),
        F.coalesce(F.col(correction), F.lit(False)).alias("correction"),
        *[F.xxhash64(squeezed(F.col(a))).alias(f"a{i}") for i, a in enumerate(attributes)],
    )
    key_cols = [f"k{i}" for i in range(len(keys))]
    attr_cols = [f"a{i}" for i in range(len(attributes))]
    present = F.col("published").isNotNull()
    for c in key_cols:
        present = present & F.col(c).isNotNull()
    ordered = rows.filter(present).repartition(*key_cols).sortWithinPartitions(*key_cols, "published", "job")
    names = [*key_cols, "version", "valid_from", "valid_to", "is_checkpoint", "patch"]
    map_type = pa.map_(pa.string(), pa.string())
    types = [*[pa.string()] * len(keys), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), map_type]

    def emit(key: tuple, line: _Timeline, out: list[list]) -> None:
        before: dict[str, str] = {}
        versions = list(line.versions())
        for v, (start, content) in enumerate(versions):
            now = {a: str(h) for a, h in zip(attributes, content, strict=True)} | {job: line.first_job[content]}
            full = v % every == 0
            patch = now if full else {a: x for a, x in now.items() if before.get(a) != x}
            for c, x in zip(out, (*key, v + 1, start, versions[v + 1][0] if v + 1 < len(versions) else None, full, list(patch.items())), strict=True):
                c.append(x)
            before = now

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        line = _Timeline()
        last_job: str | None = None
        out: list[list] = [[] for _ in names]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*key_cols, "published", "job", "valid_from", "correction", *attr_cols)]
            nk = len(key_cols)
            for row in zip(*columns, strict=True):
                if row[:nk] != key:
                    if key is not None:
                        emit(key, line, out)
                    key, line, last_job = row[:nk], _Timeline(), None
                if row[nk + 1] is not None and row[nk + 1] == last_job:
                    continue  # delivered again
                last_job = row[nk + 1]
                line.apply(row[nk + 4 :], row[nk + 2], row[nk + 3], row[nk], row[nk + 1])
            if len(out[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                out = [[] for _ in names]
        if key is not None:
            emit(key, line, out)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    schema = ", ".join(f"{c} string" for c in key_cols) + ", version int, valid_from bigint, valid_to bigint, is_checkpoint boolean, patch map<string,string>"
    store = ordered.mapInArrow(fold, schema)
    return store.withColumnsRenamed(dict(zip(key_cols, keys, strict=True)))


def reconstruct(store: DataFrame, keys: Sequence[str] = ("tenant_id", "doc_id"), attributes: Sequence[str] = ("title", "text", "job_id"), every: int = 8) -> DataFrame:
    """Validity rows with all attributes: patches folded forward from the nearest checkpoint."""
    block = F.floor((F.col("version") - 1) / every).alias("block")
    w = Window.partitionBy(*keys, "block").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = store.withColumn("block", block)
    return rows.select(
        *keys,
        "version",
        "valid_from",
        "valid_to",
        "is_checkpoint",
        *[F.last(F.try_element_at("patch", F.lit(a)), ignorenulls=True).over(w).alias(a) for a in attributes],
    )


def attribute_values(
    submissions: DataFrame,
    keys: Sequence[str] = ("tenant_id", "doc_id"),
    attributes: Sequence[str] = ("title", "text"),
    job: str = "job_id",
    published: str = "published_at",
) -> DataFrame:
    """Every value an attribute of an entity ever had, once: the keys, attribute, hash (as in the store) and value.

    Repeated values are dropped before the shuffle; of values that differ in white space only, the one published
    first is kept.
    """
    each = F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.xxhash64(squeezed(F.col(a))).cast("string").alias("hash"), F.coalesce(F.col(a), F.lit("")).alias("value")) for a in attributes]))
    present = F.col(published).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    rows = submissions.filter(present).select(*[F.col(k).cast("string").alias(k) for k in keys], F.struct(F.col(published).alias("p"), F.col(job).alias("j")).alias("at"), each)
    return rows.groupBy(*keys, "attribute", "hash").agg(F.min_by("value", "at").alias("value"))


def as_of(store: DataFrame, values: DataFrame, moment: Column, keys: Sequence[str] = ("tenant_id", "doc_id"), attributes: Sequence[str] = ("title", "text"), every: int = 8) -> DataFrame:
    """The version of every entity in force at a moment, with its attribute values read from the value table."""
    at = F.unix_micros(moment.cast("timestamp"))
    rows = reconstruct(store, keys, (*attributes, "job_id"), every)
    rows = rows.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).drop("is_checkpoint")
    for a in attributes:
        mine = values.filter(F.col("attribute") == a).select(*keys, F.col("hash").alias(a), F.col("value").alias("_value"))
        rows = rows.join(mine, [*keys, a], "left").drop(a).withColumnRenamed("_value", a)
    return rows


def append(store: DataFrame, so_far: DataFrame, new: DataFrame, keys: Sequence[str] = ("tenant_id", "doc_id"), **options: object) -> DataFrame:
    """The store after new submissions; ``so_far`` are the submissions it was built from.

    A late submission may change any version of its entity, so the entities of the new submissions are folded
    again from all their submissions; every other entity's rows are taken over as they are.
    """
    touched = new.select(*[F.col(k).cast("string").alias(k) for k in keys]).na.drop().distinct()
    again = so_far.join(touched, list(keys), "left_semi").unionByName(new)
    return store.join(touched, list(keys), "left_anti").unionByName(build_store(again, keys, **options))  # type: ignore[arg-type]


def as_text(micros: Column) -> Column:
    """A time as text to the second, an open end as the last moment of the year 9999."""
    return F.coalesce(F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd HH:mm:ss"), F.lit(OPEN_END))


def attribute_history(submissions: DataFrame, every: int = 8) -> DataFrame:
    """One row per version of each document: keys, version, valid_from, valid_to (text), title and text hashes, job_id."""
    history = reconstruct(build_store(submissions, every=every), every=every)
    return history.withColumns({"valid_from": as_text(F.col("valid_from")), "valid_to": as_text(F.col("valid_to"))})
