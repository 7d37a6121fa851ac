"""Ordered folds over keyed groups: sort inside partitions, stream through each group once.

For operators whose next output depends on the state left by all earlier rows of a key (ingestion,
token buckets, sequential tests).  Rows are shuffled by key and sorted within partitions, which spills,
and groups stream through Python in Arrow batches, so a group of any length needs the memory of its
state only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnlake.session import prepare

FLUSH = 20_000


def fold_groups(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    schema: list[tuple[str, str, pa.DataType]],
    start: Callable[[tuple], object],
    step: Callable[[object, tuple], Iterator[tuple]],
    finish: Callable[[object, tuple], Iterator[tuple]] | None = None,
) -> DataFrame:
    """Fold every group of ``keys`` in the order of ``order``.

    ``start(key)`` makes a state, ``step(state, row)`` yields output rows for each input row (a tuple of
    all columns in their order), ``finish(state, key)`` yields rows at the end of the group.
    ``schema`` lists name, SQL type and Arrow type of the output columns.
    """
    prepare(rows.sparkSession)
    columns = rows.columns
    at = [columns.index(k) for k in keys]
    names = [n for n, _, _ in schema]
    types = [t for _, _, t in schema]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: object = None
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = tuple(row[i] for i in at)
                if mine != key:
                    if key is not None and finish:
                        out.extend(finish(state, key))
                    key, state = mine, start(mine)
                out.extend(step(state, row))
            if len(out) >= FLUSH:
                yield batch_of(out)
                out = []
        if key is not None and finish:
            out.extend(finish(state, key))
        yield batch_of(out)

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(run, ", ".join(f"`{n}` {s}" for n, s, _ in schema))
