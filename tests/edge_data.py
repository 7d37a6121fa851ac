"""Folders of edge-case tables: empty ones, and ones with nulls in every column and repeated rows."""

import pyarrow as pa
import pyarrow.parquet as pq

TABLES = (
    "acts articles chunk_configs chunks customer documents embeddings eval_queries events ingest_messages lineitem mix_targets nation orders part "
    "ranked_chunks region response_records sections supplier test_items"
).split()


def build(source, target, kind):
    """Write every table of ``source``: ``empty``, or ``nulls``: some rows, each column null in turn, an all-null row, repeats."""
    target.mkdir(parents=True, exist_ok=True)
    for name in TABLES:
        table = pq.read_table(f"{source}/{name}.parquet")
        if kind == "empty":
            out = table.slice(0, 0)
        else:
            some = table.slice(0, min(40, table.num_rows)).to_pylist()
            rows = some + some[:3] + [dict.fromkeys(table.column_names)]
            for k, column in enumerate(table.column_names):
                rows.append(some[k % len(some)] | {column: None})
            out = pa.Table.from_pylist(rows, schema=table.schema)
        pq.write_table(out, target / f"{name}.parquet")
    return str(target)
