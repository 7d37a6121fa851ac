"""Every core query runs, and gives what its SQL gives, on the smallest data."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

CORE = [q for q in __import__("tarnlake.plans.catalog", fromlist=["x"]).queries()]
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(request):
    con = duckdb.connect()
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def frame(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("string", "str"):
            df[c] = df[c].map(lambda x: None if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)) else str(x))
        else:
            df[c] = df[c].astype("float64").round(6)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data absent")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, small, name):
    got = entry.queries()[name](spark, small).toPandas()
    if name in SQL:
        a, b = frame(got), frame(duck.sql(SQL[name]).df())
        assert list(a.columns) == list(b.columns)
        pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-5)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "score", "rank"] and df.count() > 0


def test_core_does_not_import_the_text_problems():
    for path in (Path(entry.__file__).parent / "tarnlake").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tarnlake.llm" not in path.read_text(), path


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data absent")
@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_core_queries_on_edge_tables(spark, small, tmp_path, kind):
    from edge_data import build

    folder = build(small, tmp_path / kind, kind)
    failed = {}
    for name in CORE:
        try:
            entry.queries()[name](spark, folder).collect()
        except Exception as e:  # noqa: BLE001  all failures are reported together
            failed[name] = str(e)[:300]
    assert not failed
