"""The queries of the problems run over the smallest data with the columns asked for."""

import os

import pytest

from tarnlake.llm import queries

COLUMNS = {
    "p1_found": ["src", "item_id", "seg_no", "lang"],
    "p3_found": ["prefix", "article_key", "tr_sent", "en_sent"],
    "p4_found": ["src", "query_id", "item"],
    "p5_found": ["query_id", "claim_no", "start_pos", "end_pos"],
    "p6_found": ["src", "item_id", "unbroken"],
    "p7_found": ["src", "item_id", "kind"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["mix_id", "source"],
    "p10_found": ["doc_id", "kind"],
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data absent")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, small, name):
    df = queries.queries()[name](spark, small)
    n = df.count()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and n > 0 and df.distinct().count() == n


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data absent")
@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_queries_on_edge_tables(spark, small, tmp_path, kind):
    from edge_data import build

    folder = build(small, tmp_path / kind, kind)
    failed = {}
    for name, query in queries.queries().items():
        try:
            rows = query(spark, folder).collect()
            if kind == "empty" and rows:
                failed[name] = f"{len(rows)} rows from nothing"
        except Exception as e:  # noqa: BLE001  all failures are reported together
            failed[name] = str(e)[:300]
    assert not failed
