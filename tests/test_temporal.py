"""Half-open periods, ingestion outcomes and integrity checks."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tarnlake.operators import temporal as M

J, N = datetime(2024, 1, 1), datetime(2024, 6, 1)
US = timedelta(microseconds=1)


def stamp(t):
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def test_each_moment_has_one_version(spark):
    rows = spark.createDataFrame([("t", "policy", 1, J, N), ("t", "policy", 2, N, None)], "tenant_id string, doc_id string, version int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    for moment, version in ((J, 1), (J + timedelta(days=1), 1), (N - US, 1), (N, 2), (datetime(2030, 1, 1), 2)):
        assert [r.version for r in M.as_of(rows, stamp(moment)).collect()] == [version]
    assert M.as_of(rows, stamp(J - US)).count() == 0
    assert [r.version for r in M.current(rows).collect()] == [2]
    assert M.overlaps(rows).count() == 0
    wide = rows.withColumn("valid_to", F.col("valid_to") + F.expr("INTERVAL 1 DAY"))
    assert sorted(r.version for r in M.overlaps(wide).collect()) == [1, 2]
    day = timedelta(days=1)
    long = [("t", "d", 1, J, J + 90 * day, None), ("t", "d", 2, J + 10 * day, J + 20 * day, None), ("t", "d", 3, J + 30 * day, J + 40 * day, None), ("t", "d", 4, J + 90 * day, None, None)]
    long += [("t", "d", 5, J + 50 * day, J + 60 * day, J), ("t", "d", 6, J + 5 * day, J + 5 * day, None), ("t", "e", 1, None, None, None)]
    rows = spark.createDataFrame(long, "tenant_id string, doc_id string, version int, valid_from timestamp_ntz, valid_to timestamp_ntz, superseded_at timestamp_ntz")
    assert sorted(r.version for r in M.overlaps(rows).collect()) == [1, 2, 3]  # the third lies in the first, not in its neighbour


def test_retired_documents_and_their_chunks(spark):
    rows = spark.createDataFrame([("t", "a", "c1", J, None), ("t", "a", "c2", J, N), ("t", "b", "c3", J, None), ("u", "a", "c4", J, None), ("t", "a", "c5", N, None)], "tenant_id string, doc_id string, chunk_id string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    named = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "none")], "tenant_id string, doc_id string")
    at = J + timedelta(days=1)
    got = {r.chunk_id: r.valid_to for r in M.retire_documents(rows, named, stamp(at)).collect()}
    assert got == {"c1": at, "c2": N, "c3": None, "c4": None, "c5": None}
    assert {r.doc_id: r.retired for r in M.retired(rows, named, stamp(at)).collect()} == {"a": True, "none": False}


def ingest(spark, rows):
    df = spark.createDataFrame(rows, "tenant_id string, doc_id string, job_id string, published long, valid_from long, correction boolean, content_hash string")
    return {r.job_id: r for r in M.ingest(df).collect()}


def test_ingestion_outcomes(spark):
    got = ingest(spark, [
        ("t", "d", "a", 1, 10, False, "x"),
        ("t", "d", "b", 2, 20, False, "x"),
        ("t", "d", "c", 3, 20, False, "y"),
        ("t", "d", "d", 4, 20, False, "z"),
        ("t", "d", "e", 5, None, True, "w"),
        ("t", "e", "f", 1, None, True, "w"),
        ("u", "d", "g", 9, None, False, "x"),
    ])
    assert {k: r.outcome for k, r in got.items()} == {"a": "created", "b": "unchanged", "c": "amended", "d": "rejected", "e": "corrected", "f": "rejected", "g": "created"}
    assert (got["a"].valid_from, got["a"].valid_to) == (10, 20)
    assert got["c"].superseded_at == 5 and got["e"].valid_from == 20 and got["e"].version == 3
    assert got["g"].valid_from == 9 and M.ingest(spark.createDataFrame([], "tenant_id string, doc_id string, job_id string, published long, valid_from long, correction boolean, content_hash string")).count() == 0


def test_known_at_still_shows_the_mistake(spark):
    got = ingest(spark, [("t", "d", "a", 1, 10, False, "x"), ("t", "d", "e", 5, None, True, "w")])
    rows = spark.createDataFrame([tuple(r) for r in got.values()], "tenant_id string, doc_id string, version int, job_id string, outcome string, valid_from long, valid_to long, recorded_at long, superseded_at long")
    before = rows.filter((F.col("recorded_at") <= 3) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > 3)))
    assert [r.job_id for r in before.collect()] == ["a"]
