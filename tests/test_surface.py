"""Plug-ins, moments, table functions, snapshots, review, the engine and the command line."""

import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnlake.engine import Config, Engine
from tarnlake.functions import moments, plugins, tables
from tarnlake.operators import review
from tarnlake.sources import files
from tarnlake.sources import tables as store


def test_plugins(spark):
    df = spark.createDataFrame([(1, "kurul karar verdi"), (2, None), (3, "!")], "id int, text string")
    rows = {r.id: r.embedding for r in plugins.embedded(df, dim=16).collect()}
    assert sum(x * x for x in rows[1]) == pytest.approx(1) and rows[2] is None and rows[3] is None
    held = plugins.embedded(df, dim=16).withColumn("embedding", F.when(F.col("id") == 1, F.array(F.lit(7.0))))
    again = {r.id: r.embedding for r in plugins.backfilled(held, dim=16).collect()}
    assert again[1] == [7.0]

    @plugins.register("scorer", "length")
    def length(pairs):
        return [len(a or "") for a, _ in pairs]

    assert [r.s for r in df.select(plugins.pair_scores(F.col("text"), F.col("text"), name="length").alias("s")).collect()] == [17.0, 0.0, 1.0]
    with pytest.raises(KeyError):
        plugins.get("reranker", "none")
    with pytest.raises(ValueError):
        plugins.register("teller", "x")


def test_moments(spark):
    texts = ["2024-06-01", "2024-06-01T10:00:00Z", "2024-06-01T10:00:00+03:00", "2024-06-01 10:00", "yesterday", "2024-13-01", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r.m for r in df.select(moments.moment(F.col("t")).cast("string").alias("m"), "i").orderBy("i").collect()]
    assert got == ["2024-06-01 00:00:00", "2024-06-01 10:00:00", "2024-06-01 07:00:00", "2024-06-01 10:00:00", None, None, None]
    errors = [r.e is not None for r in df.select(moments.moment_error(F.col("t")).alias("e"), "i").orderBy("i").collect()]
    assert errors == [False] * 4 + [True, True, False]
    a = F.lit("2024-01-01 00:00:00").cast("timestamp")
    row = spark.range(1).select(moments.is_stale(a, a + F.expr("INTERVAL 168 HOURS")).alias("x"), moments.is_stale(a, a + F.expr("INTERVAL 168 HOURS 1 SECOND")).alias("y"),
                                moments.guarantee(F.lit(0.05), F.lit(0.05), F.lit("c1")).alias("g"), moments.trace_id(a, F.lit("q")).alias("t")).first()
    assert (row.x, row.y, row.g) == (False, True, "P(unsupported_claim) <= 0.05 with 95% confidence, calibration_id=c1") and len(row.t) == 22


def test_table_functions(spark):
    tables.register_all(spark)
    assert spark.sql("SELECT chunk FROM chunks_of('Bir. İki. Üç.', 6, 0, 0)").count() == 3
    assert [r.chunk_id for r in spark.sql("SELECT * FROM citations_of('x. [a][b]')").collect()] == ["a", "b"]


def test_snapshots_and_sources(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert store.snapshot(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, folder, "a")
    store.swap_in({"a": spark.range(3), "b": spark.range(1)}, folder)
    store.swap_in({"a": spark.range(5), "b": spark.range(2)}, folder)
    assert (store.read_table(spark, folder, "a").count(), store.read_table(spark, folder, "b").count()) == (5, 2)
    (tmp_path / "store" / "NEXT-torn").write_text("")  # a writer that died before its rename changes nothing
    assert store.read_table(spark, folder, "a").count() == 5 and len(list((tmp_path / "store").glob("SNAPSHOT-*"))) == 2
    store.publish(spark.createDataFrame([("t", "j1"), ("u", "j2")], "tenant_id string, job_id string"), str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).count() == 2
    b64 = base64.b64encode(b"abc").decode()
    rows = spark.createDataFrame([("1", b64, None), ("2", None, "file:///d/x.txt"), ("3", None, "file:///d/y.txt"), ("4", None, "http://x"), ("5", b64, "file:///d/x.txt"), ("6", None, None), ("7", "%", None)], "job_id string, payload string, source_uri string")
    files = spark.createDataFrame([("file:/d/x.txt", bytearray(b"text"))], "path string, content binary")
    got = {r.job_id: (r.content and bytes(r.content), r.error) for r in store.resolved(rows, files).collect()}
    assert got == {"1": (b"abc", None), "2": (b"text", None), "3": (None, "file not found"), "4": (None, "scheme not supported"), "5": (None, "two sources"), "6": (None, "no source"), "7": (None, "payload is not base64")}


def test_review(spark):
    q = spark.createDataFrame([("a", "draft", None), ("b", "draft", None)], "query_id string, status string, note string")
    d = spark.createDataFrame([("a", "verified", "ok", 1), ("a", "rejected", "no", 2), ("b", "odd", "x", 1)], "query_id string, status string, note string, decided_at int")
    done = review.decided(q, d)
    assert {(r.query_id, r.status, r.note) for r in done.collect()} == {("a", "rejected", "no"), ("b", "draft", None)}
    fresh = spark.createDataFrame([("a", "draft", None), ("c", "draft", None)], "query_id string, status string, note string")
    assert {(r.query_id, r.status) for r in review.merged(fresh, done).collect()} == {("a", "rejected"), ("c", "draft")}
    rows = spark.createDataFrame([("g", i) for i in range(10)], "g string, i int")
    assert [r.is_test for r in review.strided_split(rows, 0.5, ["g"], ["i"]).orderBy("i").collect()] == [False, True] * 5


def test_engine_path(spark):
    engine = Engine(spark, Config(target_chars=60, overlap_chars=0, min_chars=0, alpha=0.3))
    texts = spark.createDataFrame([("t", "d", 1, "İade süresi otuz gündür. Ücret alınmaz.\n\nBaşvuru yazılı yapılır."), ("u", "e", 1, "İade yoktur.")], "tenant_id string, doc_id string, version int, text string")
    chunks = engine.chunk(texts).withColumnRenamed("chunk", "text")
    queries = spark.createDataFrame([("q", "t", "iade süresi nedir"), ("none", "t", "xyz")], "query_id string, tenant_id string, text string")
    found = engine.retrieve(queries, chunks)
    assert {r.query_id for r in found.collect()} == {"q"} and all(r.chunk_id.startswith("d:v1:chunk_") for r in found.collect())
    claims = engine.answer(queries, found, chunks).first().claims
    assert claims[0].text == "İade süresi otuz gündür." and claims[0].citations and claims[0].scores["overlap"] == 1.0
    rows = [(f"q{i}", i / 200, i > 150, True, True, True) for i in range(200)]
    obs = spark.createDataFrame(rows, "query_id string, statistic double, loss boolean, answered boolean, useful boolean, answerable boolean")
    best = engine.calibrate(obs).first()
    assert best.certified and best.threshold >= 0.7
    assert engine.decide(obs, F.lit(best.threshold)).filter("decision = 'answer'").count() == round(best.coverage * 200)
    assert engine.experiments(obs, trials=20).first().n_trials == 20


def test_command_line(spark, tmp_path, capsys):
    from tarnlake.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Merhaba.\n\nİkinci paragraf.")
    (tmp_path / "in" / "b.docx").write_bytes(b"broken")
    main(["load", str(tmp_path / "in"), str(tmp_path / "store"), "--tenant", "t"])
    assert "documents=1 chunks=1 rejected=1" in capsys.readouterr().out
    main(["list", str(tmp_path / "store")])
    assert "a.txt" in capsys.readouterr().out
    main(["query", "query_status", "/root/testdata/sf0.001", "--out", str(tmp_path / "rows")])
    assert spark.read.parquet(str(tmp_path / "rows")).count() > 0
    assert datetime.now().year > 2000


def test_draft_rules(spark):
    fields = "query_id string, tenant_id string, text string, status string, category string, relevant_docs array<string>, evidence array<string>, answer string"
    long = ["a quote of fifteen letters"]
    rows = [
        ("ok", "t", "x", "draft", "answerable", ["d"], long, "a"), ("free", "t", "x", "draft", "unanswerable", [], [], None), ("bad", None, " ", "odd", "odd", None, None, None),
        ("un", "t", "x", "draft", "unanswerable", ["d"], ["q"], None), ("multi", "t", "x", "verified", "multi-doc", ["d", "d"], ["short", *long], "a"), ("one", "t", "x", "draft", "multi-doc", ["d"], long, "a"),
        ("twice", "t", "x", "draft", "answerable", ["d"], long, "a"), ("twice", "t", "y", "draft", "answerable", ["d"], long, "a"), ("none", "t", "x", "draft", None, ["d"], long, "a"),
    ]
    held = spark.createDataFrame([("ok", "q", True), ("one", "q", False)], "query_id string, quote string, held boolean")
    got = {}
    for r in review.draft_problems(spark.createDataFrame(rows, fields), held).collect():
        got.setdefault(r.query_id, set()).add(r.problem)
    assert got == {
        "bad": {"no tenant", "no text", "unknown status", "unknown category", "answerable without documents", "no evidence", "no answer"},
        "un": {"unanswerable with documents", "unanswerable with evidence"}, "multi": {"repeated document", "short quote"}, "one": {"one document for several", "quote in no document"},
        "twice": {"repeated id"}, "none": {"unknown category"},
    }


def test_report(spark, tmp_path):
    curve = spark.createDataFrame([(0.1, 0.5, None), (0.2, 0.6, "a|b")], "coverage double, risk double, note string")
    files.write_report({"curve": curve}, str(tmp_path / "r"))
    rows = json.loads(spark.read.text(str(tmp_path / "r" / "curve.json")).first()["value"])
    assert rows == [{"coverage": 0.1, "risk": 0.5, "note": None}, {"coverage": 0.2, "risk": 0.6, "note": "a|b"}]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r" / "report.md")).collect()][:4] == ["## curve", "", "| coverage | risk | note |", "| --- | --- | --- |"]
    with pytest.raises(ValueError):
        files.write_report({"curve": curve}, str(tmp_path / "r"), most_rows=1)
