"""Files, parsers, feeds and the ingestion stream."""

import base64
import io
import json
import zipfile

import pytest

from tarnlake.sources import feeds, files, parsing
from tarnlake.streaming import ingest_stream


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    t = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}{t}</w:body></w:document>")
    return out.getvalue()


def test_decoding():
    assert parsing.decode("﻿şç".encode()) == "şç"
    assert parsing.decode("şğı".encode("cp1254")) == "şğı"
    assert parsing.decode(b"\x81\xff") == "\x81ÿ"


def test_parsers():
    html = "<html><head><title> T  x</title><style>p{}</style></head><body><script>var a</script><h1>H</h1><p>One <b>two</b><br>three</p><ul><li>a</li></ul>"
    assert parsing.parse(html.encode(), "text/html", "f.html") == ("H\n\nOne two three\n\na", "T x")
    assert parsing.parse(docx(["A", "B"], [["c", "d"]]), parsing.DOCX, "my_file.docx") == ("A\n\nB\n\nc\td", "my file")
    assert parsing.parse(b"# Head\r\n\r\n\r\n\r\nx  \n", "text/markdown", "f.md") == ("# Head\n\nx", "Head")
    assert parsing.parse(("y" * 130).encode(), "text/plain", "a/no_te.txt")[1] == "no te"
    with pytest.raises(parsing.UnsupportedMediaType):
        parsing.parse(b"", "image/png", "x.png")


def test_corpus_scan_and_errors(spark, tmp_path):
    (tmp_path / "c" / "sub").mkdir(parents=True)
    (tmp_path / "c" / "a.txt").write_text("Hello\n\nworld")
    (tmp_path / "c" / "sub" / "b.md").write_text("# B\n")
    (tmp_path / "c" / "sub" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "c" / "skip.bin").write_bytes(b"x")
    found = files.corpus(spark, str(tmp_path / "c"))
    assert {r.doc_id for r in found.collect()} == {"a.txt", "sub/b.md", "sub/bad.docx"}
    rows = {r.path.rsplit("/", 1)[-1]: r for r in parsing.parsed(found).collect()}
    assert rows["a.txt"].title == "Hello" and rows["b.md"].title == "B" and rows["bad.docx"].error.startswith("BadZipFile")


def test_records_round_trip(spark, tmp_path):
    folder = str(tmp_path / "records")
    rows = spark.createDataFrame([("q1", None, [1.0]), ("q2", "x", None)], "query_id string, note string, s array<double>")
    files.write_records(rows, folder, {"rate": 0.15})
    part = next((tmp_path / "records" / "rows").glob("part-*"))
    with part.open("a") as f:
        f.write('{"query_id": "q3", "no')
    for crc in (tmp_path / "records" / "rows").glob(".*.crc"):
        crc.unlink()
    got = files.read_records(spark, folder, "query_id string, note string, s array<double>", {"rate": 0.15})
    assert sorted(r.query_id for r in got.collect()) == ["q1", "q2"]
    with pytest.raises(ValueError):
        files.read_records(spark, folder, "query_id string", {"rate": 0.2})
    todo = spark.createDataFrame([("q1",), ("q9",)], "query_id string")
    assert [r.query_id for r in files.still_to_do(todo, got, "query_id").collect()] == ["q9"]


def test_manifest(spark, tmp_path):
    path = tmp_path / "dataset.json"
    path.write_text(json.dumps({"name": "n", "lang": "tr", "queries": [
        {"id": "a", "text": "?", "relevant_docs": ["d1"], "evidence": ["Süre  otuz gün"]},
        {"id": "a", "text": "?", "relevant_docs": ["nope"], "status": "odd"},
        {"id": "b", "text": "?", "relevant_docs": ["d1"], "evidence": ["absent"]},
    ]}))
    queries = files.manifest(spark, str(path))
    assert {r.category for r in queries.collect()} == {"answerable"}
    docs = spark.createDataFrame([("d1", "süre otuz\ngün içinde")], "doc_id string, text string")
    problems = {(r.query_id, r.problem.split(":")[0]) for r in files.manifest_errors(queries, docs).collect()}
    assert problems == {("a", "repeated id"), ("a", "unknown status odd"), ("a", "no document nope"), ("b", "quote not found")}


def test_feed_sections_statutes(spark):
    entry = "<feed><entry><id>http://x.org/abs/2401.01234v2</id><title>A\n title</title><summary> S </summary><published>2024-01-02T00:00:00Z</published><author><name>N One</name></author><author><name>N Two</name></author></entry></feed>"
    r = feeds.atom_entries(spark.createDataFrame([(entry,)], "xml string")).first()
    assert (r.entry_id, r.version, r.title, r.abstract, r.authors) == ("2401.01234", 2, "A title", "S", ["N One", "N Two"])
    page = "Lead text\n== One ==\nbody\n=== Sub ===\nmore\n== References ==\nr\n=== Deep ===\nd\n== After ==\nlast\n== Empty ==\n"
    got = [(s.heading, s.body) for s in feeds.page_sections(spark.createDataFrame([("p", page)], "slug string, text string")).orderBy("sec_no").collect()]
    assert got == [("", "Lead text"), ("One", "body"), ("Sub", "more"), ("After", "last")]
    law = "KANUN\nAmaç\nMadde 1 - Bu kanun.\nikinci satır\nTanımlar\nMADDE 2 – Tanım.\nGeçici Madde 1 - Son."
    arts = [(a.article_no, a.provisional, a.title, a.body) for a in feeds.statute_articles(spark.createDataFrame([("k", law)], "slug string, text string")).orderBy("place").collect()]
    assert arts == [(1, False, "Amaç", "Bu kanun.\nikinci satır"), (2, False, "Tanımlar", "Tanım."), (1, True, None, "Son.")]


def test_ingest_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    good = {"job_id": "j1", "tenant_id": "t", "doc_id": "d", "text": "hello", "received_at": "2024-01-01T00:00:00", "attempts": 1}
    lines = [
        good,
        good | {"received_at": "2024-01-01T01:00:00", "attempts": 2},
        good | {"job_id": "j2", "text": None, "payload": base64.b64encode(b"abc").decode()},
        good | {"job_id": "j3", "text": None},
        good | {"job_id": "j4", "text": None, "payload": "%%%"},
        good | {"job_id": None},
        good | {"job_id": "j5", "attempts": 9},
    ]
    (src / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    ingest_stream.start(ingest_stream.submissions(spark, str(src)), out, cp).awaitTermination()
    (src / "b.json").write_text(json.dumps(good | {"job_id": "j6"}))
    ingest_stream.start(ingest_stream.submissions(spark, str(src)), out, cp).awaitTermination()
    assert {r.job_id: r.text for r in ingest_stream.accepted(spark, out).collect()} == {"j1": "hello", "j2": "abc", "j6": "hello"}
    states = {r.job_id: (r.state, r.error, r.attempts) for r in ingest_stream.job_states(spark, out).collect()}
    assert states["j1"] == ("accepted", None, 2) and states["j3"] == ("failed", "no source", 1) and states["j5"][1] == "too many attempts"
    dead = [r.problem for r in spark.read.parquet(out + "/dead").collect()]
    assert sorted(dead) == ["malformed", "no identity", "no source", "payload is not base64", "too many attempts"]


def test_event_rates_stream(spark, tmp_path):
    from tarnlake.streaming.live import event_rates, once

    rows = [(1, "2024-01-01 00:00:10", "a", 1.0), (1, "2024-01-01 00:00:10", "a", 1.0), (2, "2024-01-01 00:04:00", "a", 3.0), (3, "2024-01-01 01:00:00", "b", 5.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "to_timestamp(ts) as ts", "event_type", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = event_rates(stream.dropDuplicates(["event_id"])).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.event_type, r.n, r.mean_value) for r in spark.sql("select * from rates").collect()}
    assert got == {("a", 2, 2.0), ("b", 1, 5.0)}
    q = once(stream).writeStream.format("memory").queryName("once_only").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from once_only").count() == 3
