"""Attribute history against a plain replay, and its defined edge results."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import history
from tarnlake.operators.history import append, as_of, attribute_history, attribute_values, build_store, reconstruct

SCHEMA = "job_id string, tenant_id string, doc_id string, title string, text string, valid_from timestamp_ntz, correction boolean, published_at timestamp_ntz, received_at timestamp_ntz, attempts int, version int, valid_to string"
T0 = datetime(2024, 1, 1)


def replay(rows):
    """Versions of one document by replaying its messages one by one over all moments."""
    seen, line, first = set(), [], {}
    for r in sorted(rows, key=lambda r: (r[7], r[0])):
        if r[0] in seen:
            continue
        seen.add(r[0])
        content = (" ".join((r[3] or "").split()), " ".join((r[4] or "").split()))
        first.setdefault(content, r[0])
        at = r[5]
        if r[6]:
            inforce = [i for i, v in enumerate(line) if at is None or v[0] <= at]
            if inforce:
                line[inforce[-1]] = (line[inforce[-1]][0], content)
        else:
            at = at or r[7]
            before = [v for v in line if v[0] <= at]
            if before and before[-1][1] == content and before[-1][0] != at:
                continue
            line = sorted([v for v in line if v[0] != at] + [(at, content)], key=lambda v: v[0])
        line = [v for i, v in enumerate(line) if i == 0 or line[i - 1][1] != v[1]]
    out = []
    for i, (start, content) in enumerate(line):
        end = line[i + 1][0].strftime("%Y-%m-%d %H:%M:%S") if i + 1 < len(line) else "9999-12-31 23:59:59"
        out.append((i + 1, start.strftime("%Y-%m-%d %H:%M:%S"), end, first[content]))
    return out


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for d in range(12):
        for k in range(rng.randint(1, 40)):
            published = T0 + timedelta(hours=rng.randint(0, 500), seconds=k)
            valid = None if rng.random() < 0.2 else T0 + timedelta(hours=rng.randint(0, 60) * 8)
            row = (f"j{d}-{k:03d}", "t", f"d{d}", rng.choice(["A", "B", " A "]), rng.choice(["x", "x  y", "x y", "z\n", None]), valid, rng.random() < 0.25, published, published, 1, 9, "clash")
            rows.append(row)
            if rng.random() < 0.15:
                rows.append((*row[:8], published + timedelta(hours=3), 2, 9, "clash"))
    return rows


@pytest.mark.parametrize("block", [1, 2, 5, 1024])
def test_blocks_change_nothing(monkeypatch, block):
    monkeypatch.setattr(history, "BLOCK", block)
    for seed in range(30):
        rows = random_rows(seed)
        for d in {r[2] for r in rows}:
            line, seen = history._Timeline(), set()
            for r in sorted((r for r in rows if r[2] == d), key=lambda r: (r[7], r[0])):
                if r[0] not in seen:
                    seen.add(r[0])
                    content = (" ".join((r[3] or "").split()), " ".join((r[4] or "").split()))
                    line.apply(content, r[5] and int(r[5].timestamp()), r[6], int(r[7].timestamp()), r[0])
            got = [(v + 1, datetime.fromtimestamp(s).strftime("%Y-%m-%d %H:%M:%S"), line.first_job[c]) for v, (s, c) in enumerate(line.versions())]
            assert got == [(v, s, j) for v, s, _, j in replay([r for r in rows if r[2] == d])]


@pytest.mark.parametrize("every", [1, 3, 8])
def test_matches_replay(spark, every):
    rows = random_rows(5)
    got = attribute_history(spark.createDataFrame(rows, SCHEMA), every=every).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.version, r.valid_from, r.valid_to, r.job_id))
    for d in {r[2] for r in rows}:
        assert sorted(by_doc.get(d, [])) == replay([r for r in rows if r[2] == d])


def test_store_keeps_patches_and_checkpoints(spark):
    rows = [(f"j{k:02d}", "t", "d", "T", f"text {k}", None, False, T0 + timedelta(days=k), T0, 1, 0, "") for k in range(10)]
    store = build_store(spark.createDataFrame(rows, SCHEMA), every=4).orderBy("version").collect()
    assert [r.version for r in store if r.is_checkpoint] == [1, 5, 9]
    assert all(set(r.patch) == {"text", "job_id"} for r in store if not r.is_checkpoint)
    full = reconstruct(build_store(spark.createDataFrame(rows, SCHEMA), every=4), every=4)
    assert full.filter(F.col("title").isNull()).count() == 0 and full.select("text").distinct().count() == 10


def test_edges(spark):
    rows = [
        ("a", "t", "d", None, None, None, True, T0, T0, 1, 0, ""),  # a correction with nothing to correct
        ("b", None, "d", "x", "x", None, False, T0, T0, 1, 0, ""),
        ("c", "t", None, "x", "x", None, False, T0, T0, 1, 0, ""),
        ("d", "t", "e", "x", "x", None, False, None, T0, 1, 0, ""),
    ]
    assert attribute_history(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert attribute_history(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [("a", "t", "d", "T", "w " * 300_000, None, False, T0, T0, 1, 0, "")]
    assert attribute_history(spark.createDataFrame(long, SCHEMA)).count() == 1


def test_one_hot_document(spark):
    rows = [(f"j{k:05d}", "t", "hot" if k % 3 == 0 else f"d{k}", "T", f"v{k % 7}", T0 + timedelta(minutes=k), False, T0 + timedelta(minutes=k), T0, 1, 0, "") for k in range(6000)]
    got = attribute_history(spark.createDataFrame(rows, SCHEMA))
    assert got.filter("doc_id = 'hot'").count() == 2000


def test_values_are_read_back(spark):
    """Title and text at a moment, as a correction and a late message left them."""
    day = timedelta(days=1)
    rows = [
        ("a", "t", "d", "T", "one  text", T0, False, T0, T0, 1, 0, ""),
        ("b", "t", "d", "T", "two", T0 + 10 * day, False, T0 + 10 * day, T0, 1, 0, ""),
        ("c", "t", "d", "T", "one, mended", T0 + 3 * day, True, T0 + 12 * day, T0, 1, 0, ""),
        ("e", "t", "d", "U", "between", T0 + 5 * day, False, T0 + 13 * day, T0, 1, 0, ""),
        ("f", "t", "x", None, None, None, False, T0 + day, T0, 1, 0, ""),
    ]
    df = spark.createDataFrame([*rows, rows[0]], SCHEMA)
    store, values = build_store(df, every=2), attribute_values(df)
    read = {n: [(r.doc_id, r.version, r.title, r.text) for r in as_of(store, values, F.lit(T0 + n * day), every=2).orderBy("doc_id").collect()] for n in (0, 4, 6, 20)}
    assert read[0] == [("d", 1, "T", "one, mended")]
    assert read[4] == [("d", 1, "T", "one, mended"), ("x", 1, "", "")]
    assert read[6] == [("d", 2, "U", "between"), ("x", 1, "", "")] and read[20][0] == ("d", 3, "T", "two")
    # each value stands once, whoever repeats it
    assert sorted((r.doc_id, r.attribute, r.value) for r in values.collect()) == sorted(
        [("d", "title", "T"), ("d", "title", "U"), ("d", "text", "one  text"), ("d", "text", "two"), ("d", "text", "one, mended"), ("d", "text", "between"), ("x", "title", ""), ("x", "text", "")]
    )


@pytest.mark.parametrize("cut", [0, 100, 300, 600])
def test_append_equals_building_anew(spark, cut):
    rows = random_rows(9)
    early, new = [r for r in rows if r[7] <= T0 + timedelta(hours=cut)], [r for r in rows if r[7] > T0 + timedelta(hours=cut)]
    a, b = spark.createDataFrame(early, SCHEMA), spark.createDataFrame(new, SCHEMA)
    key = lambda r: (r.tenant_id, r.doc_id, r.version)
    got = sorted(reconstruct(append(build_store(a), a, b)).collect(), key=key)
    assert got == sorted(reconstruct(build_store(spark.createDataFrame(rows, SCHEMA))).collect(), key=key)
