"""Borda ranking and sentence alignment."""

import random

import pytest

from tarnlake.llm import alignment, ranking

SCHEMA = "query_id string, arm string, chunk_id string, score double"


def brute(rows):
    points = {}
    groups = {}
    for q, arm, c, s in set(rows):
        if None in (q, arm, c):
            continue
        best = groups.setdefault(q, {}).setdefault(c, {})
        if s is not None and s == s:
            best[arm] = max(s, best.get(arm, s))
        else:
            best.setdefault("__arms__", set()).add(arm)
    arms_of = {}
    for q, arm, c, _ in rows:
        if None not in (q, arm, c):
            arms_of.setdefault(q, set()).add(arm)
    for q, items in groups.items():
        n = len(items)
        for arm in arms_of[q]:
            have = {c: s[arm] for c, s in items.items() if arm in s}
            for c in items:
                if c in have:
                    above, same = sum(v > have[c] for v in have.values()), sum(v == have[c] for v in have.values())
                    rank = above + (same + 1) / 2
                else:
                    rank = (n + 1) / 2
                points[q, c] = points.get((q, c), 0) + n - rank
    return points


@pytest.mark.parametrize("hot,slices", [(50_000, 64), (3, 4), (0, 2)])
def test_borda_against_brute_force(spark, hot, slices):
    rng = random.Random(8)
    rows = []
    for q in range(6):
        for c in range(rng.randint(1, 30)):
            for arm, scale in (("a", 1.0), ("b", 1000.0), ("c", -5.0)):
                if rng.random() < 0.8:
                    rows.append((f"q{q}", arm, f"c{c:02d}", rng.choice([None, float("nan"), round(rng.random(), 1) * scale])))
    rows += rows[:9] + [(None, "a", "x", 1.0), ("q0", None, "x", 1.0), ("q0", "a", None, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.query_id, r.chunk_id): r.points for r in ranking.borda_ranking(df, ["query_id"], "chunk_id", hot=hot, slices=slices).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_range_does_not_prevail_and_ties_go_by_id(spark):
    rows = [("q", "wide", "x", 1e9), ("q", "wide", "y", 1.0), ("q", "wide", "z", 0.0)]
    rows += [("q", arm, c, s) for arm in ("n1", "n2") for c, s in (("x", 0.1), ("y", 0.9), ("z", 0.5))]
    ranked = ranking.borda_ranking(spark.createDataFrame(rows, SCHEMA), ["query_id"], "chunk_id")
    assert [r.chunk_id for r in ranking.top_items(ranked, ["query_id"], "chunk_id", 3).orderBy("rank").collect()] == ["y", "x", "z"]
    tied = ranking.borda_ranking(spark.createDataFrame([("q", "a", c, 1.0) for c in "cba"], SCHEMA), ["query_id"], "chunk_id")
    assert [r.chunk_id for r in ranking.top_items(tied, ["query_id"], "chunk_id", 2).orderBy("rank").collect()] == ["a", "b"]
    weighted = ranking.borda_ranking(spark.createDataFrame(rows, SCHEMA), ["query_id"], "chunk_id", weights={"wide": 10.0})
    assert ranking.top_items(weighted, ["query_id"], "chunk_id", 1).first().chunk_id == "x"
    assert ranking.borda_ranking(spark.createDataFrame([], SCHEMA), ["query_id"], "chunk_id").count() == 0


WORDS = [("kurul", "board"), ("belge", "document"), ("süre", "period"), ("ücret", "fee"), ("denetçi", "auditor"), ("kayıt", "record"), ("başvuru", "application"), ("karar", "decision"), ("arşiv", "archive"), ("görevli", "officer"), ("hafta", "week"), ("veri", "data")]


def articles(n, seed=1):
    rng = random.Random(seed)
    rows, truth = [], set()
    for a in range(n):
        pairs = [rng.sample(WORDS, 4) for _ in range(rng.randint(4, 7))]
        tr = [" ".join(w for w, _ in p) + f" {rng.randint(2, 99)}." for p in pairs]
        en = [" ".join(w for _, w in p) + " " + t.split()[-1] for p, t in zip(pairs, tr, strict=True)]
        order = list(range(len(en)))
        if rng.random() < 0.4:
            i = rng.randrange(len(order) - 1)
            order[i], order[i + 1] = order[i + 1], order[i]
        merged = None
        if rng.random() < 0.4:
            merged = rng.randrange(len(order) - 1)
        en_sents, owner = [], []
        k = 0
        while k < len(order):
            if k == merged:
                en_sents.append(en[order[k]][:-1] + ", and " + en[order[k + 1]])
                owner.append((order[k], order[k + 1]))
                k += 2
            else:
                en_sents.append(en[order[k]])
                owner.append((order[k],))
                k += 1
        if rng.random() < 0.3:
            en_sents.append("Nothing of this stands elsewhere.")
            owner.append(())
        key = f"md-{a:03d}"
        rows.append(("p", "tr", key, ["(1) " + " ".join(tr[:3]), " ".join(tr[3:]), None], "x"))
        rows.append(("p", "en", key, [" ".join(en_sents), ""], "x"))
        truth |= {(key, t + 1, e + 1) for e, ts in enumerate(owner) for t in ts}
    return rows, truth


def test_alignment_recovers_reordered_and_merged(spark):
    rows, truth = articles(80)
    rows += [rows[0], ("p", "tr", "alone", ["Tek."], "x"), ("p", "en", "empty", [], "x"), ("p", "tr", "empty", ["Var."], "x"), (None, "tr", "k", ["a."], "x"), ("p", "en", "null", None, "x")]
    df = spark.createDataFrame(rows, "prefix string, lang string, article_key string, paragraphs array<string>, left_no string")
    got = {(r.article_key, r.left_no, r.right_no) for r in alignment.align_articles(df).collect()}
    assert {(r.article_key, r.left_no, r.right_no) for r in alignment.align_articles(df, most_entries=0).collect()} == got
    good = len(got & truth)
    assert good / len(got) > 0.93 and good / len(truth) > 0.93
    assert alignment.align_articles(df.limit(0)).count() == 0


def test_translations_are_learned(spark):
    rows, _ = articles(80, seed=2)
    df = spark.createDataFrame(rows, "prefix string, lang string, article_key string, paragraphs array<string>, x string")
    table = alignment.train_translations(alignment.confident_pairs(alignment.paired_articles(df))).collect()
    best = {}
    for r in table:
        if r.p > best.get(r.e, ("", 0))[1]:
            best[r.e] = (r.f, r.p)
    assert sum(best.get(a, ("",))[0] == b for a, b in WORDS) >= len(WORDS) - 1
