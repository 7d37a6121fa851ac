"""Lexical, dense and fused retrieval on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.functions.stemming import analyse, stem_en, stem_tr
from tarnlake.operators import retrieval as R


def test_lexical_matches_and_isolates_tenants(spark):
    chunks = spark.createDataFrame([("a", "c1", "iade süresi otuz gündür iade"), ("a", "c2", "iade yok"), ("b", "c3", "iade süresi"), ("a", "c4", None)], "tenant_id string, chunk_id string, text string")
    queries = spark.createDataFrame([("q1", "a", "İade süresi nedir"), ("q2", "a", ""), ("q3", "a", None)], "query_id string, tenant_id string, text string")
    scored = R.lexical_scores(R.query_lexemes(queries, T.tokens(F.col("text"))), R.postings(chunks, T.tokens(F.col("text"))))
    got = {(r.query_id, r.chunk_id): round(r.score, 6) for r in scored.collect()}
    assert got == {("q1", "c1"): 0.3, ("q1", "c2"): 0.1}


def test_fusion_goldens(spark):
    rows = [("q", "lexical", 1, "a"), ("q", "dense", 2, "a"), ("q", "dense", 1, "x")]
    got = {r.chunk_id: r for r in R.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id string, arm string, rank int, chunk_id string")).collect()}
    assert got["a"].score == pytest.approx(1 / 61 + 1 / 62) and got["x"].score == pytest.approx(1 / 61)
    assert got["a"].ranks == {"lexical": 1, "dense": 2}
    with pytest.raises(ValueError):
        R.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id string, arm string, rank int, chunk_id string"), k=0)


def test_rerank_head_and_tail(spark):
    fused = spark.createDataFrame([("q", f"c{i:02d}", 1.0 - i / 100) for i in range(40)], "query_id string, chunk_id string, score double")
    model = spark.createDataFrame([("q", f"c{i:02d}", float(i)) for i in range(40)], "query_id string, chunk_id string, model_score double")
    got = [r.chunk_id for r in R.rerank(fused, model, head=32, cut=40).orderBy("rank").collect()]
    assert got[:3] == ["c31", "c30", "c29"] and got[32:] == [f"c{i}" for i in range(32, 40)]


def test_metrics_goldens(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "x", 1), ("q2", "y", 2), ("q2", "g", 3), ("q3", "a", 1)], "query_id string, item string, rank int")
    gold = spark.createDataFrame([("q1", "a"), ("q1", "a"), ("q1", "z"), ("q2", "g")], "query_id string, item string")
    got = {r.query_id: r for r in R.ranking_metrics(ranked, gold).collect()}
    assert got["q1"].recall == 0.5 and got["q1"].precision == 0.5 and got["q1"].rr == 1
    assert got["q2"].rr == pytest.approx(1 / 3) and got["q2"].ndcg == pytest.approx(1 / math.log2(4))
    assert got["q3"].recall == got["q3"].ndcg == got["q3"].hit == 0


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(900, None)], "item_id long, embedding array<float>").repartition(5)
    asked = df.filter("item_id % 50 = 0 and embedding is not null").withColumnRenamed("item_id", "query_id")
    unit = data.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for block in (2, 100):
        got = {}
        for r in R.dense_top_k(df, asked, k=7, block=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.item_id))
        for q, items in got.items():
            scores = unit @ unit[q]
            scores[q] = -9
            assert [i for _, i in sorted(items)] == list(np.argsort(-scores)[:7])
    near = R.VectorCells.fit(df, cells=8).search(df, asked, k=7, probes=5)
    exact = R.dense_top_k(df, asked, k=7)
    assert near.join(exact, ["query_id", "item_id"]).count() / exact.count() > 0.6


def test_index_recall_on_test_data(spark, small):
    from tarnlake.plans.retrieval_queries import dense_approximate

    rows = dense_approximate(spark, small).collect()
    assert sum(r.recall for r in rows) / len(rows) >= 0.9


def test_top_k_is_exact_across_slices(spark):
    rows = spark.range(5000).select(F.lit("q").alias("query_id"), F.concat(F.lit("c"), "id").alias("chunk_id"), (F.col("id") % 97).cast("double").alias("score"))
    for k in (60, 1500):
        _same_top(rows, k)


def _same_top(rows, k):
    got = R.top_k(rows, k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])
    want = rows.orderBy(F.desc("score"), "chunk_id").limit(k)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [r.chunk_id for r in want.collect()]


def test_stems():
    assert stem_en("connections") == stem_en("connected") == "connect"
    assert stem_en("relational") == "relat" and stem_en("caresses") == "caress"
    assert stem_tr("belgelerini") == stem_tr("belgeler") and stem_tr("süre") == "sure"
    assert analyse("The İzinler", "english")[-1] and analyse(None, "turkish") == []


def test_queries_without_language_have_an_arm_per_analyzer(spark, tmp_path):
    from tarnlake.plans.retrieval_queries import lexical_stemmed

    chunks = [("a", "c1", "d1", "Belgeler saklanır", "tr"), ("a", "c2", "d2", "The connections remain", "en"), ("a", "c3", "d3", "belgelerini connected", None), ("b", "c4", "d4", "Belgeler saklanır", "tr")]
    spark.createDataFrame([(*c, None) for c in chunks], "tenant_id string, chunk_id string, doc_id string, text string, lang string, valid_to timestamp").write.parquet(f"{tmp_path}/chunks.parquet")
    labels = [None, "", "und", "Unknown", "n/a", "xx", "tr", "en", "de"]
    queries = [(f"q{i}", "a", "belgelerini connected", lang, [], "verified") for i, lang in enumerate(labels)]
    spark.createDataFrame(queries, "query_id string, tenant_id string, text string, lang string, relevant_docs array<string>, status string").write.parquet(f"{tmp_path}/eval_queries.parquet")
    got = {}
    for r in lexical_stemmed(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score, r["rank"], r.fused_score))
    want = [("c3", 0.2, 1, round(1 / 61 + 2 / 62, 9)), ("c1", 0.1, 2, round(1 / 61, 9)), ("c2", 0.1, 3, round(1 / 61, 9))]
    assert all(got[f"q{i}"] == want for i in range(6))
    assert [[c for c, *_ in got[q]] for q in ("q6", "q7", "q8")] == [["c1", "c3"], ["c2", "c3"], ["c3"]]
