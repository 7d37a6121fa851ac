"""Retrieval queries: lexical and dense search, fusion, reranking and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.functions.stemming import analysed
from tarnlake.operators import retrieval as R
from tarnlake.operators.temporal import current
from tarnlake.session import read

LEXICAL_K, DENSE_K = 50, 10
ARMS = ["lexical", "dense"]


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return current(read(spark, sf, "chunks")).select("tenant_id", "chunk_id", "doc_id", "text", "lang").distinct()


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "eval_queries").filter(F.col("status") != "rejected").select("query_id", "tenant_id", "text", "lang", "relevant_docs").dropDuplicates(["query_id"])


def _ranked_lexical(spark: SparkSession, sf: str, scorer=R.lexical_scores) -> DataFrame:  # noqa: ANN001
    posts = R.postings(_chunks(spark, sf), T.tokens(F.col("text")))
    scored = scorer(R.query_lexemes(_queries(spark, sf), T.tokens(F.col("text"))), posts).withColumn("score", F.round("score", 6))
    return R.top_k(scored, LEXICAL_K, ["query_id"], [F.desc("score"), F.asc("chunk_id")])


def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Top chunks of each query in its tenant by matching positions."""
    return _ranked_lexical(spark, sf).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


def lexical_results(spark: SparkSession, sf: str) -> DataFrame:
    """First six chunks of each query with title and snippet."""
    ranked = _ranked_lexical(spark, sf).filter("rank <= 6")
    shown = current(read(spark, sf, "chunks")).select("tenant_id", "chunk_id", "title", T.snippet(F.col("text")).alias("snippet")).distinct()
    return ranked.join(shown, ["tenant_id", "chunk_id"]).select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "title", "snippet")


def lexical_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """Top chunks of each query in its tenant by BM25."""
    return _ranked_lexical(spark, sf, R.bm25_scores).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _query_arms(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per query and analyzer: its language's own, else every analyzer in force in its tenant."""
    in_force = chunks.select("tenant_id", T.text_config(F.col("lang")).alias("config")).groupBy("tenant_id").agg(F.collect_set("config").alias("in_force"))
    own = F.when(T.names_language(F.col("lang")), F.array(T.text_config(F.col("lang"))))
    return queries.join(in_force, "tenant_id").withColumn("config", F.explode(F.coalesce(own, "in_force"))).drop("in_force")


def lexical_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the analyzer of each chunk's and each query's own language.

    A query without a language has an arm for every analyzer in its tenant's chunks; arms are fused by
    reciprocal rank.  The score is the highest of the arms', the rank that of the fusion.
    """
    chunks = _chunks(spark, sf).withColumn("tokens", analysed("text", T.text_config(F.col("lang"))))
    arms = _query_arms(_queries(spark, sf), current(read(spark, sf, "chunks"))).withColumn("tokens", analysed("text", "config"))
    asked = arms.withColumn("query_id", F.struct("query_id", F.col("config").alias("arm")))
    scored = R.lexical_scores(R.query_lexemes(asked, F.col("tokens")), R.postings(chunks, F.col("tokens"))).withColumn("score", F.round("score", 6))
    ranked = R.top_k(scored, LEXICAL_K, ["query_id"], [F.desc("score"), F.asc("chunk_id")]).select("query_id.*", "chunk_id", F.col("score").alias("match"), "rank")
    fused = R.top_k(R.reciprocal_rank_fusion(ranked, best=["match"]), LEXICAL_K, ["query_id"], [F.desc("score"), F.asc("chunk_id")])
    return fused.select("query_id", "chunk_id", F.col("match").alias("score"), "rank", F.round("score", 9).alias("fused_score"))


def query_lexemes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct lexemes of every query, sorted and joined."""
    rows = read(spark, sf, "eval_queries").select("query_id", "text").dropDuplicates(["query_id"])
    return rows.select("query_id", F.array_join(F.array_sort(T.lexemes(F.col("text"))), " | ").alias("lexemes"))


def langs_by_tenant(spark: SparkSession, sf: str) -> DataFrame:
    """Languages in force in each tenant, with the analyzers they need."""
    rows = current(read(spark, sf, "chunks")).filter(F.col("lang").isNotNull() & (F.col("lang") != ""))
    return rows.groupBy("tenant_id", "lang").agg(F.count_distinct("doc_id").alias("n_docs")).withColumn("config", T.text_config(F.col("lang")))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).filter(F.col("item_id") % 50 == 0).withColumnRenamed("item_id", "query_id")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Exact nearest vectors of every stated query vector."""
    found = R.dense_top_k(_vectors(spark, sf), _vector_queries(spark, sf), DENSE_K)
    return found.select("query_id", "item_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def dense_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors through the cell index, with its recall against the exact search."""
    vectors, asked = _vectors(spark, sf), _vector_queries(spark, sf)
    near = R.VectorCells.fit(vectors).search(vectors, asked, DENSE_K)
    exact = R.dense_top_k(vectors, asked, DENSE_K).select("query_id", "item_id", F.lit(1).alias("is_exact"))
    both = near.join(exact, ["query_id", "item_id"], "left")
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"), F.round(F.sum(F.coalesce("is_exact", F.lit(0))) / DENSE_K, 6).alias("recall"))


def unembedded_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have no vector yet, in the order of work, with the number left."""
    rows = read(spark, sf, "documents").select("doc_id", "source").distinct()
    have = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return rows.join(have, "doc_id", "left_anti").groupBy("source").agg(F.min("doc_id").alias("next_doc"), F.count(F.lit(1)).alias("left"))


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    scores = read(spark, sf, "ranked_chunks").distinct()
    return R.rank_arms(scores, ARMS)


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal rank fusion of the lexical and the dense arm."""
    return R.reciprocal_rank_fusion(_arms(spark, sf)).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


def rrf_arm_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of each fused chunk in each arm, 0 where the arm did not return it."""
    ranks = R.reciprocal_rank_fusion(_arms(spark, sf))
    return ranks.select("query_id", "chunk_id", *[F.coalesce(F.try_element_at("ranks", F.lit(a)).cast("bigint"), F.lit(0)).alias(f"{a}_rank") for a in ARMS])


def _reranked(spark: SparkSession, sf: str) -> DataFrame:
    model = read(spark, sf, "ranked_chunks").filter((F.col("arm") == "rerank") & F.col("score").isNotNull())
    model = model.select("query_id", "chunk_id", F.col("score").alias("model_score")).distinct()
    fused = R.reciprocal_rank_fusion(_arms(spark, sf)).withColumn("score", F.round("score", 9))
    return R.rerank(fused, model)


def rerank_head_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Fused order, its head by the reranker's score, cut to six."""
    return _reranked(spark, sf).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """Relevant documents of each query."""
    rows = read(spark, sf, "eval_queries").select("query_id", "relevant_docs").dropDuplicates(["query_id"])
    return rows.select("query_id", F.explode("relevant_docs").alias("item")).distinct()


def _doc_ranks(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranks of documents: the best rank of their chunks, renumbered."""
    from pyspark.sql import Window

    best = ranked.join(docs, ["query_id", "chunk_id"]).groupBy("query_id", F.col("doc_id").alias("item")).agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "item"))).drop("best")


def _doc_of(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "ranked_chunks").select("query_id", "chunk_id", "doc_id").distinct()


def ir_by_query(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking metrics at 10 of every query's fused documents."""
    fused = R.reciprocal_rank_fusion(_arms(spark, sf)).withColumn("score", F.round("score", 9))
    from pyspark.sql import Window

    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    metrics = R.ranking_metrics(_doc_ranks(ranked, _doc_of(spark, sf)), _gold(spark, sf))
    return metrics.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "hit", "rr", "ndcg")])


def retrieval_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Mean metrics of each arm alone and of their fusion, over answerable queries."""
    from pyspark.sql import Window

    arms = _arms(spark, sf)
    fused = R.reciprocal_rank_fusion(arms).withColumn("score", F.round("score", 9))
    hybrid = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    gold, docs = _gold(spark, sf), _doc_of(spark, sf)
    result: DataFrame | None = None
    for name, ranked in (("lexical", arms.filter("arm = 'lexical'")), ("dense", arms.filter("arm = 'dense'")), ("hybrid", hybrid)):
        m = R.ranking_metrics(_doc_ranks(ranked.select("query_id", "chunk_id", "rank"), docs), gold).join(gold.select("query_id").distinct(), "query_id", "left_semi")
        row = m.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "hit", "rr", "ndcg")]).withColumn("config", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return result


def queries() -> dict:
    listed = (
        lexical_topk, lexical_results, lexical_bm25, lexical_stemmed, query_lexemes, langs_by_tenant, dense_topk, dense_approximate, unembedded_queue, rrf_fuse,
        rrf_arm_ranks, rerank_head_tail, ir_by_query, retrieval_ablation,
    )
    return {f.__name__: f for f in listed}


_TOK = "regexp_extract_all(lower(replace(text, 'İ', 'i')), '[\\p{L}\\p{N}_]+')"
_Q = "(SELECT query_id, any_value(tenant_id) AS tenant_id, any_value(text) AS text, any_value(lang) AS lang FROM eval_queries WHERE status <> 'rejected' GROUP BY query_id)"
_C = "(SELECT DISTINCT tenant_id, chunk_id, doc_id, text, lang FROM chunks WHERE valid_to IS NULL)"
_POST = f"""c AS (SELECT tenant_id, chunk_id, {_TOK} AS tk FROM {_C}),
    p AS (SELECT tenant_id, chunk_id, len_ AS length, lexeme, count(*) AS tf FROM (SELECT tenant_id, chunk_id, len(tk) AS len_, unnest(tk) AS lexeme FROM c) GROUP BY ALL),
    q AS (SELECT DISTINCT query_id, tenant_id, unnest({_TOK}) AS lexeme FROM {_Q})"""
_LEX = f"WITH {_POST}, s AS (SELECT query_id, chunk_id, round((sum(tf) * 0.1::DOUBLE)::DOUBLE, 6) AS score FROM q JOIN p USING (tenant_id, lexeme) GROUP BY ALL)"
_BM = f"""WITH {_POST},
    z AS (SELECT tenant_id, count(*) AS n, avg(length) AS ml FROM (SELECT DISTINCT tenant_id, chunk_id, length FROM p) GROUP BY tenant_id),
    d AS (SELECT tenant_id, lexeme, count(*) AS df FROM p GROUP BY ALL),
    s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / ml))), 6) AS score
          FROM q JOIN d USING (tenant_id, lexeme) JOIN z USING (tenant_id) JOIN p USING (tenant_id, lexeme) GROUP BY ALL)"""
_TOP = " SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 50"
_ARM = "a AS (SELECT query_id, arm, chunk_id, row_number() OVER (PARTITION BY query_id, arm ORDER BY score DESC, chunk_id) AS rank FROM (SELECT DISTINCT * FROM ranked_chunks) WHERE arm IN ('lexical', 'dense') AND score IS NOT NULL)"
_FUSED = "f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM a GROUP BY ALL)"
_CONFIG = "CASE substr(lower(trim(lang)), 1, 2) WHEN 'tr' THEN 'turkish' WHEN 'en' THEN 'english' ELSE 'simple' END"
_METRICS = """
    g AS (SELECT DISTINCT query_id, unnest(relevant_docs) AS item FROM eval_queries),
    ng AS (SELECT query_id, count(*) AS n_gold FROM g GROUP BY query_id),
    dc AS (SELECT DISTINCT query_id, chunk_id, doc_id FROM ranked_chunks),
    dr AS (SELECT config, query_id, item, row_number() OVER (PARTITION BY config, query_id ORDER BY best, item) AS rank
           FROM (SELECT config, r.query_id, doc_id AS item, min(rank) AS best FROM r JOIN dc ON dc.query_id = r.query_id AND dc.chunk_id = r.chunk_id GROUP BY ALL)),
    h AS (SELECT dr.*, (g.item IS NOT NULL)::INT AS hit FROM dr LEFT JOIN g ON g.query_id = dr.query_id AND g.item = dr.item WHERE rank <= 10),
    per AS (SELECT config, query_id, sum(hit) AS found, count(*) AS returned, min(CASE WHEN hit = 1 THEN rank END) AS first_, sum(hit / log2(rank + 1)) AS dcg FROM h GROUP BY ALL),
    m AS (SELECT config, query_id,
             CASE WHEN n_gold > 0 THEN found / n_gold ELSE 0 END::DOUBLE AS recall,
             CASE WHEN n_gold > 0 THEN found / returned ELSE 0 END::DOUBLE AS precision,
             CASE WHEN n_gold > 0 AND found > 0 THEN 1 ELSE 0 END::DOUBLE AS hit,
             CASE WHEN n_gold > 0 AND first_ IS NOT NULL THEN 1.0::DOUBLE / first_ ELSE 0 END::DOUBLE AS rr,
             CASE WHEN n_gold > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n_gold) ELSE 0 END::DOUBLE AS ndcg,
             n_gold
          FROM per LEFT JOIN ng USING (query_id))"""
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("recall", "precision", "hit", "rr", "ndcg"))
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("recall", "precision", "hit", "rr", "ndcg"))


def oracle_sql() -> dict[str, str]:
    return {
        "lexical_topk": _LEX + _TOP,
        "lexical_bm25": _BM + _TOP,
        "lexical_results": f"""SELECT query_id, rank, chunk_id, title, snippet FROM ({_LEX}{_TOP}) JOIN {_Q} qq USING (query_id) JOIN
            (SELECT DISTINCT tenant_id, chunk_id, title, CASE WHEN length(trim(text)) > 240 THEN rtrim(substring(trim(text), 1, 240)) || '…' ELSE trim(text) END AS snippet FROM chunks WHERE valid_to IS NULL) USING (tenant_id, chunk_id) WHERE rank <= 6""",
        "query_lexemes": f"SELECT query_id, array_to_string(list_sort(list_distinct({_TOK})), ' | ') AS lexemes FROM (SELECT query_id, any_value(text) AS text FROM eval_queries GROUP BY query_id)",
        "langs_by_tenant": f"SELECT tenant_id, lang, count(DISTINCT doc_id) AS n_docs, {_CONFIG} AS config FROM chunks WHERE valid_to IS NULL AND lang <> '' GROUP BY tenant_id, lang",
        "dense_topk": """
            SELECT query_id, item_id, round(score, 5) AS score, rank FROM (
                SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
                       row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
                FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 10""",
        "unembedded_queue": "SELECT source, min(doc_id) AS next_doc, count(*) AS \"left\" FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY source",
        "rrf_fuse": f"WITH {_ARM}, {_FUSED} SELECT query_id, chunk_id, score FROM f",
        "rrf_arm_ranks": f"WITH {_ARM} SELECT query_id, chunk_id, coalesce(max(CASE WHEN arm = 'lexical' THEN rank END), 0) AS lexical_rank, coalesce(max(CASE WHEN arm = 'dense' THEN rank END), 0) AS dense_rank FROM a GROUP BY query_id, chunk_id",
        "rerank_head_tail": f"""
            WITH {_ARM}, {_FUSED},
            m AS (SELECT DISTINCT query_id, chunk_id, score AS ms FROM ranked_chunks WHERE arm = 'rerank' AND score IS NOT NULL),
            r AS (SELECT f.query_id, f.chunk_id, ms, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.chunk_id) AS fr FROM f LEFT JOIN m ON m.query_id = f.query_id AND m.chunk_id = f.chunk_id)
            SELECT query_id, chunk_id, rank FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (fr > 32 OR ms IS NULL)::INT, CASE WHEN fr > 32 OR ms IS NULL THEN fr::DOUBLE ELSE -ms END, chunk_id) AS rank FROM r) WHERE rank <= 6""",
        "ir_by_query": f"WITH {_ARM}, {_FUSED}, r AS (SELECT 'hybrid' AS config, query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f), {_METRICS} SELECT query_id, {_ROUNDED} FROM m",
        "retrieval_ablation": f"WITH {_ARM}, {_FUSED}, r AS (SELECT 'hybrid' AS config, query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f UNION ALL SELECT arm, query_id, chunk_id, rank FROM a), {_METRICS} SELECT config, count(*) AS n, {_MEANS} FROM m WHERE n_gold > 0 GROUP BY config",
    }
