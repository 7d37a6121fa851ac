"""Lexical, dense and fused retrieval as joins, aggregations and windows.

Lexical search joins distinct query lexemes with postings on (tenant, lexeme).  The tenant and the
periods are filtered before anything is ranked, and every task keeps the first k rows of each query, so a
query whose candidates are a third of all rows is cut down before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import prepare

RRF_K = 60
SLICES = 16
GROUP_LIMIT = 1000  # the planner's own limit for keeping k rows per group in map tasks


def postings(chunks: DataFrame, tokens: Column) -> DataFrame:
    """tenant_id, chunk_id, lexeme, tf and the length of each chunk, from one row per chunk."""
    rows = chunks.select("tenant_id", "chunk_id", tokens.alias("tokens")).withColumn("length", F.size("tokens"))
    return rows.select("tenant_id", "chunk_id", "length", F.explode("tokens").alias("lexeme")).groupBy("tenant_id", "chunk_id", "length", "lexeme").agg(F.count(F.lit(1)).alias("tf"))


def query_lexemes(queries: DataFrame, tokens: Column) -> DataFrame:
    """query_id, tenant_id, lexeme: the disjunction of a query's distinct lexemes; empty queries give no row."""
    return queries.select("query_id", "tenant_id", F.explode(F.array_distinct(tokens)).alias("lexeme"))


def top_k(scored: DataFrame, k: int, group: list[str], order: list[Column], item: str = "chunk_id") -> DataFrame:
    """First k rows of each group with their rank.

    Up to GROUP_LIMIT the planner keeps k rows of each group in every map task (WindowGroupLimit), so a
    hot group reaches its task as k rows per input task; beyond it groups are ranked in hash slices first.
    """
    outer = Window.partitionBy(*group).orderBy(*order)
    if k > GROUP_LIMIT:
        inner = Window.partitionBy(*group, "part").orderBy(*order)
        part = F.pmod(F.xxhash64(item), F.lit(SLICES))
        scored = scored.withColumn("part", part).withColumn("rank", F.row_number().over(inner)).filter(F.col("rank") <= k).drop("part")
    return scored.withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= k)


def lexical_scores(lexemes: DataFrame, posts: DataFrame) -> DataFrame:
    """Cover-density score of a disjunctive query: a tenth of the matching positions."""
    hits = lexemes.join(posts, ["tenant_id", "lexeme"])
    return hits.groupBy("query_id", "tenant_id", "chunk_id").agg((F.sum("tf") * F.lit(0.1)).alias("score"))


def bm25_scores(lexemes: DataFrame, posts: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 with statistics of the tenant's own chunks."""
    sizes = posts.select("tenant_id", "chunk_id", "length").distinct().groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    df = posts.groupBy("tenant_id", "lexeme").agg(F.count(F.lit(1)).alias("df"))
    wanted = lexemes.join(df, ["tenant_id", "lexeme"]).join(sizes, "tenant_id")
    hits = wanted.join(posts, ["tenant_id", "lexeme"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return hits.groupBy("query_id", "tenant_id", "chunk_id").agg(F.sum(part).alias("score"))


def reciprocal_rank_fusion(ranked: DataFrame, group: str = "query_id", item: str = "chunk_id", k: int = RRF_K, best: Sequence[str] = ()) -> DataFrame:
    """Sum of 1 / (k + rank) over arms, with the rank of each arm; one aggregation, no outer join.

    Of the columns in ``best`` the highest value over the arms is kept.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    return ranked.groupBy(group, item).agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", "rank")))).alias("ranks"),
        *[F.max(c).alias(c) for c in best],
    )


def rank_arms(scores: DataFrame, arms: list[str]) -> DataFrame:
    """Rank of each item within each arm: query_id, arm, chunk_id, score, rank.

    Arms that return nothing have no row; of several scores of one item in one arm the highest counts.
    """
    usable = F.col("arm").isin(arms) & F.col("score").isNotNull() & F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull()
    best = scores.filter(usable).groupBy("query_id", "arm", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "arm").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w))


def rerank(fused: DataFrame, model: DataFrame, head: int = 32, cut: int = 6) -> DataFrame:
    """The first ``head`` items by the model's score, the rest in fused order, cut to ``cut``."""
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    rows = fused.withColumn("fused_rank", F.row_number().over(first)).join(model, ["query_id", "chunk_id"], "left")
    tail = (F.col("fused_rank") > head) | F.col("model_score").isNull()
    final = Window.partitionBy("query_id").orderBy(
        F.when(tail, 1).otherwise(0), F.when(tail, F.col("fused_rank").cast("double")).otherwise(-F.col("model_score")), "chunk_id"
    )
    return rows.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= cut)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norm == 0, 1.0, norm)


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.to_pylist()
    return np.array(lists, dtype=np.float64) if lists else np.zeros((0, 0))


def _usable(vectors: DataFrame, key: str) -> DataFrame:
    """Rows with an id and a vector without gaps."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    return vectors.filter(F.col(key).isNotNull() & whole).select(F.col(key).cast("bigint").alias(key), "embedding")


def _nothing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "query_id bigint, item_id bigint, score double")


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """Exact nearest vectors by cosine: query_id, item_id, score.

    ``vectors``: item_id, embedding.  ``queries``: query_id, embedding; a stated set that is read in
    blocks of at most ``block`` rows, each sent to all tasks (at most block x dimension x 8 bytes).
    Every task keeps the k best of its batch per query, so only k rows per query and task are shuffled.
    Rows without an id or with a null in their vector are left out; a query never meets the item of its own id.
    """
    spark = vectors.sparkSession
    prepare(spark)
    items = _usable(vectors, "item_id")
    result: DataFrame | None = None
    ids: list[int] = []
    rows: list[list[float]] = []

    def one_block(ids: list[int], rows: list[list[float]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array(ids, dtype=np.int64), _unit(np.array(rows, dtype=np.float64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, qmat = shared.value
            for batch in batches:
                item = batch.column("item_id").to_numpy(zero_copy_only=False)
                if not len(item):
                    continue
                scores = qmat @ _unit(_matrix(batch.column("embedding"))).T
                scores[qid[:, None] == item[None, :]] = -np.inf
                keep = min(k, scores.shape[1])
                best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                # ties at the edge go by id in the final ranking, so equal scores are all kept
                edge = np.take_along_axis(scores, best, axis=1).min(axis=1)
                q, i = np.nonzero((scores >= edge[:, None]) & np.isfinite(scores))
                yield pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(item[i]), pa.array(scores[q, i])], names=["query_id", "item_id", "score"])

        return items.mapInArrow(run, "query_id bigint, item_id bigint, score double")

    for row in _usable(queries, "query_id").sort("query_id").toLocalIterator():
        ids.append(row["query_id"])
        rows.append(list(row["embedding"]))
        if len(ids) >= block:
            part = one_block(ids, rows)
            result = part if result is None else result.unionByName(part)
            ids, rows = [], []
    if ids or result is None:
        part = one_block(ids, rows) if ids else _nothing(vectors)
        result = part if result is None else result.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return result.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class VectorCells:
    """Cells of an approximate vector index: centroids fitted on a bounded sample, every row indexed."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int = 16, sample: int = 20_000, rounds: int = 12) -> VectorCells:
        """Spherical k-means over at most ``sample`` rows drawn by a hash of the id."""
        rows = _usable(vectors, "item_id").orderBy(F.xxhash64("item_id")).limit(sample).select("embedding").collect()
        if not rows:
            return cls(np.zeros((1, 0)))
        data = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64))
        centre = data[:: max(1, len(data) // cells)][:cells].copy()
        for _ in range(rounds):
            own = (data @ centre.T).argmax(axis=1)
            for c in range(len(centre)):
                if (own == c).any():
                    centre[c] = data[own == c].mean(axis=0)
            centre = _unit(centre)
        return cls(centre)

    def search(self, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int = 12, block: int = 2048) -> DataFrame:
        """Like dense_top_k, but each query meets only the ``probes`` cells nearest to it."""
        spark = vectors.sparkSession
        prepare(spark)
        rows = _usable(queries, "query_id").sort("query_id")
        result: DataFrame | None = None
        taken: list = []

        def one_block(block_rows: list) -> DataFrame:
            qid = np.array([r["query_id"] for r in block_rows], dtype=np.int64)
            qmat = _unit(np.array([r["embedding"] for r in block_rows], dtype=np.float64))
            nearest = np.argsort(-(qmat @ self.centroids.T), axis=1)[:, :probes]
            asked = [np.flatnonzero((nearest == c).any(axis=1)) for c in range(len(self.centroids))]
            shared = spark.sparkContext.broadcast((qid, qmat, self.centroids, asked))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                qid, qmat, centre, asked = shared.value
                for batch in batches:
                    item = batch.column("item_id").to_numpy(zero_copy_only=False)
                    if not len(item):
                        continue
                    data = _unit(_matrix(batch.column("embedding")))
                    cell = (data @ centre.T).argmax(axis=1)
                    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                    for c in np.unique(cell):
                        mine, who = np.flatnonzero(cell == c), asked[c]
                        if not len(who):
                            continue
                        s = qmat[who] @ data[mine].T
                        s[qid[who][:, None] == item[mine][None, :]] = -np.inf
                        keep = min(k, s.shape[1])
                        edge = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                        q, i = np.nonzero((s >= edge[:, None]) & np.isfinite(s))
                        out.append((qid[who][q], item[mine][i], s[q, i]))
                    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["query_id", "item_id", "score"])

            return _usable(vectors, "item_id").mapInArrow(run, "query_id bigint, item_id bigint, score double")

        for row in rows.toLocalIterator():
            taken.append(row)
            if len(taken) >= block:
                part = one_block(taken)
                result = part if result is None else result.unionByName(part)
                taken = []
        if taken:
            part = one_block(taken)
            result = part if result is None else result.unionByName(part)
        if result is None:
            result = _nothing(vectors)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
        return result.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Recall, precision, hit, reciprocal rank and nDCG at k of every query.

    ``ranked``: query_id, item, rank.  ``gold``: query_id, item (relevant items).  Queries without
    relevant items have 0 everywhere.
    """
    relevant = gold.select("query_id", "item").distinct().withColumn("is_relevant", F.lit(1))
    n_gold = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    head = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "item"], "left")
    hit = F.coalesce("is_relevant", F.lit(0))
    per = head.groupBy("query_id").agg(
        F.sum(hit).alias("found"),
        F.count(F.lit(1)).alias("returned"),
        F.min(F.when(hit == 1, F.col("rank"))).alias("first"),
        F.sum(hit / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    every = ranked.select("query_id").distinct().join(n_gold, "query_id", "left").join(per, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_gold").cast("int")))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    has = F.coalesce("n_gold", F.lit(0)) > 0
    return every.select(
        "query_id",
        F.when(has, F.col("found") / F.col("n_gold")).otherwise(0.0).alias("recall"),
        F.when(has & (F.col("returned") > 0), F.col("found") / F.col("returned")).otherwise(0.0).alias("precision"),
        F.when(has & (F.col("found") > 0), 1.0).otherwise(0.0).alias("hit"),
        F.when(has & F.col("first").isNotNull(), 1.0 / F.col("first")).otherwise(0.0).alias("rr"),
        F.when(has, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
    )
