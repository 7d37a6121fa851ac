"""One object for the usual path: ingest, read as of a moment, retrieve, answer, calibrate, decide, monitor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.operators import drift, history, retrieval, risk, temporal, textops
from tarnlake.session import prepare


@dataclass(frozen=True)
class Config:
    """Defaults of all stages."""

    target_chars: int = 1200
    overlap_chars: int = 150
    min_chars: int = 120
    lexical_k: int = 50
    rrf_k: int = 60
    rerank_head: int = 32
    top_n: int = 6
    max_claims: int = 4
    alpha: float = 0.05
    delta: float = 0.05
    support: float = 0.5
    drift_level: float = 100.0
    drift_jump: float = 0.01


class Engine:
    """Stages as methods; each takes and returns DataFrames."""

    def __init__(self, spark: SparkSession, config: Config | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        prepare(spark)

    def ingest(self, submissions: DataFrame) -> DataFrame:
        """Version history of all submitted documents."""
        return history.attribute_history(submissions)

    def chunk(self, texts: DataFrame) -> DataFrame:
        """Chunks of tenant_id, doc_id, version, text under the configured limits."""
        c = self.config
        rows = texts.withColumns({"_t": F.lit(c.target_chars), "_o": F.lit(c.overlap_chars), "_m": F.lit(c.min_chars)})
        made = textops.chunked(rows, target="_t", overlap="_o", least="_m")
        return made.withColumn("chunk_id", F.format_string("%s:v%d:chunk_%04d", F.col("doc_id"), F.col("version"), F.col("ordinal")))

    def as_of(self, rows: DataFrame, valid_at: Column, known_at: Column | None = None) -> DataFrame:
        return temporal.as_of(rows, valid_at, known_at)

    def retrieve(self, queries: DataFrame, chunks: DataFrame, dense: DataFrame | None = None) -> DataFrame:
        """Fused top chunks of query_id, tenant_id, text over tenant_id, chunk_id, text; ``dense`` holds query_id, chunk_id, rank."""
        posts = retrieval.postings(chunks, T.tokens(F.col("text")))
        scored = retrieval.lexical_scores(retrieval.query_lexemes(queries, T.tokens(F.col("text"))), posts)
        order = [F.desc("score"), F.asc("chunk_id")]
        arms = retrieval.top_k(scored, self.config.lexical_k, ["query_id"], order).select("query_id", "chunk_id", "rank", F.lit("lexical").alias("arm"))
        if dense is not None:
            arms = arms.unionByName(dense.select("query_id", "chunk_id", "rank", F.lit("dense").alias("arm")))
        fused = retrieval.reciprocal_rank_fusion(arms, k=self.config.rrf_k)
        return retrieval.top_k(fused, self.config.top_n, ["query_id"], order)

    def answer(self, queries: DataFrame, retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
        """Extracted claims with their citation and overlap with the cited chunk: query_id, claims."""
        passages = retrieved.join(chunks.select("chunk_id", F.col("text").alias("passage")), "chunk_id").select("query_id", "chunk_id", "passage")
        found = textops.extracted_answers(queries, passages, self.config.max_claims)
        scored = found.join(chunks.select("chunk_id", F.col("text").alias("premise")), "chunk_id")
        claim = F.struct("place", F.col("sentence").alias("text"), "chunk_id", T.overlap_score(F.col("premise"), F.col("sentence")).alias("overlap"))
        ordered = F.array_sort(F.collect_list(claim))
        shaped = F.transform(
            ordered, lambda c: F.struct(c["text"].alias("text"), F.array(c["chunk_id"]).alias("citations"), F.create_map(F.lit("overlap"), c["overlap"]).alias("scores"))
        )
        return scored.groupBy("query_id").agg(shaped.alias("claims"))

    def calibrate(self, observations: DataFrame, keys: tuple[str, ...] = (), sequential: bool = False) -> DataFrame:
        """Certified threshold per key."""
        candidates = risk.threshold_candidates(observations, keys)
        return risk.select_threshold(candidates, self.config.alpha, self.config.delta, keys, sequential)

    def observe(self, records: DataFrame, variant: str, mode: str, loss: str = "gold") -> DataFrame:
        return risk.observations(records, variant, mode, loss, self.config.support)

    def decide(self, observations: DataFrame, threshold: Column) -> DataFrame:
        """answer where the statistic does not pass the threshold, else abstain."""
        return observations.withColumn("decision", F.when(F.col("answered") & (F.col("statistic") <= threshold), "answer").otherwise("abstain"))

    def monitor(self, stream: DataFrame) -> DataFrame:
        return drift.monitored(stream, self.config.drift_level, self.config.drift_jump)

    def experiments(self, observations: DataFrame, trials: int = 200, keys: tuple[str, ...] = ()) -> DataFrame:
        """Summary of repeated splits per key."""
        c = self.config
        return risk.trial_summary(risk.repeated_trials(observations, trials, c.alpha, c.delta, keys), c.alpha, keys)
