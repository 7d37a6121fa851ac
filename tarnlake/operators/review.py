"""Human review of evaluation queries: decisions that stay, checks of drafts, splits that stay balanced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("draft", "verified", "rejected")
# Categories of queries, and characters of the shortest quote.
CATEGORIES = ("answerable", "multi-doc", "unanswerable", "paraphrase", "temporal", "trap")
LEAST_QUOTE = 15


def decided(queries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queries with the latest decision on each: ``decisions`` holds query_id, status, note, decided_at."""
    known = decisions.filter(F.col("status").isin(*STATUSES))
    last = known.groupBy("query_id").agg(F.max_by(F.struct("status", "note"), F.struct("decided_at", "status")).alias("d"))
    joined = queries.join(last, "query_id", "left")
    return joined.withColumns({"status": F.coalesce("d.status", "status"), "note": F.coalesce("d.note", "note")}).drop("d")


def merged(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """New drafts with the decisions people made on the same ids; prior queries that vanished are left out."""
    kept = prior.filter("status <> 'draft'").select("query_id", F.col("status").alias("_status"), F.col("note").alias("_note")).dropDuplicates(["query_id"])
    rows = fresh.join(kept, "query_id", "left")
    return rows.withColumns({"status": F.coalesce("_status", "status"), "note": F.coalesce("_note", "note")}).drop("_status", "_note")


def draft_problems(queries: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Every rule a draft breaks, in one pass: query_id, problem.

    ``held`` says of quotes whether a relevant document holds them (query_id, quote, held); quotes that none holds
    and ids that stand on several rows are reported too.
    """
    docs, quotes = F.coalesce(F.size("relevant_docs"), F.lit(0)), F.coalesce(F.size("evidence"), F.lit(0))
    blank = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    unanswerable = F.coalesce(F.col("category"), F.lit("")) == "unanswerable"
    rules: dict[str, Column] = {
        "no text": blank("text"),
        "no tenant": F.col("tenant_id").isNull(),
        "unknown status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "unknown category": ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)),
        "answerable without documents": ~unanswerable & (docs < 1),
        "unanswerable with documents": unanswerable & (docs > 0),
        "one document for several": (F.col("category") == "multi-doc") & (docs < 2),
        "unanswerable with evidence": unanswerable & (quotes > 0),
        "no evidence": ~unanswerable & (quotes < 1),
        "no answer": ~unanswerable & blank("answer"),
        "repeated document": F.size(F.array_distinct("relevant_docs")) < F.size("relevant_docs"),
        "short quote": ~unanswerable & F.exists("evidence", lambda e: F.char_length(F.trim(e)) < LEAST_QUOTE),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    found = queries.select("query_id", F.explode(broken).alias("problem"))
    repeated = queries.groupBy("query_id").count().filter("count > 1").select("query_id", F.lit("repeated id").alias("problem"))
    found = found.unionByName(repeated)
    if held is not None:
        found = found.unionByName(held.filter(~F.col("held")).select("query_id", F.lit("quote in no document").alias("problem")))
    return found.distinct()


def strided_split(rows: DataFrame, fraction: float, group: list[str], order: list[str]) -> DataFrame:
    """Marks every row test or calibration so that each group keeps the share at every point of its order."""
    w = Window.partitionBy(*group).orderBy(*order)
    n = F.row_number().over(w)
    step = 1 - fraction
    return rows.withColumn("is_test", F.floor(n * step + 1e-9) > F.floor((n - 1) * step + 1e-9))
