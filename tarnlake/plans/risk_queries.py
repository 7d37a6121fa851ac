"""Risk-control queries over response_records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.functions.binomial import least_sample, lower_tail
from tarnlake.operators import review
from tarnlake.operators import risk as R
from tarnlake.session import read

VARIANTS = ("nli", "overlap")
ALPHA, DELTA, TRIALS = 0.3, 0.05, 200
ALPHAS = (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4)
KINDS = ("number", "negation", "term", "date")  # kinds of planted errors in the records


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated records count once."""
    return read(spark, sf, "response_records").dropDuplicates(["query_id"])


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of every configuration: variant and mode."""
    records = _records(spark, sf).select("query_id", "claims", "answerable", "category")
    return R.observed_configurations(records, VARIANTS, R.MODES)


KEYS = ["variant", "mode"]


def _policy(mode: str):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        judged = R.judged_claims(_records(spark, sf), "nli", mode)
        rows = judged.select("query_id", F.posexplode("claims").alias("pos", "c"))
        return rows.select("query_id", (F.col("pos") + 1).cast("bigint").alias("claim_no"), F.col("c.score").alias("score"), F.col("c.action").alias("action"))

    run.__name__ = f"claim_policy_{mode}"
    run.__doc__ = f"Action on every claim under the {mode} policy."
    return run


def observations_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Statistic, gold loss and usefulness of every response in every configuration."""
    rows = _observed(spark, sf)
    return rows.select(*KEYS, "query_id", F.round("statistic", 6).alias("statistic"), "loss", "answered", "useful", "answerable")


def observations_verifier(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the verifier's own judgement as the loss, flagged mode."""
    rows = R.observations(_records(spark, sf), "nli", "flagged", loss="verifier")
    return rows.select("query_id", F.round("statistic", 6).alias("statistic"), "loss", "answered")


def assemble_answer(spark: SparkSession, sf: str) -> DataFrame:
    """Answers put together from the claims that are left."""
    return R.assembled_answers(_records(spark, sf), "nli", "strict").select("query_id", "answer", F.col("n_claims").cast("bigint").alias("n_claims"))


def lambda_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Answered and failed responses at every threshold of the grid, per configuration."""
    rows = R.threshold_candidates(_observed(spark, sf), KEYS)
    return rows.select(*KEYS, "lambda", "n", "answered", "failures")


def _selected(spark: SparkSession, sf: str, sequential: bool) -> DataFrame:
    rows = R.select_threshold(R.threshold_candidates(_observed(spark, sf), KEYS), ALPHA, DELTA, KEYS, sequential)
    return rows.select(*KEYS, "certified", "threshold", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"), "n_certified")


def ltt_bonferroni(spark: SparkSession, sf: str) -> DataFrame:
    """Certified threshold of every configuration, all thresholds tested at once."""
    return _selected(spark, sf, sequential=False)


def ltt_fixed_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """The same with thresholds tested in order."""
    return _selected(spark, sf, sequential=True)


def binomial_tail_table(spark: SparkSession, sf: str) -> DataFrame:
    """Lower tails of the answered and failed counts that occur."""
    rows = R.threshold_candidates(_observed(spark, sf), KEYS).filter(F.col("answered") > 0).select("answered", "failures").distinct()
    rows = rows.withColumn("p", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.3, 0.4)])))
    return rows.select("answered", "failures", "p", F.round(lower_tail(F.col("failures"), F.col("answered"), F.col("p")), 6).alias("tail"))


def min_certifiable_n(spark: SparkSession, sf: str) -> DataFrame:
    """Flawless answers needed to certify, for one test and for the whole grid, against the responses at hand."""
    have = _records(spark, sf).agg(F.count(F.lit(1)).alias("have"))
    alphas = [0.02, 0.05, 0.1, 0.15, 0.3]
    table = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(least_sample(DELTA, a)).cast("bigint").alias("single"), F.lit(least_sample(DELTA / R.GRID, a)).cast("bigint").alias("whole_grid")) for a in alphas]))
    return have.select("have", table.alias("t")).select("t.alpha", "t.single", "t.whole_grid", (F.col("have") >= F.col("t.single")).alias("single_possible"))


def transfer_test(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds certified on Turkish responses, tested as one hypothesis on English ones."""
    records = _records(spark, sf)
    learn = R.observations(records.filter("lang = 'tr'"), "nli", "strict")
    chosen = R.select_threshold(R.threshold_candidates(learn), ALPHA, DELTA)
    test = R.threshold_candidates(R.observations(records.filter("lang = 'en'"), "nli", "strict"))
    joined = test.join(chosen.select(F.col("threshold").alias("lambda"), "certified"), "lambda")
    p = lower_tail(F.col("failures"), F.col("answered"), F.lit(ALPHA))
    return joined.select(F.col("lambda").alias("threshold"), "answered", "failures", F.round(p, 6).alias("p_value"), ((F.col("answered") > 0) & (p <= DELTA)).alias("holds"))


def operating_point(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of every configuration at threshold 0.5."""
    rows = R.operating_point(_observed(spark, sf), F.lit(0.5), KEYS)
    return rows.select(*KEYS, "n", *[F.round(c, 6).alias(c) for c in ("answer_rate", "risk", "useful_rate", "unanswerable_answered")])


def risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Risk-coverage curve of every configuration."""
    rows = R.risk_coverage(_observed(spark, sf), KEYS)
    return rows.select(*KEYS, "query_id", F.col("k").cast("bigint").alias("k"), F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


def aurc(spark: SparkSession, sf: str) -> DataFrame:
    """Mean risk along the curve."""
    rows = R.risk_coverage(_observed(spark, sf), KEYS)
    return rows.groupBy(*KEYS).agg(F.round(F.avg("risk"), 6).alias("aurc"), F.count(F.lit(1)).alias("points"))


def risk_at_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Risk at half and at four fifths coverage."""
    curve = R.risk_coverage(_observed(spark, sf), KEYS)
    half = R.risk_at(curve, 0.5, KEYS).withColumn("level", F.lit(0.5))
    return half.unionByName(R.risk_at(curve, 0.8, KEYS).withColumn("level", F.lit(0.8))).select(*KEYS, "level", F.round("risk", 6).alias("risk"))


def auroc_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """How well each score tells clean claims from corrupted ones of each kind."""
    claims = _records(spark, sf).select(F.explode("claims").alias("c")).filter(F.col("c.scores").isNotNull())
    rows = claims.select(F.col("c.corrupted").alias("corrupted"), F.col("c.kind").alias("kind"), F.explode("c.scores").alias("variant", "score")).filter(F.col("score").isNotNull())
    bad = rows.filter("corrupted").select("variant", "kind", "score", F.lit(False).alias("is_clean"))
    # clean claims count against every kind
    kinds = F.explode(F.array(*[F.lit(k) for k in KINDS]))
    good = rows.filter(~F.col("corrupted")).select("variant", kinds.alias("kind"), "score", F.lit(True).alias("is_clean"))
    result = R.auroc(bad.unionByName(good), ["variant", "kind"])
    return result.select("variant", "kind", "n_clean", "n_corrupted", F.round("auroc", 6).alias("auroc"))


def verifier_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """False accepts and false rejects by variant and kind, with a row over all kinds."""
    rows = R.claim_confusion(_records(spark, sf), VARIANTS)
    return rows.select("variant", "kind", "n_corrupted", "n_clean", F.round("false_accept", 6).alias("false_accept"), F.round("false_reject", 6).alias("false_reject"))


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    obs = _observed(spark, sf).select(*KEYS, "query_id", "statistic", "loss", "answered", "useful", "answerable")
    return R.repeated_trials(obs, TRIALS, ALPHA, DELTA, KEYS)


def repeated_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Certification and held-out counts of every random split of every configuration."""
    rows = _trials(spark, sf)
    return rows.select(*KEYS, F.col("trial").cast("bigint").alias("trial"), "certified", "threshold", "answered", "failures", "n_test")


def exceedance(spark: SparkSession, sf: str) -> DataFrame:
    """How often the held-out risk of certified splits passes alpha."""
    rows = R.trial_summary(_trials(spark, sf), ALPHA, KEYS)
    return rows.select(*KEYS, "n_trials", *[F.round(c, 6).alias(c) for c in ("certified_rate", "exceedance", "mean_risk", "answer_rate")])


def trial_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Means over the splits: threshold, risk with its half-width, useful rate, answered share of unanswerable responses."""
    rows = R.trial_summary(_trials(spark, sf), ALPHA, KEYS)
    return rows.select(*KEYS, "n_trials", *[F.round(c, 6).alias(c) for c in ("mean_threshold", "mean_risk", "risk_ci95", "useful_rate", "unanswerable_answered")])


def ablation_table(spark: SparkSession, sf: str) -> DataFrame:
    """Operating points of all expected configurations; those without records say so."""
    expected = spark.createDataFrame([(v, m) for v in (*VARIANTS, "logit", "nli-window") for m in R.MODES], "variant string, mode string")
    have = operating_point(spark, sf)
    return expected.join(have, KEYS, "left").select(*KEYS, F.when(F.col("n").isNull(), "not run").otherwise("run").alias("state"), F.coalesce("n", F.lit(0)).alias("n"), "answer_rate", "risk")


def recall_of_records(spark: SparkSession, sf: str) -> DataFrame:
    """Document recall and evidence recall of answerable responses by category; unlabelled evidence is left out."""
    rows = _records(spark, sf).filter("answerable")
    hit = F.arrays_overlap("retrieved_docs", "relevant_docs")
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 6).alias("doc_recall"),
        F.count("evidence_retrieved").alias("n_labelled"),
        F.round(F.avg(F.col("evidence_retrieved").cast("double")), 6).alias("evidence_recall"),
    )


def citation_check(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of each claim that its response did retrieve, and those that dangle."""
    rows = _records(spark, sf).select("query_id", "retrieved", F.posexplode("claims").alias("pos", "c"))
    cited = F.coalesce(F.col("c.citations"), F.array().cast("array<string>"))
    known = F.array_intersect(cited, F.coalesce("retrieved", F.array().cast("array<string>")))
    return rows.select(
        "query_id", (F.col("pos") + 1).cast("bigint").alias("claim_no"), F.size(F.array_distinct(cited)).cast("bigint").alias("cited"), F.size(known).cast("bigint").alias("known"), F.array_join(F.array_sort(known), ",").alias("kept")
    )


def overlap_of_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of each claim with its cited chunks' texts, joined in citation order; uncited claims have 0."""
    claims = _records(spark, sf).select("query_id", F.posexplode("claims").alias("pos", "c"))
    cited = claims.select("query_id", "pos", F.col("c.text").alias("claim"), F.posexplode_outer("c.citations").alias("place", "chunk_id"))
    chunks = read(spark, sf, "chunks").select("chunk_id", F.col("text").alias("chunk_text")).groupBy("chunk_id").agg(F.min("chunk_text").alias("chunk_text"))
    parts = cited.join(chunks, "chunk_id", "left").groupBy("query_id", "pos").agg(
        F.first("claim").alias("claim"), F.array_sort(F.collect_list(F.when(F.col("chunk_text").isNotNull(), F.struct("place", "chunk_text")))).alias("parts")
    )
    premise = F.array_join(F.transform("parts", lambda p: p["chunk_text"]), "\n\n")
    return parts.select("query_id", (F.col("pos") + 1).cast("bigint").alias("claim_no"), F.round(T.overlap_score(premise, F.col("claim")), 6).alias("overlap"))


def any_evidence_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Best overlap of each claim with any chunk that its response retrieved, cited or not."""
    records = _records(spark, sf)
    claims = records.select("query_id", F.posexplode("claims").alias("pos", "c")).select("query_id", "pos", F.col("c.text").alias("claim"))
    chunks = read(spark, sf, "chunks").groupBy("chunk_id").agg(F.min("text").alias("premise"))
    held = records.select("query_id", F.explode("retrieved").alias("chunk_id")).distinct().join(chunks, "chunk_id")
    scored = claims.join(held, "query_id", "left").groupBy("query_id", "pos").agg(F.max(T.overlap_score(F.col("premise"), F.col("claim"))).alias("best"))
    return scored.select("query_id", (F.col("pos") + 1).cast("bigint").alias("claim_no"), F.round("best", 6).alias("best"))


def latest_certified(spark: SparkSession, sf: str) -> DataFrame:
    """Latest certified threshold of every configuration among its trials, taken in their order."""
    rows = _trials(spark, sf).filter("certified")
    return rows.groupBy(*KEYS).agg(F.max("trial").cast("bigint").alias("trial"), F.max_by("threshold", "trial").alias("threshold"))


def paired_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Responses on which two variants disagree: answered by one and not by the other at threshold 0.5."""
    rows = _observed(spark, sf).filter("mode = 'strict'").withColumn("served", F.col("answered") & (F.col("statistic") <= 0.5))
    a = rows.filter("variant = 'nli'").select("query_id", F.col("served").alias("nli_served"))
    b = rows.filter("variant = 'overlap'").select("query_id", F.col("served").alias("overlap_served"))
    return a.join(b, "query_id").groupBy("nli_served", "overlap_served").agg(F.count(F.lit(1)).alias("n"))


def split_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of each category split in order, two fifths to the test side."""
    rows = review.strided_split(_records(spark, sf).select("query_id", "category"), 0.6, ["category"], ["query_id"])
    return rows.select("query_id", "category", "is_test")


def evidence_found(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the chunks of each response hold the start of any quote of its query."""
    retrieved = _records(spark, sf).select("query_id", F.explode("retrieved").alias("chunk_id"))
    asked = read(spark, sf, "eval_queries").select("query_id", "evidence").dropDuplicates(["query_id"])
    asked = asked.join(_records(spark, sf).select("query_id"), "query_id", "left_semi")
    rows = R.evidence_retrieved(retrieved, asked, read(spark, sf, "chunks").select("chunk_id", "text"))
    return rows.select("query_id", F.when(F.col("found").isNull(), "no evidence").when(F.col("found"), "found").otherwise("missing").alias("state"))


def guarantee_table(spark: SparkSession, sf: str) -> DataFrame:
    """What every configuration can guarantee at ten levels of risk."""
    rows = R.guarantees(R.threshold_candidates(_observed(spark, sf), KEYS), ALPHAS, DELTA, KEYS)
    return rows.select(*KEYS, "alpha", "certified", "threshold", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


def transfer_table(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds of each language of answers tested on every other language."""
    obs = R.observations(_records(spark, sf), "nli", "strict").join(_records(spark, sf).select("query_id", "lang"), "query_id")
    rows = R.transfer(obs, "lang", ALPHA, DELTA)
    return rows.select("learned_on", "tested_on", "threshold", "answered", "failures", F.round("p_value", 6).alias("p_value"), "holds")


def missing_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Claims without a score of each variant."""
    return R.missing_scores(_records(spark, sf), ("nli", "overlap", "logit", "hits"))


def queries() -> dict:
    listed = (
        *(_policy(m) for m in R.MODES), observations_gold, observations_verifier, assemble_answer, lambda_grid, ltt_bonferroni, ltt_fixed_sequence,
        binomial_tail_table, min_certifiable_n, transfer_test, operating_point, risk_coverage, aurc, risk_at_coverage, auroc_by_kind,
        verifier_confusion, repeated_splits, exceedance, trial_figures, ablation_table, recall_of_records, citation_check, overlap_of_claims,
        any_evidence_overlap, latest_certified, paired_observations, split_sides, evidence_found, guarantee_table, transfer_table, missing_scores,
    )
    return {f.__name__: f for f in listed}


_R = """r AS (SELECT query_id, any_value(claims) AS claims, any_value(answerable) AS answerable, any_value(category) AS category, any_value(lang) AS lang,
    any_value(retrieved) AS retrieved, any_value(retrieved_docs) AS retrieved_docs, any_value(relevant_docs) AS relevant_docs, any_value(evidence_retrieved) AS evidence_retrieved
    FROM response_records GROUP BY query_id),
    c0 AS (SELECT query_id, i AS claim_no, claims[i] AS c FROM (SELECT query_id, claims, unnest(range(1, len(claims) + 1)) AS i FROM r))"""
_CONFIG = "(SELECT unnest(['nli', 'overlap']) AS variant) v, (SELECT unnest(['strict', 'flagged', 'permissive']) AS mode) m"
_OBS = f"""{_R},
    c AS (SELECT query_id, variant, mode, coalesce(c.scores[variant], 0)::DOUBLE AS score, coalesce(c.corrupted, false) AS corrupted, coalesce(c.on_evidence, false) AS on_evidence,
          (coalesce(c.scores[variant], 0) >= 0.5::DOUBLE OR mode <> 'strict') AS l FROM c0, {_CONFIG}),
    o AS (SELECT r.query_id, v.variant, m.mode, answerable, category, lang,
          CASE WHEN count(*) FILTER (WHERE l) > 0 THEN 1.0::DOUBLE - min(score) FILTER (WHERE l) ELSE 1.0::DOUBLE END AS statistic,
          coalesce(bool_or(l AND corrupted), false) AS loss, coalesce(bool_or(l), false) AS answered, coalesce(bool_or(l AND on_evidence AND NOT corrupted), false) AS useful
          FROM r CROSS JOIN {_CONFIG} LEFT JOIN c ON c.query_id = r.query_id AND c.variant = v.variant AND c.mode = m.mode GROUP BY ALL)"""


def _plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


_GRID = "gr AS (SELECT i AS place, round(i * 0.02::DOUBLE, 2) AS lam FROM range(1, 51) t(i))"


def _cand(source: str, keys: str) -> str:
    return f"SELECT {keys}, place, lam, count(*) AS n, count(*) FILTER (WHERE answered AND statistic <= lam) AS k, count(*) FILTER (WHERE answered AND statistic <= lam AND loss) AS b FROM {source}, gr GROUP BY ALL"


def _tail(k: str, n: str, p: str) -> str:
    return f"""CASE WHEN {k} >= {n} THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum(list_transform(range(0, {k} + 1), lambda i:
        exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))) END"""


_A, _D = f"{ALPHA}::DOUBLE", f"{DELTA}::DOUBLE"
_PVAL = _tail("b", "k", _A)


def _select(keys: str, source: str, sequential: bool) -> str:
    ok = f"(k > 0 AND pv <= {_D if sequential else _D + ' / 50'})"
    step = f"min({ok}::INT) OVER (PARTITION BY {keys} ORDER BY place) = 1" if sequential else ok
    return f"""SELECT {keys}, bool_or(ok) AS certified, coalesce(arg_max(lam, (k, lam)) FILTER (WHERE ok), 0)::DOUBLE AS threshold,
        coalesce(max(k) FILTER (WHERE ok) / any_value(n), 0)::DOUBLE AS coverage, coalesce((arg_max(b, (k, lam)) FILTER (WHERE ok)) / (max(k) FILTER (WHERE ok)), 1)::DOUBLE AS risk,
        count(*) FILTER (WHERE ok) AS n_certified FROM (SELECT *, {step} AS ok FROM (SELECT *, {_PVAL} AS pv FROM {source})) GROUP BY {keys}"""


_KEYS = "variant, mode"
_CURVE = """cv AS (SELECT o.variant, o.mode, query_id, row_number() OVER w AS k, row_number() OVER w / total::DOUBLE AS coverage, sum(loss::INT) OVER w / (row_number() OVER w)::DOUBLE AS risk
    FROM o JOIN (SELECT variant, mode, count(*) AS total FROM o GROUP BY ALL) t ON t.variant = o.variant AND t.mode = o.mode WHERE answered
    WINDOW w AS (PARTITION BY o.variant, o.mode ORDER BY statistic, query_id ROWS UNBOUNDED PRECEDING))"""
_POINT = f"""SELECT {_KEYS}, count(*) AS n, count(*) FILTER (WHERE s) / count(*)::DOUBLE AS answer_rate,
    CASE WHEN count(*) FILTER (WHERE s) > 0 THEN count(*) FILTER (WHERE s AND loss) / count(*) FILTER (WHERE s) ELSE 0 END::DOUBLE AS risk,
    count(*) FILTER (WHERE s AND useful) / count(*)::DOUBLE AS useful_rate,
    CASE WHEN count(*) FILTER (WHERE NOT answerable) > 0 THEN count(*) FILTER (WHERE s AND NOT answerable) / count(*) FILTER (WHERE NOT answerable)::DOUBLE END AS unanswerable_answered
    FROM (SELECT *, answered AND statistic <= 0.5::DOUBLE AS s FROM o) GROUP BY ALL"""
_SPLIT = f"""{_OBS}, {_GRID},
    sp AS (SELECT *, ('0x' || substr(sha256(trial::VARCHAR || ':' || query_id), 1, 8))::UBIGINT::DOUBLE / pow(2, 32) < 0.6::DOUBLE AS cal FROM o, (SELECT unnest(range(0, {TRIALS})) AS trial)),
    cc AS ({_cand("(SELECT * FROM sp WHERE cal)", "variant, mode, trial")}),
    ch AS ({_select("variant, mode, trial", "cc", False)}),
    tt AS ({_cand("(SELECT * FROM sp WHERE NOT cal)", "variant, mode, trial")}),
    tn AS (SELECT variant, mode, trial, count(*) AS n_test FROM sp WHERE NOT cal GROUP BY ALL),
    tr AS (SELECT ch.variant, ch.mode, ch.trial, certified, threshold, coalesce(tt.k, 0) AS answered, coalesce(tt.b, 0) AS failures, n_test
           FROM ch LEFT JOIN tt ON tt.variant = ch.variant AND tt.mode = ch.mode AND tt.trial = ch.trial AND tt.lam = ch.threshold
           JOIN tn ON tn.variant = ch.variant AND tn.mode = ch.mode AND tn.trial = ch.trial)"""
_WORDS = "list_filter(list_distinct(regexp_extract_all(lower(replace({x}, 'İ', 'i')), '[\\p{{L}}\\p{{N}}_]+')), lambda w: NOT list_contains([{stop}], w))"


def _words(x: str) -> str:
    return _WORDS.format(x=x, stop=", ".join(f"'{w}'" for w in T.OVERLAP_STOPWORDS))


def oracle_sql() -> dict[str, str]:
    found = {
        f"claim_policy_{mode}": f"WITH {_R} SELECT query_id, claim_no, coalesce(c.scores['nli'], 0)::DOUBLE AS score, CASE WHEN coalesce(c.scores['nli'], 0) >= 0.5::DOUBLE THEN 'kept' ELSE '{other}' END AS action FROM c0"
        for mode, other in (("strict", "removed"), ("flagged", "flagged"), ("permissive", "kept"))
    }
    return found | {
        "observations_gold": f"WITH {_OBS} SELECT {_KEYS}, query_id, round(statistic, 6) AS statistic, loss, answered, useful, answerable FROM o",
        "observations_verifier": f"""WITH {_R} SELECT r.query_id, round(coalesce(1.0::DOUBLE - min(coalesce(c.scores['nli'], 0)) FILTER (WHERE c0.query_id IS NOT NULL), 1.0), 6)::DOUBLE AS statistic,
            coalesce(bool_or(coalesce(c.scores['nli'], 0) < 0.5::DOUBLE) FILTER (WHERE c0.query_id IS NOT NULL), false) AS loss, count(c0.query_id) > 0 AS answered FROM r LEFT JOIN c0 USING (query_id) GROUP BY r.query_id""",
        "assemble_answer": f"""WITH {_R} SELECT r.query_id, coalesce(string_agg(trim(c.text), ' ' ORDER BY claim_no) FILTER (WHERE length(trim(c.text)) > 0 AND c.scores['nli'] >= 0.5::DOUBLE), '') AS answer,
            count(*) FILTER (WHERE c.scores['nli'] >= 0.5::DOUBLE) AS n_claims FROM r LEFT JOIN c0 USING (query_id) GROUP BY r.query_id""",
        "lambda_grid": f"WITH {_OBS}, {_GRID} SELECT {_KEYS}, lam AS lambda, n, k AS answered, b AS failures FROM ({_cand('o', _KEYS)})",
        "ltt_bonferroni": f"WITH {_OBS}, {_GRID}, cd AS ({_cand('o', _KEYS)}) SELECT {_KEYS}, certified, threshold, round(coverage, 6) AS coverage, round(risk, 6) AS risk, n_certified FROM ({_select(_KEYS, 'cd', False)})",
        "ltt_fixed_sequence": f"WITH {_OBS}, {_GRID}, cd AS ({_cand('o', _KEYS)}) SELECT {_KEYS}, certified, threshold, round(coverage, 6) AS coverage, round(risk, 6) AS risk, n_certified FROM ({_select(_KEYS, 'cd', True)})",
        "binomial_tail_table": f"WITH {_OBS}, {_GRID}, cd AS ({_cand('o', _KEYS)}) SELECT k AS answered, b AS failures, p, round({_tail('b', 'k', 'p')}, 6) AS tail FROM (SELECT DISTINCT k, b FROM cd WHERE k > 0), (SELECT unnest([0.05, 0.1, 0.3, 0.4]::DOUBLE[]) AS p)",
        "min_certifiable_n": f"""SELECT alpha, ceil(ln({_D}) / ln(1 - alpha))::BIGINT AS single, ceil(ln({_D} / 50) / ln(1 - alpha))::BIGINT AS whole_grid,
            (SELECT count(DISTINCT query_id) FROM response_records) >= ceil(ln({_D}) / ln(1 - alpha)) AS single_possible FROM (SELECT unnest([0.02, 0.05, 0.1, 0.15, 0.3]::DOUBLE[]) AS alpha)""",
        "transfer_test": f"""WITH {_OBS}, {_GRID}, s AS (SELECT *, 1 AS one FROM o WHERE variant = 'nli' AND mode = 'strict'),
            a AS ({_cand("(SELECT * FROM s WHERE lang = 'tr')", 'one')}), ch AS ({_select('one', 'a', False)}), t AS ({_cand("(SELECT * FROM s WHERE lang = 'en')", 'one')})
            SELECT threshold, k AS answered, b AS failures, round({_PVAL}, 6) AS p_value, k > 0 AND {_PVAL} <= {_D} AS holds FROM t JOIN ch ON lam = threshold""",
        "operating_point": f"WITH {_OBS} SELECT {_KEYS}, n, round(answer_rate, 6) AS answer_rate, round(risk, 6) AS risk, round(useful_rate, 6) AS useful_rate, round(unanswerable_answered, 6) AS unanswerable_answered FROM ({_POINT})",
        "risk_coverage": f"WITH {_OBS}, {_CURVE} SELECT {_KEYS}, query_id, k, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM cv",
        "aurc": f"WITH {_OBS}, {_CURVE} SELECT {_KEYS}, round(avg(risk), 6) AS aurc, count(*) AS points FROM cv GROUP BY ALL",
        "risk_at_coverage": f"""WITH {_OBS}, {_CURVE} SELECT {_KEYS}, level, round(coalesce(arg_max(risk, coverage) FILTER (WHERE coverage <= level + 1e-12), arg_min(risk, k)), 6) AS risk
            FROM cv, (SELECT unnest([0.5, 0.8]::DOUBLE[]) AS level) GROUP BY ALL""",
        "auroc_by_kind": f"""WITH {_R}, s AS (SELECT c.corrupted AS bad, c.kind AS kind, variant, c.scores[variant] AS score FROM c0, (SELECT unnest(['nli', 'overlap', 'logit', 'hits']) AS variant) WHERE c.scores[variant] IS NOT NULL),
            ks AS (SELECT unnest(['number', 'negation', 'term', 'date']) AS kind),
            u AS (SELECT variant, kind, score, 0 AS good FROM s WHERE bad UNION ALL SELECT variant, ks.kind, score, 1 FROM s, ks WHERE NOT bad),
            rk AS (SELECT *, rank() OVER (PARTITION BY variant, kind ORDER BY score) + (count(*) OVER (PARTITION BY variant, kind, score) - 1) / 2.0::DOUBLE AS mid FROM u)
            SELECT variant, kind, sum(good)::BIGINT AS n_clean, sum(1 - good)::BIGINT AS n_corrupted,
                   round(CASE WHEN sum(good) > 0 AND sum(1 - good) > 0 THEN (sum(mid * good) - sum(good) * (sum(good) + 1) / 2.0::DOUBLE) / (sum(good) * sum(1 - good)) END, 6)::DOUBLE AS auroc FROM rk GROUP BY ALL""",
        "verifier_confusion": f"""WITH {_R}, s AS (SELECT variant, CASE WHEN c.corrupted THEN c.kind ELSE 'clean' END AS kind, coalesce(c.corrupted, false) AS bad, coalesce(c.scores[variant], 0) >= 0.5::DOUBLE AS ok FROM c0, (SELECT unnest(['nli', 'overlap']) AS variant)),
            u AS (SELECT * FROM s UNION ALL SELECT variant, 'all', bad, ok FROM s)
            SELECT variant, kind, count(*) FILTER (WHERE bad) AS n_corrupted, count(*) FILTER (WHERE NOT bad) AS n_clean,
                   round(CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN count(*) FILTER (WHERE bad AND ok) / count(*) FILTER (WHERE bad) END, 6)::DOUBLE AS false_accept,
                   round(CASE WHEN count(*) FILTER (WHERE NOT bad) > 0 THEN count(*) FILTER (WHERE NOT bad AND NOT ok) / count(*) FILTER (WHERE NOT bad) END, 6)::DOUBLE AS false_reject FROM u GROUP BY ALL""",
        "repeated_splits": f"WITH {_SPLIT} SELECT {_KEYS}, trial, certified, threshold, answered, failures, n_test FROM tr",
        "exceedance": f"""WITH {_SPLIT} SELECT {_KEYS}, count(*) AS n_trials, round(avg(certified::INT), 6) AS certified_rate,
            round(coalesce(avg(CASE WHEN certified THEN (CASE WHEN answered > 0 THEN failures / answered ELSE 0 END > {_A})::INT END), 0), 6)::DOUBLE AS exceedance,
            round(avg(CASE WHEN certified AND answered > 0 THEN failures / answered END), 6) AS mean_risk,
            round(avg(CASE WHEN certified THEN answered ELSE 0 END / n_test), 6) AS answer_rate FROM tr GROUP BY ALL""",
        "trial_figures": f"""WITH {_SPLIT}, sv AS (SELECT sp.*, certified, threshold, certified AND answered AND statistic <= threshold AS s FROM sp JOIN ch ON ch.variant = sp.variant AND ch.mode = sp.mode AND ch.trial = sp.trial WHERE NOT cal),
            f AS (SELECT variant, mode, trial, certified, threshold, CASE WHEN certified AND count(*) FILTER (WHERE s) > 0 THEN count(*) FILTER (WHERE s AND loss) / count(*) FILTER (WHERE s) END AS risk,
                  count(*) FILTER (WHERE s AND useful) / count(*) AS useful, CASE WHEN certified AND count(*) FILTER (WHERE NOT answerable) > 0 THEN count(*) FILTER (WHERE s AND NOT answerable) / count(*) FILTER (WHERE NOT answerable) END AS hopeless FROM sv GROUP BY variant, mode, trial, certified, threshold)
            SELECT {_KEYS}, count(*) AS n_trials, round(avg(threshold) FILTER (WHERE certified), 6) AS mean_threshold, round(avg(risk), 6) AS mean_risk, round(1.96::DOUBLE * stddev_samp(risk) / sqrt(count(risk)), 6) AS risk_ci95,
            round(avg(useful), 6) AS useful_rate, round(avg(hopeless), 6) AS unanswerable_answered FROM f GROUP BY ALL""",
        "ablation_table": f"""WITH {_OBS}, p AS ({_POINT}), e AS (SELECT * FROM (SELECT unnest(['nli', 'overlap', 'logit', 'nli-window']) AS variant), (SELECT unnest(['strict', 'flagged', 'permissive']) AS mode))
            SELECT e.variant, e.mode, CASE WHEN n IS NULL THEN 'not run' ELSE 'run' END AS state, coalesce(n, 0) AS n, round(answer_rate, 6) AS answer_rate, round(risk, 6) AS risk FROM e LEFT JOIN p ON p.variant = e.variant AND p.mode = e.mode""",
        "guarantee_table": f"WITH {_OBS}, {_GRID}, cd AS ({_cand('o', _KEYS)}) " + " UNION ALL ".join(
            f"SELECT {_KEYS}, {a}::DOUBLE AS alpha, certified, threshold, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM ({_select(_KEYS, 'cd', False).replace(_A, f'{a}::DOUBLE')})" for a in ALPHAS),
        "transfer_table": f"""WITH {_OBS}, {_GRID}, s AS (SELECT * FROM o WHERE variant = 'nli' AND mode = 'strict' AND lang IS NOT NULL), cd AS ({_cand('s', 'lang')}), ch AS ({_select('lang', 'cd', False)}),
            t AS (SELECT learned_on, tested_on, threshold, coalesce(k, 0) AS k, coalesce(b, 0) AS b FROM (SELECT ch.lang AS learned_on, g.lang AS tested_on, threshold FROM ch, (SELECT DISTINCT lang FROM cd) g WHERE g.lang <> ch.lang)
                  LEFT JOIN cd ON cd.lang = tested_on AND lam = threshold)
            SELECT learned_on, tested_on, threshold, k AS answered, b AS failures, round({_PVAL}, 6) AS p_value, k > 0 AND {_PVAL} <= {_D} AS holds FROM t""",
        "missing_scores": f"WITH {_R} SELECT variant, count(*) AS n_claims, count(*) FILTER (WHERE c.scores[variant] IS NULL) AS n_missing FROM c0, (SELECT unnest(['nli', 'overlap', 'logit', 'hits']) AS variant) GROUP BY variant",
        "evidence_found": f"""WITH {_R}, q AS (SELECT query_id, list_filter(list_transform(coalesce(any_value(evidence), []), lambda e: substring({_plain('e')}, 1, 80)), lambda h: length(h) > 0) AS hs FROM eval_queries GROUP BY query_id),
            b AS (SELECT chunk_id, {_plain('min(text)')} AS body FROM chunks GROUP BY chunk_id), f AS (SELECT query_id, bool_or(contains(body, h)) AS held
                FROM (SELECT query_id, unnest(retrieved) AS chunk_id FROM r) JOIN b USING (chunk_id) JOIN (SELECT query_id, unnest(hs) AS h FROM q) USING (query_id) GROUP BY query_id)
            SELECT query_id, CASE WHEN len(hs) = 0 THEN 'no evidence' WHEN coalesce(held, false) THEN 'found' ELSE 'missing' END AS state FROM q LEFT JOIN f USING (query_id) WHERE query_id IN (SELECT query_id FROM r)""",
        "recall_of_records": f"WITH {_R} SELECT category, count(*) AS n, round(avg(coalesce(list_has_any(retrieved_docs, relevant_docs), false)::INT), 6) AS doc_recall, count(evidence_retrieved) AS n_labelled, round(avg(evidence_retrieved::INT), 6) AS evidence_recall FROM r WHERE answerable GROUP BY category",
        "citation_check": f"""WITH {_R} SELECT query_id, claim_no, len(list_distinct(coalesce(cs, []))) AS cited, len(kn) AS known, array_to_string(list_sort(kn), ',') AS kept FROM (
            SELECT c0.query_id, claim_no, c.citations AS cs, list_distinct(list_intersect(coalesce(c.citations, []), coalesce(retrieved, []))) AS kn FROM c0 JOIN r ON r.query_id = c0.query_id)""",
        "any_evidence_overlap": f"""WITH {_R}, ct AS (SELECT chunk_id, min(text) AS t FROM chunks GROUP BY chunk_id),
            h AS (SELECT DISTINCT query_id, unnest(retrieved) AS chunk_id FROM r), p AS (SELECT query_id, t FROM h JOIN ct USING (chunk_id)),
            w AS (SELECT c0.query_id, c0.claim_no, t, {_words('c.text')} AS hw, {_words("coalesce(t, '')")} AS pw FROM c0 LEFT JOIN p ON p.query_id = c0.query_id)
            SELECT query_id, claim_no, round(max(CASE WHEN len(hw) > 0 AND length(trim(coalesce(t, ''))) > 0 THEN len(list_intersect(hw, pw)) / len(hw)::DOUBLE ELSE 0 END), 6)::DOUBLE AS best FROM w GROUP BY ALL""",
        "latest_certified": f"WITH {_SPLIT} SELECT {_KEYS}, max(trial) AS trial, arg_max(threshold, trial) AS threshold FROM tr WHERE certified GROUP BY ALL",
        "paired_observations": f"""WITH {_OBS}, s AS (SELECT query_id, variant, answered AND statistic <= 0.5::DOUBLE AS served FROM o WHERE mode = 'strict')
            SELECT a.served AS nli_served, b.served AS overlap_served, count(*) AS n FROM s a JOIN s b ON a.query_id = b.query_id AND a.variant = 'nli' AND b.variant = 'overlap' GROUP BY ALL""",
        "split_sides": f"WITH {_R}, n AS (SELECT query_id, category, row_number() OVER (PARTITION BY category ORDER BY query_id) AS n FROM r) SELECT query_id, category, floor(n * 0.4::DOUBLE + 1e-9) > floor((n - 1) * 0.4::DOUBLE + 1e-9) AS is_test FROM n",
        "overlap_of_claims": f"""WITH {_R}, x AS (SELECT query_id, claim_no, c.text AS claim, unnest(range(1, len(c.citations) + 1)) AS i, c.citations AS cs FROM c0),
            ct AS (SELECT chunk_id, min(text) AS t FROM chunks GROUP BY chunk_id),
            pr AS (SELECT query_id, claim_no, string_agg(t, chr(10) || chr(10) ORDER BY i) AS premise FROM x JOIN ct ON ct.chunk_id = cs[i] GROUP BY ALL),
            w AS (SELECT c0.query_id, c0.claim_no, {_words('c.text')} AS hw, {_words("coalesce(premise, '')")} AS pw FROM c0 LEFT JOIN pr ON pr.query_id = c0.query_id AND pr.claim_no = c0.claim_no)
            SELECT query_id, claim_no, round(CASE WHEN len(hw) > 0 THEN len(list_intersect(hw, pw)) / len(hw)::DOUBLE ELSE 0 END, 6)::DOUBLE AS overlap FROM w""",
    }
