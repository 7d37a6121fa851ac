"""Risk control over answered responses: policies, losses, threshold selection, curves and trials.

Claims stay nested in their response wherever a higher-order function can decide per response, so no
row is exploded and nothing is shuffled before the final aggregation.  Threshold grids are evaluated in
one pass: each response adds to the grid points from its own index upwards, by a cumulative sum over at
most 50 points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.functions.binomial import lower_tail
from tarnlake.functions.running import running
from tarnlake.session import checkpointed

GRID = 50
MODES = ("strict", "flagged", "permissive")
SUPPORT = 0.5


def _claims_of(records: DataFrame) -> Column:
    """The claims column, an empty array where it is null."""
    return F.coalesce("claims", F.array().cast(records.schema["claims"].dataType))


def _judged(claims: Column, variant: str, mode: str, support: float) -> Column:
    """Claims with score and action under a mode."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    other = {"strict": "removed", "flagged": "flagged", "permissive": "kept"}[mode]

    def judge(claim: Column) -> Column:
        score = F.coalesce(F.try_element_at(claim["scores"], F.lit(variant)), F.lit(0.0))
        action = F.when(score >= support, "kept").otherwise(other)
        return F.struct(
            claim["text"].alias("text"),
            score.alias("score"),
            action.alias("action"),
            F.coalesce(claim["corrupted"], F.lit(False)).alias("corrupted"),
            F.coalesce(claim["on_evidence"], F.lit(False)).alias("on_evidence"),
            F.coalesce(claim["kind"], F.lit("")).alias("kind"),
        )

    return F.transform(claims, judge)


def judged_claims(records: DataFrame, variant: str, mode: str, support: float = SUPPORT) -> DataFrame:
    """Each response with its claims' score and action under a mode.

    A claim is supported where its score reaches ``support``; a missing score counts as 0.  Supported
    claims are kept; others are removed (strict), flagged or kept (permissive).
    """
    return records.withColumn("claims", _judged(_claims_of(records), variant, mode, support))


def _observed(claims: Column, variant: str, mode: str, loss: str, support: float) -> Column:
    """statistic, loss, answered and useful of a response as a struct."""
    left = F.filter(_judged(claims, variant, mode, support), lambda c: c["action"] != "removed")
    answered = F.size(left) > 0
    statistic = F.when(answered, 1.0 - F.array_min(F.transform(left, lambda c: c["score"]))).otherwise(1.0)
    lossy = F.exists(left, lambda c: c["corrupted"]) if loss == "gold" else F.exists(left, lambda c: c["score"] < support)
    useful = F.exists(left, lambda c: c["on_evidence"] & ~c["corrupted"])
    return F.struct(statistic.alias("statistic"), (answered & lossy).alias("loss"), answered.alias("answered"), useful.alias("useful"))


def observations(records: DataFrame, variant: str, mode: str, loss: str = "gold", support: float = SUPPORT) -> DataFrame:
    """One row per response: statistic, loss, answered, useful, answerable, category.

    The statistic is one minus the least score of the claims that are not removed; a response without
    such claims is unanswered, with statistic 1 and no loss.  The gold loss is a corrupted claim among
    them, the verifier loss an unsupported one.
    """
    return observed_configurations(records, [variant], [mode], loss, support).drop("variant", "mode")


def observed_configurations(records: DataFrame, variants: Sequence[str], modes: Sequence[str], loss: str = "gold", support: float = SUPPORT) -> DataFrame:
    """The same for all configurations in one pass over the records: with variant and mode."""
    claims = _claims_of(records)
    each = [
        F.struct(F.lit(v).alias("variant"), F.lit(m).alias("mode"), _observed(claims, v, m, loss, support).alias("o")) for v in variants for m in modes
    ]
    rows = records.select("query_id", "category", F.coalesce("answerable", F.lit(False)).alias("answerable"), F.explode(F.array(*each)).alias("c"))
    return rows.select("query_id", "c.variant", "c.mode", "c.o.*", "answerable", "category")


def assembled_answers(records: DataFrame, variant: str, mode: str) -> DataFrame:
    """The answer that is left: claims not removed, trimmed, joined in order."""
    judged = judged_claims(records, variant, mode)
    texts = F.transform(F.filter("claims", lambda c: c["action"] != "removed"), lambda c: F.trim(c["text"]))
    return judged.select("query_id", F.array_join(F.filter(texts, lambda t: F.length(t) > 0), " ").alias("answer"), F.size(texts).alias("n_claims"))


def grid_place(statistic: Column) -> Column:
    """Place of the first threshold of the grid that the statistic does not pass; null beyond the last.

    The thresholds are the doubles 0.02, 0.04 ... 1.00, and comparisons are exact: the arithmetic guess is
    off by one at most and is corrected against the thresholds themselves.
    """

    def threshold(i: Column) -> Column:
        return F.round(i * 0.02, 2)

    guess = F.greatest(F.floor(statistic * GRID), F.lit(1)).cast("int")
    place = F.when(statistic <= threshold(guess), guess).when(statistic <= threshold(guess + 1), guess + 1).otherwise(guess + 2)
    return F.when(place <= GRID, place)


def _cumulated(per_place: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Candidates from counts per place: keys, place (null: never answered), n_here, bad_here, and more counts to add up."""
    keys = list(keys)
    totals = per_place.groupBy(*keys).agg(F.sum("n_here").alias("n"))
    points = F.transform(F.sequence(F.lit(1), F.lit(GRID)), lambda i: F.struct(i.alias("place"), F.round(i * 0.02, 2).alias("lambda")))
    full = totals.withColumn("point", F.explode(points)).select(*keys, "n", "point.*")
    joined = full.join(per_place.filter(F.col("place") > 0), [*keys, "place"], "left")
    w = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *keys,
        "place",
        "lambda",
        "n",
        F.sum(F.coalesce("n_here", F.lit(0))).over(w).alias("answered"),
        F.sum(F.coalesce("bad_here", F.lit(0))).over(w).alias("failures"),
        *[F.sum(F.coalesce(c, F.lit(0))).over(w).alias(c) for c in more],
    )


def threshold_candidates(obs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Answered and failed responses at every threshold of the grid, in one pass over the data.

    ``obs`` may hold several configurations, told apart by ``keys``.
    """
    place = F.when(F.col("answered"), grid_place(F.col("statistic")))
    per_place = obs.groupBy(*keys, place.alias("place")).agg(F.count(F.lit(1)).alias("n_here"), F.count_if("loss").alias("bad_here"))
    return _cumulated(per_place, keys)


def with_p_values(candidates: DataFrame, alpha: float | Column) -> DataFrame:
    """Adds the binomial p-value of the hypothesis that the risk exceeds alpha."""
    return candidates.withColumn("p_value", lower_tail(F.col("failures"), F.col("answered"), F.lit(alpha)))


def guarantees(candidates: DataFrame, alphas: Sequence[float], delta: float, keys: Sequence[str] = ()) -> DataFrame:
    """What can be certified at each of several alphas, from one pass over the responses: keys, alpha and the columns of select_threshold."""
    each = candidates.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return select_threshold(each, F.col("alpha"), delta, [*keys, "alpha"])


def transfer(obs: DataFrame, group: str, alpha: float, delta: float, keys: Sequence[str] = ()) -> DataFrame:
    """Thresholds certified on each group of responses, tested as a single hypothesis on every other group.

    Result: keys, learned_on, tested_on, threshold, answered, failures, p_value, holds; an uncertified group has threshold 0.
    """
    keys = list(keys)
    candidates = threshold_candidates(obs.filter(F.col(group).isNotNull()), [*keys, group])
    learned = select_threshold(candidates, alpha, delta, [*keys, group]).select(*keys, F.col(group).alias("learned_on"), F.round("threshold", 2).alias("threshold"))
    tested = candidates.select(*keys, F.col(group).alias("tested_on"), F.round("lambda", 2).alias("threshold"), "answered", "failures")
    groups = candidates.select(*keys, F.col(group).alias("tested_on")).distinct()
    # one row per pair of groups, of which there are as few as labels
    pairs = learned.withColumn("_one", F.lit(1)).join(groups.withColumn("_one", F.lit(1)), [*keys, "_one"]).drop("_one").filter(F.col("learned_on") != F.col("tested_on"))
    rows = pairs.join(tested, [*keys, "tested_on", "threshold"], "left").na.fill(0, ["answered", "failures"])
    p = lower_tail(F.col("failures"), F.col("answered"), F.lit(alpha))
    return rows.withColumn("p_value", p).withColumn("holds", (F.col("answered") > 0) & (F.col("p_value") <= delta))


def missing_scores(records: DataFrame, variants: Sequence[str]) -> DataFrame:
    """How many claims lack a score of each variant, which observations count as 0: variant, n_claims, n_missing."""
    claims = records.select(F.explode(_claims_of(records)).alias("c")).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    lacks = F.try_element_at("c.scores", F.col("variant")).isNull()
    return claims.groupBy("variant").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(lacks).alias("n_missing"))


def evidence_retrieved(retrieved: DataFrame, evidence: DataFrame, chunks: DataFrame, head: int = 80) -> DataFrame:
    """Whether the chunks a query retrieved hold the start of any of its quotes: query_id, found (null without evidence).

    ``retrieved``: query_id, chunk_id.  ``evidence``: query_id, evidence (quotes).  ``chunks``: chunk_id, text.  Texts are
    compared in their normal form, quotes by their first ``head`` characters; each chunk is normalised once.
    """
    heads = F.filter(F.array_distinct(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda q: F.substring(T.normalised(q), 1, head))), lambda h: F.length(h) > 0)
    asked = evidence.select("query_id", heads.alias("heads"))
    wanted = retrieved.join(asked.filter(F.size("heads") > 0), "query_id").select("query_id", "chunk_id", "heads").distinct()
    bodies = chunks.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("text").alias("text")).select("chunk_id", T.normalised(F.col("text")).alias("body"))
    held = wanted.join(bodies, "chunk_id").groupBy("query_id").agg(F.bool_or(F.exists("heads", lambda h: F.contains(F.col("body"), h))).alias("held"))
    return asked.join(held, "query_id", "left").select("query_id", F.when(F.size("heads") > 0, F.coalesce("held", F.lit(False))).alias("found"))


def select_threshold(candidates: DataFrame, alpha: float | Column, delta: float, keys: Sequence[str] = (), sequential: bool = False) -> DataFrame:
    """The certified threshold that answers most (then the highest), per key.

    Bonferroni tests every threshold at delta over their number; the fixed sequence tests them in order
    at delta and stops at the first failure.  Without a certified one: threshold 0, coverage 0, risk 1.
    """
    keys = list(keys)
    tested = with_p_values(candidates, alpha)
    if sequential:
        w = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        passed = F.min(((F.col("answered") > 0) & (F.col("p_value") <= delta)).cast("int")).over(w) == 1
    else:
        passed = (F.col("answered") > 0) & (F.col("p_value") <= delta / GRID)
    best = tested.withColumn("ok", passed).groupBy(*keys).agg(
        F.max(F.when(F.col("ok"), F.struct("answered", "lambda", "failures"))).alias("best"), F.max("n").alias("n"), F.count_if("ok").alias("n_certified")
    )
    certified = F.col("best").isNotNull()
    return best.select(
        *keys,
        certified.alias("certified"),
        F.when(certified, F.col("best.lambda")).otherwise(0.0).alias("threshold"),
        F.when(certified & (F.col("n") > 0), F.col("best.answered") / F.col("n")).otherwise(0.0).alias("coverage"),
        F.when(certified, F.col("best.failures") / F.col("best.answered")).otherwise(1.0).alias("risk"),
        "n",
        "n_certified",
    )


def operating_point(obs: DataFrame, threshold: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Answer rate, risk among answered, useful rate and answered share of unanswerable queries."""
    served = F.col("answered") & (F.col("statistic") <= threshold)
    n, k, bad = F.count(F.lit(1)), F.count_if(served), F.count_if(served & F.col("loss"))
    hopeless = F.count_if(~F.col("answerable"))
    return obs.groupBy(*keys).agg(
        n.alias("n"),
        F.when(n > 0, k / n).otherwise(0.0).alias("answer_rate"),
        F.when(k > 0, bad / k).otherwise(0.0).alias("risk"),
        F.when(n > 0, F.count_if(served & F.col("useful")) / n).otherwise(0.0).alias("useful_rate"),
        F.when(hopeless > 0, F.count_if(served & ~F.col("answerable")) / hopeless).alias("unanswerable_answered"),
    )


def risk_coverage(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Risk among the first k answered responses by statistic, with coverage k over all.

    The order is total (statistic, query id).  A configuration may hold all rows, so it is cut into
    buckets of the statistic that are counted apart.
    """
    totals = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    bucket = F.floor(F.col("statistic") * 4096).cast("int")
    served = running(obs.filter("answered"), keys, bucket, [F.asc("statistic"), F.asc("query_id")], {"bad": F.col("loss").cast("int")}, place="k")
    return served.join(totals, list(keys)).select(*keys, "query_id", "k", (F.col("k") / F.col("total")).alias("coverage"), (F.col("bad") / F.col("k")).alias("risk"))


def risk_at(curve: DataFrame, coverage: float, keys: Sequence[str]) -> DataFrame:
    """Risk at the last point whose coverage does not pass the given one, else at the first point."""
    inside = F.when(F.col("coverage") <= coverage + 1e-12, F.struct("coverage", "risk"))
    return curve.groupBy(*keys).agg(F.coalesce(F.max(inside)["risk"], F.min_by("risk", "k")).alias("risk"))


def auroc(scored: DataFrame, keys: Sequence[str], score: str = "score", positive: str = "is_clean") -> DataFrame:
    """Area under the ROC curve with averaged ties; null where a class is missing.

    Equal scores are counted before they are ordered, so the window holds distinct scores only.
    """
    keys = list(keys)
    levels = scored.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("here"), F.count_if(F.col(positive)).alias("good"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = levels.withColumn("middle", F.coalesce(F.sum("here").over(w), F.lit(0)) + (F.col("here") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("middle") * F.col("good")).alias("rank_sum"), F.sum("good").alias("p"), (F.sum("here") - F.sum("good")).alias("q"))
    return sums.select(*keys, F.col("p").alias("n_clean"), F.col("q").alias("n_corrupted"), F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auroc"))


def repeated_trials(obs: DataFrame, trials: int, alpha: float, delta: float, keys: Sequence[str] = (), fraction: float = 0.6) -> DataFrame:
    """Random splits: certify on one side, measure on the other; one row per key and trial.

    A response is on the calibration side of a trial where a hash of trial and id says so, so no sort and
    no table of splits is needed, and the hash is taken once for all configurations of a response.  All
    that is shuffled are counts per trial, side and grid place, which both sides then share.  With the counts of
    useful and of unanswerable responses, so ``obs`` must say which ones are useful and answerable.
    """
    keys = list(keys)
    config = F.struct(*keys, F.when(F.col("answered"), grid_place(F.col("statistic"))).alias("place"), "loss", "useful", "answerable")
    nested = obs.groupBy("query_id").agg(F.collect_list(config).alias("configs"))
    drawn = nested.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    draw = F.conv(F.substring(F.sha2(F.concat(F.col("trial").cast("string"), F.lit(":"), F.col("query_id")), 256), 1, 8), 16, 10).cast("double") / float(2**32)
    rows = drawn.select("trial", (draw < fraction).alias("is_calibration"), F.explode("configs").alias("c")).select("trial", "is_calibration", "c.*")
    keys = [*keys, "trial"]
    here = {"n_here": F.count(F.lit(1)), "bad_here": F.count_if("loss"), "useful": F.count_if("useful"), "unanswerable": F.count_if(~F.col("answerable"))}
    counts = checkpointed(rows.groupBy(*keys, "is_calibration", "place").agg(*[c.alias(name) for name, c in here.items()]))
    chosen = select_threshold(_cumulated(counts.filter("is_calibration"), keys), alpha, delta, keys)
    held_out = counts.filter(~F.col("is_calibration"))
    test = _cumulated(held_out, keys, ["useful", "unanswerable"]).withColumnRenamed("unanswerable", "unanswerable_answered").join(chosen.select(*keys, "certified", F.col("threshold").alias("lambda")), [*keys, "lambda"], "right")
    total = held_out.groupBy(*keys).agg(F.sum("n_here").alias("n_test"), F.sum("unanswerable").alias("unanswerable"))
    return test.join(total, keys).select(
        *keys,
        "certified",
        F.col("lambda").alias("threshold"),
        F.coalesce("answered", F.lit(0)).alias("answered"),
        F.coalesce("failures", F.lit(0)).alias("failures"),
        "n_test",
        F.coalesce("useful", F.lit(0)).alias("useful"),
        "unanswerable",
        F.coalesce("unanswerable_answered", F.lit(0)).alias("unanswerable_answered"),
    )


def trial_summary(trials: DataFrame, alpha: float, keys: Sequence[str] = ()) -> DataFrame:
    """Certified share, share of certified trials above alpha, and means over trials.

    Threshold and answered share of unanswerable responses are averaged over certified trials, the risk (with
    the half-width of its 95 % interval) over those with answers, answer rate and useful rate over all trials,
    of which uncertified ones answer nothing.
    """

    def of_all(count: str) -> Column:
        return F.avg(F.when(F.col("n_test") > 0, F.when(F.col("certified"), F.col(count)).otherwise(0) / F.col("n_test")).otherwise(0.0))

    risk = F.when(F.col("certified") & (F.col("answered") > 0), F.col("failures") / F.col("answered"))
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.avg(F.col("certified").cast("double")).alias("certified_rate"),
        F.coalesce(F.avg(F.when(F.col("certified"), (F.coalesce(risk, F.lit(0.0)) > alpha).cast("double"))), F.lit(0.0)).alias("exceedance"),
        F.avg(risk).alias("mean_risk"),
        of_all("answered").alias("answer_rate"),
        F.avg(F.when(F.col("certified"), F.col("threshold"))).alias("mean_threshold"),
        (1.96 * F.stddev_samp(risk) / F.sqrt(F.count(risk))).alias("risk_ci95"),
        of_all("useful").alias("useful_rate"),
        F.avg(F.when(F.col("certified") & (F.col("unanswerable") > 0), F.col("unanswerable_answered") / F.col("unanswerable"))).alias("unanswerable_answered"),
    )


def claim_confusion(records: DataFrame, variants: Sequence[str], support: float = SUPPORT) -> DataFrame:
    """False accepts of corrupted and false rejects of clean claims by variant and kind, with a row for all kinds."""
    claims = records.select("query_id", F.posexplode("claims").alias("pos", "claim")).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    score = F.try_element_at(F.col("claim.scores"), F.col("variant"))
    corrupted = F.coalesce(F.col("claim.corrupted"), F.lit(False))
    rows = claims.select("variant", F.when(corrupted, F.col("claim.kind")).otherwise("clean").alias("kind"), corrupted.alias("corrupted"), (F.coalesce(score, F.lit(0.0)) >= support).alias("accepted"))
    both = rows.groupBy("variant", "kind", "corrupted").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("n_accepted"))
    rolled = both.rollup("variant", "kind").agg(
        F.sum(F.when(F.col("corrupted"), F.col("n")).otherwise(0)).alias("n_corrupted"),
        F.sum(F.when(F.col("corrupted"), F.col("n_accepted")).otherwise(0)).alias("accepted_corrupted"),
        F.sum(F.when(~F.col("corrupted"), F.col("n")).otherwise(0)).alias("n_clean"),
        F.sum(F.when(~F.col("corrupted"), F.col("n") - F.col("n_accepted")).otherwise(0)).alias("rejected_clean"),
    )
    return rolled.filter(F.col("variant").isNotNull()).select(
        "variant",
        F.coalesce("kind", F.lit("all")).alias("kind"),
        "n_corrupted",
        "n_clean",
        F.when(F.col("n_corrupted") > 0, F.col("accepted_corrupted") / F.col("n_corrupted")).alias("false_accept"),
        F.when(F.col("n_clean") > 0, F.col("rejected_clean") / F.col("n_clean")).alias("false_reject"),
    )
