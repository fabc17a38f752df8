"""Confusion metrics, rubrics, weighted scores, gates, regressions and evaluation summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.cases import listed, lookup
from proofline.functions.arrays import abs_diff_sum, bound, boundary, mask_counts, mean_least_distance
from proofline.operators.sequence import exact_quantiles
from proofline.session import cut

# Rubric size, bands, default criterion weights and the frozen synthetic gates.
RUBRIC_DIMENSIONS = 16
RUBRIC_BANDS = ((28, "strong"), (23, "useful"), (17, "insufficient"), (0, "failed"))
CRITERION_WEIGHTS = {
    "problem fit": 20,
    "distinctiveness and recognition": 15,
    "small-size performance": 15,
    "platform and container fit": 15,
    "brand continuity": 10,
    "semantic and cultural robustness": 10,
    "production stability": 10,
    "system-generating capacity": 5,
}
SYNTHETIC_MINIMUMS = {"iou": 0.965, "precision": 0.980, "recall": 0.980, "f1": 0.980}
SYNTHETIC_MAXIMUMS = {"alpha_mae": 0.018, "boundary_error_px": 2.0}


def score_columns(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, IoU and F1; an empty denominator scores 1, F1 is 0 when both are 0."""
    one = F.lit(1.0)
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(one)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(one)
    iou = F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).otherwise(one)
    f1 = F.when(precision + recall > 0, precision * 2.0 * recall / (precision + recall)).otherwise(F.lit(0.0))
    return {"precision": precision, "recall": recall, "iou": iou, "f1": f1}


def binary_scores(df: DataFrame, scope: Sequence[str], predicted: Column, truth: Column) -> DataFrame:
    counts = df.groupBy(*scope).agg(
        F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"),
        F.count_if(~predicted & truth).alias("fn"),
    )
    scores = score_columns(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("*", *[c.alias(n) for n, c in scores.items()])


def mask_scores(pairs: DataFrame, predicted: str, truth: str, threshold: int = 128, width: int | None = None) -> DataFrame:
    """The same scores between two 0..255 planes on one row, plus mean absolute error.

    With the ``width`` of the planes also boundary_error_px: the mean of both mean distances from one boundary to the other, infinite if one is empty.
    """
    both = pairs.withColumn("_m", mask_counts(F.col(predicted), F.col(truth), threshold))
    scores = score_columns(F.col("_m.both"), F.col("_m.only_a"), F.col("_m.only_b"))
    error = abs_diff_sum(F.col(predicted), F.col(truth), "bigint") / (F.size(predicted) * F.lit(255.0))
    out = both.select("*", *[c.alias(n) for n, c in scores.items()], error.alias("alpha_mae")).drop("_m")
    if width is None:
        return out
    height = F.ceil(F.size(truth) / width).cast("int")
    edges = F.struct(boundary(F.col(predicted), width, threshold).alias("a"), boundary(F.col(truth), width, threshold).alias("b"), height.alias("height"))
    apart = bound(edges, lambda e: (mean_least_distance(e["a"], e["b"], width, e["height"]) + mean_least_distance(e["b"], e["a"], width, e["height"])) / 2.0)
    return out.withColumn("boundary_error_px", F.coalesce(apart, F.lit(float("inf"))))


def trigger_eval(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Invocation precision and recall per release and split, missing runs counted as not triggered.

    Releases may be any number; the splits of the cases, train and test sets as a rule, are one array that every release gets.
    """
    asked = cases.join(runs.select("release", "case_id", "triggered"), on="case_id", how="left")
    known = asked.where(F.col("release").isNotNull())
    totals = cases.groupBy("split").agg(F.count_if("should_trigger").alias("_positive"))
    counts = known.groupBy("release", "split").agg(
        F.count_if(F.col("triggered") & F.col("should_trigger")).alias("tp"),
        F.count_if(F.col("triggered") & ~F.col("should_trigger")).alias("fp"),
    )
    splits = totals.agg(F.collect_list(F.struct("split", "_positive")).alias("s")).scalar()
    cells = runs.select("release").distinct().withColumn("_splits", splits).select("release", F.inline("_splits"))
    grid = cells.join(counts, on=["release", "split"], how="left").fillna(0, ["tp", "fp"])
    fn = (F.col("_positive") - F.col("tp")).alias("fn")
    scores = score_columns(F.col("tp"), F.col("fp"), F.col("_positive") - F.col("tp"))
    return grid.select("release", "split", "tp", "fp", fn, scores["precision"].alias("precision"), scores["recall"].alias("recall"))


def rubric_score(scores: DataFrame, vetoes: DataFrame) -> DataFrame:
    """Total of 16 dimensions scored 0..2, its band, and any must-pass violation.

    ``scores``: run_id, dimension, score.  ``vetoes``: run_id (one row per violation).
    """
    totals = scores.groupBy("run_id").agg(
        F.sum("score").alias("total"), F.count_distinct("dimension").alias("_dims"), F.count(F.lit(1)).alias("_rows"),
        F.count_if(~F.coalesce(F.col("score").isin(0, 1, 2), F.lit(False))).alias("_bad"),
    )
    failed = vetoes.groupBy("run_id").agg(F.count(F.lit(1)).alias("_vetoes"))
    valid = (F.col("_dims") == RUBRIC_DIMENSIONS) & (F.col("_rows") == RUBRIC_DIMENSIONS) & (F.col("_bad") == 0)
    band = F.lit(None).cast("string")
    for least, name in reversed(RUBRIC_BANDS):
        band = F.when(F.col("total") >= least, name).otherwise(band)
    joined = totals.join(failed, on="run_id", how="left").withColumn("vetoes", F.coalesce("_vetoes", F.lit(0)))
    verdict = F.when(~valid, "invalid").when(F.col("vetoes") > 0, "failed").otherwise(band)
    return joined.select("run_id", "total", "vetoes", verdict.alias("verdict"))


def weighted_score(scores: DataFrame, gates: DataFrame, weights: Mapping[str, float] = CRITERION_WEIGHTS) -> DataFrame:
    """Normalised weighted score per candidate; N/A criteria are left out and the rest renormalised.

    ``scores``: candidate, criterion, score (1..5 or null).  ``gates``: candidate,
    passed.  A candidate with a failed hard gate is not scored.
    """
    weight = lookup(F.col("criterion"), {name: float(value) for name, value in weights.items()})
    failed = gates.groupBy("candidate").agg(F.count_if(~F.col("passed")).alias("failed_gates"))
    used = F.when(F.col("score").isNotNull(), F.col("_w"))
    sums = scores.withColumn("_w", weight).groupBy("candidate").agg(
        F.sum(F.col("score") / 5.0 * used).alias("_sum"), F.sum(used).alias("_weights"),
        F.count_if(F.col("score").isNull()).alias("not_applicable"),
    )
    joined = sums.join(failed, on="candidate", how="left")
    gated = F.coalesce("failed_gates", F.lit(0))
    value = F.when((gated == 0) & (F.col("_weights") > 0), F.col("_sum") / F.col("_weights") * 100)
    return joined.select("candidate", gated.alias("failed_gates"), "not_applicable", value.alias("score"))


def must_checks(outputs: DataFrame, cases: DataFrame) -> DataFrame:
    """Literal must and must-not phrases per output, with the ones that failed.

    ``status`` is ``judged``, or ``no case`` or ``no output`` for a row of one side only, which has not passed.  Texts are never dealt
    by case, of which a few may have most of the outputs: the cases are written first, so that they are broadcast while small, and a
    larger table joins with split partitions, which a full outer join does not allow.
    """
    cases = cut(cases)
    left, right = outputs.withColumn("_output", F.lit(True)), cases.withColumn("_case", F.lit(True))
    unanswered = right.join(outputs.select("case_id").distinct(), on="case_id", how="left_anti")
    joined = left.join(right, on="case_id", how="left").unionByName(unanswered, allowMissingColumns=True)
    status = F.when(F.col("_case").isNull(), "no case").when(F.col("_output").isNull(), "no output").otherwise("judged")
    joined = joined.withColumn("status", status).drop("_case", "_output")
    absent = F.filter("must", lambda m: ~F.contains(F.col("output"), m))
    present = F.filter("must_not", lambda m: F.contains(F.col("output"), m))
    return joined.withColumn("absent", absent).withColumn("forbidden", present).withColumn(
        "passed", (F.col("status") == "judged") & (F.size("absent") == 0) & (F.size("forbidden") == 0)
    )


def release_regressions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per track: cases that regressed, were fixed, appeared or disappeared between two releases."""
    left = old.select("case_id", F.col("track").alias("_ot"), F.col("passed").alias("_old"))
    right = new.select("case_id", F.col("track").alias("_nt"), F.col("passed").alias("_new"))
    both = left.join(right, on="case_id", how="full_outer").withColumn("track", F.coalesce("_nt", "_ot"))
    return both.groupBy("track").agg(
        F.count_if(F.col("_old") & ~F.col("_new")).alias("regressed"), F.count_if(~F.col("_old") & F.col("_new")).alias("fixed"),
        F.count_if(F.col("_ot").isNull()).alias("added"), F.count_if(F.col("_nt").isNull()).alias("removed"),
        F.count_if("_old").alias("old_passed"), F.count_if("_new").alias("new_passed"),
    )


@dataclass(frozen=True)
class Gate:
    """One ordered threshold rule on a numeric column."""

    metric: str
    minimum: float | None = None
    maximum: float | None = None


SYNTHETIC_GATES = tuple(Gate(m, minimum=v) for m, v in SYNTHETIC_MINIMUMS.items()) + tuple(
    Gate(m, maximum=v) for m, v in SYNTHETIC_MAXIMUMS.items()
)


def threshold_gates(df: DataFrame, rules: Sequence[Gate]) -> DataFrame:
    """Reason strings of the rules a row breaks, in rule order; no reason means it passes."""
    reasons = []
    for rule in rules:
        value = F.col(rule.metric)
        for limit, word, broken in (
            (rule.minimum, "below", None if rule.minimum is None else value < rule.minimum),
            (rule.maximum, "above", None if rule.maximum is None else value > rule.maximum),
        ):
            if limit is not None:
                reasons.append(F.when(broken, F.format_string(f"{rule.metric} %.6f {word} {limit:.6f}", value.cast("double"))))
    return df.withColumn("reasons", listed(*reasons)).withColumn("passed", F.size("reasons") == 0)


def worst_case_rollup(cases: DataFrame, scope: Sequence[str], minimums: Mapping[str, float], maximums: Mapping[str, float] | None = None) -> DataFrame:
    """Worst value of every metric over the cases of a scope, failing cases and the overall verdict."""
    gates = [Gate(m, minimum=v) for m, v in minimums.items()] + [Gate(m, maximum=v) for m, v in (maximums or {}).items()]
    judged = threshold_gates(cases, gates)
    return judged.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.min(m).alias(f"worst_{m}") for m in minimums], *[F.max(m).alias(f"worst_{m}") for m in (maximums or {})],
        F.count_if(~F.col("passed")).alias("failures"), F.bool_and("passed").alias("passed"),
    )


def framing_stability(runs: DataFrame, case: Sequence[str], outcome: str) -> DataFrame:
    """Per case: variants seen, distinct outcomes, modal outcome and its share."""
    counts = runs.groupBy(*case, outcome).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*case).agg(
        F.sum("_n").alias("runs"), F.count(F.lit(1)).alias("outcomes"),
        F.min_by(outcome, F.struct(-F.col("_n"), F.col(outcome))).alias("modal_outcome"),
        (F.max("_n") / F.sum("_n")).alias("modal_share"),
    ).withColumn("stable", F.col("outcomes") == 1)


def eval_inventory(cases: DataFrame, suite: str, mode: str) -> DataFrame:
    return cases.groupBy(suite, mode).agg(F.count(F.lit(1)).alias("cases"))


def checklist(cases: DataFrame) -> DataFrame:
    """Printable checklist line per case."""
    line = F.concat(
        F.col("case_id").cast("string"), F.lit(" ["), F.col("mode"), F.lit("] must: "), F.array_join("must", "; "),
        F.lit(" | must not: "), F.array_join("must_not", "; "),
    )
    return cases.withColumn("line", line)


def score_disagreement(scores: DataFrame, keys: Sequence[str], score: str, gap: float) -> DataFrame:
    """Opposing scores of one item and criterion, surfaced instead of averaged."""
    spread = scores.groupBy(*keys).agg(F.min(score).alias("lowest"), F.max(score).alias("highest"), F.count(score).alias("scores"))
    return spread.where(F.col("highest") - F.col("lowest") >= gap)


def findability_summary(candidates: DataFrame, trials: DataFrame, key: str) -> DataFrame:
    """Median time, incorrect selections, re-find share, sample size and failures; an empty sample is no evidence.

    A trial with a null ``time_to_find`` failed: it counts in all but the median, which is that of the others.
    """
    base = trials.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("incorrect").alias("_incorrect"), F.avg(F.col("refound").cast("int")).alias("refind_share"),
        F.count_if(F.col("time_to_find").isNull()).alias("_failed"),
    )
    middle = exact_quantiles(trials, [key], "time_to_find", {"median_time": 0.5})
    joined = candidates.select(key).distinct().join(base, on=key, how="left").join(middle, on=key, how="left")
    return joined.select(
        key, F.coalesce("_n", F.lit(0)).alias("sample"), F.coalesce("_failed", F.lit(0)).alias("failed"), F.coalesce("_incorrect", F.lit(0)).alias("incorrect"), "refind_share", "median_time",
        F.when(F.col("_n") > 0, "directional evidence").otherwise("no evidence").alias("evidence"),
    )


def signal_shift(signals: DataFrame, keys: Sequence[str], value: str, is_baseline: Column) -> DataFrame:
    """Baseline average against the new observation; a shift names no cause."""
    windows = signals.withColumn("_base", is_baseline).groupBy(*keys).agg(
        F.avg(F.when(F.col("_base"), F.col(value))).alias("baseline"), F.avg(F.when(~F.col("_base"), F.col(value))).alias("observed"),
        F.count_if("_base").alias("baseline_n"), F.count_if(~F.col("_base")).alias("observed_n"),
    )
    return windows.withColumn("shift", F.col("observed") - F.col("baseline"))
