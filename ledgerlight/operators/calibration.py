"""Probability calibration and segment blends."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clip_probability, log_loss_term, logit
from .evaluation import TARGET, calibration_line, evaluate
from .isotonic import isotonic_fit, isotonic_predict
from .ordering import attach

METHODS = ("identity", "sigmoid", "isotonic")
WEIGHTS = (0.0, 0.25, 0.50, 0.75, 1.0)


# ---------------------------------------------------------------- calibrators

def sigmoid_fit(rows: DataFrame, probability: str, target: str = TARGET) -> DataFrame:
    """Intercept and slope of Platt scaling on the log odds (one row)."""
    return calibration_line(rows, probability, (), target)


def sigmoid_predict(rows: DataFrame, fit: DataFrame, probability: str, output: str) -> DataFrame:
    odds = F.col("calibration_intercept") + F.col("calibration_slope") * logit(F.col(probability))
    return attach(rows, fit).withColumn(output, 1 / (1 + F.exp(-odds))).drop(
        "calibration_intercept", "calibration_slope")


def calibrate(fit_rows: DataFrame, rows: DataFrame, probability: str, method: str, output: str = "calibrated",
              target: str = TARGET) -> DataFrame:
    if method == "identity":
        return rows.withColumn(output, clip_probability(F.col(probability)))
    if method == "sigmoid":
        return sigmoid_predict(rows, sigmoid_fit(fit_rows, probability, target), probability, output)
    if method == "isotonic":
        return isotonic_predict(rows, isotonic_fit(fit_rows, probability, target), probability, output)
    raise ValueError(f"unknown calibration method: {method}")


def compare_calibrators(rows: DataFrame, probability: str, role: str = "calibration_role",
                        target: str = TARGET) -> DataFrame:
    """Every method fitted on the fit half and measured on the other half; the best is marked.

    Best: smallest Brier score, then log loss, then the simpler method.  A method without a fit (one class in the fit half)
    gives no number and is worse than all that do.
    """
    fit_rows = rows.where(F.col(role) == "calibrator_fit")
    held = rows.where(F.col(role) == "calibrator_evaluation")
    parts = None
    for order, method in enumerate(METHODS):
        part = calibrate(fit_rows, held, probability, method, "calibrated", target).select(
            F.lit(order).alias("order"), F.lit(method).alias("method"), target,
            F.when(F.col("calibrated").isNull() & F.col(probability).isNotNull(), math.nan).otherwise(F.col("calibrated")).alias("calibrated"))
        parts = part if parts is None else parts.unionAll(part)
    table = evaluate(parts, "calibrated", ["order", "method"], target)
    best = table.agg(F.min_by("method", F.struct("brier_score", "log_loss", "order")).alias("best"))
    return attach(table, best).withColumn("selected", F.col("method") == F.col("best")).drop("order", "best")


def selected_method(comparison: DataFrame) -> str:
    return comparison.where("selected").select("method").first().method


def prediction_table(rows: DataFrame, probability: str, method: str, role: str = "calibration_role",
                     target: str = TARGET) -> DataFrame:
    """Selection-time probability on the evaluation half and the final refit on all calibration rows."""
    fit_rows = rows.where(F.col(role) == "calibrator_fit")
    out = calibrate(fit_rows, rows, probability, method, "_half", target)
    out = out.withColumn(
        "selection_evaluation_probability", F.when(F.col(role) == "calibrator_evaluation", F.col("_half"))
    ).drop("_half")
    return calibrate(rows, out, probability, method, "final_calibrated_probability", target)


# ---------------------------------------------------------------- blends

def blend(application: Column, history: Column, weight: Column) -> Column:
    return weight * history + (1 - weight) * application


def blend_violations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Component probabilities that are unknown or not strictly between zero and one."""
    def bad(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (c <= 0) | (c >= 1)

    return rows.agg(*[F.count_if(bad(F.col(c))).alias(c) for c in columns])


def weight_candidates(rows: DataFrame, application: str, history: str, groups: Sequence[str],
                      candidates: Sequence[float] = WEIGHTS, target: str = TARGET) -> DataFrame:
    """Brier score and log loss of every candidate weight per group, in one pass."""
    mixed = rows.withColumn("history_weight", F.explode(F.array(*[F.lit(float(w)) for w in candidates])))
    p = blend(F.col(application), F.col(history), F.col("history_weight"))
    y = F.col(target)
    return mixed.withColumn("_p", p).groupBy(*groups, "history_weight").agg(
        F.avg((F.col("_p") - y) * (F.col("_p") - y)).alias("brier_score"),
        F.avg(log_loss_term(y, F.col("_p"))).alias("log_loss"))


def select_weights(candidates: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Smallest Brier score, then log loss, then the lower history weight."""
    best = F.min(F.struct("brier_score", "log_loss", "history_weight")).alias("_best")
    return candidates.groupBy(*groups).agg(best).select(*groups, F.col("_best.history_weight").alias("history_weight"))


def operational_probability(rows: DataFrame, weights: DataFrame, application: str, history: str,
                            segment: str = "history_segment") -> DataFrame:
    """Blend by segment weight; ``weights`` has one row per segment."""
    return rows.join(weights, segment, "left").withColumn(
        "operational_probability",
        blend(F.col(application), F.col(history), F.coalesce(F.col("history_weight"), F.lit(1.0))))


def promotion_gate(held: DataFrame, weights: DataFrame, application: str, history: str, support: DataFrame,
                   segment: str = "history_segment", target: str = TARGET) -> DataFrame:
    """Four criteria per segment; a blend that misses one falls back to the history model alone.

    ``support`` gives per segment the bootstrap share of a better Brier score (``brier_support``).
    """
    mixed = operational_probability(held, weights, application, history, segment)
    names = ("brier_score", "log_loss", "average_precision")
    blended = evaluate(mixed, "operational_probability", [segment], target).select(
        segment, *[F.col(n).alias(f"hybrid_{n}") for n in names])
    alone = evaluate(held, history, [segment], target).select(
        segment, *[F.col(n).alias(f"history_{n}") for n in names])
    table = weights.join(blended, segment).join(alone, segment).join(support, segment, "left")
    table = table.withColumns({
        "brier_improves": F.col("hybrid_brier_score") < F.col("history_brier_score"),
        "log_loss_improves": F.col("hybrid_log_loss") < F.col("history_log_loss"),
        "average_precision_not_worse": F.col("hybrid_average_precision") >= F.col("history_average_precision"),
        "bootstrap_brier_support": F.coalesce(F.col("brier_support") >= 0.90, F.lit(False)),
    })
    promoted = ((F.col("history_weight") != 1.0) & F.col("brier_improves") & F.col("log_loss_improves")
                & F.col("average_precision_not_worse") & F.col("bootstrap_brier_support"))
    return table.withColumns({
        "candidate_promoted": promoted,
        "promoted_history_weight": F.when(promoted, F.col("history_weight")).otherwise(1.0)})
