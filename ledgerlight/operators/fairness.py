"""Audit-only group diagnostics at a fixed review capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clip_probability, logit, ratio, right_closed_band
from ..session import cut_lineage
from .evaluation import TARGET, deciles_of, error_of, lines_of, ranking_metrics, reliability_of, scored, with_counts
from .ordering import attach, exact_quantiles

PROTECTED = ("CODE_GENDER", "DAYS_BIRTH")
REVIEW_CAPACITY = 0.20
# Age bands of the audit and of the challenger segments (upper edges included).
AUDIT_AGE_EDGES = (0, 24, 34, 44, 54, 64, float("inf"))
AUDIT_AGE_LABELS = ("18-24", "25-34", "35-44", "45-54", "55-64", "65+")
SEGMENT_AGE_EDGES = (0, 30, 40, 50, 60, 200)
SEGMENT_AGE_LABELS = ("under_30", "30_to_39", "40_to_49", "50_to_59", "60_plus")

SUPPRESSIBLE = (
    "roc_auc", "average_precision", "brier_score", "expected_calibration_error", "calibration_intercept",
    "calibration_slope",
)
GAP_METRICS = (
    "event_rate", "mean_probability", "review_rate", "true_positive_rate_at_review_capacity",
    "false_positive_rate_at_review_capacity", "roc_auc", "average_precision", "brier_score",
    "expected_calibration_error",
)
# Gap sizes that must be named in the audit.
ATTENTION = {
    "review_rate": 0.10,
    "true_positive_rate_at_review_capacity": 0.10,
    "false_positive_rate_at_review_capacity": 0.10,
    "roc_auc": 0.05,
    "expected_calibration_error": 0.02,
}


def assert_protected_unused(selected: Sequence[str]) -> None:
    leaked = sorted(set(PROTECTED) & set(selected))
    if leaked:
        raise ValueError(f"protected audit fields must not be model inputs: {leaked}")


def protected_controls(inventory: DataFrame) -> DataFrame:
    """One row per protected field from a (feature, status) inventory."""
    spark = inventory.sparkSession
    fields = spark.createDataFrame([(f,) for f in PROTECTED], "feature string")
    status = inventory.where(F.col("feature").isin(*PROTECTED)).groupBy("feature").agg(
        F.max(F.col("status") == "selected").alias("selected"),
        F.max(F.col("status") == "excluded_by_policy").alias("excluded"))
    return fields.join(status, "feature", "left").select(
        "feature", F.coalesce("selected", F.lit(False)).alias("selected_for_prediction"),
        F.coalesce("excluded", F.lit(False)).alias("excluded_by_policy"))


def age_years(days_birth: Column) -> Column:
    return -days_birth / F.lit(365.25)


def audit_groups(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "gender": F.when(F.col("CODE_GENDER") == "XNA", "Unknown").otherwise(F.col("CODE_GENDER")),
        "age_band": right_closed_band(age_years(F.col("DAYS_BIRTH")), AUDIT_AGE_EDGES, AUDIT_AGE_LABELS),
    })


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; NULL without observations."""
    n = F.when(total > 0, total.cast("double"))
    share = successes / n
    scale = 1 + z * z / n
    centre = (share + z * z / (2 * n)) / scale
    margin = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / scale
    # A NULL total must stay NULL, so no greatest/least over the bounds alone.
    return (F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - margin)),
            F.when(n.isNotNull(), F.least(F.lit(1.0), centre + margin)))


WHOLE = "<all>"  # the dimension of the whole population


def score_table(rows: DataFrame, probability: str, dimensions: Sequence[str], target: str = TARGET) -> DataFrame:
    """Distinct scores of every group of every dimension, and of all rows, with running totals: what all measures read.

    Rows are pooled to ``(dimension, group, score)`` before they move.
    """
    keys = [(d, F.coalesce(F.col(d).cast("string"), F.lit("nan"))) for d in dimensions] + [(WHOLE, F.lit(WHOLE))]
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), g.alias("group")) for d, g in keys])
    long = rows.select(probability, target, F.explode(pairs).alias("_d")).select(probability, target, "_d.*")
    return cut_lineage(with_counts(scored(long, probability, ["dimension", "group"], target)))


def group_audit(rows: DataFrame, probability: str, dimensions: Sequence[str], capacity: float = REVIEW_CAPACITY,
                target: str = TARGET, **minimum: int) -> DataFrame:
    """Measures of all groups at the score that fills the review capacity of the whole population."""
    table = score_table(rows, probability, dimensions, target)
    whole = table.where(F.col("dimension") == WHOLE)
    threshold = exact_quantiles(whole, "p", "n", [1.0 - capacity]).select(F.col("quantile").alias("review_threshold"))
    return measures(table.where(F.col("dimension") != WHOLE), ["dimension", "group"], threshold, **minimum)


def group_metrics(rows: DataFrame, probability: str, groups: Sequence[str], threshold: DataFrame,
                  minimum_rows: int = 200, minimum_events: int = 20, target: str = TARGET) -> DataFrame:
    """Rates at the review threshold with intervals; ranking and calibration only for eligible groups."""
    table = cut_lineage(with_counts(scored(rows, probability, groups, target)))
    return measures(table, groups, threshold, minimum_rows, minimum_events)


def measures(table: DataFrame, groups: Sequence[str], threshold: DataFrame, minimum_rows: int = 200,
             minimum_events: int = 20) -> DataFrame:
    """All measures of a staged score table (``groups, p, events, others, n`` and the totals before)."""
    groups = list(groups)
    p, n1, n0 = F.col("p"), F.col("events"), F.col("others")
    selected = p >= F.col("review_threshold")
    sums = attach(table, threshold).groupBy(*groups).agg(
        F.sum("n").alias("rows"),
        F.sum(n1).alias("_events"),
        F.sum(n0).alias("non_events"),
        (F.sum(n1) / F.sum("n")).alias("event_rate"),
        (F.sum(p * F.col("n")) / F.sum("n")).alias("mean_probability"),
        (F.sum(n1 * (p - 1) * (p - 1) + n0 * p * p) / F.sum("n")).alias("brier_score"),
        F.coalesce(F.sum(F.when(selected, F.col("n"))), F.lit(0)).alias("review_rows"),
        F.coalesce(F.sum(F.when(selected, n1)), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.when(selected, n0)), F.lit(0)).alias("_fp"),
    ).withColumnRenamed("_events", "events")
    events, others, n = F.col("events"), F.col("non_events"), F.col("rows")
    intervals = {}
    for name, k, total in (("event_rate", events, n), ("review_rate", F.col("review_rows"), n),
                           ("true_positive_rate", F.col("_tp"), events),
                           ("false_positive_rate", F.col("_fp"), others)):
        intervals[f"{name}_low"], intervals[f"{name}_high"] = wilson(k, total)
    base = sums.withColumns({
        "review_rate": F.col("review_rows") / n,
        "true_positive_rate_at_review_capacity": ratio(F.col("_tp"), events),
        "false_positive_rate_at_review_capacity": ratio(F.col("_fp"), others),
        **intervals,
        "eligible_for_comparison":
            (n >= minimum_rows) & (events >= minimum_events) & (others >= minimum_events),
    }).drop("_tp", "_fp")
    clipped = table.withColumn("p", clip_probability(p))
    pooled = table.select(*groups, logit(p).alias("_x"), F.col("n").alias("_n"), n1.cast("double").alias("_k"))
    for part in (ranking_metrics(table, groups), error_of(reliability_of(deciles_of(clipped, groups), groups), groups),
                 lines_of(pooled, groups)):
        base = attach(base, part, groups)
    return base.withColumns({
        m: F.when(F.col("eligible_for_comparison"), F.col(m)) for m in SUPPRESSIBLE})


def comparison_gaps(groups: DataFrame) -> DataFrame:
    """Largest and smallest eligible group per dimension and metric (two groups at least)."""
    long = groups.where("eligible_for_comparison").select("dimension", "group", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in GAP_METRICS
    ])).alias("_m")).select("dimension", "group", "_m.*").where(F.col("value").isNotNull())
    return long.groupBy("dimension", "metric").agg(
        F.count(F.lit(1)).alias("_groups"),
        F.min(F.struct(-F.col("value"), "group")).alias("_top"),
        F.min(F.struct("value", "group")).alias("_low"),
    ).where(F.col("_groups") >= 2).select(
        "dimension", "metric", F.col("_top.group").alias("maximum_group"),
        (-F.col("_top.col1")).alias("maximum"), F.col("_low.group").alias("minimum_group"),
        F.col("_low.value").alias("minimum"),
        (-F.col("_top.col1") - F.col("_low.value")).alias("absolute_gap"))


def attention_items(gaps: DataFrame, thresholds: dict[str, float] = ATTENTION) -> DataFrame:
    limit = None
    for metric, value in thresholds.items():
        test = F.col("metric") == metric
        limit = F.when(test, value) if limit is None else limit.when(test, value)
    return gaps.withColumn("threshold", limit).where(F.col("absolute_gap") >= F.col("threshold"))


def gap_changes(current: DataFrame, earlier: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """How every gap moved against an earlier audit."""
    before = earlier.select("dimension", "metric", F.col("absolute_gap").alias("earlier_gap"))
    change = F.col("absolute_gap") - F.col("earlier_gap")
    return current.join(before, ["dimension", "metric"]).select(
        "dimension", "metric", "earlier_gap", F.col("absolute_gap").alias("current_gap"),
        change.alias("change"),
        F.when(change > tolerance, "wider").when(change < -tolerance, "narrower").otherwise("unchanged")
        .alias("direction"))
