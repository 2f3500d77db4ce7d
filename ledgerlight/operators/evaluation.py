"""Model evaluation on (target, probability) rows, overall or per group.

Everything that needs an order is read off one table of distinct scores with running totals
(``operators.ordering``); nothing ranks raw rows globally.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import clip_probability, log_loss_term, logit, ratio
from ..session import cut_lineage
from .ordering import attach, exact_quantiles, running_totals

TARGET = "TARGET"
UNIT = (0.0, 1.0)


def scored(rows: DataFrame, probability: str, groups: Sequence[str] = (), target: str = TARGET,
           weight: Column | None = None) -> DataFrame:
    """Distinct scores, ascending, with events / non-events at and below each score."""
    w = F.lit(1) if weight is None else weight
    base = rows.select(
        *groups, F.col(probability).alias("p"), F.col(target).alias("_y"), w.alias("_w"))
    return running_totals(
        base, "p",
        {"events": F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0)),
         "others": F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(0))},
        groups, bounds=UNIT,
    )


def ranking_metrics(table: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (ties count one half) and average precision (step sum over distinct thresholds)."""
    groups = list(groups)
    size = table.groupBy(*groups).agg(F.sum("events").alias("_pos"), F.sum("others").alias("_neg"))
    with_size = attach(table, size, groups)
    above_or_tied = F.col("_pos") - F.col("events_before")
    selected = above_or_tied + F.col("_neg") - F.col("others_before")
    return with_size.groupBy(*groups).agg(
        (F.sum(F.col("events") * (F.col("others_before") + F.col("others") * 0.5))
         / F.nullif(F.first("_pos") * F.first("_neg"), F.lit(0))).alias("roc_auc"),
        (F.sum(F.col("events") * above_or_tied / F.nullif(selected, F.lit(0)))
         / F.nullif(F.first("_pos"), F.lit(0))).alias("average_precision"),
    )


def probability_metrics(rows: DataFrame, probability: str, groups: Sequence[str] = (),
                        target: str = TARGET) -> DataFrame:
    """Base rate, Brier score and skill, log loss, precision and recall at one half."""
    y, p = F.col(target), F.col(probability)
    base = F.avg(y)
    brier = F.avg((p - y) * (p - y))
    chosen = p >= 0.5
    hits = F.count_if(chosen & (y == 1))
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(y).alias("events"),
        base.alias("base_rate"),
        F.avg(p).alias("mean_probability"),
        brier.alias("brier_score"),
        (base * (1 - base)).alias("base_rate_brier_score"),
        (1 - brier / F.nullif(base * (1 - base), F.lit(0.0))).alias("brier_skill_score"),
        F.avg(log_loss_term(y, p)).alias("log_loss"),
        F.coalesce(ratio(hits, F.count_if(chosen)), F.lit(0.0)).alias("precision_at_0_5"),
        F.coalesce(ratio(hits, F.count_if(y == 1)), F.lit(0.0)).alias("recall_at_0_5"),
    )


def evaluate(rows: DataFrame, probability: str, groups: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """One metric row per group."""
    return attach(
        probability_metrics(rows, probability, groups, target),
        ranking_metrics(scored(rows, probability, groups, target), groups), groups)


def with_counts(table: DataFrame) -> DataFrame:
    return table.withColumns({
        "n": F.col("events") + F.col("others"), "n_before": F.col("events_before") + F.col("others_before")})


def top_share_metrics(rows: DataFrame, probability: str, shares: Sequence[float] = (0.10, 0.20),
                      groups: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """Rows at or above the interpolated ``1 - share`` quantile: event rate, lift, event capture."""
    groups = list(groups)
    table = with_counts(scored(rows, probability, groups, target))
    cuts = exact_quantiles(table, "p", "n", [1.0 - s for s in shares], groups)
    labels = reduce(
        lambda out, s: out.when(F.abs(F.col("q") - (1.0 - s)) < 1e-9, F.lit(s)), shares[1:],
        F.when(F.abs(F.col("q") - (1.0 - shares[0])) < 1e-9, F.lit(shares[0])))
    cuts = cuts.select(*groups, labels.alias("share"), F.col("quantile").alias("threshold"))
    picked = F.col("p") >= F.col("threshold")
    # At most ``len(shares)`` cuts per group, carried as one array.
    cuts = cuts.groupBy(*groups).agg(F.collect_list(F.struct("share", "threshold")).alias("cuts"))
    joined = attach(table, cuts, groups).withColumn("cut", F.explode("cuts")).select(*table.columns, "cut.*")
    out = joined.groupBy(*groups, "share", "threshold").agg(
        F.sum("n").alias("_n"), F.sum("events").alias("_events"),
        F.sum(F.when(picked, F.col("n"))).alias("selected_rows"),
        F.sum(F.when(picked, F.col("events"))).alias("selected_events"),
    )
    rate = F.col("selected_events") / F.col("selected_rows")
    return out.select(
        *groups, "share", F.col("threshold").alias("probability_threshold"), "selected_rows", "selected_events",
        (F.col("selected_rows") / F.col("_n")).alias("population_share"),
        rate.alias("selected_event_rate"),
        ratio(rate, F.col("_events") / F.col("_n")).alias("lift"),
        ratio(F.col("selected_events"), F.col("_events")).alias("event_capture_rate"),
    )


def deciles_of(table: DataFrame, groups: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Equal-count bins: interpolated quantile edges, repeated edges merged, right-closed.

    ``table`` has distinct scores with ``n`` and ``n_before``.  A score belongs to the bin of the first edge that is not
    below it, so merged edges simply leave their bin empty.  Adds ``bin``.
    """
    groups = list(groups)
    edges = exact_quantiles(table, "p", "n", [i / bins for i in range(1, bins)], groups)
    # At most ``bins - 1`` edges per group.
    edges = edges.groupBy(*groups).agg(F.sort_array(F.collect_set("quantile")).alias("edges"))
    return attach(table, edges, groups).withColumn(
        "bin", F.size(F.filter("edges", lambda e: e < F.col("p"))).cast("bigint")).drop("edges")


def decile_bins(rows: DataFrame, probability: str, groups: Sequence[str] = (), target: str = TARGET,
                bins: int = 10) -> DataFrame:
    return deciles_of(with_counts(scored(rows, probability, groups, target)), groups, bins)


def reliability_of(binned: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return binned.groupBy(*groups, "bin").agg(
        F.sum("n").alias("rows"),
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_probability"),
        (F.sum("events") / F.sum("n")).alias("observed_rate"),
    ).withColumn("absolute_error", F.abs(F.col("observed_rate") - F.col("mean_probability")))


def reliability(rows: DataFrame, probability: str, groups: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    return reliability_of(decile_bins(rows, probability, groups, target), groups)


def error_of(bins: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return bins.groupBy(*groups).agg(
        (F.sum(F.col("absolute_error") * F.col("rows")) / F.sum("rows")).alias("expected_calibration_error"))


def expected_calibration_error(rows: DataFrame, probability: str, groups: Sequence[str] = (),
                               target: str = TARGET) -> DataFrame:
    return error_of(reliability(rows, probability, groups, target), groups)


def calibration_line(rows: DataFrame, probability: str, groups: Sequence[str] = (), target: str = TARGET,
                     steps: int = 25, tolerance: float = 1e-11) -> DataFrame:
    """Slope and intercept of an unpenalised logistic fit of the target on the score's log odds."""
    pooled = rows.select(
        *groups, logit(F.col(probability)).alias("_x"), F.col(target).cast("double").alias("_y")
    ).groupBy(*groups, "_x").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_k"))
    return lines_of(cut_lineage(pooled), groups, steps, tolerance)


COARSE_STEPS = 32  # bins of one unit of log odds in the rough fit; clipped log odds span 28 units
COARSE_GROUPS = 200


def _newton_step(sums: tuple, a: float, b: float) -> tuple[float, float] | None:
    g0, g1, h00, h01, h11 = (s or 0.0 for s in sums)
    det = h00 * h11 - h01 * h01
    if det <= 0.0:  # one distinct score: no slope
        return None
    return a + (h11 * g0 - h01 * g1) / det, b + (h00 * g1 - h01 * g0) / det


def _rough_lines(pooled: DataFrame, groups: list[str], state: dict) -> None:
    """Better starting points, from log odds in coarse bins (under a thousand rows a group, a few groups)."""
    rows = pooled.groupBy(*groups, F.floor(F.col("_x") * COARSE_STEPS).alias("_bin")).agg(
        F.sum("_n").alias("n"), F.sum("_k").alias("k"), (F.sum(F.col("_n") * F.col("_x")) / F.sum("_n")).alias("x")).collect()
    tables: dict[tuple, list] = {}
    for r in rows:
        tables.setdefault(tuple(r[g] for g in groups), []).append((r.n, r.k, r.x))
    for key, table in tables.items():
        line = start = state[key]
        for _ in range(8):
            if line is None or line[0] is None:
                break
            sums = [0.0] * 5
            for n, k, x in table:
                p = 1 / (1 + math.exp(-max(-700.0, min(700.0, line[0] + line[1] * x))))
                w, r = n * p * (1 - p), k - n * p
                for i, v in enumerate((r, r * x, w, w * x, w * x * x)):
                    sums[i] += v
            line = _newton_step(tuple(sums), *line)
        if line is not None and line[0] is not None and all(map(math.isfinite, line)):
            state[key] = line
        else:
            state[key] = start


def lines_of(pooled: DataFrame, groups: Sequence[str] = (), steps: int = 25, tolerance: float = 1e-11) -> DataFrame:
    """The logistic fits of every group of a staged table ``groups, _x, _n, _k`` (log odds, rows, events).

    Newton's method on two coefficients per group, all groups in one aggregate per step.  Only five sums per group and step
    reach the driver, as in any iterative fit; a group with a single class has no fit and gets NULL.
    """
    groups = list(groups)
    schema = T.StructType([*pooled.select(*groups).schema.fields,
                           T.StructField("_a", T.DoubleType()), T.StructField("_b", T.DoubleType())])
    totals = pooled.groupBy(*groups).agg(F.sum("_n").alias("n"), F.sum("_k").alias("k")).collect()
    state = {
        tuple(r[g] for g in groups):
        (math.log(r.k / (r.n - r.k)), 0.0) if r.n and 0 < r.k < r.n else (None, None)
        for r in totals}
    if len(state) <= COARSE_GROUPS:
        _rough_lines(pooled, groups, state)
    for _ in range(steps):
        current = _with_line(pooled, groups, state, schema)
        p = 1 / (1 + F.exp(-(F.col("_a") + F.col("_b") * F.col("_x"))))
        w, r = F.col("_n") * p * (1 - p), F.col("_k") - F.col("_n") * p
        sums = current.where(F.col("_a").isNotNull()).groupBy(*groups).agg(
            F.sum(r).alias("g0"), F.sum(r * F.col("_x")).alias("g1"), F.sum(w).alias("h00"),
            F.sum(w * F.col("_x")).alias("h01"), F.sum(w * F.col("_x") * F.col("_x")).alias("h11")).collect()
        moved = 0.0
        for s in sums:
            key = tuple(s[g] for g in groups)
            before = state[key]
            after = _newton_step((s.g0, s.g1, s.h00, s.h01, s.h11), *before) if before[0] is not None else None
            state[key] = after or (None, None)
            if after:
                moved = max(moved, abs(after[0] - before[0]), abs(after[1] - before[1]))
        if moved < tolerance:
            break
    table = pooled.sparkSession.createDataFrame([(*k, *v) for k, v in state.items()], schema)
    return table.select(
        *groups, F.col("_a").alias("calibration_intercept"), F.col("_b").alias("calibration_slope"))


def _with_line(pooled: DataFrame, groups: list[str], state: dict, schema: T.StructType) -> DataFrame:
    """Current coefficients next to every pooled row."""
    if not groups:
        a, b = next(iter(state.values()), (None, None))
        return pooled.withColumns({
            "_a": F.lit(a).cast("double"), "_b": F.lit(b).cast("double")})
    table = pooled.sparkSession.createDataFrame([(*k, *v) for k, v in state.items()], schema)
    return attach(pooled, table, groups, "inner")


def full_report(rows: DataFrame, probability: str, groups: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """Ranking, proper scores, reliability error and calibration line in one row per group."""
    out = evaluate(rows, probability, groups, target)
    clipped = rows.withColumn(probability, clip_probability(F.col(probability)))
    for part in (expected_calibration_error(clipped, probability, groups, target),
                 calibration_line(rows, probability, groups, target)):
        out = attach(out, part, groups)
    return out


# ---------------------------------------------------------------- operating points

FRACTIONS = (0.01, 0.02, 0.05, 0.10, 0.20, 0.30, 0.50)
PRECISION_TARGETS = (0.20, 0.30, 0.40, 0.50)
RECALL_TARGETS = (0.20, 0.40, 0.60, 0.80)


def operating_points(rows: DataFrame, probability: str, key: str, fractions: Sequence[float] = FRACTIONS,
                     target: str = TARGET) -> DataFrame:
    """Top ``ceil(n * f)`` rows by score, equal scores taken in key order.

    The cut score of each fraction comes from the running totals; only the rows tied at a cut score are
    ordered by key, again with bounded windows.
    """
    table = with_counts(scored(rows, probability, (), target))
    size = table.agg(F.sum("n").alias("rows"), F.sum("events").alias("positives"))
    higher = F.col("rows") - F.col("n_before") - F.col("n")

    def cut_here(f: Column) -> Column:
        take = F.ceil(F.col("rows") * f)
        return (higher < take) & (take <= higher + F.col("n"))

    # One row per fraction: the score at which its last row falls.
    cut = attach(table, size).withColumn(
        "fraction", F.explode(F.filter(F.array(*[F.lit(f) for f in fractions]), cut_here))
    ).withColumn("take", F.ceil(F.col("rows") * F.col("fraction"))).select(
        "fraction", "rows", "positives", "take", F.col("p").alias("cut"), (F.col("take") - higher).alias("need"),
        (F.col("positives") - F.col("events_before") - F.col("events")).alias("events_above"))
    cuts = F.broadcast(cut.select("cut").distinct())
    tied = rows.select(F.col(probability).alias("cut"), F.col(key).alias("_key"), F.col(target).alias("_y")).join(
        cuts, "cut", "left_semi")
    placed = running_totals(
        tied, "_key", {"n": F.count(F.lit(1)), "events": F.sum("_y")}, groups=("cut",))
    among = placed.join(F.broadcast(cut.select("fraction", "cut", "need")), "cut").where(
        F.col("n_before") < F.col("need")).groupBy("fraction").agg(F.sum("events").alias("events_tied"))
    hits = F.col("events_above") + F.coalesce(F.col("events_tied"), F.lit(0))
    precision = hits / F.col("take")
    return cut.join(among, "fraction", "left").select(
        "fraction", F.col("take").alias("selected_rows"), F.col("cut").alias("probability_threshold"),
        hits.alias("true_positives"), (F.col("take") - hits).alias("false_positives"),
        precision.alias("precision"), (hits / F.col("positives")).alias("recall"),
        (precision / (F.col("positives") / F.col("rows"))).alias("lift_over_prevalence"))


def precision_recall_points(rows: DataFrame, probability: str, target: str = TARGET) -> DataFrame:
    """Precision and recall at every distinct threshold."""
    table = with_counts(scored(rows, probability, (), target))
    size = table.agg(F.sum("n").alias("rows"), F.sum("events").alias("positives"))
    hits = F.col("positives") - F.col("events_before")
    return attach(table, size).select(
        F.col("p").alias("threshold"),
        (hits / (F.col("rows") - F.col("n_before"))).alias("precision"),
        (hits / F.nullif(F.col("positives"), F.lit(0))).alias("recall"))


def precision_recall_targets(rows: DataFrame, probability: str, target: str = TARGET) -> DataFrame:
    """Best recall for each precision floor, best precision for each recall floor, and the best F1 point.

    Equal bests resolve to the lowest threshold.
    """
    points = precision_recall_points(rows, probability, target)
    p, r, t = F.col("precision"), F.col("recall"), F.col("threshold")
    f1 = 2 * p * r / F.greatest(p + r, F.lit(2.220446049250313e-16))

    def best(kind: str, floor: float, eligible: Column, value: Column) -> Column:
        point = F.max_by(F.struct(p, r, t), F.when(eligible, F.struct(value, -t)))
        return F.struct(F.lit(kind).alias("kind"), F.lit(floor).alias("floor"), point.alias("point"))

    wanted = [best("precision", f, p >= f, r) for f in PRECISION_TARGETS]
    wanted += [best("recall", f, r >= f, p) for f in RECALL_TARGETS]
    wanted.append(best("maximum_f1", 0.0, F.lit(True), f1))
    reached = points.agg(F.array(*wanted).alias("all")).select(F.explode("all").alias("x")).select("x.*")
    return reached.where(F.col("point").isNotNull()).select(
        "kind", "floor", "point.precision", "point.recall", "point.threshold")


# ---------------------------------------------------------------- segments and gates

def sample_status(minimum_rows: int = 500, minimum_events: int = 30) -> Column:
    return F.when((F.col("rows") >= minimum_rows) & (F.col("events") >= minimum_events), "evaluated").otherwise(
        "exploratory_low_sample")


def segment_metrics(rows: DataFrame, probability: str, dimensions: Sequence[str], target: str = TARGET,
                    minimum_rows: int = 100) -> DataFrame:
    """Metrics for each value of each dimension; small or one-class groups are left out."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dimensions]))
    long = rows.select(probability, target, pairs.alias("_s")).select(
        probability, target, "_s.dimension", "_s.segment").where(F.col("segment").isNotNull())
    return evaluate(long, probability, ["dimension", "segment"], target).where(
        (F.col("rows") >= minimum_rows) & (F.col("events") > 0) & (F.col("events") < F.col("rows"))
    ).select("dimension", "segment", "rows", "events", F.col("base_rate").alias("prevalence"),
             "average_precision", "roc_auc", "brier_score")


def acceptance_gates(metrics: DataFrame) -> DataFrame:
    """Declared acceptance checks over a ``full_report`` row."""
    multiple = F.col("average_precision") / F.col("base_rate")
    checks = {
        "roc_auc_at_least_0_75": F.col("roc_auc") >= 0.75,
        "average_precision_at_least_2_5x_prevalence": multiple >= 2.5,
        "brier_better_than_base_rate_predictor": F.col("brier_score") < F.col("base_rate") * (1 - F.col("base_rate")),
        "calibration_slope_between_0_90_and_1_10": F.col("calibration_slope").between(0.90, 1.10),
    }
    return metrics.withColumn("average_precision_multiple", multiple).withColumns(checks).withColumn(
        "all_passed", reduce(lambda a, b: a & b, [F.col(c) for c in checks]))


# Research promotion gates of the challenger comparison.
CHALLENGER_GATES = {
    "minimum_average_precision_gain": 0.003,
    "minimum_probability_gain_positive": 0.90,
    "maximum_brier_regression": 0.0002,
    "maximum_roc_auc_regression": 0.001,
    "maximum_top_20_capture_regression": 0.005,
}


def challenger_gates(baseline: DataFrame, candidate: DataFrame, probability_positive: Column,
                     gates: dict[str, float] = CHALLENGER_GATES) -> DataFrame:
    """Five checks of a candidate metric row against the baseline row (single rows on both sides)."""
    names = ("average_precision", "brier_score", "roc_auc", "top_20_capture")
    both = attach(candidate, baseline.select(*[F.col(n).alias(f"_{n}") for n in names]))
    both = both.withColumns({f"delta_{n}": F.col(n) - F.col(f"_{n}") for n in names})
    checks = {
        "average_precision_gain": F.col("delta_average_precision") >= gates["minimum_average_precision_gain"],
        "bootstrap_probability_positive": probability_positive >= gates["minimum_probability_gain_positive"],
        "brier_non_regression": F.col("delta_brier_score") <= gates["maximum_brier_regression"],
        "roc_auc_non_regression": F.col("delta_roc_auc") >= -gates["maximum_roc_auc_regression"],
        "top_20_capture_non_regression":
            F.col("delta_top_20_capture") >= -gates["maximum_top_20_capture_regression"],
    }
    return both.withColumns(checks).withColumn(
        "all_passed", reduce(lambda a, b: a & b, [F.col(c) for c in checks])
    ).drop(*[f"_{n}" for n in names])


def metric_deltas(metrics: DataFrame, reference: str, names: Sequence[str]) -> DataFrame:
    """Differences of every model's metrics from one reference model (``model`` column)."""
    base = metrics.where(F.col("model") == reference).select(*[F.col(n).alias(f"_{n}") for n in names])
    return attach(metrics, base).select(
        "model", *names, *[(F.col(n) - F.col(f"_{n}")).alias(f"delta_{n}") for n in names])


def importance_tiers(shares: DataFrame, share: str, name: str) -> DataFrame:
    """Cumulative share from the largest down -> tier label.  ``shares`` has one row per feature name."""
    order = Window.orderBy(F.col(share).desc(), F.col(name))
    running = F.sum(share).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return shares.withColumns({"cumulative_share": running, "importance_rank": F.row_number().over(order)}).withColumn(
        "importance_tier",
        F.when(F.col("cumulative_share") <= 0.50, "Tier 1 - dominant")
        .when(F.col("cumulative_share") <= 0.80, "Tier 2 - material")
        .when(F.col("cumulative_share") <= 0.95, "Tier 3 - supporting")
        .otherwise("Tier 4 - residual"))
