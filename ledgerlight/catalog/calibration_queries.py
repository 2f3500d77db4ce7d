"""Calibrators, blends, promotion gates and the bootstrap over the prediction role."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import bootstrap as R
from ..operators import calibration as C
from ..operators import evaluation as E
from ..operators.splits import assign_splits
from ..session import cut_lineage
from ..sources.roles import role, with_roles
from .application_queries import SPLIT_CTE
from .common import r6, register
from .evaluation_queries import METRICS, SEGMENT, evaluation_ctes, newton_ctes, predictions

A, H = "application_probability", "history_probability"
ITERATIONS = 300
HALVES_CTE = f"""{SPLIT_CTE},
halves AS (SELECT predictions.*, calibration_role, {SEGMENT} AS history_segment
  FROM predictions JOIN (SELECT SK_ID_CURR, calibration_role FROM splits WHERE split = 'calibration') USING (SK_ID_CURR))"""
ROLES = ("predictions", "application_train")


def halves(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of the calibration part in its two disjoint halves; no development or holdout row enters.

    Calibration stages hand over tables, so the split is materialised once in the checkpoint folder.
    """
    splits = assign_splits(role(spark, sf, "application_train")).where("split = 'calibration'").select(
        "SK_ID_CURR", "calibration_role")
    return cut_lineage(predictions(spark, sf).join(splits, "SK_ID_CURR"))


def _held(df: DataFrame) -> DataFrame:
    return df.where("calibration_role = 'calibrator_evaluation'")


@register("sigmoid_calibration", with_roles(
    f"""SELECT SK_ID_CURR, calibration_role, {r6(f'1 / (1 + exp(-(calibration_intercept + calibration_slope * ln({H} / (1 - {H})))))')} AS calibrated
    FROM halves, line""", *ROLES,
    ctes=f"{HALVES_CTE},\nbase AS (SELECT * FROM halves WHERE calibration_role = 'calibrator_fit'),\n{newton_ctes()}"))
def sigmoid_calibration(spark: SparkSession, sf: str) -> DataFrame:
    df = halves(spark, sf)
    fit = df.where("calibration_role = 'calibrator_fit'")
    return rounded(C.calibrate(fit, df, H, "sigmoid").select("SK_ID_CURR", "calibration_role", "calibrated"))


@register("isotonic_fit", with_roles(
    f"""SELECT {r6('s')} AS score, {r6('greatest(1e-6, least(1 - 1e-6, max(m)))')} AS fitted FROM (
      SELECT j, k, s, min(a) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM (
        SELECT x.i AS j, y.i AS k, y.s, (y.cy - x.cy + x.y) / (y.cn - x.cn + x.n)::DOUBLE AS a FROM pooled x JOIN pooled y ON y.i >= x.i)
      ) GROUP BY k, s""", *ROLES, ctes=f"""{HALVES_CTE},
    pooled AS (SELECT s, n, y, row_number() OVER (ORDER BY s) AS i, sum(n) OVER (ORDER BY s) AS cn, sum(y) OVER (ORDER BY s) AS cy
      FROM (SELECT {H} AS s, count(*) AS n, sum(TARGET) AS y FROM halves WHERE calibration_role = 'calibrator_fit' GROUP BY 1))"""))
def isotonic_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted value at every fit score; the check uses the max-min form of isotonic regression."""
    fit = halves(spark, sf).where("calibration_role = 'calibrator_fit'")
    model = C.isotonic_fit(fit, H)
    return rounded(C.isotonic_predict(fit.select(F.col(H).alias("score")).distinct(), model, "score", "fitted"))


_KNOTS_CTE = f"""pooled AS (SELECT s, n, y, row_number() OVER (ORDER BY s) AS i, sum(n) OVER (ORDER BY s) AS cn, sum(y) OVER (ORDER BY s) AS cy
  FROM (SELECT {H} AS s, count(*) AS n, sum(TARGET) AS y FROM halves WHERE calibration_role = 'calibrator_fit' GROUP BY 1)),
knots AS (SELECT s, max(m) AS f FROM (
  SELECT j, k, s, min(a) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM (
    SELECT x.i AS j, y.i AS k, y.s, (y.cy - x.cy + x.y) / (y.cn - x.cn + x.n)::DOUBLE AS a FROM pooled x JOIN pooled y ON y.i >= x.i)) GROUP BY s)"""
_CLIP = "greatest(1e-6, least(1 - 1e-6, {}))"


@register("calibrator_comparison", with_roles(
    f"""SELECT method, {METRICS.present()}, row_number() OVER (ORDER BY brier_score, log_loss, place) = 1 AS selected
    FROM metrics JOIN (VALUES ('identity', 0), ('sigmoid', 1), ('isotonic', 2)) AS o(method, place) USING (method)""", *ROLES,
    ctes=f"""{HALVES_CTE},
base AS (SELECT * FROM halves WHERE calibration_role = 'calibrator_fit'),
{newton_ctes()},
{_KNOTS_CTE},
heldout AS (SELECT * FROM halves WHERE calibration_role = 'calibrator_evaluation'),
between AS (SELECT TARGET, {H} AS h, lo.s AS ls, lo.f AS lf, hi.s AS hs, hi.f AS hf FROM heldout
  ASOF LEFT JOIN knots lo ON {H} >= lo.s ASOF LEFT JOIN knots hi ON {H} <= hi.s),
calibrated AS (
  SELECT 'identity' AS method, TARGET, {_CLIP.format(H)} AS q FROM heldout
  UNION ALL SELECT 'sigmoid', TARGET, 1 / (1 + exp(-(calibration_intercept + calibration_slope * ln({H} / (1 - {H}))))) FROM heldout, line
  UNION ALL SELECT 'isotonic', TARGET, {_CLIP.format("CASE WHEN ls IS NULL THEN hf WHEN hs IS NULL OR lf = hf OR ls = hs THEN lf ELSE lf + (hf - lf) * (h - ls) / (hs - ls) END")} FROM between),
{evaluation_ctes('q', source='calibrated', groups='method')}"""))
def calibrator_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.compare_calibrators(halves(spark, sf), H))


@register("calibration_predictions", with_roles(
    f"""SELECT SK_ID_CURR, calibration_role, {r6(f"CASE WHEN calibration_role = 'calibrator_evaluation' THEN 1 / (1 + exp(-(h.calibration_intercept + h.calibration_slope * ln({H} / (1 - {H}))))) END")} AS selection_evaluation_probability,
      {r6(f'1 / (1 + exp(-(w.calibration_intercept + w.calibration_slope * ln({H} / (1 - {H})))))')} AS final_calibrated_probability
    FROM halves, line h, wline w""", *ROLES,
    ctes=f"{HALVES_CTE},\nbase AS (SELECT * FROM halves WHERE calibration_role = 'calibrator_fit'),\n{newton_ctes()},\n"
    + newton_ctes(source="halves").replace("obs", "wobs").replace("line_steps", "wsteps").replace("line AS", "wline AS")))
def calibration_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.prediction_table(halves(spark, sf), H, "sigmoid").select(
        "SK_ID_CURR", "calibration_role", "selection_evaluation_probability", "final_calibrated_probability"))


# ---------------------------------------------------------------- blends

_LOSS = ("-CASE WHEN TARGET = 1 THEN ln(greatest(least(p, 1 - 1e-6), 1e-6)) ELSE ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)) END")
CANDIDATE_CTE = f"""candidates AS (
  SELECT history_segment, w AS history_weight, avg((p - TARGET) * (p - TARGET)) AS brier_score, avg({_LOSS}) AS log_loss FROM (
    SELECT *, w * {H} + (1 - w) * {A} AS p FROM halves, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS w)
    WHERE calibration_role = 'calibrator_fit') GROUP BY ALL),
weights AS (SELECT history_segment, first(history_weight ORDER BY brier_score, log_loss, history_weight) AS history_weight
  FROM candidates GROUP BY 1)"""


def _fit(df: DataFrame) -> DataFrame:
    return df.where("calibration_role = 'calibrator_fit'")


def _weights(df: DataFrame) -> DataFrame:
    return C.select_weights(C.weight_candidates(_fit(df), A, H, ["history_segment"]), ["history_segment"])


@register("blend_weight_candidates", with_roles(
    f"SELECT history_segment, history_weight, {r6('brier_score')} AS brier_score, {r6('log_loss')} AS log_loss FROM candidates",
    *ROLES, ctes=f"{HALVES_CTE},\n{CANDIDATE_CTE}"))
def blend_weight_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.weight_candidates(_fit(halves(spark, sf)), A, H, ["history_segment"]))


@register("blend_violations", with_roles(
    f"SELECT count(*) FILTER ({A} IS NULL OR {A} <= 0 OR {A} >= 1) AS {A}, count(*) FILTER ({H} IS NULL OR {H} <= 0 OR {H} >= 1) AS {H} FROM predictions",
    "predictions"))
def blend_violations(spark: SparkSession, sf: str) -> DataFrame:
    return C.blend_violations(predictions(spark, sf), [A, H])


@register("operational_probability", with_roles(
    f"SELECT SK_ID_CURR, history_segment, history_weight, {r6(f'history_weight * {H} + (1 - history_weight) * {A}')} AS operational_probability"
    " FROM halves JOIN weights USING (history_segment)", *ROLES, ctes=f"{HALVES_CTE},\n{CANDIDATE_CTE}"))
def operational_probability(spark: SparkSession, sf: str) -> DataFrame:
    df = halves(spark, sf)
    return rounded(C.operational_probability(df, _weights(df), A, H).select(
        "SK_ID_CURR", "history_segment", "history_weight", "operational_probability"))


# ---------------------------------------------------------------- bootstrap

_EDGES = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(18)]
_POISSON = "CASE " + " ".join(f"WHEN u < {edge!r} THEN {k}" for k, edge in enumerate(_EDGES)) + " ELSE 18 END"


def bootstrap_ctes(source: str, candidate: str, reference: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""drawn AS (
  SELECT {g}it, TARGET AS y, {candidate} AS a, {reference} AS b, {_POISSON} AS w0 FROM (
    SELECT *, ('0x' || substr(md5(concat(SK_ID_CURR::VARCHAR, ':', it::VARCHAR, ':42')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
    FROM {source}, (SELECT unnest(range(0, {ITERATIONS})) AS it))),
sized AS (SELECT {g}TARGET AS y, count(*) AS n FROM {source} GROUP BY ALL),
weighted AS (SELECT {g}it, y, a, b, w0 * n / (sum(w0) OVER (PARTITION BY {g}it, y))::DOUBLE AS w FROM drawn JOIN sized USING ({g}y)),
long AS (SELECT {g}it, 1 AS sign, y, a AS p, w FROM weighted WHERE w > 0 UNION ALL SELECT {g}it, -1, y, b, w FROM weighted WHERE w > 0),
curve AS (SELECT *, sum(CASE WHEN y = 0 THEN w ELSE 0 END) OVER (PARTITION BY {g}it, sign ORDER BY p) AS neg_upto,
  sum(CASE WHEN y = 0 THEN w ELSE 0 END) OVER (PARTITION BY {g}it, sign, p) AS neg_tied,
  sum(w) OVER (PARTITION BY {g}it, sign ORDER BY p DESC) AS picked,
  sum(w * y) OVER (PARTITION BY {g}it, sign ORDER BY p DESC) AS caught FROM long),
per_model AS (SELECT {g}it, sign, sum(w * (p - y) * (p - y)) / sum(w) AS brier,
  sum(w * y * (neg_upto - neg_tied / 2)) / (sum(w * y) * sum(w * (1 - y))) AS auc,
  sum(w * y * caught / picked) / sum(w * y) AS ap FROM curve GROUP BY ALL),
deltas AS (SELECT {g}it, sum(sign * brier) AS brier_score_delta, sum(sign * auc) AS roc_auc_delta, sum(sign * ap) AS average_precision_delta
  FROM per_model GROUP BY {g}it)"""


@register("bootstrap_deltas", with_roles(
    "SELECT it::BIGINT AS iteration, " + ", ".join(f"{r6(n)} AS {n}" for n in (
        "brier_score_delta", "roc_auc_delta", "average_precision_delta")) + " FROM deltas", "predictions",
    ctes=bootstrap_ctes("predictions", H, A)))
def bootstrap_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.bootstrap_deltas(predictions(spark, sf), H, A, "SK_ID_CURR", ITERATIONS))


def _summary_sql(name: str, better: str) -> str:
    c = f"{name}_delta"
    return (f"{r6(f'avg({c})')} AS {name}_mean, {r6(f'quantile_cont({c}, 0.025)')} AS {name}_low,"
            f" {r6(f'quantile_cont({c}, 0.975)')} AS {name}_high, {r6(f'avg(CASE WHEN {c} {better}1e-12 THEN 1 ELSE 0 END)')} AS {name}_support")


@register("bootstrap_summary", with_roles(
    f"SELECT count(*) AS iterations, {_summary_sql('brier_score', '< -')}, {_summary_sql('roc_auc', '>')},"
    f" {_summary_sql('average_precision', '>')} FROM deltas", "predictions", ctes=bootstrap_ctes("predictions", H, A)))
def bootstrap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.bootstrap_summary(
        R.bootstrap_deltas(predictions(spark, sf), H, A, "SK_ID_CURR", ITERATIONS)))


@register("promotion_gate", with_roles(
    f"""SELECT history_segment, history_weight, brier_support, {r6('m.brier_score')} AS hybrid_brier_score, {r6('h.brier_score')} AS history_brier_score,
      m.brier_score < h.brier_score AS brier_improves, m.log_loss < h.log_loss AS log_loss_improves,
      m.average_precision >= h.average_precision AS average_precision_not_worse, brier_support >= 0.9 AS bootstrap_brier_support,
      history_weight <> 1 AND m.brier_score < h.brier_score AND m.log_loss < h.log_loss AND m.average_precision >= h.average_precision
        AND brier_support >= 0.9 AS candidate_promoted
    FROM weights JOIN metrics m USING (history_segment) JOIN hmetrics h USING (history_segment) JOIN support USING (history_segment)""",
    *ROLES, ctes=f"""{HALVES_CTE},
{CANDIDATE_CTE},
held AS (SELECT halves.*, history_weight, history_weight * {H} + (1 - history_weight) * {A} AS mixed FROM halves JOIN weights USING (history_segment)
  WHERE calibration_role = 'calibrator_evaluation'),
{evaluation_ctes('mixed', source='held', groups='history_segment')},
{evaluation_ctes(H, source='held', groups='history_segment').replace('ranked', 'hranked').replace('metrics AS', 'hmetrics AS')},
{bootstrap_ctes('held', 'mixed', H, 'history_segment')},
support AS (SELECT history_segment, {r6('avg(CASE WHEN brier_score_delta < -1e-12 THEN 1 ELSE 0 END)')} AS brier_support FROM deltas GROUP BY 1)"""))
def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    df = halves(spark, sf)
    weights, held = _weights(df), _held(df)
    mixed = C.operational_probability(held, weights, A, H)
    deltas = R.bootstrap_deltas(
        mixed, "operational_probability", H, "SK_ID_CURR", ITERATIONS, groups=["history_segment"])
    support = R.bootstrap_summary(deltas, ["history_segment"]).select(
        "history_segment", F.col("brier_score_support").alias("brier_support"))
    return rounded(C.promotion_gate(held, weights, A, H, support).select(
        "history_segment", "history_weight", "brier_support", "hybrid_brier_score", "history_brier_score",
        "brier_improves", "log_loss_improves", "average_precision_not_worse", "bootstrap_brier_support",
        "candidate_promoted"))


@register("challenger_gates", with_roles(
    f"""SELECT {r6('c.average_precision - b.average_precision')} AS delta_average_precision, {r6('c.brier_score - b.brier_score')} AS delta_brier_score,
      {r6('c.roc_auc - b.roc_auc')} AS delta_roc_auc, {r6('ct.capture - bt.capture')} AS delta_top_20_capture,
      c.average_precision - b.average_precision >= 0.003 AS average_precision_gain, s >= 0.9 AS bootstrap_probability_positive,
      c.brier_score - b.brier_score <= 0.0002 AS brier_non_regression, c.roc_auc - b.roc_auc >= -0.001 AS roc_auc_non_regression,
      ct.capture - bt.capture >= -0.005 AS top_20_capture_non_regression,
      c.average_precision - b.average_precision >= 0.003 AND s >= 0.9 AND c.brier_score - b.brier_score <= 0.0002
        AND c.roc_auc - b.roc_auc >= -0.001 AND ct.capture - bt.capture >= -0.005 AS all_passed
    FROM metrics c, bmetrics b, ctop ct, btop bt, (SELECT avg(CASE WHEN average_precision_delta > 1e-12 THEN 1 ELSE 0 END) AS s FROM deltas)""",
    "predictions", ctes=f"""{evaluation_ctes(H, source='predictions')},
{evaluation_ctes(A, source='predictions').replace('ranked', 'branked').replace('metrics AS', 'bmetrics AS')},
ctop AS (SELECT sum(TARGET) FILTER ({H} >= t) / sum(TARGET)::DOUBLE AS capture FROM predictions, (SELECT quantile_cont({H}, 0.8) AS t FROM predictions)),
btop AS (SELECT sum(TARGET) FILTER ({A} >= t) / sum(TARGET)::DOUBLE AS capture FROM predictions, (SELECT quantile_cont({A}, 0.8) AS t FROM predictions)),
{bootstrap_ctes('predictions', H, A)}"""))
def challenger_gates(spark: SparkSession, sf: str) -> DataFrame:
    df = predictions(spark, sf)

    def row(p: str) -> DataFrame:
        capture = E.top_share_metrics(df, p, (0.20,)).select(F.col("event_capture_rate").alias("top_20_capture"))
        return E.attach(E.evaluate(df, p), capture)

    support = R.bootstrap_summary(R.bootstrap_deltas(df, H, A, "SK_ID_CURR", ITERATIONS)).select("average_precision_support")
    gated = E.challenger_gates(row(A), E.attach(row(H), support), F.col("average_precision_support"))
    return rounded(gated.select(
        "delta_average_precision", "delta_brier_score", "delta_roc_auc", "delta_top_20_capture",
        "average_precision_gain", "bootstrap_probability_positive", "brier_non_regression",
        "roc_auc_non_regression", "top_20_capture_non_regression", "all_passed"))
