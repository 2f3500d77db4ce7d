"""Evaluation, operating points, segments, gates and fairness over the prediction role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import right_closed_band, rounded
from ..operators import evaluation as E
from ..operators import fairness as Q
from ..sources.roles import role, with_roles
from .common import Spec, r6, register

P = "history_probability"
SEGMENT = ("CASE WHEN history_source_count <= 1 THEN 'thin_0_to_1_sources'"
           " WHEN history_source_count <= 3 THEN 'partial_2_to_3_sources' ELSE 'full_4_to_5_sources' END")


def history_segment(count) -> object:
    return F.when(count <= 1, "thin_0_to_1_sources").when(count <= 3, "partial_2_to_3_sources").otherwise(
        "full_4_to_5_sources")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "predictions").withColumn(
        "history_segment", history_segment(F.col("history_source_count")))


def evaluation_ctes(p: str, source: str = "base", groups: str = "") -> str:
    """CTE ``metrics``: one row of metrics per group, by plain window functions over raw rows."""
    part = f"PARTITION BY {groups} " if groups else ""
    g = f"{groups}, " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""ranked AS (
  SELECT *, {p} AS p, rank() OVER ({part}ORDER BY {p}) AS lo_rank,
    count(*) OVER ({part + ',' if part else 'PARTITION BY '}{p}) AS ties,
    count(*) OVER ({part}ORDER BY {p} DESC) AS picked,
    sum(TARGET) OVER ({part}ORDER BY {p} DESC) AS caught
  FROM {source}),
metrics AS (
  SELECT {g}count(*) AS rows, sum(TARGET) AS events, avg(TARGET) AS base_rate, avg(p) AS mean_probability,
    avg((p - TARGET) * (p - TARGET)) AS brier_score,
    avg(TARGET) * (1 - avg(TARGET)) AS base_rate_brier_score,
    1 - avg((p - TARGET) * (p - TARGET)) / nullif(avg(TARGET) * (1 - avg(TARGET)), 0) AS brier_skill_score,
    avg(-CASE WHEN TARGET = 1 THEN ln(greatest(least(p, 1 - 1e-6), 1e-6))
              ELSE ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)) END) AS log_loss,
    coalesce(count(*) FILTER (p >= 0.5 AND TARGET = 1) / nullif(count(*) FILTER (p >= 0.5), 0)::DOUBLE, 0) AS precision_at_0_5,
    coalesce(count(*) FILTER (p >= 0.5 AND TARGET = 1) / nullif(count(*) FILTER (TARGET = 1), 0)::DOUBLE, 0) AS recall_at_0_5,
    (sum(lo_rank + (ties - 1) / 2.0) FILTER (TARGET = 1) - sum(TARGET) * (sum(TARGET) + 1) / 2.0)
      / nullif(sum(TARGET) * (count(*) - sum(TARGET)), 0)::DOUBLE AS roc_auc,
    sum(caught / picked::DOUBLE) FILTER (TARGET = 1) / nullif(sum(TARGET), 0)::DOUBLE AS average_precision
  FROM ranked {by})""".replace("PARTITION BY " + groups + " ,", f"PARTITION BY {groups}, ")


METRIC_KINDS = [("i", "rows"), ("i", "events")] + [("f", n) for n in (
    "base_rate", "mean_probability", "brier_score", "base_rate_brier_score", "brier_skill_score", "log_loss",
    "precision_at_0_5", "recall_at_0_5", "roc_auc", "average_precision")]
METRICS = Spec(tuple((k, n, n) for k, n in METRIC_KINDS))

BASE = f"base AS (SELECT *, {SEGMENT} AS history_segment FROM predictions)"


@register("probability_evaluation", with_roles(
    f"SELECT {METRICS.present()} FROM metrics", "predictions", ctes=f"{BASE},\n{evaluation_ctes(P)}"))
def probability_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.evaluate(predictions(spark, sf), P))


@register("evaluation_by_history_segment", with_roles(
    f"SELECT history_segment, {METRICS.present()} FROM metrics", "predictions",
    ctes=f"{BASE},\n{evaluation_ctes(P, groups='history_segment')}"))
def evaluation_by_history_segment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.evaluate(predictions(spark, sf), P, ["history_segment"]))


@register("evaluation_by_source_count", with_roles(
    f"""SELECT CAST(history_source_count AS BIGINT) AS history_source_count, {METRICS.present()},
      CASE WHEN rows >= 500 AND events >= 30 THEN 'evaluated' ELSE 'exploratory_low_sample' END AS status
    FROM metrics""", "predictions", ctes=f"{BASE},\n{evaluation_ctes(P, groups='history_source_count')}"))
def evaluation_by_source_count(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.evaluate(predictions(spark, sf), P, ["history_source_count"]).withColumn(
        "status", E.sample_status()))


@register("model_comparison_deltas", with_roles(
    """SELECT model, """ + ", ".join(f"{r6(n)} AS {n}, {r6(f'{n} - ref_{n}')} AS delta_{n}" for n in (
        "roc_auc", "average_precision", "brier_score", "log_loss")) + """
    FROM metrics, (SELECT roc_auc AS ref_roc_auc, average_precision AS ref_average_precision,
      brier_score AS ref_brier_score, log_loss AS ref_log_loss FROM metrics WHERE model = 'application')""",
    "predictions", ctes="""base AS (
      SELECT 'application' AS model, TARGET, application_probability AS score FROM predictions
      UNION ALL SELECT 'history', TARGET, history_probability FROM predictions),
    """ + evaluation_ctes("score", groups="model")))
def model_comparison_deltas(spark: SparkSession, sf: str) -> DataFrame:
    both = predictions(spark, sf).select("TARGET", F.explode(F.array(
        F.struct(F.lit("application").alias("model"), F.col("application_probability").alias("score")),
        F.struct(F.lit("history").alias("model"), F.col("history_probability").alias("score")),
    )).alias("m")).select("TARGET", "m.*")
    return rounded(E.metric_deltas(
        E.evaluate(both, "score", ["model"]), "application",
        ("roc_auc", "average_precision", "brier_score", "log_loss")))


@register("top_share_metrics", with_roles(
    f"""SELECT share, {r6('t')} AS probability_threshold, count(*) FILTER ({P} >= t) AS selected_rows,
      CAST(sum(TARGET) FILTER ({P} >= t) AS BIGINT) AS selected_events,
      {r6(f'count(*) FILTER ({P} >= t) / count(*)::DOUBLE')} AS population_share,
      {r6(f'avg(TARGET) FILTER ({P} >= t)')} AS selected_event_rate,
      {r6(f'avg(TARGET) FILTER ({P} >= t) / avg(TARGET)')} AS lift,
      {r6(f'sum(TARGET) FILTER ({P} >= t) / sum(TARGET)::DOUBLE')} AS event_capture_rate
    FROM predictions, (SELECT 0.1::DOUBLE AS share, quantile_cont({P}, 0.9) AS t FROM predictions
      UNION ALL SELECT 0.2::DOUBLE, quantile_cont({P}, 0.8) FROM predictions) GROUP BY share, t""", "predictions"))
def top_share_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.top_share_metrics(predictions(spark, sf), P))


_EDGES = f"""edges AS (
  SELECT list_sort(list_distinct(quantile_cont({P}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e FROM predictions),
binned AS (SELECT TARGET, {P} AS p, len(list_filter(e, lambda x: x < {P})) AS bin FROM predictions, edges),
bins AS (SELECT bin, count(*) AS rows, avg(p) AS mean_probability, avg(TARGET) AS observed_rate,
  abs(avg(TARGET) - avg(p)) AS absolute_error FROM binned GROUP BY bin)"""


@register("reliability_deciles", with_roles(
    f"""SELECT CAST(bin AS BIGINT) AS bin, rows, {r6('mean_probability')} AS mean_probability,
      {r6('observed_rate')} AS observed_rate, {r6('absolute_error')} AS absolute_error FROM bins""",
    "predictions", ctes=_EDGES))
def reliability_deciles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.reliability(predictions(spark, sf), P))


@register("expected_calibration_error", with_roles(
    f"SELECT {r6('sum(absolute_error * rows) / sum(rows)')} AS expected_calibration_error FROM bins",
    "predictions", ctes=_EDGES))
def expected_calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.expected_calibration_error(predictions(spark, sf), P))


def newton_ctes(groups: str = "", source: str = "base", p: str = P, steps: int = 12) -> str:
    """CTE ``line``: logistic intercept and slope by Newton steps in a recursive query."""
    g = f"{groups}, " if groups else ""
    on = f"USING ({groups})" if groups else "ON true"
    by = f"GROUP BY {g}i, a, b" if groups else "GROUP BY i, a, b"
    return f"""obs AS (SELECT {g}ln({p} / (1 - {p})) AS x, TARGET AS y FROM {source}),
line_steps AS (
  WITH RECURSIVE it AS (
    SELECT {g}0 AS i, ln(avg(y) / nullif(1 - avg(y), 0)) AS a, 0.0::DOUBLE AS b FROM obs {f'GROUP BY {groups}' if groups else ''}
    UNION ALL
    SELECT {g}i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
    FROM (
      SELECT {g}i, a, b, sum(y - q) AS g0, sum((y - q) * x) AS g1, sum(q * (1 - q)) AS h00,
        sum(q * (1 - q) * x) AS h01, sum(q * (1 - q) * x * x) AS h11
      FROM (SELECT {g}i, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS q FROM it JOIN obs {on} WHERE i < {steps}) {by}))
  SELECT * FROM it),
line AS (SELECT {g}a AS calibration_intercept, b AS calibration_slope FROM line_steps WHERE i = {steps})"""


@register("calibration_line", with_roles(
    f"SELECT {r6('calibration_intercept')} AS calibration_intercept, {r6('calibration_slope')} AS calibration_slope FROM line",
    "predictions", ctes=f"{BASE},\n{newton_ctes()}"))
def calibration_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.calibration_line(predictions(spark, sf), P))


@register("operating_points", with_roles(
    f"""SELECT f AS fraction, count(*) AS selected_rows, {r6('min(p)')} AS probability_threshold,
      CAST(sum(TARGET) AS BIGINT) AS true_positives, CAST(count(*) - sum(TARGET) AS BIGINT) AS false_positives,
      {r6('avg(TARGET)')} AS precision, {r6('sum(TARGET) / any_value(pos)::DOUBLE')} AS recall,
      {r6('avg(TARGET) / (any_value(pos) / any_value(n)::DOUBLE)')} AS lift_over_prevalence
    FROM (SELECT TARGET, {P} AS p, row_number() OVER (ORDER BY {P} DESC, SK_ID_CURR) AS r,
            count(*) OVER () AS n, sum(TARGET) OVER () AS pos FROM predictions)
    JOIN (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5]::DOUBLE[]) AS f) ON r <= ceil(n * f) GROUP BY f""",
    "predictions"))
def operating_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.operating_points(predictions(spark, sf), P, "SK_ID_CURR"))


_PR = f"""pr AS (
  SELECT DISTINCT {P} AS t, sum(TARGET) OVER (ORDER BY {P} DESC) / (count(*) OVER (ORDER BY {P} DESC))::DOUBLE AS precision,
    sum(TARGET) OVER (ORDER BY {P} DESC) / (sum(TARGET) OVER ())::DOUBLE AS recall FROM predictions)"""


@register("precision_recall_targets", with_roles(
    f"""SELECT kind, floor, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('t')} AS threshold FROM (
      SELECT *, row_number() OVER (PARTITION BY kind, floor ORDER BY goal DESC, t) AS r FROM (
        SELECT 'precision' AS kind, f AS floor, recall AS goal, * FROM pr, (SELECT unnest([0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS f) WHERE precision >= f
        UNION ALL SELECT 'recall', f, precision, * FROM pr, (SELECT unnest([0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS f) WHERE recall >= f
        UNION ALL SELECT 'maximum_f1', 0.0, 2 * precision * recall / greatest(precision + recall, 2.220446049250313e-16), *, 0.0 FROM pr
      )) WHERE r = 1""", "predictions", ctes=_PR))
def precision_recall_targets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.precision_recall_targets(predictions(spark, sf), P))


@register("segment_metrics", with_roles(
    f"""SELECT dimension, segment, CAST(rows AS BIGINT) AS rows, CAST(events AS BIGINT) AS events, {r6('base_rate')} AS prevalence,
      {r6('average_precision')} AS average_precision, {r6('roc_auc')} AS roc_auc, {r6('brier_score')} AS brier_score
    FROM metrics WHERE rows >= 100 AND events > 0 AND events < rows""", "predictions",
    ctes=f"""seg AS (SELECT *, CASE WHEN history_source_count <= 1 THEN 'thin_0_to_1' WHEN history_source_count <= 3
        THEN 'partial_2_to_3' ELSE 'full_4_to_5' END AS history_segment, -DAYS_BIRTH / 365.25 AS age FROM predictions),
    base AS (
      SELECT TARGET, {P}, 'history_segment' AS dimension, history_segment AS segment FROM seg
      UNION ALL SELECT TARGET, {P}, 'gender', CODE_GENDER FROM seg
      UNION ALL SELECT TARGET, {P}, 'age_band', CASE WHEN age <= 30 THEN 'under_30' WHEN age <= 40 THEN '30_to_39'
        WHEN age <= 50 THEN '40_to_49' WHEN age <= 60 THEN '50_to_59' ELSE '60_plus' END FROM seg),
    """ + evaluation_ctes(P, groups="dimension, segment")))
def segment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("history_source_count")
    rows = role(spark, sf, "predictions").withColumns({
        "history_segment": F.when(n <= 1, "thin_0_to_1").when(n <= 3, "partial_2_to_3").otherwise("full_4_to_5"),
        "gender": F.col("CODE_GENDER"),
        "age_band": right_closed_band(
            Q.age_years(F.col("DAYS_BIRTH")), Q.SEGMENT_AGE_EDGES, Q.SEGMENT_AGE_LABELS),
    })
    return rounded(E.segment_metrics(rows, P, ["history_segment", "gender", "age_band"]))


@register("acceptance_gates", with_roles(
    f"""SELECT {r6('roc_auc')} AS roc_auc, {r6('average_precision')} AS average_precision, {r6('brier_score')} AS brier_score,
      {r6('calibration_slope')} AS calibration_slope, {r6('average_precision / base_rate')} AS average_precision_multiple,
      roc_auc >= 0.75 AS roc_auc_at_least_0_75,
      average_precision / base_rate >= 2.5 AS average_precision_at_least_2_5x_prevalence,
      brier_score < base_rate * (1 - base_rate) AS brier_better_than_base_rate_predictor,
      calibration_slope BETWEEN 0.9 AND 1.1 AS calibration_slope_between_0_90_and_1_10,
      roc_auc >= 0.75 AND average_precision / base_rate >= 2.5 AND brier_score < base_rate * (1 - base_rate)
        AND calibration_slope BETWEEN 0.9 AND 1.1 AS all_passed
    FROM metrics, line""", "predictions", ctes=f"{BASE},\n{evaluation_ctes(P)},\n{newton_ctes()}"))
def acceptance_gates(spark: SparkSession, sf: str) -> DataFrame:
    report = E.acceptance_gates(E.full_report(predictions(spark, sf), P))
    return rounded(report.select(
        "roc_auc", "average_precision", "brier_score", "calibration_slope", "average_precision_multiple",
        "roc_auc_at_least_0_75", "average_precision_at_least_2_5x_prevalence",
        "brier_better_than_base_rate_predictor", "calibration_slope_between_0_90_and_1_10", "all_passed"))


# ---------------------------------------------------------------- fairness

def _audit_sql(p: str, tag: str = "") -> str:
    """CTE ``audit{tag}``: group metrics by gender and age band."""
    g = "dimension, grp"
    inner = evaluation_ctes(p, source=f"rows{tag}", groups=g).replace("ranked", f"ranked{tag}").replace(
        "metrics AS", f"metrics{tag} AS").replace("FROM ranked ", f"FROM ranked{tag} ")
    line = newton_ctes(g, source=f"rows{tag}", p=p).replace("obs", f"obs{tag}").replace("line", f"line{tag}").replace(
        f"line{tag}_steps", f"steps{tag}")

    def wilson(k: str, n: str, name: str) -> str:
        share = f"({k}) / nullif({n}, 0)::DOUBLE"
        scale = f"(1 + 3.8416 / nullif({n}, 0))"
        centre = f"(({share} + 3.8416 / (2.0 * nullif({n}, 0))) / {scale})"
        margin = (f"(1.96 * sqrt({share} * (1 - {share}) / nullif({n}, 0)::DOUBLE"
                  f" + 3.8416 / (4.0 * {n} * nullif({n}, 0))) / {scale})")
        return (f"CASE WHEN {n} > 0 THEN greatest(0, {centre} - {margin}) END AS {name}_low,"
                f" CASE WHEN {n} > 0 THEN least(1, {centre} + {margin}) END AS {name}_high")

    return f"""rows{tag} AS (
  SELECT TARGET, {p}, 'gender' AS dimension, CASE WHEN CODE_GENDER = 'XNA' THEN 'Unknown' ELSE CODE_GENDER END AS grp FROM predictions
  UNION ALL
  SELECT TARGET, {p}, 'age_band', CASE WHEN age <= 24 THEN '18-24' WHEN age <= 34 THEN '25-34' WHEN age <= 44 THEN '35-44'
    WHEN age <= 54 THEN '45-54' WHEN age <= 64 THEN '55-64' ELSE '65+' END
  FROM (SELECT *, -DAYS_BIRTH / 365.25 AS age FROM predictions)),
cut{tag} AS (SELECT quantile_cont({p}, 0.8) AS t FROM predictions),
{inner},
{line},
edges{tag} AS (SELECT {g}, list_sort(list_distinct(quantile_cont({p}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e
  FROM rows{tag} GROUP BY {g}),
ece{tag} AS (SELECT {g}, sum(err * n) / sum(n) AS expected_calibration_error FROM (
  SELECT {g}, bin, count(*) AS n, abs(avg(TARGET) - avg({p})) AS err FROM (
    SELECT {g}, TARGET, {p}, len(list_filter(e, lambda x: x < {p})) AS bin FROM rows{tag} JOIN edges{tag} USING ({g}))
  GROUP BY {g}, bin) GROUP BY {g}),
reviewed{tag} AS (SELECT {g}, count(*) FILTER ({p} >= t) AS review_rows, count(*) FILTER ({p} >= t AND TARGET = 1) AS tp,
  count(*) FILTER ({p} >= t AND TARGET = 0) AS fp FROM rows{tag}, cut{tag} GROUP BY {g}),
audit{tag} AS (
  SELECT *, rows >= 200 AND events >= 20 AND rows - events >= 20 AS eligible, base_rate AS event_rate,
    review_rows / rows::DOUBLE AS review_rate, tp / nullif(events, 0)::DOUBLE AS true_positive_rate_at_review_capacity,
    fp / nullif(rows - events, 0)::DOUBLE AS false_positive_rate_at_review_capacity,
    {wilson('events', 'rows', 'event_rate')}, {wilson('review_rows', 'rows', 'review_rate')},
    {wilson('tp', 'events', 'true_positive_rate')}, {wilson('fp', '(rows - events)', 'false_positive_rate')}
  FROM metrics{tag} JOIN reviewed{tag} USING ({g}) JOIN ece{tag} USING ({g}) LEFT JOIN line{tag} USING ({g}))"""


def _gaps_sql(tag: str = "") -> str:
    union = " UNION ALL ".join(
        f"SELECT dimension, grp, '{m}' AS metric, {m} AS v FROM audit{tag} WHERE eligible" for m in Q.GAP_METRICS)
    return f"""gaps{tag} AS (
  SELECT dimension, metric, first(grp ORDER BY v DESC, grp) AS maximum_group, max(v) AS maximum,
    first(grp ORDER BY v, grp) AS minimum_group, min(v) AS minimum, max(v) - min(v) AS absolute_gap
  FROM ({union}) WHERE v IS NOT NULL GROUP BY dimension, metric HAVING count(*) >= 2)"""


def _audit(spark: SparkSession, sf: str, p: str) -> DataFrame:
    rows = Q.audit_groups(role(spark, sf, "predictions"))
    return Q.group_audit(rows, p, ["gender", "age_band"])


_RATES = ["event_rate", "mean_probability", "review_rate", "true_positive_rate_at_review_capacity",
          "false_positive_rate_at_review_capacity"] + [
    f"{n}_{b}" for n in ("event_rate", "review_rate", "true_positive_rate", "false_positive_rate")
    for b in ("low", "high")]


@register("fairness_group_metrics", with_roles(
    f"""SELECT dimension, grp AS "group", CAST(rows AS BIGINT) AS rows, CAST(events AS BIGINT) AS events,
      CAST(rows - events AS BIGINT) AS non_events, CAST(review_rows AS BIGINT) AS review_rows,
      eligible AS eligible_for_comparison, {", ".join(f"{r6(n)} AS {n}" for n in _RATES)},
      {", ".join(f"CASE WHEN eligible THEN {r6(n)} END AS {n}" for n in Q.SUPPRESSIBLE)} FROM audit""",
    "predictions", ctes=_audit_sql(P)))
def fairness_group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_audit(spark, sf, P))


_GAP_COLUMNS = (f"dimension, metric, maximum_group, {r6('maximum')} AS maximum, minimum_group, {r6('minimum')} AS minimum,"
                f" {r6('absolute_gap')} AS absolute_gap")


@register("fairness_gaps", with_roles(
    f"SELECT {_GAP_COLUMNS} FROM gaps", "predictions", ctes=f"{_audit_sql(P)},\n{_gaps_sql()}"))
def fairness_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.comparison_gaps(_audit(spark, sf, P)))


_LIMITS = ", ".join(f"('{m}', {v}::DOUBLE)" for m, v in Q.ATTENTION.items())


@register("fairness_attention_items", with_roles(
    f"SELECT {_GAP_COLUMNS}, threshold FROM gaps JOIN (VALUES {_LIMITS}) AS l(metric, threshold) USING (metric)"
    " WHERE absolute_gap >= threshold", "predictions", ctes=f"{_audit_sql(P)},\n{_gaps_sql()}"))
def fairness_attention_items(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.attention_items(Q.comparison_gaps(_audit(spark, sf, P))))


@register("fairness_gap_changes", with_roles(
    f"""SELECT dimension, metric, {r6('b.absolute_gap')} AS earlier_gap, {r6('a.absolute_gap')} AS current_gap,
      {r6('a.absolute_gap - b.absolute_gap')} AS change,
      CASE WHEN a.absolute_gap > b.absolute_gap + 1e-9 THEN 'wider' WHEN a.absolute_gap < b.absolute_gap - 1e-9
        THEN 'narrower' ELSE 'unchanged' END AS direction
    FROM gaps_h a JOIN gaps_a b USING (dimension, metric)""", "predictions",
    ctes=f"{_audit_sql(P, '_h')},\n{_gaps_sql('_h')},\n{_audit_sql('application_probability', '_a')},\n{_gaps_sql('_a')}"))
def fairness_gap_changes(spark: SparkSession, sf: str) -> DataFrame:
    now = Q.comparison_gaps(_audit(spark, sf, P))
    return rounded(Q.gap_changes(now, Q.comparison_gaps(_audit(spark, sf, "application_probability"))))
