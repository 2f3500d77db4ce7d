"""Transparent scoring, policy, routing and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import credit_score, logit, risk_grade, rounded
from ..operators import scoring as S
from ..sources.roles import role, with_roles
from .common import r6, register

_RULES = ", ".join(f"CASE WHEN {test} THEN '{text}' END" for text, test in S.PROFILE_RULES)
CHECKED_CTE = f"checked AS (SELECT *, list_filter([{_RULES}], lambda x: x IS NOT NULL) AS violations FROM profiles)"


@register("profile_constraints", with_roles(
    "SELECT application_id, requested_amount, len(violations)::BIGINT AS broken_rules, array_to_string(violations, '; ') AS violations"
    " FROM checked WHERE len(violations) > 0", "profiles", ctes=CHECKED_CTE))
def profile_constraints(spark: SparkSession, sf: str) -> DataFrame:
    bad = S.check_profiles(role(spark, sf, "profiles")).where(F.size("violations") > 0)
    return rounded(bad.select("application_id", "requested_amount", F.size("violations").alias("broken_rules"),
                              F.array_join("violations", "; ").alias("violations")))


SCORED_CTE = f"""{CHECKED_CTE},
terms AS (SELECT *, [
    struct_pack(v := ((existing_monthly_obligations + annual_annuity / 12.0) / (annual_income / 12.0) - 0.30e0) * 3.2e0, i := 0, a := 'HC01', f := 'PF01'),
    struct_pack(v := (requested_amount / annual_income - 0.40e0) * 0.9e0, i := 1, a := 'HC06', f := 'PF06'),
    struct_pack(v := (total_outstanding / annual_income - 0.30e0) * 0.55e0, i := 2, a := 'HC07', f := 'PF07'),
    struct_pack(v := (coalesce(credit_utilization, 0.65e0) - 0.35e0) * 1.1e0, i := 3, a := 'HC03', f := 'PF03'),
    struct_pack(v := delinquent_accounts * 0.72e0, i := 4, a := 'HC02', f := NULL),
    struct_pack(v := greatest(recent_inquiries - 1, 0) * 0.18e0, i := 5, a := 'HC04', f := NULL),
    struct_pack(v := CASE WHEN employment_years IS NULL THEN 0.35e0 WHEN employment_years < 1 THEN 0.28e0
      ELSE -least(employment_years, 10.0e0) * 0.025e0 END, i := 6, a := 'HC08', f := 'PF08'),
    struct_pack(v := CASE WHEN coalesce(bureau_history_months, 0) = 0 THEN 0.35e0 WHEN bureau_history_months < 12 THEN 0.22e0
      WHEN bureau_history_months >= 60 THEN -0.14e0 ELSE -0.05e0 END, i := 7, a := 'HC05', f := 'PF05'),
    struct_pack(v := greatest(0.85e0 - data_coverage, 0.0e0) * 1.5e0, i := 8, a := 'HC09', f := 'PF09')] AS t
  FROM checked WHERE len(violations) = 0),
probabilities AS (SELECT *, greatest(0.005e0, least(0.80e0, 1 / (1 + exp(-(-3.0e0 + list_sum([x.v FOR x IN t])))))) AS probability FROM terms),
scored AS (SELECT *, CAST(greatest(300, least(850, round_even(600 + 20 * log2((1 - probability) / probability / 50), 0))) AS BIGINT) AS credit_score,
  CASE WHEN probability < 0.02 THEN 'A' WHEN probability < 0.05 THEN 'B' WHEN probability < 0.1 THEN 'C' WHEN probability < 0.2 THEN 'D' ELSE 'E' END AS risk_grade,
  array_to_string(list_slice([y.c FOR y IN list_sort([struct_pack(k := -x.v, i := x.i, c := x.a) FOR x IN t IF x.v >= 0.05e0])], 1, 3), ',') AS adverse,
  array_to_string(list_slice([y.c FOR y IN list_sort([struct_pack(k := x.v, i := x.i, c := x.f) FOR x IN t IF x.v <= -0.05e0 AND x.f IS NOT NULL])], 1, 3), ',') AS favorable
  FROM probabilities)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return S.score_profiles(S.valid_profiles(role(spark, sf, "profiles")))


@register("transparent_scores", with_roles(
    f"SELECT application_id, {r6('probability')} AS probability, credit_score, risk_grade, adverse, favorable FROM scored",
    "profiles", ctes=SCORED_CTE))
def transparent_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scored(spark, sf).select(
        "application_id", "probability", "credit_score", "risk_grade",
        F.array_join("adverse_reason_codes", ",").alias("adverse"),
        F.array_join("favorable_reason_codes", ",").alias("favorable")))


POLICY_CTE = f"""{SCORED_CTE},
dsr AS (SELECT *, (existing_monthly_obligations + annual_annuity / 12.0) / (annual_income / 12.0) AS debt_service_ratio,
  greatest(0.4e0 * (annual_income / 12.0) - existing_monthly_obligations, 0) * 12.0 * (requested_amount / annual_annuity) AS estimated_maximum_amount,
  least(abs(probability - 0.02), abs(probability - 0.05), abs(probability - 0.1), abs(probability - 0.2)) AS edge FROM scored),
decided AS (SELECT *, CASE WHEN debt_service_ratio <= 0.4 THEN 'PASS' ELSE 'FAIL' END AS affordability_status,
  CASE WHEN data_coverage < 0.7 OR coalesce(bureau_history_months, 0) < 12 THEN 'LOW'
    WHEN data_coverage >= 0.85 AND bureau_history_months >= 24 AND edge >= 0.01 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
  CASE WHEN data_coverage < 0.6 THEN 'MANUAL_REVIEW' WHEN risk_grade = 'E' THEN 'DECLINE_RECOMMENDATION'
    WHEN debt_service_ratio > 0.4 THEN 'REDUCE_AMOUNT' WHEN risk_grade IN ('A', 'B') THEN 'APPROVE' ELSE 'MANUAL_REVIEW' END AS recommendation,
  CASE WHEN data_coverage >= 0.85 AND coalesce(bureau_history_months, 0) >= 12 THEN 'FULL_FILE' ELSE 'THIN_FILE_DEMO' END AS scoring_path FROM dsr)"""


@register("policy_decisions", with_roles(
    f"""SELECT application_id, {r6('debt_service_ratio')} AS debt_service_ratio, {r6('estimated_maximum_amount')} AS estimated_maximum_amount,
      affordability_status, confidence, recommendation, scoring_path FROM decided""", "profiles", ctes=POLICY_CTE))
def policy_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.apply_policy(_scored(spark, sf)).select(
        "application_id", "debt_service_ratio", "estimated_maximum_amount", "affordability_status", "confidence",
        "recommendation", "scoring_path"))


def _texts_sql(codes: str) -> str:
    cases = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in S.REASONS.items())
    return f"CASE WHEN {codes} = '' THEN '' ELSE array_to_string(list_transform(string_split({codes}, ','), lambda x: x || ': ' || CASE x {cases} END), '; ') END"


@register("service_records", with_roles(
    f"""SELECT application_id, {r6('probability')} AS probability, credit_score, risk_grade, recommendation, confidence,
      {_texts_sql('adverse')} AS adverse_reasons, {_texts_sql('favorable')} AS favorable_reasons,
      CAST(confidence = 'LOW' AS BIGINT) + 1 AS decision_reasons, affordability_status, scoring_path
    FROM decided""", "profiles", ctes=POLICY_CTE))
def service_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every output record, its reasons with their texts."""
    def texts(side: str):
        return F.array_join(F.transform(f"risk.{side}", lambda x: F.concat(x["code"], F.lit(": "), x["description"])), "; ").alias(side)

    record = S.service_record(S.apply_policy(_scored(spark, sf)))
    return rounded(record.select(
        "application_id", F.col("risk.repayment_difficulty_probability").alias("probability"), "risk.credit_score", "risk.risk_grade",
        "decision.recommendation", "decision.confidence", texts("adverse_reasons"), texts("favorable_reasons"),
        F.size("decision.decision_reasons").alias("decision_reasons"), F.col("affordability.status").alias("affordability_status"),
        "data_quality.scoring_path"))


@register("score_scale", with_roles(
    f"""SELECT SK_ID_CURR, CAST(greatest(300, least(850, round_even(600 + 20 * log2((1 - history_probability) / history_probability / 50), 0))) AS BIGINT) AS credit_score,
      CASE WHEN history_probability < 0.02 THEN 'A' WHEN history_probability < 0.05 THEN 'B' WHEN history_probability < 0.1 THEN 'C'
        WHEN history_probability < 0.2 THEN 'D' ELSE 'E' END AS risk_grade, {r6('ln(history_probability / (1 - history_probability))')} AS log_odds
    FROM predictions""", "predictions"))
def score_scale(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("history_probability")
    return rounded(role(spark, sf, "predictions").select(
        "SK_ID_CURR", credit_score(p).alias("credit_score"), risk_grade(p).alias("risk_grade"),
        logit(p).alias("log_odds")))


_TERMS = """terms AS (SELECT SK_ID_CURR, history_probability AS probability, history_source_count AS available, AMT_INCOME_TOTAL AS annual_income,
  AMT_ANNUITY AS annual_annuity, AMT_CREDIT AS requested_credit FROM predictions JOIN application_train USING (SK_ID_CURR)),
screened AS (SELECT *, CASE WHEN annual_annuity / annual_income <= 0.4 THEN 'SCREEN_PASS' WHEN annual_annuity IS NOT NULL THEN 'SCREEN_REVIEW' END AS affordability_screen,
  annual_annuity / annual_income AS repayment_to_income, requested_credit * (0.4e0 * annual_income) / annual_annuity AS credit_at_maximum_ratio,
  CASE WHEN available <= 1 THEN 'thin_0_to_1_sources' WHEN available <= 3 THEN 'partial_2_to_3_sources' ELSE 'full_4_to_5_sources' END AS history_segment,
  least(abs(probability - 0.02), abs(probability - 0.05), abs(probability - 0.1), abs(probability - 0.2)) < 0.01 AS near FROM terms),
routed AS (SELECT *, CASE WHEN available < 4 THEN 'LOW' WHEN near THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
  CASE WHEN available < 4 THEN 'MANUAL_REVIEW_DATA_LIMITED' WHEN near THEN 'MANUAL_REVIEW_NEAR_RISK_BOUNDARY' ELSE 'STANDARD_REVIEW' END AS confidence_route,
  CASE WHEN available < 4 THEN 'DATA_LIMITED_REVIEW' WHEN probability >= 0.2 THEN 'HIGH_RISK_REVIEW'
    WHEN affordability_screen = 'SCREEN_REVIEW' THEN 'AFFORDABILITY_REVIEW' WHEN near THEN 'BOUNDARY_REVIEW' ELSE 'STANDARD_REVIEW' END AS review_route FROM screened)"""


def routed(spark: SparkSession, sf: str) -> DataFrame:
    terms = role(spark, sf, "predictions").select(
        "SK_ID_CURR", F.col("history_probability").alias("probability"),
        F.col("history_source_count").alias("available")).join(
        role(spark, sf, "application_train").select(
            "SK_ID_CURR", *[F.col(c).alias(n) for n, c in S.OVERRIDABLE.items()]), "SK_ID_CURR")
    out = S.confidence_route(S.affordability_context(terms), "probability", "available")
    return out.withColumn("review_route", S.review_route(
        F.col("probability"), F.col("confidence_route"), F.col("affordability_screen")))


@register("review_routes", with_roles(
    f"""SELECT SK_ID_CURR, history_segment, confidence, confidence_route, affordability_screen, {r6('repayment_to_income')} AS repayment_to_income,
      {r6('credit_at_maximum_ratio')} AS credit_at_maximum_ratio, review_route FROM routed""",
    "predictions", "application_train", ctes=_TERMS))
def review_routes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(routed(spark, sf).select(
        "SK_ID_CURR", "history_segment", "confidence", "confidence_route", "affordability_screen",
        "repayment_to_income", "credit_at_maximum_ratio", "review_route"))


@register("route_counts", with_roles(
    "SELECT review_route AS route, count(*) AS cases FROM routed GROUP BY 1", "predictions", "application_train", ctes=_TERMS))
def route_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.route_counts(routed(spark, sf).withColumnRenamed("review_route", "route"))


@register("sorted_head", with_roles(
    f"SELECT SK_ID_CURR, {r6('history_probability')} AS history_probability FROM predictions ORDER BY SK_ID_CURR LIMIT 100", "predictions"))
def sorted_head(spark: SparkSession, sf: str) -> DataFrame:
    """First n applications in id order (the batch scorer's limit option)."""
    return rounded(role(spark, sf, "predictions").select("SK_ID_CURR", "history_probability").orderBy("SK_ID_CURR").limit(100))


_CHECKED_OVERRIDES = """checked AS (SELECT *, CASE WHEN name NOT IN ('annual_income', 'requested_credit', 'annual_annuity', 'goods_price') THEN 'unsupported override'
  WHEN application_id <= 0 THEN 'application id must be a positive integer'
  WHEN value <= 0 OR value >= 1e9 THEN 'value must be positive and below 1,000,000,000' END AS rejection FROM overrides)"""


@register("override_rejections", with_roles(
    "SELECT rejection, name, count(*) AS overrides FROM checked GROUP BY ALL", "overrides", ctes=_CHECKED_OVERRIDES))
def override_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return S.check_overrides(role(spark, sf, "overrides")).groupBy("rejection", "name").agg(
        F.count(F.lit(1)).alias("overrides"))


_NEW = ", ".join(f"max_by(value, sequence) FILTER (name = '{n}') AS new_{n}" for n in S.OVERRIDABLE)


@register("term_overrides", with_roles(
    "SELECT SK_ID_CURR, " + ", ".join(
        f"{r6(c)} AS original_{n}, {r6(f'coalesce(new_{n}, {c})')} AS {c}" for n, c in S.OVERRIDABLE.items())
    + f" FROM application_train LEFT JOIN (SELECT application_id AS SK_ID_CURR, {_NEW} FROM checked WHERE rejection IS NULL"
    " AND value IS NOT NULL GROUP BY 1) USING (SK_ID_CURR)", "application_train", "overrides", ctes=_CHECKED_OVERRIDES))
def term_overrides(spark: SparkSession, sf: str) -> DataFrame:
    terms = role(spark, sf, "application_train").select("SK_ID_CURR", *S.OVERRIDABLE.values())
    return rounded(S.apply_overrides(terms, role(spark, sf, "overrides")))
