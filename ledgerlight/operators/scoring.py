"""Transparent applicant scorer: log-odds contributions, reasons, policy and review routes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import credit_score, floor_zero, risk_grade

INTERCEPT = -3.0
PROBABILITY_RANGE = (0.005, 0.80)
DEFAULT_UTILIZATION = 0.65
REASON_FLOOR = 0.05
TOP_REASONS = 3

# Reason texts.
REASONS = {
    "HC01": "High total repayment obligations relative to income",
    "HC02": "Historical accounts currently show delinquency",
    "HC03": "High revolving-credit utilization",
    "HC04": "Multiple recent credit inquiries",
    "HC05": "Limited usable credit history",
    "HC06": "Requested credit is high relative to annual income",
    "HC07": "Existing outstanding credit is high relative to annual income",
    "HC08": "Employment history is missing or short",
    "HC09": "Critical source coverage is incomplete",
    "PF01": "Repayment obligations are moderate relative to income",
    "PF03": "Revolving-credit utilization is low",
    "PF05": "Credit history is established",
    "PF06": "Requested credit is moderate relative to annual income",
    "PF07": "Existing outstanding credit is moderate relative to income",
    "PF08": "Employment history is established",
    "PF09": "Critical source coverage is strong",
}

# ---------------------------------------------------------------- profile constraints

PROFILE_RULES = (
    ("application_id must be a non-empty string", "coalesce(trim(application_id), '') = ''"),
    ("requested_amount must be greater than zero", "coalesce(requested_amount, 0) <= 0"),
    ("annual_income must be greater than zero", "coalesce(annual_income, 0) <= 0"),
    ("annual_annuity must be greater than zero", "coalesce(annual_annuity, 0) <= 0"),
    ("family_size must be at least one", "coalesce(family_size, 0) < 1"),
    ("employment_years cannot be negative", "employment_years < 0"),
    ("existing_monthly_obligations cannot be negative", "coalesce(existing_monthly_obligations, -1) < 0"),
    ("active_accounts cannot be negative", "coalesce(active_accounts, -1) < 0"),
    ("total_outstanding cannot be negative", "coalesce(total_outstanding, -1) < 0"),
    ("credit_utilization must be between 0 and 5", "credit_utilization NOT BETWEEN 0 AND 5"),
    ("recent_inquiries cannot be negative", "coalesce(recent_inquiries, -1) < 0"),
    ("delinquent_accounts cannot be negative", "coalesce(delinquent_accounts, -1) < 0"),
    ("bureau_history_months cannot be negative", "bureau_history_months < 0"),
    ("data_coverage must be between 0 and 1", "coalesce(data_coverage, -1) NOT BETWEEN 0 AND 1"),
)


def violations(rules) -> Column:
    """Texts of the broken rules, in declaration order."""
    return F.array_compact(F.array(*[F.when(F.expr(test), F.lit(text)) for text, test in rules]))


def check_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("violations", violations(PROFILE_RULES))


def valid_profiles(profiles: DataFrame) -> DataFrame:
    return check_profiles(profiles).where(F.size("violations") == 0).drop("violations")


# ---------------------------------------------------------------- score

def debt_service_ratio() -> Column:
    return (F.col("existing_monthly_obligations") + F.col("annual_annuity") / 12.0) / (F.col("annual_income") / 12.0)


def contributions() -> list[tuple[Column, str, str | None]]:
    """The nine (log-odds contribution, adverse code, favourable code) terms in order."""
    income = F.col("annual_income")
    usage = F.coalesce(F.col("credit_utilization"), F.lit(DEFAULT_UTILIZATION))
    years, months = F.col("employment_years"), F.col("bureau_history_months")
    employment = (F.when(years.isNull(), 0.35).when(years < 1, 0.28)
                  .otherwise(-F.least(years, F.lit(10.0)) * 0.025))
    depth = (F.when(months.isNull() | (months == 0), 0.35).when(months < 12, 0.22)
             .when(months >= 60, -0.14).otherwise(-0.05))
    return [
        ((debt_service_ratio() - 0.30) * 3.2, "HC01", "PF01"),
        ((F.col("requested_amount") / income - 0.40) * 0.9, "HC06", "PF06"),
        ((F.col("total_outstanding") / income - 0.30) * 0.55, "HC07", "PF07"),
        ((usage - 0.35) * 1.1, "HC03", "PF03"),
        (F.col("delinquent_accounts") * 0.72, "HC02", None),
        (floor_zero(F.col("recent_inquiries") - 1) * 0.18, "HC04", None),
        (employment, "HC08", "PF08"),
        (depth, "HC05", "PF05"),
        (F.greatest(F.lit(0.85) - F.col("data_coverage"), F.lit(0.0)) * 1.5, "HC09", "PF09"),
    ]


def _pick(terms: Column, keep, order, code: str) -> Column:
    """Codes of the kept terms, best first; equal values keep their declared order."""
    ranked = F.sort_array(F.transform(F.filter(terms, keep), lambda t: F.struct(
        order(t).alias("o"), t["position"].alias("p"), t[code].alias("code"))))
    return F.slice(F.transform(ranked, lambda t: t["code"]), 1, TOP_REASONS)


def score_profiles(profiles: DataFrame) -> DataFrame:
    """Probability, points, grade and reason codes of valid profiles."""
    parts = contributions()
    terms = F.array(*[
        F.struct(F.lit(i).alias("position"), value.cast("double").alias("value"), F.lit(adverse).alias("adverse"),
                 F.lit(favourable).cast("string").alias("favourable"))
        for i, (value, adverse, favourable) in enumerate(parts)])
    low, high = PROBABILITY_RANGE
    out = profiles.withColumn("terms", terms)
    odds = F.lit(INTERCEPT) + F.aggregate(
        F.transform("terms", lambda t: t["value"]), F.lit(0.0), lambda a, v: a + v)
    out = out.withColumn(
        "probability", F.greatest(F.lit(low), F.least(F.lit(high), 1.0 / (1.0 + F.exp(-odds)))))
    return out.withColumns({
        "credit_score": credit_score(F.col("probability")),
        "risk_grade": risk_grade(F.col("probability")),
        "adverse_reason_codes": _pick(
            F.col("terms"), lambda t: t["value"] >= REASON_FLOOR, lambda t: -t["value"], "adverse"),
        "favorable_reason_codes": _pick(
            F.col("terms"), lambda t: (t["value"] <= -REASON_FLOOR) & t["favourable"].isNotNull(),
            lambda t: t["value"], "favourable"),
    }).drop("terms")


def describe_reasons(codes: Column) -> Column:
    """Reason codes with their texts."""
    texts = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.transform(codes, lambda c: F.struct(c.alias("code"), F.element_at(texts, c).alias("description")))


# ---------------------------------------------------------------- policy

@dataclass(frozen=True)
class DecisionPolicy:
    maximum_debt_service_ratio: float = 0.40
    minimum_data_coverage: float = 0.60
    version: str = "demo-policy-1.0.0"


def _edge_distance(p: Column, edges=(0.02, 0.05, 0.10, 0.20)) -> Column:
    return F.least(*[F.abs(p - e) for e in edges])


def apply_policy(scored: DataFrame, policy: DecisionPolicy = DecisionPolicy()) -> DataFrame:
    """Affordability, recommendation and confidence of scored profiles."""
    limit = F.lit(policy.maximum_debt_service_ratio)
    monthly = F.col("annual_income") / 12.0
    dsr = debt_service_ratio()
    spare = F.greatest(limit * monthly - F.col("existing_monthly_obligations"), F.lit(0.0))
    maximum = spare * 12.0 * (F.col("requested_amount") / F.col("annual_annuity"))
    history, coverage = F.coalesce(F.col("bureau_history_months"), F.lit(0)), F.col("data_coverage")
    grade, affordable = F.col("risk_grade"), F.col("affordability_status") == "PASS"
    return scored.withColumns({
        "debt_service_ratio": dsr,
        "affordability_status": F.when(dsr <= limit, "PASS").otherwise("FAIL"),
        "estimated_maximum_amount": F.greatest(maximum, F.lit(0.0)),
        "confidence": F.when((coverage < 0.70) | (history < 12), "LOW").when(
            (coverage >= 0.85) & (history >= 24) & (_edge_distance(F.col("probability")) >= 0.01), "HIGH"
        ).otherwise("MEDIUM"),
    }).withColumns({
        "recommendation": F.when(coverage < policy.minimum_data_coverage, "MANUAL_REVIEW")
        .when(grade == "E", "DECLINE_RECOMMENDATION")
        .when(~affordable, "REDUCE_AMOUNT")
        .when(grade.isin("A", "B"), "APPROVE").otherwise("MANUAL_REVIEW"),
        "scoring_path": F.when((coverage >= 0.85) & (history >= 12), "FULL_FILE").otherwise("THIN_FILE_DEMO"),
        "decision_reasons": F.array_compact(F.array(
            F.when(coverage < policy.minimum_data_coverage, "Critical application or bureau data is incomplete")
            .when(grade == "E", "Estimated repayment risk exceeds the demo policy threshold")
            .when(~affordable, "Requested facility exceeds the configured affordability threshold")
            .when(grade.isin("A", "B"), "Risk and affordability checks pass the demo policy")
            .otherwise("Risk grade requires human review under the demo policy"),
            F.when(F.col("confidence") == "LOW",
                   "Confidence is low because history or source coverage is limited"))),
        "policy_version": F.lit(policy.version),
    })


def service_record(decided: DataFrame) -> DataFrame:
    """Nested output record with the published rounding (half-even)."""
    return decided.select(
        "application_id",
        F.struct(
            F.bround("probability", 6).alias("repayment_difficulty_probability"), "credit_score", "risk_grade",
            describe_reasons(F.col("adverse_reason_codes")).alias("adverse_reasons"),
            describe_reasons(F.col("favorable_reason_codes")).alias("favorable_reasons")).alias("risk"),
        F.struct("recommendation", "confidence", "decision_reasons").alias("decision"),
        F.struct(F.col("affordability_status").alias("status"),
                 F.bround("debt_service_ratio", 4).alias("debt_service_ratio"),
                 F.bround("estimated_maximum_amount", 2).alias("estimated_maximum_amount")).alias("affordability"),
        F.struct(F.col("data_coverage").alias("coverage"), "scoring_path").alias("data_quality"),
        "policy_version")


# ---------------------------------------------------------------- history confidence and routes

@dataclass(frozen=True)
class ConfidencePolicy:
    minimum_sources: int = 4
    boundary_distance: float = 0.01
    edges: tuple[float, ...] = (0.02, 0.05, 0.10, 0.20)


# Segment vocabularies (upper source counts included).
SCORING_SEGMENTS = ("thin_0_to_1_sources", "partial_2_to_3_sources", "full_4_to_5_sources")
CHALLENGER_SEGMENTS = ("thin_0_to_1", "partial_2_to_3", "full_4_to_5")


def history_segment(count: Column, labels: tuple[str, str, str] = SCORING_SEGMENTS) -> Column:
    return F.when(count <= 1, labels[0]).when(count <= 3, labels[1]).otherwise(labels[2])


def family_segment(count: Column, families: int) -> Column:
    """Segment by the model's own source families (intake models have three)."""
    return F.when(count <= 1, "thin (0-1 sources)").when(count < families, f"partial (2 of {families})").otherwise(
        f"full ({families} of {families})")


def confidence_route(df: DataFrame, probability: str, count: str,
                     policy: ConfidencePolicy = ConfidencePolicy()) -> DataFrame:
    """Confidence and data route from source coverage and distance to a grade edge."""
    thin = F.col(count) < policy.minimum_sources
    near = _edge_distance(F.col(probability), policy.edges) < policy.boundary_distance
    return df.withColumns({
        "history_segment": history_segment(F.col(count)),
        "confidence": F.when(thin, "LOW").when(near, "MEDIUM").otherwise("HIGH"),
        "confidence_route": F.when(thin, "MANUAL_REVIEW_DATA_LIMITED")
        .when(near, "MANUAL_REVIEW_NEAR_RISK_BOUNDARY").otherwise("STANDARD_REVIEW"),
    })


def affordability_context(df: DataFrame, maximum_ratio: float = 0.40) -> DataFrame:
    """Proposed repayment over income; rows with a non-positive or unknown term stay unscreened."""
    income, annuity, credit = (F.col(c) for c in ("annual_income", "annual_annuity", "requested_credit"))
    usable = (income > 0) & (annuity > 0) & (credit > 0)
    share = F.when(usable, annuity / F.nullif(income, F.lit(0)))
    return df.withColumns({
        "affordability_screen": F.when(share <= maximum_ratio, "SCREEN_PASS").when(
            share.isNotNull(), "SCREEN_REVIEW"),
        "repayment_to_income": share,
        "credit_at_maximum_ratio": F.when(usable, credit * (maximum_ratio * income) / F.nullif(annuity, F.lit(0))),
    })


def review_route(probability: Column, confidence: Column, screen: Column) -> Column:
    """Final queue: data-limited, then high risk, then affordability, then boundary, else standard."""
    return (
        F.when(confidence == "MANUAL_REVIEW_DATA_LIMITED", "DATA_LIMITED_REVIEW")
        .when(probability >= 0.20, "HIGH_RISK_REVIEW")
        .when(screen == "SCREEN_REVIEW", "AFFORDABILITY_REVIEW")
        .when(confidence == "MANUAL_REVIEW_NEAR_RISK_BOUNDARY", "BOUNDARY_REVIEW")
        .otherwise("STANDARD_REVIEW"))


ENHANCED_REVIEW_BOUNDARY = 0.114421


def intake_route(sources: Column, probability: Column, gaps: Column) -> Column:
    return (
        F.when((sources >= 3) & (gaps > 0), "DATA-LIMITED MANUAL REVIEW")
        .when(sources <= 2, "DATA-LIMITED MANUAL REVIEW")
        .when(probability >= ENHANCED_REVIEW_BOUNDARY, "ENHANCED MANUAL REVIEW")
        .otherwise("STANDARD MANUAL REVIEW"))


# ---------------------------------------------------------------- term overrides

# Terms a reviewer may change and the column each one replaces.
OVERRIDABLE = {
    "annual_income": "AMT_INCOME_TOTAL",
    "requested_credit": "AMT_CREDIT",
    "annual_annuity": "AMT_ANNUITY",
    "goods_price": "AMT_GOODS_PRICE",
}
OVERRIDE_LIMIT = 1_000_000_000.0


def check_overrides(overrides: DataFrame) -> DataFrame:
    """Why each ``(application_id, name, value)`` override is refused; NULL when it is usable."""
    value = F.col("value")
    return overrides.withColumn(
        "rejection",
        F.when(~F.coalesce(F.col("name").isin(*OVERRIDABLE), F.lit(False)), "unsupported override")
        .when(~F.coalesce(F.col("application_id") > 0, F.lit(False)), "application id must be a positive integer")
        .when(F.isnan(value) | (value <= 0.0) | (value >= OVERRIDE_LIMIT), "value must be positive and below 1,000,000,000"))


def apply_overrides(applications: DataFrame, overrides: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """Original and effective terms side by side; the last usable override of a term wins."""
    usable = check_overrides(overrides).where(F.col("rejection").isNull() & F.col("value").isNotNull())
    wide = usable.groupBy(F.col("application_id").alias(key)).agg(*[
        F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("sequence")))
        .alias(f"new_{n}") for n in OVERRIDABLE])
    joined = applications.join(wide, key, "left")
    return joined.withColumns({f"original_{n}": F.col(c) for n, c in OVERRIDABLE.items()}).withColumns(
        {c: F.coalesce(F.col(f"new_{n}"), F.col(c)) for n, c in OVERRIDABLE.items()}
    ).drop(*[f"new_{n}" for n in OVERRIDABLE])


def queue_order(df: DataFrame, probability: str = "probability", key: str = "applicant_ref") -> DataFrame:
    """Reviewer queue: highest probability first, unscored cases last."""
    return df.orderBy(F.col(probability).desc_nulls_last(), key)


def route_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("route").agg(F.count(F.lit(1)).alias("cases"))
