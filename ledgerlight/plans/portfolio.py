"""Portfolio screen and what-if scenarios over intake features.

``score`` adds a ``probability`` column to a feature table; any scorer of this package fits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import positive_ratio
from ..operators.application import term_ratios
from ..operators.intake import REF, expected_gaps, families_supplied
from ..operators.scoring import intake_route, score_profiles

Scorer = Callable[[DataFrame], DataFrame]
SWEEP = (0.50, 0.75, 1.00, 1.25, 1.50, 2.00)


def transparent_intake_score(features: DataFrame) -> DataFrame:
    """Transparent scorer over an intake feature row (unknown inputs take the scorer's neutral values)."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    mapped = features.withColumns({
        "requested_amount": F.col("AMT_CREDIT"),
        "annual_income": F.col("AMT_INCOME_TOTAL"),
        "annual_annuity": F.col("AMT_ANNUITY"),
        "employment_years": F.col("EMPLOYMENT_YEARS"),
        "existing_monthly_obligations": known("BUREAU_ANNUITY_SUM") / 120.0,
        "total_outstanding": known("BUREAU_DEBT_SUM") / 100.0,
        "credit_utilization": F.col("CC_UTILIZATION_MEAN"),
        "recent_inquiries": known("AMT_REQ_CREDIT_BUREAU_MON"),
        "delinquent_accounts": F.least(known("BUREAU_OVERDUE_CREDIT_COUNT"), F.lit(2.0)),
        "bureau_history_months": F.floor(F.col("BUREAU_DAYS_SINCE_CREDIT_MAX") / 30),
        "data_coverage": F.when(F.col("HAS_BUREAU_HISTORY") == 1, 0.9).otherwise(0.6),
    })
    return score_profiles(mapped).select(*features.columns, "probability")


def screen_portfolio(features: DataFrame, score: Scorer, count_gaps: bool = False) -> DataFrame:
    """Score every package; packages with violations stay in the queue as NOT SCORED.

    ``count_gaps`` lets gaps in expected fields move the route.
    """
    scorable = F.size("violations") == 0
    scored = score(families_supplied(features).where(scorable)).select(
        REF, "probability", F.col("TOTAL_OBLIGATION_TO_INCOME").alias("obligation_to_income"),
        F.col("source_families").alias("sources"),
        intake_route(F.col("source_families"), F.col("probability"), F.size(expected_gaps()) if count_gaps else F.lit(0)).alias("route"),
        F.array_join("findings", "; ").alias("note"))
    refused = features.where(~scorable).select(
        REF, F.lit(None).cast("double").alias("probability"), F.lit(None).cast("double").alias("obligation_to_income"),
        F.lit(None).cast("int").alias("sources"), F.lit("NOT SCORED").alias("route"),
        F.array_join("violations", "; ").alias("note"))
    return scored.unionByName(refused)


def with_terms(features: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """New declared terms, history untouched; every ratio that depends on them is recomputed."""
    income, external = F.col("AMT_INCOME_TOTAL"), F.col("BUREAU_ANNUITY_SUM")
    return features.withColumns(terms).withColumns({
        **term_ratios(),
        "EXTERNAL_DEBT_TO_INCOME": positive_ratio(F.col("BUREAU_DEBT_SUM"), income),
        "TOTAL_OBLIGATION_TO_INCOME": positive_ratio(
            F.when(external.isNotNull(), F.coalesce(F.col("AMT_ANNUITY"), F.lit(0.0)) + external), income),
    })


def request_sweep(features: DataFrame, score: Scorer, multipliers: tuple[float, ...] = SWEEP) -> DataFrame:
    """Credit, repayment and goods value scaled together, tenor constant; one row per applicant and step."""
    ready = families_supplied(features).where(F.size("violations") == 0)
    steps = ready.withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in multipliers])))
    swept = with_terms(steps, {
        c: F.col(c) * F.col("multiplier") for c in ("AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE")})
    return score(swept).select(
        REF, "multiplier", F.col("AMT_CREDIT").alias("requested_credit"), F.col("AMT_ANNUITY").alias("annual_repayment"),
        F.col("TOTAL_OBLIGATION_TO_INCOME").alias("obligation_to_income"), "probability",
        intake_route(F.col("source_families"), F.col("probability"), F.lit(0)).alias("route"))


def scenario(features: DataFrame, score: Scorer, terms: dict[str, Column]) -> DataFrame:
    """Baseline against one set of changed terms."""
    ready = families_supplied(features).where(F.size("violations") == 0)
    columns = [REF, "probability", F.col("TOTAL_OBLIGATION_TO_INCOME").alias("obligation"),
               intake_route(F.col("source_families"), F.col("probability"), F.lit(0)).alias("route")]
    before = score(ready).select(*columns)
    after = score(with_terms(ready, terms)).select(*columns)
    return before.alias("b").join(after.alias("a"), REF).select(
        REF, F.col("b.probability").alias("baseline_probability"), F.col("a.probability").alias("scenario_probability"),
        (F.col("a.probability") - F.col("b.probability")).alias("probability_change"),
        F.col("b.obligation").alias("baseline_obligation"), F.col("a.obligation").alias("scenario_obligation"),
        F.col("b.route").alias("baseline_route"), F.col("a.route").alias("scenario_route"),
        (F.col("b.route") != F.col("a.route")).alias("route_changed"))
