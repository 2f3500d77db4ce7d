"""Intake sheets: parsing, roll-ups, equality with the store, portfolio and scenarios.

The sheets come from the export job over all applications, so each query runs the export and the intake
path one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import intake as I
from ..operators.history import bureau_block, card_block, pos_block
from ..operators.quality import equality_check
from ..operators.scoring import queue_order
from ..plans import portfolio as W
from ..sources.roles import history_roles, role, with_roles
from .common import Spec, r6, register
from .history_queries import _BB_CTE, _BUREAU_CTE, BUREAU, CARD_REPORTED, POS
from .history_queries import _block_cte

CARD_SHEET = Spec.parse(CARD_REPORTED)
SHEET_ROLES = ("application_train", "bureau", "bureau_balance", "pos_cash_balance", "credit_card_balance")
REF_SQL = "concat('HC-', SK_ID_CURR::VARCHAR) AS applicant_ref"


def sheets(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return I.export_sheets(history_roles(spark, sf), role(spark, sf, "application_train"))


BUREAU_BLOCK = f"{_BB_CTE},\n{_BUREAU_CTE},\n"
_APPLICANTS = "SELECT SK_ID_CURR FROM application_train"


@register("intake_bureau_rollup", with_roles(
    f"SELECT {REF_SQL}, {BUREAU.present()} FROM bureau_rollup WHERE SK_ID_CURR IN ({_APPLICANTS})",
    "application_train", "bureau", "bureau_balance", ctes=f"{_BB_CTE},\n{_BUREAU_CTE}"))
def intake_bureau_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s = sheets(spark, sf)
    block = I.report_block(I.parse_tradelines(s["tradelines"]), I.parse_dpd(s["dpd_history"]))
    return _typed(rounded(block.drop("_unknown_status", "_orphans")), BUREAU)


def _typed(df: DataFrame, spec: Spec) -> DataFrame:
    """Counts that came from text cells back to bigint."""
    ints = {n for k, n, _ in spec.items if k == "i"}
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in ints else F.col(c) for c in df.columns])


@register("intake_revolving_rollup", with_roles(
    f"SELECT {REF_SQL}, {CARD_SHEET.present()} FROM card_rollup WHERE SK_ID_CURR IN ({_APPLICANTS})",
    "application_train", "credit_card_balance", ctes=_block_cte("card_rollup", "credit_card_balance", CARD_SHEET)))
def intake_revolving_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(rounded(I.revolving_block(sheets(spark, sf)["account_months"])), CARD_SHEET)


@register("intake_installment_rollup", with_roles(
    f"SELECT {REF_SQL}, {POS.present()} FROM pos_rollup WHERE SK_ID_CURR IN ({_APPLICANTS})",
    "application_train", "pos_cash_balance", ctes=_block_cte("pos_rollup", "pos_cash_balance", POS)))
def intake_installment_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(rounded(I.installment_account_block(sheets(spark, sf)["account_months"])), POS)


_BANDS = ", ".join(f"AMT_REQ_CREDIT_BUREAU_{b}" for b in I.ENQUIRY_BANDS)
_TOTAL = " + ".join(f"AMT_REQ_CREDIT_BUREAU_{b}" for b in I.ENQUIRY_BANDS)


@register("intake_enquiry_bands", with_roles(
    f"SELECT {REF_SQL}, {_BANDS}, ({_TOTAL})::BIGINT AS enquiry_count FROM application_train WHERE {_TOTAL} > 0",
    "application_train"))
def intake_enquiry_bands(spark: SparkSession, sf: str) -> DataFrame:
    return I.enquiry_block(sheets(spark, sf)["enquiries"]).drop("_beyond")


_STRIP = "substring('001C X-12 345-C0X0 1C2-3X0 01CX5', CAST(1 + o_orderkey % 8 AS INT), CAST(o_orderkey % 24 AS INT))"


@register("intake_strip_expansion", f"""SELECT account_ref, (i - 1)::BIGINT AS months_ago, substr(strip, i::INT, 1) AS status FROM (
    SELECT account_ref, strip, unnest(range(1, length(strip) + 1)) AS i FROM (
      SELECT o_orderkey::VARCHAR AS account_ref, trim({_STRIP}) AS strip FROM orders))
  WHERE substr(strip, i::INT, 1) NOT IN ('-', ' ')""")
def intake_strip_expansion(spark: SparkSession, sf: str) -> DataFrame:
    strips = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "'all' AS applicant_ref", "CAST(o_orderkey AS STRING) AS account_ref", f"{_STRIP} AS dpd_strip")
    return I.expand_strips(strips).select(
        "account_ref", F.col("months_ago").cast("bigint").alias("months_ago"), "status")


@register("intake_violations", with_roles(
    """SELECT 'missing required application field: annual_annuity' AS violation, count(*) AS applicants FROM application_train
       WHERE AMT_ANNUITY IS NULL HAVING count(*) > 0
       UNION ALL SELECT 'missing required application field: employment_years', count(*) FROM application_train
       WHERE DAYS_EMPLOYED = 365243 HAVING count(*) > 0""", "application_train"))
def intake_violations(spark: SparkSession, sf: str) -> DataFrame:
    parsed = I.parse_application(sheets(spark, sf)["application"])
    return parsed.select(F.explode("violations").alias("violation")).groupBy("violation").agg(
        F.count(F.lit(1)).alias("applicants"))


_EQUAL = {
    "bureau": [n for _, n, _ in BUREAU.items],
    "card": [n for _, n, _ in CARD_SHEET.items],
    "pos": [n for _, n, _ in POS.items],
}


@register("serving_equality", with_roles(
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", 0.0::DOUBLE AS max_difference, 0::BIGINT AS mismatches, count({n}) AS compared FROM {t}"
        f" WHERE SK_ID_CURR IN ({_APPLICANTS})"
        for t, key in (("bureau_rollup", "bureau"), ("card_rollup", "card"), ("pos_rollup", "pos")) for n in _EQUAL[key]),
    *SHEET_ROLES, ctes=",\n".join([
        _BB_CTE, _BUREAU_CTE, _block_cte("card_rollup", "credit_card_balance", CARD_SHEET),
        _block_cte("pos_rollup", "pos_cash_balance", POS)])))
def serving_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Stored features against the same applicants' intake features, column by column."""
    tables, s = history_roles(spark, sf), sheets(spark, sf)
    ids = tables["application_train"].select("SK_ID_CURR")
    paths = (
        (bureau_block(tables["bureau"], tables["bureau_balance"]),
         I.report_block(I.parse_tradelines(s["tradelines"]), I.parse_dpd(s["dpd_history"])), _EQUAL["bureau"]),
        (card_block(tables["credit_card_balance"]), I.revolving_block(s["account_months"]), _EQUAL["card"]),
        (pos_block(tables["pos_cash_balance"]), I.installment_account_block(s["account_months"]), _EQUAL["pos"]),
    )
    out = None
    for stored, served, names in paths:
        left = stored.join(ids, "SK_ID_CURR", "left_semi").withColumn(
            I.REF, F.concat(F.lit("HC-"), F.col("SK_ID_CURR").cast("string")))
        part = equality_check(left, served, I.REF, names)
        out = part if out is None else out.unionAll(part)
    return rounded(out)


# ---------------------------------------------------------------- packages

_RATIO = "CASE WHEN {d} > 0 THEN ({n}) / {d} END"
PACKAGE_CTE = f"""{_BB_CTE},
{_BUREAU_CTE},
{_block_cte("card_rollup", "credit_card_balance", CARD_SHEET)},
{_block_cte("pos_rollup", "pos_cash_balance", POS)},
package AS (
  SELECT {REF_SQL}, *, CAST(h.SK_ID_CURR IS NOT NULL AS INT) AS has_report, CAST(c.SK_ID_CURR IS NOT NULL AS INT) AS has_card,
    CAST(p.SK_ID_CURR IS NOT NULL AS INT) AS has_pos, -DAYS_EMPLOYED / 365.25::DOUBLE AS EMPLOYMENT_YEARS,
    AMT_ANNUITY IS NOT NULL AND DAYS_EMPLOYED <> 365243 AS scorable
  FROM application_train a LEFT JOIN bureau_rollup h ON h.SK_ID_CURR = a.SK_ID_CURR
  LEFT JOIN card_rollup c ON c.SK_ID_CURR = a.SK_ID_CURR LEFT JOIN pos_rollup p ON p.SK_ID_CURR = a.SK_ID_CURR)""".replace(
    "SELECT concat('HC-', SK_ID_CURR::VARCHAR)", "SELECT concat('HC-', a.SK_ID_CURR::VARCHAR)")


def packages(spark: SparkSession, sf: str) -> DataFrame:
    return I.build_features(sheets(spark, sf))


_ENGINEERED = {
    **{n: n for n in ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "OWN_CAR_AGE")},
    "CREDIT_TO_INCOME": _RATIO.format(n="AMT_CREDIT", d="AMT_INCOME_TOTAL"),
    "ANNUITY_TO_INCOME": _RATIO.format(n="AMT_ANNUITY", d="AMT_INCOME_TOTAL"),
    "CREDIT_TO_ANNUITY": _RATIO.format(n="AMT_CREDIT", d="AMT_ANNUITY"),
    "CREDIT_TO_GOODS": _RATIO.format(n="AMT_CREDIT", d="AMT_GOODS_PRICE"),
    "DOWN_PAYMENT_RATE": _RATIO.format(n="AMT_GOODS_PRICE - AMT_CREDIT", d="AMT_GOODS_PRICE"),
    "TOTAL_OBLIGATION_TO_INCOME":
        "CASE WHEN BUREAU_ANNUITY_SUM IS NOT NULL THEN (coalesce(AMT_ANNUITY, 0) + BUREAU_ANNUITY_SUM) / AMT_INCOME_TOTAL END",
    "EXTERNAL_DEBT_TO_INCOME": "BUREAU_DEBT_SUM / AMT_INCOME_TOTAL",
}
_SPECS = (BUREAU, CARD_SHEET, POS)
INTAKE_COLUMNS = [(k, n) for spec in _SPECS for k, n, _ in spec.items] + [("f", f"AMT_REQ_CREDIT_BUREAU_{b}") for b in I.ENQUIRY_BANDS]
_LEVELS = ("NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_HOUSING_TYPE")


@register("intake_features", with_roles(
    f"""SELECT applicant_ref, has_report::BIGINT AS HAS_BUREAU_HISTORY, has_card::BIGINT AS HAS_CREDIT_CARD_HISTORY,
      has_pos::BIGINT AS HAS_POS_HISTORY, {", ".join(f"{r6(e)} AS {n}" for n, e in _ENGINEERED.items())}, {", ".join(_LEVELS)},
      {", ".join(spec.present() for spec in _SPECS)},
      {", ".join(f"CASE WHEN {_TOTAL} > 0 THEN {r6(f'AMT_REQ_CREDIT_BUREAU_{b}')} END AS AMT_REQ_CREDIT_BUREAU_{b}" for b in I.ENQUIRY_BANDS)},
      coalesce({_TOTAL}, 0)::BIGINT AS enquiry_count, coalesce(BUREAU_CREDIT_COUNT, 0)::BIGINT AS tradeline_count,
      (coalesce(CC_MONTH_COUNT, 0) + coalesce(POS_MONTH_COUNT, 0))::BIGINT AS account_month_count,
      CASE WHEN scorable THEN 0 ELSE 1 END::BIGINT AS refused FROM package""",
    *SHEET_ROLES, ctes=PACKAGE_CTE))
def intake_features(spark: SparkSession, sf: str) -> DataFrame:
    """The whole feature row of every package."""
    whole = rounded(packages(spark, sf).select(
        I.REF, *I.FAMILIES, *_ENGINEERED, *_LEVELS, *[n for spec in _SPECS for _, n, _ in spec.items],
        *[f"AMT_REQ_CREDIT_BUREAU_{b}" for b in I.ENQUIRY_BANDS], "enquiry_count", "tradeline_count", "account_month_count",
        F.when(F.size("violations") > 0, 1).otherwise(0).alias("refused")))
    for spec in _SPECS:
        whole = _typed(whole, spec)
    return whole


_GAPS = """list_filter([CASE WHEN has_report = 0 THEN 'sheet.tradelines' END, CASE WHEN has_card = 0 AND has_pos = 0 THEN 'sheet.account_months' END,
  CASE WHEN has_report = 1 AND BUREAU_DAYS_SINCE_CREDIT_MEAN IS NULL THEN 'tradelines.opened_days_ago' END,
  CASE WHEN has_card = 1 AND CC_UTILIZATION_MEAN IS NULL THEN 'account_months.balance_and_limit' END,
  CASE WHEN AMT_GOODS_PRICE IS NULL THEN 'application.goods_price' END], lambda x: x IS NOT NULL)"""


@register("expected_field_gaps", with_roles(
    f"""SELECT applicant_ref, array_to_string({_GAPS}, ',') AS gaps,
      CASE WHEN has_report = 1 AND BUREAU_ANNUITY_SUM IS NULL THEN 'tradelines.annuity' ELSE '' END AS affordability_gaps,
      (has_report + has_card + has_pos)::BIGINT AS source_families FROM package""", *SHEET_ROLES, ctes=PACKAGE_CTE))
def expected_field_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.families_supplied(packages(spark, sf)).select(
        I.REF, F.array_join(I.expected_gaps(), ",").alias("gaps"),
        F.array_join(I.affordability_gaps(), ",").alias("affordability_gaps"), "source_families"))


@register("intake_alignment", with_roles(
    """SELECT applicant_ref, AMT_INCOME_TOTAL, AMT_GOODS_PRICE, OWN_CAR_AGE, NULL::DOUBLE AS EXT_SOURCE_1, 4::BIGINT AS features_supplied,
      (CAST(AMT_GOODS_PRICE IS NULL AS INT) + CAST(OWN_CAR_AGE IS NULL AS INT) + CAST(CC_BALANCE_MAX IS NULL AS INT) + 1)::BIGINT AS APPLICATION_MISSING_COUNT
    FROM package""", *SHEET_ROLES, ctes=PACKAGE_CTE))
def intake_alignment(spark: SparkSession, sf: str) -> DataFrame:
    selected = ("AMT_INCOME_TOTAL", "AMT_GOODS_PRICE", "OWN_CAR_AGE", "CC_BALANCE_MAX", "EXT_SOURCE_1",
                "APPLICATION_MISSING_COUNT")
    return rounded(I.align(packages(spark, sf), selected).drop("CC_BALANCE_MAX"))


def _probability_sql(m: str = "1.0e0") -> str:
    credit, annuity = f"(AMT_CREDIT * {m})", f"(AMT_ANNUITY * {m})"
    return f"""greatest(0.005e0, least(0.8e0, 1 / (1 + exp(-(-3.0e0
      + ((coalesce(BUREAU_ANNUITY_SUM, 0) / 120.0e0 + {annuity} / 12.0e0) / (AMT_INCOME_TOTAL / 12.0e0) - 0.3e0) * 3.2e0
      + ({credit} / AMT_INCOME_TOTAL - 0.4e0) * 0.9e0 + (coalesce(BUREAU_DEBT_SUM, 0) / 100.0e0 / AMT_INCOME_TOTAL - 0.3e0) * 0.55e0
      + (coalesce(CC_UTILIZATION_MEAN, 0.65e0) - 0.35e0) * 1.1e0 + least(coalesce(BUREAU_OVERDUE_CREDIT_COUNT, 0), 2) * 0.72e0
      + greatest((CASE WHEN enquiries > 0 THEN AMT_REQ_CREDIT_BUREAU_MON ELSE 0 END) - 1, 0) * 0.18e0
      + CASE WHEN EMPLOYMENT_YEARS < 1 THEN 0.28e0 ELSE -least(EMPLOYMENT_YEARS, 10) * 0.025e0 END
      + CASE WHEN coalesce(floor(BUREAU_DAYS_SINCE_CREDIT_MAX / 30.0), 0) = 0 THEN 0.35e0 WHEN BUREAU_DAYS_SINCE_CREDIT_MAX / 30.0 < 12 THEN 0.22e0
        WHEN floor(BUREAU_DAYS_SINCE_CREDIT_MAX / 30.0) >= 60 THEN -0.14e0 ELSE -0.05e0 END
      + CASE WHEN has_report = 1 THEN 0 ELSE 0.25e0 END * 1.5e0)))))"""


SCORED_CTE = f"""{PACKAGE_CTE},
counted AS (SELECT *, coalesce({_TOTAL}, 0) AS enquiries, has_report + has_card + has_pos AS families,
  len({_GAPS}) AS gap_count FROM package)"""


def _route_sql(p: str, gaps: str) -> str:
    return (f"CASE WHEN families >= 3 AND {gaps} > 0 THEN 'DATA-LIMITED MANUAL REVIEW' WHEN families <= 2 THEN 'DATA-LIMITED MANUAL REVIEW'"
            f" WHEN {p} >= 0.114421 THEN 'ENHANCED MANUAL REVIEW' ELSE 'STANDARD MANUAL REVIEW' END")


@register("portfolio_screen", with_roles(
    f"""SELECT applicant_ref, {r6('p')} AS probability,
      {r6('CASE WHEN scorable AND BUREAU_ANNUITY_SUM IS NOT NULL THEN (AMT_ANNUITY + BUREAU_ANNUITY_SUM) / AMT_INCOME_TOTAL END')} AS obligation_to_income,
      CASE WHEN scorable THEN families END::BIGINT AS sources,
      CASE WHEN scorable THEN {_route_sql('p', '0')} ELSE 'NOT SCORED' END AS route
    FROM (SELECT *, CASE WHEN scorable THEN {_probability_sql()} END AS p FROM counted)""", *SHEET_ROLES, ctes=SCORED_CTE))
def portfolio_screen(spark: SparkSession, sf: str) -> DataFrame:
    screened = W.screen_portfolio(packages(spark, sf), W.transparent_intake_score)
    return rounded(queue_order(screened).drop("note"))


@register("request_sweep", with_roles(
    f"""SELECT applicant_ref, m AS multiplier, {r6('AMT_CREDIT * m')} AS requested_credit, {r6('AMT_ANNUITY * m')} AS annual_repayment,
      {r6('CASE WHEN BUREAU_ANNUITY_SUM IS NOT NULL THEN (AMT_ANNUITY * m + BUREAU_ANNUITY_SUM) / AMT_INCOME_TOTAL END')} AS obligation_to_income,
      {r6('p')} AS probability, {_route_sql('p', '0')} AS route
    FROM (SELECT *, {_probability_sql('m')} AS p FROM counted, (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0]::DOUBLE[]) AS m) WHERE scorable)""",
    *SHEET_ROLES, ctes=SCORED_CTE))
def request_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.request_sweep(packages(spark, sf), W.transparent_intake_score))


@register("term_scenario", with_roles(
    f"""SELECT applicant_ref, {r6('b')} AS baseline_probability, {r6('a')} AS scenario_probability, {r6('a - b')} AS probability_change,
      {r6('(AMT_ANNUITY + BUREAU_ANNUITY_SUM) / AMT_INCOME_TOTAL')} AS baseline_obligation,
      {r6('(AMT_ANNUITY * 0.5e0 + BUREAU_ANNUITY_SUM) / AMT_INCOME_TOTAL')} AS scenario_obligation,
      {_route_sql('b', '0')} AS baseline_route, {_route_sql('a', '0')} AS scenario_route,
      {_route_sql('b', '0')} <> {_route_sql('a', '0')} AS route_changed
    FROM (SELECT *, {_probability_sql()} AS b, {_probability_sql('0.5e0')} AS a FROM counted WHERE scorable)""",
    *SHEET_ROLES, ctes=SCORED_CTE))
def term_scenario(spark: SparkSession, sf: str) -> DataFrame:
    terms = {c: F.col(c) * 0.5 for c in ("AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE")}
    return rounded(W.scenario(packages(spark, sf), W.transparent_intake_score, terms))


_FAULTS = """faulty AS (
  SELECT SK_ID_CURR, CASE WHEN SK_ID_CURR % 11 = 0 AND SK_ID_CURR IN (SELECT SK_ID_CURR FROM months)
      THEN 'account_months.account_kind must be revolving or installment' END AS kind,
    CASE WHEN SK_ID_CURR % 7 = 0 AND SK_ID_CURR IN (SELECT SK_ID_CURR FROM bureau WHERE DAYS_CREDIT IS NOT NULL)
      THEN 'expected a number in tradelines.opened_days_ago' END AS number,
    CASE WHEN SK_ID_CURR % 13 = 0 THEN 'missing required sheet: application' END AS sheet
  FROM application_train WHERE SK_ID_CURR % 13 <> 0 OR SK_ID_CURR IN (SELECT SK_ID_CURR FROM months)
    OR SK_ID_CURR IN (SELECT SK_ID_CURR FROM bureau) OR coalesce(greatest(%s), 0) >= 1)""".replace(
    "%s", ", ".join(f"AMT_REQ_CREDIT_BUREAU_{band}" for band in I.ENQUIRY_BANDS))


@register("intake_quarantine", with_roles(
    f"SELECT {REF_SQL}, concat_ws('; ', kind, number, sheet) AS reasons FROM faulty"
    " WHERE kind IS NOT NULL OR number IS NOT NULL OR sheet IS NOT NULL",
    "application_train", "bureau", "pos_cash_balance", "credit_card_balance",
    ctes=f"months AS (SELECT SK_ID_CURR FROM pos_cash_balance UNION SELECT SK_ID_CURR FROM credit_card_balance),\n{_FAULTS}"))
def intake_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """All packages, some of them with faults put in: unreadable numbers, months without a kind, no application sheet."""
    s = sheets(spark, sf)
    number = F.regexp_extract(I.REF, "([0-9]+)$", 1).cast("long")

    def faulty(every: int):
        return number % every == 0

    s["tradelines"] = s["tradelines"].withColumn("opened_days_ago", F.when(
        faulty(7), F.concat("opened_days_ago", F.lit("O"))).otherwise(F.col("opened_days_ago")))
    s["account_months"] = s["account_months"].withColumn("account_kind", F.when(~faulty(11), F.col("account_kind")))
    s["application"] = s["application"].where(~faulty(13))
    wanted = ("account_months.account_kind", "expected a number in tradelines", "missing required sheet")
    hits = F.array_sort(F.filter("violations", lambda v: v.rlike("^(" + "|".join(wanted) + ")")))
    return I.build_features(s).select(I.REF, F.array_join(hits, "; ").alias("reasons")).where("reasons <> ''")
