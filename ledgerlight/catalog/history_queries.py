"""Lifetime feature blocks and store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import history as H
from ..session import stage_folder
from ..sources.layout import read_layout, write_layout
from ..sources.roles import history_roles, role, with_roles
from .common import Spec, register

BALANCE = Spec.parse("""
i BB_MONTHS_OBSERVED = count(*)
i BB_OLDEST_MONTH = min(MONTHS_BALANCE)
i BB_LATEST_MONTH = max(MONTHS_BALANCE)
i BB_DELINQUENT_MONTHS = count(*) FILTER (STATUS BETWEEN '1' AND '5')
i BB_SEVERE_DELINQUENT_MONTHS = count(*) FILTER (STATUS BETWEEN '3' AND '5')
i BB_MAX_DELINQUENCY_LEVEL = max(coalesce(try_cast(STATUS AS INT), 0))
i BB_DEFAULT_MONTHS = count(*) FILTER (STATUS = '5')
i BB_CLOSED_MONTHS = count(*) FILTER (STATUS = 'C')
i BB_UNKNOWN_MONTHS = count(*) FILTER (STATUS = 'X')
i BB_RECENT_12M_DELINQUENT_MONTHS = count(*) FILTER (STATUS BETWEEN '1' AND '5' AND MONTHS_BALANCE >= -12)
""")

BUREAU = Spec.parse("""
i BUREAU_CREDIT_COUNT = count(*)
i BUREAU_UNIQUE_CREDIT_COUNT = count(DISTINCT SK_ID_BUREAU)
i BUREAU_CREDIT_TYPE_COUNT = count(DISTINCT CREDIT_TYPE)
i BUREAU_ACTIVE_COUNT = count(*) FILTER (CREDIT_ACTIVE = 'Active')
i BUREAU_CLOSED_COUNT = count(*) FILTER (CREDIT_ACTIVE = 'Closed')
i BUREAU_SOLD_COUNT = count(*) FILTER (CREDIT_ACTIVE = 'Sold')
i BUREAU_BAD_DEBT_COUNT = count(*) FILTER (CREDIT_ACTIVE = 'Bad debt')
i BUREAU_RECENT_12M_COUNT = count(*) FILTER (DAYS_CREDIT >= -365)
i BUREAU_RECENT_24M_COUNT = count(*) FILTER (DAYS_CREDIT >= -730)
f BUREAU_DAYS_SINCE_CREDIT_MEAN = avg(-DAYS_CREDIT)
i BUREAU_DAYS_SINCE_CREDIT_MIN = -max(DAYS_CREDIT)
i BUREAU_DAYS_SINCE_CREDIT_MAX = -min(DAYS_CREDIT)
f BUREAU_DAYS_OVERDUE_MEAN = avg(CREDIT_DAY_OVERDUE)
i BUREAU_DAYS_OVERDUE_MAX = max(CREDIT_DAY_OVERDUE)
i BUREAU_OVERDUE_CREDIT_COUNT = count(*) FILTER (CREDIT_DAY_OVERDUE > 0)
i BUREAU_PROLONG_SUM = sum(CNT_CREDIT_PROLONG)
i BUREAU_PROLONG_MAX = max(CNT_CREDIT_PROLONG)
f BUREAU_CREDIT_SUM = sum(AMT_CREDIT_SUM)
f BUREAU_CREDIT_MEAN = avg(AMT_CREDIT_SUM)
f BUREAU_CREDIT_MAX = max(AMT_CREDIT_SUM)
f BUREAU_DEBT_SUM = sum(AMT_CREDIT_SUM_DEBT)
f BUREAU_DEBT_MEAN = avg(AMT_CREDIT_SUM_DEBT)
f BUREAU_DEBT_MAX = max(AMT_CREDIT_SUM_DEBT)
f BUREAU_OVERDUE_SUM = sum(AMT_CREDIT_SUM_OVERDUE)
f BUREAU_OVERDUE_MAX = max(AMT_CREDIT_SUM_OVERDUE)
f BUREAU_LIMIT_SUM = sum(AMT_CREDIT_SUM_LIMIT)
f BUREAU_ANNUITY_SUM = sum(AMT_ANNUITY)
f BUREAU_DEBT_TO_CREDIT = sum(AMT_CREDIT_SUM_DEBT) / nullif(sum(AMT_CREDIT_SUM), 0)
f BUREAU_OVERDUE_TO_CREDIT = sum(AMT_CREDIT_SUM_OVERDUE) / nullif(sum(AMT_CREDIT_SUM), 0)
f BUREAU_ACTIVE_RATE = count(*) FILTER (CREDIT_ACTIVE = 'Active') / CAST(count(*) AS DOUBLE)
f BUREAU_OVERDUE_RATE = count(*) FILTER (CREDIT_DAY_OVERDUE > 0) / CAST(count(*) AS DOUBLE)
i BB_MONTHS_OBSERVED = sum(BB_MONTHS_OBSERVED)
i BB_DELINQUENT_MONTHS = sum(BB_DELINQUENT_MONTHS)
i BB_SEVERE_DELINQUENT_MONTHS = sum(BB_SEVERE_DELINQUENT_MONTHS)
i BB_MAX_DELINQUENCY_LEVEL = max(BB_MAX_DELINQUENCY_LEVEL)
i BB_DEFAULT_MONTHS = sum(BB_DEFAULT_MONTHS)
i BB_CLOSED_MONTHS = sum(BB_CLOSED_MONTHS)
i BB_UNKNOWN_MONTHS = sum(BB_UNKNOWN_MONTHS)
i BB_RECENT_12M_DELINQUENT_MONTHS = sum(BB_RECENT_12M_DELINQUENT_MONTHS)
f BB_DELINQUENT_MONTH_RATE = CAST(sum(BB_DELINQUENT_MONTHS) AS DOUBLE) / nullif(sum(BB_MONTHS_OBSERVED), 0)
f BB_SEVERE_DELINQUENT_MONTH_RATE = CAST(sum(BB_SEVERE_DELINQUENT_MONTHS) AS DOUBLE) / nullif(sum(BB_MONTHS_OBSERVED), 0)
""")

PREVIOUS = Spec.parse("""
i PREV_APPLICATION_COUNT = count(*)
i PREV_UNIQUE_APPLICATION_COUNT = count(DISTINCT SK_ID_PREV)
i PREV_APPROVED_COUNT = count(*) FILTER (NAME_CONTRACT_STATUS = 'Approved')
i PREV_REFUSED_COUNT = count(*) FILTER (NAME_CONTRACT_STATUS = 'Refused')
i PREV_CANCELED_COUNT = count(*) FILTER (NAME_CONTRACT_STATUS = 'Canceled')
i PREV_UNUSED_OFFER_COUNT = count(*) FILTER (NAME_CONTRACT_STATUS = 'Unused offer')
i PREV_RECENT_12M_COUNT = count(*) FILTER (DAYS_DECISION >= -365)
i PREV_RECENT_24M_COUNT = count(*) FILTER (DAYS_DECISION >= -730)
i PREV_DAYS_SINCE_DECISION_MIN = -max(DAYS_DECISION)
f PREV_DAYS_SINCE_DECISION_MEAN = avg(-DAYS_DECISION)
i PREV_DAYS_SINCE_DECISION_MAX = -min(DAYS_DECISION)
f PREV_APPLICATION_AMOUNT_MEAN = avg(AMT_APPLICATION)
f PREV_APPLICATION_AMOUNT_MAX = max(AMT_APPLICATION)
f PREV_CREDIT_SUM = sum(AMT_CREDIT)
f PREV_CREDIT_MEAN = avg(AMT_CREDIT)
f PREV_CREDIT_MAX = max(AMT_CREDIT)
f PREV_ANNUITY_MEAN = avg(AMT_ANNUITY)
f PREV_ANNUITY_MAX = max(AMT_ANNUITY)
f PREV_DOWN_PAYMENT_MEAN = avg(AMT_DOWN_PAYMENT)
f PREV_DOWN_PAYMENT_RATE_MEAN = avg(RATE_DOWN_PAYMENT)
f PREV_PAYMENT_COUNT_MEAN = avg(CNT_PAYMENT)
f PREV_PAYMENT_COUNT_MAX = max(CNT_PAYMENT)
f PREV_CREDIT_TO_APPLICATION_MEAN = avg(AMT_CREDIT / nullif(AMT_APPLICATION, 0))
f PREV_ANNUITY_TO_CREDIT_MEAN = avg(AMT_ANNUITY / nullif(AMT_CREDIT, 0))
i PREV_HIGH_YIELD_COUNT = count(*) FILTER (NAME_YIELD_GROUP = 'high')
i PREV_MIDDLE_YIELD_COUNT = count(*) FILTER (NAME_YIELD_GROUP = 'middle')
i PREV_CASH_LOAN_COUNT = count(*) FILTER (NAME_CONTRACT_TYPE = 'Cash loans')
i PREV_CONSUMER_LOAN_COUNT = count(*) FILTER (NAME_CONTRACT_TYPE = 'Consumer loans')
f PREV_APPROVAL_RATE = count(*) FILTER (NAME_CONTRACT_STATUS = 'Approved') / CAST(count(*) AS DOUBLE)
f PREV_REFUSAL_RATE = count(*) FILTER (NAME_CONTRACT_STATUS = 'Refused') / CAST(count(*) AS DOUBLE)
""")

POS = Spec.parse("""
i POS_MONTH_COUNT = count(*)
i POS_CONTRACT_COUNT = count(DISTINCT SK_ID_PREV)
i POS_OLDEST_MONTH = min(MONTHS_BALANCE)
i POS_LATEST_MONTH = max(MONTHS_BALANCE)
f POS_INSTALLMENT_COUNT_MEAN = avg(CNT_INSTALMENT)
f POS_INSTALLMENT_COUNT_MAX = max(CNT_INSTALMENT)
f POS_FUTURE_INSTALLMENTS_MEAN = avg(CNT_INSTALMENT_FUTURE)
f POS_FUTURE_INSTALLMENTS_MIN = min(CNT_INSTALMENT_FUTURE)
f POS_DPD_MEAN = avg(SK_DPD)
i POS_DPD_MAX = max(SK_DPD)
i POS_DPD_SUM = sum(SK_DPD)
f POS_DPD_DEF_MEAN = avg(SK_DPD_DEF)
i POS_DPD_DEF_MAX = max(SK_DPD_DEF)
i POS_DPD_MONTH_COUNT = count(*) FILTER (SK_DPD > 0)
i POS_DPD_DEF_MONTH_COUNT = count(*) FILTER (SK_DPD_DEF > 0)
i POS_RECENT_12M_DPD_COUNT = count(*) FILTER (SK_DPD > 0 AND MONTHS_BALANCE >= -12)
i POS_ACTIVE_MONTH_COUNT = count(*) FILTER (NAME_CONTRACT_STATUS = 'Active')
i POS_COMPLETED_MONTH_COUNT = count(*) FILTER (NAME_CONTRACT_STATUS = 'Completed')
f POS_DPD_MONTH_RATE = count(*) FILTER (SK_DPD > 0) / CAST(count(*) AS DOUBLE)
f POS_DPD_DEF_MONTH_RATE = count(*) FILTER (SK_DPD_DEF > 0) / CAST(count(*) AS DOUBLE)
""")

CARD_REPORTED = """
i CC_MONTH_COUNT = count(*)
i CC_CONTRACT_COUNT = count(DISTINCT SK_ID_PREV)
i CC_OLDEST_MONTH = min(MONTHS_BALANCE)
i CC_LATEST_MONTH = max(MONTHS_BALANCE)
f CC_BALANCE_MEAN = avg(AMT_BALANCE)
f CC_BALANCE_MAX = max(AMT_BALANCE)
f CC_BALANCE_SUM = sum(AMT_BALANCE)
f CC_LIMIT_MEAN = avg(AMT_CREDIT_LIMIT_ACTUAL)
f CC_LIMIT_MAX = max(AMT_CREDIT_LIMIT_ACTUAL)
f CC_UTILIZATION_MEAN = avg(AMT_BALANCE / nullif(AMT_CREDIT_LIMIT_ACTUAL, 0))
f CC_UTILIZATION_MAX = max(AMT_BALANCE / nullif(AMT_CREDIT_LIMIT_ACTUAL, 0))
f CC_DPD_MEAN = avg(SK_DPD)
i CC_DPD_MAX = max(SK_DPD)
i CC_DPD_MONTH_COUNT = count(*) FILTER (SK_DPD > 0)
i CC_DPD_DEF_MONTH_COUNT = count(*) FILTER (SK_DPD_DEF > 0)
i CC_RECENT_12M_DPD_COUNT = count(*) FILTER (SK_DPD > 0 AND MONTHS_BALANCE >= -12)
i CC_ACTIVE_MONTH_COUNT = count(*) FILTER (NAME_CONTRACT_STATUS = 'Active')
f CC_DPD_MONTH_RATE = count(*) FILTER (SK_DPD > 0) / CAST(count(*) AS DOUBLE)
f CC_DPD_DEF_MONTH_RATE = count(*) FILTER (SK_DPD_DEF > 0) / CAST(count(*) AS DOUBLE)
"""
CARD = Spec.parse(CARD_REPORTED + """
f CC_DRAWINGS_MEAN = avg(AMT_DRAWINGS_CURRENT)
f CC_DRAWINGS_SUM = sum(AMT_DRAWINGS_CURRENT)
f CC_ATM_DRAWINGS_SUM = sum(AMT_DRAWINGS_ATM_CURRENT)
f CC_POS_DRAWINGS_SUM = sum(AMT_DRAWINGS_POS_CURRENT)
f CC_PAYMENT_CURRENT_SUM = sum(AMT_PAYMENT_CURRENT)
f CC_PAYMENT_TOTAL_SUM = sum(AMT_PAYMENT_TOTAL_CURRENT)
f CC_PAYMENT_TO_MINIMUM_MEAN = avg(AMT_PAYMENT_TOTAL_CURRENT / nullif(AMT_INST_MIN_REGULARITY, 0))
f CC_RECEIVABLE_MEAN = avg(AMT_TOTAL_RECEIVABLE)
f CC_RECEIVABLE_MAX = max(AMT_TOTAL_RECEIVABLE)
i CC_DRAWING_COUNT_SUM = sum(CNT_DRAWINGS_CURRENT)
i CC_ATM_DRAWING_COUNT_SUM = sum(CNT_DRAWINGS_ATM_CURRENT)
i CC_POS_DRAWING_COUNT_SUM = sum(CNT_DRAWINGS_POS_CURRENT)
""")

INSTALLMENT = Spec.parse("""
i INST_PAYMENT_COUNT = count(*)
i INST_CONTRACT_COUNT = count(DISTINCT SK_ID_PREV)
i INST_UNIQUE_NUMBER_COUNT = count(DISTINCT NUM_INSTALMENT_NUMBER)
f INST_VERSION_MEAN = avg(NUM_INSTALMENT_VERSION)
f INST_DUE_SUM = sum(AMT_INSTALMENT)
f INST_PAID_SUM = sum(AMT_PAYMENT)
f INST_DUE_MEAN = avg(AMT_INSTALMENT)
f INST_PAID_MEAN = avg(AMT_PAYMENT)
f INST_PAYMENT_RATIO = sum(AMT_PAYMENT) / nullif(sum(AMT_INSTALMENT), 0)
f INST_LATE_DAYS_MEAN = avg(coalesce(greatest(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0), 0))
i INST_LATE_DAYS_MAX = max(coalesce(greatest(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0), 0))
i INST_LATE_DAYS_SUM = sum(coalesce(greatest(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0), 0))
f INST_SHORTFALL_MEAN = avg(coalesce(greatest(AMT_INSTALMENT - AMT_PAYMENT, 0), 0))
f INST_SHORTFALL_MAX = max(coalesce(greatest(AMT_INSTALMENT - AMT_PAYMENT, 0), 0))
f INST_SHORTFALL_SUM = sum(coalesce(greatest(AMT_INSTALMENT - AMT_PAYMENT, 0), 0))
i INST_LATE_PAYMENT_COUNT = count(*) FILTER (DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT)
i INST_SHORT_PAYMENT_COUNT = count(*) FILTER (AMT_PAYMENT < AMT_INSTALMENT)
i INST_RECENT_12M_LATE_COUNT = count(*) FILTER (DAYS_INSTALMENT >= -365 AND DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT)
i INST_RECENT_24M_LATE_COUNT = count(*) FILTER (DAYS_INSTALMENT >= -730 AND DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT)
f INST_LATE_PAYMENT_RATE = count(*) FILTER (DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT) / CAST(count(*) AS DOUBLE)
f INST_SHORT_PAYMENT_RATE = count(*) FILTER (AMT_PAYMENT < AMT_INSTALMENT) / CAST(count(*) AS DOUBLE)
i INST_DAYS_SINCE_DUE_MIN = -max(DAYS_INSTALMENT)
i INST_DAYS_SINCE_DUE_MAX = -min(DAYS_INSTALMENT)
""")

_BB_CTE = f"""balance_rollup AS (
  SELECT SK_ID_BUREAU, {BALANCE.select()} FROM bureau_balance GROUP BY SK_ID_BUREAU)"""
_BUREAU_CTE = f"""bureau_rollup AS (
  SELECT SK_ID_CURR, {BUREAU.select()}
  FROM bureau LEFT JOIN balance_rollup USING (SK_ID_BUREAU) GROUP BY SK_ID_CURR)"""


def _block_cte(name: str, source: str, spec: Spec) -> str:
    return f"{name} AS (\n  SELECT SK_ID_CURR, {spec.select()} FROM {source} GROUP BY SK_ID_CURR)"


SPINE_CTE = """spine AS (
  SELECT SK_ID_CURR FROM application_train UNION SELECT SK_ID_CURR FROM application_test)"""

BLOCKS = (
    ("HAS_BUREAU_HISTORY", "bureau_rollup", BUREAU),
    ("HAS_PREVIOUS_APPLICATION", "previous_rollup", PREVIOUS),
    ("HAS_POS_HISTORY", "pos_rollup", POS),
    ("HAS_CREDIT_CARD_HISTORY", "card_rollup", CARD),
    ("HAS_INSTALLMENT_HISTORY", "installment_rollup", INSTALLMENT),
)
BLOCK_CTES = ",\n".join([
    SPINE_CTE, _BB_CTE, _BUREAU_CTE,
    _block_cte("previous_rollup", "previous_application", PREVIOUS),
    _block_cte("pos_rollup", "pos_cash_balance", POS),
    _block_cte("card_rollup", "credit_card_balance", CARD),
    _block_cte("installment_rollup", "installments_payments", INSTALLMENT),
])
ALL_ROLES = (
    "application_train", "application_test", "bureau", "bureau_balance", "previous_application",
    "pos_cash_balance", "credit_card_balance", "installments_payments",
)


def _store_sql(select_block) -> str:
    flags = ",\n    ".join(f"CAST({b}.SK_ID_CURR IS NOT NULL AS INT) AS {flag}" for flag, b, _ in BLOCKS)
    body = ",\n    ".join(select_block(b, spec) for _, b, spec in BLOCKS)
    joins = "\n  ".join(f"LEFT JOIN {b} ON {b}.SK_ID_CURR = spine.SK_ID_CURR" for _, b, _ in BLOCKS)
    return f"SELECT spine.SK_ID_CURR,\n    {flags},\n    {body}\n  FROM spine\n  {joins}"


# The raw store for queries that build on it, and the rounded one that is compared.
STORE_CTE = f"""{BLOCK_CTES},
lifetime_store AS (
  {_store_sql(lambda b, spec: ", ".join(f"{b}.{n}" for _, n, _ in spec.items))})"""


def _rounded_store() -> str:
    flags = ",\n    ".join(
        f"CAST({b}.SK_ID_CURR IS NOT NULL AS BIGINT) AS {flag}" for flag, b, _ in BLOCKS)
    body = ",\n    ".join(spec.present(f"{b}.") for _, b, spec in BLOCKS)
    joins = "\n  ".join(f"LEFT JOIN {b} ON {b}.SK_ID_CURR = spine.SK_ID_CURR" for _, b, _ in BLOCKS)
    return f"SELECT spine.SK_ID_CURR,\n    {flags},\n    {body}\n  FROM spine\n  {joins}"


def _simple(name: str, source: str, spec: Spec, build) -> None:
    sql = with_roles(
        f"SELECT SK_ID_CURR, {spec.present()} FROM block", source, ctes=_block_cte("block", source, spec))

    @register(name, sql)
    def job(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(build(role(spark, sf, source)))


@register("id_spine", with_roles(
    "SELECT SK_ID_CURR FROM spine", "application_train", "application_test", ctes=SPINE_CTE))
def id_spine(spark: SparkSession, sf: str) -> DataFrame:
    return H.id_spine(role(spark, sf, "application_train"), role(spark, sf, "application_test"))


@register("bureau_balance_by_account", with_roles(
    f"SELECT SK_ID_BUREAU, {BALANCE.present()} FROM balance_rollup", "bureau_balance", ctes=_BB_CTE))
def bureau_balance_by_account(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.balance_by_account(role(spark, sf, "bureau_balance")))


@register("bureau_features", with_roles(
    f"SELECT SK_ID_CURR, {BUREAU.present()} FROM bureau_rollup", "bureau", "bureau_balance",
    ctes=f"{_BB_CTE},\n{_BUREAU_CTE}"))
def bureau_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.bureau_block(role(spark, sf, "bureau"), role(spark, sf, "bureau_balance")))


_simple("previous_application_features", "previous_application", PREVIOUS, H.previous_block)
_simple("pos_features", "pos_cash_balance", POS, H.pos_block)
_simple("credit_card_features", "credit_card_balance", CARD, H.card_block)
_simple("installment_features", "installments_payments", INSTALLMENT, H.installment_block)


@register("lifetime_feature_store", with_roles(_rounded_store(), *ALL_ROLES, ctes=BLOCK_CTES))
def lifetime_feature_store(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(H.lifetime_features(history_roles(spark, sf)))


@register("bucketed_lifetime_store", with_roles(_rounded_store(), *ALL_ROLES, ctes=BLOCK_CTES))
def bucketed_lifetime_store(spark: SparkSession, sf: str) -> DataFrame:
    """The same store over sources that are kept in buckets."""
    name = f"layout_{uuid.uuid4().hex}"
    write_layout(spark, history_roles(spark, sf), name, f"{stage_folder(spark)}/{name}", buckets=8)
    return rounded(H.lifetime_features(read_layout(spark, name, list(ALL_ROLES))))


@register("source_availability", with_roles(
    """SELECT CAST(HAS_BUREAU_HISTORY + HAS_PREVIOUS_APPLICATION + HAS_POS_HISTORY + HAS_CREDIT_CARD_HISTORY
         + HAS_INSTALLMENT_HISTORY AS BIGINT) AS source_count, count(*) AS applications
       FROM lifetime_store GROUP BY 1""", *ALL_ROLES, ctes=STORE_CTE))
def source_availability(spark: SparkSession, sf: str) -> DataFrame:
    store = H.lifetime_features(history_roles(spark, sf))
    return rounded(store.groupBy(H.source_count().alias("source_count")).agg(
        F.count(F.lit(1)).alias("applications")))
