"""Lifetime history features: five source blocks rolled up to one row per applicant.

Each block is ``raw table -> groupBy(SK_ID_CURR).agg``.  Partial aggregation before the shuffle keeps a
very large applicant from overloading a task, and distinct counts are planned by Catalyst as a two-step
aggregate keyed on the value as well.  Nothing is joined at raw grain except account <- account-months,
which is aggregated to the account first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import count_where, flag, floor_zero, ratio, share_where

KEY = "SK_ID_CURR"
DELINQUENT = ("1", "2", "3", "4", "5")
SEVERE = ("3", "4", "5")
HISTORY_FLAGS = (
    "HAS_BUREAU_HISTORY",
    "HAS_PREVIOUS_APPLICATION",
    "HAS_POS_HISTORY",
    "HAS_CREDIT_CARD_HISTORY",
    "HAS_INSTALLMENT_HISTORY",
)


def aggregate(df: DataFrame, keys: list[str], features: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in features.items()])


def id_spine(train: DataFrame, test: DataFrame, key: str = KEY) -> DataFrame:
    return train.select(key).union(test.select(key)).distinct()


def account_month_features() -> dict[str, Column]:
    status, month = F.col("STATUS"), F.col("MONTHS_BALANCE")
    late = status.isin(*DELINQUENT)
    # The pattern keeps letters away from the cast: a failing cast costs far more than the match.
    level = F.coalesce(F.when(status.rlike(r"^\s*[+-]?\d+\s*$"), status.try_cast("int")), F.lit(0))
    return {
        "BB_MONTHS_OBSERVED": F.count(F.lit(1)),
        "BB_OLDEST_MONTH": F.min(month),
        "BB_LATEST_MONTH": F.max(month),
        "BB_DELINQUENT_MONTHS": count_where(late),
        "BB_SEVERE_DELINQUENT_MONTHS": count_where(status.isin(*SEVERE)),
        "BB_MAX_DELINQUENCY_LEVEL": F.max(level),
        "BB_DEFAULT_MONTHS": count_where(status == "5"),
        "BB_CLOSED_MONTHS": count_where(status == "C"),
        "BB_UNKNOWN_MONTHS": count_where(status == "X"),
        "BB_RECENT_12M_DELINQUENT_MONTHS": count_where((month >= -12) & late),
    }


def balance_by_account(balance: DataFrame, key: str = "SK_ID_BUREAU") -> DataFrame:
    """Monthly status rows -> one row per external account."""
    return aggregate(balance, [key], account_month_features())


def bureau_account_features() -> dict[str, Column]:
    age = -F.col("DAYS_CREDIT")
    overdue_days = F.col("CREDIT_DAY_OVERDUE")
    credit, debt, overdue = (F.col(f"AMT_CREDIT_SUM{s}") for s in ("", "_DEBT", "_OVERDUE"))
    state = {"ACTIVE": "Active", "CLOSED": "Closed", "SOLD": "Sold", "BAD_DEBT": "Bad debt"}
    out = {
        "BUREAU_CREDIT_COUNT": F.count(F.lit(1)),
        "BUREAU_UNIQUE_CREDIT_COUNT": F.countDistinct("SK_ID_BUREAU"),
        "BUREAU_CREDIT_TYPE_COUNT": F.countDistinct("CREDIT_TYPE"),
    }
    for name, value in state.items():
        out[f"BUREAU_{name}_COUNT"] = count_where(F.col("CREDIT_ACTIVE") == value)
    for label, days in (("12M", 365), ("24M", 730)):
        out[f"BUREAU_RECENT_{label}_COUNT"] = count_where(F.col("DAYS_CREDIT") >= -days)
    for stat, fn in (("MEAN", F.avg), ("MIN", F.min), ("MAX", F.max)):
        out[f"BUREAU_DAYS_SINCE_CREDIT_{stat}"] = fn(age)
    out |= {
        "BUREAU_DAYS_OVERDUE_MEAN": F.avg(overdue_days),
        "BUREAU_DAYS_OVERDUE_MAX": F.max(overdue_days),
        "BUREAU_OVERDUE_CREDIT_COUNT": count_where(overdue_days > 0),
        "BUREAU_PROLONG_SUM": F.sum("CNT_CREDIT_PROLONG"),
        "BUREAU_PROLONG_MAX": F.max("CNT_CREDIT_PROLONG"),
    }
    for name, amount in (("CREDIT", credit), ("DEBT", debt)):
        out |= {f"BUREAU_{name}_SUM": F.sum(amount), f"BUREAU_{name}_MEAN": F.avg(amount),
                f"BUREAU_{name}_MAX": F.max(amount)}
    out |= {
        "BUREAU_OVERDUE_SUM": F.sum(overdue),
        "BUREAU_OVERDUE_MAX": F.max(overdue),
        "BUREAU_LIMIT_SUM": F.sum("AMT_CREDIT_SUM_LIMIT"),
        "BUREAU_ANNUITY_SUM": F.sum("AMT_ANNUITY"),
        "BUREAU_DEBT_TO_CREDIT": ratio(F.sum(debt), F.sum(credit)),
        "BUREAU_OVERDUE_TO_CREDIT": ratio(F.sum(overdue), F.sum(credit)),
        "BUREAU_ACTIVE_RATE": share_where(F.col("CREDIT_ACTIVE") == "Active"),
        "BUREAU_OVERDUE_RATE": share_where(overdue_days > 0),
    }
    return out


# Account-month measures that survive to applicant grain (the two month bounds do not).
_BB_SUMMED = (
    "BB_MONTHS_OBSERVED", "BB_DELINQUENT_MONTHS", "BB_SEVERE_DELINQUENT_MONTHS", "BB_DEFAULT_MONTHS",
    "BB_CLOSED_MONTHS", "BB_UNKNOWN_MONTHS", "BB_RECENT_12M_DELINQUENT_MONTHS",
)


def balance_rollup_features() -> dict[str, Column]:
    out = {name: F.sum(name) for name in _BB_SUMMED}
    out["BB_MAX_DELINQUENCY_LEVEL"] = F.max("BB_MAX_DELINQUENCY_LEVEL")
    observed = F.sum("BB_MONTHS_OBSERVED")
    out["BB_DELINQUENT_MONTH_RATE"] = ratio(F.sum("BB_DELINQUENT_MONTHS"), observed)
    out["BB_SEVERE_DELINQUENT_MONTH_RATE"] = ratio(F.sum("BB_SEVERE_DELINQUENT_MONTHS"), observed)
    return out


def with_distinct_counts(block: DataFrame, rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Add counts of distinct values per key, each from its own two-column aggregate.

    Several distinct counts in one aggregate would multiply all rows before they move; here only pairs that are already
    distinct within a task do.
    """
    for name, column in columns.items():
        pairs = rows.where(F.col(column).isNotNull()).select(key, column).distinct()
        block = block.join(pairs.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(
            name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return block


def bureau_block(bureau: DataFrame, balance: DataFrame, key: str = KEY) -> DataFrame:
    accounts = balance_by_account(balance).drop("BB_OLDEST_MONTH", "BB_LATEST_MONTH")
    joined = bureau.join(accounts, "SK_ID_BUREAU", "left")
    return aggregate(joined, [key], {**bureau_account_features(), **balance_rollup_features()})


def previous_block(previous: DataFrame, key: str = KEY) -> DataFrame:
    status, kind, product = (F.col(c) for c in ("NAME_CONTRACT_STATUS", "NAME_YIELD_GROUP", "NAME_CONTRACT_TYPE"))
    age, asked, credit, annuity = (
        -F.col("DAYS_DECISION"), F.col("AMT_APPLICATION"), F.col("AMT_CREDIT"), F.col("AMT_ANNUITY"))
    return aggregate(previous, [key], {
        "PREV_APPLICATION_COUNT": F.count(F.lit(1)),
        "PREV_UNIQUE_APPLICATION_COUNT": F.countDistinct("SK_ID_PREV"),
        **{f"PREV_{n}_COUNT": count_where(status == v) for n, v in (
            ("APPROVED", "Approved"), ("REFUSED", "Refused"), ("CANCELED", "Canceled"),
            ("UNUSED_OFFER", "Unused offer"))},
        "PREV_RECENT_12M_COUNT": count_where(F.col("DAYS_DECISION") >= -365),
        "PREV_RECENT_24M_COUNT": count_where(F.col("DAYS_DECISION") >= -730),
        "PREV_DAYS_SINCE_DECISION_MIN": F.min(age),
        "PREV_DAYS_SINCE_DECISION_MEAN": F.avg(age),
        "PREV_DAYS_SINCE_DECISION_MAX": F.max(age),
        "PREV_APPLICATION_AMOUNT_MEAN": F.avg(asked),
        "PREV_APPLICATION_AMOUNT_MAX": F.max(asked),
        "PREV_CREDIT_SUM": F.sum(credit),
        "PREV_CREDIT_MEAN": F.avg(credit),
        "PREV_CREDIT_MAX": F.max(credit),
        "PREV_ANNUITY_MEAN": F.avg(annuity),
        "PREV_ANNUITY_MAX": F.max(annuity),
        "PREV_DOWN_PAYMENT_MEAN": F.avg("AMT_DOWN_PAYMENT"),
        "PREV_DOWN_PAYMENT_RATE_MEAN": F.avg("RATE_DOWN_PAYMENT"),
        "PREV_PAYMENT_COUNT_MEAN": F.avg("CNT_PAYMENT"),
        "PREV_PAYMENT_COUNT_MAX": F.max("CNT_PAYMENT"),
        # Mean of the per-row ratios, not ratio of the sums.
        "PREV_CREDIT_TO_APPLICATION_MEAN": F.avg(ratio(credit, asked)),
        "PREV_ANNUITY_TO_CREDIT_MEAN": F.avg(ratio(annuity, credit)),
        "PREV_HIGH_YIELD_COUNT": count_where(kind == "high"),
        "PREV_MIDDLE_YIELD_COUNT": count_where(kind == "middle"),
        "PREV_CASH_LOAN_COUNT": count_where(product == "Cash loans"),
        "PREV_CONSUMER_LOAN_COUNT": count_where(product == "Consumer loans"),
        "PREV_APPROVAL_RATE": share_where(status == "Approved"),
        "PREV_REFUSAL_RATE": share_where(status == "Refused"),
    })


def _month_frame(prefix: str) -> dict[str, Column]:
    """Measures that loan-months and card-months have in common."""
    month, dpd, strict = F.col("MONTHS_BALANCE"), F.col("SK_DPD"), F.col("SK_DPD_DEF")
    return {
        f"{prefix}_MONTH_COUNT": F.count(F.lit(1)),
        f"{prefix}_CONTRACT_COUNT": F.countDistinct("SK_ID_PREV"),
        f"{prefix}_OLDEST_MONTH": F.min(month),
        f"{prefix}_LATEST_MONTH": F.max(month),
        f"{prefix}_DPD_MEAN": F.avg(dpd),
        f"{prefix}_DPD_MAX": F.max(dpd),
        f"{prefix}_DPD_MONTH_COUNT": count_where(dpd > 0),
        f"{prefix}_DPD_DEF_MONTH_COUNT": count_where(strict > 0),
        f"{prefix}_RECENT_12M_DPD_COUNT": count_where((month >= -12) & (dpd > 0)),
        f"{prefix}_ACTIVE_MONTH_COUNT": count_where(F.col("NAME_CONTRACT_STATUS") == "Active"),
        f"{prefix}_DPD_MONTH_RATE": share_where(dpd > 0),
        f"{prefix}_DPD_DEF_MONTH_RATE": share_where(strict > 0),
    }


def pos_features() -> dict[str, Column]:
    planned, left = F.col("CNT_INSTALMENT"), F.col("CNT_INSTALMENT_FUTURE")
    return {
        **_month_frame("POS"),
        "POS_INSTALLMENT_COUNT_MEAN": F.avg(planned),
        "POS_INSTALLMENT_COUNT_MAX": F.max(planned),
        "POS_FUTURE_INSTALLMENTS_MEAN": F.avg(left),
        "POS_FUTURE_INSTALLMENTS_MIN": F.min(left),
        "POS_DPD_SUM": F.sum("SK_DPD"),
        "POS_DPD_DEF_MEAN": F.avg("SK_DPD_DEF"),
        "POS_DPD_DEF_MAX": F.max("SK_DPD_DEF"),
        "POS_COMPLETED_MONTH_COUNT": count_where(F.col("NAME_CONTRACT_STATUS") == "Completed"),
    }


def pos_block(pos: DataFrame, key: str = KEY) -> DataFrame:
    return aggregate(pos, [key], pos_features())


def card_reported_features() -> dict[str, Column]:
    """Card measures that an external credit report also carries."""
    balance, limit = F.col("AMT_BALANCE"), F.col("AMT_CREDIT_LIMIT_ACTUAL")
    used = ratio(balance, limit)
    return {
        **_month_frame("CC"),
        "CC_BALANCE_MEAN": F.avg(balance),
        "CC_BALANCE_MAX": F.max(balance),
        "CC_BALANCE_SUM": F.sum(balance),
        "CC_LIMIT_MEAN": F.avg(limit),
        "CC_LIMIT_MAX": F.max(limit),
        "CC_UTILIZATION_MEAN": F.avg(used),
        "CC_UTILIZATION_MAX": F.max(used),
    }


def card_block(card: DataFrame, key: str = KEY) -> DataFrame:
    owed = F.col("AMT_TOTAL_RECEIVABLE")
    return aggregate(card, [key], {
        **card_reported_features(),
        "CC_DRAWINGS_MEAN": F.avg("AMT_DRAWINGS_CURRENT"),
        "CC_DRAWINGS_SUM": F.sum("AMT_DRAWINGS_CURRENT"),
        "CC_ATM_DRAWINGS_SUM": F.sum("AMT_DRAWINGS_ATM_CURRENT"),
        "CC_POS_DRAWINGS_SUM": F.sum("AMT_DRAWINGS_POS_CURRENT"),
        "CC_PAYMENT_CURRENT_SUM": F.sum("AMT_PAYMENT_CURRENT"),
        "CC_PAYMENT_TOTAL_SUM": F.sum("AMT_PAYMENT_TOTAL_CURRENT"),
        "CC_PAYMENT_TO_MINIMUM_MEAN": F.avg(
            ratio(F.col("AMT_PAYMENT_TOTAL_CURRENT"), F.col("AMT_INST_MIN_REGULARITY"))),
        "CC_RECEIVABLE_MEAN": F.avg(owed),
        "CC_RECEIVABLE_MAX": F.max(owed),
        "CC_DRAWING_COUNT_SUM": F.sum("CNT_DRAWINGS_CURRENT"),
        "CC_ATM_DRAWING_COUNT_SUM": F.sum("CNT_DRAWINGS_ATM_CURRENT"),
        "CC_POS_DRAWING_COUNT_SUM": F.sum("CNT_DRAWINGS_POS_CURRENT"),
    })


def installment_block(payments: DataFrame, key: str = KEY) -> DataFrame:
    due_day, paid_day = F.col("DAYS_INSTALMENT"), F.col("DAYS_ENTRY_PAYMENT")
    due, paid = F.col("AMT_INSTALMENT"), F.col("AMT_PAYMENT")
    late, short = paid_day > due_day, paid < due
    late_days, missing = floor_zero(paid_day - due_day), F.greatest(due - paid, F.lit(0.0))
    sums = aggregate(payments, [key], {
        "INST_PAYMENT_COUNT": F.count(F.lit(1)),
        "INST_VERSION_MEAN": F.avg("NUM_INSTALMENT_VERSION"),
        "INST_DUE_SUM": F.sum(due),
        "INST_PAID_SUM": F.sum(paid),
        "INST_DUE_MEAN": F.avg(due),
        "INST_PAID_MEAN": F.avg(paid),
        # Ratio of the sums, unlike the previous-application ratios.
        "INST_PAYMENT_RATIO": ratio(F.sum(paid), F.sum(due)),
        **{f"INST_LATE_DAYS_{s}": f(late_days) for s, f in (("MEAN", F.avg), ("MAX", F.max), ("SUM", F.sum))},
        **{f"INST_SHORTFALL_{s}": f(missing) for s, f in (("MEAN", F.avg), ("MAX", F.max), ("SUM", F.sum))},
        "INST_LATE_PAYMENT_COUNT": count_where(late),
        "INST_SHORT_PAYMENT_COUNT": count_where(short),
        "INST_RECENT_12M_LATE_COUNT": count_where((due_day >= -365) & late),
        "INST_RECENT_24M_LATE_COUNT": count_where((due_day >= -730) & late),
        "INST_LATE_PAYMENT_RATE": share_where(late),
        "INST_SHORT_PAYMENT_RATE": share_where(short),
        "INST_DAYS_SINCE_DUE_MIN": F.min(-due_day),
        "INST_DAYS_SINCE_DUE_MAX": F.max(-due_day),
    })
    return with_distinct_counts(sums, payments, key, {
        "INST_CONTRACT_COUNT": "SK_ID_PREV", "INST_UNIQUE_NUMBER_COUNT": "NUM_INSTALMENT_NUMBER"})


def assemble(spine: DataFrame, blocks: dict[str, DataFrame], key: str = KEY) -> DataFrame:
    """Left-join one-row-per-key blocks to the spine; ``HAS_*`` tells a block that had no row.

    Every block leaves its aggregate hash-partitioned on ``key``, so the chain adds no exchange beyond
    the spine's own.  Features of an absent block stay NULL; only the flags are filled.
    """
    marked = {name: block.withColumn(name, F.lit(1)) for name, block in blocks.items()}
    joined = reduce(lambda left, right: left.join(right, key, "left"), marked.values(), spine)
    features = [c for block in blocks.values() for c in block.columns if c != key]
    return joined.select(
        key, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in blocks], *[F.col(c) for c in features]
    )


def lifetime_features(tables: dict[str, DataFrame]) -> DataFrame:
    """The lifetime feature store: 5 availability flags and 145 features per application."""
    blocks = dict(zip(HISTORY_FLAGS, (
        bureau_block(tables["bureau"], tables["bureau_balance"]),
        previous_block(tables["previous_application"]),
        pos_block(tables["pos_cash_balance"]),
        card_block(tables["credit_card_balance"]),
        installment_block(tables["installments_payments"]),
    ), strict=True))
    return assemble(id_spine(tables["application_train"], tables["application_test"]), blocks)


def source_count(flags: tuple[str, ...] = HISTORY_FLAGS) -> Column:
    return reduce(lambda a, b: a + b, [flag(F.col(f) == 1) for f in flags])
