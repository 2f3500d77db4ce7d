"""Temporal history features: recency weights, sequences, velocity and trajectories.

Sequences are computed at *day* (or month) grain instead of event grain.  Events of one loan that share
a due day are ordered "not late before late, then by instalment number", so one row per loan and day
with its late / not-late counts carries everything that run lengths, streaks and state changes need.
A loan therefore contributes at most one row per calendar day to any window, however many payments it
has, and the rows are already partially aggregated before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import (
    count_where, flag, floor_zero, half_life, ratio, share_where,
)
from .history import KEY, aggregate, assemble, id_spine

LOAN = "SK_ID_PREV"
DAY_HALF_LIVES = (90, 180, 365)
MONTH_HALF_LIVES = (3, 6, 12)
RECENT_EVENTS = 6
STRESS_WINDOW_DAYS = 90
TEMPORAL_FLAGS = (
    "HAS_TEMPORAL_INSTALLMENTS",
    "HAS_TEMPORAL_PREVIOUS",
    "HAS_TEMPORAL_POS",
    "HAS_TEMPORAL_CREDIT_CARD",
    "HAS_TEMPORAL_BUREAU",
)


# ---------------------------------------------------------------- instalments

def reconcile_installments(payments: DataFrame) -> DataFrame:
    """Payment rows -> one event per applicant, loan and instalment number (split payments summed)."""
    events = payments.groupBy(KEY, LOAN, "NUM_INSTALMENT_NUMBER").agg(
        F.max("DAYS_INSTALMENT").alias("DUE_DAY"),
        F.max("DAYS_ENTRY_PAYMENT").alias("PAYMENT_DAY"),
        F.max("AMT_INSTALMENT").alias("DUE_AMOUNT"),
        F.sum("AMT_PAYMENT").alias("PAID_AMOUNT"),
    )
    due, paid_on = F.col("DUE_DAY"), F.col("PAYMENT_DAY")
    owed, paid = F.col("DUE_AMOUNT"), F.col("PAID_AMOUNT")
    return events.withColumns({
        "LATE_DAYS": floor_zero(paid_on - due),
        "SHORTFALL": F.greatest(owed - paid, F.lit(0.0)),
        "IS_LATE": flag(paid_on > due),
        "IS_SHORT": flag(paid < owed),
        "IS_ON_TIME": flag((paid_on <= due) & (paid >= owed)),
    })


def loan_day_sequence(events: DataFrame) -> DataFrame:
    """One row per loan and due day with its place in the loan's late / not-late sequence.

    ``ISLAND`` numbers the stretches that start with a not-late event; all late events of an island
    form one run.  ``RUN_LENGTH`` is the late run that ends on the day.
    """
    days = events.groupBy(LOAN, KEY, "DUE_DAY").agg(
        F.count(F.lit(1)).alias("EVENTS"),
        F.sum("IS_LATE").alias("LATE"),
        F.sum("IS_ON_TIME").alias("ON_TIME"),
        F.sum("SHORTFALL").alias("SHORTFALL"),
        F.sum("DUE_AMOUNT").alias("DUE_AMOUNT"),
        F.sum("LATE_DAYS").alias("LATE_DAYS"),
    ).withColumn("CLEAN", F.col("EVENTS") - F.col("LATE"))
    loan = Window.partitionBy(LOAN)
    ordered = loan.orderBy(F.col("DUE_DAY").asc_nulls_last(), F.col(KEY))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    late, clean = F.col("LATE"), F.col("CLEAN")
    return (
        days.withColumns({
            "POSITION": F.row_number().over(ordered),
            "PRIOR_ENDS_LATE": (F.lag(late).over(ordered) > 0),
            "ISLAND": F.sum(flag(clean > 0)).over(so_far),
            "LATE_SO_FAR": F.sum(late).over(so_far),
        })
        .withColumn(
            "LATE_AT_ISLAND_START", F.max(F.when(clean > 0, F.col("LATE_SO_FAR") - late)).over(so_far)
        )
        .withColumn("RUN_LENGTH", F.col("LATE_SO_FAR") - F.coalesce(F.col("LATE_AT_ISLAND_START"), F.lit(0)))
        .withColumns({
            "LAST_LATE_POSITION": F.coalesce(F.max(F.when(late > 0, F.col("POSITION"))).over(loan), F.lit(0)),
            "LAST_ISLAND": F.max("ISLAND").over(loan),
            "LONGEST_RUN": F.max(F.when(late > 0, F.col("RUN_LENGTH"))).over(loan),
        })
    )


def loan_features(sequence: DataFrame) -> DataFrame:
    """Per loan: recency-weighted rates, current streaks, cures, relapses, longest late run."""
    age = -F.col("DUE_DAY")
    late, clean, prior_late = F.col("LATE"), F.col("CLEAN"), F.col("PRIOR_ENDS_LATE")
    features: dict[str, Column] = {}
    for days in DAY_HALF_LIVES:
        weight = half_life(age, days)
        features[f"WEIGHTED_LATE_RATE_{days}D"] = ratio(
            F.sum(weight * late), F.sum(weight * F.col("EVENTS")))
        features[f"WEIGHTED_SHORTFALL_RATE_{days}D"] = ratio(
            F.sum(weight * F.col("SHORTFALL")), F.sum(weight * F.col("DUE_AMOUNT")))
    weight = half_life(age, 180)
    relapse_here = (late > 0) & ((clean > 0) | ~prior_late)
    features |= {
        "WEIGHTED_LATE_DAYS_180D": ratio(
            F.sum(weight * F.col("LATE_DAYS")), F.sum(weight * F.col("EVENTS"))),
        "CURRENT_ON_TIME_STREAK": F.sum(
            F.when(F.col("POSITION") > F.col("LAST_LATE_POSITION"), F.col("ON_TIME")).otherwise(0)),
        "CURRENT_LATE_STREAK": F.sum(F.when(F.col("ISLAND") == F.col("LAST_ISLAND"), late).otherwise(0)),
        "CURE_COUNT": count_where((clean > 0) & prior_late),
        "RELAPSE_COUNT": count_where(relapse_here),
        "DAYS_SINCE_LATE": F.min(F.when(late > 0, age)),
        "MAX_CONSECUTIVE_LATE": F.coalesce(F.max("LONGEST_RUN"), F.lit(0)),
    }
    return aggregate(sequence, [KEY, LOAN], {f"TINST_LOAN_{n}": c for n, c in features.items()})


def installment_windows(events: DataFrame) -> DataFrame:
    """Per applicant: rates and counts in disjoint or nested windows of event age."""
    age = -F.col("DUE_DAY")
    late, short = F.col("IS_LATE"), F.col("IS_SHORT")

    def within(upper: int, value: Column, lower: int | None = None) -> Column:
        test = age <= upper if lower is None else (age > lower) & (age <= upper)
        return F.when(test, value)

    def shortfall_rate(upper: int) -> Column:
        return ratio(F.sum(within(upper, F.col("SHORTFALL"))), F.sum(within(upper, F.col("DUE_AMOUNT"))))

    return aggregate(events, [KEY], {
        "TINST_LATE_RATE_90D": F.avg(within(90, late)),
        "TINST_LATE_RATE_91_365D": F.avg(within(365, late, 90)),
        "TINST_LATE_RATE_180D": F.avg(within(180, late)),
        "TINST_LATE_RATE_181_730D": F.avg(within(730, late, 180)),
        "TINST_SHORT_RATE_365D": F.avg(within(365, short)),
        "TINST_SHORTFALL_RATE_90D": shortfall_rate(90),
        "TINST_SHORTFALL_RATE_365D": shortfall_rate(365),
        "TINST_LATE_DAYS_MEAN_90D": F.avg(within(90, F.col("LATE_DAYS"))),
        "TINST_LATE_DAYS_MAX_365D": F.max(within(365, F.col("LATE_DAYS"))),
        **{f"TINST_EVENT_COUNT_{d}D": count_where(age <= d) for d in (30, 90, 365)},
        "TINST_LATE_COUNT_90D": count_where((age <= 90) & (late == 1)),
        "TINST_SHORT_COUNT_90D": count_where((age <= 90) & (short == 1)),
        "TINST_DAYS_SINCE_LAST_LATE": F.min(F.when(late == 1, age)),
        "TINST_DAYS_SINCE_LAST_SHORT": F.min(F.when(short == 1, age)),
    })


def recent_event_pivot(events: DataFrame, depth: int = RECENT_EVENTS) -> DataFrame:
    """The ``depth`` latest events of each loan as columns, maximum over the applicant's loans.

    The rank filter lets Catalyst cut every loan to ``depth`` rows before the shuffle as well as after.
    """
    newest = Window.partitionBy(LOAN).orderBy(
        F.col("DUE_DAY").desc_nulls_last(), F.col(KEY).desc(), F.col("IS_LATE").desc(),
        F.col("NUM_INSTALMENT_NUMBER").desc(),
    )
    ranked = events.withColumn("RANK", F.row_number().over(newest)).where(F.col("RANK") <= depth)
    measures = {
        "LATE": F.col("IS_LATE"),
        "SHORT": F.col("IS_SHORT"),
        "LATE_DAYS": F.col("LATE_DAYS"),
        "PAYMENT_RATIO": ratio(F.col("PAID_AMOUNT"), F.col("DUE_AMOUNT")),
    }
    return aggregate(ranked, [KEY], {
        f"TINST_RECENT_EVENT_{n}_{name}": F.max(F.when(F.col("RANK") == n, value))
        for n in range(1, depth + 1) for name, value in measures.items()
    })


def installment_rollup(events: DataFrame) -> DataFrame:
    """Applicant block: loans are averaged first so that a long loan does not dominate."""
    loans = loan_features(loan_day_sequence(events))

    def col(name: str) -> Column:
        return F.col(f"TINST_LOAN_{name}")

    features = {f"TINST_WEIGHTED_{kind}_RATE_{d}D": F.avg(col(f"WEIGHTED_{kind}_RATE_{d}D"))
                for kind in ("LATE", "SHORTFALL") for d in DAY_HALF_LIVES}
    features |= {
        "TINST_WEIGHTED_LATE_RATE_MAX_180D": F.max(col("WEIGHTED_LATE_RATE_180D")),
        "TINST_WEIGHTED_LATE_DAYS_180D": F.avg(col("WEIGHTED_LATE_DAYS_180D")),
        "TINST_CURRENT_ON_TIME_STREAK_MAX": F.max(col("CURRENT_ON_TIME_STREAK")),
        "TINST_CURRENT_LATE_STREAK_MAX": F.max(col("CURRENT_LATE_STREAK")),
        "TINST_MAX_CONSECUTIVE_LATE": F.max(col("MAX_CONSECUTIVE_LATE")),
        "TINST_CURE_COUNT": F.sum(col("CURE_COUNT")),
        "TINST_RELAPSE_COUNT": F.sum(col("RELAPSE_COUNT")),
        "TINST_CURE_RATE": ratio(
            F.sum(col("CURE_COUNT")), F.sum(col("CURE_COUNT") + col("RELAPSE_COUNT"))),
        "TINST_DAYS_SINCE_LATE_MIN": F.min(col("DAYS_SINCE_LATE")),
    }
    per_loan = aggregate(loans, [KEY], features)
    return (
        per_loan.join(installment_windows(events), KEY).join(recent_event_pivot(events), KEY)
        .withColumns({
            "TINST_LATE_DELTA_90_365D": F.col("TINST_LATE_RATE_90D") - F.col("TINST_LATE_RATE_91_365D"),
            "TINST_LATE_DELTA_180_730D": F.col("TINST_LATE_RATE_180D") - F.col("TINST_LATE_RATE_181_730D"),
        })
    )


# ---------------------------------------------------------------- earlier applications

def application_velocity(previous: DataFrame) -> DataFrame:
    """Counts by recency, bursts and gaps between decisions.

    Bursts and gaps run over one row per applicant and decision day.  The mean gap of an ordered series
    telescopes to (last - first) / (n - 1), and two decisions on one day make the smallest gap zero.
    """
    age, status = -F.col("DAYS_DECISION"), F.col("NAME_CONTRACT_STATUS")
    plain = aggregate(previous, [KEY], {
        **{f"TPREV_APPLICATION_COUNT_{d}D": count_where(age <= d) for d in (30, 90, 180, 365)},
        "TPREV_REFUSED_COUNT_90D": count_where((age <= 90) & (status == "Refused")),
        "TPREV_APPROVED_COUNT_180D": count_where((age <= 180) & (status == "Approved")),
        "TPREV_CASH_LOAN_COUNT_180D": count_where((age <= 180) & (F.col("NAME_CONTRACT_TYPE") == "Cash loans")),
        "TPREV_DECISION_GAP_MEAN_DAYS": F.when(
            F.count("DAYS_DECISION") > 1,
            (F.max("DAYS_DECISION") - F.min("DAYS_DECISION"))
            / F.nullif(F.count("DAYS_DECISION") - 1, F.lit(0))),
        "TPREV_OTHER_LOAN_PURPOSE_COUNT": count_where(
            F.col("NAME_CASH_LOAN_PURPOSE") == "Payments on other loans"),
        "TPREV_ANNUITY_MEAN_365D": F.avg(F.when(age <= 365, F.col("AMT_ANNUITY"))),
        "TPREV_CREDIT_SUM_365D": F.sum(F.when(age <= 365, F.col("AMT_CREDIT"))),
    })
    by_day = Window.partitionBy(KEY).orderBy("DAYS_DECISION")
    days = previous.groupBy(KEY, "DAYS_DECISION").agg(F.count(F.lit(1)).alias("ROWS_THAT_DAY"))
    days = days.withColumns({
        "IN_30_DAYS": F.sum("ROWS_THAT_DAY").over(by_day.rangeBetween(-30, 0)),
        "GAP": F.when(F.col("DAYS_DECISION").isNotNull() & (F.col("ROWS_THAT_DAY") > 1), 0)
                .otherwise(F.col("DAYS_DECISION") - F.lag("DAYS_DECISION").over(by_day)),
    })
    bursts = aggregate(days, [KEY], {
        "TPREV_APPLICATION_BURST_MAX_30D": F.max("IN_30_DAYS"),
        "TPREV_DECISION_GAP_MIN_DAYS": F.min("GAP"),
    })
    return plain.join(bursts, KEY)


def cash_after_stress(previous: DataFrame, events: DataFrame, window: int = STRESS_WINDOW_DAYS) -> DataFrame:
    """Approved cash loans decided 0-90 days after a late or short instalment of the same applicant.

    A semi join on (applicant, block of days) with the day range as residual: each stressed day is listed
    in its own block and the next one, so neither side fans out and a block holds at most two windows of
    distinct days.
    """
    span = window + 1
    stressed = (
        events.where((F.col("IS_LATE") == 1) | (F.col("IS_SHORT") == 1))
        .where(F.col("DUE_DAY").isNotNull())
        .select(KEY, "DUE_DAY").distinct()
        .withColumn("BLOCK", F.floor(F.col("DUE_DAY") / span))
        .withColumn("BLOCK", F.explode(F.array(F.col("BLOCK"), F.col("BLOCK") + 1)))
        .withColumnRenamed(KEY, "STRESSED_ID")
    )
    cash = (
        previous.where((F.col("NAME_CONTRACT_TYPE") == "Cash loans") & (F.col("NAME_CONTRACT_STATUS") == "Approved"))
        .select(KEY, LOAN, "DAYS_DECISION").withColumn("CASH_BLOCK", F.floor(F.col("DAYS_DECISION") / span))
    )
    followed = cash.join(
        stressed,
        (F.col(KEY) == F.col("STRESSED_ID")) & (F.col("CASH_BLOCK") == F.col("BLOCK"))
        & (F.col("DAYS_DECISION") - F.col("DUE_DAY")).between(0, window),
        "left_semi",
    )
    return aggregate(followed, [KEY], {"TPREV_CASH_AFTER_STRESS_90D_COUNT": F.countDistinct(LOAN)})


# ---------------------------------------------------------------- loan months

def _late_state_changes(pos: DataFrame) -> DataFrame:
    """Cures and relapses of each loan over its months (rows of one month ordered by days past due)."""
    dpd = F.col("SK_DPD")
    months = pos.groupBy(LOAN, KEY, "MONTHS_BALANCE").agg(
        count_where(dpd > 0).alias("LATE_ROWS"),
        F.count(F.lit(1)).alias("ROWS"),
        ((F.min(dpd) == 0) & (F.count(dpd) == F.count(F.lit(1)))).alias("STARTS_AT_ZERO"),
    )
    ordered = Window.partitionBy(LOAN).orderBy(F.col("MONTHS_BALANCE").asc_nulls_last(), F.col(KEY))
    prior_late = F.lag("LATE_ROWS").over(ordered) > 0
    months = months.withColumn("PRIOR_ENDS_LATE", prior_late)
    late, clean = F.col("LATE_ROWS") > 0, F.col("ROWS") > F.col("LATE_ROWS")
    return aggregate(months, [KEY], {
        "TPOS_DPD_CURE_COUNT": count_where(F.col("PRIOR_ENDS_LATE") & F.col("STARTS_AT_ZERO")),
        "TPOS_DPD_RELAPSE_COUNT": count_where(late & (clean | ~F.col("PRIOR_ENDS_LATE"))),
    })


def pos_applicant_months(pos: DataFrame) -> DataFrame:
    active = F.col("NAME_CONTRACT_STATUS") == "Active"
    return aggregate(pos, [KEY, "MONTHS_BALANCE"], {
        "ACTIVE_CONCURRENCY": F.countDistinct(F.when(active, F.col(LOAN))),
        "FUTURE_INSTALLMENTS": F.sum(F.when(active, F.col("CNT_INSTALMENT_FUTURE"))),
        "MAX_DPD": F.max("SK_DPD"),
        "LATE_ROWS": count_where(F.col("SK_DPD") > 0),
        "ROWS": F.count(F.lit(1)),
    })


def pos_trajectory(pos: DataFrame) -> DataFrame:
    month = F.col("MONTHS_BALANCE")
    concurrency, future, dpd = F.col("ACTIVE_CONCURRENCY"), F.col("FUTURE_INSTALLMENTS"), F.col("MAX_DPD")
    weighted = {}
    for months in MONTH_HALF_LIVES:  # the weights depend on the month alone
        weight = half_life(-month, months)
        weighted[f"TPOS_WEIGHTED_DPD_RATE_{months}M"] = ratio(F.sum(weight * F.col("LATE_ROWS")), F.sum(weight * F.col("ROWS")))
    monthly = aggregate(pos_applicant_months(pos), [KEY], {
        **weighted,
        "TPOS_ACTIVE_CONCURRENCY_MAX_12M": F.max(F.when(month >= -12, concurrency)),
        "TPOS_ACTIVE_CONCURRENCY_MEAN_12M": F.avg(F.when(month >= -12, concurrency)),
        "TPOS_FUTURE_INSTALLMENTS_MAX_6M": F.max(F.when(month >= -6, future)),
        "TPOS_FUTURE_INSTALLMENTS_MEAN_6M": F.avg(F.when(month >= -6, future)),
        "TPOS_FUTURE_INSTALLMENTS_SLOPE_12M": F.regr_slope(F.when(month >= -12, future), month),
        # Divides by every month of the applicant, not only the last six.
        "TPOS_DPD_RATE_6M": share_where((month >= -6) & (dpd > 0)),
        "TPOS_DPD_MAX_12M": F.max(F.when(month >= -12, dpd)),
    })
    return monthly.join(_late_state_changes(pos), KEY)


# ---------------------------------------------------------------- cards and accounts

def card_trajectory(card: DataFrame) -> DataFrame:
    month = F.col("MONTHS_BALANCE")
    used = ratio(F.col("AMT_BALANCE"), F.col("AMT_CREDIT_LIMIT_ACTUAL"))
    paid, minimum = F.col("AMT_PAYMENT_TOTAL_CURRENT"), F.col("AMT_INST_MIN_REGULARITY")
    pay_share = ratio(paid, minimum)

    def last(months: int, value: Column) -> Column:
        return F.when(month >= -months, value)

    atm = F.sum(last(6, F.col("AMT_DRAWINGS_ATM_CURRENT")))
    return aggregate(card, [KEY], {
        "TCC_UTILIZATION_MEAN_3M": F.avg(last(3, used)),
        "TCC_UTILIZATION_MEAN_6M": F.avg(last(6, used)),
        "TCC_UTILIZATION_MAX_12M": F.max(last(12, used)),
        "TCC_UTILIZATION_STD_12M": F.stddev_pop(last(12, used)),
        "TCC_UTILIZATION_SLOPE_12M": F.regr_slope(last(12, used), month),
        "TCC_PAYMENT_TO_MINIMUM_MEAN_6M": F.avg(last(6, pay_share)),
        "TCC_PAYMENT_TO_MINIMUM_SLOPE_12M": F.regr_slope(last(12, pay_share), month),
        "TCC_ATM_DRAWINGS_SUM_6M": atm,
        "TCC_ATM_DRAWING_TO_PAYMENT_6M": ratio(atm, F.sum(last(6, paid))),
        # An unknown comparison counts as "no", so the denominators are all six-month rows.
        "TCC_MAXED_RATE_6M": F.avg(last(6, flag(used >= 0.90))),
        "TCC_BELOW_MINIMUM_RATE_6M": F.avg(last(6, flag(paid < minimum))),
        "TCC_DPD_RATE_6M": F.avg(last(6, flag(F.col("SK_DPD") > 0))),
        "TCC_DPD_MAX_12M": F.max(last(12, F.col("SK_DPD"))),
    })


def active_account_burden(bureau: DataFrame) -> DataFrame:
    active = F.col("CREDIT_ACTIVE") == "Active"
    debt, credit = F.col("AMT_CREDIT_SUM_DEBT"), F.col("AMT_CREDIT_SUM")

    def total(value: Column) -> Column:
        return F.sum(F.when(active, value))

    return aggregate(bureau, [KEY], {
        "TBUREAU_ACTIVE_DEBT_SUM": total(debt),
        "TBUREAU_ACTIVE_CREDIT_SUM": total(credit),
        "TBUREAU_ACTIVE_ANNUITY_SUM": total(F.col("AMT_ANNUITY")),
        "TBUREAU_ACTIVE_OVERDUE_SUM": total(F.col("AMT_CREDIT_SUM_OVERDUE")),
        "TBUREAU_ACTIVE_DEBT_TO_CREDIT": ratio(total(debt), total(credit)),
        "TBUREAU_ACTIVE_DEBT_ANOMALY_COUNT": count_where(active & ((debt < 0) | (debt > credit))),
        "TBUREAU_NEW_ACTIVE_COUNT_180D": count_where(active & (F.col("DAYS_CREDIT") >= -180)),
        "TBUREAU_DAYS_SINCE_NEWEST_ACTIVE": F.min(F.when(active, -F.col("DAYS_CREDIT"))),
    })


# ---------------------------------------------------------------- store

def cycling_signals() -> Column:
    """How many of five stress families show up; an unknown input counts as "no"."""
    families = (
        (F.col("TPREV_APPLICATION_BURST_MAX_30D") >= 3) | (F.col("TPREV_REFUSED_COUNT_90D") >= 2),
        F.col("TPOS_ACTIVE_CONCURRENCY_MAX_12M") >= 2,
        F.col("TPREV_CASH_AFTER_STRESS_90D_COUNT") > 0,
        (F.col("TCC_MAXED_RATE_6M") >= 0.50) | (F.col("TCC_BELOW_MINIMUM_RATE_6M") >= 0.50),
        F.col("TPREV_OTHER_LOAN_PURPOSE_COUNT") > 0,
    )
    return reduce(lambda a, b: a + b, [flag(f) for f in families])


def temporal_features(tables: dict[str, DataFrame]) -> DataFrame:
    """The temporal feature store: 111 features per application."""
    events = reconcile_installments(tables["installments_payments"])
    previous = tables["previous_application"]
    blocks = dict(zip(TEMPORAL_FLAGS, (
        installment_rollup(events),
        application_velocity(previous),
        pos_trajectory(tables["pos_cash_balance"]),
        card_trajectory(tables["credit_card_balance"]),
        active_account_burden(tables["bureau"]),
    ), strict=True))
    store = assemble(id_spine(tables["application_train"], tables["application_test"]), blocks)
    after = "TPREV_CASH_AFTER_STRESS_90D_COUNT"
    return (
        store.join(cash_after_stress(previous, events), KEY, "left")
        .withColumn(after, F.coalesce(F.col(after), F.lit(0)))
        .withColumn("CYCLING_SIGNAL_FAMILY_COUNT", cycling_signals())
        .withColumn("CYCLING_MULTI_SIGNAL_FLAG", flag(F.col("CYCLING_SIGNAL_FAMILY_COUNT") >= 2))
    )
