"""Features from user-supplied intake sheets, for many applicants in one job.

The sheets are renamed to the raw tables' columns and rolled up by the same aggregates as the lifetime
store, so that a submitted applicant and a stored one get the same values.  Cells arrive as text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import count_where, finite_or_null, missing_count, positive_ratio
from .application import NOT_EMPLOYED, term_ratios, years_before
from .history import (
    account_month_features, aggregate, balance_rollup_features, bureau_account_features, card_reported_features,
    pos_features,
)

REF = "applicant_ref"
# Accepted spellings, column names, bands.
YES = ("y", "yes", "true", "1", "t")
NO = ("n", "no", "false", "0", "f")
EMPTY = ("", "na", "nan", "none")
APPLICATION_COLUMNS = {
    "annual_income": "AMT_INCOME_TOTAL",
    "requested_credit": "AMT_CREDIT",
    "annual_annuity": "AMT_ANNUITY",
    "goods_price": "AMT_GOODS_PRICE",
    "contract_type": "NAME_CONTRACT_TYPE",
    "income_type": "NAME_INCOME_TYPE",
    "education_type": "NAME_EDUCATION_TYPE",
    "housing_type": "NAME_HOUSING_TYPE",
    "owns_car": "FLAG_OWN_CAR",
    "owns_realty": "FLAG_OWN_REALTY",
    "car_age_years": "OWN_CAR_AGE",
    "employment_years": "EMPLOYMENT_YEARS",
    "address_vintage_years": "REGISTRATION_YEARS",
    "id_document_age_years": "ID_AGE_YEARS",
    "has_email": "FLAG_EMAIL",
    "has_work_phone": "FLAG_WORK_PHONE",
}
REQUIRED = ("annual_income", "requested_credit", "annual_annuity", "income_type", "education_type", "employment_years")
LETTER_FLAGS = ("owns_car", "owns_realty")
NUMBER_FLAGS = ("has_email", "has_work_phone")
TEXT_FIELDS = ("contract_type", "income_type", "education_type", "housing_type")
TRADELINE_STATUSES = ("Active", "Closed", "Sold", "Bad debt")
TRADELINE_NUMBERS = {
    "opened_days_ago": None, "sanctioned_amount": "AMT_CREDIT_SUM", "credit_limit": "AMT_CREDIT_SUM_LIMIT",
    "current_balance": "AMT_CREDIT_SUM_DEBT", "overdue_amount": "AMT_CREDIT_SUM_OVERDUE",
    "days_overdue": "CREDIT_DAY_OVERDUE", "annuity": "AMT_ANNUITY", "times_prolonged": "CNT_CREDIT_PROLONG",
}
# (exclusive lower, inclusive upper] days.  The bands are disjoint.
ENQUIRY_BANDS = {
    "HOUR": (-0.5, 0.0), "DAY": (0.0, 1.0), "WEEK": (1.0, 7.0), "MON": (7.0, 30.0), "QRT": (30.0, 90.0),
    "YEAR": (90.0, 365.0),
}
FAMILIES = {
    "HAS_BUREAU_HISTORY": "credit report",
    "HAS_CREDIT_CARD_HISTORY": "revolving account history",
    "HAS_POS_HISTORY": "installment account history",
}


# ---------------------------------------------------------------- cells

def is_empty(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*EMPTY)


def parse_number(c: Column) -> Column:
    """Number without thousands commas; empty and infinite cells are NULL."""
    return finite_or_null(F.when(~is_empty(c), F.regexp_replace(F.trim(c), ",", "").try_cast("double")))


def is_bad_number(c: Column) -> Column:
    return ~is_empty(c) & F.regexp_replace(F.trim(c), ",", "").try_cast("double").isNull()


def parse_flag(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin(*YES), F.lit(1.0)).when(text.isin(*NO), F.lit(0.0))


def is_bad_flag(c: Column) -> Column:
    return ~is_empty(c) & ~F.lower(F.trim(c)).isin(*YES, *NO)


def optional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add absent columns as NULL text."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


# ---------------------------------------------------------------- application sheet

def parse_application(sheet: DataFrame) -> DataFrame:
    """One row per applicant with model columns, ``violations`` (why it cannot be scored) and findings.

    The one-row rule is checked by the same aggregate that picks the row.
    """
    df = optional(sheet, list(APPLICATION_COLUMNS))
    names = list(APPLICATION_COLUMNS)
    one = df.groupBy(REF).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(n).alias(n) for n in names])
    numbers = [n for n in names if n not in LETTER_FLAGS + NUMBER_FLAGS + TEXT_FIELDS]
    rules = [F.when(F.col("_rows") != 1, "'application' must hold exactly one row")]
    rules += [F.when(is_empty(F.col(n)), f"missing required application field: {n}") for n in REQUIRED]
    rules += [F.when(is_bad_number(F.col(n)), f"expected a number in {n}") for n in numbers]
    rules += [F.when(is_bad_flag(F.col(n)), f"expected Y or N in {n}") for n in NUMBER_FLAGS]
    rules.append(F.when(parse_number(F.col("annual_income")) <= 0, "annual_income must be positive"))
    parsed: dict[str, Column] = {}
    for name, column in APPLICATION_COLUMNS.items():
        cell = F.col(name)
        if name in LETTER_FLAGS:
            parsed[column] = F.substring(F.upper(F.trim(cell)), 1, 1)
        elif name in NUMBER_FLAGS:
            parsed[column] = parse_flag(cell)
        elif name in TEXT_FIELDS:
            parsed[column] = F.trim(cell)
        else:
            parsed[column] = parse_number(cell)
    out = one.select(
        REF, F.array_compact(F.array(*rules)).alias("violations"), *[c.alias(n) for n, c in parsed.items()])
    years = F.col("EMPLOYMENT_YEARS")
    out = out.withColumn("EMPLOYMENT_SENTINEL", F.when(years.isNull() | (years < 0), 1).otherwise(0))
    return out.withColumns({
        "EMPLOYMENT_YEARS": F.when(F.col("EMPLOYMENT_SENTINEL") == 0, years),
        "application_findings": F.array_compact(F.array(
            F.when((F.col("FLAG_OWN_CAR") == "Y") & F.col("OWN_CAR_AGE").isNull(),
                   "application.car_age_absent"))),
    })


# ---------------------------------------------------------------- credit report sheets

def parse_tradelines(sheet: DataFrame) -> DataFrame:
    df = optional(sheet, ["account_ref", "credit_type", "status", *TRADELINE_NUMBERS])
    return df.select(
        REF, F.col("account_ref").alias("SK_ID_BUREAU"), F.col("credit_type").alias("CREDIT_TYPE"),
        F.trim("status").alias("CREDIT_ACTIVE"),
        (-parse_number(F.col("opened_days_ago"))).alias("DAYS_CREDIT"),
        *[parse_number(F.col(n)).alias(c) for n, c in TRADELINE_NUMBERS.items() if c])


def expand_strips(sheet: DataFrame) -> DataFrame:
    """One character per month, newest first -> one row per month; ``-`` and blanks keep their place only."""
    months = F.posexplode(F.split(F.trim("dpd_strip"), "")).alias("months_ago", "status")
    return sheet.where(F.col("dpd_strip").isNotNull()).select(REF, "account_ref", months).where(
        ~F.col("status").isin("-", " ", "")).select(
        REF, "account_ref", F.col("months_ago").cast("string").alias("months_ago"), "status")


def parse_dpd(sheet: DataFrame) -> DataFrame:
    """Both forms may be mixed: a row with a strip is expanded, a row without one is a month of its own."""
    df = optional(sheet, ["months_ago", "status"])
    long = df.select(REF, "account_ref", "months_ago", "status")
    if "dpd_strip" in df.columns:
        single = F.col("dpd_strip").isNull() & F.coalesce("months_ago", "status").isNotNull()
        long = expand_strips(df).unionByName(df.where(single).select(*long.columns))
    return long.select(
        REF, F.col("account_ref").alias("SK_ID_BUREAU"),
        (-parse_number(F.col("months_ago"))).alias("MONTHS_BALANCE"),
        F.upper(F.trim("status")).alias("STATUS"))


def dpd_by_account(dpd: DataFrame) -> DataFrame:
    return aggregate(dpd, [REF, "SK_ID_BUREAU"], account_month_features())


def report_block(tradelines: DataFrame, dpd: DataFrame) -> DataFrame:
    """Account features plus the monthly roll-up of those accounts that the report lists."""
    accounts = aggregate(tradelines, [REF], {
        **bureau_account_features(),
        "_unknown_status": count_where(~F.coalesce(F.col("CREDIT_ACTIVE"), F.lit("")).isin(*TRADELINE_STATUSES)),
    })
    per_account = dpd_by_account(dpd)
    listed = tradelines.select(REF, "SK_ID_BUREAU").distinct()
    known = per_account.join(listed, [REF, "SK_ID_BUREAU"], "left_semi")
    orphans = per_account.join(listed, [REF, "SK_ID_BUREAU"], "left_anti").groupBy(REF).agg(
        F.count(F.lit(1)).alias("_orphans"))
    months = aggregate(known, [REF], balance_rollup_features())
    return accounts.join(months, REF, "left").join(orphans, REF, "left")


def orphan_accounts(tradelines: DataFrame, dpd: DataFrame) -> DataFrame:
    """Monthly accounts that no tradeline names."""
    return dpd_by_account(dpd).select(REF, "SK_ID_BUREAU", "BB_MONTHS_OBSERVED").join(
        tradelines.select(REF, "SK_ID_BUREAU").distinct(), [REF, "SK_ID_BUREAU"], "left_anti")


def parse_months(sheet: DataFrame, kind: str) -> DataFrame:
    """Monthly rows of one account kind in the raw tables' columns."""
    numbers = {
        "dpd_days": "SK_DPD", "dpd_days_tolerant": "SK_DPD_DEF", "balance": "AMT_BALANCE",
        "credit_limit": "AMT_CREDIT_LIMIT_ACTUAL", "installments_total": "CNT_INSTALMENT",
        "installments_remaining": "CNT_INSTALMENT_FUTURE",
    }
    df = optional(sheet, ["account_ref", "account_kind", "contract_status", "months_ago", *numbers])
    return df.where(F.lower(F.trim("account_kind")) == kind).select(
        REF, F.col("account_ref").alias("SK_ID_PREV"), F.trim("contract_status").alias("NAME_CONTRACT_STATUS"),
        (-parse_number(F.col("months_ago"))).alias("MONTHS_BALANCE"),
        *[parse_number(F.col(n)).alias(c) for n, c in numbers.items()])


def revolving_block(months: DataFrame) -> DataFrame:
    return aggregate(parse_months(months, "revolving"), [REF], card_reported_features())


def installment_account_block(months: DataFrame) -> DataFrame:
    return aggregate(parse_months(months, "installment"), [REF], pos_features())


def enquiry_block(enquiries: DataFrame) -> DataFrame:
    days = parse_number(F.col("days_ago"))
    bands = {f"AMT_REQ_CREDIT_BUREAU_{n}": count_where((days > low) & (days <= high)).cast("double")
             for n, (low, high) in ENQUIRY_BANDS.items()}
    return aggregate(enquiries, [REF], {
        **bands, "_beyond": count_where(days > 365), "enquiry_count": F.count(F.lit(1))})


# ---------------------------------------------------------------- package

NUMBER_CELLS = {
    "tradelines": tuple(TRADELINE_NUMBERS),
    "dpd_history": ("months_ago",),
    "account_months": ("months_ago", "dpd_days", "dpd_days_tolerant", "balance", "credit_limit", "installments_total",
                       "installments_remaining"),
    "enquiries": ("days_ago",),
}


def sheet_violations(sheets: dict[str, DataFrame]) -> DataFrame:
    """One row per applicant with a cell in the optional sheets that must not be read as missing.

    Such cells are text where a number belongs, and account months without their kind.  A sheet has a fixed set of
    rules, so the collected set is small whatever the number of rows.
    """
    parts = []
    for name, numbers in NUMBER_CELLS.items():
        df = optional(sheets[name], [*numbers, "account_kind"])
        rules = [F.when(is_bad_number(F.col(n)), f"expected a number in {name}.{n}") for n in numbers]
        if name == "account_months":
            kind = F.lower(F.trim("account_kind"))
            rules.append(F.when(~F.coalesce(kind.isin("revolving", "installment"), F.lit(False)),
                                "account_months.account_kind must be revolving or installment"))
        parts.append(df.select(REF, F.explode(F.array_compact(F.array(*rules))).alias("rule")))
    return reduce(DataFrame.unionAll, parts).groupBy(REF).agg(F.sort_array(F.collect_set("rule")).alias("sheet_rules"))


def every_applicant(sheets: dict[str, DataFrame]) -> DataFrame:
    """Applicants named in any sheet."""
    return reduce(DataFrame.unionAll, [s.select(REF) for s in sheets.values()]).where(F.col(REF).isNotNull()).distinct()


def sheet_counts(sheet: DataFrame, name: str) -> DataFrame:
    return sheet.groupBy(REF).agg(F.count(F.lit(1)).alias(name))


def build_features(sheets: dict[str, DataFrame]) -> DataFrame:
    """One row per applicant: features, findings, evidence counters and violations.

    Applicants with violations keep their row (and their reasons) but are not scorable; absent families
    give NULL features and a zero flag, never zero features.  A package without an application sheet and one
    with unreadable cells are such violations.
    """
    parsed = parse_application(sheets["application"])
    none = F.array().cast("array<string>")
    application = every_applicant(sheets).join(parsed, REF, "left").join(sheet_violations(sheets), REF, "left").withColumns({
        "violations": F.concat(
            F.coalesce("violations", F.array(F.lit("missing required sheet: application"))), F.coalesce("sheet_rules", none)),
        "application_findings": F.coalesce("application_findings", none)}).drop("sheet_rules")
    tradelines = parse_tradelines(sheets["tradelines"])
    dpd = parse_dpd(sheets["dpd_history"])
    months = sheets["account_months"]
    blocks = {
        "HAS_BUREAU_HISTORY": report_block(tradelines, dpd),
        "HAS_CREDIT_CARD_HISTORY": revolving_block(months),
        "HAS_POS_HISTORY": installment_account_block(months),
    }
    out = application
    for flag_name, block in blocks.items():
        out = out.join(block.withColumn(flag_name, F.lit(1)), REF, "left")
    out = out.join(enquiry_block(sheets["enquiries"]), REF, "left")
    for sheet, name in ((tradelines, "tradeline_count"), (dpd, "dpd_month_count"), (months, "account_month_count")):
        out = out.join(sheet_counts(sheet, name), REF, "left")
    out = out.withColumns({f: F.coalesce(F.col(f), F.lit(0)) for f in blocks})
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in (
        "tradeline_count", "dpd_month_count", "account_month_count", "enquiry_count")})
    income, external = F.col("AMT_INCOME_TOTAL"), F.col("BUREAU_ANNUITY_SUM")
    out = out.withColumns({
        **term_ratios(),
        "EXTERNAL_DEBT_TO_INCOME": positive_ratio(F.col("BUREAU_DEBT_SUM"), income),
        "TOTAL_OBLIGATION_TO_INCOME": positive_ratio(
            F.when(external.isNotNull(), F.coalesce(F.col("AMT_ANNUITY"), F.lit(0.0)) + external), income),
    })
    report, card, pos = (F.col(f) == 1 for f in blocks)
    some_months = F.col("account_month_count") > 0
    findings = F.array_compact(F.concat(F.col("application_findings"), F.array(
        F.when(~report, "report.absent"),
        F.when(F.col("_unknown_status") > 0, "report.status_unknown"),
        F.when(report & (F.col("dpd_month_count") == 0), "report.months_absent"),
        F.when(F.col("_orphans") > 0, "report.months_orphaned"),
        F.when(~some_months, "months.absent"),
        F.when(some_months & ~card, "months.revolving_absent"),
        F.when(some_months & ~pos, "months.installment_absent"),
        F.when(F.col("enquiry_count") == 0, "enquiries.absent"),
        F.when(F.col("_beyond") > 0, "enquiries.too_old"),
    )))
    return out.withColumn("findings", findings).drop("application_findings", "_unknown_status", "_orphans", "_beyond")


def align(features: DataFrame, selected: Sequence[str]) -> DataFrame:
    """The model's column list in order: absent columns NULL, missing count over exactly these columns."""
    present = set(features.columns)
    out = features.select(REF, *[
        F.col(c) if c in present else F.lit(None).cast("double").alias(c)
        for c in selected if c != "APPLICATION_MISSING_COUNT"])
    supplied = sum(1 for c in selected if c in present)
    out = out.withColumn("features_supplied", F.lit(supplied))
    if "APPLICATION_MISSING_COUNT" in selected:
        counted = [c for c in selected if c != "APPLICATION_MISSING_COUNT"]
        out = out.withColumn("APPLICATION_MISSING_COUNT", missing_count(out, counted))
    return out


def families_supplied(features: DataFrame) -> DataFrame:
    """Named source families present and absent, and how many."""
    present = F.array_compact(F.array(*[F.when(F.col(f) == 1, label) for f, label in FAMILIES.items()]))
    absent = F.array_compact(F.array(*[F.when(F.col(f) != 1, label) for f, label in FAMILIES.items()]))
    return features.withColumns({
        "sources_present": present, "sources_absent": absent, "source_families": F.size(present)})


# What an expected field's absence looks like in the feature row.
def expected_gaps() -> Column:
    report, card, pos = (F.col(f) == 1 for f in FAMILIES)
    return F.array_compact(F.array(
        F.when(~report, "sheet.tradelines"),
        F.when(~card & ~pos, "sheet.account_months"),
        # A field of an absent family is reported by the family, not again on its own.
        F.when(report & F.col("BUREAU_DAYS_SINCE_CREDIT_MEAN").isNull(), "tradelines.opened_days_ago"),
        F.when(card & F.col("CC_UTILIZATION_MEAN").isNull(), "account_months.balance_and_limit"),
        F.when(F.col("AMT_GOODS_PRICE").isNull(), "application.goods_price")))


def affordability_gaps() -> Column:
    return F.array_compact(F.array(F.when(
        (F.col("HAS_BUREAU_HISTORY") == 1) & F.col("BUREAU_ANNUITY_SUM").isNull(), "tradelines.annuity")))


# ---------------------------------------------------------------- inverse job

_ENQUIRY_DAYS = {"HOUR": 0, "DAY": 1, "WEEK": 5, "MON": 20, "QRT": 70, "YEAR": 300}


def _text(c: Column) -> Column:
    return c.cast("string")


def export_sheets(tables: dict[str, DataFrame], application: DataFrame) -> dict[str, DataFrame]:
    """Raw tables -> intake sheets of all given applications (cells as text, full precision)."""
    ref = F.concat(F.lit("HC-"), F.col("SK_ID_CURR").cast("string")).alias(REF)
    direct = {n: c for n, c in APPLICATION_COLUMNS.items() if c in application.columns and n not in NUMBER_FLAGS}
    employed = F.col("DAYS_EMPLOYED")
    out = {"application": application.select(
        ref, *[_text(F.col(c)).alias(n) for n, c in direct.items()],
        _text(years_before(F.when(employed != NOT_EMPLOYED, employed))).alias("employment_years"),
        _text(years_before(F.col("DAYS_REGISTRATION"))).alias("address_vintage_years"),
        _text(years_before(F.col("DAYS_ID_PUBLISH"))).alias("id_document_age_years"),
        *[F.when(F.col(APPLICATION_COLUMNS[n]) == 1, "Y").otherwise("N").alias(n) for n in NUMBER_FLAGS])}
    ids = application.select("SK_ID_CURR")

    def of_ids(df: DataFrame) -> DataFrame:
        return df.join(ids, "SK_ID_CURR", "left_semi")

    bureau = of_ids(tables["bureau"])
    out["tradelines"] = bureau.select(
        ref, _text(F.col("SK_ID_BUREAU")).alias("account_ref"), F.col("CREDIT_TYPE").alias("credit_type"),
        F.col("CREDIT_ACTIVE").alias("status"), _text(-F.col("DAYS_CREDIT")).alias("opened_days_ago"),
        *[_text(F.col(c)).alias(n) for n, c in TRADELINE_NUMBERS.items() if c])
    out["dpd_history"] = tables["bureau_balance"].join(
        bureau.select("SK_ID_BUREAU", "SK_ID_CURR"), "SK_ID_BUREAU").select(
        ref, _text(F.col("SK_ID_BUREAU")).alias("account_ref"), _text(-F.col("MONTHS_BALANCE")).alias("months_ago"),
        F.col("STATUS").alias("status"))

    def months(df: DataFrame, prefix: str, kind: str) -> DataFrame:
        def cell(name: str) -> Column:
            return _text(F.col(name)) if name in df.columns else F.lit(None).cast("string")

        return of_ids(df).select(
            ref, F.concat(F.lit(prefix), _text(F.col("SK_ID_PREV"))).alias("account_ref"),
            F.lit(kind).alias("account_kind"), _text(-F.col("MONTHS_BALANCE")).alias("months_ago"),
            cell("SK_DPD").alias("dpd_days"), cell("SK_DPD_DEF").alias("dpd_days_tolerant"),
            F.col("NAME_CONTRACT_STATUS").alias("contract_status"), cell("AMT_BALANCE").alias("balance"),
            cell("AMT_CREDIT_LIMIT_ACTUAL").alias("credit_limit"),
            cell("CNT_INSTALMENT").alias("installments_total"),
            cell("CNT_INSTALMENT_FUTURE").alias("installments_remaining"))

    out["account_months"] = months(tables["credit_card_balance"], "CC-", "revolving").unionByName(
        months(tables["pos_cash_balance"], "POS-", "installment"))
    totals = F.array(*[F.struct(F.lit(str(day)).alias("days_ago"), F.col(f"AMT_REQ_CREDIT_BUREAU_{band}").cast("int").alias("n"))
                       for band, day in _ENQUIRY_DAYS.items()])
    dated = application.select(ref, F.explode(F.filter(totals, lambda t: t["n"] >= 1)).alias("t"))
    out["enquiries"] = dated.select(
        REF, F.explode(F.array_repeat("t.days_ago", F.col("t.n"))).alias("days_ago"), F.lit("Credit application").alias("purpose"))
    return out
