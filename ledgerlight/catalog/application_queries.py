"""Application engineering, ratios, selection, splits and the delivered-table profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import application as A
from ..operators import profile as R
from ..operators.fairness import protected_controls
from ..operators.history import bureau_block
from ..operators.splits import assign_splits, overlap_count
from ..operators.temporal import temporal_features
from ..session import spread
from ..sources.roles import APPLICATION_COLUMNS, ROLES, history_roles, role, with_roles
from .common import Spec, present, r6, register
from .history_queries import _BB_CTE, _BUREAU_CTE
from .temporal_queries import TEMPORAL_CTE, TEMPORAL_ROLES

_POS = "CASE WHEN {d} > 0 THEN ({n}) / {d} END"
ENGINEERED = Spec.parse("\n".join([
    "i EMPLOYMENT_SENTINEL = CAST(DAYS_EMPLOYED = 365243 AS INT)",
    "f EMPLOYMENT_YEARS = CASE WHEN DAYS_EMPLOYED <> 365243 THEN -DAYS_EMPLOYED / 365.25::DOUBLE END",
    "f REGISTRATION_YEARS = -DAYS_REGISTRATION / 365.25::DOUBLE",
    "f ID_AGE_YEARS = -DAYS_ID_PUBLISH / 365.25::DOUBLE",
    "f PHONE_CHANGE_YEARS = -DAYS_LAST_PHONE_CHANGE / 365.25::DOUBLE",
    "f CREDIT_TO_INCOME = " + _POS.format(n="AMT_CREDIT", d="AMT_INCOME_TOTAL"),
    "f ANNUITY_TO_INCOME = " + _POS.format(n="AMT_ANNUITY", d="AMT_INCOME_TOTAL"),
    "f CREDIT_TO_ANNUITY = " + _POS.format(n="AMT_CREDIT", d="AMT_ANNUITY"),
    "f CREDIT_TO_GOODS = " + _POS.format(n="AMT_CREDIT", d="AMT_GOODS_PRICE"),
    "f DOWN_PAYMENT_RATE = " + _POS.format(n="AMT_GOODS_PRICE - AMT_CREDIT", d="AMT_GOODS_PRICE"),
    "f EXT_SOURCE_MEAN = list_avg([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3])",
    "f EXT_SOURCE_MIN = list_min([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3])",
    "f EXT_SOURCE_MAX = list_max([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3])",
    "f EXT_SOURCE_STD = list_aggregate([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3], 'stddev_samp')",
    "i EXT_SOURCE_COUNT = list_count([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3])",
]))
_DROPPED = ("DAYS_EMPLOYED", "DAYS_REGISTRATION", "DAYS_ID_PUBLISH", "DAYS_LAST_PHONE_CHANGE")
_KEPT = [n for n, _ in APPLICATION_COLUMNS if n not in _DROPPED]
_ALL = _KEPT + [n for _, n, _ in ENGINEERED.items]
_TEXT = {"CODE_GENDER", "OCCUPATION_TYPE", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"}
ALL_COLUMNS = [*_ALL, "APPLICATION_MISSING_COUNT"]
_INT = {"SK_ID_CURR", "TARGET", "DAYS_BIRTH", "CNT_CHILDREN", "REGION_RATING_CLIENT", "FLAG_MOBIL", "FLAG_EMAIL",
        "FLAG_WORK_PHONE"}


def column_kind(name: str) -> str:
    if name in _TEXT or name.startswith("NAME_"):
        return "t"
    return "i" if name in _INT else "f"


ENGINEERED_CTE = f"""engineered AS (
  SELECT *, {" + ".join(f"CAST({n} IS NULL AS INT)" for n in _ALL)} AS APPLICATION_MISSING_COUNT
  FROM (SELECT *, {ENGINEERED.select()} FROM application_train))"""
_KINDS = [(column_kind(n), n) for n in _KEPT] + [(k, n) for k, n, _ in ENGINEERED.items] + [("i", "APPLICATION_MISSING_COUNT")]


@register("application_features", with_roles(
    f"SELECT {', '.join(present(k, n, n) for k, n in _KINDS)} FROM engineered", "application_train",
    ctes=ENGINEERED_CTE))
def application_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.engineer(role(spark, sf, "application_train")))


_COUNTED = ("AMT_ANNUITY", "AMT_GOODS_PRICE", "OWN_CAR_AGE", "EMPLOYMENT_YEARS", "CREDIT_TO_GOODS",
            "AMT_REQ_CREDIT_BUREAU_MON")


@register("missing_count_over_model_columns", with_roles(
    f"SELECT SK_ID_CURR, CAST({' + '.join(f'CAST({n} IS NULL AS INT)' for n in _COUNTED)} AS BIGINT)"
    " AS APPLICATION_MISSING_COUNT FROM engineered", "application_train", ctes=ENGINEERED_CTE))
def missing_count_over_model_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = A.engineer(role(spark, sf, "application_train"))
    return rounded(A.recount_missing(df, _COUNTED).select("SK_ID_CURR", "APPLICATION_MISSING_COUNT"))


@register("obligation_ratios", with_roles(
    f"""SELECT SK_ID_CURR, {r6("CASE WHEN BUREAU_ANNUITY_SUM IS NOT NULL AND AMT_INCOME_TOTAL > 0 THEN (coalesce(AMT_ANNUITY, 0) + BUREAU_ANNUITY_SUM) / AMT_INCOME_TOTAL END")} AS TOTAL_OBLIGATION_TO_INCOME,
      {r6("BUREAU_DEBT_SUM / AMT_INCOME_TOTAL")} AS EXTERNAL_DEBT_TO_INCOME
    FROM application_train LEFT JOIN bureau_rollup USING (SK_ID_CURR)""",
    "application_train", "bureau", "bureau_balance", ctes=f"{_BB_CTE},\n{_BUREAU_CTE}"))
def obligation_ratios(spark: SparkSession, sf: str) -> DataFrame:
    history = bureau_block(role(spark, sf, "bureau"), role(spark, sf, "bureau_balance"))
    df = role(spark, sf, "application_train").join(history, "SK_ID_CURR", "left")
    return rounded(A.obligation_ratios(df).select(
        "SK_ID_CURR", "TOTAL_OBLIGATION_TO_INCOME", "EXTERNAL_DEBT_TO_INCOME"))


_BURDEN = Spec.parse("""
f BURDEN_ACTIVE_ANNUITY_TO_INCOME = TBUREAU_ACTIVE_ANNUITY_SUM / AMT_INCOME_TOTAL
f BURDEN_ACTIVE_DEBT_TO_INCOME = TBUREAU_ACTIVE_DEBT_SUM / AMT_INCOME_TOTAL
f BURDEN_PROPOSED_PLUS_ACTIVE_ANNUITY_TO_INCOME = (AMT_ANNUITY + TBUREAU_ACTIVE_ANNUITY_SUM) / AMT_INCOME_TOTAL
f BURDEN_REQUESTED_PLUS_ACTIVE_DEBT_TO_INCOME = (AMT_CREDIT + TBUREAU_ACTIVE_DEBT_SUM) / AMT_INCOME_TOTAL
i BURDEN_TEMPORAL_SOURCE_COUNT = HAS_TEMPORAL_INSTALLMENTS + HAS_TEMPORAL_PREVIOUS + HAS_TEMPORAL_POS + HAS_TEMPORAL_CREDIT_CARD + HAS_TEMPORAL_BUREAU
f CYCLING_SIGNAL_BURDEN_INTERACTION = CYCLING_SIGNAL_FAMILY_COUNT * (AMT_ANNUITY + TBUREAU_ACTIVE_ANNUITY_SUM) / AMT_INCOME_TOTAL
""")


@register("cross_source_burden", with_roles(
    f"SELECT SK_ID_CURR, {_BURDEN.present()} FROM (SELECT SK_ID_CURR, {_BURDEN.select()}"
    " FROM application_train JOIN temporal_store USING (SK_ID_CURR))", *TEMPORAL_ROLES, ctes=TEMPORAL_CTE))
def cross_source_burden(spark: SparkSession, sf: str) -> DataFrame:
    tables = history_roles(spark, sf)
    joined = tables["application_train"].join(temporal_features(tables), "SK_ID_CURR")
    return rounded(A.burden_features(joined).select("SK_ID_CURR", *[n for _, n, _ in _BURDEN.items]))


# ---------------------------------------------------------------- splits and selection

SPLIT_CTE = """hashed AS (
  SELECT SK_ID_CURR, TARGET, ('0x' || substr(md5(concat(SK_ID_CURR::VARCHAR, ':42')), 1, 12))::BIGINT AS h FROM application_train),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY h, SK_ID_CURR) AS r, count(*) OVER (PARTITION BY TARGET) AS n FROM hashed),
parts AS (SELECT *, (n * 70) // 100 AS dev, (n * 85) // 100 AS upto FROM placed),
splits AS (
  SELECT SK_ID_CURR, TARGET,
    CASE WHEN r <= dev THEN 'development' WHEN r <= upto THEN 'calibration' ELSE 'holdout' END AS split,
    CASE WHEN r <= dev THEN CASE WHEN r * 100 <= dev * 85 THEN 'fit' ELSE 'early_stop' END END AS tuning_role,
    CASE WHEN r > dev AND r <= upto THEN CASE WHEN (r - dev) * 2 <= upto - dev THEN 'calibrator_fit'
      ELSE 'calibrator_evaluation' END END AS calibration_role
  FROM parts)"""


@register("stratified_splits", with_roles(
    "SELECT SK_ID_CURR, CAST(TARGET AS BIGINT) AS TARGET, split, tuning_role, calibration_role FROM splits",
    "application_train", ctes=SPLIT_CTE))
def stratified_splits(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assign_splits(role(spark, sf, "application_train")))


@register("split_summary", with_roles(
    f"SELECT split, count(*) AS rows, sum(TARGET)::BIGINT AS target_count, {r6('avg(TARGET)')} AS target_rate FROM splits GROUP BY split",
    "application_train", ctes=SPLIT_CTE))
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assign_splits(role(spark, sf, "application_train")).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("TARGET").alias("target_count"), F.avg("TARGET").alias("target_rate")))


@register("sealed_holdout_overlap", with_roles(
    "SELECT count(*) AS shared_keys FROM splits a JOIN splits b USING (SK_ID_CURR) WHERE a.split = 'holdout' AND b.split <> 'holdout'",
    "application_train", ctes=SPLIT_CTE))
def sealed_holdout_overlap(spark: SparkSession, sf: str) -> DataFrame:
    splits = assign_splits(role(spark, sf, "application_train"))
    return overlap_count(splits.where("split = 'holdout'"), splits.where("split <> 'holdout'"))


def development_rows(spark: SparkSession, sf: str) -> DataFrame:
    train = role(spark, sf, "application_train")
    chosen = assign_splits(train).where("split = 'development'").select("SK_ID_CURR")
    return A.engineer(spread(train)).join(chosen, "SK_ID_CURR", "left_semi")


def _inventory_sql() -> str:
    parts = []
    for name in ALL_COLUMNS:
        kind = "categorical" if column_kind(name) == "t" else "numeric"
        parts.append(
            f"SELECT '{name}' AS feature, '{kind}' AS kind, count(*) FILTER ({name} IS NULL) / count(*)::DOUBLE AS missing_rate,"
            f" count(DISTINCT {name}) + CAST(count(*) > count({name}) AS INT) <= 1 AS constant,"
            f" {'true' if A.excluded_by_policy(name) else 'false'} AS barred FROM dev")
    return " UNION ALL ".join(parts)


INVENTORY_CTE = f"""{SPLIT_CTE},
{ENGINEERED_CTE},
dev AS (SELECT * FROM engineered WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM splits WHERE split = 'development')),
inventory AS (SELECT feature, kind, missing_rate, CASE WHEN barred THEN 'excluded_by_policy'
  WHEN missing_rate > 0.75 THEN 'excluded_high_missingness' WHEN constant THEN 'excluded_constant' ELSE 'selected' END AS status
  FROM ({_inventory_sql()}))"""


@register("feature_selection", with_roles(
    f"SELECT feature, kind, {r6('missing_rate')} AS missing_rate, status FROM inventory", "application_train",
    ctes=INVENTORY_CTE))
def feature_selection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.feature_inventory(development_rows(spark, sf)))


_VARIANT_SQL = {
    "v1_reference": "true",
    "v1_no_external_score": "NOT starts_with(feature, 'EXT_SOURCE')",
    "v3_core": "feature IN (" + ", ".join(f"'{n}'" for n in A.DECLARED + A.COMPUTED) + ", 'HAS_BUREAU_HISTORY')"
               " OR regexp_matches(feature, '^(BUREAU_|BB_|AMT_REQ_CREDIT_BUREAU_)')",
}


@register("variant_columns", with_roles(
    " UNION ALL ".join(f"SELECT '{v}' AS variant, feature, kind FROM inventory WHERE status = 'selected' AND ({t})"
                       for v, t in _VARIANT_SQL.items()), "application_train", ctes=INVENTORY_CTE))
def variant_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Which selected features each variant keeps."""
    inventory = A.feature_inventory(development_rows(spark, sf)).where("status = 'selected'")
    names = ALL_COLUMNS
    kept = F.array(*[
        F.when(F.col("feature").isin(*[n for n in names if A.VARIANTS[v](n)]), v) for v in _VARIANT_SQL])
    return inventory.select(F.explode(F.array_compact(kept)).alias("variant"), "feature", "kind")


@register("protected_field_controls", with_roles(
    """SELECT feature, status = 'selected' AS selected_for_prediction, status = 'excluded_by_policy' AS excluded_by_policy
    FROM inventory WHERE feature IN ('CODE_GENDER', 'DAYS_BIRTH')""", "application_train", ctes=INVENTORY_CTE))
def protected_field_controls(spark: SparkSession, sf: str) -> DataFrame:
    return protected_controls(A.feature_inventory(development_rows(spark, sf)))


# ---------------------------------------------------------------- profile of the delivered table

_NULL = "({c} IS NULL OR upper(trim({c})) IN ('', 'NA', 'N/A', 'NAN', 'NULL', 'NONE'))"


def _num(c: str) -> str:
    return f"CASE WHEN NOT {_NULL.format(c=c)} THEN try_cast(trim({c}) AS DOUBLE) END"


def _bad(c: str) -> str:
    return f"count(*) FILTER (NOT isnan({_num(c)}) AND {_num(c)} <= 0)"


_COUNTS_CTE = f"""counts AS (
  SELECT count(*) AS rows, count(DISTINCT nullif(trim(SK_ID_CURR), '')) AS unique_keys,
    count(nullif(trim(SK_ID_CURR), '')) - count(DISTINCT nullif(trim(SK_ID_CURR), '')) AS duplicate_keys,
    count(*) FILTER (coalesce(trim(SK_ID_CURR), '') = '') AS missing_keys,
    count(*) FILTER (trim(TARGET) = '0') AS target_0, count(*) FILTER (trim(TARGET) = '1') AS target_1,
    count(*) FILTER (coalesce(trim(TARGET), '') NOT IN ('0', '1')) AS invalid_targets,
    count(*) FILTER (trim(DAYS_EMPLOYED) IN ('365243', '365243.0')) AS employment_sentinels,
    count(*) FILTER (upper(trim(CODE_GENDER)) = 'XNA') AS gender_unknown,
    {_bad('AMT_INCOME_TOTAL')} AS nonpositive_income, {_bad('AMT_CREDIT')} AS nonpositive_credit,
    {_bad('AMT_ANNUITY')} AS nonpositive_annuity
  FROM application_text),
found AS (SELECT * FROM ({" UNION ALL ".join(
    f"SELECT '{code}' AS code, '{sev}' AS severity, {name} AS count, {name} / rows::DOUBLE AS rate FROM counts"
    for code, sev, name in R.FINDINGS)}) WHERE count > 0)"""


@register("profile_findings", with_roles(
    f"SELECT code, severity, count, {r6('rate')} AS rate FROM found", "application_text", ctes=_COUNTS_CTE))
def profile_findings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.findings(R.counters(role(spark, sf, "application_text"))))


@register("profile_summary", with_roles(
    f"""SELECT rows, unique_keys, duplicate_keys, target_0, target_1, invalid_targets AS target_other,
      {r6('target_1 / rows::DOUBLE')} AS target_prevalence,
      CASE (SELECT max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) FROM found)
        WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS maximum_severity,
      NOT EXISTS (SELECT 1 FROM found WHERE severity IN ('critical', 'high')) AS ready_for_modeling
    FROM counts""", "application_text", ctes=_COUNTS_CTE))
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.summary(role(spark, sf, "application_text")))


_TEXT_COLUMNS = [n for n, _ in ROLES["application_text"][2]]


@register("profile_missingness", with_roles(
    f"SELECT \"column\", missing, {r6('missing_rate')} AS missing_rate, missing_rate >= 0.5 AS mostly_missing FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({_NULL.format(c=c)}) AS missing,"
        f" count(*) FILTER ({_NULL.format(c=c)}) / count(*)::DOUBLE AS missing_rate FROM application_text"
        for c in _TEXT_COLUMNS) + ")", "application_text"))
def profile_missingness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.missingness(role(spark, sf, "application_text")))


@register("profile_numeric", with_roles(
    f"""SELECT "column", count(*) FILTER (isfinite(v)) AS count, count(*) FILTER (NOT empty AND NOT coalesce(isfinite(v), false)) AS invalid_count,
      {r6('min(v) FILTER (isfinite(v))')} AS minimum, {r6('max(v) FILTER (isfinite(v))')} AS maximum,
      {r6('avg(v) FILTER (isfinite(v))')} AS mean, {r6('stddev_samp(v) FILTER (isfinite(v))')} AS standard_deviation
    FROM (""" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_num(c)} AS v, {_NULL.format(c=c)} AS empty FROM application_text"
        for c in R.NUMERIC_COLUMNS) + ') GROUP BY "column"', "application_text"))
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.numeric_profile(role(spark, sf, "application_text")))


@register("profile_categories", with_roles(
    'SELECT "column", level, count(*) AS count FROM (' + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN {_NULL.format(c=c)} THEN '<missing>' ELSE trim({c}) END AS level FROM application_text"
        for c in R.CATEGORY_COLUMNS) + ") GROUP BY ALL", "application_text"))
def profile_categories(spark: SparkSession, sf: str) -> DataFrame:
    return R.category_profile(role(spark, sf, "application_text"))
