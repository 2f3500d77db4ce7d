"""Profile of the labelled application table as delivered (all columns text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from .ordering import attach
from .quality import severity_rank

# Textual null markers, profiled columns, coded findings.
NULL_MARKERS = ("", "NA", "N/A", "NAN", "NULL", "NONE")
CRITICAL_COLUMNS = ("SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY")
NUMERIC_COLUMNS = (
    "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH", "DAYS_EMPLOYED",
    "CNT_FAM_MEMBERS", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
)
CATEGORY_COLUMNS = (
    "NAME_CONTRACT_TYPE", "CODE_GENDER", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_HOUSING_TYPE",
)
FINDINGS = (
    ("DQ-APP-001", "critical", "duplicate_keys"),
    ("DQ-APP-002", "critical", "missing_keys"),
    ("DQ-APP-003", "high", "invalid_targets"),
    ("DQ-APP-004", "medium", "employment_sentinels"),
    ("DQ-APP-005", "medium", "gender_unknown"),
    ("DQ-APP-006", "high", "nonpositive_income"),
    ("DQ-APP-007", "high", "nonpositive_credit"),
    ("DQ-APP-008", "high", "nonpositive_annuity"),
)


def is_null_text(c: Column) -> Column:
    return c.isNull() | F.upper(F.trim(c)).isin(*NULL_MARKERS)


def number(c: Column) -> Column:
    """Numeric value of a text cell; NULL for null markers and for anything that is not a number."""
    return F.when(~is_null_text(c), F.trim(c).try_cast("double"))


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def check_columns(df: DataFrame) -> None:
    missing = sorted(set(CRITICAL_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError("application table is missing critical columns: " + ", ".join(missing))


def counters(df: DataFrame) -> DataFrame:
    """Row, key, target and anomaly counters in one aggregate."""
    check_columns(df)
    key = F.coalesce(F.trim("SK_ID_CURR"), F.lit(""))
    target = F.coalesce(F.trim("TARGET"), F.lit(""))
    real_key = F.when(key != "", key)

    def nonpositive(name: str) -> Column:
        value = number(F.col(name))
        return F.count_if(~F.isnan(value) & (value <= 0))

    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(real_key).alias("unique_keys"),
        (F.count(real_key) - F.countDistinct(real_key)).alias("duplicate_keys"),
        F.count_if(key == "").alias("missing_keys"),
        F.count_if(target == "0").alias("target_0"),
        F.count_if(target == "1").alias("target_1"),
        F.count_if(~target.isin("0", "1")).alias("invalid_targets"),
        F.count_if(F.trim("DAYS_EMPLOYED").isin("365243", "365243.0")).alias("employment_sentinels"),
        F.count_if(F.upper(F.trim("CODE_GENDER")) == "XNA").alias("gender_unknown"),
        nonpositive("AMT_INCOME_TOTAL").alias("nonpositive_income"),
        nonpositive("AMT_CREDIT").alias("nonpositive_credit"),
        nonpositive("AMT_ANNUITY").alias("nonpositive_annuity"),
    )


def findings(counts: DataFrame) -> DataFrame:
    """Coded findings with a count above zero."""
    rows = F.array(*[
        F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(name).alias("count"))
        for code, severity, name in FINDINGS])
    return counts.select("rows", F.explode(rows).alias("f")).select(
        "f.*", ratio(F.col("f.count"), F.col("rows")).alias("rate")).where("count > 0")


def summary(df: DataFrame) -> DataFrame:
    counts = counters(df)
    worst = findings(counts).agg(
        F.coalesce(F.max_by("severity", severity_rank(F.col("severity"))), F.lit("none")).alias("maximum_severity"))
    return attach(counts, worst).select(
        "rows", "unique_keys", "duplicate_keys", "target_0", "target_1", F.col("invalid_targets").alias("target_other"),
        ratio(F.col("target_1"), F.col("rows")).alias("target_prevalence"), "maximum_severity",
        (~F.col("maximum_severity").isin("critical", "high")).alias("ready_for_modeling"))


def missingness(df: DataFrame) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(is_null_text(F.col(c))).alias("missing"))
             for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.array(*parts).alias("p")).select(
        "rows", F.explode("p").alias("p")).select(
        "p.column", "p.missing", ratio(F.col("p.missing"), F.col("rows")).alias("missing_rate"),
        (ratio(F.col("p.missing"), F.col("rows")) >= 0.5).alias("mostly_missing"))


def numeric_profile(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Count, unusable cells, range, mean and sample deviation (0.0 for a single value)."""
    parts = []
    for name in (c for c in columns if c in df.columns):
        raw, value = F.col(name), number(F.col(name))
        good = F.when(_finite(value), value)
        n = F.count(good)
        parts.append(F.struct(
            F.lit(name).alias("column"), n.alias("count"),
            F.count_if(~is_null_text(raw) & ~_finite(value)).alias("invalid_count"),
            F.min(good).alias("minimum"), F.max(good).alias("maximum"), F.avg(good).alias("mean"),
            F.when(n > 0, F.coalesce(F.stddev_samp(good), F.lit(0.0))).alias("standard_deviation")))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def category_profile(df: DataFrame, columns: Sequence[str] = CATEGORY_COLUMNS) -> DataFrame:
    """Frequency of every level, ``<missing>`` for null markers."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.when(is_null_text(F.col(c)), "<missing>").otherwise(F.trim(c)).alias("level"))
        for c in columns if c in df.columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.level").agg(
        F.count(F.lit(1)).alias("count"))
