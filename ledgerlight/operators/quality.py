"""Quality gates over feature stores, contract checks over sources.

A gate reads the store once: all columns are profiled in a single aggregate and turned into one row per
column afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import CONTRACTS, SourceContract
from ..functions.expressions import count_where
from .history import KEY
from .ordering import attach

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
SEVERITY_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def lifetime_rate(name: str) -> bool:
    return name.endswith("_RATE")


def lifetime_count(name: str) -> bool:
    return "COUNT" in name or name.endswith("_MONTHS_OBSERVED") or name.startswith("HAS_")


def temporal_rate(name: str) -> bool:
    return "_RATE_" in name or name.endswith("_RATE")


def temporal_count(name: str) -> bool:
    return any(t in name for t in ("COUNT", "STREAK", "CONSECUTIVE")) or name.endswith("_FLAG")


def long_columns(df: DataFrame) -> DataFrame:
    """``(position, value)`` rows of a wide table: numbers as doubles, other types as a hash, NULL kept.

    One narrow aggregate over these rows replaces one very wide aggregate over the table, which would
    be too large to compile; the rows collapse to one per column before the shuffle.
    """
    values = []
    for field in df.schema.fields:
        c = F.col(field.name)
        numeric = isinstance(field.dataType, (*NUMERIC, T.BooleanType))
        values.append(c.cast("double") if numeric else F.when(c.isNotNull(), F.xxhash64(c).cast("double")))
    return df.select(F.posexplode(F.array(*values)).alias("_pos", "value"))


def by_position(flags: Iterable, position: Column) -> Column:
    """Literal looked up by column position."""
    return F.element_at(F.array(*[F.lit(f) for f in flags]), position + 1)


def column_report(store: DataFrame, is_rate: Callable[[str], bool], is_count: Callable[[str], bool]) -> DataFrame:
    """One row per column: missing, minimum, maximum, rates outside [0, 1], negative counts, non-finite values."""
    fields = store.schema.fields
    numeric = [isinstance(f.dataType, NUMERIC) for f in fields]
    rates = [n and is_rate(f.name) for n, f in zip(numeric, fields, strict=True)]
    counts = [n and is_count(f.name) for n, f in zip(numeric, fields, strict=True)]
    v, zero = F.col("value"), F.lit(0).cast("bigint")
    infinite = F.lit(float("inf"))
    table = long_columns(store).groupBy("_pos").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(v.isNull()).alias("null_count"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        F.count_if(v < 0).alias("_below"), F.count_if(v > 1).alias("_above"),
        F.count_if(F.isnan(v) | (F.abs(v) == infinite)).alias("_wild"))
    known = by_position(numeric, F.col("_pos"))
    return table.select(
        by_position([f.name for f in fields], F.col("_pos")).alias("column"),
        "null_count", (F.col("null_count") / F.nullif("rows", F.lit(0))).alias("null_rate"),
        F.when(known, F.col("minimum")).alias("minimum"), F.when(known, F.col("maximum")).alias("maximum"),
        F.when(by_position(rates, F.col("_pos")), F.col("_below") + F.col("_above")).otherwise(zero)
        .alias("rate_violations"),
        F.when(by_position(counts, F.col("_pos")), F.col("_below")).otherwise(zero).alias("negative_rows"),
        F.when(known, F.col("_wild")).otherwise(zero).alias("non_finite_rows"))


def top_missing(report: DataFrame, top: int = 20, key: str = KEY) -> DataFrame:
    """The most incomplete features of the report (a top-k over the column list)."""
    return report.where(F.col("column") != key).orderBy(F.col("null_rate").desc(), "column").limit(top).select(
        "column", "null_count", "null_rate")


def cardinality(store: DataFrame, train: DataFrame, test: DataFrame, key: str = KEY) -> DataFrame:
    expected = train.select(key).unionAll(test.select(key)).agg(F.count(F.lit(1)).alias("expected_rows"))
    seen = store.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("unique_keys"),
        F.count_if(F.col(key).isNull()).alias("null_keys"))
    return attach(seen, expected)


def availability_coverage(store: DataFrame, flags: Iterable[str]) -> DataFrame:
    parts = [F.struct(F.lit(f).alias("flag"), F.sum(f).alias("rows"), F.avg(f).alias("rate")) for f in flags]
    return store.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def target_rate_by_availability(store: DataFrame, labelled: DataFrame, flags: Iterable[str], key: str = KEY) -> DataFrame:
    """Target rate where a source is present and where it is not."""
    joined = labelled.select(key, "TARGET").join(store.select(key, *flags), key)
    pairs = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("available")) for f in flags])
    return joined.select("TARGET", F.explode(pairs).alias("p")).groupBy("p.flag", "p.available").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("TARGET").alias("target_rate"))


def future_event_bounds(tables: dict[str, DataFrame]) -> DataFrame:
    """Latest relative day or month of each source; anything above zero lies after the application."""
    sources = (
        ("installment_due_max", "installments_payments", "DAYS_INSTALMENT"),
        ("installment_payment_max", "installments_payments", "DAYS_ENTRY_PAYMENT"),
        ("previous_decision_max", "previous_application", "DAYS_DECISION"),
        ("pos_month_max", "pos_cash_balance", "MONTHS_BALANCE"),
        ("credit_card_month_max", "credit_card_balance", "MONTHS_BALANCE"),
        ("bureau_credit_day_max", "bureau", "DAYS_CREDIT"),
    )
    parts = [
        tables[table].agg(F.max(column).cast("bigint").alias("latest")).select(F.lit(name).alias("source"), "latest")
        for name, table, column in sources]
    return reduce(DataFrame.unionAll, parts).withColumn("in_future", F.coalesce(F.col("latest") > 0, F.lit(False)))


def _finding(check: str, severity: str, failed: Column, evidence: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"),
        F.coalesce(failed, F.lit(False)).alias("failed"), evidence.cast("bigint").alias("evidence"))


def _report_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.sum("rate_violations").alias("bad_rates"), F.sum("negative_rows").alias("bad_counts"),
        F.sum("non_finite_rows").alias("bad_floats"),
        F.coalesce(F.max(F.col("column") == "TARGET"), F.lit(False)).alias("has_target"))


def lifetime_findings(store: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """All declared checks of the lifetime store with their outcome."""
    facts = attach(
        _report_totals(column_report(store, lifetime_rate, lifetime_count)), cardinality(store, train, test))
    rows, unique, nulls, expected = (F.col(c) for c in ("rows", "unique_keys", "null_keys", "expected_rows"))
    checks = F.array(
        _finding("application_row_reconciliation", "critical", rows != expected, rows - expected),
        _finding("primary_key_uniqueness", "critical", (rows != unique) | (nulls > 0), rows - unique + nulls),
        _finding("target_column_absent", "critical", F.col("has_target"), F.col("has_target").cast("int")),
        _finding("bounded_rate_validity", "high", F.col("bad_rates") > 0, F.col("bad_rates")),
        _finding("nonnegative_count_validity", "high", F.col("bad_counts") > 0, F.col("bad_counts")),
        _finding("finite_numeric_values", "high", F.col("bad_floats") > 0, F.col("bad_floats")),
    )
    return facts.select(F.explode(checks).alias("c")).select("c.*")


def temporal_findings(store: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    families, multi = F.col("CYCLING_SIGNAL_FAMILY_COUNT"), F.col("CYCLING_MULTI_SIGNAL_FLAG")
    cycling = store.agg(
        (F.count_if((families < 0) | (families > 5)) + F.count_if(~multi.isin(0, 1))).alias("bad_cycling"))
    future = future_event_bounds(tables).agg(F.count_if("in_future").alias("future_sources"))
    facts = _report_totals(column_report(store, temporal_rate, temporal_count))
    for part in (cardinality(store, tables["application_train"], tables["application_test"]), cycling, future):
        facts = attach(facts, part)
    rows, unique, expected = F.col("rows"), F.col("unique_keys"), F.col("expected_rows")
    checks = F.array(
        _finding("application_grain_reconciliation", "critical", (rows != unique) | (rows != expected),
                 rows - expected),
        _finding("target_leakage", "critical", F.col("has_target"), F.col("has_target").cast("int")),
        _finding("future_relative_events", "critical", F.col("future_sources") > 0, F.col("future_sources")),
        _finding("bounded_rates", "high", F.col("bad_rates") > 0, F.col("bad_rates")),
        _finding("nonnegative_features", "high", F.col("bad_counts") > 0, F.col("bad_counts")),
        _finding("finite_features", "high", F.col("bad_floats") > 0, F.col("bad_floats")),
        _finding("cycling_bounds", "high", F.col("bad_cycling") > 0, F.col("bad_cycling")),
    )
    return facts.select(F.explode(checks).alias("c")).select("c.*")


def severity_rank(severity: Column) -> Column:
    out = None
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank) if out is None else out.when(severity == name, rank)
    return out.otherwise(0)


def gate(findings: DataFrame) -> DataFrame:
    """One row: number of failed checks, worst severity, ready flag."""
    worst = F.coalesce(F.max_by(F.col("severity"), F.when(F.col("failed"), severity_rank(F.col("severity")))),
                       F.lit("none"))
    return findings.agg(
        F.count_if("failed").alias("failed_checks"), worst.alias("maximum_severity")
    ).withColumn("ready", ~F.col("maximum_severity").isin("critical", "high"))


def assert_ready(findings: DataFrame) -> None:
    """Raise with the failed checks' names (the findings hold one row per declared check)."""
    failed = [r.check for r in findings.where("failed AND severity IN ('critical', 'high')").collect()]
    if failed:
        raise ValueError(f"quality gate failed: {', '.join(failed)}")


# ---------------------------------------------------------------- contracts and equality

def schema_check(df: DataFrame, contract: SourceContract) -> dict:
    """Required columns and minimum width, from the schema alone."""
    missing = sorted(set(contract.required) - set(df.columns))
    wide = len(df.columns) >= contract.min_columns
    return {"table": contract.table, "missing_required": missing, "columns": len(df.columns),
            "valid": not missing and wide}


def key_violations(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*key).count().where("count > 1")


def orphans(child: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """Child keys without a parent and how many child rows carry them (keys are counted before the join)."""
    keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(
        F.count(F.lit(1)).alias("rows"))
    return keys.join(parents.select(F.col(parent_column).alias("_key")).distinct(), "_key", "left_anti")


def contract_checks(tables: dict[str, DataFrame], contracts: Iterable[SourceContract] = CONTRACTS) -> DataFrame:
    """Declared keys and references of every table: one row per check."""
    applications = tables["application_train"].select(KEY).unionAll(tables["application_test"].select(KEY))
    parents = {**tables, "application": applications}
    parts = []
    for contract in contracts:
        if contract.table not in tables:
            continue
        df = tables[contract.table]
        if contract.key:
            parts.append(key_violations(df, contract.key).agg(
                F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")
            ).select(F.lit(contract.table).alias("table"), F.lit("duplicate_key").alias("check"),
                     F.lit(",".join(contract.key)).alias("columns"), "keys", "rows"))
        for column, parent, parent_column in contract.references:
            parts.append(orphans(df, column, parents[parent], parent_column).agg(
                F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")
            ).select(F.lit(contract.table).alias("table"), F.lit(f"orphan_of_{parent}").alias("check"),
                     F.lit(column).alias("columns"), "keys", "rows"))
    return reduce(DataFrame.unionAll, parts)


def equality_check(left: DataFrame, right: DataFrame, key: str, columns: Iterable[str],
                   tolerance: float = 1e-9) -> DataFrame:
    """Same entity by two paths: per column the largest difference and how many rows disagree.

    A full outer join on the key; a value known on one side only is a mismatch.
    """
    columns = list(columns)
    a = left.select(key, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns])
    b = right.select(key, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns])
    joined = a.join(b, key, "full_outer")
    parts = []
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        gap = F.abs(x - y) / F.greatest(F.lit(1.0), F.abs(x))
        differs = (x.isNull() != y.isNull()) | (gap > tolerance)
        parts.append(F.struct(
            F.lit(c).alias("column"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_difference"),
            F.count_if(F.coalesce(differs, F.lit(False))).alias("mismatches"),
            F.count(x).alias("compared")))
    return joined.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
