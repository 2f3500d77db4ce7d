"""Feature-store builds: write a version, gate the written data, then commit it.

The gate reads the written Parquet, so a store is computed once, nothing is cached, and a failed gate leaves
the previous version current.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import HISTORY_TABLES, contract_for
from ..operators.history import lifetime_features
from ..operators.ordering import attach
from ..operators.quality import assert_ready, gate, lifetime_findings, schema_check, temporal_findings
from ..operators.temporal import temporal_features
from ..sources.snapshots import Snapshots


def check_sources(tables: dict[str, DataFrame]) -> None:
    """Required columns of every raw table, from the schemas alone."""
    absent = [n for n in HISTORY_TABLES if n not in tables]
    if absent:
        raise FileNotFoundError(f"missing required history inputs: {', '.join(absent)}")
    broken = [r for r in (schema_check(tables[n], contract_for(n)) for n in HISTORY_TABLES)
              if r["missing_required"]]
    if broken:
        raise ValueError(f"source contracts are not met: {broken}")


def _build(spark: SparkSession, store: DataFrame, target: str, find) -> DataFrame:
    findings = []

    def gate_written(written: DataFrame) -> None:
        found = find(written)
        assert_ready(found)
        findings.append(spark.createDataFrame(found.collect(), found.schema))  # one row per check

    Snapshots(spark, target).commit(store, "SK_ID_CURR", gate_written)
    return findings[0]


def build_lifetime_store(spark: SparkSession, tables: dict[str, DataFrame], target: str) -> DataFrame:
    """Build, gate and commit the lifetime store; returns the findings."""
    check_sources(tables)
    return _build(spark, lifetime_features(tables), target, lambda written: lifetime_findings(
        written, tables["application_train"], tables["application_test"]))


def build_temporal_store(spark: SparkSession, tables: dict[str, DataFrame], target: str) -> DataFrame:
    """Build, gate and commit the temporal store; returns the findings."""
    check_sources(tables)
    return _build(spark, temporal_features(tables), target, lambda written: temporal_findings(written, tables))


def store_report(store: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON row: size, columns and gate outcome."""
    size = store.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(store.columns)))
    return attach(size, gate(findings)).select(F.to_json(F.struct("*")).alias("report"))
