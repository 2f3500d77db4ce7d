"""Store gates, coverage, source bounds and contract checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import CONTRACTS, contract_for
from ..functions.expressions import rounded
from ..operators import quality as G
from ..operators.history import HISTORY_FLAGS, bureau_block, lifetime_features
from ..operators.temporal import temporal_features
from ..operators.manifest import build_manifest, file_digests
from ..session import cut_lineage, stage_folder
from ..sources.roles import ROLES, history_roles, role, with_roles
from ..sources.snapshots import Snapshots
from ..sources.tables import check_csv_table, read_store
from .common import r6, register
from .history_queries import _BB_CTE, _BUREAU_CTE, ALL_ROLES, BLOCKS, BUREAU, STORE_CTE
from .temporal_queries import STORE as TEMPORAL_STORE
from .temporal_queries import TEMPORAL_CTE, TEMPORAL_ROLES

LIFETIME_COLUMNS = [("i", "SK_ID_CURR")] + [("i", f) for f, _, _ in BLOCKS] + [
    (k, n) for _, _, s in BLOCKS for k, n, _ in s.items]
TEMPORAL_COLUMNS = [("i", "SK_ID_CURR")] + [(k, n) for k, n, _ in TEMPORAL_STORE.items]


def _report_cte(table: str, columns, is_rate, is_count) -> str:
    parts = []
    for _, name in columns:
        rate = f"count(*) FILTER ({name} < 0 OR {name} > 1)" if is_rate(name) else "0"
        negative = f"count(*) FILTER ({name} < 0)" if is_count(name) else "0"
        parts.append(
            f"SELECT '{name}' AS \"column\", count(*) FILTER ({name} IS NULL) AS null_count,"
            f" count(*) FILTER ({name} IS NULL) / count(*)::DOUBLE AS null_rate, min({name})::DOUBLE AS minimum,"
            f" max({name})::DOUBLE AS maximum, {rate} AS rate_violations, {negative} AS negative_rows,"
            f" count(*) FILTER (NOT isfinite({name}::DOUBLE)) AS non_finite_rows FROM {table}")
    return "report AS (" + "\n UNION ALL ".join(parts) + ")"


_LIFETIME_REPORT = STORE_CTE.replace("lifetime_store AS (", "lifetime_store AS MATERIALIZED (") + ",\n" + _report_cte(
    "lifetime_store", LIFETIME_COLUMNS, G.lifetime_rate, G.lifetime_count)
_TEMPORAL_REPORT = TEMPORAL_CTE.replace("temporal_store AS (", "temporal_store AS MATERIALIZED (") + ",\n" + _report_cte(
    "temporal_store", TEMPORAL_COLUMNS, G.temporal_rate, G.temporal_count)
_REPORT_SQL = f"""SELECT "column", null_count, {r6('null_rate')} AS null_rate, {r6('minimum')} AS minimum, {r6('maximum')} AS maximum,
  CAST(rate_violations AS BIGINT) AS rate_violations, CAST(negative_rows AS BIGINT) AS negative_rows, non_finite_rows FROM report"""


def _lifetime(spark: SparkSession, sf: str) -> DataFrame:
    return lifetime_features(history_roles(spark, sf))


@register("lifetime_column_report", with_roles(_REPORT_SQL, *ALL_ROLES, ctes=_LIFETIME_REPORT))
def lifetime_column_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.column_report(_lifetime(spark, sf), G.lifetime_rate, G.lifetime_count))


@register("temporal_column_report", with_roles(_REPORT_SQL, *TEMPORAL_ROLES, ctes=_TEMPORAL_REPORT))
def temporal_column_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.column_report(
        temporal_features(history_roles(spark, sf)), G.temporal_rate, G.temporal_count))


@register("top_missing_features", with_roles(
    f"""SELECT "column", null_count, {r6('null_rate')} AS null_rate FROM report WHERE "column" <> 'SK_ID_CURR'
    ORDER BY report.null_rate DESC, "column" LIMIT 20""", *ALL_ROLES, ctes=_LIFETIME_REPORT))
def top_missing_features(spark: SparkSession, sf: str) -> DataFrame:
    report = G.column_report(_lifetime(spark, sf), G.lifetime_rate, G.lifetime_count)
    return rounded(G.top_missing(report))


_CARDINALITY = """(SELECT count(*) FROM application_train) + (SELECT count(*) FROM application_test) AS expected_rows,
  count(*) AS rows, count(DISTINCT SK_ID_CURR) AS unique_keys, count(*) FILTER (SK_ID_CURR IS NULL) AS null_keys"""


@register("store_cardinality", with_roles(
    f"SELECT {_CARDINALITY} FROM lifetime_store", *ALL_ROLES, ctes=STORE_CTE))
def store_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    tables = history_roles(spark, sf)
    return rounded(G.cardinality(
        lifetime_features(tables), tables["application_train"], tables["application_test"]))


_FACTS = """facts AS (SELECT * FROM (SELECT sum(rate_violations) AS bad_rates, sum(negative_rows) AS bad_counts,
  sum(non_finite_rows) AS bad_floats FROM report), (SELECT {cardinality} FROM {store}))"""


def _checks_sql(items) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", '{severity}' AS severity, {failed} AS failed, CAST({evidence} AS BIGINT) AS evidence FROM facts"
        for name, severity, failed, evidence in items)


_LIFETIME_CHECKS = _checks_sql([
    ("application_row_reconciliation", "critical", "rows <> expected_rows", "rows - expected_rows"),
    ("primary_key_uniqueness", "critical", "rows <> unique_keys OR null_keys > 0", "rows - unique_keys + null_keys"),
    ("target_column_absent", "critical", "false", "0"),
    ("bounded_rate_validity", "high", "bad_rates > 0", "bad_rates"),
    ("nonnegative_count_validity", "high", "bad_counts > 0", "bad_counts"),
    ("finite_numeric_values", "high", "bad_floats > 0", "bad_floats"),
])
_LIFETIME_FACTS = f"{_LIFETIME_REPORT},\n{_FACTS.format(cardinality=_CARDINALITY, store='lifetime_store')}"


def _lifetime_findings(spark: SparkSession, sf: str) -> DataFrame:
    """As in a store build, the gate reads what was written."""
    tables = history_roles(spark, sf)
    return G.lifetime_findings(
        cut_lineage(lifetime_features(tables)), tables["application_train"], tables["application_test"])


@register("lifetime_quality_findings", with_roles(_LIFETIME_CHECKS, *ALL_ROLES, ctes=_LIFETIME_FACTS))
def lifetime_quality_findings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_lifetime_findings(spark, sf))


_BOUNDS = " UNION ALL ".join(
    f"SELECT '{n}' AS source, max({c})::BIGINT AS latest, max({c}) > 0 AS in_future FROM {t}" for n, t, c in (
        ("installment_due_max", "installments_payments", "DAYS_INSTALMENT"),
        ("installment_payment_max", "installments_payments", "DAYS_ENTRY_PAYMENT"),
        ("previous_decision_max", "previous_application", "DAYS_DECISION"),
        ("pos_month_max", "pos_cash_balance", "MONTHS_BALANCE"),
        ("credit_card_month_max", "credit_card_balance", "MONTHS_BALANCE"),
        ("bureau_credit_day_max", "bureau", "DAYS_CREDIT")))
_TEMPORAL_FACTS = f"""{_TEMPORAL_REPORT},
facts AS (SELECT * FROM (SELECT sum(rate_violations) AS bad_rates, sum(negative_rows) AS bad_counts,
  sum(non_finite_rows) AS bad_floats FROM report), (SELECT {_CARDINALITY},
  count(*) FILTER (CYCLING_SIGNAL_FAMILY_COUNT NOT BETWEEN 0 AND 5)
    + count(*) FILTER (CYCLING_MULTI_SIGNAL_FLAG NOT IN (0, 1)) AS bad_cycling FROM temporal_store),
  (SELECT count(*) FILTER (in_future) AS future_sources FROM ({_BOUNDS})))"""
_TEMPORAL_CHECKS = _checks_sql([
    ("application_grain_reconciliation", "critical", "rows <> expected_rows OR rows <> unique_keys", "rows - expected_rows"),
    ("target_leakage", "critical", "false", "0"),
    ("future_relative_events", "critical", "future_sources > 0", "future_sources"),
    ("bounded_rates", "high", "bad_rates > 0", "bad_rates"),
    ("nonnegative_features", "high", "bad_counts > 0", "bad_counts"),
    ("finite_features", "high", "bad_floats > 0", "bad_floats"),
    ("cycling_bounds", "high", "bad_cycling > 0", "bad_cycling"),
])


@register("temporal_quality_findings", with_roles(_TEMPORAL_CHECKS, *TEMPORAL_ROLES, ctes=_TEMPORAL_FACTS))
def temporal_quality_findings(spark: SparkSession, sf: str) -> DataFrame:
    tables = history_roles(spark, sf)
    return rounded(G.temporal_findings(cut_lineage(temporal_features(tables)), tables))


@register("lifetime_quality_gate", with_roles(
    f"""SELECT count(*) FILTER (failed) AS failed_checks,
      coalesce(max_by(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 1 END) FILTER (failed), 'none') AS maximum_severity,
      count(*) FILTER (failed) = 0 AS ready FROM ({_LIFETIME_CHECKS})""", *ALL_ROLES, ctes=_LIFETIME_FACTS))
def lifetime_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.gate(_lifetime_findings(spark, sf)))


@register("future_event_bounds", with_roles(
    _BOUNDS, "installments_payments", "previous_application", "pos_cash_balance", "credit_card_balance", "bureau"))
def future_event_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return G.future_event_bounds(history_roles(spark, sf))


@register("source_coverage", with_roles(
    " UNION ALL ".join(f"SELECT '{f}' AS flag, sum({f})::BIGINT AS rows, {r6(f'avg({f})')} AS rate FROM lifetime_store"
                       for f in HISTORY_FLAGS), *ALL_ROLES, ctes=STORE_CTE))
def source_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.availability_coverage(_lifetime(spark, sf), HISTORY_FLAGS))


@register("target_rate_by_availability", with_roles(
    " UNION ALL ".join(
        f"SELECT '{f}' AS flag, {f}::BIGINT AS available, count(*) AS rows, {r6('avg(TARGET)')} AS target_rate"
        f" FROM lifetime_store JOIN application_train USING (SK_ID_CURR) GROUP BY {f}" for f in HISTORY_FLAGS),
    *ALL_ROLES, ctes=STORE_CTE))
def target_rate_by_availability(spark: SparkSession, sf: str) -> DataFrame:
    tables = history_roles(spark, sf)
    return rounded(G.target_rate_by_availability(
        lifetime_features(tables), tables["application_train"], HISTORY_FLAGS))


def _contract_sql() -> str:
    parts = []
    for c in CONTRACTS:
        if c.table not in ALL_ROLES:
            continue
        if c.key:
            k = ", ".join(c.key)
            parts.append(
                f"SELECT '{c.table}' AS \"table\", 'duplicate_key' AS \"check\", '{','.join(c.key)}' AS columns, count(*) AS keys,"
                f" coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM {c.table} GROUP BY {k} HAVING count(*) > 1)")
        for column, parent, pc in c.references:
            source = ("(SELECT SK_ID_CURR FROM application_train UNION ALL SELECT SK_ID_CURR FROM application_test)"
                      if parent == "application" else parent)
            parts.append(
                f"SELECT '{c.table}', 'orphan_of_{parent}', '{column}', count(DISTINCT {column}), count(*)"
                f" FROM {c.table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {pc} FROM {source})")
    return " UNION ALL ".join(parts)


@register("contract_checks", with_roles(_contract_sql(), *ALL_ROLES))
def contract_checks(spark: SparkSession, sf: str) -> DataFrame:
    return G.contract_checks(history_roles(spark, sf))


def _manifest_sql() -> str:
    parts = []
    for c in CONTRACTS:
        there = c.table in ALL_ROLES
        names = [n for n, _ in ROLES[c.table][2]] if there else []
        missing = ",".join(sorted(set(c.required) - set(names))) if there else None
        parts.append(
            f"SELECT '{c.file}' AS file_name, '{c.table}' AS table_name, {str(c.mandatory).lower()} AS required,"
            f" '{'present' if there else 'missing'}' AS status, {len(names) if there else 'NULL'}::BIGINT AS column_count,"
            f" {'NULL' if missing is None else repr(missing)}::VARCHAR AS missing_required_columns,"
            f" {f'(SELECT count(*) FROM {c.table})' if there else 'NULL'}::BIGINT AS row_count,"
            f" {str(not missing and len(names) >= c.min_columns).lower() if there else 'NULL'}::BOOLEAN AS schema_valid")
    return " UNION ALL ".join(parts)


@register("source_manifest", with_roles(_manifest_sql(), *ALL_ROLES))
def source_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of a delivery: the history tables written as CSV, two optional files left out."""
    folder = f"{stage_folder(spark)}/delivery-{uuid.uuid4().hex}"
    for name, df in history_roles(spark, sf).items():
        df.write.option("header", True).csv(f"{folder}/{contract_for(name).file}")
    return build_manifest(spark, folder).select(
        "file_name", "table_name", "required", "status", F.col("column_count").cast("long").alias("column_count"),
        F.array_join("missing_required_columns", ",").alias("missing_required_columns"), "row_count", "schema_valid")


@register("file_manifest")
def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return file_digests(spark, f"{sf}/*.parquet")


def _new_snapshots(spark: SparkSession) -> Snapshots:
    return Snapshots(spark, f"{stage_folder(spark)}/snapshots-{uuid.uuid4().hex}")


@register("store_point_lookup", with_roles(
    "SELECT SK_ID_CURR, SK_ID_BUREAU, CREDIT_ACTIVE FROM bureau WHERE SK_ID_CURR IN"
    " (SELECT SK_ID_CURR FROM application_test)", "bureau", "application_test"))
def store_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Id-set restriction of a written store."""
    store = _new_snapshots(spark)
    store.commit(role(spark, sf, "bureau").select("SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE"), "SK_ID_CURR")
    return read_store(spark, store.path, ids=role(spark, sf, "application_test"))


@register("store_single_lookup", with_roles(
    f"SELECT SK_ID_CURR, {BUREAU.present()} FROM bureau_rollup WHERE SK_ID_CURR = (SELECT min(SK_ID_CURR) FROM bureau)",
    "bureau", "bureau_balance", ctes=f"{_BB_CTE},\n{_BUREAU_CTE}"))
def store_single_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One applicant out of a written store; the key filter reaches the Parquet scan."""
    store = _new_snapshots(spark)
    store.commit(bureau_block(role(spark, sf, "bureau"), role(spark, sf, "bureau_balance")), "SK_ID_CURR")
    wanted = role(spark, sf, "bureau").agg(F.min("SK_ID_CURR")).first()[0]
    return rounded(read_store(spark, store.path, one_id=wanted))


@register("snapshot_commits", with_roles(
    f"SELECT 2::BIGINT AS version, 2::BIGINT AS versions, SK_ID_CURR, {BUREAU.present()} FROM bureau_rollup",
    "bureau", "bureau_balance", ctes=f"{_BB_CTE},\n{_BUREAU_CTE}"))
def snapshot_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions are committed, a third with repeated keys is refused by its gate, and the second is what readers get."""
    store = _new_snapshots(spark)

    def unique(written: DataFrame) -> None:
        if not G.key_violations(written, ("SK_ID_CURR",)).isEmpty():
            raise ValueError("keys repeat")

    bureau = role(spark, sf, "bureau")
    store.commit(bureau.select("SK_ID_CURR").distinct(), "SK_ID_CURR", unique)
    number = store.commit(bureau_block(bureau, role(spark, sf, "bureau_balance")), "SK_ID_CURR", unique)
    try:
        store.commit(bureau.select("SK_ID_CURR"), "SK_ID_CURR", unique)
    except ValueError:
        pass
    else:
        raise AssertionError("the gate let repeated keys pass")
    return rounded(store.read().select(
        F.lit(number).cast("long").alias("version"), F.lit(store.history().count()).cast("long").alias("versions"), "*"))


# Faults by key: a word in an amount, a fraction in a whole number, an infinite amount, one field too many.
_FAULTS = (("AMT_CREDIT_SUM", 7, "n/a", "not_a_number"), ("DAYS_CREDIT", 11, "-12.5", "not_whole"),
           ("AMT_ANNUITY", 13, "Infinity", "not_finite"))
_SPLIT = 17


def _fault_sql() -> str:
    parts = [f"SELECT SK_ID_BUREAU::VARCHAR AS SK_ID_BUREAU, '{c}' AS \"column\", '{cell}' AS cell, '{kind}' AS kind, NULL::DOUBLE AS amount"
             f" FROM bureau WHERE SK_ID_BUREAU % {m} = 0 AND SK_ID_BUREAU % {_SPLIT} <> 0" for c, m, cell, kind in _FAULTS]
    parts.append(f"SELECT SK_ID_BUREAU::VARCHAR, NULL, NULL, 'malformed_record', NULL FROM bureau WHERE SK_ID_BUREAU % {_SPLIT} = 0")
    sound = " AND ".join(f"SK_ID_BUREAU % {m} <> 0" for m in (*[m for _, m, _, _ in _FAULTS], _SPLIT))
    parts.append(f"SELECT SK_ID_BUREAU::VARCHAR, NULL, NULL, 'sound', {r6('AMT_CREDIT_SUM')} FROM bureau WHERE {sound}")
    return " UNION ALL ".join(parts)


@register("csv_cell_faults", with_roles(_fault_sql(), "bureau"))
def csv_cell_faults(spark: SparkSession, sf: str) -> DataFrame:
    """The accounts written as CSV with broken cells and records, read back as faults and sound rows."""
    rows = role(spark, sf, "bureau")
    key = F.col("SK_ID_BUREAU")
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns}
    for column, every, cell, _ in _FAULTS:
        cells[column] = F.when(key % every == 0, cell).otherwise(cells[column])
    cells["CREDIT_TYPE"] = F.when(key % _SPLIT == 0, "one,more").otherwise(cells["CREDIT_TYPE"])
    folder = f"{stage_folder(spark)}/csv-{uuid.uuid4().hex}"
    # one column of whole lines under another separator: no quotes, so a comma splits its cell
    line = F.concat_ws(",", *cells.values()).alias(",".join(cells))
    rows.select(line).write.option("header", True).option("sep", "\u0001").csv(f"{folder}/bureau.csv")
    checked = check_csv_table(spark, folder, "bureau")
    broken = F.col("kind") == "malformed_record"
    faults = checked.faults.select("SK_ID_BUREAU", "column", F.when(~broken, F.col("cell")).alias("cell"), "kind", F.lit(None).cast("double").alias("amount"))
    sound = checked.rows.select(F.col("SK_ID_BUREAU").cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("sound"), "AMT_CREDIT_SUM")
    return rounded(faults.unionAll(sound))
