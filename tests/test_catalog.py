"""Registered queries against their SQL on the smallest data set (all of them with ``CATALOG=all``)."""

import glob
import math
import os

import duckdb
import pytest

from ledgerlight.catalog import load_catalog

SF_DIR = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = load_catalog()
QUICK = (
    "id_spine", "bureau_features", "installment_loan_sequence", "application_velocity", "cash_after_stress",
    "application_features", "stratified_splits", "transparent_scores", "review_routes", "reliability_deciles",
    "intake_strip_expansion", "pairwise_cramers_v", "intake_quarantine", "portfolio_screen", "store_single_lookup",
    "shared_bin_counts", "calibrator_comparison", "csv_cell_faults", "snapshot_commits",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return str(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(CHECKS) if os.environ.get("CATALOG") == "all" else QUICK)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    relation = duck.sql(CHECKS[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(relation.columns, relation.fetchall())


def test_every_check_has_its_query():
    assert set(CHECKS) <= set(QUERIES) and len(QUERIES) > 100


def test_entry_runs_in_a_plain_session(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 151
