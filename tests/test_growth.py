"""Steps whose time or memory a task must not grow with the table."""

import math
import random

import pytest
from pyspark.sql import functions as F


def test_manifest_reads_a_file_once_and_sorts_no_lines(spark, tmp_path):
    from ledgerlight.operators.manifest import path_facts

    texts = {"a.csv": b"x,y\n1,2\n3,4", "b.csv": b"\xef\xbb\xbfx,y\r\n1,2\r\n", "c.csv": b"", "d.csv": b"\n\n", "e.csv": b"only"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    listing = spark.createDataFrame([(f"file://{tmp_path / n}", len(t)) for n, t in texts.items()], "path string, length bigint")
    got = {r.path.rsplit("/", 1)[1]: (r.row_count, r.header) for r in path_facts(spark, listing).collect()}
    assert got == {"a.csv": (2, "x,y"), "b.csv": (1, "﻿x,y\r"), "c.csv": (0, None), "d.csv": (1, ""), "e.csv": (0, "only")}


def test_loan_partitions_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    from ledgerlight.operators.temporal import loan_day_sequence, loan_features, reconcile_installments
    from ledgerlight.sources import roles

    keys = spark.range(400)
    keys.select(F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    keys.select(
        F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        F.lit(3.0).alias("l_quantity"), F.lit(100.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"),
        F.lit("2001-01-01").cast("timestamp").alias("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(roles, "JOINED_ROWS", 20, raising=False)
    payments = roles.role(spark, str(tmp_path), "installments_payments")
    loans = loan_features(loan_day_sequence(reconcile_installments(payments)))
    assert loans.rdd.getNumPartitions() == 20 and loans.count() == 200


@pytest.mark.parametrize("seed", [1, 2])
def test_bucket_quantiles_are_exact(spark, seed):
    from ledgerlight.operators.ordering import bucket_counts, bucket_quantiles

    draw = random.Random(seed)
    columns = {
        0: [draw.uniform(-5, 5) for _ in range(997)] + [None] * 30, 1: [float(draw.randrange(3)) for _ in range(500)],
        2: [math.exp(draw.uniform(-300, 300)) * draw.choice((-1, 1)) for _ in range(400)] + [0.0, -0.0], 3: [7.5], 4: [None, None]}
    rows = spark.createDataFrame([(p, v) for p, vs in columns.items() for v in vs], "p int, v double")
    counts = bucket_counts(rows, "v", ["p"])
    assert {r.p: r["rows"] for r in counts.where("_bucket IS NULL").collect()} == {0: 30, 4: 2}
    wanted = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.p, r.q): r.quantile for r in bucket_quantiles(rows, counts, "v", wanted, ["p"]).collect()}
    for p, vs in columns.items():
        known = sorted(v for v in vs if v is not None)
        for q in wanted if known else []:
            h = (len(known) - 1) * q
            a, b = known[math.floor(h)], known[math.ceil(h)]
            assert got.pop((p, q)) == a + (b - a) * (h - math.floor(h))
    assert not got


def test_float_position_never_falls_and_stays_short(spark):
    from ledgerlight.operators.ordering import _float_position

    draw = random.Random(3)
    values = sorted({math.ldexp(draw.uniform(-1, 1), draw.randrange(-1070, 1020)) for _ in range(5000)} | {
        1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 5e-324, -5e-324, 0.0, 1.7e308, float("inf"), float("-inf")})
    table = spark.createDataFrame(list(enumerate(values)), "n int, v double")
    places = [r.p for r in table.select("n", _float_position(F.col("v")).alias("p")).orderBy("n").collect()]
    assert places == sorted(places) and places[0] < places[1] and places[-2] < places[-1]
    assert len(str(_float_position(F.col("v")))) < 1000


def test_small_files_are_spread_over_the_cores(spark, tmp_path):
    from ledgerlight.catalog.audit_queries import contributions

    spark.range(50).select(
        F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"),
        (F.col("id") - 10).cast("double").alias("c_acctbal"), F.lit("A").alias("c_mktsegment"),
    ).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert contributions(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_trees_do_not_depend_on_unused_bins():
    """Histograms are as wide as the bins in use; columns of one bin are passed over."""
    import numpy as np

    from ledgerlight.operators.boosting import Settings, _grow

    draw = np.random.default_rng(0)
    bins = draw.integers(0, 9, (600, 4)).astype(np.uint8)
    bins[:, 2] = 0
    pull = draw.normal(size=600) + (bins[:, 1] > 4)
    how = Settings(depth=3, least_rows=20)
    first = _grow(bins, pull, np.ones(600), np.arange(4), how)
    assert first[0][0] == 1 and first[1][0] == 4 and 2 not in first[0]
    wider = np.vstack([bins, np.full((1, 4), 255, dtype=np.uint8)])  # one row far to the right, without weight
    again = _grow(wider, np.append(pull, 0.0), np.append(np.ones(600), 0.0), np.arange(2), how)
    assert again[0][0] == 1 and again[1][0] == 4
