import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import bootstrap as R
from ledgerlight.operators import calibration as C
from ledgerlight.operators import evaluation as E
from ledgerlight.operators import fairness as Q
from ledgerlight.operators import splits as S
from ledgerlight.operators.ordering import exact_quantiles, running_totals

random.seed(5)
# A third of all scores are equal and another third differ by less than one fine bucket.
SCORES = [0.25] * 200 + [0.5 + i * 1e-12 for i in range(200)] + [random.random() for _ in range(200)]
ROWS = [(i, int(random.random() < 0.2 + 0.5 * (p > 0.4)), p) for i, p in enumerate(SCORES)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, TARGET int, p double").cache()


def test_running_totals_and_quantiles(rows):
    totals = running_totals(rows, "p", {"n": F.count(F.lit(1))}, bounds=(0.0, 1.0))
    got = {r.p: (r.n, r.n_before) for r in totals.collect()}
    p = np.array(SCORES)
    assert sum(n for n, _ in got.values()) == len(p)
    assert all(before == int((p < value).sum()) and n == int((p == value).sum()) for value, (n, before) in got.items())
    qs = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    found = {r.q: r.quantile for r in exact_quantiles(totals, "p", "n", qs).collect()}
    for q in qs:
        assert found[q] == pytest.approx(np.quantile(p, q), abs=1e-15)


def auc_ap(y, p):
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])
    ap = np.mean([(pos >= a).sum() / (p >= a).sum() for a in pos])
    return auc, ap


def test_ranking_metrics_match_brute_force(rows):
    y, p = np.array([r[1] for r in ROWS]), np.array(SCORES)
    r = E.evaluate(rows, "p").first()
    auc, ap = auc_ap(y, p)
    assert r.roc_auc == pytest.approx(auc, abs=1e-12) and r.average_precision == pytest.approx(ap, abs=1e-12)
    assert r.brier_score == pytest.approx(((p - y) ** 2).mean(), abs=1e-12)
    threshold = np.quantile(p, 0.9)
    top = E.top_share_metrics(rows, "p", (0.10,)).first()
    assert top.probability_threshold == pytest.approx(threshold) and top.selected_rows == (p >= threshold).sum()


def test_operating_points_and_ties(rows):
    order = sorted(ROWS, key=lambda r: (-r[2], r[0]))
    for r in E.operating_points(rows, "p", "id").collect():
        take = math.ceil(len(order) * r.fraction)
        assert r.selected_rows == take and r.true_positives == sum(x[1] for x in order[:take])


def test_perfect_ranking(spark):
    df = spark.createDataFrame(
        list(zip([0, 0, 0, 0, 1, 1], [.05, .10, .15, .20, .70, .90])), "TARGET int, p double")
    r = E.evaluate(df, "p").first()
    assert r.roc_auc == 1 and r.average_precision == 1 and r.brier_skill_score > 0


def test_group_metrics_and_suppression(spark):
    df = spark.createDataFrame(
        list(zip([1, 1, 0, 0, 0, 0], [.9, .2, .8, .7, .1, .05])), "TARGET int, p double").withColumn("g", F.lit("a"))
    cut = spark.createDataFrame([(0.75,)], "review_threshold double")
    r = Q.group_metrics(df, "p", ["g"], cut, minimum_rows=1, minimum_events=1).first()
    assert r.review_rate == pytest.approx(2 / 6)
    assert r.true_positive_rate_at_review_capacity == 0.5 and r.false_positive_rate_at_review_capacity == 0.25
    hidden = Q.group_metrics(df.limit(3), "p", ["g"], cut).first()
    assert not hidden.eligible_for_comparison and hidden.roc_auc is None
    with pytest.raises(ValueError):
        Q.assert_protected_unused(["AMT_CREDIT", "DAYS_BIRTH"])


def test_acceptance_gates(spark):
    row = spark.createDataFrame([(0.78, 0.24, 0.08, 0.06, 1.02)],
                                "roc_auc double, average_precision double, base_rate double, brier_score double, calibration_slope double")
    r = E.acceptance_gates(row).first()
    assert r.all_passed and r.average_precision_multiple == pytest.approx(3.0)


def test_challenger_gates(spark):
    schema = "average_precision double, brier_score double, roc_auc double, top_20_capture double"
    base = spark.createDataFrame([(0.24, 0.066, 0.78, 0.56)], schema)
    better = spark.createDataFrame([(0.244, 0.066, 0.78, 0.56)], schema)
    worse = spark.createDataFrame([(0.242, 0.066, 0.78, 0.56)], schema)
    assert E.challenger_gates(base, better, F.lit(0.97)).first().all_passed
    assert not E.challenger_gates(base, worse, F.lit(0.97)).first().average_precision_gain


def test_split_shares(spark):
    df = spark.createDataFrame([(i, int(i >= 80)) for i in range(100)], "SK_ID_CURR long, TARGET int")
    got = {r.split: (r.n, r.m) for r in S.assign_splits(df).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg("TARGET").alias("m")).collect()}
    assert got == {"development": (70, 0.2), "calibration": (15, 0.2), "holdout": (15, 0.2)}
    assert S.assign_splits(df.repartition(7)).exceptAll(S.assign_splits(df)).count() == 0


def test_calibration_line_and_isotonic(spark):
    random.seed(3)
    data = [(i, int(random.random() < p), p) for i, p in enumerate(random.choice([0.1, 0.2, 0.35, 0.5, 0.8]) for _ in range(800))]
    df = spark.createDataFrame(data, "id long, TARGET int, p double")
    line = E.calibration_line(df, "p").first()
    x = np.log(np.array([d[2] for d in data]) / (1 - np.array([d[2] for d in data])))
    y = np.array([d[1] for d in data])
    w = np.zeros(2)
    design = np.c_[np.ones_like(x), x]
    for _ in range(50):
        q = 1 / (1 + np.exp(-design @ w))
        w += np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design, design.T @ (y - q))
    assert line.calibration_intercept == pytest.approx(w[0], abs=1e-8)
    assert line.calibration_slope == pytest.approx(w[1], abs=1e-8)
    fitted = {r.p: r.f for r in C.isotonic_predict(df.select("p").distinct(), C.isotonic_fit(df, "p"), "p", "f").collect()}
    values = [fitted[k] for k in sorted(fitted)]
    assert values == sorted(values)
    one_class = df.where("TARGET = 0")
    assert E.calibration_line(one_class, "p").first().calibration_slope is None


def test_blend_weight_prefers_application(spark):
    df = spark.createDataFrame(
        [(y, p, 1 - p, "s") for y, p in zip([0, 0, 1, 1], [.1, .2, .8, .9])], "TARGET int, a double, h double, seg string")
    candidates = C.weight_candidates(df, "a", "h", ["seg"])
    assert candidates.count() == 5
    assert C.select_weights(candidates, ["seg"]).first().history_weight == 0.0
    assert C.blend_violations(df.union(spark.createDataFrame([(1, 0.0, None, "s")], df.schema)), ["a", "h"]).first().asDict() == {"a": 1, "h": 1}


def test_bootstrap_favours_the_better_model(spark):
    random.seed(9)
    data = []
    for i in range(300):
        y = int(i % 4 == 0)
        data.append((i, y, min(0.95, max(0.05, 0.25 + 0.5 * y + random.uniform(-.2, .2))), random.uniform(0.05, 0.6)))
    df = spark.createDataFrame(data, "id long, TARGET int, good double, bad double")
    s = R.bootstrap_summary(R.bootstrap_deltas(df, "good", "bad", "id", 15)).first()
    assert s.brier_score_support == 1.0 and s.roc_auc_support == 1.0 and s.average_precision_low > 0


def test_one_outlier_squeezes_no_bucket(spark):
    from pyspark.sql import functions as F

    from ledgerlight.operators.ordering import _float_buckets, running_totals

    values = [float(n) for n in range(1, 20_001)] + [1e18, -1e18, 0.0, -0.0, -3.5, float("inf")]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    coarse, fine = _float_buckets(F.col("v"))
    largest = table.distinct().groupBy(coarse.alias("c"), fine.alias("f")).count().agg(F.max("count")).first()[0]
    assert largest == 1
    totals = {r["v"]: r["n_before"] for r in running_totals(table, "v", {"n": F.count(F.lit(1))}).collect()}
    assert totals == {v: sum(x < v for x in sorted(values)[:4]) if v <= 0 else sum(x < v for x in (-1e18, -3.5, 0.0, -0.0)) + (
        20_000 if v == 1e18 else 20_001 if v == float("inf") else int(v) - 1) for v in set(values)}


def test_two_groups_are_joined_without_moving_rows(spark):
    from pyspark.sql import functions as F

    from ledgerlight.operators.splits import assign_splits

    rows = spark.range(2000).select(F.col("id").alias("SK_ID_CURR"), (F.col("id") % 7 == 0).cast("int").alias("TARGET"))
    plan = assign_splits(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
    assert {r["split"]: r["count"] for r in assign_splits(rows).groupBy("split").count().collect()} == {
        "development": 1399, "calibration": 300, "holdout": 301}
