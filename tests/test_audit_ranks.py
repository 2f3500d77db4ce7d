"""Ranks without a hot join, and tiled pair correlations, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import audit as D
from ledgerlight.operators.ordering import with_ranks


def test_a_two_valued_column_of_a_million_rows_is_not_joined_by_value(spark):
    rows = spark.range(1_000_000).select(F.lit("f").alias("feature"), (F.col("id") % 3 == 0).cast("double").alias("value"), "id")
    ranked = with_ranks(rows, "value", ["feature"], "rank")
    ones = 333_334
    zeros = 1_000_000 - ones
    got = {r["value"]: (r["n"], r["low"], r["high"]) for r in ranked.groupBy("value").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high")).collect()}
    assert got == {0.0: (zeros, (zeros + 1) / 2, (zeros + 1) / 2), 1.0: (ones, zeros + (ones + 1) / 2, zeros + (ones + 1) / 2)}


def test_ranks_of_frequent_and_rare_values(spark, monkeypatch):
    import ledgerlight.operators.ordering as O

    monkeypatch.setattr(O, "HOT_SHARE", 4)  # a quarter of a group is frequent
    draw = random.Random(1)
    rows = [(g, draw.choice([0.5, 0.5, draw.random()]) if n % 10 else None, n) for n, g in enumerate("ab" * 200)]
    got = with_ranks(spark.createDataFrame(rows, "g string, v double, id long"), "v", ["g"], "r").collect()
    for g in "ab":
        values = np.array([v for h, v, _ in rows if h == g and v is not None])
        for r in (r for r in got if r["g"] == g):
            assert r["r"] == (values < r["v"]).sum() + ((values == r["v"]).sum() + 1) / 2
    assert sorted(r["id"] for r in got) == [n for _, v, n in rows if v is not None]


def plain_spearman(x, y):
    both = [(a, b) for a, b in zip(x, y, strict=True) if not (math.isnan(a) or math.isnan(b))]
    if len(both) < 2:
        return len(both), None
    ranks = [np.array([sum(u < v for u in side) + (sum(u == v for u in side) + 1) / 2 for v in side]) for side in zip(*both, strict=True)]
    if not all(r.std() for r in ranks):
        return len(both), None
    return len(both), float(np.corrcoef(*ranks)[0, 1])


@pytest.mark.parametrize("tile", [16, 3])
def test_tiled_correlations(spark, monkeypatch, tile):
    monkeypatch.setattr(D, "TILE_COLUMNS", tile)
    draw = random.Random(2)
    names = [f"c{n}" for n in range(8)]
    table = []
    for n in range(60):
        base = draw.random()
        row = [base, round(base + draw.random(), 1), float(draw.randint(0, 2)), -base, 7.0, draw.random(), draw.random(), draw.random()]
        table.append([v if k == 0 or draw.random() > 0.2 else math.nan for k, v in enumerate(row)])
        table[-1][7] = table[-1][7] if n < 1 else math.nan
    rows = spark.createDataFrame([(n, *[None if math.isnan(v) and k % 2 else v for k, v in enumerate(r)]) for n, r in enumerate(table)],
                                 "id long, " + ", ".join(f"{c} double" for c in names))
    got = {(r["feature_a"], r["feature_b"]): (r["rows"], r["association"]) for r in D.pairwise_spearman(rows, "id", names, minimum_rows=2).collect()}
    columns = list(zip(*table, strict=True))
    for a in range(8):
        for b in range(a + 1, 8):
            n, rho = plain_spearman(columns[a], columns[b])
            if not n:
                assert (names[a], names[b]) not in got
            else:
                assert got[names[a], names[b]] == (n, None if rho is None else pytest.approx(rho, abs=1e-12))
    few = D.pairwise_spearman(rows, "id", names, minimum_rows=500).collect()
    assert all(r["association"] is None for r in few)
    assert D.pairwise_spearman(rows, "id", names[:2], minimum_rows=2, sample_rows=10).first()["rows"] <= 10
    assert D.pairwise_spearman(rows.where("false"), "id", names).count() == 0


def test_masks_that_do_the_same_are_scored_once(spark):
    rows = spark.createDataFrame([(n, int(n % 3 == 0), float(n % 5), float(n % 7), 1) for n in range(60)],
                                 "id long, TARGET int, a double, b double, has int")
    scored = []

    def score(df):
        scored.append(df.select("_effect").distinct().count())
        return df.withColumn("probability", F.coalesce(F.col("a"), F.lit(9.0)) / 20 + F.coalesce(F.col("b"), F.lit(0.0)) / 20 + F.col("has") * 0.05)

    masks = {"x.a": (["a", "other"], {}), "y.a": (["a"], {}), "unread": (["other"], {}), "sheet": (["b"], {"has": 0})}
    table = {r["field"]: r for r in D.ablation(rows, "id", masks, score, lambda df: F.col("probability") > 0.3, ["a", "b", "has"]).collect()}
    assert scored == [3] and table.keys() == masks.keys()  # as they are, without a, without the sheet
    assert table["x.a"][1:] == table["y.a"][1:] and set(table["unread"][1:]) == {0.0}
    plain = [(n, n % 5 / 20 + n % 7 / 20 + 0.05) for n in range(60)]
    assert table["x.a"]["mean_absolute_probability_shift"] == pytest.approx(sum(abs(0.45 - n % 5 / 20) for n, _ in plain) / 60)
    assert table["sheet"]["mean_absolute_probability_shift"] == pytest.approx(sum(n % 7 / 20 + 0.05 for n, _ in plain) / 60)
    assert table["sheet"]["route_change_share"] == pytest.approx(sum((p > 0.3) != (n % 5 / 20 > 0.3) for n, p in plain) / 60)
