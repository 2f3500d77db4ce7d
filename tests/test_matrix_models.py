"""The shared matrix with its trees, the replicate bootstrap and the block isotonic fit, against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.functions.expressions import poisson_one, uniform_hash
from ledgerlight.operators import boosting as B
from ledgerlight.operators import bootstrap as R
from ledgerlight.operators import isotonic as I
from ledgerlight.operators.application import Selection


# ---------------------------------------------------------------- matrix and trees

@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(4)
    rows = []
    for n in range(1200):
        a, b = draw.gauss(0, 1), draw.choice([0.0, 0.0, 0.0, draw.random()])
        word = draw.choice(["red", "red", "blue", "rare%d" % n])
        p = 1 / (1 + math.exp(-(1.5 * a + (2 if word == "blue" else -1))))
        rows.append((n, int(draw.random() < p), "early_stop" if n % 7 == 0 else "fit", a if n % 9 else None, b if n % 11 else math.nan, word if n % 13 else None))
    return spark.createDataFrame(rows, "id long, y int, tuning_role string, a double, b double, word string").repartition(3)


@pytest.fixture(scope="module")
def layout(table):
    return B.learn_layout(table, Selection(("a", "b"), ("word",)), bins=16, least_rows=50)


def test_matrix_places_every_value_between_its_quantiles(table, layout):
    rows = {r["id"]: r for r in table.collect()}
    assert layout.columns == ["a", "b", "a__missing", "b__missing", "word"] and layout.levels["word"] == ["blue", "red"]
    known = {c: np.array([r[c] for r in rows.values() if r[c] is not None and not math.isnan(r[c])]) for c in ("a", "b")}
    edges = {c: np.unique(np.quantile(v, [i / 16 for i in range(1, 16)])) for c, v in known.items()}
    for c, values in edges.items():
        assert layout.edges[c] == pytest.approx(values.tolist(), abs=1e-12)
    got = {r["id"]: list(r["bins"]) for r in B.binned_matrix(table, layout, ["id"]).collect()}
    for n, r in rows.items():
        want = []
        for c in ("a", "b"):
            gone = r[c] is None or math.isnan(r[c])
            want.append(sum(e < (np.median(known[c]) if gone else r[c]) for e in layout.edges[c]))
        want += [int(r[c] is None or math.isnan(r[c])) for c in ("a", "b")] + [{"blue": 1, "red": 2}.get(r["word"], 0)]
        assert got[n] == want
    matrix = B.binned_matrix(table.drop("a"), layout, ["id", "y"])  # an absent column is missing everywhere
    assert {tuple(r["bins"])[2] for r in matrix.collect()} == {1}
    counts = {(r["feature"], r["bin"]): (r["rows"], r["events"]) for r in B.bin_counts(B.binned_matrix(table, layout, ["y"]), layout, "y").collect()}
    assert counts["word", 2] == (sum(r["word"] == "red" for r in rows.values()), sum(r["y"] for r in rows.values() if r["word"] == "red"))
    assert B.binned_matrix(table.where("false"), layout, ["id"]).count() == 0


def test_grown_tree_takes_the_best_cut():
    draw = np.random.default_rng(2)
    bins, y = draw.integers(0, 9, size=(400, 3)).astype(np.uint8), draw.integers(0, 2, 400).astype(float)
    y[bins[:, 1] > 4] = 1
    how = B.Settings(depth=1, least_rows=20, step=1.0)
    pull, weight = y - y.mean(), np.full(400, y.mean() * (1 - y.mean()))
    places, cuts, values, gains = B._grow(bins, pull, weight, np.arange(3), how)
    best = max(((pull[left].sum() ** 2 / (weight[left].sum() + 1) + pull[~left].sum() ** 2 / (weight[~left].sum() + 1)
                 - pull.sum() ** 2 / (weight.sum() + 1)), c, cut)
               for c in range(3) for cut in range(8) if 20 <= (left := bins[:, c] <= cut).sum() <= 380)
    assert (gains[0], places[0], cuts[0]) == (pytest.approx(best[0]), best[1], best[2]) and best[1:] == (1, 4)
    left = bins[:, 1] <= 4
    assert values[1] == pytest.approx(pull[left].sum() / (weight[left].sum() + 1))


def test_models_of_one_matrix(spark, table, layout):
    matrix = B.binned_matrix(table, layout, ["id", "y", "tuning_role"])
    quick = B.Settings(rounds=40, least_rows=20)
    plans = [B.Plan("both", tuple(layout.places(["a", "word"])), quick), B.Plan("noise", tuple(layout.places(["b"])), quick)]
    forests = B.fit_plans(matrix, plans, "id", "y")
    scored = B.predict_all(matrix, forests, ["id", "y"]).toPandas()

    def auc(name):
        rows = scored[scored["model"] == name]
        up, down = rows.loc[rows["y"] == 1, "p"].to_numpy(), rows.loc[rows["y"] == 0, "p"].to_numpy()
        return (up[:, None] > down).mean() + 0.5 * (up[:, None] == down).mean()

    assert auc("both") > 0.8 and auc("noise") < 0.65 and len(scored) == 2400
    assert len(forests["noise"].places) < len(forests["both"].places) <= 40  # early stopping
    gains = {r["feature"]: r["gain"] for r in B.gain_importance(spark, forests["both"], layout).collect()}
    assert sum(gains.values()) == pytest.approx(1) and gains["b"] == 0 and min(gains["a"], gains["word"]) > 0.2
    again = B.fit_plans(matrix.repartition(5), plans, "id", "y")
    assert np.array_equal(again["both"].values, forests["both"].values)  # the same rows, however dealt
    assert len(B.fit_plans(matrix, plans[:1], "id", "y", fit_rows=150)) == 1


def test_dealt_rows_grow_the_trees_of_all_rows(spark, table, layout):
    """Beyond ``fit_rows`` no row is left out, and the tasks together find what one task with all rows finds."""
    matrix = B.binned_matrix(table, layout, ["id", "y", "tuning_role"])
    whole = B.Settings(rounds=12, depth=3, least_rows=20, row_share=1.0, column_share=1.0)  # no draws
    plans = [B.Plan("both", tuple(layout.places(["a", "word"])), whole),
             B.Plan("short", tuple(layout.places(["a"])), B.Settings(**{**whole.__dict__, "rounds": 4, "depth": 2}))]
    one, many = B.fit_plans(matrix, plans, "id", "y"), B.fit_plans(matrix, plans, "id", "y", fit_rows=150)
    for name, forest in one.items():
        assert many[name].base == forest.base and np.array_equal(many[name].places, forest.places)
        assert np.array_equal(many[name].cuts, forest.cuts)
        assert many[name].values == pytest.approx(forest.values, abs=1e-6) and many[name].gains == pytest.approx(forest.gains, abs=1e-4)


def test_dealt_trees_do_not_depend_on_the_tasks(spark, table, layout, monkeypatch):
    matrix = B.binned_matrix(table, layout, ["id", "y", "tuning_role"])
    plans = [B.Plan("both", tuple(layout.places(["a", "b", "word"])), B.Settings(rounds=60, depth=4, least_rows=20, patience=5))]
    four = B.fit_plans(matrix, plans, "id", "y", fit_rows=100)["both"]
    for shards in (1, 2, 3):
        with monkeypatch.context() as patch:
            patch.setattr(B, "shard_count", lambda context, wanted, n=shards: n)
            other = B.fit_plans(matrix.repartition(7), plans, "id", "y", fit_rows=700)["both"]
        assert np.array_equal(other.values, four.values) and np.array_equal(other.places, four.places)
    assert 1 < len(four.places) < 60  # early stopping
    # Alike rows are rows of their own.
    alike = matrix.where("id < 40").withColumn("tuning_role", F.lit("fit")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("copy")
    short = [B.Plan("both", plans[0].places, B.Settings(rounds=3, depth=2, least_rows=20, row_share=1.0, column_share=1.0))]
    one, many = (B.fit_plans(alike, short, "id", "y", fit_rows=n)["both"] for n in (1000, 100))
    assert many.values == pytest.approx(one.values, abs=1e-6) and many.places.max() >= 0
    # Tasks without a row take part.
    few = matrix.where("id < 3").withColumn("tuning_role", F.lit("fit"))
    assert B.fit_plans(few, plans, "id", "y", fit_rows=1)["both"].places.max() == -1


def test_a_fit_of_many_rows_leaves_none_out(spark):
    n = B.FIT_ROWS + 1000
    matrix = spark.range(n).select(
        "id", (F.col("id") % 7 == 0).cast("int").alias("y"), F.lit("fit").alias("tuning_role"),
        F.unhex(F.lpad(F.hex(F.col("id") % 7), 2, "0")).alias("bins"))
    forest = B.fit_plans(matrix, [B.Plan("one", (0,), B.Settings(rounds=1, depth=1, row_share=1.0, step=1.0))], "id", "y")["one"]
    events = -(-n // 7)
    rate = events / n
    assert forest.base == pytest.approx(math.log(rate / (1 - rate)), abs=1e-12)
    assert forest.values[0, 1:].tolist() == pytest.approx(
        [events * (1 - rate) / (events * rate * (1 - rate) + 1), -(n - events) * rate / ((n - events) * rate * (1 - rate) + 1)], rel=1e-6)


# ---------------------------------------------------------------- bootstrap

def test_draws_are_those_of_the_columns(spark):
    rows = spark.range(20).select("id", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("i")).withColumn(
        "d", poisson_one(uniform_hash(F.col("id"), F.col("i"), F.lit(7))))
    want = {(r["id"], r["i"]): r["d"] for r in rows.collect()}
    got = R.draws([str(n) for n in range(20)], 31, 7)
    assert all(got[n, i] == d for (n, i), d in want.items())
    assert R.draws([None], 1, 7)[0, 0] == np.searchsorted(R._EDGES, int(hashlib.md5(b"0:7").hexdigest()[:12], 16) / 2**48, side="right")


def brute_deltas(rows, iterations, seed):
    out = {}
    weights = R.draws([str(r[0]) for r in rows], iterations, seed).astype(float)
    y = np.array([r[1] for r in rows])
    for i in range(iterations):
        w = weights[:, i].copy()
        if not w.any():
            continue
        for k in (0, 1):
            if w[y == k].any():
                w[y == k] *= (y == k).sum() / w[y == k].sum()
        values = []
        for column in (2, 3):
            p = np.array([r[column] for r in rows])
            brier = (w * (p - y) ** 2).sum() / w.sum()
            e, o = w * (y == 1), w * (y == 0)
            auc = sum(e[j] * (o[p < p[j]].sum() + o[p == p[j]].sum() / 2) for j in range(len(p))) / (e.sum() * o.sum()) if e.sum() * o.sum() else None
            ap = sum(e[j] * e[p >= p[j]].sum() / w[p >= p[j]].sum() for j in np.flatnonzero(e)) / e.sum() if e.sum() else None
            values.append((brier, auc, ap))
        out[i] = [None if a is None else a - b for a, b in zip(*values, strict=True)]
    return out


@pytest.mark.parametrize("cell, chunk", [(64, 4096), (3, 5)])
def test_bootstrap_matches_resampling_by_hand(spark, monkeypatch, cell, chunk):
    monkeypatch.setattr(R, "CELL_ROWS", cell)
    monkeypatch.setattr(R, "CHUNK_ROWS", chunk)
    draw = random.Random(6)
    rows = [(n, int(draw.random() < 0.3), draw.choice([0.2, 0.2, 0.2, draw.random()]), round(draw.random(), 1), "x" if n % 3 else None)
            for n in range(150)] + [(900, 1, 0.5, 0.5, "tiny"), (901, 0, 0.5, 0.25, "tiny")]
    df = spark.createDataFrame(rows, "id long, TARGET int, a double, b double, g string").repartition(4)
    for group in ("x", None, "tiny"):
        want = brute_deltas([r for r in rows if r[4] == group], 12, 42)
        got = {r["iteration"]: [r[f"{m}_delta"] for m in ("brier_score", "roc_auc", "average_precision")]
               for r in R.bootstrap_deltas(df, "a", "b", "id", 12, groups=["g"]).where(F.col("g").eqNullSafe(group)).collect()}
        assert got.keys() == want.keys()
        for i, values in got.items():
            assert values == [None if v is None else pytest.approx(v, abs=1e-12) for v in want[i]]
    whole = brute_deltas(rows, 12, 42)
    got = {r["iteration"]: r["average_precision_delta"] for r in R.bootstrap_deltas(df, "a", "b", "id", 12).collect()}
    assert got == {i: pytest.approx(v[2], abs=1e-12) for i, v in whole.items()}


def test_draws_never_move(spark):
    df = spark.range(500).select("id", (F.col("id") % 5 == 0).cast("int").alias("TARGET"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    plans = [R.bootstrap_deltas(df, "a", "b", "id", n)._jdf.queryExecution().toString() for n in (2, 300)]
    assert all("explode(sequence" not in p.lower() for p in plans) and plans[0].count("Exchange") == plans[1].count("Exchange")


# ---------------------------------------------------------------- isotonic

def plain_isotonic(points):
    scores = sorted({p for p, _ in points})
    blocks = [[sum(y for q, y in points if q == p), sum(q == p for q, _ in points), [p]] for p in scores]
    n = 0
    while n + 1 < len(blocks):
        if blocks[n][0] / blocks[n][1] >= blocks[n + 1][0] / blocks[n + 1][1]:
            blocks[n: n + 2] = [[blocks[n][0] + blocks[n + 1][0], blocks[n][1] + blocks[n + 1][1], blocks[n][2] + blocks[n + 1][2]]]
            n = max(0, n - 1)
        else:
            n += 1
    return blocks


@pytest.mark.parametrize("shape", ["rising", "falling", "noise", "one score", "steps"])
@pytest.mark.parametrize("block_rows", [100_000, 40])
def test_isotonic_blocks(spark, shape, block_rows):
    draw = random.Random(len(shape))
    points = []
    for n in range(400):
        p = {"one score": 0.3, "steps": draw.choice([0.1, 0.4, 0.4, 0.9])}.get(shape, round(draw.random(), 3))
        chance = {"rising": p, "falling": 1 - p, "noise": 0.5, "one score": 0.2, "steps": p}[shape]
        points.append((p, int(draw.random() < chance)))
    df = spark.createDataFrame([*points, (None, 1), (0.5, None)], "p double, TARGET int").repartition(5)
    blocks = I.isotonic_fit(df, "p", block_rows=block_rows)
    want = plain_isotonic(points)
    got = sorted((r["low"], r["high"], r["total"], r["weight"]) for r in blocks.collect())
    assert got == [(min(b[2]), max(b[2]), b[0], b[1]) for b in want]
    asked = sorted({p for p, _ in points})[::7] + [-1.0, 0.123456, 0.5, 2.0]
    rows = spark.createDataFrame([(q, "k") for q in [*asked, None]], "q double, k string")
    xs = [x for b in want for x in (min(b[2]), max(b[2]))]
    ys = [v for b in want for v in (b[0] / b[1],) * 2]
    for most in (50_000, 3):
        out = {r["q"]: r["f"] for r in I.isotonic_predict(rows, blocks, "q", "f", most_steps=most).collect()}
        assert out.pop(None) is None
        for q, f in out.items():
            assert f == pytest.approx(min(max(np.interp(q, xs, ys), 1e-6), 1 - 1e-6), abs=1e-12)
