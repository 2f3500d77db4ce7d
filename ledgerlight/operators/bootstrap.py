"""Paired bootstrap whose iterations are array slots, not copies of the rows.

A row draws its weight for every iteration from a hash of its key, so the draws are made where they are needed and never
shuffled: what moves is one narrow row per (group, model, score, class, key), dealt by ranges of the score.  Rows that share
group, score and class are summed up before that as soon as a task meets ``CELL_ROWS`` of them, so a score that a third of
all rows have arrives as a few rows of sums.

Ranks need what lies below a score.  A first pass adds up the draws of every range, the totals of the ranges before it are
its offsets, and a second pass reads each range in score order from there.  Every pass returns one row of arrays per range,
group and model.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .evaluation import TARGET

CELL_ROWS = 64
CHUNK_ROWS = 4_096  # rows whose draws are held at a time
TIE = 1e-12  # differences up to here are rounding
_EDGES = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])
_CELL = ["_g", "_sign", "_p", "_y"]
_SUMS = ("events", "others", "events_error", "others_error")


def draws(keys: Sequence[str | None], iterations: int, seed: int) -> np.ndarray:
    """Poisson(1) draws by md5 of ``key:iteration:seed`` (as ``poisson_one(uniform_hash(...))``): one row per key."""
    suffixes = [f"{i}:{seed}".encode() for i in range(iterations)]
    out = np.empty((len(keys), iterations))
    for row, key in zip(out, keys, strict=True):
        start = hashlib.md5(b"" if key is None else f"{key}:".encode())
        raw = bytearray()
        for suffix in suffixes:
            state = start.copy()
            state.update(suffix)
            raw += b"\0\0" + state.digest()[:6]
        row[:] = np.frombuffer(bytes(raw), dtype=">u8")
    return np.searchsorted(_EDGES, out / 2.0**48, side="right").astype(np.int64)


def _weights(table: pd.DataFrame, iterations: int, seed: int) -> np.ndarray:
    out = np.zeros((len(table), iterations), dtype=np.int64)
    raw = table["_sums"].isna().to_numpy()
    out[raw] = draws(table["_key"].to_numpy()[raw].tolist(), iterations, seed)
    for n in np.flatnonzero(~raw).tolist():
        out[n] = table["_sums"].iloc[n]
    return out


def _combiner(iterations: int, seed: int):
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = batch.groupby(_CELL, sort=False).ngroup().to_numpy()
            crowded = np.bincount(cell)[cell] >= CELL_ROWS
            yield batch[~crowded].assign(_n=1, _sums=None)
            for _, rows in batch[crowded].groupby(cell[crowded], sort=False):
                total = np.zeros(iterations, dtype=np.int64)
                for at in range(0, len(rows), CHUNK_ROWS):
                    total += draws(rows["_key"].iloc[at: at + CHUNK_ROWS].tolist(), iterations, seed).sum(axis=0)
                yield rows.iloc[:1].assign(_key=None, _n=len(rows), _sums=[total.tolist()])

    return combine


def _range_sums(iterations: int, seed: int):
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (part, g, sign), rows in batch.groupby(["_part", "_g", "_sign"], sort=False):
                sums = np.zeros((4, iterations))
                sizes = np.zeros(2, dtype=np.int64)
                for at in range(0, len(rows), CHUNK_ROWS):
                    some = rows.iloc[at: at + CHUNK_ROWS]
                    weight, y = _weights(some, iterations, seed).astype(np.float64), some["_y"].to_numpy()
                    error = (some["_p"].to_numpy() - y) ** 2
                    for k, kind in enumerate((y == 1, y == 0)):
                        sums[k] += weight[kind].sum(axis=0)
                        sums[2 + k] += error[kind] @ weight[kind]
                        sizes[k] += int(some["_n"].to_numpy()[kind].sum())
                yield pd.DataFrame([{"_part": part, "_g": g, "_sign": sign, "n_events": sizes[0], "n_others": sizes[1],
                                     **{name: sums[k].tolist() for k, name in enumerate(_SUMS)}}])

    return add


_RANGE = "_part int, _g string, _sign int, n_events long, n_others long, " + ", ".join(f"{n} array<double>" for n in _SUMS)
_OFFSET = ("_part int, _g string, _sign int, events_before array<double>, others_before array<double>, "
           "events array<double>, others array<double>, scale array<double>")
_READ = "_g string, _sign int, ranked array<double>, precise array<double>"
_DELTAS = "_g string, iteration long, brier_score_delta double, roc_auc_delta double, average_precision_delta double"


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _scale(sizes: pd.DataFrame, events: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Factors that give every class its own size back; 0 where an iteration draws nothing of it."""
    size = np.array([[sizes["n_events"].sum()], [sizes["n_others"].sum()]], dtype=np.float64)
    drawn = np.stack([events, others])
    return np.divide(size, drawn, out=np.zeros_like(drawn), where=drawn > 0)


def _offsets(ranges: pd.DataFrame) -> pd.DataFrame:
    """What lies below every range of one group and model."""
    table = ranges.groupby("_part", as_index=False).agg(
        {"_g": "first", "_sign": "first", "n_events": "sum", "n_others": "sum",
         **{n: lambda c: _stacked(c).sum(axis=0) for n in ("events", "others")}}).sort_values("_part")
    events, others = _stacked(table["events"]), _stacked(table["others"])
    scale = _scale(table, events.sum(axis=0), others.sum(axis=0)).ravel().tolist()
    return table.assign(
        events_before=list(np.cumsum(events, axis=0) - events), others_before=list(np.cumsum(others, axis=0) - others),
        events=[events.sum(axis=0)] * len(table), others=[others.sum(axis=0)] * len(table), scale=[scale] * len(table))[
        ["_part", "_g", "_sign", "events_before", "others_before", "events", "others", "scale"]]


def _reader(iterations: int, seed: int):
    def read(rows: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        """Numerators of both ranking metrics over one range, scores rising."""
        out = []
        below = {(g, s): r for g, s, r in zip(offsets["_g"], offsets["_sign"], offsets.itertuples(index=False), strict=True)}
        for (g, sign), table in rows.groupby(["_g", "_sign"], sort=False):
            start = below[g, sign]
            table = table.sort_values("_p", kind="stable")
            before = np.stack([start.events_before, start.others_before]).astype(np.float64)
            whole = np.stack([start.events, start.others]).astype(np.float64)
            scale = np.asarray(start.scale, dtype=np.float64).reshape(2, iterations)
            ranked, precise = np.zeros(iterations), np.zeros(iterations)
            scores = table["_p"].to_numpy()
            fresh = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
            at = 0
            while at < len(table):
                # whole scores, and as few of them beyond the chunk size as there can be
                end = int(np.r_[fresh, len(table)][np.searchsorted(fresh, at + CHUNK_ROWS, side="left")]) if at + CHUNK_ROWS < len(table) else len(table)
                some = table.iloc[at:end]
                first = fresh[(fresh >= at) & (fresh < end)] - at
                here = np.zeros((2, len(first), iterations))
                owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, end - at]))
                y = some["_y"].to_numpy()
                for low in range(0, end - at, CHUNK_ROWS):
                    weight = _weights(some.iloc[low: low + CHUNK_ROWS], iterations, seed)
                    for k, kind in enumerate((1, 0)):
                        mine = y[low: low + CHUNK_ROWS] == kind
                        np.add.at(here[k], owner[low: low + CHUNK_ROWS][mine], weight[mine])
                under = before[:, None, :] + np.cumsum(here, axis=1) - here
                ranked += (here[0] * (under[1] + here[1] / 2)).sum(axis=0)
                from_here = (whole[:, None, :] - under) * scale[:, None, :]
                picked = from_here.sum(axis=0)
                precise += (here[0] * np.divide(from_here[0], picked, out=np.zeros_like(picked), where=picked > 0)).sum(axis=0)
                before = before + here.sum(axis=1)
                at = end
            out.append({"_g": g, "_sign": sign, "ranked": ranked.tolist(), "precise": precise.tolist()})
        return pd.DataFrame(out, columns=["_g", "_sign", "ranked", "precise"])

    return read


def _difference(metrics: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
    """Candidate minus reference of one group, per iteration."""
    values, drawn = {}, None
    for sign in (1, -1):
        own, sums = metrics[metrics["_sign"] == sign], ranges[ranges["_sign"] == sign]
        events, others, e_error, o_error = (_stacked(sums[n]).sum(axis=0) for n in _SUMS)
        scale = _scale(sums, events, others)
        drawn = (events + others) > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            brier = (scale[0] * e_error + scale[1] * o_error) / (scale[0] * events + scale[1] * others)
            auc = _stacked(own["ranked"]).sum(axis=0) / np.where(events * others > 0, events * others, np.nan)
            precision = _stacked(own["precise"]).sum(axis=0) / np.where(events > 0, events, np.nan)
        values[sign] = brier, auc, precision
    deltas = [a - b for a, b in zip(values[1], values[-1], strict=True)]
    table = pd.DataFrame({"_g": metrics["_g"].iloc[0], "iteration": np.arange(len(drawn)), **dict(zip(
        ("brier_score_delta", "roc_auc_delta", "average_precision_delta"), deltas, strict=True))})
    return table[drawn]


def bootstrap_deltas(rows: DataFrame, candidate: str, reference: str, key: str, iterations: int, seed: int = 42,
                     groups: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """Per iteration: candidate minus reference in Brier score, ROC AUC and average precision.

    Each row gets a Poisson(1) weight from a hash of its key and the iteration, and weights are rescaled so that every
    class keeps its size.  Both models see the same weights.  A metric that an iteration does not define (it drew
    one class only) is NULL, and an iteration without any row is left out.
    """
    groups = list(groups)
    group = F.to_json(F.struct(*groups)) if groups else F.lit("")
    models = F.explode(F.array(
        F.struct(F.lit(1).alias("_sign"), F.col(candidate).cast("double").alias("_p")),
        F.struct(F.lit(-1).alias("_sign"), F.col(reference).cast("double").alias("_p"))))
    long = rows.select(group.alias("_g"), F.col(target).cast("int").alias("_y"), F.col(key).cast("string").alias("_key"), models.alias("_m")).select(
        "_g", "_m._sign", "_m._p", "_y", "_key").where("_p IS NOT NULL AND _y IN (0, 1)")
    packed = long.mapInPandas(
        _combiner(iterations, seed), "_g string, _sign int, _p double, _y int, _key string, _n long, _sums array<long>")
    dealt = cut_lineage(packed.repartitionByRange("_g", "_sign", "_p").withColumn("_part", F.spark_partition_id()))
    ranges = cut_lineage(dealt.mapInPandas(_range_sums(iterations, seed), _RANGE))
    offsets = ranges.groupBy("_g", "_sign").applyInPandas(_offsets, _OFFSET)
    metrics = dealt.groupBy("_part").cogroup(offsets.groupBy("_part")).applyInPandas(_reader(iterations, seed), _READ)
    deltas = metrics.groupBy("_g").cogroup(ranges.groupBy("_g")).applyInPandas(_difference, _DELTAS)
    names = ["iteration", "brier_score_delta", "roc_auc_delta", "average_precision_delta"]
    if not groups:
        return deltas.select(*names)
    known = rows.select(*groups, group.alias("_g")).distinct()
    return deltas.join(known, "_g").select(*groups, *names)


def bootstrap_summary(deltas: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean, 95 % interval and share of iterations in favour of the candidate (rows = iterations)."""
    out = []
    for name, better in (("brier_score", -1), ("roc_auc", 1), ("average_precision", 1)):
        c = F.col(f"{name}_delta")
        out += [
            F.avg(c).alias(f"{name}_mean"),
            F.percentile(c, F.lit(0.025)).alias(f"{name}_low"),
            F.percentile(c, F.lit(0.975)).alias(f"{name}_high"),
            F.avg(F.when(c * better > TIE, 1.0).otherwise(0.0)).alias(f"{name}_support")]
    return deltas.groupBy(*groups).agg(F.count(F.lit(1)).alias("iterations"), *out)
