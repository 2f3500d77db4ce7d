"""Boosted trees on a shared matrix of bins.

*Matrix.*  Every model column becomes one small whole number per row: numeric values are placed between exact quantiles of
the development rows (a missing value stands where the median stands, next to a 0/1 column that marks it), categories get
their place among the frequent levels in alphabetical order (place 0: missing, rare or unknown).  A row's bins are one
binary value, one byte a column, so the matrix is written once and any model reads the columns it declares.

*Fit.*  Growing a tree needs sums of gradients per (node, column, bin) and nothing else.  Every model is fitted on all labelled
rows.  Few rows are one task per model, many models side by side.  More rows are dealt over the tasks of a barrier stage: each
task keeps its rows and sums them up for all models, the sums of a share of the columns meet in one task, which finds the
best cuts of these columns, and all tasks learn the best of all columns.  Scoring reads every row of the matrix.
"""

from __future__ import annotations

import uuid
from collections.abc import Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import stage_folder
from .application import Selection
from .meeting import Each, Meeting, Total, shard_count
from .ordering import bucket_counts, bucket_quantiles
from .preprocess import MISSING_SUFFIX, level_counts
from .quality import long_columns

BINS = 64
MOST_LEVELS = 255
LEAST_LEVEL_ROWS = 100
FIT_ROWS = 20_000  # labelled rows that are fitted in one task per model; more are dealt over tasks
LEAF_WEIGHT = 1.0  # added to the curvature of every leaf
GRAIN = 2.0**28  # gradients of dealt rows are whole multiples of its inverse: sums of 33 million are exact in any order


# ---------------------------------------------------------------- matrix

@dataclass(frozen=True)
class Layout:
    """What the bytes of a matrix row mean: edges of numeric columns, levels of categories, marks of missing values."""

    edges: Mapping[str, list[float]]
    medians: Mapping[str, float]
    marked: tuple[str, ...]
    levels: Mapping[str, list[str]]

    @property
    def columns(self) -> list[str]:
        return [*sorted(self.edges), *[f"{c}{MISSING_SUFFIX}" for c in self.marked], *sorted(self.levels)]

    def places(self, names: Sequence[str]) -> list[int]:
        """Bytes of the named features, with the marks of those that have one."""
        wanted = set(names)
        return [n for n, c in enumerate(self.columns) if c.removesuffix(MISSING_SUFFIX) in wanted]


def learn_layout(rows: DataFrame, selection: Selection, bins: int = BINS, least_rows: int = LEAST_LEVEL_ROWS) -> Layout:
    """Quantile edges, medians, missing marks and frequent levels of development rows.

    What reaches the driver is ``bins`` edges per numeric column and the frequent levels of the categories, each of which
    covers ``least_rows`` rows; more than ``MOST_LEVELS`` of them in a column are an error.
    """
    numeric = sorted(selection.numeric)
    edges: dict[str, list[float]] = {c: [] for c in numeric}
    medians, marked = dict.fromkeys(numeric, 0.0), set()
    if numeric:
        long = long_columns(rows.select(*[F.col(c).cast("double").alias(c) for c in numeric])).select(
            "_pos", F.when(~F.isnan("value"), F.col("value")).alias("value"))
        counts = bucket_counts(long, "value", ["_pos"])
        marked = {numeric[r._pos] for r in counts.where("_bucket IS NULL").select("_pos").collect()}
        wanted = sorted({*[i / bins for i in range(1, bins)], 0.5})
        for r in bucket_quantiles(long, counts, "value", wanted, ["_pos"]).collect():
            if r.q == 0.5:
                medians[numeric[r._pos]] = r.quantile
            if bins % 2 == 0 or r.q != 0.5:
                edges[numeric[r._pos]].append(r.quantile)
    levels: dict[str, list[str]] = {c: [] for c in selection.categorical}
    if selection.categorical:
        for r in level_counts(rows, selection.categorical).where(F.col("rows") >= least_rows).collect():
            levels[r.feature].append(r.level)
        crowded = [c for c, names in levels.items() if len(names) > MOST_LEVELS]
        if crowded:
            raise ValueError(f"more than {MOST_LEVELS} frequent levels: {crowded}")
    return Layout({c: sorted(set(e)) for c, e in edges.items()}, medians, tuple(sorted(marked)),
                  {c: sorted(names) for c, names in levels.items()})


def binned_matrix(rows: DataFrame, layout: Layout, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``bins`` for every row; columns that ``rows`` lacks are missing throughout."""
    numeric, categorical = sorted(layout.edges), sorted(layout.levels)
    marked = set(layout.marked)
    inputs = [F.col(c).cast("double").alias(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in numeric]
    inputs += [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in categorical]
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    edges = {c: np.array(layout.edges[c]) for c in numeric}
    codes = {c: {level: n + 1 for n, level in enumerate(layout.levels[c])} for c in categorical}
    medians = dict(layout.medians)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, marks = [], []
            for c in numeric:
                column = batch[c].to_numpy(dtype=np.float64, na_value=np.nan)
                missing = np.isnan(column)
                values.append(np.searchsorted(edges[c], np.where(missing, medians[c], column), side="left"))
                if c in marked:
                    marks.append(missing)
            values += marks + [batch[c].map(codes[c]).fillna(0).to_numpy() for c in categorical]
            matrix = np.stack(values, axis=1).astype(np.uint8) if values else np.zeros((len(batch), 0), dtype=np.uint8)
            out = batch[[f"_keep_{c}" for c in keep]].set_axis(list(keep), axis=1)
            yield out.assign(bins=[row.tobytes() for row in matrix])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*kept, *inputs).mapInPandas(place, f"{fields}, bins binary")


def bin_counts(matrix: DataFrame, layout: Layout, target: str) -> DataFrame:
    """``feature, bin, rows, events`` of a matrix: what every tree of every model is grown from at its root."""
    names = layout.columns

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins, y = _matrix(batch["bins"]), batch[target].to_numpy(dtype=np.float64)
            out = []
            for n, name in enumerate(names):
                rows = np.bincount(bins[:, n], minlength=256)
                there = np.flatnonzero(rows)
                events = np.bincount(bins[:, n], y, 256)
                out.append(pd.DataFrame({"feature": name, "bin": there, "rows": rows[there], "events": events[there].astype(np.int64)}))
            yield pd.concat(out, ignore_index=True)

    return matrix.select("bins", target).mapInPandas(count, "feature string, bin long, rows long, events long").groupBy(
        "feature", "bin").agg(F.sum("rows").alias("rows"), F.sum("events").alias("events"))


def _matrix(column: pd.Series) -> np.ndarray:
    width = len(column.iloc[0]) if len(column) else 0
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), width)


# ---------------------------------------------------------------- trees

@dataclass(frozen=True)
class Settings:
    """How a model is grown.  ``patience``: rounds without a better log loss on the early-stop rows."""

    rounds: int = 300
    step: float = 0.1
    depth: int = 5
    least_rows: int = 80
    row_share: float = 0.85
    column_share: float = 0.8
    patience: int = 20
    seed: int = 42


#: Settings of the declared variants; the declared step is for a learner that takes four times as many rounds.
STANDARD = Settings()
HIGH_CAPACITY = Settings(step=0.08, depth=6, least_rows=60, column_share=0.9)


@dataclass
class Forest:
    """Trees as arrays of heap-ordered nodes: children of ``i`` are ``2 i + 1`` (bin <= cut) and ``2 i + 2``."""

    base: float
    places: np.ndarray  # node -> byte of the matrix, -1 at leaves; one row per tree
    cuts: np.ndarray
    values: np.ndarray
    gains: np.ndarray

    def scores(self, bins: np.ndarray) -> np.ndarray:
        total, every = np.full(len(bins), self.base), np.arange(len(bins))
        depth = (self.places.shape[1] + 1).bit_length() - 2 if len(self.places) else 0
        for places, cuts, values in zip(self.places, self.cuts, self.values, strict=True):
            total += values[_leaves(bins, every, places, cuts, depth)]
        return total


def _leaves(bins: np.ndarray, every: np.ndarray, places: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(bins), dtype=np.int64)
    for _ in range(depth):
        place = places[node]
        inner = place >= 0
        node = np.where(inner, 2 * node + 1 + (bins[every, place] > cuts[node]), node)
    return node


def _grow(bins: np.ndarray, pull: np.ndarray, weight: np.ndarray, columns: np.ndarray, how: Settings):
    """One tree on the given rows: level by level, the best cut of every node from its histograms."""
    size = 2 ** (how.depth + 1) - 1
    places, cuts = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
    values, gains = np.zeros(size), np.zeros(size)
    node, open_rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    by_column = np.ascontiguousarray(bins.T)
    widths = (by_column.max(axis=1).astype(np.int64) + 1 if len(bins) else np.ones(len(by_column), dtype=np.int64)).tolist()  # bins in use
    for level in range(how.depth + 1):
        first, width = 2**level - 1, 2**level
        local = node[open_rows] - first
        g, h = pull[open_rows], weight[open_rows]
        all_g, all_h = np.bincount(local, g, width), np.bincount(local, h, width)
        values[first: first + width] = how.step * all_g / (all_h + LEAF_WEIGHT)
        if level == how.depth or not len(open_rows):
            break
        best, best_place, best_cut = np.full(width, 1e-9), np.full(width, -1), np.zeros(width, dtype=np.int64)
        whole = all_g**2 / (all_h + LEAF_WEIGHT)
        for c in columns.tolist():
            wide = widths[c]
            if wide == 1:
                continue
            key = local * wide + by_column[c][open_rows]
            left_n = np.bincount(key, minlength=width * wide).reshape(width, wide).cumsum(axis=1)
            if left_n[:, 0].sum() == len(open_rows):
                continue
            left_g = np.bincount(key, g, width * wide).reshape(width, wide).cumsum(axis=1)
            left_h = np.bincount(key, h, width * wide).reshape(width, wide).cumsum(axis=1)
            gain = (left_g**2 / (left_h + LEAF_WEIGHT)
                    + (all_g[:, None] - left_g) ** 2 / (all_h[:, None] - left_h + LEAF_WEIGHT) - whole[:, None])
            fits = (left_n >= how.least_rows) & (left_n[:, -1:] - left_n >= how.least_rows)
            gain = np.where(fits, gain, 0.0)
            cut = gain.argmax(axis=1)
            top = gain[np.arange(width), cut]
            better = top > best
            best[better], best_place[better], best_cut[better] = top[better], c, cut[better]
        split = best_place >= 0
        places[first: first + width], cuts[first: first + width] = best_place, best_cut
        gains[first: first + width] = np.where(split, best, 0.0)
        open_rows, local = open_rows[split[local]], local[split[local]]
        place, cut = best_place[local], best_cut[local]
        node[open_rows] = 2 * (local + first) + 1 + (bins[open_rows, place] > cut)
    return places, cuts, values, gains


def _log_loss(y: np.ndarray, score: np.ndarray) -> float:
    return float((np.logaddexp(0, score) - y * score).mean())


def boost(bins: np.ndarray, y: np.ndarray, columns: Sequence[int], how: Settings, held: np.ndarray | None = None) -> Forest:
    """Trees on the rows outside ``held``; with ``held``, as many as its log loss asks for."""
    fit = np.flatnonzero(~held) if held is not None else np.arange(len(y))
    rate = float(np.clip(y[fit].mean(), 1e-6, 1 - 1e-6))
    base, draw = float(np.log(rate / (1 - rate))), np.random.default_rng(how.seed)
    score, trees, every = np.full(len(y), base), [], np.arange(len(y))
    columns = np.asarray(columns, dtype=np.int64)
    best, best_rounds = np.inf, 0
    for n in range(how.rounds):
        rows = np.sort(draw.choice(fit, max(1, int(how.row_share * len(fit))), replace=False))
        some = np.sort(draw.choice(columns, max(1, int(np.ceil(how.column_share * len(columns)))), replace=False))
        p = 1 / (1 + np.exp(-score[rows]))
        tree = _grow(bins[rows], y[rows] - p, p * (1 - p), some, how)
        trees.append(tree)
        score += tree[2][_leaves(bins, every, tree[0], tree[1], how.depth)]
        if held is not None:
            loss = _log_loss(y[held], score[held])
            if loss < best - 1e-7:
                best, best_rounds = loss, n + 1
            elif n + 1 - best_rounds >= how.patience:
                break
    trees = trees[:max(1, best_rounds)] if held is not None else trees
    return Forest(base, *[np.stack([t[k] for t in trees]) for k in range(4)])


# ---------------------------------------------------------------- trees on dealt rows

@dataclass
class _Shard:
    """The rows of one task.  ``mark`` is a hash of the row: draws come from it, wherever the row is."""

    bins: np.ndarray
    y: np.ndarray
    held: np.ndarray
    mark: np.ndarray
    widths: list[int]  # bins in use per column, over all shards

    def __post_init__(self) -> None:
        self.by_column = np.ascontiguousarray(self.bins.T)

    def drawn(self, how: Settings, n: int) -> np.ndarray:
        """Whether a row takes part in tree ``n``."""
        return _mixed(self.mark ^ _mixed(np.array([how.seed * 1_000_003 + n], dtype=np.uint64))) <= how.row_share * 2.0**64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grain(x: np.ndarray) -> np.ndarray:
    return np.rint(x * GRAIN) / GRAIN


def _sums(shard: _Shard, columns: Sequence[int], rows: np.ndarray, slot: np.ndarray, slots: int, pull: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``(rows, pull, weight) x slot x bins of the columns``."""
    out, at = np.empty((3, slots, sum(shard.widths[c] for c in columns))), 0
    for c in columns:
        wide = shard.widths[c]
        key = slot * wide
        key += shard.by_column[c][rows]
        for k, by in enumerate((None, pull, weight)):
            out[k, :, at: at + wide] = np.bincount(key, by, slots * wide).reshape(slots, wide)
        at += wide
    return out


def _own_cuts(sums: np.ndarray, whole: np.ndarray, columns: Sequence[int], widths: Sequence[int], how: Settings) -> np.ndarray:
    """The best cut of every node among the columns: gain, place, cut, and the three sums left of it."""
    nodes = sums.shape[1]
    best, at, every = np.tile([1e-9, -1, 0, 0, 0, 0], (nodes, 1)), 0, np.arange(nodes)
    before = whole[:, 1] ** 2 / (whole[:, 2] + LEAF_WEIGHT)
    for c in columns:
        left = sums[:, :, at: at + widths[c]].cumsum(axis=2)
        at += widths[c]
        right = whole.T[:, :, None] - left
        gain = left[1] ** 2 / (left[2] + LEAF_WEIGHT) + right[1] ** 2 / (right[2] + LEAF_WEIGHT) - before[:, None]
        gain = np.where((left[0] >= how.least_rows) & (right[0] >= how.least_rows), gain, 0.0)
        cut = gain.argmax(axis=1)
        top = gain[every, cut]
        better = top > best[:, 0]
        best[better] = np.column_stack([top, np.full(nodes, c), cut, *left[:, every, cut]])[better]
    return best


def _grow_dealt(shard: _Shard, rows: np.ndarray, pull: np.ndarray, weight: np.ndarray, whole: np.ndarray, columns: np.ndarray,
                how: Settings, shards: int, index: int) -> Generator[Total | Each, np.ndarray, tuple[np.ndarray, ...]]:
    """One tree as ``_grow`` makes it, on the rows of all shards.

    Of two children only the one with fewer rows is summed up; the other one is what its parent has beyond it.
    """
    size = 2 ** (how.depth + 1) - 1
    places, cuts = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
    values, gains = np.zeros(size), np.zeros(size)
    values[0] = how.step * whole[1] / (whole[2] + LEAF_WEIGHT)
    columns = [c for c in columns.tolist() if shard.widths[c] > 1]
    owned = [part.tolist() for part in np.array_split(np.array(columns, dtype=np.int64), shards)]
    ends = np.cumsum([sum(shard.widths[c] for c in part) for part in owned]).tolist()
    node, nodes, whole, summed, parents = np.zeros(len(rows), dtype=np.int64), np.array([0]), whole[None], np.array([0]), None
    for _ in range(how.depth if columns else 0):
        slot_of = np.full(size, -1)
        slot_of[summed] = np.arange(len(summed))
        slot = slot_of[node]
        there = np.flatnonzero(slot >= 0)
        sums = _sums(shard, columns, rows[there], slot[there], len(summed), pull[there], weight[there])
        own = yield Total([sums[:, :, a:b] for a, b in zip([0, *ends], ends)])
        if parents is not None:
            both = np.empty((3, len(nodes), own.shape[2]))
            at = np.searchsorted(nodes, summed)
            both[:, at], both[:, at ^ 1] = own, parents - own
            own = both
        found = yield Each(_own_cuts(own, whole, owned[index], shard.widths, how))
        best = found[0]
        for other in found[1:]:
            best = np.where((other[:, 0] > best[:, 0])[:, None], other, best)
        split = best[:, 1] >= 0
        if not split.any():
            break
        cut_nodes, best = nodes[split], best[split]
        places[cut_nodes], cuts[cut_nodes], gains[cut_nodes] = best[:, 1].astype(np.int64), best[:, 2].astype(np.int64), best[:, 0]
        parents = own[:, split]
        left, right = best[:, 3:], whole[split] - best[:, 3:]
        nodes = (2 * cut_nodes[:, None] + [1, 2]).ravel()
        whole = np.stack([left, right], axis=1).reshape(-1, 3)
        values[nodes] = how.step * whole[:, 1] / (whole[:, 2] + LEAF_WEIGHT)
        summed = np.where(left[:, 0] <= right[:, 0], nodes[::2], nodes[1::2])
        place = places[node]
        inner = np.flatnonzero(place >= 0)
        now = node[inner]
        node[inner] = 2 * now + 1 + (shard.bins[rows[inner], place[inner]] > cuts[now])
    return places, cuts, values, gains


def _boost_dealt(shard: _Shard, columns: Sequence[int], how: Settings, tuning: bool, shards: int,
                 index: int) -> Generator[Total | Each, np.ndarray, Forest]:
    """``boost`` on the rows of all shards; with ``tuning``, as many trees as the log loss of the held rows asks for."""
    use = ~shard.held if tuning else np.ones(len(shard.y), dtype=bool)
    held = np.flatnonzero(~use)
    rows, events, others = (yield Each(np.array([use.sum(), shard.y[use].sum(), len(held)], dtype=np.float64))).sum(axis=0)
    rate = float(np.clip(events / rows, 1e-6, 1 - 1e-6))
    base, draw = float(np.log(rate / (1 - rate))), np.random.default_rng(how.seed)
    score, trees, every = np.full(len(shard.y), base), [], np.arange(len(shard.y))
    columns = np.asarray(columns, dtype=np.int64)
    best, best_rounds = np.inf, 0
    for n in range(how.rounds + tuning):
        drawn = np.flatnonzero(use & shard.drawn(how, n))
        p = 1 / (1 + np.exp(-score[drawn]))
        pull, weight = _grain(shard.y[drawn] - p), _grain(p * (1 - p))
        lost = _grain(np.logaddexp(0, score[held]) - shard.y[held] * score[held]).sum()
        *whole, lost = (yield Each(np.array([len(drawn), pull.sum(), weight.sum(), lost]))).sum(axis=0)
        if tuning and n:  # of the trees so far
            if lost / others < best - 1e-7:
                best, best_rounds = lost / others, n
            elif n - best_rounds >= how.patience:
                break
        if n == how.rounds:
            break
        some = np.sort(draw.choice(columns, max(1, int(np.ceil(how.column_share * len(columns)))), replace=False))
        tree = yield from _grow_dealt(shard, drawn, pull, weight, np.array(whole), some, how, shards, index)
        trees.append(tree)
        score += tree[2][_leaves(shard.bins, every, tree[0], tree[1], how.depth)]
    trees = trees[:max(1, best_rounds)] if tuning else trees
    return Forest(base, *[np.stack([t[k] for t in trees]) for k in range(4)])


# ---------------------------------------------------------------- models over the matrix

@dataclass(frozen=True)
class Plan:
    """A model to fit: its name, the bytes of the matrix that it may read, and how it is grown."""

    name: str
    places: tuple[int, ...]
    how: Settings = STANDARD


_FITTED = ("model string, rounds int, base double, width int, places array<int>, cuts array<int>, values array<double>, gains array<double>")


def fit_plans(development: DataFrame, plans: Sequence[Plan], key: str, target: str, fit_rows: int = FIT_ROWS) -> dict[str, Forest]:
    """Every plan fitted with early stopping and fitted again, on all rows of ``development``.

    ``development`` has ``key, target, tuning_role, bins``.  Up to ``fit_rows`` rows are fitted in one task per plan.  More are
    dealt over all tasks that run at once (an eighth of ``fit_rows`` or more for each), all plans side by side in every task;
    the models then do not depend on the number of tasks.  The models (arrays of nodes) come back to the driver.
    """
    rows = development.select(key, target, "tuning_role", "bins")
    n = rows.count()
    fitted = _fit_apart(rows, plans, key, target) if n <= fit_rows else _fit_dealt(rows, plans, target, -(-8 * n // fit_rows))

    def nodes(r, name: str, kind) -> np.ndarray:
        return np.array(r[name], dtype=kind).reshape(-1, r.width)

    return {r.model: Forest(r.base, nodes(r, "places", np.int64), nodes(r, "cuts", np.int64), nodes(r, "values", np.float64),
                            nodes(r, "gains", np.float64)) for r in fitted}


def _fitted(plan: Plan, rounds: int, forest: Forest) -> dict:
    return {"model": plan.name, "rounds": rounds, "base": forest.base, "width": forest.places.shape[1],
            "places": forest.places.ravel().tolist(), "cuts": forest.cuts.ravel().tolist(),
            "values": forest.values.ravel().tolist(), "gains": forest.gains.ravel().tolist()}


def _fit_apart(rows: DataFrame, plans: Sequence[Plan], key: str, target: str) -> list[Row]:
    """Each plan in a task of its own that holds all rows."""
    by_slot = dict(enumerate(plans))

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        plan = by_slot[int(table["slot"].iloc[0])]
        table = table.sort_values(key)
        bins, y = _matrix(table["bins"]), table[target].to_numpy(dtype=np.float64)
        held = (table["tuning_role"] == "early_stop").to_numpy()
        rounds = len(boost(bins, y, plan.places, plan.how, held).places) if held.any() and not held.all() else plan.how.rounds
        return pd.DataFrame([_fitted(plan, rounds, boost(bins, y, plan.places, Settings(**{**plan.how.__dict__, "rounds": rounds})))])

    dealt = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(plans) - 1))))
    return dealt.repartitionByRange(len(plans), "slot").groupBy("slot").applyInPandas(fit, _FITTED).collect()


def _fit_dealt(rows: DataFrame, plans: Sequence[Plan], target: str, wanted: int) -> list[Row]:
    """All plans in every task, each of which holds its share of the rows."""
    spark = rows.sparkSession
    shards, folder = shard_count(spark.sparkContext, wanted), f"{stage_folder(spark)}/trees-{uuid.uuid4().hex}"

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(_matrix(b["bins"]), b[target].to_numpy(dtype=np.float64), (b["tuning_role"] == "early_stop").to_numpy(),
                  b["_mark"].to_numpy(dtype=np.int64)) for b in batches if len(b)]
        meeting = Meeting(shards, folder)
        wide = max((p[0].shape[1] for p in parts), default=0)
        parts.append((np.zeros((0, wide), dtype=np.uint8), np.zeros(0), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)))
        bins, y, held, mark = (np.concatenate(column) for column in zip(*parts, strict=True))
        del parts
        wide = int(meeting.answer({0: Each(np.array([wide]))})[0].max())
        bins = bins if len(bins) else np.zeros((0, wide), dtype=np.uint8)
        order = np.argsort(mark, kind="stable")
        bins, y, held, mark = bins[order], y[order], held[order], mark[order]
        # Rows that are alike have one hash; each gets draws of its own by its place among them.
        first = np.flatnonzero(np.diff(mark, prepend=mark[:1] - 1)) if len(mark) else np.zeros(0, dtype=np.int64)
        again = np.arange(len(mark)) - np.repeat(first, np.diff(np.append(first, len(mark))))
        used = bins.max(axis=0).astype(np.int64) + 1 if len(bins) else np.ones(wide, dtype=np.int64)
        facts = meeting.answer({0: Each(np.append(used, [held.sum(), len(held)]))})[0]
        shard = _Shard(bins, y, held, _mixed(mark.view(np.uint64)) + again.astype(np.uint64), facts[:, :wide].max(axis=0).tolist())
        some_held, every = facts[:, wide:].sum(axis=0).tolist()

        def both(plan: Plan):
            rounds = plan.how.rounds
            if 0 < some_held < every:
                rounds = len((yield from _boost_dealt(shard, plan.places, plan.how, True, shards, meeting.index)).places)
            how = Settings(**{**plan.how.__dict__, "rounds": rounds})
            return _fitted(plan, rounds, (yield from _boost_dealt(shard, plan.places, how, False, shards, meeting.index)))

        fitted = meeting.run([both(plan) for plan in plans])
        if meeting.index == 0:
            yield pd.DataFrame(fitted)

    marked = rows.select(target, "tuning_role", "bins", F.xxhash64(*rows.columns).alias("_mark"))
    store, root = fs.FileSystem.from_uri(folder)
    try:
        return marked.repartition(shards, "_mark").mapInPandas(fit, _FITTED, barrier=shards > 1).collect()
    finally:
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


def predict_all(matrix: DataFrame, forests: Mapping[str, Forest], keep: Sequence[str]) -> DataFrame:
    """``keep, model, p`` for every row and model, the matrix read once."""
    shared = matrix.sparkSession.sparkContext.broadcast(dict(forests))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = _matrix(batch["bins"])
            for name, forest in shared.value.items():
                yield batch[list(keep)].assign(model=name, p=1 / (1 + np.exp(-forest.scores(bins))))

    fields = ", ".join(f"`{c}` {matrix.schema[c].dataType.simpleString()}" for c in keep)
    return matrix.select(*keep, "bins").mapInPandas(score, f"{fields}, model string, p double")


def gain_importance(spark, forest: Forest, layout: Layout) -> DataFrame:
    """``feature, gain``: share of split gain per feature, marks of missing values folded into theirs (one row per column)."""
    gains = np.bincount(forest.places[forest.places >= 0], forest.gains[forest.places >= 0], len(layout.columns))
    rows = [(c.removesuffix(MISSING_SUFFIX), float(g)) for c, g in zip(layout.columns, gains / max(gains.sum(), 1e-300), strict=True)]
    return spark.createDataFrame(rows, "feature string, gain double").groupBy("feature").agg(F.sum("gain").alias("gain"))
