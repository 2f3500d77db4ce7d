"""Near-duplicate embeddings by cross-polytope hashing with multiprobe buckets.

A vector is turned by three rounds of random signs and a fast Hadamard transform; the nearest corner of the
cross-polytope (the largest coordinate and its sign) is one hash, ``DEPTH`` of them name a bucket, and ``TABLES``
independent tables are kept.  Next to its own bucket a vector probes the ``PROBES`` buckets that lie next nearest: a pair is
a candidate where one of its vectors owns a bucket that the other owns or probes.  Candidates are verified with their
cosine in double precision.  Buckets are read in cells of bounded size (see ``cells``).  A pair found by several tables is
counted in the first of them only, so link counts need no table of pairs, and cells give spanning forests only.

Vectors that are equal share a class and are hashed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import cell_pairs, forest, inner_pairs, into_cells, whole_cells
from .graph import components
from .staging import ship_by_value, stage

ship_by_value(__name__)

TABLES, DEPTH, PROBES, CORNERS = 12, 3, 4, 3
SMALL = 48  # cells of up to so many rows are compared together
LEAST_COSINE = 0.93
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the width is a power of two."""
    out, step = x.copy(), 1
    while step < out.shape[1]:
        halves = out.reshape(len(out), -1, 2, step)
        out = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(x.shape)
        step *= 2
    return out / np.sqrt(x.shape[1])


def corners(x: np.ndarray, table: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest ``CORNERS`` corners of each row under one rotation, and what each one loses against the nearest."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    turned = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    draw = np.random.default_rng([SEED, table, depth])
    for _ in range(3):
        turned = hadamard(turned * draw.choice([-1.0, 1.0], width))
    size = np.abs(turned)
    near = np.argsort(-size, axis=1, kind="stable")[:, :CORNERS]
    best = np.take_along_axis(size, near, axis=1)
    corner = 2 * near + (np.take_along_axis(turned, near, axis=1) < 0)
    return corner, (best[:, :1] - best) ** 2


def buckets(x: np.ndarray) -> np.ndarray:
    """``(rows, TABLES, 1 + PROBES)`` bucket numbers of unit vectors: the own bucket, then the probed ones."""
    out = np.zeros((len(x), TABLES, 1 + PROBES), dtype=np.int64)
    ways = np.stack(np.meshgrid(*[np.arange(min(CORNERS, 2 * x.shape[1]))] * DEPTH, indexing="ij"), axis=-1).reshape(-1, DEPTH)
    for table in range(TABLES):
        hashed = [corners(x, table, depth) for depth in range(DEPTH)]
        number = 0
        for d, (c, _) in enumerate(hashed):
            number = number * (1 << (1 + max(1, (x.shape[1] - 1).bit_length()))) + c[:, ways[:, d] % c.shape[1]].astype(np.int64)
        loss = sum(lo[:, ways[:, d] % lo.shape[1]] for d, (_, lo) in enumerate(hashed))
        order = np.argsort(loss, axis=1, kind="stable")[:, : 1 + PROBES]
        out[:, table] = np.take_along_axis(number, order, axis=1)
    return out


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # keeps the squares of extreme values finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _number_type(width: int) -> type:
    return np.int32 if (4 * width) ** DEPTH < 1 << 31 else np.int64


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every class its buckets (``keys``), its bucket numbers (``every``) and its vector, in the narrowest exact type."""
    for batch in batches:
        for width, same in batch.groupby(batch["embedding"].map(len)):
            rows = np.stack([np.asarray(v, dtype=np.float64) for v in same["embedding"]])
            every = buckets(_units(rows))
            group = pd.util.hash_array(same["label"].to_numpy(dtype=np.int64)).astype(np.uint64) + np.uint64(width)
            table = np.arange(TABLES, dtype=np.uint64)[None, :, None]
            keys = (every.astype(np.uint64) * np.uint64(TABLES) + table) ^ group[:, None, None]
            with np.errstate(over="ignore"):
                narrow = rows.astype(np.float32)
            exact = (narrow == rows).all(axis=1)
            yield pd.DataFrame({
                "cls": same["cls"].to_numpy(), "copies": same["copies"].to_numpy(), "label": same["label"].to_numpy(),
                "width": np.int32(width), "keys": list(keys.reshape(len(same), -1).view(np.int64)),
                "every": [e.astype(_number_type(width)).tobytes() for e in every],
                "vector": [(n if e else r).tobytes() for n, r, e in zip(narrow, rows, exact, strict=True)]})


def _vectors(raw: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=np.float32 if len(v) == 4 * width else np.float64) for v in raw]).astype(np.float64)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole, cuts in whole_cells(batches, 8_000):
        whole = whole.reset_index(drop=True)
        cell = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        for width, part in whole.groupby("width"):  # one width a bucket, but for a clash of hashes
            table, at = part.reset_index(drop=True), cell[part.index]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            yield from _linked_cells(table, starts, np.r_[starts[1:], len(table)], int(width))


def _linked_cells(table: pd.DataFrame, starts: np.ndarray, ends: np.ndarray, width: int) -> Iterator[pd.DataFrame]:
    cls, copies, label, tab, own, part, lo, hi = (
        table[c].to_numpy() for c in ("cls", "copies", "label", "tab", "own", "part", "lo", "hi"))
    unit = _units(_vectors(table["vector"], width))
    every = np.frombuffer(b"".join(table["every"]), dtype=_number_type(width)).reshape(-1, TABLES, 1 + PROBES)
    links = np.zeros(len(table), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        """Count the close pairs that no earlier table and no other bucket of this table counts."""
        mine, theirs = every[a], every[b]
        meets = (mine[:, :, :1] == theirs).any(axis=2) | (mine == theirs[:, :, :1]).any(axis=2)
        at, each = meets.argmax(axis=1), np.arange(len(a))
        # inside a table each may probe the other's bucket: then the smaller one's bucket counts
        mine, theirs = mine[each, at], theirs[each, at]
        mutual = (mine[:, :1] == theirs[:, 1:]).any(axis=1) & (theirs[:, :1] == mine[:, 1:]).any(axis=1)
        first = (at == tab[a]) & (~mutual | (own[a] == (cls[a] < cls[b])))
        a, b = a[first], b[first]
        links[:] += np.bincount(a, copies[b], len(table)).astype(np.int64) + np.bincount(b, copies[a], len(table)).astype(np.int64)
        found.append((a, b))

    small = (lo[starts] == hi[starts]) & (ends - starts <= SMALL)
    for at in range(0, int(small.sum()), 2_000):
        a, b = inner_pairs(starts[small][at: at + 2_000], ends[small][at: at + 2_000])
        able = (own[a] | own[b]) & (cls[a] != cls[b]) & (label[a] == label[b]) & (tab[a] == tab[b])
        a, b = a[able], b[able]
        near = np.concatenate([np.einsum("ij,ij->i", unit[a[k: k + 50_000]], unit[b[k: k + 50_000]])
                               for k in range(0, len(a), 50_000)] or [np.zeros(0)]) >= LEAST_COSINE
        keep(a[near], b[near])
    for start, end in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        left, right = cell_pairs(part[start:end], lo[start], hi[start])
        left, right = left + start, right + start
        close = unit[left] @ unit[right].T >= LEAST_COSINE
        close &= (own[left][:, None] | own[right][None, :]) & (cls[left][:, None] != cls[right][None, :])
        close &= (label[left][:, None] == label[right][None, :]) & (tab[left][:, None] == tab[right][None, :])
        if lo[start] == hi[start]:
            close &= left[:, None] < right[None, :]
        x, y = np.nonzero(close)
        for k in range(0, len(x), 20_000):
            keep(left[x[k: k + 20_000]], right[y[k: k + 20_000]])
    if not sum(len(a) for a, _ in found):
        return
    a, b = (np.concatenate(side) for side in zip(*found, strict=True))
    names, at = np.unique(cls, return_inverse=True)
    member, root = forest(len(names), at[a], at[b])
    hit = np.flatnonzero(links)
    yield pd.DataFrame({"a": cls[hit], "b": cls[hit], "links": links[hit]})
    yield pd.DataFrame({"a": names[member], "b": names[root], "links": np.int64(0)})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label, ...)``.

    Vectors are compared where their labels are equal and not null and their lengths agree.  A vector that is null,
    empty or zero or has null or non-finite components links with nothing.  Repeated rows are vectors of their own and link with
    each other; a row without ``vec_id`` takes part but names no component.  Other columns are ignored; an empty
    table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.coalesce(
        F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0), F.lit(False))
    plain = F.transform("embedding", lambda v: v + F.lit(0.0))  # minus zero becomes zero
    keyed = rows.withColumn("embedding", F.when(sound, plain)).withColumn(
        "digest", F.when(F.col("embedding").isNotNull(), F.sha2(F.concat_ws(
            ",", F.col("label").cast("string"), F.col("embedding").cast("array<string>")), 256)))
    usable = keyed.where("digest IS NOT NULL")
    classes = stage(usable.groupBy("digest").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding")).withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    hashed = stage(classes.select("cls", "copies", "label", "embedding").mapInPandas(
        _hashed, "cls long, copies long, label long, width int, keys array<long>, every binary, vector binary"), "vector-hashes")
    slim = hashed.select("cls", F.posexplode("keys").alias("at", "bucket")).select(
        "cls", "bucket", F.expr(f"cast(at div {1 + PROBES} as int)").alias("tab"), (F.col("at") % (1 + PROBES) == 0).alias("own"))
    cells = into_cells(slim, "bucket", "cls", payload=hashed.drop("keys"))
    found = stage(cells.mapInPandas(_linked, "a long, b long, links long"), "vector-links")
    counts = found.where("links > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(found.where("a != b"), "a", "b").withColumnRenamed("node", "cls")
    joined = classes.select("digest", "cls", "least", "copies").join(roots, "cls", "left").join(counts, "cls", "left").withColumn(
        "root", F.coalesce("root", "cls"))
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
