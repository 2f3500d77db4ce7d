"""Pairs inside buckets without a pair join: buckets become cells of bounded size, cells are read as arrays.

A bucket of ``n`` rows is dealt into ``ceil(n / CHUNK)`` chunks by a hash of the row's id.  Each pair of chunks
is one cell, so each pair of rows of the bucket meets in exactly one cell, a hot bucket is spread over many
tasks, and no task holds more than about two chunks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import ship_by_value

ship_by_value(__name__)

CHUNK = 512
CELL = ["bucket", "lo", "hi"]


def into_cells(rows: DataFrame, bucket: str, row_id: str, chunk: int = CHUNK, payload: DataFrame | None = None) -> DataFrame:
    """Add ``lo, hi`` (the cell) and ``part`` (the row's own chunk); rows alone in their bucket are left out.

    A row of a bucket with ``m`` chunks appears in ``m`` cells.  ``payload`` has more columns of each ``row_id``, which
    are joined only to the rows that are left.  The table comes dealt and sorted by cell.
    """
    sizes = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / F.lit(chunk)).cast("int")
    dealt = (
        rows.join(sizes, bucket)
        .withColumn("part", F.pmod(F.xxhash64(row_id), parts).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("lo", F.least("part", "_other")).withColumn("hi", F.greatest("part", "_other"))
        .drop("_n", "_other").withColumnRenamed(bucket, "bucket")
    )
    if payload is not None:
        dealt = dealt.join(payload, row_id)
    return dealt.repartition(*CELL).sortWithinPartitions(*CELL)


def whole_cells(batches: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Tables of whole cells from a stream sorted by cell, with the start of each cell and the end of the last."""
    held: list[pd.DataFrame] = []

    def cut(table: pd.DataFrame) -> np.ndarray:
        keys = table[CELL].to_numpy()
        return np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        table = pd.concat(held, ignore_index=True)
        starts = cut(table)
        if len(starts) > 1:
            yield table.iloc[: starts[-1]], starts
            table = table.iloc[starts[-1]:]
        held = [table]
    if held and sum(map(len, held)):
        table = pd.concat(held, ignore_index=True)
        yield table, np.r_[cut(table), len(table)]


def cell_pairs(part: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sides of a cell: the chunk with itself, or one chunk with the other."""
    if lo == hi:
        every = np.arange(len(part))
        return every, every
    return np.flatnonzero(part == lo), np.flatnonzero(part == hi)


def inner_pairs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs ``a < b`` of rows of each cell, for many small cells at once."""
    sizes = ends - starts
    rows = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    partners = np.repeat(ends, sizes) - 1 - rows
    a = np.repeat(rows, partners)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(partners) - partners, partners)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(member, smallest row number)`` with the same components as the pairs ``(a, b)``."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        root = root[root]
        if np.array_equal(root, before):
            break
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]
