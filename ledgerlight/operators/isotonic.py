"""Monotone calibration by pooling adjacent violators in value ranges.

Rows are pooled to distinct scores, and every range of scores is fitted in a task of its own.  Pooling is the same whatever
comes first, so the blocks that the ranges leave are fitted again over other ranges, until no block stands above its right
neighbour anywhere.  Blocks only become fewer; what fits ``BLOCK_ROWS`` is finished in one task.  No fit passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clip_probability
from ..session import cut_lineage
from .evaluation import TARGET

BLOCK_ROWS = 100_000
MOST_STEPS = 50_000  # blocks of a step function that are broadcast; a longer one is read by ranges
SALTS = 8
_BLOCK = "low double, high double, total double, weight double"


def pool(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Block number of each of a sequence of means ``total / weight`` after pooling adjacent violators."""
    sums, sizes, members = [], [], []
    for t, w in zip(total.tolist(), weight.tolist(), strict=True):
        n = 1
        while sums and sums[-1] * w >= t * sizes[-1]:  # the mean on the left is not below
            t, w, n = t + sums.pop(), w + sizes.pop(), n + members.pop()
        sums.append(t)
        sizes.append(w)
        members.append(n)
    return np.repeat(np.arange(len(members)), members)


def _pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(batches)  # about BLOCK_ROWS rows
    if held:
        table = pd.concat(held, ignore_index=True).sort_values("low")
        block = pool(table["total"].to_numpy(), table["weight"].to_numpy())
        yield table.groupby(block).agg(low=("low", "min"), high=("high", "max"), total=("total", "sum"), weight=("weight", "sum"))


def _violated(blocks: DataFrame) -> bool:
    """Whether the last block of a range is not below the first of the next (one row per range)."""
    mean = F.col("total") / F.col("weight")
    ends = blocks.groupBy("part").agg(
        F.min("low").alias("low"), F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))
    before = F.lag("last").over(Window.partitionBy().orderBy("low"))
    return not ends.withColumn("before", before).where("before >= first").isEmpty()


def isotonic_fit(rows: DataFrame, probability: str, target: str = TARGET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The fitted step function: blocks ``low, high, total, weight`` with rising means ``total / weight``.

    Equal scores are pooled before the fit; rows without a score or target are left out.
    """
    score = F.col(probability).cast("double")
    blocks = cut_lineage(rows.where(score.isNotNull() & F.col(target).isNotNull()).groupBy(score.alias("low")).agg(
        F.sum(F.col(target).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight")).select(
        "low", F.col("low").alias("high"), "total", "weight"))
    turn = 0
    while (size := blocks.count()) > block_rows:
        ranges = -(-size // block_rows) + 1 + turn % 3  # other cuts in every round
        blocks = cut_lineage(blocks.select("low", "high", "total", "weight").repartitionByRange(ranges, "low").mapInPandas(
            _pooled, _BLOCK).withColumn("part", F.spark_partition_id()))
        if not _violated(blocks):
            return blocks.drop("part")
        turn += 1
    return cut_lineage(blocks.select("low", "high", "total", "weight").coalesce(1).mapInPandas(_pooled, _BLOCK))


def _interpolated(scores: np.ndarray, blocks: pd.DataFrame) -> np.ndarray:
    """Fitted values: level inside a block, linear between two, flat beyond the first and the last."""
    blocks = blocks.sort_values("low")
    mean = (blocks["total"] / blocks["weight"]).to_numpy()
    points = np.stack([blocks["low"].to_numpy(), blocks["high"].to_numpy()], axis=1).ravel()
    return np.where(np.isnan(scores), np.nan, np.interp(scores, points, np.repeat(mean, 2)))


def _clipped(fitted: Column, probability: str) -> Column:
    return F.when(F.col(probability).isNotNull(), clip_probability(fitted))


def isotonic_predict(rows: DataFrame, blocks: DataFrame, probability: str, output: str, most_steps: int = MOST_STEPS) -> DataFrame:
    """``rows`` with the interpolated fit, clipped into the open unit interval; NULL without a score."""
    size = blocks.count()
    if not size:
        raise ValueError("an isotonic fit needs at least one scored row")
    if size <= most_steps:
        table = blocks.toPandas()

        @F.pandas_udf("double")
        def fitted(scores: pd.Series) -> pd.Series:
            return pd.Series(_interpolated(scores.to_numpy(dtype=np.float64, na_value=np.nan), table))

        return rows.withColumn(output, _clipped(fitted(F.col(probability).cast("double")), probability))
    return _predict_by_ranges(rows, blocks, probability, output, -(-size // most_steps) + 1)


def _predict_by_ranges(rows: DataFrame, blocks: DataFrame, probability: str, output: str, ranges: int) -> DataFrame:
    """Rows and blocks dealt by the same cuts; a range also gets the block on either side of it.

    Rows of a range are spread over ``SALTS`` tasks, so that a score of very many rows is not one task's.
    """
    starts = cut_lineage(blocks.select("low", "high", "total", "weight").repartitionByRange(ranges, "low").withColumn("part", F.spark_partition_id()))
    cuts = np.array([r.low for r in starts.groupBy("part").agg(F.min("low").alias("low")).orderBy("low").collect()])  # one per range

    @F.pandas_udf("int")
    def part_of(scores: pd.Series) -> pd.Series:
        values = np.nan_to_num(scores.to_numpy(dtype=np.float64, na_value=0.0))
        return pd.Series(np.maximum(0, np.searchsorted(cuts, values, side="right") - 1).astype(np.int32))

    own = starts.select("low", "high", "total", "weight", part_of("low").alias("_part"))
    ends = own.groupBy("_part").agg(F.min("low").alias("first"), F.max("low").alias("last"))
    edges = own.join(ends, "_part").select("low", "high", "total", "weight", F.explode(F.array_compact(F.array(
        F.when(F.col("low") == F.col("first"), F.col("_part") - 1), F.when(F.col("low") == F.col("last"), F.col("_part") + 1)))).alias("_part"))
    dealt = own.unionByName(edges).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumns({
        "_part": part_of(F.col(probability).cast("double")), "_salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})

    def fit(table: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        scores = table[probability].to_numpy(dtype=np.float64, na_value=np.nan)
        return table.drop(columns=["_part", "_salt"]).assign(**{output: _interpolated(scores, steps) if len(table) else []})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = salted.groupBy("_part", "_salt").cogroup(dealt.groupBy("_part", "_salt")).applyInPandas(fit, f"{schema}, `{output}` double")
    return out.withColumn(output, _clipped(F.col(output), probability))
