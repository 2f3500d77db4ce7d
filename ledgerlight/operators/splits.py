"""Reproducible class-stratified partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import uniform_hash
from .ordering import attach, running_totals

SEED = 42


def assign_splits(rows: DataFrame, key: str = "SK_ID_CURR", target: str = "TARGET", seed: int = SEED) -> DataFrame:
    """70 / 15 / 15 development, calibration, holdout, and the two nested splits.

    Rows of a class are ordered by a hash of their key; the place in that order decides the part, so
    class shares are exact and the result does not depend on partitioning.  The hash is uniform, which
    keeps the buckets behind ``running_totals`` even.

    Development rows are ``fit`` (85 %) or ``early_stop``; calibration rows ``calibrator_fit`` (50 %) or
    ``calibrator_evaluation``.
    """
    hashed = rows.select(key, target, uniform_hash(F.col(key), F.lit(seed)).alias("_u"))
    placed = running_totals(
        hashed, "_u", {"n": F.count(F.lit(1))}, groups=[target], ties=[key], bounds=(0.0, 1.0))
    sizes = placed.groupBy(target).agg(F.sum("n").alias("_size"))
    size, rank = F.col("_size"), F.col("n_before") + 1
    development = F.floor(size * 70 / 100)
    calibration = F.floor(size * 85 / 100) - development
    in_calibration = rank - development
    split = (F.when(rank <= development, "development")
             .when(in_calibration <= calibration, "calibration").otherwise("holdout"))
    return attach(placed, sizes, [target]).select(
        key, target, split.alias("split"),
        F.when(split == "development",
               F.when(rank * 100 <= development * 85, "fit").otherwise("early_stop")).alias("tuning_role"),
        F.when(split == "calibration",
               F.when(in_calibration * 2 <= calibration, "calibrator_fit").otherwise("calibrator_evaluation"))
        .alias("calibration_role"))


def overlap_count(left: DataFrame, right: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """How many keys two populations share; a sealed partition must give zero."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi").agg(
        F.count(F.lit(1)).alias("shared_keys"))
