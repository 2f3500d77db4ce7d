"""Model preparation: imputation, missing indicators, rare-level pooling, encoding and scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import flag, is_missing
from .application import Selection
from .ordering import bucket_counts, bucket_quantiles
from .quality import by_position, long_columns

RARE = "<infrequent>"
MISSING_SUFFIX = "__missing"
LEVEL_SUFFIX = "__level"


def numeric_fills(rows: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Exact median and number of missing cells per numeric column, all columns in two passes: give staged ``rows``."""
    numeric = list(numeric)
    long = long_columns(rows.select(*numeric)).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    counted = bucket_counts(long, "value", ["_pos"])
    counts = counted.groupBy("_pos").agg(F.coalesce(F.sum(F.when(F.col("_bucket").isNull(), F.col("rows"))), F.lit(0)).alias("missing"))
    medians = bucket_quantiles(long, counted, "value", [0.5], ["_pos"]).select("_pos", F.col("quantile").alias("median"))
    return counts.join(medians, "_pos", "left").select(
        by_position(numeric, F.col("_pos")).alias("feature"), "median", "missing")


def level_counts(rows: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Rows per known level of every categorical column."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in categorical]))
    return rows.select(pairs.alias("p")).select("p.*").where(F.col("level").isNotNull()).groupBy(
        "feature", "level").agg(F.count(F.lit(1)).alias("rows"))


def category_fills(counts: DataFrame) -> DataFrame:
    """Most frequent level per column; equal counts resolve to the first level in order."""
    best = F.min(F.struct((-F.col("rows")).alias("r"), "level")).alias("_best")
    return counts.groupBy("feature").agg(best).select("feature", F.col("_best.level").alias("mode"))


def frequent_levels(counts: DataFrame, minimum: int) -> DataFrame:
    return counts.where(F.col("rows") >= minimum)


@dataclass
class Preparation:
    """Statistics learned on development rows: one entry per model column, so they live on the driver."""

    selection: Selection
    medians: dict[str, float]
    indicators: list[str]
    modes: dict[str, str]
    levels: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def learn(cls, rows: DataFrame, selection: Selection, minimum_frequency: int | None = None) -> Preparation:
        medians, indicators, modes, levels = {}, [], {}, {}
        if selection.numeric:
            for r in numeric_fills(rows, selection.numeric).collect():
                medians[r.feature] = 0.0 if r.median is None else r.median
                if r.missing:
                    indicators.append(r.feature)
        if selection.categorical:
            counts = level_counts(rows, selection.categorical)
            modes = {r.feature: r.mode for r in category_fills(counts).collect()}
            if minimum_frequency is not None:
                # A kept level covers ``minimum_frequency`` rows of a policy-selected column.
                for r in frequent_levels(counts, minimum_frequency).collect():
                    levels.setdefault(r.feature, []).append(r.level)
        return cls(selection, medians, sorted(indicators), modes, levels)

    @property
    def numeric_columns(self) -> list[str]:
        return [*self.selection.numeric, *[f"{c}{MISSING_SUFFIX}" for c in self.indicators]]

    @property
    def level_columns(self) -> list[str]:
        return [f"{c}{LEVEL_SUFFIX}" for c in self.selection.categorical]

    def apply(self, rows: DataFrame) -> DataFrame:
        """Imputed numeric columns, 0/1 indicators and pooled text levels."""
        out = rows.withColumns({
            f"{c}{MISSING_SUFFIX}": flag(is_missing(rows, c)).cast("double") for c in self.indicators})
        out = out.withColumns({
            c: F.when(is_missing(rows, c), F.lit(self.medians[c])).otherwise(F.col(c).cast("double"))
            for c in self.selection.numeric})
        pooled = {}
        for c in self.selection.categorical:
            level = F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c, RARE)))
            if self.levels:
                level = F.when(level.isin(*self.levels.get(c, [])), level).otherwise(RARE)
            pooled[f"{c}{LEVEL_SUFFIX}"] = level
        return out.withColumns(pooled)


def linear_stages(prep: Preparation) -> list:
    """Scaled numerics and one-hot levels in one vector."""
    stages: list = [
        VectorAssembler(inputCols=prep.numeric_columns, outputCol="numeric_vector"),
        StandardScaler(inputCol="numeric_vector", outputCol="scaled_vector", withMean=True, withStd=True)]
    inputs = ["scaled_vector"]
    if prep.level_columns:
        indexed = [f"{c}_index" for c in prep.level_columns]
        encoded = [f"{c}_onehot" for c in prep.level_columns]
        stages += [
            StringIndexer(inputCols=prep.level_columns, outputCols=indexed, handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=False, handleInvalid="keep")]
        inputs += encoded
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]
