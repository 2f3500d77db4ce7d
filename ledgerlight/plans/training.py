"""Training, experiments and batch scoring.

Experiments share one matrix of bins (``operators.boosting``), written once: every declared variant reads its own columns of it.
Early stopping uses a stratified part of development, the refit all of it, metrics the calibration part only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import credit_score, missing_count, risk_grade
from ..operators.application import (
    VARIANTS, Challenger, Selection, engineer, excluded_by_policy, select_features,
)
from ..operators.boosting import (
    FIT_ROWS, HIGH_CAPACITY, STANDARD, Layout, Plan, binned_matrix, fit_plans, learn_layout, predict_all,
)
from ..operators.calibration import blend
from ..operators.evaluation import evaluate
from ..operators.history import HISTORY_FLAGS, source_count
from ..operators.preprocess import LEVEL_SUFFIX, MISSING_SUFFIX, Preparation, linear_stages
from ..operators.quality import key_violations
from ..operators.reasons import feature_family
from ..operators.scoring import confidence_route, history_segment
from ..session import cut_lineage

KEY, TARGET = "SK_ID_CURR", "TARGET"
MISSING_COUNT = "APPLICATION_MISSING_COUNT"


# ---------------------------------------------------------------- merge

def merge_with_gaps(applications: DataFrame, store: DataFrame, expected: Sequence[str], check_keys: bool = True) -> DataFrame:
    """One-to-one left merge: flags of an absent store row become 0, its features stay NULL."""
    missing = sorted(set(expected) - set(store.columns))
    if missing:
        raise ValueError(f"feature store is missing {len(missing)} expected columns")
    if TARGET in store.columns:
        raise ValueError("the feature store must not hold the target")
    if check_keys:
        for name, df in (("application", applications), ("feature store", store)):
            if not key_violations(df, (KEY,)).isEmpty():
                raise ValueError(f"{name} keys are not unique")
    joined = applications.join(store.select(KEY, *expected).withColumn("_stored", F.lit(True)), KEY, "left")
    flags = [c for c in expected if c.startswith("HAS_")]
    return joined.withColumns({f: F.coalesce(F.col(f), F.lit(0)) for f in flags}).withColumn(
        "store_row_missing", F.col("_stored").isNull()).drop("_stored")


# ---------------------------------------------------------------- models

def _probability(df: DataFrame, output: str) -> DataFrame:
    return df.withColumn(output, vector_to_array("probability").getItem(1)).drop("probability", "rawPrediction", "prediction")


@dataclass
class LinearModel:
    prep: Preparation
    pipeline: PipelineModel
    means: list[float]

    def predict(self, rows: DataFrame, output: str = "model_probability") -> DataFrame:
        kept = rows.columns
        return _probability(self.pipeline.transform(self.prep.apply(rows)), output).select(*kept, output)

    @property
    def names(self) -> list[str]:
        """Raw feature behind every vector slot; indicators are marked as such."""
        out = [f"MISSINGINDICATOR_{n.removesuffix(MISSING_SUFFIX)}" if n.endswith(MISSING_SUFFIX) else n
               for n in self.prep.numeric_columns]
        if self.prep.level_columns:
            for column, labels in zip(self.prep.level_columns, self.pipeline.stages[2].labelsArray, strict=True):
                # One slot per label, one for unseen levels and one for invalid ones.
                out += [column.removesuffix(LEVEL_SUFFIX)] * (len(labels) + 2)
        return out

    def contributions(self, rows: DataFrame, key: str = KEY) -> DataFrame:
        """Exact log-odds contributions ``coefficient * (x - development mean)`` as a long table."""
        weights = self.pipeline.stages[-1].coefficients.toArray().tolist()
        names = self.names[:len(weights)]
        names += names[-1:] * (len(weights) - len(names))
        vector = self.pipeline.transform(self.prep.apply(rows)).select(
            key, F.posexplode(vector_to_array("features")).alias("_slot", "_x"))

        def slot(values: list) -> Column:
            return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_slot") + 1)

        return vector.select(
            key, slot(names).alias("feature"), ((F.col("_x") - slot(self.means)) * slot(weights)).alias("contribution")
        ).groupBy(key, "feature").agg(F.sum("contribution").alias("contribution"))


def fit_linear(development: DataFrame, selection: Selection, c: float = 0.5, iterations: int = 400,
               minimum_frequency: int = 100) -> LinearModel:
    """L2 logistic baseline; ``regParam = 1 / (C * n)`` puts the penalty on the same scale."""
    prep = Preparation.learn(development, selection, minimum_frequency)
    prepared = prep.apply(development)
    n = development.count()
    model = Pipeline(stages=[*linear_stages(prep), LogisticRegression(
        featuresCol="features", labelCol=TARGET, regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=iterations,
        standardization=False)]).fit(prepared)
    features = PipelineModel(model.stages[:-1]).transform(prepared)
    means = features.select(Summarizer.mean(F.col("features")).alias("m")).first().m.toArray().tolist()
    return LinearModel(prep, model, means)


def family_importance(gains: DataFrame) -> DataFrame:
    return gains.groupBy(feature_family(F.col("feature")).alias("family")).agg(F.sum("gain").alias("gain_share"))


# ---------------------------------------------------------------- experiments

@dataclass(frozen=True)
class Matrix:
    """The shared table of bins of development and calibration rows; the holdout never enters."""

    rows: DataFrame  # key, target, split, tuning_role, bins
    layout: Layout

    def part(self, split: str) -> DataFrame:
        return self.rows.where(F.col("split") == split)


def shared_matrix(frame: DataFrame, splits: DataFrame) -> Matrix:
    """Bin the selected columns of ``frame`` once, with edges, levels and selection learned on development rows."""
    rows = cut_lineage(frame.join(splits.select(KEY, "split", "tuning_role"), KEY).where("split <> 'holdout'"))
    development = rows.where("split = 'development'").drop("split", "tuning_role")
    layout = learn_layout(development, select_features(development))
    return Matrix(cut_lineage(binned_matrix(rows, layout, [KEY, TARGET, "split", "tuning_role"])), layout)


def run_challengers(matrix: Matrix, base: Sequence[str], added: Sequence[str], variants: Sequence[Challenger],
                    fit_rows: int = FIT_ROWS) -> DataFrame:
    """``key, target, model, p`` of every declared variant on the calibration rows."""
    plans = [Plan(v.name, tuple(matrix.layout.places(v.columns(base, added))), HIGH_CAPACITY if v.high_capacity else STANDARD)
             for v in variants]
    forests = fit_plans(matrix.part("development"), plans, KEY, TARGET, fit_rows)
    return predict_all(matrix.part("calibration"), forests, [KEY, TARGET])


def ensemble(predictions: DataFrame, name: str = "fixed_equal_weight_ensemble") -> DataFrame:
    """Equal-weight average of all models' probabilities."""
    return predictions.groupBy(KEY, TARGET).agg(F.avg("p").alias("p")).select(KEY, TARGET, F.lit(name).alias("model"), "p")


def with_variant_counts(engineered: DataFrame) -> DataFrame:
    """The missing count of each restricted variant, over the columns that it may read."""
    counted = [c for c in engineered.columns if c != MISSING_COUNT and not excluded_by_policy(c)]
    return engineered.withColumns({
        f"{MISSING_COUNT}__{name}": missing_count(engineered, [c for c in counted if keep(c)]) for name, keep in VARIANTS.items()})


def run_collectible(matrix: Matrix, columns: Sequence[str], fit_rows: int = FIT_ROWS) -> DataFrame:
    """``key, target, model, p`` of the full variant and of those that a submitted applicant can supply."""
    plans = []
    for name, keep in VARIANTS.items():
        own = [f"{MISSING_COUNT}__{name}" if c == MISSING_COUNT and name != "v1_reference" else c for c in columns if keep(c)]
        plans.append(Plan(name, tuple(matrix.layout.places(own))))
    forests = fit_plans(matrix.part("development"), plans, KEY, TARGET, fit_rows)
    return predict_all(matrix.part("calibration"), forests, [KEY, TARGET])


def rank_experiments(predictions: DataFrame) -> DataFrame:
    """Comparison table, best average precision first (one row per model)."""
    table = evaluate(predictions, "p", ["model"])
    order = Window.orderBy(F.col("average_precision").desc(), "model")
    return table.withColumn("rank", F.row_number().over(order))


# ---------------------------------------------------------------- batch scorer

@dataclass
class BatchScorer:
    """Scores applications against the store; ``weights`` holds the history weight of each segment."""

    history_model: LinearModel
    application_model: LinearModel
    weights: dict[str, float]
    store_columns: Sequence[str]

    def score(self, applications: DataFrame, store: DataFrame, check_keys: bool = True) -> DataFrame:
        merged = merge_with_gaps(applications, store, self.store_columns, check_keys)
        missing_row = F.col("store_row_missing")
        flags = [f for f in HISTORY_FLAGS if f in self.store_columns]
        frame = engineer(merged.drop("store_row_missing")).join(merged.select(KEY, missing_row), KEY)
        out = self.application_model.predict(
            self.history_model.predict(frame, "history_component_probability"), "application_component_probability")
        sources = source_count(tuple(flags))
        out = out.withColumns({"available_history_sources": sources, "history_segment": history_segment(sources)})
        weight = F.create_map(*[F.lit(x) for kv in self.weights.items() for x in kv])
        out = out.withColumn("history_weight", F.coalesce(F.element_at(weight, F.col("history_segment")), F.lit(1.0)))
        out = out.withColumn("repayment_difficulty_probability", blend(
            F.col("application_component_probability"), F.col("history_component_probability"), F.col("history_weight")))
        p = F.col("repayment_difficulty_probability")
        routed = confidence_route(out, "repayment_difficulty_probability", "available_history_sources")
        return routed.select(
            F.col(KEY).alias("application_id"), p, "history_component_probability", "application_component_probability",
            "history_weight", credit_score(p).alias("internal_credit_score"), risk_grade(p).alias("risk_grade"),
            "history_segment", "available_history_sources", "confidence",
            F.col("confidence_route").alias("review_route"), "store_row_missing",
            F.array_compact(F.array(F.when(missing_row, "FEATURE_STORE_ROW_MISSING"))).alias("data_quality_flags"),
            F.when(F.col("history_weight") >= 0.5, "history").otherwise("application")
            .alias("dominant_explanation_component"))


def write_sealed(df: DataFrame, path: str) -> None:
    """Holdout results are written once; an existing target is an error, not overwritten."""
    df.write.mode("errorifexists").parquet(path)
