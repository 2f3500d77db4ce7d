"""Model preparation statistics (checked) and trained models (rows only: no SQL form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import application as A
from ..operators import preprocess as X
from ..operators import boosting as B
from ..operators import bootstrap as R
from ..operators import calibration as C
from ..operators.history import HISTORY_FLAGS, lifetime_features, source_count
from ..operators.scoring import history_segment
from ..operators.splits import assign_splits
from ..operators.temporal import temporal_features
from ..plans import training as T
from ..session import cut_lineage, spread
from ..sources.roles import history_roles, role, with_roles
from .application_queries import ALL_COLUMNS, INVENTORY_CTE, column_kind, development_rows
from .common import r6, register

CATEGORICAL_COLUMNS = [c for c in ALL_COLUMNS if column_kind(c) == "t"]
NUMERIC_COLUMNS = [c for c in ALL_COLUMNS if column_kind(c) != "t" and not A.excluded_by_policy(c)]
CATEGORY = [c for c in CATEGORICAL_COLUMNS if not A.excluded_by_policy(c)]


@register("median_imputation", with_roles(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r6(f'quantile_cont({c}, 0.5)')} AS median, count(*) FILTER ({c} IS NULL) AS missing FROM dev"
        for c in NUMERIC_COLUMNS), "application_train", ctes=INVENTORY_CTE))
def median_imputation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.numeric_fills(cut_lineage(development_rows(spark, sf).select(*NUMERIC_COLUMNS)), NUMERIC_COLUMNS))


_LEVELS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS level, count(*) AS rows FROM dev WHERE {c} IS NOT NULL GROUP BY 2" for c in CATEGORY)


@register("mode_imputation", with_roles(
    f"SELECT feature, first(level ORDER BY rows DESC, level) AS mode FROM ({_LEVELS}) GROUP BY feature",
    "application_train", ctes=INVENTORY_CTE))
def mode_imputation(spark: SparkSession, sf: str) -> DataFrame:
    return X.category_fills(X.level_counts(development_rows(spark, sf), CATEGORY))


@register("rare_level_pooling", with_roles(
    f"SELECT feature, CASE WHEN rows >= 100 THEN level ELSE '<infrequent>' END AS level, sum(rows)::BIGINT AS rows FROM ({_LEVELS}) GROUP BY ALL",
    "application_train", ctes=INVENTORY_CTE))
def rare_level_pooling(spark: SparkSession, sf: str) -> DataFrame:
    counts = X.level_counts(development_rows(spark, sf), CATEGORY)
    pooled = F.when(F.col("rows") >= 100, F.col("level")).otherwise(X.RARE)
    return counts.groupBy("feature", pooled.alias("level")).agg(F.sum("rows").alias("rows"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Engineered rows with their split, materialised once for the fits below."""
    train = role(spark, sf, "application_train")
    splits = assign_splits(train).select("SK_ID_CURR", "split", "tuning_role")
    return cut_lineage(A.engineer(spread(train)).join(splits, "SK_ID_CURR"))


def responsible(development: DataFrame) -> A.Selection:
    """The selection policy over all engineered columns, learned on development rows."""
    return A.select_features(development.drop("split", "tuning_role"))


def _part(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


@register("logistic_baseline_metrics")
def logistic_baseline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = _labelled(spark, sf)
    development = _part(df, "development")
    model = T.fit_linear(development, responsible(development))
    return rounded(T.evaluate(model.predict(_part(df, "calibration"), "p"), "p"))


@register("logistic_contributions")
def logistic_contributions(spark: SparkSession, sf: str) -> DataFrame:
    df = _labelled(spark, sf)
    development = _part(df, "development")
    model = T.fit_linear(development, responsible(development))
    return rounded(model.contributions(_part(df, "calibration")))


def _stores(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str], list[str]]:
    """Engineered applications with both stores, the columns before and the columns that the temporal store adds."""
    tables = history_roles(spark, sf)
    lifetime, temporal = cut_lineage(lifetime_features(tables)), cut_lineage(temporal_features(tables))
    columns = [[c for c in store.columns if c != T.KEY] for store in (lifetime, temporal)]
    base = A.engineer(T.merge_with_gaps(role(spark, sf, "application_train"), lifetime, columns[0]).drop("store_row_missing"))
    full = A.burden_features(T.merge_with_gaps(base, temporal, columns[1]).drop("store_row_missing"))
    return full, base.columns, [c for c in full.columns if c not in base.columns]


@register("boosted_tree_challengers")
def boosted_tree_challengers(spark: SparkSession, sf: str) -> DataFrame:
    """All declared variants over both stores, their ensemble, and the ranking on the calibration rows."""
    frame, base, added = _stores(spark, sf)
    matrix = T.shared_matrix(frame, assign_splits(role(spark, sf, "application_train")))
    predictions = cut_lineage(T.run_challengers(matrix, base, added, A.CHALLENGERS))
    return rounded(T.rank_experiments(predictions.unionByName(T.ensemble(predictions))))


@register("collectible_variants")
def collectible_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of what an applicant can supply: metrics on calibration, and paired intervals against the full variant."""
    tables = history_roles(spark, sf)
    lifetime = cut_lineage(lifetime_features(tables))
    columns = [c for c in lifetime.columns if c != T.KEY]
    train = role(spark, sf, "application_train")
    frame = A.obligation_ratios(A.engineer(T.merge_with_gaps(train, lifetime, columns).drop("store_row_missing")))
    matrix = T.shared_matrix(T.with_variant_counts(frame), assign_splits(train))
    predictions = cut_lineage(T.run_collectible(matrix, frame.columns))
    reference = predictions.where("model = 'v1_reference'").select(T.KEY, F.col("p").alias("reference"))
    pairs = predictions.where("model <> 'v1_reference'").join(reference, T.KEY)
    intervals = R.bootstrap_summary(
        R.bootstrap_deltas(pairs, "p", "reference", T.KEY, 300, groups=["model"]), ["model"]).drop("iterations")
    return rounded(T.evaluate(predictions, "p", ["model"]).join(intervals, "model", "left"))


@register("gain_importance_by_family")
def gain_importance_by_family(spark: SparkSession, sf: str) -> DataFrame:
    """Split gain of the model with all temporal columns, by feature family."""
    frame, base, added = _stores(spark, sf)
    matrix = T.shared_matrix(frame, assign_splits(role(spark, sf, "application_train")))
    plan = B.Plan("all", tuple(matrix.layout.places([*base, *added])))
    forest = B.fit_plans(matrix.part("development"), [plan], T.KEY, T.TARGET)["all"]
    return rounded(T.family_importance(B.gain_importance(spark, forest, matrix.layout)))


def _bins_sql() -> str:
    """Every selected numeric column of the engineered applications against its 63 quantile edges."""
    grid = "[" + ", ".join(repr(i / B.BINS) for i in range(1, B.BINS)) + "]"
    parts = []
    for name in NUMERIC_COLUMNS:
        parts.append(
            f"SELECT '{name}' AS feature, len(list_filter(e, lambda x: x < coalesce({name}::DOUBLE, m))) AS bin, TARGET, {name} IS NULL AS gone"
            f" FROM learned, (SELECT list_distinct(quantile_cont({name}::DOUBLE, {grid})) AS e, coalesce(quantile_cont({name}::DOUBLE, 0.5), 0) AS m"
            " FROM learned WHERE split = 'development')")
    return " UNION ALL ".join(parts)


@register("shared_bin_counts", with_roles(
    """SELECT feature, bin::BIGINT AS bin, count(*) AS rows, sum(TARGET)::BIGINT AS events FROM (
      SELECT feature, bin, TARGET FROM placed_bins JOIN chosen USING (feature)
      UNION ALL SELECT feature || '__missing', gone::INT, TARGET FROM placed_bins JOIN chosen USING (feature)
        WHERE feature IN (SELECT feature FROM inventory WHERE missing_rate > 0)) GROUP BY ALL""",
    "application_train", ctes=f"""{INVENTORY_CTE},
chosen AS (SELECT feature FROM inventory WHERE status = 'selected' AND kind = 'numeric'),
learned AS (SELECT SK_ID_CURR, engineered.TARGET, split, {", ".join(f"{r6(c)} AS {c}" for c in NUMERIC_COLUMNS)}
  FROM engineered JOIN (SELECT SK_ID_CURR, split FROM splits WHERE split <> 'holdout') USING (SK_ID_CURR)),
placed_bins AS ({_bins_sql()})"""))
def shared_bin_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and events per bin of the shared matrix of the application columns."""
    train = role(spark, sf, "application_train")
    frame = A.engineer(spread(train))
    numeric = [c for c in frame.columns if c not in CATEGORICAL_COLUMNS]
    matrix = T.shared_matrix(rounded(frame.select(*numeric)), assign_splits(train))
    return B.bin_counts(matrix.rows, matrix.layout, T.TARGET)


@register("batch_scores")
def batch_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Both components, blend, grade, segment and route for the unlabelled applications.

    The history model learns from the whole lifetime store, the application model from the applications alone, both on
    development rows; the blend weights are selected on the fitting half of the calibration part.
    """
    train, test = role(spark, sf, "application_train"), role(spark, sf, "application_test")
    store = cut_lineage(lifetime_features(history_roles(spark, sf)))
    columns = [c for c in store.columns if c != T.KEY]
    splits = assign_splits(train).select(T.KEY, "split", "calibration_role")
    merged = cut_lineage(A.engineer(T.merge_with_gaps(train, store, columns).drop("store_row_missing")).join(splits, T.KEY))
    development = _part(merged, "development").drop("split", "calibration_role")
    history = T.fit_linear(development, A.select_features(development))
    application = T.fit_linear(development, A.select_features(development.drop(*columns)))
    held = merged.where("calibration_role = 'calibrator_fit'")
    flags = tuple(f for f in HISTORY_FLAGS if f in columns)
    both = application.predict(history.predict(held, "h"), "a").withColumn("history_segment", history_segment(source_count(flags)))
    chosen = C.select_weights(C.weight_candidates(both, "a", "h", ["history_segment"]), ["history_segment"]).collect()
    weights = {"thin_0_to_1_sources": 1.0} | {r["history_segment"]: r["history_weight"] for r in chosen}  # one row per segment
    scores = T.BatchScorer(history, application, weights, columns).score(test, store)
    return rounded(scores.withColumn("data_quality_flags", F.array_join("data_quality_flags", ",")))
