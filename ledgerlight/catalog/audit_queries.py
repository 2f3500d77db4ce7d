"""Reasons, stability, factor effects, associations and ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import audit as D
from ..operators import intake as I
from ..operators import reasons as R
from ..operators import scoring as S
from ..operators.application import engineer
from ..operators.history import lifetime_features
from ..plans.portfolio import transparent_intake_score
from ..session import spread
from ..sources.roles import history_roles, role, with_roles
from .application_queries import ALL_COLUMNS, ENGINEERED_CTE, column_kind
from .common import r6, register
from .history_queries import ALL_ROLES, STORE_CTE
from .intake_queries import INTAKE_COLUMNS, SCORED_CTE, SHEET_ROLES, _probability_sql, _route_sql, packages
from .quality_queries import LIFETIME_COLUMNS
from .scoring_queries import SCORED_CTE as PROFILE_CTE

# Long contribution table: a known non-linear function of each feature stands in for a model.
NUMERIC = ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "OWN_CAR_AGE", "EXT_SOURCE_2",
           "EXT_SOURCE_3", "AMT_REQ_CREDIT_BUREAU_YEAR", "FLAG_EMAIL")
CATEGORY = ("NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_HOUSING_TYPE", "FLAG_OWN_CAR")


def _contribution(i: int) -> str:
    return f"CAST((SK_ID_CURR * {37 + 16 * i}) % 401 - 200 + TARGET * {60 - 25 * (i % 4)} AS DOUBLE) / 512"


def _value(name: str) -> str:
    return f"CAST({name} AS DOUBLE)"


LONG_CTE = "contributions AS (" + " UNION ALL ".join(
    f"SELECT SK_ID_CURR, TARGET AS target, '{n}' AS feature, false AS categorical, {_value(n)} AS value, NULL::VARCHAR AS level, {n} IS NULL AS is_missing,"
    f" {_contribution(i)} AS contribution, CASE WHEN {n} IS NULL THEN 0.25e0 ELSE -0.0625e0 END AS indicator_contribution FROM application_train"
    for i, n in enumerate(NUMERIC)) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT SK_ID_CURR, TARGET, '{n}', true, NULL, {n}, {n} IS NULL, {_contribution(i + 20)}, NULL FROM application_train"
    for i, n in enumerate(CATEGORY)) + ")"


def contributions(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "application_train")
    parts = [
        F.struct(F.lit(n).alias("feature"), F.lit(False).alias("categorical"), F.expr(_value(n)).alias("value"),
                 F.lit(None).cast("string").alias("level"), F.col(n).isNull().alias("is_missing"),
                 F.expr(_contribution(i)).alias("contribution"),
                 F.when(F.col(n).isNull(), 0.25).otherwise(-0.0625).alias("indicator_contribution"))
        for i, n in enumerate(NUMERIC)]
    parts += [
        F.struct(F.lit(n).alias("feature"), F.lit(True).alias("categorical"), F.lit(None).cast("double").alias("value"),
                 F.col(n).alias("level"), F.col(n).isNull().alias("is_missing"),
                 F.expr(_contribution(i + 20)).alias("contribution"),
                 F.lit(None).cast("double").alias("indicator_contribution"))
        for i, n in enumerate(CATEGORY)]
    return spread(rows.select("SK_ID_CURR", "TARGET", *NUMERIC, *CATEGORY)).select("SK_ID_CURR", F.col("TARGET").alias("target"), F.explode(F.array(*parts)).alias("c")).select(
        "SK_ID_CURR", "target", "c.*")


def _rules_sql(rules, otherwise: str, name: str = "feature") -> str:
    cases = " ".join(f"WHEN regexp_matches({name}, '{p}') THEN '{label}'" for p, label in rules)
    return f"CASE {cases} ELSE '{otherwise}' END"


def _text_sql(code: str, side: int) -> str:
    cases = " ".join(f"WHEN '{c}' THEN '{pair[side]}'" for c, pair in R.REASON_TEXTS.items())
    return f"CASE {code} {cases} END"


def _side_sql(name: str, side: int, keep: str, order: str, features: str) -> str:
    parts = {"": "code", "_texts": _text_sql("code", side), "_features": f"array_to_string({features}, '+')"}
    return ", ".join(f"coalesce(string_agg({e}, '|' ORDER BY {order}) FILTER ({keep}), '') AS {name}{suffix}" for suffix, e in parts.items())


@register("row_reasons", with_roles(
    f"""SELECT SK_ID_CURR, {_side_sql('adverse', 0, 'up <= 3 AND total > 0', 'total DESC, code', 'pushing')},
      {_side_sql('favorable', 1, 'down <= 3 AND total < 0', 'total, code', 'pulling')}, {r6('max(total) FILTER (total > 0)')} AS strongest
    FROM (SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY total DESC, code) AS up,
        row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY total, code) AS down
      FROM (SELECT SK_ID_CURR, {_rules_sql(R.REASON_RULES, R.OTHER_REASON)} AS code, sum(contribution) AS total,
          (list(feature ORDER BY contribution DESC, feature) FILTER (contribution > 0))[1:3] AS pushing,
          (list(feature ORDER BY contribution, feature) FILTER (contribution < 0))[1:3] AS pulling FROM contributions GROUP BY ALL))
    GROUP BY SK_ID_CURR""", "application_train", ctes=LONG_CTE))
def row_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Codes, texts and leading features of each row's strongest reasons."""
    rows = R.row_reasons(contributions(spark, sf).select("SK_ID_CURR", "feature", "contribution"), "SK_ID_CURR")

    def joined(side: str, suffix: str, entry):
        return F.array_join(F.transform(side, entry), "|").alias(f"{side}{suffix}")

    columns = []
    for side, adverse in (("adverse", True), ("favorable", False)):
        columns += [joined(side, "", lambda x: x["code"]),
                    joined(side, "_texts", (lambda up: lambda x: R.describe(x["code"], up))(adverse)),
                    joined(side, "_features", lambda x: F.array_join(x["features"], "+"))]
    return rounded(rows.select("SK_ID_CURR", *columns, F.get("adverse", F.lit(0))["contribution"].alias("strongest")))


_UP = PROFILE_CTE.replace("FROM profiles)", "FROM bumped)")
for _name in ("checked", "terms", "probabilities", "scored"):
    _UP = _UP.replace(f"{_name} AS (", f"{_name}_up AS (").replace(f"FROM {_name} ", f"FROM {_name}_up ").replace(
        f"FROM {_name})", f"FROM {_name}_up)")
_UP = ("bumped AS (SELECT * REPLACE (requested_amount * 1.005e0 AS requested_amount, annual_income * 1.005e0 AS annual_income,"
       " annual_annuity * 1.005e0 AS annual_annuity) FROM profiles),\n" + _UP)


@register("explanation_stability", with_roles(
    f"""SELECT count(*) AS rows, {r6("avg(CASE WHEN a.adverse <> '' AND b.adverse <> '' AND split_part(a.adverse, ',', 1) = split_part(b.adverse, ',', 1) THEN 1 ELSE 0 END)")} AS top_adverse_reason_match_rate,
      {r6('avg(CASE WHEN a.adverse = b.adverse THEN 1 ELSE 0 END)')} AS exact_ordered_top_three_match_rate,
      {r6("avg(CASE WHEN a.adverse = '' AND b.adverse = '' THEN 1 WHEN a.adverse = '' OR b.adverse = '' THEN 0 ELSE len(list_intersect(string_split(a.adverse, ','), string_split(b.adverse, ','))) / len(list_distinct(list_concat(string_split(a.adverse, ','), string_split(b.adverse, ','))))::DOUBLE END)")} AS mean_top_three_jaccard,
      {r6('max(abs(a.probability - b.probability))')} AS change_maximum,
      {r6('avg(CASE WHEN a.risk_grade <> b.risk_grade THEN 1 ELSE 0 END)')} AS risk_grade_change_rate,
      {r6('avg(CASE WHEN (a.probability >= 0.2) <> (b.probability >= 0.2) THEN 1 ELSE 0 END)')} AS review_route_change_rate,
      {r6('quantile_cont(abs(a.probability - b.probability), 0.5)')} AS change_median,
      {r6('quantile_cont(abs(a.probability - b.probability), 0.95)')} AS change_p95
    FROM scored a JOIN scored_up b USING (application_id)""", "profiles", ctes=f"{PROFILE_CTE},\n{_UP}"))
def explanation_stability(spark: SparkSession, sf: str) -> DataFrame:
    profiles = S.valid_profiles(role(spark, sf, "profiles"))
    bumped = profiles.withColumns({
        c: F.col(c) * 1.005 for c in ("requested_amount", "annual_income", "annual_annuity")})

    def view(df: DataFrame) -> DataFrame:
        return S.score_profiles(df).select(
            "application_id", "probability", F.col("adverse_reason_codes").alias("codes"),
            F.col("risk_grade").alias("grade"), (F.col("probability") >= 0.2).alias("route"))

    return rounded(R.stability(view(profiles), view(bumped), "application_id"))


def _rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY feature ORDER BY {c}) + (count(*) OVER (PARTITION BY feature, {c}) - 1) / 2.0"


@register("numeric_effects", with_roles(
    f"""SELECT feature, count(*) AS rows, {r6('corr(rv, rc)')} AS value_contribution_spearman, {r6('corr(rv, rt)')} AS value_target_spearman,
      {r6('avg(contribution) FILTER (value >= hi) - avg(contribution) FILTER (value <= lo)')} AS upper_minus_lower_contribution,
      {r6('100 * (avg(target) FILTER (value >= hi) - avg(target) FILTER (value <= lo))')} AS upper_minus_lower_event_rate_pp
    FROM (SELECT *, {_rank('value')} AS rv, {_rank('contribution')} AS rc, {_rank('target')} AS rt FROM contributions WHERE value IS NOT NULL)
    JOIN (SELECT feature, CASE WHEN count(DISTINCT value) = 2 THEN min(value) ELSE quantile_cont(value, 0.25) END AS lo,
        CASE WHEN count(DISTINCT value) = 2 THEN max(value) ELSE quantile_cont(value, 0.75) END AS hi
      FROM contributions WHERE value IS NOT NULL GROUP BY 1) USING (feature) GROUP BY feature""",
    "application_train", ctes=LONG_CTE))
def numeric_effects(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.numeric_effects(contributions(spark, sf)))


@register("category_effects", with_roles(
    f"""SELECT feature, first(level ORDER BY m DESC, level) AS highest_risk_category, {r6('max(m)')} AS highest_risk_mean,
      {r6('first(e ORDER BY m DESC, level)')} AS highest_risk_event_rate, first(level ORDER BY m, level) AS lowest_risk_category,
      {r6('min(m)')} AS lowest_risk_mean, {r6('first(e ORDER BY m, level)')} AS lowest_risk_event_rate, count(*) AS eligible_categories
    FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS total FROM (
        SELECT feature, coalesce(level, '<MISSING>') AS level, count(*) AS n, avg(contribution) AS m, avg(target) AS e
        FROM contributions WHERE categorical GROUP BY 1, 2))
    WHERE n >= greatest(50, floor(total * 0.002)) GROUP BY feature""", "application_train", ctes=LONG_CTE))
def category_effects(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.category_effects(contributions(spark, sf).where("categorical")))


_FACTOR_CTE = f"""{LONG_CTE},
factors AS (SELECT *, total_mean_abs / sum(total_mean_abs) OVER () AS share FROM (
  SELECT feature, bool_or(categorical) AS categorical, avg(abs(contribution)) AS direct_mean_abs, avg(abs(indicator_contribution)) AS indicator_mean_abs,
    avg(is_missing::INT) AS missing_rate,
    avg(indicator_contribution) FILTER (is_missing) - avg(indicator_contribution) FILTER (NOT is_missing) AS missing_effect,
    avg(abs(contribution)) + coalesce(avg(abs(indicator_contribution)), 0) AS total_mean_abs FROM contributions GROUP BY feature)),
tiers AS (SELECT *, sum(share) OVER (ORDER BY share DESC, feature ROWS UNBOUNDED PRECEDING) AS cumulative_share,
  row_number() OVER (ORDER BY share DESC, feature) AS importance_rank, {_rules_sql(R.SOURCE_RULES, R.SOURCE_OTHER)} AS source_group FROM factors)"""


@register("factor_table", with_roles(
    f"""SELECT feature, categorical, {", ".join(f"{r6(n)} AS {n}" for n in ("direct_mean_abs", "indicator_mean_abs", "missing_rate", "missing_effect", "total_mean_abs", "share", "cumulative_share"))},
      importance_rank, CASE WHEN cumulative_share <= 0.5 THEN 'Tier 1 - dominant' WHEN cumulative_share <= 0.8 THEN 'Tier 2 - material'
        WHEN cumulative_share <= 0.95 THEN 'Tier 3 - supporting' ELSE 'Tier 4 - residual' END AS importance_tier, source_group,
      CASE WHEN categorical THEN 'category-dependent' ELSE {_rules_sql(R.DIRECTION_RULES, R.DIRECTION_OTHER)} END AS expected_direction FROM tiers""",
    "application_train", ctes=_FACTOR_CTE))
def factor_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.factor_table(contributions(spark, sf)))


@register("factor_group_summary", with_roles(
    f"SELECT source_group, count(*) AS factor_count, {r6('sum(share)')} AS share, {r6('median(missing_rate)')} AS median_missing_rate FROM tiers GROUP BY 1",
    "application_train", ctes=_FACTOR_CTE))
def factor_group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.group_summary(D.factor_table(contributions(spark, sf))))


# Every numeric factor: engineered application columns and the whole lifetime store, rounded as in their own queries.
_PAIRED = [c for c in ALL_COLUMNS if column_kind(c) != "t" and c not in ("SK_ID_CURR", "TARGET")] + [
    c for _, c in LIFETIME_COLUMNS if c != "SK_ID_CURR"]
_SPEARMAN_CTE = f"""{STORE_CTE},
{ENGINEERED_CTE},
factors AS (SELECT SK_ID_CURR, {", ".join(f"{r6(c)} AS {c}" for c in _PAIRED)} FROM engineered LEFT JOIN lifetime_store USING (SK_ID_CURR)),
named AS (SELECT unnest([{", ".join(f"'{c}'" for c in _PAIRED)}]) AS f, unnest(range({len(_PAIRED)})) AS i),
long AS MATERIALIZED (SELECT SK_ID_CURR, i, f, v FROM (UNPIVOT factors ON COLUMNS(* EXCLUDE (SK_ID_CURR)) INTO NAME f VALUE v) JOIN named USING (f)),
met AS MATERIALIZED (SELECT a.i AS i, b.i AS j, a.v AS x, b.v AS y FROM long a JOIN long b ON a.SK_ID_CURR = b.SK_ID_CURR AND a.i < b.i),
spearman AS MATERIALIZED (
  SELECT p.f AS feature_a, q.f AS feature_b, rows, CASE WHEN rows >= 500 AND isfinite(rho) THEN rho END AS association FROM (
    SELECT i, j, count(*) AS rows, corr(rx, ry) AS rho FROM (
      SELECT i, j, rank() OVER (PARTITION BY i, j ORDER BY x) + (count(*) OVER (PARTITION BY i, j, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY i, j ORDER BY y) + (count(*) OVER (PARTITION BY i, j, y) - 1) / 2.0 AS ry FROM met) GROUP BY i, j) AS s
  JOIN named p ON p.i = s.i JOIN named q ON q.i = s.j)"""


def _spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of all numeric factors of the labelled applications."""
    store = lifetime_features(history_roles(spark, sf))
    columns = [c for c in store.columns if c != "SK_ID_CURR"]
    frame = engineer(role(spark, sf, "application_train")).join(store.select("SK_ID_CURR", *columns), "SK_ID_CURR", "left")
    return D.pairwise_spearman(rounded(frame.select("SK_ID_CURR", *_PAIRED)), "SK_ID_CURR", _PAIRED)


@register("pairwise_spearman", with_roles(
    f"SELECT feature_a, feature_b, rows, {r6('association')} AS association FROM spearman", *ALL_ROLES,
    ctes=_SPEARMAN_CTE))
def pairwise_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_spearman(spark, sf))


_LEVELS = [c for c in ALL_COLUMNS if column_kind(c) == "t"]
_CRAMER = " UNION ALL ".join(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, sum(o)::BIGINT AS rows, sqrt(sum((o - e) * (o - e) / e) / (sum(o) * (least(max(nx), max(ny)) - 1))) AS association
      FROM (SELECT coalesce(c.o, 0) AS o, r.t * k.t / n::DOUBLE AS e, nx, ny
        FROM (SELECT coalesce({a}, '<MISSING>') AS x, count(*) AS t, count(*) OVER () AS nx FROM application_train GROUP BY 1) r
        CROSS JOIN (SELECT coalesce({b}, '<MISSING>') AS y, count(*) AS t, count(*) OVER () AS ny FROM application_train GROUP BY 1) k
        CROSS JOIN (SELECT count(*) AS n FROM application_train)
        LEFT JOIN (SELECT coalesce({a}, '<MISSING>') AS x, coalesce({b}, '<MISSING>') AS y, count(*) AS o FROM application_train GROUP BY ALL) c
          ON c.x = r.x AND c.y = k.y)""" for i, a in enumerate(_LEVELS) for b in _LEVELS[i + 1:])
_CRAMER_CTE = f"cramer AS ({_CRAMER})"


@register("pairwise_cramers_v", with_roles(
    f"SELECT feature_a, feature_b, rows, {r6('association')} AS association FROM cramer", "application_train",
    ctes=_CRAMER_CTE))
def pairwise_cramers_v(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.pairwise_cramers_v(role(spark, sf, "application_train"), _LEVELS))


@register("related_features", with_roles(
    f"""SELECT feature, first(other ORDER BY v DESC, other) AS strongest_related_feature, {r6('max(v)')} AS strongest_absolute_association,
      array_to_string(list(other ORDER BY v DESC, other)[1:5], ',') AS related_features,
      CASE WHEN max(v) >= 0.9 THEN 'high redundancy candidate; validate with grouped ablation before removing'
        WHEN max(v) >= 0.75 THEN 'partial substitute candidate; important interactions may still differ'
        ELSE 'related signal, but too weak to treat as a substitute' END AS substitutability
    FROM (SELECT feature_a AS feature, feature_b AS other, v FROM strong UNION ALL SELECT feature_b, feature_a, v FROM strong) GROUP BY feature""",
    *ALL_ROLES, ctes=f"""{_SPEARMAN_CTE},
{_CRAMER_CTE},
strong AS (SELECT feature_a, feature_b, {r6('abs(association)')} AS v FROM (SELECT * FROM spearman UNION ALL SELECT * FROM cramer) WHERE abs(association) >= 0.5)"""))
def related_features(spark: SparkSession, sf: str) -> DataFrame:
    numeric = rounded(_spearman(spark, sf))
    pairs = D.strong_pairs(numeric, "Spearman rho on observed values").unionAll(
        D.strong_pairs(rounded(D.pairwise_cramers_v(role(spark, sf, "application_train"), _LEVELS)), "Cramer's V"))
    return rounded(D.related_features(pairs).withColumn("related_features", F.array_join("related_features", ",")))


@register("effect_directions", with_roles(
    """SELECT feature, CASE WHEN abs(c) >= 0.15 THEN CASE WHEN c > 0 THEN 'higher -> more risk' ELSE 'higher -> less risk' END
        WHEN abs(d) >= 0.03 THEN CASE WHEN d > 0 THEN 'non-monotonic; upper values net more risk' ELSE 'non-monotonic; upper values net less risk' END
        ELSE 'mixed / weak marginal direction' END AS direction
    FROM (SELECT feature, corr(rv, rc) AS c, avg(contribution) FILTER (value >= hi) - avg(contribution) FILTER (value <= lo) AS d
      FROM (SELECT *, """ + _rank("value") + " AS rv, " + _rank("contribution") + """ AS rc FROM contributions WHERE value IS NOT NULL)
      JOIN (SELECT feature, CASE WHEN count(DISTINCT value) = 2 THEN min(value) ELSE quantile_cont(value, 0.25) END AS lo,
        CASE WHEN count(DISTINCT value) = 2 THEN max(value) ELSE quantile_cont(value, 0.75) END AS hi
      FROM contributions WHERE value IS NOT NULL GROUP BY 1) USING (feature) GROUP BY feature)""", "application_train", ctes=LONG_CTE))
def effect_directions(spark: SparkSession, sf: str) -> DataFrame:
    effects = D.numeric_effects(contributions(spark, sf))
    return effects.select("feature", D.direction_label(
        F.col("value_contribution_spearman"), F.col("upper_minus_lower_contribution")).alias("direction"))


# ---------------------------------------------------------------- ablation

# What the transparent scorer and the routes read, and what the package row of the check calls it.
_INPUTS = ("AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "EMPLOYMENT_YEARS", "BUREAU_ANNUITY_SUM", "BUREAU_DEBT_SUM",
           "CC_UTILIZATION_MEAN", "AMT_REQ_CREDIT_BUREAU_MON", "BUREAU_OVERDUE_CREDIT_COUNT", "BUREAU_DAYS_SINCE_CREDIT_MAX", *I.FAMILIES)
_RENAMED = {"HAS_BUREAU_HISTORY": "has_report", "HAS_CREDIT_CARD_HISTORY": "has_card", "HAS_POS_HISTORY": "has_pos"}
_MODEL_COLUMNS = sorted({*I.APPLICATION_COLUMNS.values(), *D.DERIVED_FROM, *I.FAMILIES, *[n for _, n in INTAKE_COLUMNS]})
_MASKS = D.intake_field_masks(_MODEL_COLUMNS, I.APPLICATION_COLUMNS)


def _masked_probability() -> str:
    """The scorer's formula with its value for unknown employment, which no scorable package has before a mask hides it."""
    return _probability_sql().replace("CASE WHEN EMPLOYMENT_YEARS < 1", "CASE WHEN EMPLOYMENT_YEARS IS NULL THEN 0.35e0 WHEN EMPLOYMENT_YEARS < 1")


_REQUIRED = ", ".join(f"'application.{n}'" for n in I.REQUIRED)


def _masked_sql() -> str:
    parts = ["SELECT 'baseline' AS field, * FROM counted WHERE scorable"]
    for name, (features, flags) in _MASKS.items():
        changes = [f"NULL AS {f}" for f in features if f in _INPUTS] + [f"{v} AS {_RENAMED[f]}" for f, v in flags.items()]
        replaced = f"* REPLACE ({', '.join(changes)})" if changes else "*"
        parts.append(f"SELECT '{name}' AS field, {replaced} FROM counted WHERE scorable")
    return " UNION ALL BY NAME ".join(parts)


@register("field_ablation", with_roles(
    f"""SELECT field, {r6('ap - base_ap')} AS delta_average_precision, {r6('auc - base_auc')} AS delta_roc_auc, {r6('shift')} AS mean_absolute_probability_shift,
      {r6('moved')} AS route_change_share, CASE WHEN field IN ({_REQUIRED}) THEN 'REQUIRED' WHEN moved >= 0.01 THEN 'EXPECTED' ELSE 'OPTIONAL' END AS tier
    FROM ranks JOIN (SELECT s.field, avg(abs(s.p - b.p)) AS shift, avg(CASE WHEN s.route <> b.route THEN 1 ELSE 0 END) AS moved
        FROM routed s JOIN routed b USING (applicant_ref) WHERE b.field = 'baseline' AND s.field <> 'baseline' GROUP BY s.field) USING (field),
      (SELECT ap AS base_ap, auc AS base_auc FROM ranks WHERE field = 'baseline')""", *SHEET_ROLES, ctes=f"""{SCORED_CTE},
masked AS ({_masked_sql()}),
probed AS (SELECT applicant_ref, field, TARGET, has_report + has_card + has_pos AS families, {_masked_probability()} AS p FROM masked),
routed AS (SELECT *, {_route_sql('p', '0')} AS route, rank() OVER (PARTITION BY field ORDER BY p) + (count(*) OVER (PARTITION BY field, p) - 1) / 2.0 AS r,
  count(*) OVER (PARTITION BY field ORDER BY p DESC) AS picked, sum(TARGET) OVER (PARTITION BY field ORDER BY p DESC) AS caught FROM probed),
ranks AS (SELECT field, (sum(r) FILTER (TARGET = 1) - sum(TARGET) * (sum(TARGET) + 1) / 2.0) / (sum(TARGET) * (count(*) - sum(TARGET)))::DOUBLE AS auc,
  sum(caught / picked::DOUBLE) FILTER (TARGET = 1) / sum(TARGET)::DOUBLE AS ap FROM routed GROUP BY field)"""))
def field_ablation(spark: SparkSession, sf: str) -> DataFrame:
    labels = role(spark, sf, "application_train").select(
        F.concat(F.lit("HC-"), F.col("SK_ID_CURR").cast("string")).alias(I.REF), "TARGET")
    rows = packages(spark, sf).where(F.size("violations") == 0).join(labels, I.REF)

    def route(df: DataFrame):
        families = sum((F.when(F.col(f) == 1, 1).otherwise(0) for f in I.FAMILIES), F.lit(0))
        return S.intake_route(families, F.col("probability"), F.lit(0))

    table = D.ablation(rows, I.REF, _MASKS, transparent_intake_score, route, _INPUTS)
    return rounded(D.field_tiers(table, [f"application.{n}" for n in I.REQUIRED]))
