import os

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import application as A
from ledgerlight.operators import audit as D
from ledgerlight.operators import intake as I
from ledgerlight.operators import profile as R
from ledgerlight.operators import reasons as N
from ledgerlight.operators import scoring as S
from ledgerlight.operators.manifest import build_manifest, manifest_summary
from ledgerlight.plans import portfolio as W
from ledgerlight.sources.sheets import read_sheet
from ledgerlight.sources.tables import read_csv_table, read_descriptions, write_csv, write_json_lines

TEXT = ["SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_EMPLOYED", "CODE_GENDER", "EXT_SOURCE_1"]


def test_dirty_profile(spark):
    df = spark.createDataFrame([
        ("1", "0", "100000", "40000", "2000", "-100", "F", "0.5"), ("1", "1", "50000", "10000", "500", "365243", "M", ""),
        (" ", "0", "0", "-5", "0", "-3", "XNA", "NA"), ("4", "2", "bad", "1", "1", "-3", "F", None),
        ("5", "", "1", "1", "1", "-3", "F", "nan")], TEXT)
    s = R.summary(df).first()
    assert (s.rows, s.duplicate_keys, s.target_0, s.target_1, s.target_other) == (5, 1, 2, 1, 2)
    assert s.target_prevalence == 0.2 and s.maximum_severity == "critical" and not s.ready_for_modeling
    counts = {r.code: r["count"] for r in R.findings(R.counters(df)).collect()}
    assert counts == {f"DQ-APP-00{i}": n for i, n in zip(range(1, 9), (1, 1, 2, 1, 1, 1, 1, 1))}
    assert [r.column for r in R.missingness(df).where("mostly_missing").collect()] == ["EXT_SOURCE_1"]
    income = R.numeric_profile(df, ["AMT_INCOME_TOTAL"]).first()
    assert income["count"] == 4 and income.invalid_count == 1
    with pytest.raises(ValueError):
        R.check_columns(df.drop("TARGET"))


def test_engineering(spark):
    df = spark.createDataFrame(
        [(1, 100.0, 40.0, 4.0, 50.0, -730, 0.2, 0.4, None), (2, 0.0, 40.0, None, 50.0, 365243, None, None, 0.5)],
        "SK_ID_CURR long, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, AMT_GOODS_PRICE double, "
        "DAYS_EMPLOYED int, EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double")
    one, two = A.engineer(df).orderBy("SK_ID_CURR").collect()
    assert one.CREDIT_TO_INCOME == 0.4 and one.DOWN_PAYMENT_RATE == pytest.approx(0.2)
    assert one.EXT_SOURCE_STD == pytest.approx(0.1 * 2**0.5) and one.EXT_SOURCE_COUNT == 2
    assert two.EMPLOYMENT_SENTINEL == 1 and two.EMPLOYMENT_YEARS is None and two.CREDIT_TO_INCOME is None
    assert two.EXT_SOURCE_STD is None and one.APPLICATION_MISSING_COUNT == 1
    # annuity, years, 3 ratios without income / annuity, two sources, deviation
    assert two.APPLICATION_MISSING_COUNT == 8


def test_burden_and_obligation(spark):
    df = spark.createDataFrame(
        [(100.0, 20.0, 50.0, 10.0, 30.0, 1, 2), (0.0, 20.0, 50.0, 10.0, 30.0, 1, 2)],
        "AMT_INCOME_TOTAL double, AMT_ANNUITY double, AMT_CREDIT double, TBUREAU_ACTIVE_ANNUITY_SUM double, "
        "TBUREAU_ACTIVE_DEBT_SUM double, HAS_TEMPORAL_BUREAU int, CYCLING_SIGNAL_FAMILY_COUNT int")
    a, b = A.burden_features(df).collect()
    assert a.BURDEN_ACTIVE_ANNUITY_TO_INCOME == pytest.approx(0.1)
    assert a.BURDEN_PROPOSED_PLUS_ACTIVE_ANNUITY_TO_INCOME == pytest.approx(0.3)
    assert a.CYCLING_SIGNAL_BURDEN_INTERACTION == pytest.approx(0.6) and b.BURDEN_ACTIVE_DEBT_TO_INCOME is None
    o = spark.createDataFrame([(100.0, 20.0, None, 5.0), (100.0, None, 10.0, None)],
                              "AMT_INCOME_TOTAL double, AMT_ANNUITY double, BUREAU_ANNUITY_SUM double, BUREAU_DEBT_SUM double")
    x, y = A.obligation_ratios(o).collect()
    assert x.TOTAL_OBLIGATION_TO_INCOME is None and x.EXTERNAL_DEBT_TO_INCOME == 0.05
    assert y.TOTAL_OBLIGATION_TO_INCOME == 0.1


def test_selection_and_variants(spark):
    df = spark.createDataFrame([(1, 0, "M", 5.0, None, 1, "a"), (2, 1, "F", 6.0, None, 1, "b")],
                               "SK_ID_CURR long, TARGET int, CODE_GENDER string, AMT_CREDIT double, X double, C int, NAME_INCOME_TYPE string")
    status = {r.feature: r.status for r in A.feature_inventory(df).collect()}
    assert status == {"SK_ID_CURR": "excluded_by_policy", "TARGET": "excluded_by_policy", "CODE_GENDER": "excluded_by_policy",
                      "AMT_CREDIT": "selected", "X": "excluded_high_missingness", "C": "excluded_constant",
                      "NAME_INCOME_TYPE": "selected"}
    chosen = A.select_features(df)
    assert chosen.numeric == ("AMT_CREDIT",) and chosen.categorical == ("NAME_INCOME_TYPE",)
    names = ("AMT_CREDIT", "EXT_SOURCE_1", "BUREAU_DEBT_SUM", "CC_DRAWINGS_SUM", "CC_LIMIT_MAX", "PREV_CREDIT_SUM")
    kept = {v: [n for n in names if f(n)] for v, f in A.VARIANTS.items()}
    assert kept["v3_core"] == ["AMT_CREDIT", "BUREAU_DEBT_SUM"]
    assert kept["v3_extended"] == ["AMT_CREDIT", "BUREAU_DEBT_SUM", "CC_LIMIT_MAX"]
    added = ["HAS_TEMPORAL_POS", "TINST_CURE_COUNT", "TINST_LATE_RATE_90D", "TPREV_REFUSED_COUNT_90D"]
    assert A.temporal_columns(added, "repayment_sequence") == ["HAS_TEMPORAL_POS", "TINST_CURE_COUNT"]
    assert A.temporal_columns(added, "repayment_recency") == ["HAS_TEMPORAL_POS", "TINST_LATE_RATE_90D"]


PROFILE = ("application_id string, requested_amount double, annual_income double, annual_annuity double, family_size int, "
           "employment_years double, existing_monthly_obligations double, active_accounts int, total_outstanding double, "
           "credit_utilization double, recent_inquiries int, delinquent_accounts int, bureau_history_months int, data_coverage double")


def test_scores_and_policy(spark):
    df = spark.createDataFrame([
        ("strong", 10000.0, 120000.0, 3000.0, 2, 10.0, 100.0, 2, 1000.0, 0.05, 0, 0, 120, 1.0),
        ("risky", 90000.0, 50000.0, 20000.0, 1, None, 1500.0, 5, 60000.0, 0.9, 6, 2, None, 0.65),
        ("thin", 10000.0, 120000.0, 3000.0, 2, 10.0, 100.0, 2, 1000.0, 0.05, 0, 0, 120, 0.5),
        ("bad", 0.0, 120000.0, 3000.0, 0, 10.0, 100.0, 2, 1000.0, 0.05, 0, 0, 120, 1.5)], PROFILE)
    assert S.check_profiles(df).where("application_id = 'bad'").first().violations == [
        "requested_amount must be greater than zero", "family_size must be at least one", "data_coverage must be between 0 and 1"]
    rows = {r.application_id: r for r in S.apply_policy(S.score_profiles(S.valid_profiles(df))).collect()}
    assert rows["strong"].risk_grade == "A" and rows["strong"].recommendation == "APPROVE" and rows["strong"].confidence in ("HIGH", "MEDIUM")
    assert rows["risky"].risk_grade == "E" and rows["risky"].recommendation == "DECLINE_RECOMMENDATION"
    # debt service (0.76 - 0.30) * 3.2 = 1.472, two delinquent accounts 1.44, credit ratio (1.8 - 0.4) * 0.9 = 1.26
    assert rows["risky"].adverse_reason_codes == ["HC01", "HC02", "HC06"]
    assert rows["thin"].recommendation == "MANUAL_REVIEW" and rows["thin"].scoring_path == "THIN_FILE_DEMO"


def test_routes_and_affordability(spark):
    df = spark.createDataFrame([(0.08, 3), (0.35, 5), (0.101, 4)], "p double, n int")
    got = [(r.confidence, r.confidence_route) for r in S.confidence_route(df, "p", "n").collect()]
    assert got == [("LOW", "MANUAL_REVIEW_DATA_LIMITED"), ("HIGH", "STANDARD_REVIEW"), ("MEDIUM", "MANUAL_REVIEW_NEAR_RISK_BOUNDARY")]
    terms = spark.createDataFrame([(100000.0, 50000.0, 200000.0)], "annual_income double, annual_annuity double, requested_credit double")
    r = S.affordability_context(terms).first()
    assert r.affordability_screen == "SCREEN_REVIEW" and r.repayment_to_income == 0.5
    assert r.credit_at_maximum_ratio == pytest.approx(160000)


def test_reasons(spark):
    df = spark.createDataFrame([(1, "POS_DPD_MAX", 0.6), (1, "CC_UTILIZATION_MEAN", 0.3), (1, "EXT_SOURCE_2", -0.5),
                                (1, "missingindicator_AMT_ANNUITY", 0.1)], "id long, feature string, contribution double")
    r = N.row_reasons(df, "id").first()
    assert [x.code for x in r.adverse] == ["ML01", "ML02", "ML07"] and [x.code for x in r.favorable] == ["ML06"]
    assert r.adverse[0].features == ["POS_DPD_MAX"]
    labels = spark.createDataFrame([("BB_X",), ("EXT_SOURCE_1",), ("NAME_X",), ("FLAG_MOBIL",)], "f string").select(
        N.source_group(F.col("f")).alias("g")).collect()
    assert [x.g for x in labels] == ["Bureau monthly status", "External scores", "Application categorical", "Application verified flags"]


def sheets(spark):
    make = spark.createDataFrame
    app = ("applicant_ref string, annual_income string, requested_credit string, annual_annuity string, goods_price string, "
           "income_type string, education_type string, employment_years string, owns_car string, has_email string")
    return {
        "application": make([
            ("A", "600,000", "500000", "120000", "550000", "Working", "Higher", "4", "y", "Yes"),
            ("B", "600000", "500000", "120000", None, "Working", "Higher", "-1", "N", "n"),
            ("C", "x", "1", "1", "1", "Working", "Higher", "1", "N", "maybe"),
            ("D", "1", "1", "1", "1", "W", "H", "1", "N", "N"), ("D", "1", "1", "1", "1", "W", "H", "1", "N", "N")], app),
        "tradelines": make([("A", "t1", "Card", "Active", "100", "1000", "60000", "40000", "0"),
                            ("A", "t2", "Loan", "Strange", "800", "3000", "60000", "40000", "5")],
                           "applicant_ref string, account_ref string, credit_type string, status string, opened_days_ago string, "
                           "sanctioned_amount string, current_balance string, annuity string, days_overdue string"),
        "dpd_history": make([("A", "t1", "001C X"), ("A", "zz", "1")], "applicant_ref string, account_ref string, dpd_strip string"),
        "account_months": make([("A", "c1", "Revolving", "0", "0", "0", "Active", "400", "1000"),
                                ("A", "c1", "revolving", "1", "3", "0", "Active", "600", "1000"),
                                ("A", "p1", "installment", "1", "0", "0", "Active", None, None)],
                               "applicant_ref string, account_ref string, account_kind string, months_ago string, dpd_days string, "
                               "dpd_days_tolerant string, contract_status string, balance string, credit_limit string"),
        "enquiries": make([("A", d, "x") for d in ("0", "5", "60", "200", "400")], "applicant_ref string, days_ago string, purpose string"),
    }


def test_intake(spark):
    rows = {r.applicant_ref: r for r in I.build_features(sheets(spark)).collect()}
    a, b, c = rows["A"], rows["B"], rows["C"]
    assert a.violations == [] and a.BUREAU_ANNUITY_SUM == 80000 and a.BUREAU_ACTIVE_COUNT == 1
    assert a.TOTAL_OBLIGATION_TO_INCOME == pytest.approx(200000 / 600000)
    assert a.EXTERNAL_DEBT_TO_INCOME == pytest.approx(120000 / 600000)
    assert (a.BB_MONTHS_OBSERVED, a.BB_DELINQUENT_MONTHS, a.BB_CLOSED_MONTHS, a.BB_UNKNOWN_MONTHS) == (5, 1, 1, 1)
    assert a.CC_UTILIZATION_MEAN == 0.5 and a.CC_UTILIZATION_MAX == 0.6 and a.CC_DPD_MONTH_RATE == 0.5 and a.POS_MONTH_COUNT == 1
    bands = [getattr(a, f"AMT_REQ_CREDIT_BUREAU_{n}") for n in I.ENQUIRY_BANDS]
    assert bands == [1, 0, 1, 0, 1, 1]
    assert len(a.findings) == 4  # car age, strange status, orphan account, old enquiry
    assert b.HAS_BUREAU_HISTORY == 0 and b.BUREAU_DEBT_SUM is None and b.EMPLOYMENT_SENTINEL == 1 and b.EMPLOYMENT_YEARS is None
    assert "expected a number in annual_income" in c.violations and "expected Y or N in has_email" in c.violations
    assert rows["D"].violations == ["'application' must hold exactly one row"]


def test_strip_positions(spark):
    strip = spark.createDataFrame([("A", "t", " 001C X ")], "applicant_ref string, account_ref string, dpd_strip string")
    got = sorted((int(r.months_ago), r.status) for r in I.expand_strips(strip).collect())
    assert got == [(0, "0"), (1, "0"), (2, "1"), (3, "C"), (5, "X")]


def test_alignment_gaps_and_portfolio(spark):
    features = I.build_features(sheets(spark)).cache()
    aligned = I.align(features.where("applicant_ref = 'B'"), ["AMT_CREDIT", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "APPLICATION_MISSING_COUNT"]).first()
    assert aligned.features_supplied == 2 and aligned.APPLICATION_MISSING_COUNT == 2
    gaps = {r.applicant_ref: r.g for r in features.select("applicant_ref", I.expected_gaps().alias("g")).collect()}
    assert gaps["A"] == [] and gaps["B"] == ["sheet.tradelines", "sheet.account_months", "application.goods_price"]
    screen = {r.applicant_ref: r.route for r in W.screen_portfolio(features, W.transparent_intake_score).collect()}
    assert screen["C"] == screen["D"] == "NOT SCORED" and screen["B"] == "DATA-LIMITED MANUAL REVIEW"
    sweep = W.request_sweep(features, W.transparent_intake_score).where("applicant_ref = 'A'").orderBy("multiplier").collect()
    assert len(sweep) == 6 and sweep[0].probability <= sweep[-1].probability and sweep[2].requested_credit == 500000
    masks = D.intake_field_masks(features.columns, I.APPLICATION_COLUMNS)
    assert "CREDIT_TO_INCOME" in masks["application.annual_income"][0] and masks["sheet.tradelines"][1] == {"HAS_BUREAU_HISTORY": 0}


def test_overrides(spark):
    apps = spark.createDataFrame([(1, 10.0, 20.0, 3.0, 4.0), (2, 10.0, 20.0, 3.0, 4.0)],
                                 "SK_ID_CURR long, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, AMT_GOODS_PRICE double")
    changes = spark.createDataFrame([(1, 1, "annual_income", 50.0), (1, 2, "annual_income", 60.0), (1, 3, "annual_income", -1.0),
                                     (1, 4, "other", 5.0), (2, 5, "goods_price", None)],
                                    "application_id long, sequence long, name string, value double")
    rows = {r.SK_ID_CURR: r for r in S.apply_overrides(apps, changes).collect()}
    assert rows[1].AMT_INCOME_TOTAL == 60 and rows[1].original_annual_income == 10 and rows[2].AMT_GOODS_PRICE == 4


def test_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "bureau_balance.csv").write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,C\n1,-2,3\n")
    (raw / "sample_submission.csv").write_text("SK_ID_CURR\n1\n")
    (raw / "HomeCredit_columns_description.csv").write_bytes("Table,Row,Description,X\nt,A,caf\xe9,1\nt,A,again,1\nt,B,,1\n".encode("latin-1"))
    table = {r.table_name: r for r in build_manifest(spark, str(raw)).collect()}
    bb = table["bureau_balance"]
    assert bb.schema_valid and bb.row_count == 2 and len(bb.sha256) == 64 and bb.bytes == os.path.getsize(raw / "bureau_balance.csv")
    assert table["sample_submission"].missing_required_columns == ["TARGET"] and table["bureau"].status == "missing"
    summary = manifest_summary(build_manifest(spark, str(raw))).first()
    assert not summary.ready_for_profiling and summary.missing_required_files == 7
    assert [r.MONTHS_BALANCE for r in read_csv_table(spark, str(raw), "bureau_balance").orderBy("MONTHS_BALANCE").collect()] == [-2, -1]
    docs = read_descriptions(spark, str(raw / "HomeCredit_columns_description.csv")).collect()
    assert [d.Row for d in docs] == ["A"]
    for name, header in (("p1", "days_ago,purpose\n0,x\n7,y\n"), ("p2", "purpose,days_ago\nz,31\n")):
        os.makedirs(tmp_path / "packages" / name)
        (tmp_path / "packages" / name / "enquiries.csv").write_text(header)
    got = sorted((r.applicant_ref, r.days_ago) for r in read_sheet(spark, str(tmp_path / "packages"), "enquiries", ["days_ago", "purpose"]).collect())
    assert got == [("p1", "0"), ("p1", "7"), ("p2", "31")]
    df = spark.range(3)
    write_json_lines(df, str(tmp_path / "j"))
    write_csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_incomplete_and_mixed_packages_stay(spark):
    s = sheets(spark)
    s["dpd_history"] = spark.createDataFrame(
        [("A", "t1", "001C X", None, None), ("B", "t9", None, "2", "1"), ("B", "t9", None, "3", "0"), ("A", "t2", "", None, None)],
        "applicant_ref string, account_ref string, dpd_strip string, months_ago string, status string")
    got = {(r[0], r[1], r[2]) for r in I.parse_dpd(s["dpd_history"]).select("applicant_ref", "MONTHS_BALANCE", "STATUS").collect()}
    assert got == {("A", 0.0, "0"), ("A", -1.0, "0"), ("A", -2.0, "1"), ("A", -3.0, "C"), ("A", -5.0, "X"), ("B", -2.0, "1"), ("B", -3.0, "0")}
    more = spark.createDataFrame([("E", "t5", "Card", "Active", "12O0", "1", "1", "1", "0")], s["tradelines"].schema)
    s["tradelines"] = s["tradelines"].unionAll(more)
    s["account_months"] = s["account_months"].unionAll(spark.createDataFrame(
        [("B", "c9", None, "0", "0", "0", "Active", "4", "10")], s["account_months"].schema))
    features = I.build_features(s)
    rows = {r.applicant_ref: r.violations for r in features.collect()}
    assert rows["A"] == [] and set(rows) == set("ABCDE")
    assert rows["B"] == ["account_months.account_kind must be revolving or installment"]
    assert rows["E"] == ["missing required sheet: application", "expected a number in tradelines.opened_days_ago"]
    screen = {r.applicant_ref: r.route for r in W.screen_portfolio(features, W.transparent_intake_score).collect()}
    assert {k for k, v in screen.items() if v == "NOT SCORED"} == set("BCDE")


def test_reason_rules_and_texts_by_example(spark):
    names = {  # feature: code, group, family, direction
        "BUREAU_DAYS_OVERDUE_MEAN": ("ML01", "Credit bureau", "Frozen bureau history", "higher -> more risk"),
        "CC_UTILIZATION_MEAN": ("ML02", "Credit card history", "Frozen credit-card history", "higher -> more risk"),
        "EXT_SOURCE_2": ("ML06", "External scores", "External scores", "higher -> less risk"),
        "MISSINGINDICATOR_EXT_SOURCE_1": ("ML07", "Application verified flags", "Application and other", "higher -> less risk"),
        "AMT_CREDIT": ("ML08", "Application financial", "Application and other", "context-dependent"),
        "HOUSETYPE_MODE": ("ML11", "Application property", "Application and other", "context-dependent"),
        "OBS_30_CNT_SOCIAL_CIRCLE": ("ML99", "Application financial", "Application and other", "context-dependent"),
        "LIVINGAREA_AVG": ("ML11", "Application property", "Application and other", "context-dependent"),
    }
    table = spark.createDataFrame([(n,) for n in names], "f string").select(
        "f", N.reason_code(F.col("f")), N.source_group(F.col("f")), N.feature_family(F.col("f")),
        N.expected_direction(F.col("f"), F.lit(False)))
    assert {r[0]: tuple(r[1:]) for r in table.collect()} == names
    texts = spark.range(1).select(N.describe(F.lit("ML02"), True), N.describe(F.lit("ML07"), False)).first()
    assert tuple(texts) == ("Credit utilization and revolving balances increase estimated repayment risk",
                            "Available source information reduces model uncertainty or risk")


def test_masks_follow_one_rule(spark):
    columns = ["AMT_INCOME_TOTAL", "CREDIT_TO_INCOME", "BUREAU_ANNUITY_SUM", "TOTAL_OBLIGATION_TO_INCOME", "BB_MONTHS_OBSERVED", "POS_DPD_MAX"]
    masks = D.intake_field_masks(columns, {"annual_income": "AMT_INCOME_TOTAL", "goods_price": "AMT_GOODS_PRICE"})
    assert masks["application.annual_income"] == (["AMT_INCOME_TOTAL", "CREDIT_TO_INCOME", "TOTAL_OBLIGATION_TO_INCOME"], {})
    assert "application.goods_price" not in masks and masks["sheet.dpd_history"] == (["BB_MONTHS_OBSERVED"], {})
    assert masks["tradelines.annuity"] == (["BUREAU_ANNUITY_SUM", "TOTAL_OBLIGATION_TO_INCOME"], {})
    assert masks["sheet.account_months"] == (["POS_DPD_MAX"], {"HAS_CREDIT_CARD_HISTORY": 0, "HAS_POS_HISTORY": 0})
