import pytest
from pyspark.sql import functions as F

from fixtures_raw import PAYMENTS, raw_tables
from ledgerlight.functions.expressions import rounded
from ledgerlight.operators import history as H
from ledgerlight.operators import quality as G
from ledgerlight.operators import temporal as P
from ledgerlight.plans.stores import build_lifetime_store, build_temporal_store, store_report
from ledgerlight.plans.training import merge_with_gaps, write_sealed
from ledgerlight.sources.snapshots import CommitConflict, Snapshots, restrict
from ledgerlight.sources.tables import check_csv_table, read_csv_table, read_store


def by_id(df):
    return {r.SK_ID_CURR: r for r in df.collect()}


def test_lifetime_store(spark):
    store = H.lifetime_features(raw_tables(spark))
    assert len(store.columns) == 151 and "TARGET" not in store.columns
    rows = by_id(store)
    assert set(rows) == {1, 2}
    one, two = rows[1], rows[2]
    assert one.BUREAU_CREDIT_COUNT == 1 and one.BB_DELINQUENT_MONTHS == 1 and one.BB_MAX_DELINQUENCY_LEVEL == 1
    assert one.INST_LATE_PAYMENT_COUNT == 3 and one.INST_SHORT_PAYMENT_COUNT == 3
    assert one.CC_UTILIZATION_MEAN == pytest.approx(0.925)
    assert one.PREV_CREDIT_TO_APPLICATION_MEAN == pytest.approx((0.9 + 1 + 1) / 3)
    assert two.HAS_BUREAU_HISTORY == 0 and two.BUREAU_CREDIT_COUNT is None and two.INST_DUE_SUM is None


def test_temporal_store(spark):
    store = P.temporal_features(raw_tables(spark))
    assert len(store.columns) - 1 == 111
    rows = by_id(store)
    one, two = rows[1], rows[2]
    assert one.TINST_EVENT_COUNT_365D == 3
    assert one.TINST_SHORT_COUNT_90D == 0  # 60 + 40 reconciles to a full payment
    assert one.TINST_RECENT_EVENT_1_LATE == 1 and one.TINST_RECENT_EVENT_3_SHORT == 1
    assert one.TINST_WEIGHTED_LATE_RATE_90D > one.TINST_WEIGHTED_LATE_RATE_365D
    assert one.TINST_CURE_COUNT == 1 and one.TINST_RELAPSE_COUNT == 1 and one.TINST_CURRENT_LATE_STREAK_MAX == 1
    assert one.TPREV_APPLICATION_BURST_MAX_30D == 2 and one.TPREV_DECISION_GAP_MIN_DAYS == 5
    assert one.TPREV_DECISION_GAP_MEAN_DAYS == 20 and one.TPREV_CASH_AFTER_STRESS_90D_COUNT == 1
    assert one.TPOS_DPD_CURE_COUNT == 1 and one.TCC_MAXED_RATE_6M == 1.0
    assert one.CYCLING_MULTI_SIGNAL_FLAG == 1
    assert two.HAS_TEMPORAL_INSTALLMENTS == 0 and two.TPREV_CASH_AFTER_STRESS_90D_COUNT == 0
    assert two.TINST_EVENT_COUNT_365D is None


def brute_loan(events):
    """Run structure of one loan's ordered late flags, by hand."""
    late = [e for e in events]
    runs = best = 0
    for flag in late:
        runs = runs + 1 if flag else 0
        best = max(best, runs)
    trailing = 0
    for flag in reversed(late):
        if not flag:
            break
        trailing += 1
    clean_tail = 0
    for flag in reversed(late):
        if flag:
            break
        clean_tail += 1
    cures = sum(1 for a, b in zip(late, late[1:]) if a and not b)
    relapses = sum(1 for a, b in zip(late, late[1:]) if not a and b)
    return best, trailing, clean_tail, cures, relapses


def test_sequences_match_brute_force_with_a_hot_loan(spark):
    """Loan 1 holds a third of the rows and repeats due days; ties: not late first, then number."""
    rows, expected = [], {}
    state = 7
    for loan, size in ((1, 400), *((n, 8) for n in range(2, 102))):
        events = []
        for number in range(size):
            state = (state * 1103515245 + 12345) % 2**31
            due, late = -(state // 7 % 90), state // 1000 % 3 == 0
            rows.append((loan, loan, 1.0, number, due, due + (2 if late else 0), 10.0, 10.0))
            events.append((due, late, number))
        expected[loan] = brute_loan([late for _, late, _ in sorted(events)])
    loans = P.loan_features(P.loan_day_sequence(P.reconcile_installments(spark.createDataFrame(rows, PAYMENTS))))
    for r in loans.collect():
        assert (r.TINST_LOAN_MAX_CONSECUTIVE_LATE, r.TINST_LOAN_CURRENT_LATE_STREAK,
                r.TINST_LOAN_CURRENT_ON_TIME_STREAK, r.TINST_LOAN_CURE_COUNT,
                r.TINST_LOAN_RELAPSE_COUNT) == expected[r.SK_ID_PREV], r.SK_ID_PREV


def test_stage_gate_promote(spark, tmp_path):
    tables = raw_tables(spark)
    target = str(tmp_path / "lifetime")
    findings = build_lifetime_store(spark, tables, target)
    assert findings.where("failed").count() == 0
    build_lifetime_store(spark, tables, target)  # replaces the earlier version
    assert read_store(spark, target, one_id=1).count() == 1
    assert read_store(spark, target, ids=tables["application_test"]).first().SK_ID_CURR == 2
    assert '"ready":true' in store_report(read_store(spark, target), findings).first().report
    temporal = build_temporal_store(spark, tables, str(tmp_path / "temporal"))
    assert temporal.where("failed").count() == 0


def test_gate_refuses_future_events_and_duplicates(spark, tmp_path):
    tables = raw_tables(spark)
    tables["bureau"] = tables["bureau"].withColumn("DAYS_CREDIT", F.lit(3))
    with pytest.raises(ValueError, match="future_relative_events"):
        build_temporal_store(spark, tables, str(tmp_path / "t"))
    store = H.lifetime_features(raw_tables(spark))
    findings = G.lifetime_findings(store.unionAll(store), tables["application_train"], tables["application_test"])
    bad = {r.check for r in findings.where("failed").collect()}
    assert bad == {"application_row_reconciliation", "primary_key_uniqueness"}
    assert G.gate(findings).first().asDict() == {
        "failed_checks": 2, "maximum_severity": "critical", "ready": False}
    with pytest.raises(ValueError, match="contracts"):
        build_lifetime_store(spark, {**tables, "bureau": tables["bureau"].drop("CREDIT_ACTIVE")}, str(tmp_path / "x"))


def test_merge_with_gaps_and_sealed_write(spark, tmp_path):
    apps = spark.createDataFrame([(1, 10.0), (2, 20.0)], "SK_ID_CURR long, AMT_CREDIT double")
    store = spark.createDataFrame([(1, 1, 5.0)], "SK_ID_CURR long, HAS_BUREAU_HISTORY int, BUREAU_DEBT_SUM double")
    rows = by_id(merge_with_gaps(apps, store, ["HAS_BUREAU_HISTORY", "BUREAU_DEBT_SUM"]))
    assert rows[2].HAS_BUREAU_HISTORY == 0 and rows[2].BUREAU_DEBT_SUM is None and rows[2].store_row_missing
    with pytest.raises(ValueError, match="unique"):
        merge_with_gaps(apps, store.unionAll(store), ["HAS_BUREAU_HISTORY"])
    with pytest.raises(ValueError, match="missing"):
        merge_with_gaps(apps, store, ["NOT_THERE"])
    write_sealed(apps, str(tmp_path / "holdout"))
    with pytest.raises(Exception, match="already exists"):
        write_sealed(apps, str(tmp_path / "holdout"))


def test_snapshots_commit_refuse_and_keep_versions(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    assert table.current() == 0 and table.history().count() == 0
    with pytest.raises(FileNotFoundError, match="no committed"):
        table.read()
    first = spark.range(0, 100).select(F.col("id").alias("k"))
    second = spark.range(0, 5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert table.commit(first, "k") == 1 and table.commit(second, "k") == 2

    def refuse(written):
        assert written.count() == 100  # the gate reads what was written
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        table.commit(first, "k", refuse)
    assert table.current() == 2 and table.read().count() == 5000 and table.read(1).columns == ["k"]
    # another writer that took the next number with a smaller id has it
    rival = spark.createDataFrame([(3, "0", str(tmp_path / "x"), 1)], "version long, writer string, folder string, rows long")

    def lose(written):
        rival.coalesce(1).write.mode("append").json(str(tmp_path / "t" / "commits"))

    with pytest.raises(CommitConflict):
        table.commit(first, "k", lose)
    assert [r.version for r in table.history().orderBy("version").collect()] == [1, 2, 3]


def test_lookups_open_only_row_groups_that_can_match(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    table = Snapshots(spark, str(tmp_path / "t"))
    rows = spark.range(0, 40_000).select((F.col("id") * 7).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table in several files
    try:
        table.commit(rows.repartition(6), "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    store = table.read()
    files = [pq.ParquetFile(f).metadata for f in glob.glob(str(tmp_path / "t" / "data" / "*" / "*.parquet"))]
    groups = [m.row_group(g).column(0) for m in files for g in range(m.num_row_groups)]
    ranges = sorted((g.statistics.min, g.statistics.max) for g in groups)
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # a key lies in one row group
    few = restrict(store, "k", spark.createDataFrame([(7,), (70,), (71,), (None,)], "id long"))
    assert sorted(r.v for r in few.collect()) == [1, 10]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(k, " in plan and "Join" not in plan
    many = restrict(store, "k", spark.range(700, 70_000).select("id"))
    assert many.count() == len([k for k in range(0, 280_000, 7) if 700 <= k < 70_000])
    assert "GreaterThanOrEqual(k,700)" in many._jdf.queryExecution().executedPlan().toString()
    assert restrict(store, "k", spark.range(0).select("id")).count() == 0


def test_broken_cells_are_named(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "bureau_balance.csv").write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,C\n2,x,0\n3,-1.5,1\n4,,\n5.0,-3.0,X\n6,-1,0,9\n7,1e400,C\nseven,-2,C\n")
    checked = check_csv_table(spark, str(folder), "bureau_balance")
    got = sorted((r.SK_ID_BUREAU, r.column or "", r.kind) for r in checked.faults.collect())
    assert got == [("2", "MONTHS_BALANCE", "not_a_number"), ("3", "MONTHS_BALANCE", "not_whole"), ("6", "", "malformed_record"),
                   ("7", "MONTHS_BALANCE", "not_finite"), ("seven", "SK_ID_BUREAU", "not_a_number")]
    assert sorted((r.SK_ID_BUREAU, r.MONTHS_BALANCE, r.STATUS) for r in checked.rows.collect()) == [(1, -1, "C"), (4, None, None), (5, -3, "X")]
    with pytest.raises(ValueError, match="not_whole in MONTHS_BALANCE: 1"):
        read_csv_table(spark, str(folder), "bureau_balance")
    assert read_csv_table(spark, str(folder), "bureau_balance", most_faults=5).count() == 3


def test_bucketed_sources_are_not_exchanged(spark, tmp_path):
    from ledgerlight.sources.layout import read_layout, write_layout

    tables = raw_tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as between large tables
    try:
        write_layout(spark, tables, "layout_test", str(tmp_path / "layout"), 4)
        kept = read_layout(spark, "layout_test", list(tables))

        def moved(df):
            return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

        for block, name in ((H.previous_block, "previous_application"), (H.pos_block, "pos_cash_balance"),
                            (H.card_block, "credit_card_balance"), (H.installment_block, "installments_payments")):
            assert moved(block(kept[name])) == 0 < moved(block(tables[name])), name
        accounts = kept["bureau"].join(H.balance_by_account(kept["bureau_balance"]), "SK_ID_BUREAU", "left")
        assert moved(accounts) == 0
        plan = P.installment_rollup(P.reconcile_installments(kept["installments_payments"]))
        assert moved(plan) < moved(P.installment_rollup(P.reconcile_installments(tables["installments_payments"])))
        for build in (H.lifetime_features, P.temporal_features):
            assert by_id(rounded(build(kept))) == by_id(rounded(build(tables)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE IF EXISTS layout_test CASCADE")
