"""Tiny raw tables for the store builds."""

TERMS = "AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double"
BUREAU = ("SK_ID_CURR long, SK_ID_BUREAU long, CREDIT_ACTIVE string, CREDIT_TYPE string, DAYS_CREDIT int, "
          "CREDIT_DAY_OVERDUE int, CNT_CREDIT_PROLONG int, AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, "
          "AMT_CREDIT_SUM_OVERDUE double, AMT_CREDIT_SUM_LIMIT double, AMT_ANNUITY double")
BALANCE = "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string"
PREVIOUS = ("SK_ID_PREV long, SK_ID_CURR long, NAME_CONTRACT_STATUS string, NAME_CONTRACT_TYPE string, "
            "NAME_YIELD_GROUP string, NAME_CASH_LOAN_PURPOSE string, DAYS_DECISION int, AMT_APPLICATION double, "
            "AMT_CREDIT double, AMT_ANNUITY double, AMT_DOWN_PAYMENT double, RATE_DOWN_PAYMENT double, CNT_PAYMENT double")
POS = ("SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, CNT_INSTALMENT double, CNT_INSTALMENT_FUTURE double, "
       "NAME_CONTRACT_STATUS string, SK_DPD int, SK_DPD_DEF int")
CARD = ("SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, AMT_BALANCE double, AMT_CREDIT_LIMIT_ACTUAL double, "
        "AMT_DRAWINGS_CURRENT double, AMT_DRAWINGS_ATM_CURRENT double, AMT_DRAWINGS_POS_CURRENT double, "
        "AMT_PAYMENT_CURRENT double, AMT_PAYMENT_TOTAL_CURRENT double, AMT_INST_MIN_REGULARITY double, "
        "AMT_TOTAL_RECEIVABLE double, CNT_DRAWINGS_CURRENT int, CNT_DRAWINGS_ATM_CURRENT int, "
        "CNT_DRAWINGS_POS_CURRENT int, NAME_CONTRACT_STATUS string, SK_DPD int, SK_DPD_DEF int")
PAYMENTS = ("SK_ID_PREV long, SK_ID_CURR long, NUM_INSTALMENT_VERSION double, NUM_INSTALMENT_NUMBER int, "
            "DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT int, AMT_INSTALMENT double, AMT_PAYMENT double")


def raw_tables(spark):
    """One applicant with every source, one without any."""
    make = spark.createDataFrame
    return {
        "application_train": make([(1, 1, 100.0, 50.0, 5.0)], f"SK_ID_CURR long, TARGET int, {TERMS}"),
        "application_test": make([(2, 100.0, 50.0, 5.0)], f"SK_ID_CURR long, {TERMS}"),
        "bureau": make([(1, 10, "Active", "Consumer credit", -100, 0, 0, 1000.0, 250.0, 10.0, 0.0, 100.0)], BUREAU),
        "bureau_balance": make([(10, -1, "1"), (10, -2, "C")], BALANCE),
        "previous_application": make([
            (20, 1, "Approved", "Cash loans", "high", "Payments on other loans", -20, 1000.0, 900.0, 100.0, 0.0, 0.0, 12.0),
            (21, 1, "Refused", "Cash loans", "low", "XAP", -25, 500.0, 500.0, 50.0, 0.0, 0.0, 6.0),
            (22, 1, "Refused", "Consumer loans", "low", "XAP", -60, 500.0, 500.0, 50.0, 0.0, 0.0, 6.0)], PREVIOUS),
        "pos_cash_balance": make([
            (20, 1, -2, 12.0, 8.0, "Active", 5, 1), (20, 1, -1, 12.0, 7.0, "Active", 0, 0)], POS),
        "credit_card_balance": make([
            (30, 1, -2, 900.0, 1000.0, 50.0, 20.0, 30.0, 40.0, 40.0, 50.0, 950.0, 3, 1, 2, "Active", 0, 0),
            (30, 1, -1, 950.0, 1000.0, 50.0, 20.0, 30.0, 40.0, 40.0, 50.0, 950.0, 3, 1, 2, "Active", 0, 0)], CARD),
        # Instalment 3 is paid in two parts, instalment 1 late and short.
        "installments_payments": make([
            (20, 1, 1.0, 1, -100, -98, 100.0, 90.0), (20, 1, 1.0, 2, -70, -75, 100.0, 100.0),
            (20, 1, 1.0, 3, -40, -38, 100.0, 60.0), (20, 1, 1.0, 3, -40, -37, 100.0, 40.0)], PAYMENTS),
    }
