"""Source contracts as data: file, grain, keys, required columns and read schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class SourceContract:
    table: str
    file: str
    grain: str
    key: tuple[str, ...]
    required: tuple[str, ...]
    min_columns: int
    mandatory: bool = True
    references: tuple[tuple[str, str, str], ...] = ()  # (column, parent table, parent column)
    encoding: str = "UTF-8"


_APPLICATION = ("SK_ID_CURR", "application", "SK_ID_CURR")
_EARLIER = ("SK_ID_PREV", "previous_application", "SK_ID_PREV")

# The public source files and what each must hold.
CONTRACTS: tuple[SourceContract, ...] = (
    SourceContract(
        "application_train", "application_train.csv", "labelled application", ("SK_ID_CURR",),
        ("SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY"), 100,
    ),
    SourceContract(
        "application_test", "application_test.csv", "unlabelled application", ("SK_ID_CURR",),
        ("SK_ID_CURR", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY"), 100,
    ),
    SourceContract(
        "bureau", "bureau.csv", "external credit account", ("SK_ID_BUREAU",),
        ("SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", "DAYS_CREDIT"), 15, references=(_APPLICATION,),
    ),
    SourceContract(
        "bureau_balance", "bureau_balance.csv", "account-month", ("SK_ID_BUREAU", "MONTHS_BALANCE"),
        ("SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"), 3,
        references=(("SK_ID_BUREAU", "bureau", "SK_ID_BUREAU"),),
    ),
    SourceContract(
        "previous_application", "previous_application.csv", "earlier application", ("SK_ID_PREV",),
        ("SK_ID_CURR", "SK_ID_PREV", "NAME_CONTRACT_STATUS"), 30, references=(_APPLICATION,),
    ),
    SourceContract(
        "pos_cash_balance", "POS_CASH_balance.csv", "loan-month", ("SK_ID_PREV", "MONTHS_BALANCE"),
        ("SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE", "SK_DPD"), 8, references=(_APPLICATION, _EARLIER),
    ),
    SourceContract(
        "credit_card_balance", "credit_card_balance.csv", "card-month", ("SK_ID_PREV", "MONTHS_BALANCE"),
        ("SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE", "AMT_BALANCE"), 20,
        references=(_APPLICATION, _EARLIER),
    ),
    # Split payments repeat an instalment, so this table has no key.
    SourceContract(
        "installments_payments", "installments_payments.csv", "payment against a due instalment", (),
        ("SK_ID_CURR", "SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT",
         "AMT_INSTALMENT", "AMT_PAYMENT"), 8, references=(_APPLICATION, _EARLIER),
    ),
    SourceContract(
        "column_descriptions", "HomeCredit_columns_description.csv", "documented column", (),
        ("Table", "Row", "Description"), 4, mandatory=False, encoding="ISO-8859-1",
    ),
    SourceContract(
        "sample_submission", "sample_submission.csv", "unlabelled id placeholder", ("SK_ID_CURR",),
        ("SK_ID_CURR", "TARGET"), 2, mandatory=False,
    ),
)

HISTORY_TABLES = (
    "application_train", "application_test", "bureau", "bureau_balance", "previous_application",
    "pos_cash_balance", "credit_card_balance", "installments_payments",
)


def contract_for(name: str) -> SourceContract:
    """Contract by table name or, ignoring case, by file name."""
    for contract in CONTRACTS:
        if name == contract.table or name.casefold() == contract.file.casefold():
            return contract
    raise KeyError(f"no source contract for {name}")


def contracts_frame(spark: SparkSession, contracts: tuple[SourceContract, ...] = CONTRACTS) -> DataFrame:
    rows = [
        (c.table, c.file, c.grain, list(c.key), list(c.required), c.min_columns, c.mandatory)
        for c in contracts
    ]
    return spark.createDataFrame(
        rows,
        "table_name string, file_name string, grain string, primary_key array<string>, "
        "required_columns array<string>, min_columns int, mandatory boolean",
    )


# Read types.  Columns that are not listed are read as strings and kept out of the feature builds.
_LONG = {"SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV"}
_INT_PREFIX = ("DAYS_", "MONTHS_", "CNT_CREDIT", "CNT_DRAWINGS", "CREDIT_DAY", "SK_DPD", "NUM_INSTALMENT_NUMBER",
               "FLAG_", "TARGET", "CNT_CHILDREN", "HOUR_", "REGION_RATING", "REG_", "LIVE_")
_STRING_EXACT = {"FLAG_OWN_CAR", "FLAG_OWN_REALTY", "FLAG_LAST_APPL_PER_CONTRACT"}
_DOUBLE_PREFIX = ("AMT_", "RATE_", "EXT_SOURCE", "CNT_", "NUM_INSTALMENT_VERSION", "OWN_CAR_AGE")


def read_type(column: str) -> T.DataType:
    if column in _LONG:
        return T.LongType()
    if column in _STRING_EXACT:
        return T.StringType()
    # Some day columns of the published files carry a decimal point, so they are read as doubles
    # and narrowed by ``sources.tables``.
    if column.startswith(_INT_PREFIX) or column.startswith(_DOUBLE_PREFIX):
        return T.DoubleType()
    return T.StringType()


def narrows_to_int(column: str) -> bool:
    return column.startswith(_INT_PREFIX) and column not in _STRING_EXACT


def read_schema(header: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, read_type(name)) for name in header])
