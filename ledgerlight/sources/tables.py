"""Readers and sinks for the raw tables, feature stores and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import HISTORY_TABLES, contract_for, narrows_to_int, read_type
from .snapshots import Snapshots, restrict

_BROKEN = "_broken_record"


def header_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of a CSV file; only its first line is read."""
    reader = spark.read.option("encoding", encoding).option("header", True)
    names = reader.option("inferSchema", False).csv(path).columns
    return [name.lstrip("\ufeff") for name in names]


@dataclass(frozen=True)
class CheckedTable:
    """A raw table read cell by cell: the rows whose cells are all sound, and the faults of the others."""

    rows: DataFrame
    faults: DataFrame  # key columns as text, column, cell, kind


def check_csv_table(spark: SparkSession, folder: str, table: str) -> CheckedTable:
    """One raw CSV table with an explicit schema; nothing is turned into NULL but an empty cell.

    Fault kinds: ``malformed_record`` (more or fewer fields than the header; ``cell`` is the line), ``not_a_number``,
    ``not_finite`` and ``not_whole``.  A record with any fault is not among the rows.
    """
    contract = contract_for(table)
    path = f"{folder.rstrip('/')}/{contract.file}"
    header = header_of(spark, path, contract.encoding)
    types = {n: read_type(n) for n in header}
    text = ", ".join(f"`{n}` string" for n in header)
    raw = (
        spark.read.option("header", True).option("encoding", contract.encoding).option("mode", "PERMISSIVE")
        .option("columnPruning", False)  # a pruned parser does not see that a record has too many fields
        .option("columnNameOfCorruptRecord", _BROKEN).schema(f"{text}, `{_BROKEN}` string").csv(path)
    )
    checks = []
    for name, kind in types.items():
        if isinstance(kind, T.StringType):
            continue
        cell, number = F.trim(name), F.trim(name).try_cast("double")
        fault = F.when(F.coalesce(cell, F.lit("")) == "", None).when(number.isNull(), "not_a_number").when(
            F.isnan(number) | (F.abs(number) == float("inf")), "not_finite")
        if isinstance(kind, T.LongType) or narrows_to_int(name):
            fault = fault.when(number != F.floor(number), "not_whole")
        checks.append(F.when(fault.isNotNull(), F.struct(F.lit(name).alias("column"), F.col(name).alias("cell"), fault.alias("kind"))))
    broken = F.struct(F.lit(None).cast("string").alias("column"), F.col(_BROKEN).alias("cell"), F.lit("malformed_record").alias("kind"))
    found = F.when(F.col(_BROKEN).isNotNull(), F.array(broken)).otherwise(F.array_compact(F.array(*checks)))
    judged = raw.withColumn("_faults", found)

    def typed(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.col(name)
        cell = F.nullif(F.trim(name), F.lit(""))
        if isinstance(kind, T.LongType):
            return F.coalesce(cell.try_cast("long"), cell.try_cast("double").cast("long")).alias(name)
        return cell.try_cast("double").cast("int" if narrows_to_int(name) else "double").alias(name)

    rows = judged.where(F.size("_faults") == 0).select(*[typed(n, k) for n, k in types.items()])
    keys = [F.col(k) for k in contract.key if k in types]
    faults = judged.where(F.size("_faults") > 0).select(*keys, F.explode("_faults").alias("_f")).select(*keys, "_f.*")
    return CheckedTable(rows, faults)


def read_csv_table(spark: SparkSession, folder: str, table: str, most_faults: int = 0) -> DataFrame:
    """The sound rows of a raw CSV table; more than ``most_faults`` broken cells or records are an error."""
    checked = check_csv_table(spark, folder, table)
    found = checked.faults.groupBy("kind", "column").count().orderBy("kind", "column").collect()  # a few per column
    if sum(r["count"] for r in found) > most_faults:
        named = ", ".join(f"{r['kind']} in {r['column'] or 'the record'}: {r['count']}" for r in found)
        raise ValueError(f"{table} has broken cells ({named})")
    return checked.rows


def read_history_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_csv_table(spark, folder, name) for name in HISTORY_TABLES}


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Column documentation (single-byte encoding): rows without a name or text are left out."""
    docs = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return docs.dropna(subset=["Row", "Description"]).dropDuplicates(["Row"]).select("Row", "Description")


def read_store(spark: SparkSession, path: str, ids: DataFrame | None = None, one_id: int | None = None) -> DataFrame:
    """The current version of a feature store, whole, for one id or for a set of ids; both reach the Parquet scan."""
    store = Snapshots(spark, path).read()
    if one_id is not None:
        store = store.where(F.col("SK_ID_CURR") == F.lit(one_id))
    if ids is not None:
        store = restrict(store, "SK_ID_CURR", ids.select("SK_ID_CURR"))
    return store


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
