"""Source tables kept in buckets of the key they are always grouped by.

History tables are bucketed and sorted by applicant, the accounts and their months by account.  A store build over them reads
its rows where they lie: grouping by applicant and joining accounts to their months need no exchange of source rows, only the
account rows that are already rolled up move once to their applicants.  The tables are written once and used by every build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKET_KEYS = {
    "bureau": "SK_ID_BUREAU", "bureau_balance": "SK_ID_BUREAU", "previous_application": "SK_ID_CURR", "pos_cash_balance": "SK_ID_CURR",
    "credit_card_balance": "SK_ID_CURR", "installments_payments": "SK_ID_CURR",
}


def write_layout(spark: SparkSession, tables: dict[str, DataFrame], database: str, folder: str, buckets: int) -> None:
    """Write every history table to ``folder`` as a bucketed table of ``database``; applications stay plain.

    ``buckets`` is at best a multiple of the cores of a cluster; a very large applicant makes a large bucket file, which one
    task reads, so its rows should be rolled up as they stream (all blocks do).
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in tables.items():
        key = BUCKET_KEYS.get(name)
        rows = df.repartition(buckets, key) if key else df  # one file a bucket
        writer = rows.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", f"{folder.rstrip('/')}/{name}")
        (writer.bucketBy(buckets, key).sortBy(key) if key else writer).saveAsTable(f"{database}.{name}")


def read_layout(spark: SparkSession, database: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.table(f"{database}.{name}") for name in names}
