"""Session helpers: defaults for a standalone run and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def build_session(app_name: str = "ledgerlight", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; cluster settings given by the caller win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # call sites cost more than building a wide plan
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_folder(spark: SparkSession) -> str:
    """Shared folder for tables between jobs: the one the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is used, and only on a ``local`` master (unit tests, a laptop).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="ledgerlight-stage-")
    return f"file://{_LOCAL[context.applicationId]}"


def write_stage(df: DataFrame) -> str:
    """Write ``df`` to a new folder of the stage folder."""
    path = f"{stage_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder: a lost executor loses none of it, and columns are still pruned."""
    return df.sparkSession.read.schema(df.schema).parquet(write_stage(df))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores, in a number of partitions that adaptive execution leaves as it is.

    For narrow tables of which much is computed per row: a small Parquet file is one task otherwise.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
