"""Tables handed from one job to the next, and Python functions shipped to the tasks.

Staged tables are Parquet in the shared folder that the cluster names in ``spark.checkpoint.dir``, so a lost
executor loses none of them, and later jobs keep column pruning.  Where the setting is missing, a temporary
folder is used, and only on a ``local`` master (tests, a laptop).
"""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; see the module text for a session without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="ledgerlight-stage-")
    return f"file://{_LOCAL[context.applicationId]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and return it as a table that later jobs read."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_by_value(module: str) -> None:
    """Pickle the functions of ``module`` whole, so that tasks need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_by_value(__name__)


def release() -> None:
    """Give freed memory back to the machine: Spark uses Python workers again, for other jobs too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over a partition, with what it freed released at the end."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release()

    return run
