"""Tables with versions: data folders that never change, and a log of commits that names the current one.

A write goes to a folder of its own, the gate reads what was written, and only then one small file is added to the log.
Readers take the newest commit, so they see the old version or the new one and never a half-written or missing table, and a
failed gate or a lost job leaves nothing but a folder that no commit names.  Two writers that take the same number are told
apart by their ids: the smaller one has it, the other is refused.  Everything goes through Spark's readers and writers.

Data is sorted by the key across files, and Parquet keeps a bloom filter of it, so a lookup opens the row groups
that can hold its keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "version long, writer string, folder string, rows long"
LITERAL_IDS = 1_000  # ids that are written into the filter itself
BROADCAST_IDS = 1_000_000  # ids that are sent to every task; more are joined


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Snapshots:
    spark: SparkSession
    path: str

    @property
    def _root(self) -> str:
        return self.path.rstrip("/")

    def history(self) -> DataFrame:
        """One row per version: the commit that has its number."""
        try:
            log = self.spark.read.schema(_COMMIT).json(f"{self._root}/commits")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            log = self.spark.createDataFrame([], _COMMIT)
        return log.groupBy("version").agg(F.min_by(F.struct("writer", "folder", "rows"), "writer").alias("c")).select("version", "c.*")

    def current(self) -> int:
        """Number of the newest version; 0 before the first."""
        return self.history().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def commit(self, df: DataFrame, key: str, gate: Callable[[DataFrame], None] | None = None) -> int:
        """Write, check and publish a version; returns its number.  ``gate`` raises to refuse what was written."""
        writer, expected = uuid.uuid4().hex, self.current() + 1
        folder = f"{self._root}/data/{writer}"
        df.repartitionByRange(key).sortWithinPartitions(key).write.option("compression", "zstd").option(
            f"parquet.bloom.filter.enabled#{key}", "true").parquet(folder)
        written = self.spark.read.schema(df.schema).parquet(folder)
        if gate is not None:
            gate(written)
        entry = self.spark.createDataFrame([(expected, writer, folder, written.count())], _COMMIT)
        entry.coalesce(1).write.mode("append").json(f"{self._root}/commits")
        winner = self.history().where(F.col("version") == expected).first()
        if winner.writer != writer:
            raise CommitConflict(f"version {expected} of {self._root} was committed by another writer")
        return expected

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or the one of that number."""
        number = self.current() if version is None else version
        entry = self.history().where(F.col("version") == number).first()
        if entry is None:
            raise FileNotFoundError(f"{self._root} has no version {number}" if number else f"{self._root} holds no committed table")
        return self.spark.read.parquet(entry.folder)


def restrict(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of a key-sorted table whose key is among ``ids``.

    A few ids go into the filter that the scan evaluates on its row groups.  For more, the scan gets their range, and the
    rows are joined to the distinct ids: broadcast up to a checked number, beyond it by key.
    """
    distinct = ids.select(F.col(ids.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    few = distinct.limit(LITERAL_IDS + 1).collect()
    if len(few) <= LITERAL_IDS:
        return table.where(F.col(key).isin([r[0] for r in few]))
    low, high, size = distinct.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    inside = table.where(F.col(key).between(low, high))
    return inside.join(F.broadcast(distinct) if size <= BROADCAST_IDS else distinct, key, "left_semi")
