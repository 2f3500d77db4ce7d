"""Source manifest: size, digest, physical rows, header and contract outcome of every file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import CONTRACTS, SourceContract
from ..session import cut_lineage

CHUNK = 4 * 1024 * 1024


def path_facts(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """``path, length, sha256, row_count, header`` of listed files, one file at a time in a task.

    A file is read once: its digest, its lines minus the header and its first line (NULL for an empty file) come from the
    same pass, and no more of it is held than a chunk.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """SHA-256 and lines of each listed file, streamed in chunks so that a file of any size fits."""
        from pyarrow import fs

        for batch in batches:
            digests, rows, headers = [], [], []
            for path in batch["path"]:
                system, inner = fs.FileSystem.from_uri(path)
                state, ends, last, head, open_head = hashlib.sha256(), 0, b"\n", [], True
                with system.open_input_stream(inner) as stream:
                    while chunk := stream.read(CHUNK):
                        state.update(chunk)
                        ends, last = ends + chunk.count(b"\n"), chunk[-1:]
                        if open_head:
                            first, end, _ = chunk.partition(b"\n")
                            head.append(first)
                            open_head = not end
                digests.append(state.hexdigest())
                rows.append(max(ends + (last != b"\n") - 1, 0))
                headers.append(b"".join(head).decode("utf-8", "replace") if head else None)
            yield batch.assign(sha256=digests, row_count=rows, header=headers)

    spread = listing.repartition(spark.sparkContext.defaultParallelism, "path")
    return spread.mapInPandas(read, "path string, length bigint, sha256 string, row_count long, header string")


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """Name, bytes and SHA-256 of the files a pattern matches."""
    listing = spark.read.format("binaryFile").load(pattern).select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length")
    return path_facts(spark, listing).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes"), "sha256")


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, file_name, length`` of the files of a delivery; a folder of parts counts as the file of its name."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length")
    inside = F.regexp_extract("path", r"([^/]+\.csv)(/[^/]+)?$", 1)
    return listing.withColumn("file_name", inside).where("file_name <> ''")


def build_manifest(spark: SparkSession, folder: str, contracts: Iterable[SourceContract] = CONTRACTS) -> DataFrame:
    """One row per contracted file: size, digest, rows, header and whether the contract is met.

    ``sha256`` of a folder of parts is the digest of its parts' digests in order of their names.
    """
    files = listed_files(spark, folder)
    shape = "file_name string, bytes long, row_count long, columns array<string>"
    if files.isEmpty():
        found, digests = spark.createDataFrame([], shape), spark.createDataFrame([], "file_name string, sha256 string")
    else:
        header = F.transform(F.split(F.regexp_replace("header", "^\ufeff|\r$", ""), ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
        read = cut_lineage(files.select("path", "file_name").join(path_facts(spark, files.select("path", "length")), "path"))
        found = read.groupBy("file_name").agg(
            F.sum("length").alias("bytes"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
            F.min_by(header, "path").alias("columns"))
        parts = read.groupBy("file_name").agg(
            F.sort_array(F.collect_list(F.struct("path", "sha256"))).alias("d"))  # the parts of one delivered table
        digests = parts.select("file_name", F.when(F.size("d") == 1, F.col("d")[0]["sha256"]).otherwise(
            F.sha2(F.array_join(F.transform("d", lambda x: x["sha256"]), ""), 256)).alias("sha256"))
    table = spark.createDataFrame([(
        c.file, c.table, c.mandatory, c.grain, c.min_columns, list(c.key), list(c.required)) for c in contracts],
        "file_name string, table_name string, required boolean, grain string, minimum_column_count int, "
        "primary_key array<string>, _needed array<string>")
    present = F.col("bytes").isNotNull()
    missing = F.when(present, F.array_sort(F.array_except("_needed", F.coalesce("columns", F.array().cast("array<string>")))))
    return table.join(found, "file_name", "left").join(digests, "file_name", "left").withColumns({
        "status": F.when(present, "present").otherwise("missing"), "column_count": F.when(present, F.size("columns")),
        "missing_required_columns": missing}).withColumn("schema_valid", F.when(
            present, (F.size("missing_required_columns") == 0) & (F.col("column_count") >= F.col("minimum_column_count")))).drop("_needed")


def manifest_summary(manifest: DataFrame) -> DataFrame:
    missing = F.col("required") & (F.col("status") == "missing")
    invalid = (F.col("status") == "present") & ~F.col("schema_valid")
    return manifest.agg(
        F.count(F.lit(1)).alias("expected_files"),
        F.count_if(F.col("status") == "present").alias("present_files"),
        F.count_if(missing).alias("missing_required_files"),
        F.count_if(invalid).alias("invalid_schema_files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
    ).withColumn("ready_for_profiling",
                 (F.col("missing_required_files") == 0) & (F.col("invalid_schema_files") == 0))
