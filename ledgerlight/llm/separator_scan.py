"""Token counts of documents in flat, unindexed token files, by a blocked separator scan.

A token file is nothing but little-endian 16-bit ids; every document ends with the end-of-document id.  Files are read
in blocks of a fixed number of tokens, wherever documents begin or end; each block is searched at once for the
separator.  A document that crosses blocks is stitched by a prefix scan over the blocks of its file: the number of
separators before the block and the place of the last one.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import new_path, ship_by_value, stage
from .tokens import default_vocabulary, encode

ship_by_value(__name__)

SEPARATOR, ID_BYTES, BLOCK_TOKENS = 50_256, 2, 1 << 20


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Write one token file per task to ``folder`` (any URI that tasks reach); ``file, ordinal, doc_id`` of each document.

    A repeated task writes another file; only the files named in the result count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, written = vocabulary or default_vocabulary(), None, 0
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.bin"
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(posixpath.join(root, name))
                for text in batch.column("text").to_pylist():
                    ids = encode(text, path, added_as_text=True)
                    out.write(np.append(ids, np.uint32(SEPARATOR)).astype("<u2").tobytes())
                ordinal = np.arange(written, written + batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{name}"] * len(ordinal)), pa.array(ordinal), batch.column("doc_id")],
                    ["file", "ordinal", "doc_id"])
                written += batch.num_rows
        finally:
            if out is not None:
                out.close()

    return stage(docs.select("doc_id", "text").mapInArrow(write, "file string, ordinal long, doc_id long"), "token-index")


def _blocks(block_tokens: int):
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["file"]:
                store, path = fs.FileSystem.from_uri(uri)
                tokens = store.get_file_info(path).size // ID_BYTES
                start = np.arange(0, tokens, block_tokens)
                yield pd.DataFrame({"file": uri, "block": np.arange(len(start)), "start": start,
                                    "count": np.minimum(block_tokens, tokens - start)})

    return blocks


def _search(separator: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, block, start, count in batch.itertuples(index=False):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(int(count) * ID_BYTES, int(start) * ID_BYTES), dtype="<u2")
                yield pd.DataFrame({"file": [uri], "block": [block], "count": [count],
                                    "ends": [np.flatnonzero(ids == separator) + int(start)]})

    return search


def scan_token_files(files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, ordinal, start, n_tokens, closed`` of every document in the files named in ``files(file)``.

    ``n_tokens`` leaves the separator out.  Tokens after the last separator of a file are one more document with
    ``closed`` false.  Empty documents count zero tokens; an empty file has no documents; a last odd byte is ignored.
    """
    named = files.where("file IS NOT NULL").select("file").distinct()
    dealt = named.mapInPandas(_blocks(block_tokens), "file string, block long, start long, count long").repartition("file", "block")
    found = stage(dealt.mapInPandas(_search(separator), "file string, block long, count long, ends array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("file", "block", F.size("ends").alias("n"), F.element_at(
        F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    carry = sums.select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("opened"))
    closed = found.join(carry, ["file", "block"]).select(
        "file", "earlier", "opened", "ends", F.posexplode("ends").alias("k", "end")).select(
        "file", (F.col("earlier") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("opened")).otherwise(F.get("ends", F.col("k") - 1) + 1).alias("start"), "end")
    closed = closed.select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = found.groupBy("file").agg(
        F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.array_max("ends")) + 1, F.lit(0)).alias("start"),
        F.sum("count").alias("count"))
    rest = whole.where(F.col("count") > F.col("start")).select(
        "file", "ordinal", "start", (F.col("count") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def document_token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs(doc_id, text, ...)``, read back from token files in the shared folder.

    Null and empty texts have no tokens; repeated rows are documents of their own; an empty table gives no rows.
    """
    index = write_token_files(docs, new_path(docs.sparkSession, "tokens"), vocabulary)
    counts = scan_token_files(index)
    return index.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
