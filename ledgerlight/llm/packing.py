"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

Documents longer than a sequence are cut into whole sequences and one shorter piece, which comes first.  Shorter pieces
are dealt by hash into groups of a bounded number, and each group is packed in one task, longest piece first: a piece
goes to the open sequence whose choice leaves the smallest sum of squared counts of open sequences per residual
gap; a new sequence is opened only if none has room.  A group wastes a few sequences whatever its size, so
large groups (100,000 pieces, a few megabytes of lengths) waste a few in ten thousand.

Where an order of the documents is given, the groups are consecutive runs of it instead, and sequences are numbered
by run, inside a run by the place of their longest piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import ship_by_value, stage
from .tokens import default_vocabulary, encode

ship_by_value(__name__)

SEQUENCE, END_ID = 1024, 2
GROUP_PIECES = 100_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(length: int, sequence: int = SEQUENCE) -> list[int]:
    """Starts of a document's pieces: only the first may be shorter than a sequence."""
    first = length % sequence
    return ([0] if first else []) + list(range(first, length, sequence))


def pieces(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of every row of ``docs``; ``with_ids`` adds the token ids (array of int)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or default_vocabulary()
        for batch in batches:
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text, path), np.uint32(END_ID)).astype("<u4")
                at = cut_points(len(ids))
                for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
                    row.append(n)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        parts.append(ids[a:b].astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc)]
            columns += [pa.array(parts, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, _PIECE + ", ids array<int>" * with_ids)


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items come longest first and are at most ``size`` long.

    Putting an item of length ``x`` into an open bin with gap ``g`` changes the sum of squares by
    ``2 (N[g - x] - N[g]) + 2``, or by ``1 - 2 N[x]`` where it fills the bin.
    """
    counts = np.zeros(size + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, opened = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    never = np.int64(1) << 40
    for item, x in enumerate(lengths.tolist()):
        gaps = counts[x: size + 1]
        change = 2 * (counts[: size + 1 - x] - gaps) + 2
        change[0] = 1 - 2 * gaps[0]
        change[gaps == 0] = never
        left = int(np.argmin(change))
        if change[left] == never:
            bins[item], offsets[item], left = opened, 0, size - x
            opened += 1
        else:
            gap = x + left
            bins[item], offsets[item] = open_bins[gap].pop(), size - gap
            counts[gap] -= 1
        if left:
            open_bins[left].append(int(bins[item]))
            counts[left] += 1
    return bins, offsets


def _packed(table: pa.Table) -> pa.Table:
    order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
    table = table.sort_by(order)
    bins, offsets = sum_of_squares(table.column("length").to_numpy())
    bunch = table.column("bunch").to_numpy().astype(np.int64)
    return table.drop_columns(["bunch"]).append_column(
        "sequence_id", pa.array((bunch << 32) + bins)).append_column("offset", pa.array(offsets))


def pack(cut: DataFrame, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``cut`` (as from :func:`pieces`) with ``sequence_id`` and ``offset``.

    Pieces as long as a sequence are sequences of their own, with negative ids.
    """
    short = cut.where(F.col("length") < SEQUENCE)
    bunches = max(1, -(-short.count() // group_pieces))
    row = F.monotonically_increasing_id()  # copies of one row, or rows without id, share no group for that
    bunch = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", row), F.lit(bunches)).cast("int")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    packed = short.withColumn("bunch", bunch).groupBy("bunch").applyInArrow(
        _packed, f"{schema}, sequence_id long, offset long")
    whole = cut.where(F.col("length") >= SEQUENCE).withColumns({
        "sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole)


def _packed_run(table: pa.Table) -> pa.Table:
    order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
    table = table.sort_by(order)
    lengths, position = table.column("length").to_numpy(), table.column("position").to_numpy()
    whole = int(np.count_nonzero(lengths == SEQUENCE))  # the first rows
    bins, offsets = sum_of_squares(lengths[whole:])
    bins, offsets = np.r_[np.arange(whole), bins + whole], np.r_[np.zeros(whole, dtype=np.int64), offsets]
    _, first = np.unique(bins, return_index=True)  # a bin's longest piece opened it
    number = np.empty(len(first), dtype=np.int64)
    number[np.argsort(position[first])] = np.arange(len(first))
    run = table.column("run").to_numpy()
    return table.drop_columns(["run", "position"]).append_column(
        "sequence_id", pa.array((run << 32) + number[bins])).append_column("offset", pa.array(offsets))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``position`` by ``slot, place`` in place of these; counts are added up over two levels of slots."""
    fine = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).withColumn("coarse", F.expr("slot div 4096"))
    coarse = fine.groupBy("coarse").agg(F.sum("n").alias("n"))

    def before(*partition: str, order: str):
        span = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(span), F.lit(0))

    coarse = coarse.select("coarse", before(order="coarse").alias("coarse_before"))  # one row per 4,096 slots
    fine = fine.withColumn("fine_before", before("coarse", order="slot")).join(coarse, "coarse").select(
        "slot", (F.col("fine_before") + F.col("coarse_before")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("slot").orderBy("place", "doc_id", "piece", "ids_crc32")) - 1
    return rows.withColumn("inside", inside).join(fine.hint("merge"), "slot").select(
        *[c for c in rows.columns if c not in ("slot", "place")], (F.col("before") + F.col("inside")).alias("position"))


def pack_in_order(docs: DataFrame, order: DataFrame, vocabulary: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """As :func:`pack_documents`, in the order ``doc_id, slot, place`` (one row an id): a run of at most ``group_pieces``
    consecutive pieces, long and short, shares no sequence with another run, and ``sequence_id`` rises with the runs.

    Documents that ``order`` lacks, those without id among them, come behind the others as :func:`pack` deals them.
    """
    cut = stage(pieces(docs, vocabulary), "pieces")
    ranked = stage(cut.join(order.hint("merge"), "doc_id", "left"), "ranked-pieces")  # read by every job below
    placed = stage(_ranked(ranked.where("slot IS NOT NULL")).withColumn("run", F.floor(F.col("position") / group_pieces)), "runs")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    packed = placed.groupBy("run").applyInArrow(_packed_run, f"{schema}, sequence_id long, offset long")
    runs = placed.agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]
    rest = pack(ranked.where("slot IS NULL").drop("slot", "place"), group_pieces)
    return packed.unionByName(rest.withColumn("sequence_id", F.expr(
        f"IF(sequence_id < 0, {(runs + (1 << 20)) << 32}L - sequence_id, sequence_id + {runs << 32}L)")))


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of ``docs(doc_id, text, ...)``.

    Null and empty texts give one piece with the end id alone.  Repeated rows are packed as often as they come; a
    null ``doc_id`` stays null; other columns are ignored; an empty table gives no rows.
    """
    return pack(stage(pieces(docs, vocabulary), "pieces"))


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of a packed table that carries ``ids``: at most ``SEQUENCE`` tokens a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
