"""SimHash near-duplicates through pivot distance tables.

A fingerprint is the bitwise majority of the XXH64 hashes of a document's word shingles.  For every distinct
fingerprint the Hamming distances to 65 reference fingerprints are computed once: zero, and 16 half-set patterns
in each of four 16-bit segments.  Two facts about fingerprints ``x, y`` that differ in at most ``limit`` bits drive
the search:

* no distance to a reference differs by more than ``limit`` (the triangle inequality), and
* bits outside a segment change the distance to zero and to that segment's references alike, so the differences
  ``d(x, reference) - d(x, 0)`` of an untouched segment are *equal*; two differing bits leave two of four
  segments untouched.

Fingerprints with equal differences in two segments share a bucket (six buckets each).  Inside the cells of a bucket,
pairs whose largest coordinate difference exceeds the limit are discarded, and the survivors' bits are compared.
A cell gives a spanning forest, never its pairs.  The result is exact: no cap, no probability.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import cell_pairs, forest, into_cells, whole_cells
from .graph import components
from .staging import lean, ship_by_value, stage

ship_by_value(__name__)

SHINGLE_WORDS, SEED, LIMIT = 3, 42, 2
SEGMENTS, SEGMENT_BITS, PER_SEGMENT = 4, 16, 16


def references() -> np.ndarray:
    """The reference fingerprints: zero first, then the segments' patterns, each with half of its segment set."""
    draw = np.random.default_rng(20_24)
    out = [0]
    for segment in range(SEGMENTS):
        for _ in range(PER_SEGMENT):
            bits = draw.permutation(SEGMENT_BITS)[: SEGMENT_BITS // 2]
            out.append(sum(1 << (segment * SEGMENT_BITS + int(b)) for b in bits))
    return np.array(out, dtype=np.uint64)


def document_fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of a whole text; no words (or null) gives zero."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) < words:
        hashes = np.array([digest(line, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths)[: len(tokens) - words + 1].tolist(), ends[words - 1:].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at: at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([document_fingerprint(x) for x in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "mark"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, mark`` (the fingerprint's bits as a signed long) of every row."""
    return docs.select("doc_id", "text").mapInArrow(lean(_fingerprints), "doc_id long, mark long")


def _pivot_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pivots = references()
    mix = np.random.default_rng(7).integers(1, 1 << 62, size=(SEGMENTS, PER_SEGMENT), dtype=np.int64).astype(np.uint64) * 2 + 1
    pairs = list(itertools.combinations(range(SEGMENTS), 2))
    for batch in batches:
        marks = batch["mark"].to_numpy(dtype=np.int64).view(np.uint64)
        table = np.bitwise_count(marks[:, None] ^ pivots[None, :])
        profile = (table[:, 1:].astype(np.int64) - table[:, :1]).astype(np.uint64).reshape(-1, SEGMENTS, PER_SEGMENT)
        keys = (profile * mix).sum(axis=2, dtype=np.uint64)
        out = []
        for n, (s, t) in enumerate(pairs):
            bucket = (keys[:, s] * np.uint64(0x9E3779B97F4A7C15) ^ (keys[:, t] + np.uint64(n))) * np.uint64(0xD6E8FEB86659FD93)
            out.append(pd.DataFrame({"mark": marks.view(np.int64), "bucket": bucket.view(np.int64)}))
        rows = pd.concat(out, ignore_index=True)
        rows["distances"] = [r.tobytes() for r in table] * len(pairs)
        yield rows


def pivot_table(marks: DataFrame) -> DataFrame:
    """``mark, bucket, distances``: six rows for each distinct fingerprint; ``distances`` has one byte a reference."""
    return marks.select("mark").mapInPandas(lean(_pivot_rows), "mark long, bucket long, distances binary")


def _near_in_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    width = 1 + SEGMENTS * PER_SEGMENT
    for table, starts in whole_cells(batches):
        marks = table["mark"].to_numpy(dtype=np.int64)
        bits = marks.view(np.uint64)
        distances = np.frombuffer(b"".join(table["distances"]), dtype=np.uint8).reshape(-1, width).astype(np.int8)
        part, lo, hi = (table[c].to_numpy() for c in ("part", "lo", "hi"))
        found_a, found_b = [], []
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            left, right = cell_pairs(part[start:end], lo[start], hi[start])
            for at in range(0, len(left), 64):
                a, b = left[at: at + 64] + start, right + start
                near = np.ones((len(a), len(b)), dtype=bool) if lo[start] != hi[start] else a[:, None] < b[None, :]
                x, y = np.nonzero(near)
                for column in range(0, width, 13):  # most pairs fall at the first references
                    if not len(x):
                        break
                    d = distances[:, column: column + 13]
                    keep = np.abs(d[a[x]] - d[b[y]]).max(axis=1) <= LIMIT
                    x, y = x[keep], y[keep]
                keep = np.bitwise_count(bits[a[x]] ^ bits[b[y]]) <= LIMIT
                found_a.append(a[x[keep]])
                found_b.append(b[y[keep]])
        a, b = forest(len(table), np.concatenate(found_a), np.concatenate(found_b))
        yield pd.DataFrame({"a": marks[a], "b": marks[b]})


def near_links(marks: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints, with the components of all pairs within the limit."""
    cells = into_cells(pivot_table(marks), "bucket", "mark")
    return cells.mapInPandas(lean(_near_in_cells), "a long, b long").distinct()


def _named(marks: DataFrame) -> DataFrame:
    """``mark, least, root, component_id`` of every distinct fingerprint: its smallest id, its component and that one's name."""
    classes = stage(marks.groupBy("mark").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(near_links(classes), "a", "b")
    grouped = classes.join(roots, classes["mark"] == roots["node"], "left").select(
        "mark", "least", F.coalesce("root", "mark").alias("root"))
    return grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows get equal results; a null
    ``doc_id`` takes part but never names a component.  Other columns are ignored.  An empty table gives no rows.
    """
    marks = stage(fingerprints(docs), "simhash")
    named = _named(marks).select("mark", "component_id")
    return marks.join(named, "mark").select(
        "doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def _with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for marked in _fingerprints(iter([batch])):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), marked.column("mark")], ["doc_id", "row", "mark"])


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: the smallest ``doc_id`` of each component stays, one row of it.

    Rows are judged by id and fingerprint, so an id with different texts keeps those that lead their components.  Of
    rows with the same id and fingerprint the smallest text stays.  Rows without ``doc_id`` stay: no decision can name them.
    """
    marks = stage(fingerprints(docs), "simhash")
    lead = F.min(F.struct("least", "mark")).alias("lead")
    stay = stage(_named(marks).where("least IS NOT NULL").groupBy("root").agg(lead).select(
        F.col("lead.least").alias("doc_id"), F.col("lead.mark").alias("mark")), "simhash-leads")
    ids = marks.where("doc_id IS NOT NULL").groupBy("doc_id").count()
    dropped = ids.join(stay, "doc_id", "left_anti").select("doc_id")
    # the ids are hashed, so the texts move once and are not sorted
    kept = docs.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    if ids.where("count > 1").isEmpty():
        return kept
    rows = kept.where("doc_id IS NOT NULL").select("doc_id", "text", F.struct(*[kept[c] for c in docs.columns]).alias("row"))
    marked = rows.mapInArrow(lean(_with_marks), f"doc_id long, row {rows.schema['row'].dataType.simpleString()}, mark long")
    led = marked.join(stay, ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(
        F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return led.select("row.*").unionByName(kept.where("doc_id IS NULL"))
