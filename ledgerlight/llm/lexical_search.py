"""Ranked lexical search with Block-Max MaxScore.

*Index.*  Tasks turn their documents into segments of at most ``SEGMENT_DOCS`` rows.  A segment keeps its documents' ids and
lengths and, for every indexed term, a posting list in blocks of ``BLOCK`` documents, each compressed by itself.  Beside
each block stand the pairs (occurrences, document length) that no other document of the block beats in both; they bound
the block's score whatever the corpus statistics turn out to be, so the index is written in one pass over the texts.

*Search.*  In each segment, per item: every list has a bound, the greatest of its blocks.  Lists are ordered by bound, and those
whose bounds together stay below the tenth best score so far are non-essential: a document in none of the others
cannot enter.  The essential lists are read and added up; then the non-essential ones are visited from the greatest
bound down, and a candidate whose score so far, block bound and remaining list bounds together stay below the
tenth best is given up before its block is decompressed.  Each task keeps one heap per item and carries its tenth best score
from segment to segment; the heaps are merged by rank.

Items may have any number of terms in all: they are dealt into passes of about ``PASS_TERMS`` distinct terms, since what
a pass looks for is broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import ship_by_value, stage

ship_by_value(__name__)

SEGMENT_DOCS, SEGMENT_BYTES, BLOCK = 8_192, 32 << 20, 64
PASS_TERMS = 200_000  # distinct terms looked for in one pass over the texts: what is broadcast
TOP = 10
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


def _term_column(text: str) -> Column:
    """The same terms as a list, by column functions."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.expr(rf"regexp_extract_all(translate({text}, '{upper}', '{upper.lower()}'), "
                  r"'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)")


# ---------------------------------------------------------------- index


def skyline(block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the postings that no other of their block beats in both occurrences and shortness, one of equals."""
    order = np.lexsort((length, -tf, block))
    rank = length[order] - block[order] * (int(length.max(initial=0)) + 1)  # falls from block to block
    least = np.minimum.accumulate(rank)
    return order[np.r_[True, rank[1:] < least[:-1]]] if len(order) else order


def _segment(ids: list, lengths: list[int], postings: list[np.ndarray]) -> dict:
    """One index row from the documents' ids, term counts and (term, occurrences) tables."""
    doc = np.repeat(np.arange(len(postings)), [len(p) for p in postings])
    flat = np.concatenate(postings) if len(doc) else np.zeros((0, 2), dtype=np.int64)
    order = np.lexsort((doc, flat[:, 0]))
    doc, term, tf = doc[order], flat[order, 0], flat[order, 1]
    length = np.array(lengths, dtype=np.int64)
    terms, starts, counts = np.unique(term, return_index=True, return_counts=True)
    place = np.arange(len(term)) - np.repeat(starts, counts)
    opens = np.flatnonzero(place % BLOCK == 0)
    closes = np.r_[opens[1:], len(term)].astype(np.int64)[: len(opens)]
    block = np.repeat(np.arange(len(opens)), closes - opens)
    sky = skyline(block, tf, length[doc]) if len(term) else np.zeros(0, dtype=np.int64)
    blobs = [zlib.compress(np.stack([doc[a:b], tf[a:b]]).astype("<u4").tobytes(), 1)
             for a, b in zip(opens.tolist(), closes.tolist(), strict=True)]
    return {
        "doc_ids": ids, "lengths": lengths, "terms": terms, "counts": counts, "blocks": -(-counts // BLOCK),
        "lasts": doc[closes - 1], "sky_sizes": np.bincount(block[sky], minlength=len(opens)), "sky_tf": tf[sky], "sky_length": length[doc[sky]],
        "sizes": np.array([len(b) for b in blobs], dtype=np.int64), "postings": b"".join(blobs)}


_INDEX_SCHEMA = ("doc_ids array<long>, lengths array<long>, terms array<long>, counts array<long>, blocks array<long>, lasts array<long>,"
                 " sky_sizes array<long>, sky_tf array<long>, sky_length array<long>, sizes array<long>, postings binary")


def _indexer(shared):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: n for n, t in enumerate(shared.value)}
        find = number.get
        ids, lengths, postings, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            row = _segment(ids, lengths, postings)
            return pa.RecordBatch.from_arrays(
                [pa.array([row[c]], pa.binary() if c == "postings" else pa.list_(pa.int64())) for c in row], list(row))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue  # such a document counts nowhere and is never found
                known = [n for n in map(find, words) if n is not None]
                terms, tf = np.unique(np.array(known, dtype=np.int64), return_counts=True)
                ids.append(doc_id)
                lengths.append(len(words))
                postings.append(np.stack([terms, tf], axis=1))
                held += len(text)
                if len(ids) >= SEGMENT_DOCS or held >= SEGMENT_BYTES:
                    yield segment()
                    ids, lengths, postings, held = [], [], [], 0
        if ids:
            yield segment()

    return index


def build_index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Segments of all rows of ``docs`` with the posting lists of ``terms`` (named by their place in the list)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    return stage(docs.select("doc_id", "text").mapInArrow(_indexer(shared), _INDEX_SCHEMA), "lexical-index")


def statistics(index: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in them, and the document frequency of each indexed term."""
    docs, length = index.agg(
        F.coalesce(F.sum(F.size("lengths")), F.lit(0)),
        F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    found = np.zeros(terms, dtype=np.int64)  # as long as the broadcast list of terms
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("n"))
    for term, n in pairs.toLocalIterator():
        found[term] = n
    return int(docs), int(length), found


# ---------------------------------------------------------------- search


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What ``tf`` occurrences in a document of relative length ``m`` are worth, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Heap:
    """The best documents of one item: score falling, id rising, null ids last."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    @property
    def least(self) -> int:
        """A document below this score cannot enter; one that equals it may, by its id."""
        return self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, scores: np.ndarray, doc_ids: list) -> None:
        rows = self.rows + list(zip(scores.tolist(), doc_ids, strict=True))
        self.rows = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.top]


class Segment:
    """One index row, opened for reading."""

    def __init__(self, row, n_docs: int, total: int):
        self.doc_ids = row["doc_ids"]
        lengths = np.asarray(row["lengths"], dtype=np.int64)
        self.relative = 25 + (75 * lengths * n_docs) // total
        terms, blocks = np.asarray(row["terms"], dtype=np.int64), np.asarray(row["blocks"], dtype=np.int64)
        ends = np.cumsum(blocks)
        self.lists = {t: (a, b) for t, a, b in zip(terms.tolist(), (ends - blocks).tolist(), ends.tolist(), strict=True)}
        self.lasts = np.asarray(row["lasts"], dtype=np.int64)
        sky_sizes = np.asarray(row["sky_sizes"], dtype=np.int64)
        worth = saturation(np.asarray(row["sky_tf"], dtype=np.int64),
                           25 + (75 * np.asarray(row["sky_length"], dtype=np.int64) * n_docs) // total)
        self.block_bound = np.maximum.reduceat(worth, np.cumsum(sky_sizes) - sky_sizes) if len(worth) else worth
        self.ends = np.cumsum(np.asarray(row["sizes"], dtype=np.int64))
        self.starts = self.ends - np.asarray(row["sizes"], dtype=np.int64)
        self.postings = row["postings"]
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_bound(self, term: int) -> int:
        a, b = self.lists[term]
        return int(self.block_bound[a:b].max())

    def block(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and worths of one block; kept, since items share terms."""
        if n not in self.read:
            doc, tf = np.frombuffer(zlib.decompress(self.postings[self.starts[n]: self.ends[n]]), dtype="<u4").reshape(2, -1).astype(np.int64)
            self.read[n] = doc, saturation(tf, self.relative[doc])
        return self.read[n]

    def search(self, weights: dict[int, int], heap: Heap) -> None:
        """Put the segment's best documents for an item (its terms with weight times repeats) on the item's heap."""
        held = sorted((w * self.list_bound(t), t) for t, w in weights.items() if w and t in self.lists)
        if not held:
            return
        bounds, below = np.array([b for b, _ in held]), heap.least
        rest = np.cumsum(bounds)  # what the lists up to one can add together
        free = int(np.searchsorted(rest, below))  # so many lists are non-essential
        if free == len(held):
            return
        score = np.zeros(len(self.doc_ids), dtype=np.int64)
        for _, term in held[free:]:
            a, b = self.lists[term]
            for n in range(a, b):
                doc, worth = self.block(n)
                score[doc] += weights[term] * worth
        found = np.flatnonzero(score)
        for n in range(free - 1, -1, -1):
            term = held[n][1]
            a, b = self.lists[term]
            below = max(below, self._tenth(score[found], heap.top))
            found = found[score[found] + rest[n] >= below]
            home = a + np.searchsorted(self.lasts[a:b], found)
            inside = home < b
            bound = np.zeros(len(found), dtype=np.int64)
            bound[inside] = weights[term] * self.block_bound[home[inside]]
            stays = score[found] + bound + (rest[n - 1] if n else 0) >= below
            found, home = found[stays], home[stays & inside]
            wanted = np.zeros(len(score), dtype=bool)
            wanted[found] = True
            for number in np.unique(home).tolist():
                doc, worth = self.block(number)
                hit = wanted[doc]
                score[doc[hit]] += weights[term] * worth[hit]
        found = found[score[found] >= max(below, self._tenth(score[found], heap.top))]
        heap.add(score[found], [self.doc_ids[n] for n in found.tolist()])

    @staticmethod
    def _tenth(scores: np.ndarray, top: int) -> int:
        return int(np.partition(scores, len(scores) - top)[len(scores) - top]) if len(scores) >= top else 1


def _searcher(shared, n_docs: int, total: int, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        heaps = [Heap(top) for _ in items]
        for batch in batches:
            for n in range(batch.num_rows):
                segment = Segment({c: batch.column(c)[n].as_py() if c in ("doc_ids", "postings") else batch.column(c)[n].values.to_numpy()
                                   for c in batch.schema.names}, n_docs, total)
                for weights, heap in zip(items, heaps, strict=True):
                    segment.search(weights, heap)
        rows = [(n, doc_id, score) for n, heap in enumerate(heaps) for score, doc_id in heap.rows]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return search


def _one_pass(docs: DataFrame, items: list, top: int) -> DataFrame:
    """The best documents of items (rows of ``item_id, terms``) that fit a broadcast."""
    counted = [{} for _ in range(len(items))]
    number: dict[bytes, int] = {}
    for counts, item in zip(counted, items, strict=True):
        for term in item["terms"]:
            n = number.setdefault(term.encode("utf-8", "surrogatepass"), len(number))
            counts[n] = counts.get(n, 0) + 1
    index = build_index(docs, list(number))
    n_docs, total, df = statistics(index, len(number))
    spark = docs.sparkSession
    weights = [{t: k * term_weight(n_docs, int(df[t])) for t, k in counts.items() if df[t]} for counts in counted]
    shared = spark.sparkContext.broadcast(weights)
    best = index.mapInArrow(_searcher(shared, n_docs, max(total, 1), top), "item long, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(n, item["item_id"]) for n, item in enumerate(items)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of ``docs(doc_id, text)`` for each ``items(item_id, text)``.

    Every row of ``docs`` with a term is a document of its own, so repeated rows are ranked one after the other; null and
    empty texts count for nothing, and a null ``doc_id`` comes after all others of its score.  Equal rows of ``items`` are one
    item; different texts (or a null one) under one ``item_id`` are ranked apart under that id.  Items without terms or without
    a document above 0 have no rows.  Other columns are ignored, and empty tables give no rows.
    """
    wanted = items.select("item_id", "text").distinct().select("item_id", _term_column("text").alias("terms")).where(F.size("terms") > 0)
    wanted = stage(wanted, "search-items")
    n_terms = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    if not n_terms:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    passes = -(-n_terms // pass_terms)
    part = F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes))
    out = None
    for n in range(passes):  # each brings about pass_terms terms to the driver
        result = _one_pass(docs, wanted.where(part == n).collect(), top)
        out = result if out is None else out.unionByName(result)
    return out
