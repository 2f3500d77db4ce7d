"""Source divergence audit: how far the word use of each source lies from that of its peers and its language.

Every group ``(lang, source)`` gives each kept term of its language a smoothed share ``p``; two groups differ by the sum of
``floor((p - q)^2 / (p + q))`` over all kept terms.  Shares are whole numbers and all arithmetic is exact.

The pair sums are rows of a sparse product, made one row at a time after Gustavson: a group takes its own terms, looks each
of them up in the *term-major index* (term -> the groups that use it, with counts) and adds what the two counts give to a dense
accumulator with one place per peer.  No pair of postings becomes a row.  Terms that one or both groups lack do not meet there
although they count: with ``p0`` the share of an unused term, the sum over all ``V`` kept terms is

    V * f(p0, q0) + sum over g's terms of [f(p, q0) - f(p0, q0)] + sum over h's terms of [f(p0, q) - f(p0, q0)]
      + sum over shared terms of [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

The last sum is what the accumulators hold.  In the others a share depends on the count alone, so they run over each group's
histogram of counts.  The index is cut into slices of terms, and the rows of a large language into blocks, so a task holds
``ROW_BLOCK`` times ``PEER_BLOCK`` places at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import ship_by_value, stage

ship_by_value(__name__)

LEAST_DOCS, TOP_TERMS = 10, 10
HELD_TERMS = 200_000  # terms a task counts before it hands its counts on
SLICE_POSTINGS, ROW_BLOCK, PEER_BLOCK = 1 << 20, 512, 2_048
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII; only A-Z are lower-cased."""
    return (text or b"").translate(_LETTERS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def counts() -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, docs) in held.items():
            terms = list(uses)
            for at in range(0, len(terms), 50_000):
                part = terms[at: at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array([uses[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                    ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            words = terms_of(text)
            uses, docs = held.setdefault((lang, source), (Counter(), Counter()))
            uses.update(words)
            docs.update(set(words))
        if sum(len(u) for u, _ in held.values()) > HELD_TERMS:
            yield from counts()
    yield from counts()


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 * count / total)`` for ``count <= total``, three digits at a time so that nothing overflows."""
    out = np.zeros_like(count)
    for _ in range(3):
        count = count * 1000
        out = out * 1000 + count // total
        count = count % total
    return out + 1


def share_column(count: Column, total: Column) -> Column:
    """The same as a column expression."""
    digits = F.lit(0).cast("long")
    for _ in range(3):
        count = count * F.lit(1000)
        quotient = F.call_function("div", count, total)
        digits, count = digits * F.lit(1000) + quotient, F.pmod(count, total)
    return digits + F.lit(1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def accumulate(terms: list[np.ndarray], counts: list[np.ndarray], rows: range, peers: range, totals: np.ndarray) -> np.ndarray:
    """Corrected sums over shared terms, for a slice of the index and a block of rows against a block of peers.

    ``terms[t]`` are the places of the groups that use term ``t`` and ``counts[t]`` their counts; ``totals`` are the groups'
    denominators.  The slice is turned once to row-major for the rows; each row then scatters through the lists.
    """
    sizes = np.array([len(t) for t in terms], dtype=np.int64)
    group, count = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.int64)
    term = np.repeat(np.arange(len(terms)), sizes)
    used, unused = share(count + 2, totals[group]), share(np.full(len(totals), 2, dtype=np.int64), totals)
    peer = (group >= peers.start) & (group < peers.stop)  # the lists, without groups of other blocks
    p_group, p_term, p_used = group[peer], term[peer], used[peer]
    ends = np.cumsum(np.bincount(p_term, minlength=len(terms)))
    starts = ends - np.bincount(p_term, minlength=len(terms))
    dense = np.zeros((len(rows), len(peers)), dtype=np.int64)
    mine = np.flatnonzero((group >= rows.start) & (group < rows.stop))
    mine = mine[np.argsort(group[mine], kind="stable")]
    bounds = np.searchsorted(group[mine], np.arange(rows.start, rows.stop + 1))
    for n, row in enumerate(rows):
        own = mine[bounds[n]: bounds[n + 1]]
        for at in range(0, len(own), 4096):  # a bounded part of the lists at a time
            part = own[at: at + 4096]
            low, sizes_here = starts[term[part]], ends[term[part]] - starts[term[part]]
            where = np.repeat(low - (np.cumsum(sizes_here) - sizes_here), sizes_here) + np.arange(sizes_here.sum())
            p, q, h = np.repeat(used[part], sizes_here), p_used[where], p_group[where]
            p0, q0 = unused[row], unused[h]
            np.add.at(dense[n], h - peers.start, distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0))
    return dense


def _accumulator(groups):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[list, list]] = {}
        sizes: Counter = Counter()

        def flush(key: tuple) -> pd.DataFrame:
            terms, counts = held.pop(key)
            sizes.pop(key)
            lang, row_block, peer_block = key
            totals = groups.value[lang]
            rows = range(row_block * ROW_BLOCK, min(len(totals), (row_block + 1) * ROW_BLOCK))
            peers = range(peer_block * PEER_BLOCK, min(len(totals), (peer_block + 1) * PEER_BLOCK))
            dense = accumulate(terms, counts, rows, peers, totals)
            g, h = np.nonzero(dense)
            return pd.DataFrame({"lang": lang, "g": g + rows.start, "h": h + peers.start, "part": dense[g, h]})

        for batch in batches:
            for lang, row_block, peer_block, places, counts in batch[["lang", "row_block", "peer_block", "places", "counts"]].itertuples(index=False):
                key = lang, row_block, peer_block
                lists = held.setdefault(key, ([], []))
                lists[0].append(places)
                lists[1].append(counts)
                sizes[key] += len(places)
                if sizes[key] >= SLICE_POSTINGS:
                    yield flush(key)
        for key in list(held):
            yield flush(key)

    return sums


def _base_sums(groups):
    def base(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a group's own terms add against each peer that lacks them, from its histogram of counts."""
        for batch in batches:
            out = []
            for lang, place, histogram in batch[["lang", "g", "histogram"]].itertuples(index=False):
                totals = groups.value[lang]
                count, times = (np.array([r[k] for r in histogram], dtype=np.int64) for k in ("n", "terms"))
                p, p0 = share(count + 2, np.full_like(count, totals[place])), share(np.array([2]), totals[place: place + 1])
                q0 = share(np.full(len(totals), 2, dtype=np.int64), totals)
                extra = np.zeros(len(totals), dtype=np.int64)
                for a in range(0, len(count), 256):
                    extra += (times[a: a + 256, None] * (
                        distance(p[a: a + 256, None], q0[None, :]) - distance(p0, q0)[None, :])).sum(axis=0)
                out.append(pd.DataFrame({"lang": lang, "g": place, "h": np.arange(len(totals)), "part": extra}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang": [], "g": [], "h": [], "part": []})

    return base


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n``: uses of each term that at least ``least_docs`` documents of its language hold."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = stage(texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("lang_n")).where(F.col("d") >= least_docs)
    return stage(counts.select("lang", "source", "term", "n").join(kept.select("lang", "term", "lang_n"), ["lang", "term"]), "kept-terms")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every ``(lang, source)`` of ``docs(text, lang, source)``.

    Part ``pair`` has the divergence from each other source of the language, part ``term`` the ``top_terms`` terms that the
    source uses more than its language and that add most to the divergence from it; both by falling value, then item.
    Null language, source and text are the empty string; a group without kept terms keeps its pairs.  Repeated rows count
    as often as they occur, ids and other columns are ignored, and an empty table gives no rows.
    """
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    kept = kept_counts(docs, least_docs)
    langs = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = stage(
        named.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "own"])
        .withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("total", F.col("own") + 2 * F.col("v")).withColumn("lang_total", F.col("lang_total") + 2 * F.col("v")), "groups")
    by_value = [F.desc("value"), F.asc("item")]

    p = share_column(F.col("n") + 2, F.col("total"))
    q = share_column(F.col("lang_n") + 2, F.col("lang_total"))
    gap = F.col("p") - F.col("q")
    order = W.partitionBy("lang", "source").orderBy(*by_value)
    terms = kept.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), "item",
        F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value")).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    pairs = pair_sums(kept, groups)
    left, right = groups.select("lang", "source", "place", "v", "total"), groups.select(
        "lang", F.col("source").alias("item"), F.col("place").alias("h"), F.col("total").alias("peer_total"))
    # one row per pair of sources: the stated result
    unused = [F.when(F.col(t) > 0, share_column(F.lit(2).cast("long"), F.col(t))).otherwise(1) for t in ("total", "peer_total")]
    zero = F.call_function("div", (unused[0] - unused[1]) * (unused[0] - unused[1]), unused[0] + unused[1])
    pair = left.join(right, "lang").where("place <> h").join(
        pairs.withColumnRenamed("g", "place"), ["lang", "place", "h"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.col("v") * zero + F.coalesce("part", F.lit(0))).cast("long").alias("value")).withColumn("rank", F.row_number().over(order))
    return pair.unionByName(terms)


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, g, h, part`` for places of groups: all but the term ``V * f(p0, q0)`` of the module text."""
    spark = kept.sparkSession
    named = stage(kept.join(groups.select("lang", "source", "place"), ["lang", "source"]).select("lang", "term", "n", "place"), "placed")
    table: dict[str, list] = {}
    for r in groups.where("v > 0").select("lang", "place", "total").orderBy("lang", "place").toLocalIterator():
        table.setdefault(r["lang"], []).append(r["total"])  # one number per group
    totals = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in table.items()})
    index = named.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "n")).alias("uses")).select(
        "lang", "term", F.col("uses.place").alias("places"), F.col("uses.n").alias("counts"))
    for name, size in {"row_block": ROW_BLOCK, "peer_block": PEER_BLOCK}.items():  # a list goes to the blocks of its groups
        index = index.withColumn(name, F.explode(F.expr(f"array_distinct(transform(places, x -> cast(x div {size} as int)))")))
    shared = index.mapInPandas(_accumulator(totals), "lang string, g long, h long, part long")
    histogram = named.groupBy("lang", F.col("place").cast("long").alias("g"), "n").agg(F.count(F.lit(1)).alias("terms")).groupBy(
        "lang", "g").agg(F.collect_list(F.struct("n", "terms")).alias("histogram"))
    base = stage(histogram.mapInPandas(_base_sums(totals), "lang string, g long, h long, part long"), "base-sums")
    turned = base.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "part")
    return shared.unionByName(base).unionByName(turned).groupBy("lang", "g", "h").agg(F.sum("part").alias("part"))
