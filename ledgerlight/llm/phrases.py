"""Substring dedup with repeated-phrase automata.

A window is 50 consecutive words; a word goes if some window over it also starts in a document with a smaller id.

1. *Anchors.*  Every window names the 16-word gram with the smallest hash inside it, so equal windows name equal
   grams; about one gram in eighteen is named at all.  Grams named in one document only are dropped.
2. *Confirmed passages.*  In documents that hold a recurring gram, the windows over such grams are counted by their hash; each
   recurring window is credited to the smallest document that has it, and runs of such windows there are passages.
3. *Sharded automata.*  Suspect documents are dealt into shards of about ``SHARD_BYTES``.  A shard gets the passages that
   share a gram with its documents, and compiles the opening words of every 25-word tile of a passage into an Aho-Corasick
   automaton; any window of a passage holds a whole tile.  The shard's documents run through the automaton, and
   each hit is extended word by word along the passage: 50 equal words or more are an occurrence.

Hashes only nominate; what is removed has been compared word by word.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import lean, release, ship_by_value, stage

ship_by_value(__name__)

WINDOW, GRAM, TILE, TILE_KEY = 50, 16, 25, 10
SHARD_BYTES = 8 << 20
_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def gram_hashes(tokens: list[bytes], sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all runs of each size (even numbers), from polynomials that are doubled up from single words."""
    single = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    powers, spans, width = {1: _STEP}, {1: single}, 1
    while 2 * width <= max(sizes):
        low, power = spans[width], powers[width]
        spans[2 * width] = low[:-width] + np.uint64(power) * low[width:] if len(low) > width else low[:0]
        powers[2 * width] = power * power & _MASK
        width *= 2
    out = []
    for size in sizes:
        count, total, offset, scale = max(0, len(tokens) - size + 1), None, 0, 1
        for bit in sorted((b for b in spans if size & b), reverse=True):
            part = spans[bit][offset: offset + count] * np.uint64(scale)
            total = part if total is None else total + part
            scale, offset = scale * powers[bit] & _MASK, offset + bit
        total = total ^ (total >> np.uint64(33))
        total = total * np.uint64(0xFF51AFD7ED558CCD)
        out.append(total ^ (total >> np.uint64(29)))
    return out


def window_minima(grams: np.ndarray) -> np.ndarray:
    """For every window, the smallest gram hash inside it, from minima of runs that are doubled up."""
    inside = WINDOW - GRAM + 1
    if len(grams) < inside:
        return grams[:0]
    least, width = grams, 1
    while 2 * width <= inside:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(grams) - inside + 1], least[inside - width:])


def _digest(tokens: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(tokens)).hexdigest()


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, named = [], [], []
        for text in batch.column("text").to_pylist():
            tokens = split_words(text)
            counts.append(len(tokens))
            digests.append(_digest(tokens))
            if len(tokens) < WINDOW:
                named.append(np.zeros(0, dtype=np.int64))
                continue
            (grams,) = gram_hashes(tokens, (GRAM,))
            named.append(np.unique(window_minima(grams)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), _lists(named, pa.int64())],
            ["doc_id", "n_words", "whole_sha256", "grams"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "grams")), strict=True):
            tokens = split_words(text)
            if len(tokens) < WINDOW:
                continue
            grams, windows = gram_hashes(tokens, (GRAM, WINDOW))
            hit = np.flatnonzero(np.isin(window_minima(grams).view(np.int64), np.array(wanted, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(hit), doc_id, dtype=np.int64)), pa.array(hit), pa.array(windows[hit].view(np.int64))],
                ["doc_id", "at", "mark"])


def _passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for doc_id, text, firsts in batch[["doc_id", "text", "firsts"]].itertuples(index=False):
            tokens = split_words(text)
            at = np.unique(np.asarray(firsts, dtype=np.int64))
            at = at[at <= len(tokens) - WINDOW]
            if not len(at):
                continue
            grams, = gram_hashes(tokens, (GRAM,))
            named = window_minima(grams)
            out = []
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                passage = b" ".join(tokens[run[0]: run[-1] + WINDOW]).decode("utf-8", "surrogatepass")
                out.append((doc_id, passage, np.unique(named[run]).view(np.int64)))
            yield pd.DataFrame(out, columns=["first_id", "passage", "grams"])


def _occurrences(docs: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
    """Per document of a shard: the words that occurrences of passages of earlier documents cover."""
    automaton, sides = ahocorasick.Automaton(), []
    for first_id, passage in zip(passages["first_id"], passages["passage"], strict=True):
        tokens = passage.split(" ")
        sides.append((first_id, tokens))
        for at in range(0, len(tokens) - TILE + 1, TILE):
            key = f" {' '.join(tokens[at: at + TILE_KEY])} "
            automaton.get(key, None) or automaton.add_word(key, [])
            automaton.get(key).append((len(sides) - 1, at))
    out = []
    if len(automaton):
        automaton.make_automaton()
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        raw = split_words(text)
        if not len(automaton) or len(raw) < WINDOW:
            continue
        line = b" ".join(raw)
        words = line.decode("utf-8", "surrogatepass")
        tokens, starts, gone = None, None, None  # made for the few documents with a hit that counts
        done: dict[tuple[int, int], int] = {}
        for end, places in automaton.iter(f" {words} "):
            places = [x for x in places if sides[x[0]][0] < doc_id]
            if not places:
                continue
            if tokens is None:
                tokens, gone = words.split(" "), np.zeros(len(raw), dtype=bool)
                starts = np.r_[0, np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)].tolist()
            # ``end`` is the blank after the key in a line that opens with a blank
            after = bisect_left(starts, end)
            for side, at in places:
                passage = sides[side][1]
                p, t = after - TILE_KEY, at
                if done.get((side, p - t), -1) >= p:
                    continue
                left = 0
                while p - left > 0 and t - left > 0 and tokens[p - left - 1] == passage[t - left - 1]:
                    left += 1
                stop, limit = p + TILE_KEY, min(len(tokens), p + len(passage) - t)
                while stop < limit and tokens[stop] == passage[stop - p + t]:
                    stop += 1
                done[side, p - t] = stop - 1
                if stop - p + left >= WINDOW:
                    gone[p - left: stop] = True
        if gone is not None and gone.any():
            kept = [w for w, g in zip(raw, gone.tolist(), strict=True) if not g]
            out.append((doc_id, hashlib.sha256(line).hexdigest(), int(gone.sum()), _digest(kept),
                        b" ".join(kept).decode("utf-8", "surrogatepass")))
    release()
    return pd.DataFrame(out, columns=["doc_id", "whole_sha256", "n_removed", "kept_sha256", "kept"]).astype(
        {"doc_id": "int64", "n_removed": "int64"})


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs(doc_id, text, ...)``.

    ``with_text`` adds ``kept``, the words that stay, where some went.  Null and empty texts have no words.  Rows without
    ``doc_id`` keep all words and count for no other row; repeated rows get equal results, since rows of one
    id never count against each other.  Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text")
    named = stage(rows.mapInArrow(
        lean(_anchors), "doc_id long, n_words long, whole_sha256 string, grams array<long>"), "grams")
    each = named.where("doc_id IS NOT NULL").select("doc_id", F.explode("grams").alias("gram"))
    recurring = each.groupBy("gram").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where(
        "least < most").select("gram")
    shared = stage(each.join(recurring, "gram").distinct(), "shared-grams")
    wanted = shared.groupBy("doc_id").agg(F.collect_list("gram").alias("grams"))
    suspects = stage(rows.join(wanted, "doc_id"), "suspects")

    windows = suspects.mapInArrow(lean(_windows), "doc_id long, at long, mark long")
    confirmed = windows.groupBy("mark").agg(
        F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("most")).where("first.doc_id < most")
    firsts = confirmed.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list("first.at").alias("firsts"))
    passages = stage(suspects.select("doc_id", "text").join(firsts, "doc_id").mapInPandas(
        lean(_passages), "first_id long, passage string, grams array<long>").withColumn(
            "passage_id", F.monotonically_increasing_id()), "passages")

    size = suspects.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(12, -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    route = passages.select("passage_id", F.explode("grams").alias("gram")).join(
        shared.select("gram", shard).distinct(), "gram").select("passage_id", "shard").distinct()
    routed = passages.select("passage_id", "first_id", "passage").join(route, "passage_id").select("shard", "first_id", "passage")
    hits = suspects.select("doc_id", "text", shard).groupBy("shard").cogroup(routed.groupBy("shard")).applyInPandas(
        _occurrences, "doc_id long, whole_sha256 string, n_removed long, kept_sha256 string, kept string")
    found = (hits if with_text else hits.drop("kept")).dropDuplicates(["doc_id", "whole_sha256"])
    return named.drop("grams").join(found, ["doc_id", "whole_sha256"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), *(["kept"] if with_text else []))
