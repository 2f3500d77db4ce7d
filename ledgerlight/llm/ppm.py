"""Language-model scores: prediction by partial matching over bytes, and a word unigram score as the base.

The pretrained trie has contexts of up to ``ORDER`` bytes.  A symbol that a context has not seen costs an escape to the
next shorter context (method C: a context with ``n`` counts of ``d`` symbols escapes with ``d / (n + d)``), where
the symbols of the longer context are excluded; below order zero all remaining bytes are equally likely.  A
document starts behind ``ORDER`` zero bytes and ends with one.

Every context of the training texts counts; none is dropped.  A score depends only on the ``ORDER + 1`` bytes of a
position, so the texts are cut into pieces of ``PIECE_BYTES``, and a piece sends its distinct byte strings (few beside its
positions) with their training counts to the shards of the trie.  A shard holds all contexts whose last ``NEAR`` bytes
fall to it and so all it needs of the orders above ``NEAR``; the lower orders are one small table (``NEAR + 1`` bytes a row)
that every shard reads.  The shards answer each piece with the logarithms of its strings, and the piece adds them up by
document.  The number of shards follows the corpus.

Word counts are exact and unbounded.  The words that make up at least one in ``FREQUENT_WORDS`` of all tokens (so at most that
many) are looked up in the tasks; the documents' other words are joined to the count table, and none of those is
frequent enough to be a hot key.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import lean, release, ship_by_value, stage

ship_by_value(__name__)

ORDER = 5
NEAR = 2  # orders up to this one are read by every shard
PIECE_BYTES = 32 << 20
PIECE_ROWS = 1 << 20
SHARD_BYTES = 64 << 20  # of text for each shard
LEAST_SHARDS = 24
FREQUENT_WORDS = 1 << 17
END_WORD = "\n"  # no word holds white space
_SLICE, _CHUNK = 1 << 20, 8 << 20
_LOWER, _TEXTS = -1, -2  # in place of a shard's number
_ROWS = 256  # rows of a batch that are turned into Python objects at a time


def held_out(doc_id: str) -> Column:
    """Rows that are not learned from; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(True))


def lower_words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every position of every text as one number, and the text it belongs to."""
    lead = bytes(ORDER)
    stream = np.frombuffer(b"".join(lead + t + b"\0" for t in texts), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + ORDER + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    keys = stream[ORDER:].copy()
    for back in range(1, ORDER + 1):
        keys |= stream[ORDER - back: len(stream) - back] << np.uint64(8 * back)
    real = np.ones(len(stream), dtype=bool)
    for place in range(ORDER):
        real[starts + place] = False
    return keys[real[ORDER:]], np.repeat(np.arange(len(texts)), sizes - ORDER)


def _sliced(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of a few megabytes each, with the place of their first text."""
    first, held = 0, 0
    for n, text in enumerate(texts):
        held += len(text)
        if held >= _SLICE:
            yield first, texts[first: n + 1]
            first, held = n + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A few rows at a time, with their texts as bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]


def _squeezed(values: np.ndarray | bytes) -> bytes:
    raw = values if isinstance(values, bytes) else values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True) if len(blob) > 8 else b""


def _sorted_out(blob: bytes) -> np.ndarray:
    """Keys from their differences."""
    return np.cumsum(np.frombuffer(_opened(blob), dtype=np.uint64), dtype=np.uint64)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their sums."""
    if not len(keys):
        return keys, times
    rank = np.argsort(keys, kind="stable")
    keys, times = keys[rank], times[rank]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times, first)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the bytes before the symbol that the shortest context above ``NEAR`` sees."""
    near = (keys >> np.uint64(8)) & np.uint64((1 << (8 * (NEAR + 1))) - 1)
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(shards)


_FIRST = "word string, n long, piece long, shard int, blob binary, times binary"


def _first_pass(shards: int):
    """Word counts of the training rows; per piece its texts, its lower orders and its distinct keys for each shard."""

    def rows(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        types = {"word": pa.string(), "n": pa.int64(), "piece": pa.int64(), "shard": pa.int32(), "blob": pa.binary(), "times": pa.binary()}
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()], list(types))

    def closed(piece: int, grams: list) -> pa.RecordBatch:
        both, times = _summed(*(np.concatenate(c) for c in zip(*grams, strict=True)))
        keys, times = _summed(both >> np.uint64(1), np.where(both & np.uint64(1) == 1, times, 0))
        seen = times > 0
        lower = _summed(keys[seen] & Trie._mask(NEAR), times[seen])
        at = shard_of(keys, shards).astype(np.int32)
        rank = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[rank], np.arange(shards + 1))
        out = [(_LOWER, *lower)]
        out += [(n, keys[rank[a:b]], times[rank[a:b]]) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return rows(piece=[piece] * len(out), shard=[n for n, _, _ in out], times=[_squeezed(t.astype(np.int64)) for _, _, t in out],
                    blob=[_squeezed(np.diff(k, prepend=np.uint64(0))) for _, k, _ in out])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        piece, held, texts_held, ends = TaskContext.get().partitionId() << 20, 0, 0, 0
        for batch, texts in _small(batches):
            learned = batch.column("learned").to_numpy(zero_copy_only=False)
            for text, wanted in zip(texts, learned, strict=True):
                if wanted:
                    words.update(lower_words(text))
            if len(words) > 150_000:
                yield rows(word=[w.decode("utf-8", "surrogatepass") for w in words], n=list(words.values()))
                words = Counter()
            ends += int(learned.sum())
            for at, some in _sliced(texts):
                keys, owner = keys_of(some)
                grams.append(np.unique((keys << np.uint64(1)) | learned[at + owner].astype(np.uint64), return_counts=True))
                if sum(len(k) for k, _ in grams) > 500_000 + 1.25 * len(grams[0][0]):
                    grams = [_summed(*(np.concatenate(c) for c in zip(*grams, strict=True)))]
            packed = _squeezed(pickle.dumps((batch.column("doc_id").to_pylist(), texts), protocol=5))
            yield rows(piece=[piece], shard=[_TEXTS], blob=[packed])
            held += sum(map(len, texts))
            texts_held += len(texts)
            if held >= PIECE_BYTES or texts_held + _ROWS > PIECE_ROWS:
                yield closed(piece, grams)
                grams, piece, held, texts_held = [], piece + 1, 0, 0
                release()
        if grams:
            yield closed(piece, grams)
        if ends:
            words[END_WORD.encode()] += ends
        yield rows(word=[w.decode("utf-8", "surrogatepass") for w in words], n=list(words.values()))

    return lean(first)


def _lower_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, times = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        for blob, counts in zip(batch.column("blob").to_pylist(), batch.column("times").to_pylist(), strict=True):
            keys, times = _summed(np.r_[keys, _sorted_out(blob)], np.r_[times, np.frombuffer(_opened(counts), dtype=np.int64)])
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], ["key", "n"])


class Trie:
    """Counts per order in sorted arrays; ``levels`` are those of the lower orders where they are built already."""

    def __init__(self, orders: dict[int, tuple[np.ndarray, np.ndarray]], levels: Sequence[tuple] = (), top: int = ORDER):
        self.levels = list(levels)
        for order in range(len(self.levels), top + 1):
            keys, counts = orders.get(order, (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
            rank = np.argsort(keys, kind="stable")
            keys, counts = keys[rank].astype(np.uint64), counts[rank].astype(np.float64)
            contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(np.float64)
            below = np.zeros(len(contexts))  # how often the next shorter context has seen this context's symbols
            if order and len(keys):
                short, short_counts = self.levels[-1][:2]
                place, known = self._find(short, keys & self._mask(order - 1))
                below = np.bincount(at, np.where(known, short_counts[place], 0.0), len(contexts))
            self.levels.append((keys, counts, contexts, total, kinds, below))

    @staticmethod
    def _mask(order: int) -> np.uint64:
        return np.uint64((1 << (8 * (order + 1))) - 1)

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        place = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return place, table[place] == wanted

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol behind its context."""
        out = np.zeros(len(keys))
        open_at = np.arange(len(keys))
        seen_n = seen_d = np.zeros(len(keys))  # counts and kinds of the excluded symbols in the context at hand
        for order in range(ORDER, -1, -1):
            if not len(open_at):
                return out
            table, counts, contexts, total, kinds, below = self.levels[order]
            if not len(table):
                continue
            now = keys[open_at] & self._mask(order)
            place, hit = self._find(table, now)
            where, known = self._find(contexts, now >> np.uint64(8))
            n = np.where(known, total[where] - seen_n, 0.0)
            d = np.where(known, kinds[where] - seen_d, 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                found = np.log10(counts[place] / (n + d))
                escape = np.where(known & (d > 0), np.log10(d / (n + d)), 0.0)
            out[open_at] += np.where(hit, found, escape)
            miss = ~hit
            # the excluded symbols, seen from the next shorter context
            seen_n, seen_d = np.where(known, below[where], 0.0)[miss], np.where(known, kinds[where], 0.0)[miss]
            open_at = open_at[miss]
        if len(open_at):
            left = 256 - len(self.levels[0][0])
            out[open_at] -= math.log10(max(1, left))
        return out


class Lookup:
    """Values of distinct keys, hashed: two slots a key, two to four slots a row; a key without a free slot is searched."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        rank = np.argsort(keys)
        self.keys, self.values = keys[rank], values[rank]
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        self.slots = np.full((1 << (64 - int(self.shift))) + 1, np.uint64((1 << 64) - 1))
        self.found = np.zeros(len(self.slots))
        home = self._home(keys)
        for step in (0, 1):
            free = self.slots[home + step] == np.uint64((1 << 64) - 1)
            self.slots[home[free] + step] = keys[free]
            placed = self.slots[home + step] == keys
            self.found[home[placed] + step] = values[placed]
            home, keys, values = home[~placed], keys[~placed], values[~placed]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        home = self._home(keys)
        out = self.found[home]
        open_at = np.flatnonzero(self.slots[home] != keys)
        home = home[open_at] + 1
        out[open_at] = self.found[home]
        open_at = open_at[self.slots[home] != keys[open_at]]
        out[open_at] = self.values[np.searchsorted(self.keys, keys[open_at])]
        return out


def _as_chunks(value) -> pd.DataFrame:
    whole = zlib.compress(pickle.dumps(value, protocol=5), 1)
    parts = [whole[at: at + _CHUNK] for at in range(0, len(whole), _CHUNK)]
    return pd.DataFrame({"part": np.arange(len(parts)), "piece": parts})


def _lower_chunks(table: pd.DataFrame) -> pd.DataFrame:
    keys, times = table["key"].to_numpy(dtype=np.int64).astype(np.uint64), table["n"].to_numpy(dtype=np.int64)
    return _as_chunks(Trie({o: _summed(keys & Trie._mask(o), times) for o in range(NEAR + 1)}, top=NEAR).levels)


def _word_chunks(table: pd.DataFrame) -> pd.DataFrame:
    words = [w.encode("utf-8", "surrogatepass") for w in table["word"]]
    return _as_chunks(dict(zip(words, np.log10(table["n"].to_numpy() + 1.0).tolist(), strict=True)))


def _chunked(rows: DataFrame, build) -> bytes:
    """``build`` of a bounded table, run in one task; the driver only passes the compressed bytes on."""
    one = rows.withColumn("one", F.lit(0)).groupBy("one")
    parts = one.applyInPandas(build, "part long, piece binary").collect()
    return b"".join(bytes(r["piece"]) for r in sorted(parts, key=lambda r: r["part"]))


def _answers(shared):
    def answer(table: pa.Table) -> pa.Table:
        """The logarithms of all keys that the pieces sent to one shard."""
        lower = shared.value[0]
        asked = [_sorted_out(b) for b in table.column("blob").to_pylist()]
        times = [np.frombuffer(_opened(t), dtype=np.int64) for t in table.column("times").to_pylist()]
        keys, times = _summed(np.concatenate(asked), np.concatenate(times))
        seen = times > 0
        trie = Trie({o: _summed(keys[seen] & Trie._mask(o), times[seen]) for o in range(NEAR + 1, ORDER + 1)},
                    pickle.loads(zlib.decompress(lower)) if lower else Trie({}, top=NEAR).levels)
        logs = np.concatenate([trie.log10(keys[at: at + _SLICE]) for at in range(0, len(keys), _SLICE)])
        answers = pa.array([_squeezed(logs[np.searchsorted(keys, some)]) for some in asked], pa.binary())
        del asked, times, keys, logs, trie, seen
        release()
        return pa.table([table.column("piece"), table.column("shard"), table.column("blob"), answers],
                        ["piece", "shard", "blob", "times"])

    return answer


def _scorer(shared):
    def score(table: pa.Table) -> pa.Table:
        """The rows of one piece, from its texts and what the shards answered."""
        frequent = pickle.loads(zlib.decompress(shared.value[1])) if shared.value[1] else {}
        of_shard = table.filter(pc.greater_equal(table.column("shard"), 0))
        logs = Lookup(np.concatenate([_sorted_out(b) for b in of_shard.column("blob").to_pylist()]),
                      np.concatenate([np.frombuffer(_opened(t)) for t in of_shard.column("times").to_pylist()]))
        row, out = table.column("piece")[0].as_py() << 20, []
        for blob in table.filter(pc.equal(table.column("shard"), _TEXTS)).column("blob").to_pylist():
            ids, texts = pickle.loads(_opened(blob))
            scores = np.zeros(len(texts))
            for first, some in _sliced(texts):
                keys, owner = keys_of(some)
                scores[first: first + len(some)] = np.bincount(owner, logs[keys], len(some))
            tokens, known, sums, rare, times, ends = [], [], [], [], [], [0]
            for text in texts:
                words = lower_words(text)
                tokens.append(len(words) + 1)
                hits, total = 0, 0.0
                words.append(END_WORD.encode())
                for word, n in Counter(words).items():
                    log = frequent.get(word)
                    if log is None:
                        rare.append(word)
                        times.append(n)
                    else:
                        hits += n
                        total += n * log
                known.append(hits)
                sums.append(total)
                ends.append(len(rare))
            cuts = pa.array(ends, pa.int32())
            names = pa.array([w.decode("utf-8", "surrogatepass") for w in rare], pa.string())
            out.append(pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(texts))), pa.array(ids, pa.int64()),
                pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores),
                pa.ListArray.from_arrays(cuts, names), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32()))],
                ["row", "doc_id", "n_tokens", "known", "logs", "score", "rare", "times"]))
            row += len(texts)
        del logs, of_shard, frequent
        release()
        return pa.Table.from_batches(out)

    return score


_SCORED = ("row long, doc_id long, n_tokens long, known long, logs double, score double, "
           "rare array<string>, times array<int>")


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text, ...)``.

    ``base_score`` sums ``log10((c + 1) / (N + V + 1))`` over the lower-case words and one end per document; ``score`` is the
    trie's log10 probability of the whole text and its end.  Null texts are empty; repeated rows get equal results
    and each count in training; other columns are ignored; an empty table gives no rows.  Without training rows
    every byte costs the same and ``base_score`` is zero.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    rows = docs.select("doc_id", "text", (~held_out("doc_id")).alias("learned"))
    passed = stage(rows.mapInArrow(_first_pass(shards), _FIRST), "pieces")
    words = stage(passed.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = words.where(F.col("n") * FREQUENT_WORDS >= F.lit(tokens))  # FREQUENT_WORDS rows at most
    lower = passed.where(F.col("shard") == _LOWER).select("blob", "times").mapInArrow(lean(_lower_rows), "key long, n long").groupBy(
        "key").agg(F.sum("n").alias("n"))
    shared = spark.sparkContext.broadcast((_chunked(lower, _lower_chunks), _chunked(frequent, _word_chunks)))
    parts = passed.where("word IS NULL").select("piece", "shard", "blob", "times")
    answers = parts.where("shard >= 0").groupBy("shard").applyInArrow(_answers(shared), parts.schema)
    scored = stage(parts.where(F.col("shard") == _TEXTS).unionByName(answers).groupBy("piece").applyInArrow(
        _scorer(shared), _SCORED), "scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select(
        "row", F.col("p.rare").alias("word"), F.col("p.times").alias("times"))
    rest = words.where(F.col("n") * FREQUENT_WORDS < F.lit(tokens))
    met = pairs.join(rest, "word").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    logs_sum = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return scored.drop("rare", "times").join(met, "row", "left").select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (logs_sum - F.col("n_tokens") * math.log10(tokens + kinds + 1)).alias("base_score"), "score")
