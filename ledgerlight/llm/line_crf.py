"""Quality rules by line sequence labelling.

A text is a sequence of lines.  A linear-chain conditional random field with the states *boilerplate* and *content* scores
each line by its marks (below) and each pair of neighbouring lines by their states; Viterbi decoding gives the likeliest
states, and the share of a document's word characters in content lines decides whether it stays.

Labels exist for documents only (``labels.quality``), so lines are labelled in rounds.  At first every line of a good
document is content and every line of a bad one boilerplate, and the marks are fitted without moves (such labels never
change inside a document).  After each fit the lines of bad documents are decoded again and those found to be content
are relabelled, but a bad document that would turn out content as a whole keeps its labels: it is known to be bad.

The field is fitted by gradient steps on the penalised likelihood, in one task, on a bounded sample (``SAMPLE_DOCS``
documents, cut into at most ``SAMPLE_PIECES`` pieces of ``PIECE_LINES`` lines); every document is measured and decoded
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import ship_by_value

ship_by_value(__name__)

SAMPLE_DOCS, SAMPLE_PIECES, PIECE_LINES = 4_000, 8_000, 64  # bounds on the labelled rows that the field is fitted on
LEAST_WORDS, MOST_REPEATED, LEAST_CONTENT = 50, 0.5, 0.5
BLOCK_BYTES = 1 << 20  # texts are measured together up to so many bytes; a longer text is a block of its own
ROUNDS, STEPS, RATE, PENALTY = 3, 120, 0.15, 1e-3

#: Marks of a line, one bit each, in this order: the bound that the named measure has to pass.
MARKS = (
    ("always", 0.0),
    ("words", 1), ("words", 3), ("words", 8), ("words", 20),
    ("symbols", 0.0), ("symbols", 0.02), ("symbols", 0.05), ("symbols", 0.12),
    ("shouts", 0.0), ("shouts", 0.02), ("shouts", 0.08),
    ("capitals", 0.15), ("capitals", 0.5), ("capitals", 0.9),
    ("digits", 0.05), ("digits", 0.2),
    ("points", 0.03), ("points", 0.1),
    ("stop", 0.5), ("opens", 0.5),
    ("echo", 0.1), ("echo", 0.4),
    ("phrases", 0.0), ("phrases", 0.3), ("phrases", 0.7),
    ("seen", 0.5), ("first", 0.5), ("last", 0.5),
    ("length", 12), ("brief", 0.33),
)

_BYTES = np.arange(256)
_BLANK = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])
_HEAD = (_BYTES < 0x80) | (_BYTES >= 0xC0)  # first bytes of code points
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
_UPPER, _LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_POINT = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_SYMBOL & ~np.isin(_BYTES, list(b".,!"))
_STOP = np.isin(_BYTES, list(b".!?;:"))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    distinct, numbers = np.unique(keys, return_inverse=True)
    return numbers.astype(np.int64), max(1, len(distinct))


def repeated_words(ids: np.ndarray, owner: np.ndarray, window: int = 3) -> np.ndarray:
    """Which words lie in a run of ``window`` words that their document (``owner``) holds twice or more."""
    inside = np.zeros(len(ids), dtype=bool)
    runs = len(ids) - window + 1
    if runs < 2:
        return inside
    key, sizes = ids[:runs].astype(np.int64), int(ids.max()) + 1
    for step in range(1, window):
        key, _ = _numbered(key * sizes + ids[step: runs + step])  # the pair fits: both sides number at most len(ids)
    same = owner[:runs] == owner[window - 1:]
    key = np.where(same, key * (int(owner.max()) + 1) + owner[:runs], -1)
    _, numbers, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = (counts[numbers] > 1) & same
    for step in range(window):
        inside[step: runs + step] |= again
    return inside


def measure(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """Counts per text, bytes ``(start, end)`` with the text number of each line that has a word, and its measures."""
    blob = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(blob, dtype=np.uint8)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    ends = np.flatnonzero(raw == 10)
    starts = np.r_[0, ends[:-1] + 1]
    blank = _BLANK[raw]
    word_starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    words = blob.split()
    numbers = {w: n for n, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    word_text = np.searchsorted(text_ends, word_starts, side="right")
    again = repeated_words(ids, word_text)
    echo = np.r_[False, ids[1:] == ids[:-1]] if len(ids) else np.zeros(0, dtype=bool)

    def over(flags: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[high] - total[low]

    first_word, past_word = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    n_words = past_word - first_word
    line_text = np.searchsorted(text_ends, ends, side="right")
    has_word = n_words > 0
    seen = np.zeros(len(ends), dtype=bool)
    at = -1
    met: set[bytes] = set()
    for n in np.flatnonzero(has_word).tolist():
        if line_text[n] != at:
            at, met = line_text[n], set()
        line = blob[starts[n]: ends[n]]
        seen[n] = line in met
        met.add(line)
    solid = ~blank & _HEAD[raw]
    chars = over(solid, starts, ends)
    symbols = over(_SYMBOL[raw], starts, ends)
    size = len(texts)

    def by_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(line_text, values, size).astype(np.int64)

    counts = {
        "n_words": by_text(n_words), "word_chars": by_text(chars), "n_symbols": by_text(symbols),
        "n_dup_lines": by_text(seen), "n_repeat_words": np.bincount(word_text, again, size).astype(np.int64)}

    lines = np.flatnonzero(has_word)
    low, high, firsts, pasts = starts[lines], ends[lines], first_word[lines], past_word[lines]
    letters = np.maximum(1, over(_UPPER[raw] | _LOWER[raw], low, high))
    solids, held, owner = np.maximum(1, chars[lines]), n_words[lines], line_text[lines]
    tails = np.maximum.accumulate(np.where(blank, -1, np.arange(len(raw))))[high - 1] if len(lines) else low
    measures = {
        "always": np.ones(len(lines)), "words": held, "symbols": symbols[lines] / solids,
        "shouts": over(raw == 33, low, high) / solids, "capitals": over(_UPPER[raw], low, high) / letters,
        "digits": over(_DIGIT[raw], low, high) / solids, "points": over(_POINT[raw], low, high) / solids,
        "stop": _STOP[raw[tails]], "opens": _UPPER[raw[word_starts[firsts]]] if len(lines) else low,
        "echo": over(echo, firsts, pasts) / np.maximum(1, held), "phrases": over(again, firsts, pasts) / np.maximum(1, held),
        "seen": seen[lines], "first": np.r_[True, owner[1:] != owner[:-1]] if len(lines) else low,
        "last": np.r_[owner[1:] != owner[:-1], True] if len(lines) else low,
        "length": solids / np.maximum(1, held), "brief": np.maximum(1, held) / solids,
    }
    return counts, np.stack([owner, low, high, chars[lines]], axis=1).astype(np.int64), measures


def line_marks(measures: dict[str, np.ndarray]) -> np.ndarray:
    """The marks of every line as the bits of one number."""
    bits = np.zeros(len(measures["always"]), dtype=np.int64)
    for n, (name, bound) in enumerate(MARKS):
        bits |= (measures[name] > bound).astype(np.int64) << n
    return bits


def unpack(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(len(MARKS))) & 1).astype(np.float64)


class Chains:
    """Sequences that lie one after the other in an array of lines, walked in step: line ``t`` of all that have one."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.lengths, self.starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
        self.steps = int(lengths.max(initial=0))
        self.active = np.searchsorted(-self.lengths, -np.arange(self.steps), side="left")

    def at(self, t: int) -> np.ndarray:
        return self.starts[: self.active[t]] + t

    def viterbi(self, emission: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """The likeliest state of every line; ``emission`` is the score of state 1 over state 0.  Ties go to state 1."""
        states, back = np.zeros(len(emission), dtype=np.int8), np.zeros((len(emission), 2), dtype=np.int8)
        best = np.zeros((len(self.lengths), 2))
        for t in range(self.steps):
            rows = self.at(t)
            if t:
                ways = best[: len(rows), :, None] + moves
                back[rows] = ways[:, 1] >= ways[:, 0]
                best[: len(rows)] = ways.max(axis=1)
            best[: len(rows), 1] += emission[rows]
        for t in range(self.steps - 1, -1, -1):
            rows = self.at(t)
            onward = self.active[t + 1] if t + 1 < self.steps else 0
            states[rows[onward:]] = best[onward: len(rows), 1] >= best[onward: len(rows), 0]
            states[rows[:onward]] = back[rows[:onward] + 1, states[rows[:onward] + 1]]
        return states

    def marginals(self, emission: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of state 1 for every line, and the expected number of each move."""
        scores = np.stack([np.zeros(len(emission)), emission], axis=1)
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        expected = np.zeros((2, 2))
        for t in range(self.steps):
            rows = self.at(t)
            ahead[rows] = scores[rows]
            if t:
                ahead[rows] += np.logaddexp.reduce(ahead[rows - 1][:, :, None] + moves, axis=1)
        for t in range(self.steps - 2, -1, -1):
            rows = self.at(t)[: self.active[t + 1]]
            behind[rows] = np.logaddexp.reduce(moves + (scores[rows + 1] + behind[rows + 1])[:, None, :], axis=2)
        for t in range(1, self.steps):
            rows = self.at(t)
            pair = ahead[rows - 1][:, :, None] + moves + (scores[rows] + behind[rows])[:, None, :]
            pair -= np.logaddexp.reduce(pair.reshape(len(rows), 4), axis=1)[:, None, None]
            expected += np.exp(pair).sum(axis=0)
        both = ahead + behind
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), expected


def _moves_made(states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    inner = np.ones(len(states), dtype=bool)
    inner[np.cumsum(lengths) - lengths] = False
    made = np.zeros((2, 2))
    np.add.at(made, (states[:-1][inner[1:]], states[1:][inner[1:]]), 1)
    return made


def fit(bits: np.ndarray, lengths: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the marks (for content) and of the moves, from sequences of good and bad documents."""
    chains, marks = Chains(lengths), unpack(bits)
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    is_good = np.repeat(good, lengths)
    states = is_good.astype(np.int8)
    weights, moves = np.zeros(len(MARKS)), np.zeros((2, 2))
    for n in range(ROUNDS):
        squares, move_squares = np.full(len(MARKS), 1e-8), np.full((2, 2), 1e-8)
        made = _moves_made(states, lengths)
        for _ in range(STEPS):  # AdaGrad on the likelihood per line
            content, expected = chains.marginals(marks @ weights, moves)
            pull = marks.T @ (states - content) / len(bits) - PENALTY * weights
            move_pull = (made - expected) / len(bits) - PENALTY * moves
            squares += pull * pull
            move_squares += move_pull * move_pull
            weights = weights + RATE * pull / np.sqrt(squares)
            if n:
                moves = moves + RATE * move_pull / np.sqrt(move_squares)
        found = chains.viterbi(marks @ weights, moves)
        some_bad = np.bincount(sequence, found == 0, len(lengths)) > 0
        states = np.where(is_good, 1, np.where(some_bad[sequence], found, 0)).astype(np.int8)
    return weights, moves


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for n, text in enumerate(texts):
        if held and held + len(text) > BLOCK_BYTES:
            yield start, n
            start, held = n, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _training_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids, quality = _bytes(batch), batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist()
        out = []
        for low, high in _blocks(texts):
            _, lines, measures = measure(texts[low:high])
            for n, bits in enumerate(np.split(line_marks(measures), np.searchsorted(lines[:, 0], np.arange(1, high - low)))):
                for at in range(0, len(bits), PIECE_LINES):
                    out.append((ids[low + n], at, quality[low + n], bits[at: at + PIECE_LINES].tolist()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
             pa.array(columns[3], pa.list_(pa.int64()))], ["doc_id", "at", "quality", "bits"])


def _fit_table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(batches)  # at most SAMPLE_PIECES rows
    table = pd.concat(held, ignore_index=True) if held else pd.DataFrame({"quality": []})
    if table["quality"].nunique() == 2:
        table = table.sort_values(["doc_id", "at"])
        lengths = table["bits"].map(len).to_numpy()
        weights, moves = fit(np.concatenate(table["bits"].to_list()).astype(np.int64), lengths, table["quality"].to_numpy() == 1)
        yield pd.DataFrame({"weights": [weights.tolist()], "moves": [moves.ravel().tolist()]})


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[float], list[float]]:
    """Weights and moves of the field, from documents that ``labels(doc_id, quality)`` calls good (1) or bad (0).

    Ids with both labels, other values and null ids are not learned from; of the rows of one id one is.  With labels of one kind
    or none, the field calls every line content.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("_most")).where("quality = _most")
    # as many of each kind as there are, the ids with the smallest hashes: at most sample_docs ids
    order = F.xxhash64("doc_id", F.lit("line field"))
    half = [known.where(F.col("quality") == k).select("doc_id", "quality").orderBy(order).limit(sample_docs // 2) for k in (0, 1)]
    picked = F.broadcast(half[0].unionByName(half[1]))
    texts = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    pieces = texts.mapInArrow(_training_pieces, "doc_id long, at long, quality int, bits array<long>")
    bounded = pieces.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(SAMPLE_PIECES)
    model = bounded.coalesce(1).mapInPandas(_fit_table, "weights array<double>, moves array<double>").first()
    if model is None:
        return [1.0] + [0.0] * (len(MARKS) - 1), [0.0] * 4
    return list(model["weights"]), list(model["moves"])


def _labeller(weights: list[float], moves: list[float], with_text: bool):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, move = np.array(weights), np.array(moves).reshape(2, 2)
        for batch in batches:
            texts, parts, contents = _bytes(batch), [], []
            for low, high in _blocks(texts):
                counts, lines, measures = measure(texts[low:high])
                size = high - low
                chains = Chains(np.bincount(lines[:, 0], minlength=size))
                states = chains.viterbi(unpack(line_marks(measures)) @ weight, move)
                counts["n_lines"] = np.bincount(lines[:, 0], minlength=size)
                counts["n_content_lines"] = np.bincount(lines[:, 0], states, size).astype(np.int64)
                inside = np.bincount(lines[:, 0], states * lines[:, 3], size)
                counts["content_share"] = inside / np.maximum(1, counts["word_chars"])
                parts.append(counts)
                if with_text:
                    blob = b"\n".join(texts[low:high]) + b"\n"
                    kept = lines[states == 1]
                    bounds = np.searchsorted(kept[:, 0], np.arange(size + 1))
                    contents += [b"\n".join(blob[a:b] for _, a, b, _ in kept[bounds[n]: bounds[n + 1]].tolist())
                                 for n in range(size)]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines",
                     "content_share"]
            columns = [batch.column("doc_id")] + [
                pa.array(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, dtype=np.int64),
                         pa.float64() if n == "content_share" else pa.int64()) for n in names]
            if with_text:
                columns.append(pa.array(contents, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names] + ["content"] * with_text)

    return label


def label_documents(docs: DataFrame, model: tuple[list[float], list[float]], with_text: bool = False) -> DataFrame:
    """Counts and content share of every row of ``docs(doc_id, text, ...)``; ``with_text`` adds the content lines.

    Null texts are empty; a text without words has no lines and the share 0.  Every row is judged for itself, so repeated
    rows get equal results and null ids are passed through.  Other columns are ignored; an empty table gives no rows.
    """
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long,"
              " n_content_lines long, content_share double" + (", content string" if with_text else ""))
    return docs.select("doc_id", "text").mapInArrow(_labeller(*model, with_text), schema)


def judge(docs: DataFrame, labels: DataFrame, with_text: bool = False) -> DataFrame:
    """The rows of ``label_documents`` with ``base_failed`` (too short or too repetitive) and ``kept``.

    ``kept`` is false where the plain rules fail, and otherwise true where at least half of the word characters
    are in content lines.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    return label_documents(docs, train(docs, labels), with_text).withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("content_share") >= LEAST_CONTENT))
