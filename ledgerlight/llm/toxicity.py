"""Toxicity scores from non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts and unlabelled texts only.  With class prior ``pi`` (the share of toxic among
the labelled rows of the training fold) the risk of a classifier ``g`` is estimated as

    pi * E_toxic[loss(+g)]  +  max(0, E_unlabelled[loss(-g)] - pi * E_toxic[loss(-g)])

and where the second part falls below zero its gradient is reversed, so the model cannot win by calling
all toxic examples it has not been shown clean.  Several numpy classifiers are trained, each in a task of its own on all
confirmed texts and its share of the unlabelled ones of a bounded sample, and their weights are averaged.  A document's features are its distinct lower-case
words and the first letters of its longer words, hashed into ``SLOTS`` slots; no label, language, source or id enters.
Only slots that are clearly commoner in toxic than in unlabelled texts carry weight, and no weight is negative: otherwise
the many one-off words of a long document would drown the few that matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import lean, release, ship_by_value

ship_by_value(__name__)

SLOTS = 1 << 18
STEMS = (4, 5, 6)
MEMBERS = 4
SAMPLE_ROWS = 12_000  # bound on the texts of each kind that the classifiers are fitted on
THRESHOLD = 0.3
DENSITY, SMOOTH = 50.0, 30.0  # hits in so many words count one; so many words are added to every text
# A telling slot is in so many times more toxic texts than its share of unlabelled texts lets expect, with a
# log-likelihood ratio that chance reaches for about one slot in twenty thousand.
LEAST_LIFT, LEAST_SURPRISE = 2.0, 20.0
_EDGES = re.compile(r"^\W+|\W+$")
_CACHE: dict[str, tuple[int, ...]] = {}


def word_slots(word: str) -> tuple[int, ...]:
    """Feature slots of one white-space separated token."""
    known = _CACHE.get(word)
    if known is None:
        if len(_CACHE) > 300_000:
            _CACHE.clear()
        bare = _EDGES.sub("", word.lower())
        parts = [bare] if bare else []
        parts += [f"{bare[:n]}*" for n in STEMS if len(bare) > n]
        known = _CACHE[word] = tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % SLOTS for p in parts)
    return known


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a whole text with their values; empty for null and empty texts.

    A value is the smoothed density of the slot's words: one hit in a long text says little, several say much.
    """
    words = (text or "").split()
    found: Counter[int] = Counter()
    for word, times in Counter(words).items():
        for slot in word_slots(word):
            found[slot] += times
    slots = np.fromiter(found.keys(), dtype=np.int32, count=len(found))
    counts = np.fromiter(found.values(), dtype=np.float32, count=len(found))
    return slots, np.minimum(counts * np.float32(DENSITY / (len(words) + SMOOTH)), 3)


def _packed(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    return owner, np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])


def fit(toxic: list[tuple[np.ndarray, np.ndarray]], unlabelled: list[tuple[np.ndarray, np.ndarray]], prior: float,
        epochs: int = 30, batches: int = 8, rate: float = 0.5, decay: float = 1e-5,
        seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier, by AdaGrad on the non-negative risk with logistic loss."""
    seen = np.bincount(np.concatenate([x for x, _ in toxic]), minlength=SLOTS)
    expected = (np.bincount(np.concatenate([x for x, _ in unlabelled]), minlength=SLOTS) + 1) * len(toxic) / len(unlabelled)
    surprise = 2 * (seen * np.log(np.maximum(seen, 1e-9) / expected) - (seen - expected))
    telling = (seen > LEAST_LIFT * expected) & (surprise >= LEAST_SURPRISE)
    toxic = [(x[telling[x]], v[telling[x]]) for x, v in toxic]
    unlabelled = [(x[telling[x]], v[telling[x]]) for x, v in unlabelled]
    weights, squares = np.zeros(SLOTS), np.full(SLOTS, 1e-6)
    bias, bias_square = float(np.log(prior / (1 - prior))), 1e-6
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        p_order, u_order = draw.permutation(len(toxic)), draw.permutation(len(unlabelled))
        for p_rows, u_rows in zip(np.array_split(p_order, batches), np.array_split(u_order, batches), strict=True):
            if not len(p_rows) or not len(u_rows):
                continue
            p_owner, p_slots, p_values = _packed([toxic[i] for i in p_rows])
            u_owner, u_slots, u_values = _packed([unlabelled[i] for i in u_rows])
            p_score = bias + np.bincount(p_owner, weights[p_slots] * p_values, len(p_rows))
            u_score = bias + np.bincount(u_owner, weights[u_slots] * u_values, len(u_rows))
            p_sigma, u_sigma = 1 / (1 + np.exp(-np.clip(p_score, -40, 40))), 1 / (1 + np.exp(-np.clip(u_score, -40, 40)))
            negative = np.logaddexp(0, u_score).mean() - prior * np.logaddexp(0, p_score).mean()
            if negative >= 0:
                p_pull = prior * ((p_sigma - 1) - p_sigma) / len(p_rows)
                u_pull = u_sigma / len(u_rows)
            else:  # the unlabelled part is already explained: step back along it
                p_pull = prior * p_sigma / len(p_rows)
                u_pull = -u_sigma / len(u_rows)
            slope = decay * weights  # bincount of no slots is of whole numbers, so it comes second
            slope = slope + np.bincount(p_slots, p_pull[p_owner] * p_values, SLOTS)
            slope = slope + np.bincount(u_slots, u_pull[u_owner] * u_values, SLOTS)
            squares += slope * slope
            weights = np.maximum(0, weights - rate * slope / np.sqrt(squares)) * telling
            pull = p_pull.sum() + u_pull.sum()
            bias_square += pull * pull
            bias -= 0.1 * rate * pull / np.sqrt(bias_square)
    return weights, bias


def training_fold(doc_id: str) -> Column:
    """Rows whose labels may be learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) != 2


def _member(prior: float):
    def train(table: pd.DataFrame) -> pd.DataFrame:
        slots = [text_features(t) for t in table["text"]]
        kinds = table["toxic"].to_numpy()
        toxic = [s for s, k in zip(slots, kinds, strict=True) if k == 1]
        rest = [s for s, k in zip(slots, kinds, strict=True) if k == 0]
        if not toxic or not rest:
            return pd.DataFrame({"weights": [], "bias": []}).astype({"weights": object, "bias": float})
        weights, bias = fit(toxic, rest, prior)
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "bias": [bias]})

    return train


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Averaged weights and bias; without any toxic example in the training fold, the constant prior.

    ``sample_rows`` bounds the toxic and the unlabelled texts that are fitted on: those with the smallest
    hashes of their ids, one text for each id (the smallest of repeated rows).  The prior is counted over all labelled rows
    of the training fold.
    """
    fold = labels.where(training_fold("doc_id") & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    rows, hits = fold.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(max(hits / max(rows, 1), 1e-4), 0.5)
    order = F.xxhash64("doc_id")
    confirmed = fold.where("toxic = 1").select("doc_id", F.lit(1).alias("toxic")).distinct().orderBy(order).limit(sample_rows)
    others = docs.where(training_fold("doc_id")).select("doc_id", F.lit(0).alias("toxic")).distinct().orderBy(order).limit(sample_rows)
    picked = F.broadcast(confirmed.unionByName(others))  # at most 2 * sample_rows ids
    sample = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # every classifier sees all confirmed texts and its own share of the unlabelled ones
    share = F.pmod(F.xxhash64("doc_id", F.lit("member")), F.lit(MEMBERS)).cast("int")
    every = F.array(*[F.lit(n) for n in range(MEMBERS)])
    dealt = sample.withColumn("member", F.explode(F.when(F.col("toxic") == 1, every).otherwise(F.array(share))))
    models = dealt.groupBy("member").applyInPandas(_member(prior), "weights binary, bias double").collect()
    if not models:
        return np.zeros(SLOTS, dtype=np.float32), float(np.log(prior / (1 - prior)))
    weights = np.mean([np.frombuffer(m["weights"], dtype="<f4") for m in models], axis=0).astype(np.float32)
    return weights, float(np.mean([m["bias"] for m in models]))


def logits(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of each text."""
    rows = map(text_features, texts)
    scores = [bias + float(np.dot(weights[slots].astype(np.float64), values)) for slots, values in rows]
    return np.array(scores, dtype=np.float64)


def _scorer(shared, bias: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value, dtype=np.float32)
        for batch in batches:
            logit = logits(batch.column("text").to_pylist(), weights, bias)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))], ["doc_id", "score"])
        _CACHE.clear()

    return lean(score)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id, score, predicted`` of every row; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model[0].tobytes())  # SLOTS floats: one megabyte
    rows = docs.select("doc_id", "text").mapInArrow(_scorer(shared, model[1]), "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text, ...)``.

    ``labels(doc_id, toxic, ...)`` may hold nulls, repeats and other columns; rows whose label is neither 0 nor 1
    are not learned from.  A null ``doc_id`` is held out.  Empty tables give empty results.
    """
    held_out = F.coalesce(~training_fold("doc_id"), F.lit(True))
    return score(docs, train(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def _keeper(shared, bias: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value, dtype=np.float32)
        edge = float(np.log(THRESHOLD / (1 - THRESHOLD)))
        for batch in batches:
            logit = logits(batch.column("text").to_pylist(), weights, bias)
            yield batch.filter(pa.array(logit < edge))
        _CACHE.clear()

    return lean(keep)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not call toxic, with their columns."""
    weights, bias = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights.tobytes())
    return docs.mapInArrow(_keeper(shared, bias), docs.schema)
