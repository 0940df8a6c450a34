"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagscope.llm.base import balanced_sample, fold, small_batches
from bagscope.llm.ngrams import grams, letters, slices
from bagscope.session import materialize

SIZES = (3, 4, 5)
_PART = 100_000


@dataclass(frozen=True)
class Settings:
    """``per_class`` and ``max_chars`` bound the training sample; scoring has no bound."""

    per_class: int = 2000
    max_chars: int = 50_000
    bits: int = 17
    width: int = 8
    rounds: int = 5
    steps: int = 8
    candidates: int = 4
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 7


def _words(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram buckets in order of their word, and the number of n-grams of each word."""
    starts = np.concatenate([[0], np.cumsum((codes[:-1] == 0) & (codes[1:] != 0))])  # word number at each place
    places, buckets = [], []
    for ids, inside in grams(codes, SIZES, bits):
        at = np.flatnonzero(inside)
        places.append(starts[np.minimum(at + 1, len(codes) - 1)])
        buckets.append(ids[at])
    place, ids = np.concatenate(places), np.concatenate(buckets)
    order = np.argsort(place, kind="stable")
    return ids[order], np.bincount(place, minlength=int(starts[-1]) + 1)[1:]


def best_word(text: str | None, weights: np.ndarray, bias: float, bits: int) -> float:
    """The largest logit of a word's averaged n-gram vectors; the bias where there is no word."""
    best = -np.inf
    for codes in slices(letters(text or "")):
        total, count = np.zeros(len(codes)), np.zeros(len(codes), np.int32)
        for ids, inside in grams(codes, SIZES, bits):
            total[: len(ids)] += weights[ids] * inside
            count[: len(ids)] += inside
        # an n-gram belongs to the word that begins after the zero at or before its place
        starts = np.flatnonzero((codes[:-1] == 0) & (codes[1:] != 0))
        if len(starts):
            totals, counts = np.add.reduceat(total, starts), np.add.reduceat(count, starts)
            if counts.any():
                best = max(best, float((totals[counts > 0] / counts[counts > 0]).max()) + bias)
    return bias if best == -np.inf else best


class Model:
    """``weights``: each bucket's vector times the difference of the two classes' softmax rows."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int):
        self.weights, self.bias, self.bits = weights, bias, bits

    def score(self, text: str | None) -> float:
        logit = best_word(text, self.weights, self.bias, self.bits)
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(texts: list[str | None], toxic: list[int], settings: Settings = Settings()) -> Model:
    """Fit vectors and softmax together.

    A text is toxic through few of its words, so a text stands for its word of the largest logit
    (multiple-instance learning): rounds of choosing candidate words under the current model, each
    followed by Adam steps on the vectors of the chosen words and on the softmax rows. Words are first
    chosen by the log odds of their n-grams. With one class or no text the score is constant: the share of toxic
    texts, and a quarter without any label, so that nothing is called toxic for want of labels.
    """
    y = np.asarray(toxic, float)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.25
    start = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(1 << settings.bits, np.float32), start, settings.bits)
    ids_of: dict[bytes, int] = {}  # the n-grams of each different word, in the order they are met
    owners, members = [], []
    for i, text in enumerate(texts):
        mine = set()
        for codes in slices(letters(text or "")):
            ids, counts = _words(codes, settings.bits)
            packed, ends = ids.astype(np.int32).tobytes(), np.cumsum(counts) * 4
            for end, n in zip(ends.tolist(), counts.tolist()):
                if n:
                    mine.add(ids_of.setdefault(packed[end - 4 * n : end], len(ids_of)))
        owners.append(np.full(len(mine), i, np.int32))
        members.append(np.array(sorted(mine), np.int32))
    owner, member = np.concatenate(owners), np.concatenate(members)
    if not len(member):
        return Model(np.zeros(1 << settings.bits, np.float32), start, settings.bits)
    lengths = np.fromiter((len(k) // 4 for k in ids_of), np.int64, len(ids_of))
    flat = np.frombuffer(b"".join(ids_of), np.int32)
    del ids_of
    begins = np.concatenate([[0], np.cumsum(lengths)])
    parts = [(a, min(a + _PART, len(lengths))) for a in range(0, len(lengths), _PART)]  # few words at a time bound what is held

    def word_means(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(lengths), np.float32)
        for a, b in parts:
            out[a:b] = np.add.reduceat(values[flat[begins[a] : begins[b]]], begins[a:b] - begins[a]) / lengths[a:b]
        return out

    size = 1 << settings.bits
    seen = np.zeros((2, size))
    for label in (0, 1):
        chosen = np.bincount(member[y[owner] == label], minlength=len(lengths)).astype(np.float32)
        for a, b in parts:
            seen[label] += np.bincount(flat[begins[a] : begins[b]], np.repeat(chosen[a:b], lengths[a:b]), size)
    odds = np.log((seen[1] + 1) / (y.sum() + 2)) - np.log((seen[0] + 1) / ((1 - y).sum() + 2))
    rng = np.random.default_rng(settings.seed)
    vectors = rng.normal(0, 0.1, (size, settings.width)).astype(np.float32)
    rows = rng.normal(0, 0.3, (settings.width, 2)).astype(np.float32)
    bias = np.array([0.0, start], np.float32)
    held = [np.zeros_like(vectors), np.zeros_like(vectors), np.zeros_like(rows), np.zeros_like(rows), np.zeros(2), np.zeros(2)]
    step = 0
    logits = word_means(odds)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(settings.rounds):
        order = np.lexsort((-logits[member], owner))
        first = np.searchsorted(owner[order], np.arange(len(y)))
        rank = np.arange(len(order)) - first[owner[order]]
        kept = order[rank < settings.candidates]
        doc, word = owner[kept], member[kept]
        part = np.concatenate([np.arange(begins[w], begins[w] + lengths[w]) for w in word])
        ids, counts = flat[part], lengths[word]
        cuts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        unique, local = np.unique(ids, return_inverse=True)
        edges = np.searchsorted(doc, np.arange(len(y) + 1))
        full = edges[1:] > edges[:-1]
        for _ in range(settings.steps):
            step += 1
            own = vectors[unique]
            hidden = np.add.reduceat(own[local], cuts, axis=0) / counts[:, None]
            out = hidden @ rows + bias
            margin = out[:, 1] - out[:, 0]
            top = np.full(len(y), -np.inf)
            top[full] = np.maximum.reduceat(margin, edges[:-1][full])
            chosen = np.flatnonzero(margin == top[doc])
            chosen = chosen[np.unique(doc[chosen], return_index=True)[1]]
            probability = 1 / (1 + np.exp(-margin[chosen]))
            error = (probability - y[doc[chosen]]) * balance[doc[chosen]] / len(y)
            wide = np.stack([-error, error], axis=1)
            back = np.zeros(len(counts))
            back[chosen] = error
            spread = np.repeat(back / counts, counts)
            slope = np.bincount(local, spread, len(unique))
            grads = [
                slope[:, None] * (rows[:, 1] - rows[:, 0])[None] + settings.decay * own,
                hidden[chosen].T @ wide + settings.decay * rows,
                wide.sum(axis=0),
            ]
            for i, (target, grad, where) in enumerate(zip((vectors, rows, bias), grads, (unique, ..., ...))):
                first_m, second_m = held[2 * i], held[2 * i + 1]
                first_m[where] = 0.9 * first_m[where] + 0.1 * grad
                second_m[where] = 0.99 * second_m[where] + 0.01 * grad**2
                target[where] -= settings.rate * (first_m[where] / (1 - 0.9**step)) / (np.sqrt(second_m[where] / (1 - 0.99**step)) + 1e-8)
        logits = word_means(vectors @ (rows[:, 1] - rows[:, 0]))
    weights = (vectors @ (rows[:, 1] - rows[:, 0])).astype(np.float32)
    return Model(weights, float(bias[1] - bias[0]), settings.bits)


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold.

    At most ``per_class`` documents of each class and of at most ``max_chars`` characters are drawn. Labels of a
    document are joined by its key; null labels and texts are not drawn. Different texts under one key are drawn each by
    itself; equal rows are one.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).where("_toxic in (0, 1)").distinct()
    texts = documents.where(F.col("text").isNotNull() & (fold("doc_id", 5) != 0) & (F.length("text") <= settings.max_chars)).select("doc_id", "text", F.xxhash64("text").alias("_print"))
    # drawn by key and print alone; only the texts of the bounded draw leave the scan
    different = texts.select("doc_id", "_print").join(marked, "doc_id").distinct()
    keys = materialize(balanced_sample(different, "_toxic", settings.per_class, "doc_id", ties=["_print"]))
    found = texts.join(F.broadcast(keys), ["doc_id", "_print"]).dropDuplicates(["doc_id", "_print", "_toxic"])
    drawn = found.select("text", "_toxic").toPandas()  # a row for each key drawn
    drawn = drawn.sort_values(["_toxic", "text"], kind="stable")
    return train(drawn["text"].tolist(), drawn["_toxic"].tolist(), settings)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``toxicity`` (double): the likelihood of the toxic class for each whole text.

    Empty and null texts, and texts without a letter, get the score of the bias alone. Rows are kept as
    they are, repeats included.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: one weight per bucket
    schema = T.StructType([*documents.drop("toxicity").schema.fields, T.StructField("toxicity", T.DoubleType())])
    def mapped(batches):
        known = shared.value
        for batch in batches:
            scores = pa.array([known.score(x) for x in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "toxicity"])

    return documents.drop("toxicity").mapInArrow(mapped, schema)


def toxicity(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    ``held_out`` documents (crc32 of the key modulo 5 is 0) take no part in training. A null key is held
    out or not as the empty text is. An empty table gives an empty result.
    """
    model = fit(documents, labels, settings)
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
