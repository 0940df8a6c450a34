"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (FTRL-proximal) under an elastic-net penalty and calibrated
with one temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagscope.llm.base import balanced_sample, fold, small_batches
from bagscope.llm.ngrams import grams, letters, slices

SIZES = (1, 2, 3)
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the training sample; a sampled row is at most 2**bits counts, however long its text."""

    per_class: int = 600
    bits: int = 15
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.001
    l2: float = 0.0005
    seed: int = 7


def counts(text: str | None, bits: int) -> np.ndarray:
    """How often each n-gram bucket occurs in the whole text."""
    total = np.zeros(1 << bits, np.int64)
    for codes in slices(letters(text or "")):
        for ids, inside in grams(codes, SIZES, bits):
            total += np.bincount(ids[inside], minlength=1 << bits)
    return total


def tfidf(ids: np.ndarray, found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic counts times inverse document frequency, of unit length."""
    values = (1 + np.log(found)) * idf[ids]
    length = np.sqrt((values**2).sum())
    return values / length if length else values


class Model:
    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float, bits: int):
        self.classes, self.weights, self.bias, self.idf = classes, weights, bias, idf
        self.temperature, self.bits = temperature, bits

    def predict(self, text: str | None) -> tuple[str, float]:
        total = counts(text, self.bits) if text and self.classes else np.zeros(0)
        ids = np.flatnonzero(total)
        if not len(ids):
            return UNDETERMINED, 0.0
        p = softmax((tfidf(ids, total[ids], self.idf) @ self.weights[ids] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, size: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after online passes: per-coordinate rates, soft-thresholded by l1, shrunk by l2."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))  # the last row is the bias

    def solved(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(0, np.abs(zi) - s.l1)
        return -shrunk / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2)

    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            ids, values = rows[i]
            at = np.append(ids, size)
            x = np.append(values, 1.0)
            w = solved(z[at], n[at])
            error = softmax(x @ w)
            error[y[i]] -= 1
            grad = x[:, None] * error[None]
            grown = n[at] + grad**2
            z[at] += grad - (np.sqrt(grown) - np.sqrt(n[at])) / s.alpha * w
            n[at] = grown
    w = solved(z, n)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least cross-entropy on rows that were not trained on."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(10), 120))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def document_frequencies(documents: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """The number of texts and, for each bucket, of texts that hold it, over all rows given."""
    small_batches(documents.sparkSession)

    def mapped(batches):
        seen, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += counts(text, bits) > 0
                rows += 1
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(ids, -1), "n": np.append(seen[ids], rows)})

    parts = documents.select("text").mapInArrow(mapped, "bucket long, n long")
    total = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2**bits + 1 rows
    found = np.zeros(1 << bits, np.int64)
    real = total[total["bucket"] >= 0]
    found[real["bucket"].to_numpy(np.int64)] = real["n"].to_numpy(np.int64)
    return int(total.loc[total["bucket"] < 0, "n"].sum()), found


def fit(documents: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from text and non-null language of the documents outside the held-out fold.

    Document frequencies are counted over all of them; the regression takes at most ``per_class`` of each
    language, of which every fifth is kept back for the temperature.
    """
    small_batches(documents.sparkSession)
    rows = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", 4) != 2)).select("doc_id", "text", "lang")
    n, found = document_frequencies(rows, settings.bits)
    idf = np.log((1 + n) / (1 + found)) + 1
    bits = settings.bits

    def mapped(batches):
        for batch in batches:
            columns: dict[str, list] = {"lang": [], "ids": [], "found": []}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                total = counts(text, bits)
                ids = np.flatnonzero(total)
                columns["lang"].append(lang)
                columns["ids"].append(ids.astype(np.int32))
                columns["found"].append(total[ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns["lang"], pa.string()), pa.array(columns["ids"], pa.list_(pa.int32())), pa.array(columns["found"], pa.list_(pa.int64()))],
                names=list(columns),
            )

    drawn = balanced_sample(rows, "lang", settings.per_class, "doc_id", "text").select("text", "lang")
    drawn = [r for r in drawn.mapInArrow(mapped, "lang string, ids array<int>, found array<bigint>").toPandas().itertuples(index=False) if len(r.ids)]
    drawn.sort(key=lambda r: (r.lang, np.asarray(r.ids).tobytes(), np.asarray(r.found).tobytes()))
    classes = sorted({r.lang for r in drawn})
    y = np.array([classes.index(r.lang) for r in drawn], int)
    vectors = [(np.asarray(r.ids), tfidf(np.asarray(r.ids), np.asarray(r.found), idf)) for r in drawn]
    back = np.arange(len(drawn)) % 5 == 0
    learn = [v for v, b in zip(vectors, back) if not b]
    weights, bias = ftrl(learn, y[~back], max(1, len(classes)), 1 << bits, settings)
    logits = np.array([v @ weights[i] + bias for (i, v), b in zip(vectors, back) if b])
    return Model(classes, weights.astype(np.float32), bias, idf, temperature(logits, y[back]), bits)


def languages(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    ``held_out`` documents (crc32 of the key modulo 4 is 2) are not learned from. A null text, an empty
    one, or one without a letter is ``und`` with score 0, and so is every text where nothing could be
    learned. Rows are kept as they are, repeats included.
    """
    spark = documents.sparkSession
    model = fit(documents, settings)
    shared = spark.sparkContext.broadcast(model)  # fixed size: 2**bits weights for each language

    def mapped(batches):
        known = shared.value
        for batch in batches:
            found = [known.predict(x) for x in batch.column("text").to_pylist()]
            names, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, scores], names=["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(mapped, f"doc_id {kind}, lang_pred string, score double")
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
