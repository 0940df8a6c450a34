"""Sequence embeddings by batched inference with an encoder of the caller's choice."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagscope.functions.text import MAX_TOKENS, truncate_for_encoder
from bagscope.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, measured_size
from bagscope.session import materialize

# workers get the functions below by value and need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ID = "repertoire_id"
BATCH_SIZE = 128  # fixed value: sequences per inference call

Encoder = Callable[[np.ndarray], dict[str, np.ndarray]]

POOLINGS = ("cls", "mean", "max")
VECTORS = T.StructType([T.StructField(name, T.ArrayType(T.FloatType())) for name in POOLINGS])


def hashed_residue_encoder(width: int = 32) -> Encoder:
    """A deterministic stand-in for a pretrained model: each residue and its neighbours hash to a token
    vector, and the three token poolings are taken over them. Load a real model here instead."""

    def token(window: str) -> np.ndarray:
        return np.random.default_rng(zlib.crc32(window.encode())).standard_normal(width).astype("float32")

    known: dict[str, np.ndarray] = {}

    def encode(batch: np.ndarray) -> dict[str, np.ndarray]:
        first, means, maxima = [], [], []
        for text in batch:
            text = "" if text is None else str(text)
            windows = [text[max(i - 1, 0) : i + 2] for i in range(len(text))]
            for window in ["^" + text[:2], *windows]:
                if window not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[window] = token(window)
            tokens = np.stack([known[w] for w in windows]) if windows else np.zeros((1, width), "float32")
            first.append(known["^" + text[:2]])
            means.append(tokens.mean(axis=0))
            maxima.append(tokens.max(axis=0))
        return {"cls": np.stack(first), "mean": np.stack(means), "max": np.stack(maxima)}

    return encode


def embed_distinct(
    sequences: DataFrame, make_encoder: Callable[[], Encoder] = hashed_residue_encoder, batch_size: int = BATCH_SIZE,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """(encoder_input, cls, mean, max) for every distinct sequence, cut to the encoder's limit.

    ``make_encoder`` runs once per Python worker, so a model is loaded there and nowhere else.
    """
    inputs = sequences.where(F.col("junction_aa").isNotNull()).select(
        truncate_for_encoder(F.col("junction_aa"), max_tokens).alias("encoder_input")
    )
    return _embedded(inputs.distinct(), make_encoder, batch_size).select("encoder_input", *POOLINGS)


def _embedded(texts: DataFrame, make_encoder: Callable[[], Encoder], batch_size: int) -> DataFrame:
    infer = predict_batch_udf(make_encoder, return_type=VECTORS, batch_size=batch_size)
    return texts.withColumn("v", infer("encoder_input")).select("*", "v.*").drop("v")


def embed_sequences(
    sequences: DataFrame, make_encoder: Callable[[], Encoder] = hashed_residue_encoder, batch_size: int = BATCH_SIZE,
    by: Sequence[str] = ("repertoire_id",), max_tokens: int = MAX_TOKENS, poolings: Sequence[str] = POOLINGS,
) -> DataFrame:
    """(by .., copies, poolings ..): the vectors of each distinct input of a repertoire and how often it occurs.

    ``poolings`` are the token poolings wanted, of cls, mean and max; no others are stored. Each distinct text is embedded once, and vectors are joined to counted inputs, not to every occurrence;
    pool them with ``copies``. Null sequences have no vectors. Where not all vectors can be broadcast, those of the
    commonest texts are, and stay where their repertoires are counted; the other rows come back together by ``by`` after
    their join, so that pooling combines a repertoire's rows before it sends anything.
    """
    keyed = sequences.where(F.col("junction_aa").isNotNull()).withColumn(
        "encoder_input", truncate_for_encoder(F.col("junction_aa"), max_tokens)
    )
    counted = materialize(keyed.groupBy(*by, "encoder_input").agg(F.count(F.lit(1)).alias("copies")))
    texts = counted.groupBy("encoder_input").agg(F.count(F.lit(1)).alias("__n"))
    vectors = materialize(_embedded(texts, make_encoder, batch_size).select("encoder_input", "__n", *poolings))
    return _with_vectors(counted, vectors, by).drop("encoder_input", "__n")


def _with_vectors(counted: DataFrame, vectors: DataFrame, by: Sequence[str], rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``counted`` (by .., encoder_input, copies) with the vectors of its inputs, of which ``__n`` rows hold each; both are stored."""
    n, held = measured_size(vectors)
    if n <= rows and held <= size:
        return counted.join(F.broadcast(vectors), "encoder_input")
    least = _cut_off(vectors, min(rows, size * n // held))
    frequent = materialize(vectors.where(F.col("__n") >= least))  # as many rows as can be broadcast
    near = counted.join(F.broadcast(frequent), "encoder_input")
    rare = counted.join(F.broadcast(frequent.select("encoder_input")), "encoder_input", "left_anti")
    return near.unionByName(rare.join(vectors.where(F.col("__n") < least), "encoder_input").hint("rebalance", *by))


def _cut_off(frequency: DataFrame, wanted: int) -> int:
    """The least ``__n`` that at most ``wanted`` rows reach, to within an eighth of a doubling."""
    step = F.floor(F.log2("__n") * 8).alias("step")
    steps = frequency.groupBy(step).agg(F.count(F.lit(1)).alias("rows"), F.min("__n").alias("least"))
    least, total = 1 << 62, 0
    for r in steps.orderBy(F.desc("step")).toLocalIterator():  # some hundred rows
        total += r["rows"]
        if total > wanted:
            break
        least = r["least"]
    return least
