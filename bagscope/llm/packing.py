"""Best-fit packing of documents into sequences, certified by dual-feasible functions and repacked where gaps are left.

Pieces of documents are dealt into partitions of bounded size and like lengths, and each partition packs its own by best-fit
decreasing. A dual-feasible function maps lengths to shares such that no full sequence holds shares of more than 1, so
their sum is a lower bound of the sequences that any packing needs. A partition whose packing meets its bound is
certified. Where sequences are left with a gap, their documents are exchanged: the sequences of neighbouring partitions
with the greatest gaps are opened, their pieces are packed together, and so on over ever fewer partitions.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagscope.llm.base import small_batches
from bagscope.operators.ranking import ordered_index
from bagscope.session import materialize

#: Words, and parts of words, that a worker remembers; past that it begins anew.
WORDS, PARTS = 1 << 19, 1 << 20
#: Bytes of text whose new words are encoded together; a single longer text is handled alone.
CHUNK = 2 << 20
# Letters of two bytes that stay letters when case is lowered, and how the tokenizer cuts texts (fixed values).
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc9][\x80-\xbf]"
_PARTS = re.compile(
    rb"(?>(?:[^\s\x80-\xff]+|" + _LATIN + rb")*)[\x80-\xff]\S*"  # a word with any other character
    rb"|'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]+|" + _LATIN + rb")+|[0-9]|[^a-z0-9\s\x80-\xff]+"
)
_ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\s]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Settings:
    """``pieces`` are packed by one task; ``fan`` partitions exchange documents; each opens ``opened`` sequences, and
    as many more for each sequence that its packing is over the bound."""

    capacity: int = 4096
    end: int = 1
    pieces: int = 8192
    fan: int = 16
    opened: int = 4


# ---- tokens


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def _word_keys(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and a 64-bit key of every word between ASCII spaces: sums of random letters times powers, taken back to place 0."""
    codes = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACES[codes], [True]])))
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(16, len(codes).bit_length())
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_letters()[codes] * _powers(size, _BASE)[: len(codes)], out=sums[1:])
    back = _powers(size, pow(_BASE, -1, 1 << 64))
    return starts, ends, (sums[ends] - sums[starts]) * back[starts]


class WordIds:
    """Ids of whole texts as little-endian bytes, by a tokenizer that lowers case, drops white space and cuts texts into parts first.

    Words between ASCII spaces are encoded once while they are remembered, and so are the parts that the tokenizer cuts
    them into. Words with characters other than ASCII and Latin letters are not cut; texts that hold a special token are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, new: list[bytes]) -> None:
        """Encode new parts together. Each closes with a token that ends a word; where the numbers differ, one by one."""
        for i in range(0, len(new), 20_000):
            some = [p.decode("utf-8", "replace") for p in new[i : i + 20_000]]
            single = [k for k, p in enumerate(some) if p.isascii() or p.isalpha()]
            ids = np.array(self.tokenizer.encode(" ".join([some[k] for k in single]), add_special_tokens=False).ids, "<u4")
            last = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(last) != len(single):
                single, last = [], []
            flat = ids.tobytes()
            self.parts.update((new[i + k], flat[4 * a : 4 * b]) for k, a, b in zip(single, [0, *last], last))
            other = sorted(set(range(len(some))) - set(single))
            self.parts.update(zip([new[i + k] for k in other], self._ids([some[k] for k in other])))

    def _learn(self, words: set[bytes]) -> None:
        cut = [(w, (_ASCII_PARTS if w.isascii() else _PARTS).findall(w)) for w in words]
        if len(self.parts) > PARTS:
            self.parts.clear()
        parts = self.parts
        new = {p for _, own in cut for p in own if p not in parts}
        self._learn_parts(list(new))
        self.words.update((w, parts[own[0]] if len(own) == 1 else b"".join([parts[p] for p in own])) for w, own in cut)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        lowered = [(t or b"").lower() for t in texts]
        whole = [i for i, t in enumerate(lowered) if any(x in t for x in self.special)]
        for i in whole:
            lowered[i] = b""
        joined = b" ".join(lowered)
        starts, ends, keys = _word_keys(joined)
        # each different word of the batch is looked up once
        _, first, word = np.unique(keys, return_index=True, return_inverse=True)
        own = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.words) > WORDS:
            self.words.clear()
        self._learn({w for w in own if w not in self.words})
        ids_of = [self.words[w] for w in own]
        sizes = np.array([len(x) for x in ids_of], np.int64) // 4
        flat = np.frombuffer(b"".join(ids_of), "<u4")
        each = sizes[word]
        at = np.repeat((np.cumsum(sizes) - sizes)[word] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        ids = flat[at].tobytes()
        begins = np.cumsum([0, *[len(t) + 1 for t in lowered]])
        through = np.append(0, np.cumsum(each))[np.searchsorted(starts, begins)] * 4
        out = [ids[a:b] for a, b in zip(through[:-1].tolist(), through[1:].tolist())]
        for i, other in zip(whole, self._ids([texts[i].decode("utf-8", "replace") for i in whole])):
            out[i] = other
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordIds:
    """The encoder of this worker. Tasks call it by name: what they would carry along themselves, each would begin anew."""
    return WordIds(path)


def pieces(documents: DataFrame, path: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, row, piece, start, length and ids_crc32 of the pieces of every document.

    A document is its ids and the closing id; only one of more than ``capacity`` ids is cut, and only its last piece
    may be shorter. ``row`` numbers the rows, so that repeated and null keys stay apart. Null and empty texts are
    the closing id alone.
    """
    path = path or tokenizer_path()
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))
    fields = [("row", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, t) for n, t in fields]])
    arrow = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    closing, width = np.array([settings.end], "<u4").tobytes(), 4 * settings.capacity

    def mapped(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words = encoder(path)

        def done(held):
            batch = pa.Table.from_batches(held).combine_chunks()
            numbers = batch.column("row").to_pylist()
            owner, out = [], []
            for i, ids in enumerate(words.encode(batch.column("text").to_pylist())):
                ids += closing
                for k in range(0, len(ids), width):
                    cut = ids[k : k + width]
                    owner.append(i)
                    out.append((numbers[i], k // width, k // 4, len(cut) // 4, zlib.crc32(cut)))
            keys = batch.column("doc_id").take(pa.array(owner)).combine_chunks()
            columns = [pa.array(c, t) for c, t in zip(zip(*out), arrow)]
            yield from pa.Table.from_arrays([keys, *columns], names=["doc_id", *[n for n, _ in fields]]).to_batches()

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                yield from done(held)
                held, size = [], 0
        if held and sum(b.num_rows for b in held):
            yield from done(held)

    return rows.mapInArrow(mapped, schema)


# ---- bounds and packing of one partition


def dual_feasible(capacity: int) -> np.ndarray:
    """One row for each function, one share for each length (0 .. capacity): lengths that fit together have shares of 1 at most.

    Three families: the length itself (threshold 0); for each threshold e, lengths below it count nothing and those
    above capacity - e a whole sequence; and for each k, shares rounded down to k-ths of k + 1.
    """
    x = np.arange(capacity + 1, dtype=np.int64)[None]
    e = np.arange(capacity // 2 + 1)[:, None]
    thresholds = np.where(x > capacity - e, 1.0, np.where(x >= e, x / capacity, 0.0))
    k = np.arange(1, 65)[:, None]
    rounded = np.where(x * (k + 1) % capacity == 0, x / capacity, x * (k + 1) // capacity / k)
    return np.concatenate([thresholds, rounded])


def bound(counts: np.ndarray, capacity: int) -> tuple[int, np.ndarray]:
    """The lower bound of the sequences for ``counts`` pieces of each length, and the function that gives it.

    The slack in rounding up covers the rounding of sums of shares.
    """
    functions = dual_feasible(capacity)
    values = functions @ counts
    best = int(values.argmax())
    return math.ceil(float(values[best]) - 1e-6), functions[best]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece by best-fit decreasing.

    Sequences are kept by the room they have; the bits of one whole number tell which rooms there are, so the
    tightest room that holds a piece is its lowest bit from the piece's length on.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, number = 0, 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = bits >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                bits ^= 1 << room
        else:
            room, own = capacity, number
            number += 1
        bins[i], offsets[i] = own, capacity - room
        left = room - length
        if left:
            rooms[left].append(own)
            bits |= 1 << left
    return bins, offsets


def _packed(lengths: np.ndarray, shares: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, offsets, and for each piece whether its bin is opened again.

    Each bin holds shares of 1 at most, and what is left of it is its gap. Without gaps the number of bins is
    certified: no other packing of these pieces, with whatever others, needs fewer for them. Else the bins with the
    greatest gaps are opened, ``opened`` for the rounding and as many for each whole bin of gaps.
    """
    bins, offsets = best_fit(lengths, settings.capacity)
    gaps = 1 - np.bincount(bins, shares[lengths])
    widest = np.argsort(-gaps, kind="stable")[: settings.opened * (1 + math.ceil(gaps.sum() - 1e-6))]
    return bins, offsets, np.isin(bins, widest[gaps[widest] > 1e-9]) & (gaps.sum() > 1e-6)


def length_counts(rows: DataFrame, capacity: int) -> np.ndarray:
    """The number of pieces of each length; at most capacity + 1 numbers reach the driver."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().toLocalIterator():
        counts[length] = n
    return counts


def pack(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rows`` (with row, piece and length) with sequence_id and offset: as few sequences of ``capacity`` as found.

    Pieces are dealt over partitions in turns, forth and back, in the order of their lengths: every partition gets as
    many, and of each length its share, so that none lacks the short ones that fill the gaps of the others. The function
    that bounds all pieces best certifies the partitions' packings; those with a gap open the sequences with the
    greatest gaps, ``fan`` of them pack what they opened together, and so on until one partition is left or none has a
    gap. Each round is a written table, a small part of the one before. Sequence ids are of the round, the partition
    and the place in it; offsets have no gaps.
    """
    counts = length_counts(rows, settings.capacity)
    shares = bound(counts, settings.capacity)[1]
    parts = max(1, -(-int(counts.sum()) // settings.pieces))
    turn, place = F.floor(F.col("place") / parts), F.col("place") % parts
    part = F.when(turn % 2 == 0, place).otherwise(parts - 1 - place).cast("bigint")
    left = ordered_index(rows, [F.col("length"), F.xxhash64("row", "piece")], "place").withColumn("part", part).drop("place")
    schema = T.StructType([*left.schema.fields, *[T.StructField(n, T.LongType()) for n in ("bin", "offset")], T.StructField("open", T.BooleanType())])

    def packed(frame):
        import pandas as pd

        bins, offsets, opened = _packed(frame["length"].to_numpy(), shares, settings)
        return pd.concat([frame.reset_index(drop=True), pd.DataFrame({"bin": bins, "offset": offsets, "open": opened})], axis=1)

    done, level = [], 0
    while True:
        placed = materialize(left.groupBy("part").applyInPandas(packed, schema))
        number = (F.lit(level) * (1 << 56) + F.col("part") * (1 << 24) + F.col("bin")).alias("sequence_id")
        last = parts == 1
        kept = placed if last else placed.where("not open")
        done.append(kept.select(*rows.columns, number, "offset"))
        opened = placed.where("open").drop("bin", "offset", "open")
        if last or opened.isEmpty():
            break
        parts, level = -(-parts // settings.fan), level + 1
        left = opened.withColumn("part", F.floor(F.col("part") / settings.fan).cast("bigint"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def certificate(rows: DataFrame, settings: Settings = Settings()) -> int:
    """The lower bound of the sequences for all pieces of a table with ``length``."""
    return bound(length_counts(rows, settings.capacity), settings.capacity)[0]


def packing(documents: DataFrame, path: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    ``ids_crc32`` is that of the piece's ids as little-endian unsigned 32-bit numbers. Null and empty texts are
    pieces of one id; repeated rows and null keys are packed each; an empty table gives none; other columns are
    not looked at.
    """
    rows = materialize(pieces(documents, path, settings))
    return pack(rows, settings).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
