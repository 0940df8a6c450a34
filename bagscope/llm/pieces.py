"""SentencePiece encoding and decoding by a batched numpy Viterbi pass over a given model file.

Texts are cut into words at the marks that stand for spaces; words of equal length advance together, hashes of
their substrings probe the sorted keys of the pieces, and a vectorised maximum stores backpointers. In a
unigram model the maximum is over summed scores. A model built by merges (BPE) encodes differently from the
best sum of its scores, so there the pass only takes steps between pieces that are compatible: pieces whose
joined text the merges would cut into just these two. A sequence of pieces in which all neighbours are
compatible is the one that the merges give, so the result equals that of the merges exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bagscope.llm.base import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581  # stands for a space
#: Code points that one pass handles; a single longer text is one pass.
CHUNK = 2 << 20
#: Pairs of pieces whose compatibility an encoder remembers.
MEMORY = 4 << 20
#: Words whose pieces an encoder remembers; past that it begins anew.
WORDS = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(codes: np.ndarray) -> np.ndarray:
    value = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (value ^ (value >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Vocabulary:
    """Pieces and scores of a model file; of fixed size, so it can be broadcast."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray  # 0 text, 1 byte, 2 control or unknown
    merges: bool
    unknown: int

    @staticmethod
    def load(path: str = MODEL, merges: bool = True) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = [2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else int(model.is_byte(i)) for i in ids]
        return Vocabulary([model.id_to_piece(i) for i in ids], np.array([model.get_score(i) for i in ids]), np.array(kinds, np.int8), merges, model.unk_id())


class Encoder:
    """Encodes and decodes lists of texts; holds what it has learned of compatible pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        self.score_of = {p: float(s) for p, s, k in zip(v.pieces, v.scores, v.kinds) if k == 0}
        self.byte_ids = np.full(256, v.unknown, np.int32)
        for i in np.flatnonzero(v.kinds == 1):
            self.byte_ids[int(v.pieces[i][3:5], 16)] = i
        usable = [i for i in np.flatnonzero(v.kinds == 0).tolist() if not v.merges or len(self.merged(v.pieces[i])) == 1]
        self.whole = {v.pieces[i] for i in usable}  # a text that is one of these merges to one piece
        self.longest = max((len(v.pieces[i]) for i in usable), default=1)
        powers = _powers(self.longest)
        keys = np.array([(_mixed(_codes(v.pieces[i])) * powers[: len(v.pieces[i])]).sum(dtype=np.uint64) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ids = np.append(np.array(usable, np.int32)[order], np.int32(-1))
        slots = np.arange(1 << _SLOTS, dtype=np.uint64) << np.uint64(64 - _SLOTS)
        self.first = np.searchsorted(self.keys[:-1], slots).astype(np.int32)
        crowd = np.bincount((self.keys[:-1] >> np.uint64(64 - _SLOTS)).astype(np.int64), minlength=1)
        self.crowd = int(crowd.max()) if len(usable) else 1
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.slot_keys, self.slot_ok = np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, bool)
        self._forget_words()
        self.text_of = [p.replace("▁", " ").encode("utf-8", "surrogatepass") if k == 0 else b"" for p, k in zip(v.pieces, v.kinds)]
        for i in np.flatnonzero(v.kinds == 1):
            self.text_of[i] = bytes([int(v.pieces[i][3:5], 16)])

    def _forget_words(self) -> None:
        self.word_keys, self.word_begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.word_counts, self.word_flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by its merges: best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score_of.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where no piece has the hash."""
        start = self.first[(keys >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        found = np.full(keys.shape, -1, np.int32)
        for step in range(self.crowd):
            at = np.minimum(start + step, len(self.keys) - 1)
            np.copyto(found, self.ids[at], where=self.keys[at] == keys)
        return found

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging left + right gives just these pieces; unknown characters (negative) never merge."""
        ok = np.ones(len(left), bool)
        known = (left >= 0) & (right >= 0)
        keys = left[known].astype(np.int64) * len(self.vocabulary.pieces) + right[known]
        slots = ((keys.astype(np.uint64) * _P) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        answer = self.slot_ok[slots]
        missed = np.flatnonzero(self.slot_keys[slots] != keys)
        if len(missed):
            answer[missed] = self._looked_up(keys[missed])
            self.slot_keys[slots[missed]], self.slot_ok[slots[missed]] = keys[missed], answer[missed]
        ok[known] = answer
        return ok

    def _looked_up(self, keys: np.ndarray) -> np.ndarray:
        """Compatibility of pairs (left * pieces + right) from all that was worked out so far, or anew."""
        at = np.searchsorted(self.pair_keys, keys)
        new = np.ones(len(keys), bool) if not len(self.pair_keys) else self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] != keys
        if new.any():
            pieces, n = self.vocabulary.pieces, len(self.vocabulary.pieces)
            if len(self.pair_keys) > MEMORY:  # only what was learned goes; it is worked out again when met
                self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
                new = np.ones(len(keys), bool)
            fresh = np.unique(keys[new])
            answers = []
            for k in fresh.tolist():
                a, b = pieces[k // n], pieces[k % n]
                answers.append(a + b not in self.whole and self.merged(a + b) == [a, b])
            together = np.concatenate([self.pair_keys, fresh])
            order = np.argsort(together, kind="stable")
            self.pair_keys, self.pair_ok = together[order], np.concatenate([self.pair_ok, np.array(answers, bool)])[order]
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_ok[at]

    def _viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length (rows of code points), flat, and their number for each word.

        An unknown character is the negative of its code point, less one.
        """
        m, n = words.shape
        prefix = np.zeros((m, n + 1), np.uint64)
        powers = _powers(n + 1)
        np.cumsum(_mixed(words) * powers[:n], axis=1, dtype=np.uint64, out=prefix[:, 1:])
        merges, scores, none = self.vocabulary.merges, self.vocabulary.scores, np.int32(-0x7FFFFFFF)
        # the hash of a substring times the power of its place; keys are taken back to place 0
        back = np.ones(n + 1, np.uint64)
        back[1:] = np.uint64(pow(int(_P), -1, 1 << 64))
        back = np.multiply.accumulate(back)
        by_size = []
        for size in range(1, min(n, self.longest) + 1):
            found = self._probe((prefix[:, size:] - prefix[:, : n + 1 - size]) * back[None, : n + 1 - size])
            if size == 1:
                found = np.where(found < 0, -1 - words.astype(np.int32), found)
            else:
                found = np.where(found < 0, none, found)
            by_size.append(found)
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        piece = np.full((m, n + 1), none, np.int32)
        length = np.zeros((m, n + 1), np.int32)
        least = float(scores.min()) - 10.0 if len(scores) else -10.0
        for end in range(1, n + 1):
            sizes = min(end, self.longest)
            ids = np.stack([by_size[s - 1][:, end - s] for s in range(1, sizes + 1)], axis=1)
            row, at = np.nonzero(ids != none)
            start = end - 1 - at
            chosen = ids[row, at]
            if merges:
                prior = piece[row, start]
                reached = (start == 0) | (prior != none)
                gain = np.full(len(row), -np.inf)
                inner = np.flatnonzero(reached & (start > 0))
                gain[reached & (start == 0)] = 1.0
                gain[inner[self._compatible(prior[inner], chosen[inner])]] = 1.0
            else:
                gain = best[row, start] + np.where(chosen >= 0, scores[np.maximum(chosen, 0)], least)
            value = np.full((m, sizes), -np.inf)
            value[row, at] = gain
            top = value.argmax(axis=1)  # of equal sums the shortest piece
            rows = np.arange(m)
            best[:, end] = value[rows, top]
            reached = best[:, end] > -np.inf
            piece[:, end] = np.where(reached, ids[rows, top], none)
            length[:, end] = top + 1
        steps, place, rows = [], np.full(m, n), np.arange(m)
        while len(rows):
            here = place[rows]
            steps.append((rows, piece[rows, here]))
            place[rows] = here - length[rows, here]
            rows = rows[place[rows] > 0]
        counts = np.bincount(np.concatenate([r for r, _ in steps]), minlength=m)
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]), np.int32)
        for k, (r, p) in enumerate(steps):
            flat[ends[r] - 1 - k] = p
        return flat, counts

    def _bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters replaced by the ids of their bytes, or by the unknown id where there are none."""
        lost = np.flatnonzero(flat < 0)
        if not len(lost):
            return flat, counts
        has_bytes = (self.byte_ids != self.vocabulary.unknown).all()
        parts = [self.byte_ids[list(chr(-int(flat[i]) - 1).encode("utf-8", "surrogatepass"))] if has_bytes else np.array([self.vocabulary.unknown], np.int32) for i in lost]
        sizes = np.ones(len(flat), np.int64)
        sizes[lost] = [len(p) for p in parts]
        owner = np.repeat(np.arange(len(counts)), counts)
        out = np.repeat(flat, sizes)
        begins = np.cumsum(sizes) - sizes
        for i, p in zip(lost, parts):
            out[begins[i] : begins[i] + len(p)] = p
        return out, np.bincount(owner, sizes, len(counts)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has. Equal words are encoded once,
        and words met in earlier calls are looked up."""
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        sizes = np.array([len(t) for t in marked], np.int64)
        codes = _codes("".join(marked))
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        is_mark = codes == MARK
        begin = is_mark.copy()
        begin[1:] &= ~is_mark[:-1]
        begin[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.append(starts, len(codes)))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes) * _powers(len(codes)), dtype=np.uint64, out=sums[1:])
        inverse = np.full(len(codes) + 1, np.uint64(pow(int(_P), -1, 1 << 64)))
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        keys = (sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64) * _P
        unique, first, word = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.word_keys) > WORDS:
            self._forget_words()
        at = np.searchsorted(self.word_keys, unique)
        met = np.zeros(len(unique), bool)
        if len(self.word_keys):
            met = self.word_keys[np.minimum(at, len(self.word_keys) - 1)] == unique
        fresh = np.flatnonzero(~met)
        parts, members = [self.word_flat], []
        fresh_counts = np.zeros(len(fresh), np.int64)
        of_length = lengths[first[fresh]]
        order = np.argsort(of_length, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(of_length[order])) + 1) if len(order) else ():
            n = int(of_length[group[0]])
            step = max(1, (1 << 21) // n)
            for i in range(0, len(group), step):
                own = group[i : i + step]
                flat, counts = self._bytes(*self._viterbi(codes[starts[first[fresh[own]]][:, None] + np.arange(n)[None]]))
                parts.append(flat)
                members.append(own)
                fresh_counts[own] = counts
        flat = np.concatenate(parts)
        fresh_begin = np.empty(len(fresh), np.int64)
        if members:
            by_place = np.concatenate(members)
            fresh_begin[by_place] = len(self.word_flat) + np.cumsum(fresh_counts[by_place]) - fresh_counts[by_place]
        word_begin, word_counts = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        word_begin[met], word_counts[met] = self.word_begin[at[met]], self.word_counts[at[met]]
        word_begin[fresh], word_counts[fresh] = fresh_begin, fresh_counts
        together = np.concatenate([self.word_keys, unique[fresh]])
        order = np.argsort(together, kind="stable")
        self.word_keys, self.word_flat = together[order], flat
        self.word_begin = np.concatenate([self.word_begin, fresh_begin])[order]
        self.word_counts = np.concatenate([self.word_counts, fresh_counts])[order]
        each = word_counts[word]
        ends = np.cumsum(each)
        ids = flat[np.repeat(word_begin[word] - (ends - each), each) + np.arange(int(ends[-1]))]
        text_of = np.searchsorted(np.cumsum(sizes), starts, side="right")
        return ids, np.bincount(text_of, each, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, without the space that encoding puts first."""
        parts = self.text_of
        text = b"".join([parts[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_ENCODERS: dict[int, Encoder] = {}


def encoded(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """``documents`` with ``ids`` (array of int), ``n_tokens`` and ``round_trip`` of every whole text.

    ``round_trip`` tells whether decoding gives the text back; it is false only for texts that hold the space
    mark itself. Null and empty texts have no ids and the round trip of an empty text. Columns of these
    names are replaced; rows are kept as they are. The vocabulary is read on the driver and broadcast.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))
    own = documents.drop("ids", "n_tokens", "round_trip")
    schema = T.StructType([*own.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])

    def mapped(batches):
        encoder = _ENCODERS.get(0)
        if encoder is None or encoder.vocabulary.pieces != shared.value.pieces:
            encoder = _ENCODERS[0] = Encoder(shared.value)

        def done(held):
            batch = pa.Table.from_batches(held).combine_chunks()
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids, counts = encoder.encode(texts)
            offsets = np.append(0, np.cumsum(counts))
            same = [encoder.decode(ids[offsets[i] : offsets[i + 1]]) == t for i, t in enumerate(texts)]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            out = batch.append_column("ids", lists).append_column("n_tokens", pa.array(counts.astype(np.int32))).append_column("round_trip", pa.array(same))
            yield from out.to_batches()

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                yield from done(held)
                held, size = [], 0
        if held and sum(b.num_rows for b in held):
            yield from done(held)

    return own.mapInArrow(mapped, schema)


def tokens(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every document."""
    return encoded(documents.select("doc_id", "text"), path).select("doc_id", "n_tokens", "ids", "round_trip")
