"""Alignment of two tokenizers over the same bytes by merge-path partitioning.

The ends of A tokens and of B tokens, counted in bytes, are two sorted lists, and a walk that merges them meets every
pair of tokens whose byte ranges overlap. A binary search on each of many diagonals of the merge cuts the walk into
pieces of equal work, whatever the texts' lengths. The pieces are independent: they step side by side and emit one
overlap a step. A group closes where both lists end at once; a group that crosses a piece's border is stitched from
the number of closings before it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagscope.llm.base import small_batches
from bagscope.operators.joins import lookup_join
from bagscope.session import materialize

#: Steps of the merge in one piece.
WORK = 256
#: Bytes of text that are aligned together; a single longer text is handled alone.
CHUNK = 2 << 20
#: Words whose tokens a worker remembers; past that it begins anew.
WORDS = 1 << 18
#: White space other than the ASCII kinds (fixed values). Texts that hold any are not cut into words.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Words with the spaces before them. What stands behind other white space belongs to the word before, like a text's last spaces.
_WORDS = re.compile(r" *[^ ]+(?:(?<=[\t-\r]) +[^ ]*)*(?: +\Z)?| +")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- the merge


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` where the pieces of the merge begin, and its end last; of equal ends A's comes first.

    On diagonal d the merge has taken i of a and d - i of b, where i is the least with a[i] > b[d - i - 1].
    """
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        taken = np.zeros(len(d), bool)  # whether a[mid] comes before b[d - mid - 1]
        at = np.flatnonzero(open_)
        taken[at] = a[mid[at]] <= b[d[at] - mid[at] - 1]
        low, high = np.where(open_ & taken, mid + 1, low), np.where(open_ & ~taken, mid, high)
    return low, d - low


def merged(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping pairs of places in the sorted ends ``a`` and ``b``, and the group of each place of a and of b.

    Both lists end at the same byte. All pieces take a step at a time. A step takes the lesser end, of A if they
    are equal, and emits the token it takes with the other list's present token; a B end that equals the A end
    just taken only closes the group.
    """
    none = np.zeros(0, np.int64)
    if not len(a):
        return none, none, none, none
    i, j = (x[:-1].copy() for x in diagonals(a, b, work))
    pieces, last = len(i), len(a) + len(b) - work * (len(i) - 1)
    left, right = np.empty((work, pieces), np.int64), np.empty((work, pieces), np.int64)
    closing = np.zeros((work, pieces), bool)
    group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    far_a, far_b = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    before = np.append(-1, a)
    closed = np.zeros(pieces, np.int64)  # within the piece so far
    for step in range(work):
        n = pieces if step < last else pieces - 1  # the last piece may be shorter
        if n == 0:
            break
        x, y = i[:n], j[:n]
        first = far_a[x] <= far_b[y]
        left[step, :n], right[step, :n] = x, y
        closing[step, :n] = ~first & (before[x] == far_b[y])
        group_a[x[first]] = closed[:n][first]
        group_b[y[~first]] = closed[:n][~first]
        closed[:n] += closing[step, :n]
        i[:n] += first
        j[:n] += ~first
    # stitching: what was closed in the pieces before
    base = np.cumsum(closed) - closed
    begin_a, begin_b = diagonals(a, b, work)
    group_a += np.repeat(base, np.diff(begin_a))
    group_b += np.repeat(base, np.diff(begin_b))
    taken = ~closing
    if last < work:
        taken[last:, -1] = False
    return left.T[taken.T], right.T[taken.T], group_a, group_b


# ---- tokens


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of byte-level entries: printable Latin-1 stands for itself, the other bytes for 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokens:
    """Ids of both tokenizers for texts that begin with a space. Equal words are encoded once while they are remembered."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [e.encode() if e in special else bytes(alphabet[c] for c in e) for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        # tokens are only cut between words if no piece has a space behind another character
        self.by_word = not any(re.search(r"[^▁]▁", p) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.begin, self.count = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
        self.sound = np.zeros(0, bool)

    def _encode_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_b(self, texts: list[str]) -> list[np.ndarray]:
        """``texts`` begin with a space, which the encoder puts there itself."""
        return [np.array(ids, np.int32) for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def _joined(self, ids: np.ndarray, side: int) -> bytes:
        table = (self.a_bytes, self.b_bytes)[side]
        return b"".join([table[i] for i in ids.tolist()])

    def _words_of(self, words: list[str], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of words in a row, their number for each word, and whether they give back its bytes.

        Words are encoded as one text and cut at the words' bytes; one by one if that does not come out.
        """
        together = "".join(words)
        encode = (self._encode_a, self._encode_b)[side]
        ids = encode([together])[0] if words else np.zeros(0, np.int32)
        if len(ids) and self._joined(ids, side) == together.encode():
            ends = np.cumsum((self.a_sizes, self.b_sizes)[side][ids])
            cuts = np.cumsum([len(w.encode()) for w in words])
            at = np.searchsorted(ends, cuts)
            if (ends[at] == cuts).all():
                return ids, np.diff(np.append(-1, at)), np.ones(len(words), bool)
        each = encode(words) if words else []
        sound = [self._joined(x, side) == w.encode() for w, x in zip(words, each)]
        return np.concatenate([ids[:0], *each]), np.array([len(x) for x in each], np.int64), np.array(sound, bool)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if not w.endswith(" ")]  # a last space may go with those of the next word
        other = [w for w in words if w.endswith(" ")]
        parts = [plain[i : i + 10_000] for i in range(0, len(plain), 10_000)] + [[w] for w in other]
        sound = np.ones(len(words), bool)
        for side in (0, 1):
            ids, counts, good = (np.concatenate(x) for x in zip(*[self._words_of(part, side) for part in parts]))
            self.begin[side] = np.append(self.begin[side], len(self.flat[side]) + np.cumsum(counts) - counts)
            self.count[side] = np.append(self.count[side], counts)
            self.flat[side] = np.append(self.flat[side], ids)
            sound &= good
        self.sound = np.append(self.sound, sound)
        self.known.update(zip([*plain, *other], range(len(self.known), len(self.known) + len(words))))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B the ids of all texts and their number for each text; none for texts whose bytes they don't give back."""
        full = [" " + t if t else "" for t in texts]
        by_word = [bool(t) and self.by_word and not _OTHER_SPACE.search(t) for t in full]
        words = [_WORDS.findall(t) if cut else [] for t, cut in zip(full, by_word)]
        if len(self.known) > WORDS:
            self._forget()
        new = {w for own in words for w in own if w not in self.known}
        if new:
            self._learn(list(new))
        known = self.known
        place = np.array([known[w] for own in words for w in own], np.int64)
        sizes = np.array([len(own) for own in words], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        sound = np.bincount(owner, ~self.sound[place], len(texts)) == 0
        out = []
        for side in (0, 1):
            each = self.count[side][place]
            ends = np.cumsum(each)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[side][np.repeat(self.begin[side][place] - (ends - each), each) + np.arange(total)]
            out.append((ids, np.bincount(owner, each, len(texts)).astype(np.int64)))
        odd = np.flatnonzero(np.array([bool(t) for t in full], bool) & ~(np.array(by_word, bool) & sound))
        if not len(odd):
            return out
        parts = [np.split(ids, np.cumsum(counts)[:-1]) for ids, counts in out]
        for i in odd.tolist():
            if not by_word[i]:
                parts[0][i], parts[1][i] = self._encode_a([full[i]])[0], self._encode_b([full[i]])[0]
            if not self._joined(parts[0][i], 0) == full[i].encode() == self._joined(parts[1][i], 1):
                parts[0][i] = parts[1][i] = np.zeros(0, np.int32)
        return [(np.concatenate(own), np.array([len(x) for x in own], np.int64)) for own in parts]


class Aligner:
    """Groups and links of batches of texts."""

    def __init__(self, a_path: str, b_path: str):
        self.tokens = t = Tokens(a_path, b_path)
        self.pieces = len(t.b_bytes)
        # what a token writes: before the next of its own side, and before the other side or the next group
        self.a_text = [np.array([f"{i}{end}" for i in range(len(t.a_bytes))], object) for end in ",|"]
        self.b_text = [np.array([f"{i}{end}" for i in range(self.pieces)], object) for end in ",;"]

    def align(self, texts: list[str]) -> dict[str, list]:
        """For each text the counts, the digest of its groups, and its linked id pairs (A id * pieces + B id) with their number."""
        (a, n_a), (b, n_b) = self.tokens.encode(texts)
        # the bytes of all texts in a row: no token passes the end of its text, where both lists end
        ends_a, ends_b = np.cumsum(self.tokens.a_sizes[a]), np.cumsum(self.tokens.b_sizes[b])
        left, right, group_a, group_b = merged(ends_a, ends_b)
        text_a, text_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        n_links = np.bincount(text_a[left], minlength=len(texts))
        # groups in order, in each the A tokens before the B tokens
        number = int(group_a[-1]) + 1 if len(a) else 0
        of_a, of_b = np.bincount(group_a, minlength=number), np.bincount(group_b, minlength=number)
        text_of_group = text_a[(np.cumsum(of_a) - 1)] if number else np.zeros(0, np.int64)
        n_groups = np.bincount(text_of_group, minlength=len(texts))
        written = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[np.cumsum(of_a) - 1], last_b[np.cumsum(of_b) - 1] = True, True
        at_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(of_a)[group_b]
        written[at_a] = np.where(last_a, self.a_text[1][a], self.a_text[0][a])
        written[at_b] = np.where(last_b, self.b_text[1][b], self.b_text[0][b])
        written, ends = written.tolist(), np.cumsum(n_a + n_b).tolist()
        digests = []
        for i, end in enumerate(ends):
            begin = end - int(n_a[i] + n_b[i])
            digests.append(hashlib.sha256("".join(written[begin:end])[:-1].encode()).hexdigest() if end > begin else "")
        # different pairs of each text
        pairs = a[left].astype(np.int64) * self.pieces + b[right]
        order = np.lexsort((pairs, text_a[left])) if len(pairs) else np.zeros(0, np.int64)
        pairs, owner = pairs[order], text_a[left][order]
        first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(pairs)))
        per_text = np.bincount(owner[first], minlength=len(texts)) if len(first) else np.zeros(len(texts), np.int64)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests, "pairs": pairs[first], "times": times, "per_text": per_text}


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(documents: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, row, counts, groups_sha256, and the linked id pairs of every document: ``pairs`` with their ``times``.

    A pair is the A id times the number of B pieces, and the B id. ``row`` numbers the rows, so that repeated and null
    keys stay apart. Null and empty texts, and texts that a tokenizer doesn't give back, have no tokens.
    """
    paths = paths or tokenizer_paths()
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    fields = [*[(n, T.LongType()) for n in COUNTS], ("groups_sha256", T.StringType()), ("pairs", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*rows.schema.fields[:2], *[T.StructField(n, t) for n, t in fields]])

    def mapped(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if paths not in _ALIGNERS:
            _ALIGNERS[paths] = Aligner(*paths)

        def done(held):
            batch = pa.Table.from_batches(held)
            found = _ALIGNERS[paths].align([t or "" for t in batch.column("text").to_pylist()])
            offsets = pa.array(np.append(0, np.cumsum(found["per_text"])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(found["pairs"], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(found["times"].astype(np.int32)))]
            own = [*[pa.array(found[n], pa.int64()) for n in COUNTS], pa.array(found["groups_sha256"], pa.string()), *lists]
            out = batch.select(["doc_id", "row"])
            for (name, _), column in zip(fields, own):
                out = out.append_column(name, column)
            yield from out.to_batches(max_chunksize=256)

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


def pair_counts(found: DataFrame, pieces: int) -> DataFrame:
    """pair, ``count`` (documents that hold it linked) and ``best``: whether no pair of its A id has a greater one."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = materialize(counts.withColumn("a", F.expr(f"pair div {pieces}")))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def alignment(documents: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    Texts are encoded and aligned once and written with their different pairs. Pairs are counted over all documents, and
    each document's pairs look their counts up: the table of pairs is broadcast if it is measured to be small,
    else joined by key with hot pairs spread. Documents without tokens have zeros and an empty digest; repeated rows
    and keys each get their own row; an empty table gives none.
    """
    from sentencepiece import SentencePieceProcessor

    paths = paths or tokenizer_paths()
    found = materialize(aligned(documents, paths))
    counts = materialize(pair_counts(found, SentencePieceProcessor(model_file=paths[1]).get_piece_size()))
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = lookup_join(each, counts, ["pair"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", *COUNTS, *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("n_best", "count_sum")], "groups_sha256"
    )
