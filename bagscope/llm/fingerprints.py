"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at each step the walk writes the character it stands on and moves on or
stays, as a random bit of the step and the character says. Texts a few edits apart fall into step again after
an edit, so their edit distance becomes a Hamming distance of what was written. A fingerprint samples places of
the written text; bands of sampled bits find candidates, and the share of equal samples verifies them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagscope.llm.base import small_batches
from bagscope.llm.graph import components
from bagscope.session import materialize

SLOTS = 64
SEED = 17
#: Bits of the step in the table of random bits.
PERIOD = 1 << 13
BANDS, BAND_BITS = 32, 20
#: Code points that are walked together; one longer text is walked alone.
TOGETHER = 20_000_000


@lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """For each step and hashed character whether the walk moves on; behind the end (0) it stays."""
    table = np.random.default_rng(SEED).integers(0, 2, (PERIOD, 256), dtype=np.int64)
    table[:, 0] = 0
    return table


@lru_cache(maxsize=1)
def _written() -> np.ndarray:
    """The byte that a slot shows for a hashed character: a permutation for each slot."""
    rng = np.random.default_rng(SEED + 1)
    return np.stack([rng.permutation(256) for _ in range(SLOTS)]).astype(np.uint8)


@lru_cache(maxsize=1)
def _bands() -> np.ndarray:
    """For each band the sampled bits of a fingerprint."""
    rng = np.random.default_rng(SEED + 2)
    return np.stack([rng.choice(SLOTS * 8, BAND_BITS, replace=False) for _ in range(BANDS)])


@lru_cache(maxsize=1)
def _records() -> list[np.ndarray]:
    """For each slot the steps at which a sequence of random priorities takes a new least value.

    A slot of a walk of n steps samples the step of least priority among them, that is the last record
    before n. Walks of n and m > n steps then sample the same step in n of m slots. The gap to the next
    record is geometric in the present least value, so records need no priorities in between.
    """
    rng = np.random.default_rng(SEED + 3)
    out = []
    for _ in range(SLOTS):
        at, least, steps = 0, rng.random(), [0]
        while at < 1 << 45:
            at += int(min(1 << 46, np.ceil(np.log(1 - rng.random()) / np.log1p(-least)))) if least < 1 else 1
            least *= rng.random()
            steps.append(at)
        out.append(np.array(steps))
    return out


def _symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(9)).astype(np.uint8) % np.uint8(255) + np.uint8(1)


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of SLOTS bytes for each text; equal texts give equal rows.

    The walk over a text of n code points takes 2 n steps, in which it passes about all of it. Texts advance
    together, the longest first, so those still walking are a prefix. Empty texts show the end mark only.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    n = sizes[order]
    flat = np.zeros(int(n.sum()) + len(n), np.uint8)
    begin = np.cumsum(n + 1) - (n + 1)
    for i, b in zip(order.tolist(), begin.tolist()):
        if texts[i]:
            flat[b : b + len(texts[i])] = _symbols(texts[i])
    steps = 2 * n
    walking = int((n > 0).sum())
    slot_step = np.stack([r[np.searchsorted(r, steps[:walking]) - 1] for r in _records()], axis=1) if walking else np.zeros((0, SLOTS), np.int64)
    by_step = np.argsort(slot_step.ravel(), kind="stable")
    rows, found = by_step // SLOTS, np.zeros(walking * SLOTS, np.uint8)
    due = slot_step.ravel()[by_step]
    stops, firsts = np.unique(due, return_index=True)
    edges = np.append(firsts, len(due)).tolist()
    stops = stops.tolist() + [-1]
    place, moves, stop = begin[:walking].copy(), _moves(), 0
    live = walking
    for j in range(int(steps[0]) if walking else 0):
        while live and steps[live - 1] <= j:
            live -= 1
        if live == 0 or stop + 1 == len(stops):
            break
        here = place[:live]
        seen = flat.take(here)
        if stops[stop] == j:
            a, b = edges[stop], edges[stop + 1]
            found[by_step[a:b]] = seen[rows[a:b]]
            stop += 1
        here += moves[j & (PERIOD - 1)].take(seen)
    shown = np.zeros((len(texts), SLOTS), np.uint8)
    shown[order[:walking]] = found.reshape(walking, SLOTS)
    return _written()[np.arange(SLOTS)[None], shown]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: 1 less the Hamming distance of the samples."""
    return (a == b).mean(axis=1)


def band_keys(prints: np.ndarray) -> np.ndarray:
    """The sampled bits of each band as one number."""
    bits = np.unpackbits(prints, axis=1)
    weights = (1 << np.arange(BAND_BITS, dtype=np.int64))[::-1]
    return np.stack([bits[:, band].astype(np.int64) @ weights for band in _bands()], axis=1)


def _edited(text: str, following: str) -> str:
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def _compared(pairs: list[tuple]) -> dict[str, list]:
    """Results of (doc_id, text, following text)."""
    texts = [p[1] for p in pairs]
    following = [p[2] for p in pairs]
    changed = [_edited(a, b) for a, b in zip(texts, following)]
    places: dict[str, int] = {}
    at = [[places.setdefault(t, len(places)) for t in part] for part in (texts, changed, following)]
    prints = fingerprints(list(places))
    own, edit, after = (prints[x] for x in at)
    bands = [band_keys(x) for x in (own, edit, after)]
    return {
        "doc_id": [p[0] for p in pairs],
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [x.tobytes().hex() for x in own],
        "edited_fingerprint": [x.tobytes().hex() for x in edit],
        "near_edited": likeness(own, edit),
        "near_next": likeness(own, after),
        "candidate_edited": (bands[0] == bands[1]).any(axis=1),
        "candidate_next": (bands[0] == bands[2]).any(axis=1),
    }


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, candidate_edited boolean, candidate_next boolean"
_TYPES = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "candidate_edited": pa.bool_(), "candidate_next": pa.bool_()}


def with_edited(documents: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    Documents are ordered by doc_id (null first; rows of one doc_id by their text), and after the last comes
    the first. Texts are dealt out once by ranges of doc_id; a task compares neighbours as they come. Only
    its first and last text are written with the results, and joined across tasks. A null text counts as
    empty. A single document is its own next one; an empty table gives none.

    ``candidate_*`` tells whether the two fingerprints agree in a band of sampled bits, ``near_*`` is the
    share of equal samples, which verifies candidates.
    """
    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def out(pairs, part, edge, text):
        columns = _compared(pairs) if edge is None else {"doc_id": [p[0] for p in pairs], **{k: [None] * len(pairs) for k in _TYPES}}
        arrays = [pa.array(columns["doc_id"], id_type[0]), *[pa.array(columns[k], t) for k, t in _TYPES.items()]]
        more = [pa.array([part] * len(pairs), pa.int32()), pa.array([edge] * len(pairs), pa.string()), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays([*arrays, *more], names=["doc_id", *_TYPES, "part", "edge", "text"])

    id_type: list = [None]

    def mapped(batches):
        part, held, size, last = TaskContext.get().partitionId(), [], 0, None
        for batch in batches:
            id_type[0] = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if last is None:
                    yield out([(doc_id,)], part, "head", [text])
                else:
                    held.append((*last, text))
                    size += len(last[1])
                    if size >= TOGETHER:
                        yield out(held, part, None, [None] * len(held))
                        held, size = [], 0
                last = (doc_id, text)
        if held:
            yield out(held, part, None, [None] * len(held))
        if last is not None:
            yield out([(last[0],)], part, "tail", [last[1]])

    done = materialize(rows.mapInArrow(mapped, f"doc_id {kind}, {RESULT}, part int, edge string, text string"))
    parts = sorted(r.part for r in done.where("edge = 'head'").select("part").collect())  # one number a task
    inner = done.where("edge is null").drop("part", "edge", "text")
    if not parts:
        return inner
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    heads = done.where("edge = 'head'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    tails = done.where("edge = 'tail'").select("part", "doc_id", "text").join(F.broadcast(after), "part").join(heads, "next")

    def crossed(batches):
        for batch in batches:
            if batch.num_rows:
                columns = _compared(list(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "following")])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(columns[k], t) for k, t in _TYPES.items()]], names=["doc_id", *_TYPES])

    return inner.unionByName(tails.select("doc_id", "text", "following").mapInArrow(crossed, f"doc_id {kind}, {RESULT}"))


def near_groups(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, fingerprint and group_id, the smallest doc_id of a group of near copies.

    Equal texts are one node. In each band the fingerprints with equal bits are compared with the first of
    them and linked if ``least`` or more of the samples are equal; those that are not like it are compared
    with the first of their own, until each is linked or is the first. No pairs are listed, so a large
    group costs as many links as members. Null and empty texts form one group.
    """
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def mapped(batches):
        for batch in batches:
            prints = fingerprints([x or "" for x in batch.column("text").to_pylist()])
            hexes = pa.array([x.tobytes().hex() for x in prints], pa.string())
            keys = pa.array(band_keys(prints).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), hexes, keys], names=["doc_id", "fingerprint", "bands"])

    marked = materialize(documents.select("doc_id", "text").mapInArrow(mapped, f"doc_id {kind}, fingerprint string, bands array<bigint>"))
    nodes = materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")))
    left = materialize(nodes.select(F.posexplode("bands").alias("band", "key"), "fingerprint"))
    found = None
    while not left.isEmpty():
        heads = left.groupBy("band", "key").agg(F.min("fingerprint").alias("head"))
        near = left.join(heads, ["band", "key"]).where("fingerprint <> head")
        equal = F.aggregate(F.sequence(F.lit(0), F.lit(SLOTS - 1)), F.lit(0), lambda n, i: n + (F.substr("fingerprint", i * 2 + 1, F.lit(2)) == F.substr("head", i * 2 + 1, F.lit(2))).cast("int"))
        near = materialize(near.withColumn("like", equal >= least * SLOTS))
        linked = near.where("like").select("fingerprint", "head")
        found = linked if found is None else found.unionByName(linked)
        left = materialize(near.where("not like").select("band", "key", "fingerprint"))
    if found is None:
        roots = nodes.select("fingerprint", F.col("fingerprint").alias("root"))
    else:
        links = found.distinct().select(F.xxhash64("fingerprint").alias("u"), F.xxhash64("head").alias("v"))
        own = nodes.select("fingerprint", F.xxhash64("fingerprint").alias("node"))
        roots = own.join(components(links), "node", "left").select("fingerprint", F.coalesce("root", "node").cast("string").alias("root"))
    first = nodes.join(roots, "fingerprint")
    smallest = first.groupBy("root").agg(F.min("first").alias("group_id"))
    of_print = first.join(smallest, "root").select("fingerprint", "group_id")
    return marked.select("doc_id", "fingerprint").join(of_print, "fingerprint").select("doc_id", "fingerprint", "group_id")
