"""SimHash near-duplicates: 64-bit fingerprints, linked at a small Hamming distance through vantage-point trees."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagscope.llm.base import small_batches
from bagscope.llm.graph import components
from bagscope.session import materialize

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
VANTAGE_POINTS = 8
#: Rings of the last vantage point, as wide as this many distances.
RING = 5
LEAF = 256
_STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text, unsigned: a bit is set if over half the shingle hashes have it."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(joined))
    if len(starts) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _STEP):
        pairs = zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed bigint, of every row."""
    small_batches(documents.sparkSession)

    def mapped(batches):
        for batch in batches:
            prints = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(mapped, f"doc_id {kind}, fp bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shards(fp: Column, radius: int = RADIUS) -> Column:
    """The leaves of the vantage-point trees that a fingerprint belongs to, as an array of bigint.

    The 64 bits are cut into four blocks. Two fingerprints that differ in at most two bits agree on two
    whole blocks at least, so there is one tree for each choice of two blocks. Its upper levels measure
    distances to fixed vantage points on these two blocks only, where the radius left is 0: the branch is
    the exact distance and no branch but one's own can hold a partner. The last level measures the distance
    on all 64 bits in rings; a fingerprint within half the radius of a ring's boundary goes to both
    sides, so that by the triangle inequality each pair meets in some leaf.
    """
    if radius > BLOCKS - 2:
        raise ValueError(f"{BLOCKS} blocks serve a radius of up to {BLOCKS - 2}")
    rng = np.random.default_rng(SEED)
    width = 64 // BLOCKS
    reach = (radius + 1) // 2
    keys = []
    for tree, pair in enumerate(combinations(range(BLOCKS), 2)):
        mask = sum(((1 << width) - 1) << (width * b) for b in pair)
        key = F.lit(tree).cast("bigint")
        for point in rng.integers(0, 1 << 63, VANTAGE_POINTS, dtype=np.int64) * 2 + 1:
            away = F.bit_count(fp.bitwiseXOR(F.lit(int(point))).bitwiseAND(F.lit(_signed(mask))))
            key = key * (2 * width + 1) + away
        last = F.bit_count(fp.bitwiseXOR(F.lit(int(rng.integers(-(1 << 63), 1 << 63, dtype=np.int64)))))
        for edge in (-reach, reach):
            ring = F.floor(F.greatest(last + edge, F.lit(0)) / F.lit(RING))
            keys.append(key * (64 // RING + 1) + ring)
    return F.array_distinct(F.array(*keys))


def _forest(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of the points, the position of the first point it is connected to."""
    label = np.arange(len(points))
    step = max(1, (1 << 22) // len(points))
    while True:
        low = label.copy()
        for at in range(0, len(points), step):
            near = np.bitwise_count(points[at : at + step, None] ^ points[None]) <= radius
            low[at : at + step] = np.where(near, label[None], len(points)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def tree_links(points: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (point, earlier point) that connect all points within ``radius`` of each other: a forest.

    A vantage-point tree over unsigned fingerprints: each node splits at the median distance, and the points
    whose distance lies within the radius of the median go down both branches. Where a split separates
    too little, as in a dense group, the node is compared whole, in blocks.
    """
    found, stack = [], [points]
    while stack:
        own = stack.pop()
        if len(own) < 2:
            continue
        if len(own) > LEAF:
            away = np.bitwise_count(own ^ own[len(own) // 2]).astype(int)
            middle = int(np.median(away))
            near, far = own[away <= middle + radius // 2], own[away >= middle - (radius + 1) // 2 + 1]
            if max(len(near), len(far)) < 0.9 * len(own):
                stack += [near, far]
                continue
        label = _forest(own, radius)
        moved = np.flatnonzero(label != np.arange(len(own)))
        if len(moved):
            found.append((own[moved], own[label[moved]]))
    return found


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``u``, ``v`` between the distinct fingerprints ``fp`` that connect all pairs within ``radius``."""
    dealt = prints.select(F.explode(shards(F.col("fp"), radius)).alias("shard"), "fp")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "fp")

    def mapped(batches):
        shard, held = None, []

        def out(pairs):
            for u, v in pairs:
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            shard_of = batch.column("shard").to_numpy(zero_copy_only=False)
            prints_of = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero(np.diff(shard_of)) + 1
            begins, ends = np.append(0, cuts), np.append(cuts, len(shard_of))
            for a, b in zip(begins.tolist(), ends.tolist()):
                if shard_of[a] != shard:
                    if sum(map(len, held)) > 1:
                        yield from out(tree_links(np.concatenate(held), radius))
                    shard, held = shard_of[a], []
                held.append(prints_of[a:b])
        if sum(map(len, held)) > 1:
            yield from out(tree_links(np.concatenate(held), radius))

    return dealt.mapInArrow(mapped, "u bigint, v bigint")


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row.

    Rows with equal fingerprints are one node, so groups of copies are never paired. Null and empty texts
    have the fingerprint zero and are linked like any other. A null doc_id keeps its row; it is never the
    smallest of a component unless all are null. Repeated rows stay repeated; an empty table gives none.
    """
    prints = materialize(fingerprints(documents))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("fp"), radius))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
