"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on the driver on a bounded sample; every vector is put into a leaf. A query visits
leaves in the order of a priority queue over the tree, as many as a calibration against exact search over all
rows found to be needed for the wanted recall, and more where these hold too few rows. Vectors of different
lengths have no cosine, so each length has a tree of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagscope.llm.base import small_batches
from bagscope.operators.joins import lookup_join
from bagscope.session import materialize


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the vectors the tree is fitted on, ``probes`` the queries it is calibrated with."""

    neighbours: int = 5
    sample: int = 20_000
    probes: int = 128
    branches: int = 12
    leaf: int = 400
    recall: float = 0.97
    block: int = 4096
    rounds: int = 12
    seed: int = 3


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that its largest component is about one and no square leaves the range of doubles."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal vectors give equal values wherever they stand."""
    queries, rows = scaled(queries), scaled(rows)
    dots = np.einsum("ik,jk->ij", queries, rows)
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return dots / (np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None] * lengths[None])


class Tree:
    """Nodes by number: the centre of each, its children, and for leaves the leaf number."""

    def __init__(self) -> None:
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self.stacked: list[np.ndarray | None] = []
        #: Ids of each leaf over all rows, an id of several leaves counted in the first alone.
        self.held: np.ndarray | None = None

    def _add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centres) - 1

    @staticmethod
    def fit(sample: np.ndarray, leaf: int, settings: Settings) -> Tree:
        """Split by k-means until a node has at most ``leaf`` vectors of the sample or can't be split."""
        tree, rng = Tree(), np.random.default_rng(settings.seed)
        width = sample.shape[1]
        stack = [(tree._add(sample.mean(axis=0) if len(sample) else np.zeros(width)), sample)]
        while stack:
            node, own = stack.pop()
            groups = tree._split(own, leaf, settings, rng)
            if len(groups) < 2:
                tree.leaf[node] = tree.leaves
                tree.leaves += 1
                continue
            for centre, members in groups:
                child = tree._add(centre)
                tree.children[node].append(child)
                stack.append((child, members))
        tree.stacked = [np.array([tree.centres[c] for c in kids]) if kids else None for kids in tree.children]
        return tree

    @staticmethod
    def _split(own: np.ndarray, leaf: int, s: Settings, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        distinct = np.unique(own, axis=0) if len(own) > leaf else own[:0]
        k = min(s.branches, len(distinct), max(2, -(-len(own) // leaf)))
        if len(own) <= leaf or k < 2:
            return []
        centres = distinct[rng.choice(len(distinct), k, replace=False)]
        for _ in range(s.rounds):
            near = nearest(own, centres)
            held = [own[near == i] for i in range(len(centres))]
            centres = np.array([h.mean(axis=0) for h in held if len(h)])
        near = nearest(own, centres)
        return [(centres[i], own[near == i]) for i in range(len(centres)) if (near == i).any()]

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree, each time to the nearest child."""
        out = np.zeros(len(vectors), np.int32)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = nearest(vectors[rows], self.stacked[node])
            stack += [(child, rows[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int, enough: int = 0) -> list[int]:
        """Leaves in best-bin-first order: the queue gives the unexpanded node nearest to the query.

        There are ``most``, and more until they hold ``enough`` ids.
        """
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < most or held < enough):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                found.append(self.leaf[node])
                held += int(self.held[self.leaf[node]]) if enough else 0
                continue
            away = ((self.stacked[node] - query) ** 2).sum(axis=1)
            for d, child in zip(away.tolist(), self.children[node]):
                heapq.heappush(queue, (d, child))
        return found


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", centres, centres)[None] - 2 * vectors @ centres.T).argmin(axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and ``v`` (array of double) of the vectors that take part.

    Null, empty and zero vectors, vectors with a null or non-finite component, and rows without an id take no part.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The length, the places and the matrix of the vectors of each length in a column."""
    widths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        own = column if len(at) == len(widths) else column.take(pa.array(at))
        yield width, at, own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)


def _apart(frame: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    widths = frame["v"].map(len).to_numpy()
    return {w: (frame["vec_id"].to_numpy(np.int64)[widths == w], np.stack(frame["v"][widths == w])) for w in np.unique(widths).tolist()}


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return frame.drop_duplicates(["query_id", "vec_id"]).groupby("query_id", sort=False).head(k)


def block_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a block of rows for each query, its own id left out; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    repeated = len(np.unique(ids)) < len(ids)
    parts = []
    step = max(1, (1 << 21) // max(1, len(ids)))
    for at in range(0, len(query_ids), step):
        own = query_ids[at : at + step]
        scores = cosines(queries[at : at + step], rows)
        scores[own[:, None] == ids[None]] = -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")
        top = top if repeated else top[:, :k]
        frame = pd.DataFrame({"query_id": np.repeat(own, top.shape[1]), "vec_id": ids[top].ravel(), "score": np.take_along_axis(scores, top, axis=1).ravel()})
        parts.append(_best(frame[frame["score"] > -np.inf], k))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


SCORED = "query_id bigint, vec_id bigint, score double"


def exact(rows: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """Exact search of a bounded set of queries (by length) over all rows: each task keeps its k best of each query."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def mapped(batches):
        best = None
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for width, at, values in by_width(batch.column("v")):
                if width in shared.value:
                    frame = block_best(*shared.value[width], ids[at], values, k)
                    best = frame if best is None else _best(pd.concat([best, frame]), k)
        if best is not None and len(best):
            yield pa.RecordBatch.from_pandas(best[["query_id", "vec_id", "score"]], preserve_index=False)

    return ranked(rows.mapInArrow(mapped, SCORED), k).select("query_id", "vec_id", "score").toPandas()  # queries x k


def calibrate(trees: dict[int, Tree], rows: DataFrame, probes: pd.DataFrame, settings: Settings) -> int:
    """The least number of leaves to visit for the wanted recall of the probes against exact search over all rows."""
    probes = probes[probes["v"].map(len).isin(trees)]
    if not len(probes):
        return 1
    asked = _apart(probes)
    truth = exact(rows, asked, settings.neighbours)
    if not len(truth):
        return 1
    listed = rows.sparkSession.createDataFrame(pd.DataFrame({"vec_id": truth["vec_id"].unique()}))  # probes x neighbours ids
    wanted = rows.where(F.size("v").isin(list(asked))).join(F.broadcast(listed), "vec_id").toPandas()
    leaf_of = {
        (w, v): leaf for w, (ids, vectors) in _apart(wanted).items() for v, leaf in zip(ids.tolist(), trees[w].assign(units(vectors)).tolist())
    }
    place = {
        q: (w, {leaf: n for n, leaf in enumerate(trees[w].visits(u, trees[w].leaves))})
        for w, (ids, vectors) in asked.items()
        for q, u in zip(ids.tolist(), units(vectors))
    }
    needed = np.sort([place[q][1][leaf_of[place[q][0], v]] + 1 for q, v in zip(truth["query_id"], truth["vec_id"])])
    return int(needed[min(len(needed) - 1, int(np.ceil(settings.recall * len(needed))) - 1)])


def search(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows found for each query.

    ``queries`` are rows of the same columns; a query's own id is not among its neighbours. A query id given
    twice is answered once, by the smallest of its vectors; a row given twice counts once. A query is compared
    with the rows of its vector's length. Both tables are dealt by leaf in blocks of ``block`` rows or queries,
    so a leaf with a third of all rows is many tasks; the best of all blocks are ranked again by query. A query
    has ``neighbours`` rows, or all if there are fewer. Empty tables give none.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    k = settings.neighbours
    rows = materialize(usable(vectors))
    asked = materialize(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    n = rows.count()
    if not n or asked.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).toPandas()
    share = min(1.0, settings.sample / n)
    leaf = max(8, int(settings.leaf * share))
    trees = {width: Tree.fit(units(sample), leaf, settings) for width, (_, sample) in _apart(drawn).items()}
    probes = asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(settings.probes).toPandas()
    visits = calibrate(trees, rows, probes, settings)
    shared = spark.sparkContext.broadcast(trees)  # bounded by the sample; a length that is not in it is one leaf

    def placed(batches):
        for batch in batches:
            leaves, widths = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for width, at, values in by_width(batch.column("v")):
                widths[at] = width
                if width in shared.value:
                    leaves[at] = shared.value[width].assign(units(values))
            yield batch.append_column("width", pa.array(widths)).append_column("leaf", pa.array(leaves))

    schema = "vec_id bigint, v array<double>, width int, leaf int"
    dealt = materialize(rows.select("vec_id", "v").mapInArrow(_filled(placed), schema))
    branched = [width for width, tree in trees.items() if tree.leaves > 1]
    homes = dealt.where(F.col("width").isin(branched)).groupBy("width", "vec_id").agg(F.min("leaf").alias("leaf"))
    for tree in trees.values():
        tree.held = np.zeros(tree.leaves, np.int64)
    for row in homes.groupBy("width", "leaf").agg(F.count("*").alias("n")).collect():  # a row per leaf of the trees
        trees[row["width"]].held[row["leaf"]] = row["n"]
    counted = spark.sparkContext.broadcast(trees)

    def routed(batches):
        for batch in batches:
            for width, at, values in by_width(batch.column("v")):
                tree = counted.value.get(width)
                found = [[0]] * len(at) if tree is None else [tree.visits(u, visits, k + 1) for u in units(values)]
                own = batch.take(pa.array(np.repeat(at, [len(f) for f in found])))
                own = own.append_column("width", pa.array(np.full(own.num_rows, width, np.int32)))
                yield own.append_column("leaf", pa.array(np.concatenate(found).astype(np.int32)))

    routes = materialize(asked.select("vec_id", "v").mapInArrow(_filled(routed), schema))
    at_leaf = ["width", "leaf"]
    sizes = dealt.groupBy(*at_leaf).agg(F.count("*").alias("rows")).join(routes.groupBy(*at_leaf).agg(F.count("*").alias("queries")), at_leaf)
    parts = materialize(
        sizes.select(
            *at_leaf,
            F.ceil(F.col("rows") / settings.block).cast("int").alias("row_parts"),
            F.ceil(F.col("queries") / settings.block).cast("int").alias("query_parts"),
        )
    )
    left = lookup_join(dealt, parts, at_leaf).select(
        *at_leaf, F.pmod(F.xxhash64("vec_id"), "row_parts").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("q"), "vec_id", "v"
    )
    right = lookup_join(routes, parts, at_leaf).select(
        *at_leaf, F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)).alias("r"), F.pmod(F.xxhash64("vec_id"), "query_parts").cast("int").alias("q"), F.col("vec_id").alias("query_id"), "v"
    )

    def compared(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(given):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        return block_best(given["query_id"].to_numpy(np.int64), np.stack(given["v"]), own["vec_id"].to_numpy(np.int64), np.stack(own["v"]), k)

    keys = [*at_leaf, "r", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compared, SCORED)
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _filled(function):
    return lambda batches: function(b for b in batches if b.num_rows)


def nearest_neighbours(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The search whose queries are the rows with an id divisible by 50."""
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), settings)
