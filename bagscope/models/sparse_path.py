"""L1 logistic regression along a path of C over a long feature table, for all folds at once.

Nothing as wide as the vocabulary reaches the driver or a task. Each problem (a held-out fold, and a held-out part of the
rest) only knows its working set, the columns that may have a coefficient. Those are solved by Newton steps, one scan for
all problems each; then the gradient of every other column comes from a join of the residuals with the long
table, and the columns that break the optimality condition are taken in. The path goes from strong to weak
penalties, and each point starts from the one before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagscope.models.batched import Problem, few_tasks, summed
from bagscope.operators.joins import lookup_join
from bagscope.operators.ranking import first_n_per_group
from bagscope.session import materialize

ID = "repertoire_id"
#: Columns that a problem takes in at once; rounds go on until no column is left to take.
TAKEN = 200
#: Columns whose second derivatives are held together; more of them take turns in blocks.
BLOCK = 1000
#: How far beyond 1 the scaled gradient of a column without a coefficient may be.
SLACK = 1e-6


@dataclass
class Solution:
    """Intercept, columns, and for each column the coefficient of the scaled feature and the scale."""

    intercept: float = 0.0
    columns: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scales: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _inside(p: Problem) -> Column:
    return (F.col("fold") != p.fold) & (F.col("part") != p.part)


def problem_scales(values: DataFrame, rows: DataFrame, problems: Sequence[Problem], sizes: Sequence[int]) -> DataFrame:
    """idx and ``s_<i>``, the population deviation of every column within each problem's rows, zeros included; 1 if constant."""
    joined = lookup_join(values, rows.select(ID, "fold", "part"), [ID])
    sums = []
    for i, p in enumerate(problems):
        v = F.when(_inside(p), F.col("value")).otherwise(0.0)
        sums += [F.sum(v).alias(f"__a_{i}"), F.sum(v * v).alias(f"__q_{i}")]
    table, scales = joined.groupBy("idx").agg(*sums), []
    for i, n in enumerate(sizes):
        mean = F.col(f"__a_{i}") / F.lit(float(max(n, 1)))
        variance = F.col(f"__q_{i}") / F.lit(float(max(n, 1))) - mean * mean
        scales.append(F.when(variance > F.lit(1e-12) * F.greatest(mean * mean, F.lit(1.0)), F.sqrt(variance)).otherwise(F.lit(1.0)).alias(f"s_{i}"))
    return materialize(table.select("idx", *scales))


def _restricted(values: DataFrame, rows: DataFrame, columns: np.ndarray) -> DataFrame:
    """The rows with their entries in ``columns``, as places and values; rows without entries keep empty lists."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(int(c), i) for i, c in enumerate(columns)], "idx bigint, place int")
    held = lookup_join(values, listed, ["idx"])  # the union of the working sets
    entries = held.groupBy(ID).agg(F.collect_list(F.struct("place", "value")).alias("e"))
    joined = rows.join(entries, ID, "left")
    e = F.coalesce("e", F.array().cast("array<struct<place:int,value:double>>"))
    return materialize(joined.select(ID, "fold", "part", "label", e.getField("place").alias("places"), e.getField("value").alias("entries")))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = np.zeros((batch.num_rows, width))
    places = batch.column("places")
    counts = np.diff(places.offsets.to_numpy())
    x[np.repeat(np.arange(batch.num_rows), counts), places.flatten().to_numpy(zero_copy_only=False)] = batch.column("entries").flatten().to_numpy(zero_copy_only=False)
    return x


def _descend(gradient: np.ndarray, h: np.ndarray, at: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The step from ``at`` to the minimiser of the quadratic model plus |coefficients|; place 0 is the free intercept.

    A sweep over the coordinates finds which of them are not zero and their signs. With these fixed the minimiser is that
    of a linear system; the way there ends where a coefficient would change its sign, which then is zero. Sweeps go on
    until no coordinate has anything to gain.
    """
    w, pulled = at.copy(), gradient.copy()  # gradient of the model at w
    diagonal = np.maximum(np.diag(h), 1e-12)
    for _ in range(rounds):
        for j in range(len(h)):
            new = w[j] - pulled[j] / diagonal[j]
            if j:
                new = np.sign(new) * max(abs(new) - 1 / diagonal[j], 0.0)
            if new != w[j]:
                pulled += (new - w[j]) * h[:, j]
                w[j] = new
        while True:
            own = np.flatnonzero((w != 0) | (np.arange(len(w)) == 0))
            sign = np.sign(w[own])
            sign[0] = 0.0
            face = h[np.ix_(own, own)]
            step = np.linalg.solve(face + 1e-9 * np.diag(diagonal[own]), -(pulled[own] + sign))
            flips = np.flatnonzero((sign != 0) & ((w[own] + step) * sign < 0))
            shares = w[own][flips] / -step[flips]
            far = float(shares.min()) if len(flips) else 1.0
            w[own] += far * step
            pulled += h[:, own] @ (far * step)
            if not len(flips):
                break
            ends = own[flips[shares.argmin()]]
            pulled -= w[ends] * h[:, ends]
            w[ends] = 0.0
        gain = np.where(w != 0, np.abs(pulled + np.sign(w)), np.maximum(np.abs(pulled) - 1, 0.0))
        gain[0] = abs(pulled[0])
        if (gain / np.sqrt(diagonal)).max() < 1e-9:
            break
    return w - at


@dataclass
class _Newton:
    """One problem's descent: a scan gives the derivatives of one block of its columns, each with the intercept, in turns."""

    at: np.ndarray
    blocks: list[np.ndarray]
    step: np.ndarray | None = None
    value: float = np.inf
    length: float = 1.0
    turn: int = 0
    quiet: int = 0

    def point(self) -> np.ndarray:
        return self.at if self.step is None else self.at + self.length * self.step

    def take(self, line: np.ndarray, tolerance: float) -> bool:
        """Use a scan's sums; whether no block has a step left."""
        point, own = self.point(), self.blocks[self.turn]
        value = line[0] + np.abs(point[1:]).sum()
        if self.step is not None and value > self.value + 1e-12 * max(1.0, abs(self.value)) and self.length > 1e-6:
            self.length /= 2
            return False
        self.at, self.value, k = point, value, len(own)
        self.step, self.length = np.zeros(len(point)), 1.0
        self.step[own] = _descend(line[1 : 1 + k], line[1 + k :].reshape(k, k) + 1e-10 * np.eye(k), point[own])
        self.quiet = self.quiet + 1 if np.abs(self.step).max() < tolerance else 0
        self.turn = (self.turn + 1) % len(self.blocks)
        return self.quiet >= len(self.blocks)


def _solve(table: DataFrame, union: np.ndarray, problems, solutions, weights, c: float, scans: int, tolerance: float) -> None:
    """Newton steps of all problems on their working sets; ``solutions`` are changed in place."""
    spark, width, state = table.sparkSession, len(union), {}
    for i, s in enumerate(solutions):
        if weights[i] is not None:
            columns = np.arange(1, len(s.columns) + 1)
            blocks = [np.append(0, columns[b : b + BLOCK]) for b in range(0, max(1, len(columns)), BLOCK)]
            state[i] = _Newton(np.append(s.intercept, s.coefficients), blocks)
    place_of = {i: np.searchsorted(union, solutions[i].columns) for i in state}
    for _ in range(scans):
        if not state:
            break
        sent = {i: (problems[i], weights[i], place_of[i], solutions[i].scales, s.point(), s.blocks[s.turn]) for i, s in state.items()}
        shared = spark.sparkContext.broadcast(sent)

        def partial(held, batch, shared=shared):
            folds, parts, labels = (batch.column(n).to_numpy() for n in ("fold", "part", "label"))
            every = _matrix(batch, width)
            for i, (p, (zeros, ones), places, scales, point, block) in shared.value.items():
                own = (folds != p.fold) & (parts != p.part)
                if not own.any():
                    continue
                x, y = np.concatenate([np.ones((int(own.sum()), 1)), every[own][:, places] / scales], axis=1), labels[own]
                margin, weight = x @ point, c * np.where(y == 1, ones, zeros)
                chance = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                inner = x[:, block]
                curved = (inner.T * (weight * chance * (1 - chance))) @ inner
                line = np.concatenate([[weight @ (np.logaddexp(0, margin) - y * margin)], inner.T @ (weight * (chance - y)), curved.ravel()])
                held[i] = held[i] + line if i in held else line

        for i, line in summed(table, partial).items():
            if state[i].take(line, tolerance):
                solutions[i].intercept, solutions[i].coefficients = float(state[i].at[0]), state[i].at[1:]
                del state[i]
        shared.unpersist()
    for i, s in state.items():
        solutions[i].intercept, solutions[i].coefficients = float(s.at[0]), s.at[1:]


def margins(table: DataFrame, union: np.ndarray, problems, solutions) -> DataFrame:
    """repertoire_id, fold, part, label and ``margins`` (one for each problem) of every row."""
    sent = [(np.searchsorted(union, s.columns), s.coefficients / np.where(s.scales > 0, s.scales, 1), s.intercept) for s in solutions]
    shared, width = table.sparkSession.sparkContext.broadcast(sent), len(union)
    kind = table.schema[ID].dataType.simpleString()

    def mapped(batches):
        for batch in batches:
            x = _matrix(batch, width)
            found = np.stack([x[:, places] @ w + b for places, w, b in shared.value], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in (ID, "fold", "part", "label")], lists], names=[ID, "fold", "part", "label", "margins"])

    return table.mapInArrow(mapped, f"{ID} {kind}, fold int, part int, label int, margins array<double>")


def fit_path(
    values: DataFrame, rows: DataFrame, problems: Sequence[Problem], cs: Sequence[float], balanced: bool = True,
    scans: int = 200, tolerance: float = 1e-7,
) -> tuple[dict[tuple[Problem, float], Solution], DataFrame]:
    """The solution of every problem at every C, and (grid_order, problem, fold, part, repertoire_id, label, margin) of all rows.

    ``values`` is a stored (repertoire_id, idx, value) table with each pair once, ``rows`` (repertoire_id, fold, part,
    label); a row without values counts as zeros. Each problem minimises C times the summed (balanced: class-weighted)
    logistic loss plus the sum of the coefficients' sizes, over features divided by their deviation within the
    problem's rows; the intercept is free. Problems of one class have no coefficients and a margin of 0.
    """
    rows = materialize(rows.select(ID, *[F.col(n).cast("int").alias(n) for n in ("fold", "part", "label")]))
    counts = {(r["fold"], r["part"], r["label"]): r["count"] for r in rows.groupBy("fold", "part", "label").count().toLocalIterator()}
    weights, sizes = [], []
    for p in problems:
        n = [sum(k for (f, q, y), k in counts.items() if f != p.fold and q != p.part and y == label) for label in (0, 1)]
        sizes.append(sum(n))
        weights.append(None if not all(n) else tuple(sum(n) / (2 * k) for k in n) if balanced else (1.0, 1.0))
    scales = problem_scales(values, rows, problems, sizes)
    solutions = [Solution() for _ in problems]
    union = np.zeros(0, np.int64)
    total = sum(counts.values())
    table = few_tasks(_restricted(values, rows, union), total)
    out: dict[tuple[Problem, float], Solution] = {}
    scored = None
    for order in sorted(range(len(cs)), key=lambda k: cs[k]):
        c = cs[order]
        while True:
            _solve(table, union, problems, solutions, weights, c, scans, tolerance)
            fresh = _columns_to_take(values, materialize(margins(table, union, problems, solutions)), scales, problems, solutions, weights, c)
            if not fresh:
                break
            for i, found in fresh.items():
                s = solutions[i]
                columns = np.append(s.columns, [idx for idx, _ in found]).astype(np.int64)
                sort = np.argsort(columns)
                s.coefficients = np.append(s.coefficients, np.zeros(len(found)))[sort]
                s.scales, s.columns = np.append(s.scales, [scale for _, scale in found])[sort], columns[sort]
            union = np.unique(np.concatenate([s.columns for s in solutions]))
            table = few_tasks(_restricted(values, rows, union), total)
        for p, s in zip(problems, solutions):
            out[p, c] = Solution(s.intercept, s.columns.copy(), s.coefficients.copy(), s.scales.copy())
        own = margins(table, union, problems, solutions).select(F.lit(order).alias("grid_order"), F.posexplode("margins").alias("problem", "margin"), ID, "fold", "part", "label")
        own = materialize(own)
        scored = own if scored is None else scored.unionByName(own)
    return out, scored


def _columns_to_take(values, at: DataFrame, scales: DataFrame, problems, solutions, weights, c: float) -> dict[int, list[tuple[int, float]]]:
    """For each problem the columns outside its working set whose gradient is too large, the largest first, TAKEN at most."""
    residual = []
    for i, (p, w) in enumerate(zip(problems, weights)):
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margins")[i]))
        weight = F.lit(0.0) if w is None else F.when(_inside(p), F.when(F.col("label") == 1, w[1]).otherwise(w[0])).otherwise(0.0)
        residual.append((weight * c * (chance - F.col("label"))).alias(f"r_{i}"))
    joined = lookup_join(values, materialize(at.select(ID, *residual)), [ID])
    gradients = joined.groupBy("idx").agg(*[F.sum(F.col("value") * F.col(f"r_{i}")).alias(f"g_{i}") for i in range(len(problems))])
    both = gradients.join(scales, "idx")
    each = F.array(*[F.struct(F.lit(i).alias("problem"), (F.abs(F.col(f"g_{i}")) / F.col(f"s_{i}")).alias("size"), F.col(f"s_{i}").alias("scale")) for i in range(len(problems))])
    found = both.select("idx", F.inline(each)).where(F.col("size") > 1 + SLACK)
    known = [(i, int(j)) for i, s in enumerate(solutions) for j in s.columns]
    if known:
        listed = found.sparkSession.createDataFrame(known, "problem int, idx bigint")
        found = lookup_join(found, listed, ["problem", "idx"], "left_anti")
    out: dict[int, list] = {}
    for r in first_n_per_group(found, ["problem"], [F.desc("size"), F.col("idx")], TAKEN, salts=8).toLocalIterator():
        out.setdefault(r["problem"], []).append((r["idx"], r["scale"]))
    return out
