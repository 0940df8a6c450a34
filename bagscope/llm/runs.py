"""Periodic runs of words: Lyndon arrays from the first phase of Baier's suffix sorter, extended into runs.

The first phase sorts suffixes into groups by their longest Lyndon prefix. Taken to its end, the length of a group's
context is the Lyndon array: at each place the longest Lyndon word that begins there. Done under an order of the words
and under its reverse, it holds a Lyndon root of every run; a root whose equal continuation to both sides
(longest common extensions) spans enough of its periods is a run.

A word of a run with exponent e or more occurs e times or more in it. Texts are first cut at words that are too
rare for that, again and again until no cut is left, so that grouping only sees stretches that may hold a run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagscope.llm.base import small_batches

#: Bytes of text that one pass handles; a single longer text is one pass.
CHUNK = 4 << 20


@dataclass(frozen=True)
class Settings:
    """A run has ``least`` words or more, and ``exponent`` times its period or more (2 at least)."""

    least: int = 6
    exponent: int = 4


def lyndon_lengths(letters: np.ndarray) -> np.ndarray:
    """At each place the length of the longest Lyndon word that begins there, by Baier's grouping.

    ``letters`` are whole numbers from 0; a 0 ends a stretch and is less than all others, so no word passes
    it; the last letter is one. Groups are taken from the greatest to the least. Each suffix of a group with context u looks for the
    nearest suffix before it that is in a lesser group; one found by l suffixes has its context extended by
    l times u, and moves to a new group right above its old one (more extensions, higher group). Every suffix
    is passed over once by the chains of nearest lesser ones, so the work is linear.
    """
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    held = letters[order]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    sizes_of = np.diff(np.append(first, n))
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(first, sizes_of)
    places, place_of = order.tolist(), np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    at, group = place_of.tolist(), group_of.tolist()
    size = [0] * n
    for start, count in zip(first.tolist(), sizes_of.tolist()):
        size[start] = count
    lengths, lesser = [1] * n, [-1] * n
    floor = int(sizes_of[0])  # the group of the ends of stretches, which are never extended
    top = n - 1
    while top >= floor:
        here = group[places[top]]
        begin, top = here, here - 1
        members = places[begin : begin + size[here]]
        grown = lengths[members[0]]
        if len(members) > 1:
            members.sort()
        found: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= here:
                p = lesser[p]
            lesser[i] = p
            if p >= 0 and group[p] >= floor:
                found[p] = found.get(p, 0) + 1
        if not found:
            continue
        by_times: dict[int, list[int]] = {}
        for p, times in found.items():
            by_times.setdefault(times, []).append(p)
        for times in sorted(by_times, reverse=True):
            moved = by_times[times]
            for p in moved:  # to the end of its group
                g = group[p]
                size[g] -= 1
                end, place = g + size[g], at[p]
                other = places[end]
                places[place], places[end] = other, p
                at[other], at[p] = place, end
            behind = [group[p] + size[group[p]] for p in moved]
            for p, new in zip(moved, behind):  # what has left a group is a group of its own right behind it
                group[p] = new
                size[new] += 1
                lengths[p] += times * grown
    return np.array(lengths, np.int64)


class Extensions:
    """Longest common extensions of two places, from the names of all substrings whose length is a power of 2."""

    def __init__(self, letters: np.ndarray, longest: int):
        self.names = [letters.astype(np.int32)]
        width = 1
        while 2 * width <= longest:
            last = self.names[-1]
            pairs = last[:-width].astype(np.int64) * (int(last.max()) + 1) + last[width:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
            width *= 2

    def right(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many letters from ``a`` and from ``b`` on are equal, ``most`` at most."""
        done = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            width, names = 1 << level, self.names[level]
            for _ in range(2 if level == len(self.names) - 1 else 1):
                free = np.flatnonzero(done + width <= most)
                same = free[names[a[free] + done[free]] == names[b[free] + done[free]]]
                done[same] += width
        return done

    def left(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many letters before ``a`` and before ``b`` are equal, ``most`` at most."""
        done = np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            width, names = 1 << level, self.names[level]
            for _ in range(2 if level == len(self.names) - 1 else 1):
                free = np.flatnonzero(done + width <= most)
                same = free[names[a[free] - done[free] - width] == names[b[free] - done[free] - width]]
                done[same] += width
        return done


def _stretches(words: np.ndarray, owner: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that may be in a run, and the stretch each is in, by cutting at rare words until none is left."""
    place, stretch = np.arange(len(words)), owner
    while True:
        _, of, counts = np.unique(stretch * (int(words.max(initial=0)) + 1) + words[place], return_inverse=True, return_counts=True)
        kept = counts[of] >= settings.exponent
        joined = np.append(False, (place[1:] == place[:-1] + 1) & (stretch[1:] == stretch[:-1]) & kept[1:] & kept[:-1])[kept]
        if not len(joined):
            return place[kept], stretch[kept]
        number = np.cumsum(~joined) - 1
        long = np.bincount(number)[number] >= settings.least
        same = bool(kept.all() and long.all())
        place, stretch = place[kept][long], number[long]
        if same or not len(place):
            return place, stretch


def find_runs(words: np.ndarray, owner: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """Rows (owner, start, end, period) of all runs in texts of numbered words, one text after another.

    ``owner`` is the text of each word, ascending; places count over all texts. Each run comes once, ordered by
    start and period.
    """
    none = np.zeros((0, 4), np.int64)
    if not len(words):
        return none
    place, stretch = _stretches(words, owner, settings)
    if not len(place):
        return none
    # stretches one after another, each closed by a 0
    edges = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
    sizes = np.diff(np.append(edges, len(place)))
    begins = edges + np.arange(len(edges))
    spot = np.arange(len(place)) + np.repeat(np.arange(len(edges)), sizes)
    letters = np.zeros(len(place) + len(edges), np.int64)
    letters[spot] = np.unique(words[place], return_inverse=True)[1] + 1
    source = np.zeros(len(letters), np.int64)
    source[spot] = place
    low, high = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
    extensions = Extensions(letters, int(sizes.max()))
    found = []
    for order in (letters, np.where(letters > 0, int(letters.max()) + 1 - letters, 0)):
        period = lyndon_lengths(order)[spot]
        root = np.flatnonzero(period * settings.exponent <= high - low)
        a, p = spot[root], period[root]
        b = a + p
        end = b + extensions.right(a, b, high[root] - b)
        start = a - extensions.left(a, b, a - low[root])
        whole = end - start >= np.maximum(settings.least, settings.exponent * p)
        found.append(np.stack([source[start], source[end - 1] + 1, p], axis=1)[whole])
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return np.concatenate([owner[rows[:, 0]][:, None], rows], axis=1)


def _results(texts: list[bytes | None], settings: Settings) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed text of each text."""
    words = [t.split() if t else [] for t in texts]  # bytes are split at the six ASCII spaces only
    sizes = np.array([len(w) for w in words], np.int64)
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for own in words for w in own), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    runs = find_runs(numbers, owner, settings)
    begins = np.cumsum(sizes) - sizes
    marks = np.zeros(len(numbers) + 1, np.int64)  # +1 where what is dropped begins, -1 behind it
    np.add.at(marks, runs[:, 1] + runs[:, 3], 1)
    np.add.at(marks, runs[:, 2], -1)
    dropped = np.cumsum(marks)[:-1] > 0
    listed: list[list[dict]] = [[] for _ in texts]
    for text, start, end, period in runs.tolist():
        listed[text].append({"start": start - int(begins[text]), "length": end - start, "period": period})
    collapsed = []
    for i, own in enumerate(words):
        if listed[i]:
            own = [w for w, gone in zip(own, dropped[begins[i] : begins[i] + sizes[i]].tolist()) if not gone]
        collapsed.append(b" ".join(own).decode("utf-8", "replace"))
    return listed, collapsed


RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))


def periodic_runs(documents: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``documents`` with ``runs`` (structs of start, length and period in words, by start, then period) and ``collapsed``.

    Words are what stands between the ASCII spaces. ``collapsed`` has each run cut to its first period; its words
    are joined by one space. Null, empty and blank texts have no runs and are empty when collapsed; repeated rows
    each get their own; an empty table gives none. Columns named ``runs`` and ``collapsed`` are replaced, all
    others are kept as they are. Texts are handled where they are read, whole, and nothing is shuffled.
    """
    small_batches(documents.sparkSession)
    names = [c for c in documents.columns if c.lower() not in ("runs", "collapsed")]
    own = documents.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*own.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def mapped(batches):
        def done(held):
            batch = pa.Table.from_batches(held)
            runs, collapsed = _results(batch.column(text).cast(pa.large_binary()).to_pylist(), settings)
            out = batch.append_column("runs", pa.array(runs, kind)).append_column("collapsed", pa.array(collapsed, pa.large_string()).cast(pa.string()))
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

    return own.mapInArrow(mapped, schema)


def with_planted(documents: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents, chosen by crc32 of the key, repeat a part of themselves to their end.

    With h that crc32 and g = floor(h / 10): where h % 10 is 0, each word i >= a of the n becomes word
    a + (i - a) % p, for a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null key counts as an empty one.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.expr("h div 10")
    a, p = F.expr("g % n"), F.expr("1 + (n - a) div (3 + g % 8)")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = documents.select("doc_id", "text", h.alias("h")).withColumn("g", g)
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("bigint"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    place: Column = F.expr("transform(sequence(0L, n - 1), i -> element_at(words, cast(if(i < a, i, a + (i - a) % p) as int) + 1))")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(place, " ")).otherwise(F.col("text")).alias("text"))


def runs_digest(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of all runs and of the collapsed text, for texts with planted repetitions.

    The longest run is that of greatest length, then smallest start, then smallest period; without a run its four
    columns are null. Null, empty and blank texts have no run; repeated rows and keys each get their own row.
    """
    found = periodic_runs(with_planted(documents), settings)
    first = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length <> y.length THEN int(sign(y.length - x.length)) WHEN x.start <> y.start THEN int(sign(x.start - y.start)) ELSE int(sign(x.period - y.period)) END)")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("longest", F.get(first, F.lit(0))).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col("longest")[name].alias(name) for name in ("start", "length", "period")],
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
