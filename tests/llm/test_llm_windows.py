"""Runs, packing and tokenizer alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bagscope.llm import alignment, packing, runs

SCHEMA = "doc_id bigint, text string, lang string, RUNS string, row string"
ODD = [None, "", "   ", "one", "a\x0bb\x0cc\x1cd é\x85x", "<|endoftext|> <s> <0x41> ▁", " lead  and trail  ", "same text", "same text", "na " * 30000]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and very long texts, odd spaces, special strings, repeats, a null key, clashing names."""
    data = [(i, t, "en", "x", "y") for i, t in enumerate(ODD)] + [(7, "same text", "en", "x", "y"), (None, "no key", None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


# ---- runs


def brute_lyndon(w):
    out = []
    for i in range(len(w)):
        end = next((e for e in range(i, len(w)) if w[e] == 0), len(w))
        words = [w[i:k] for k in range(i + 1, end + 1)]
        out.append(max([len(x) for x in words if all(x < x[d:] for d in range(1, len(x)))], default=1))
    return out


def brute_runs(w, least, exponent):
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            x = w[start : i + p]
            if len(x) >= max(least, exponent * p) and not any(x[q:] == x[: len(x) - q] for q in range(1, p)):
                out.append((start, len(x), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_lengths_by_grouping():
    rng = random.Random(1)
    for t in range(600):
        w = [rng.randint(t % 2, rng.randint(1, 3)) for _ in range(rng.randint(1, 24))] + [0]
        assert runs.lyndon_lengths(np.array(w)).tolist() == brute_lyndon(w), w


def periodic(rng):
    w = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 50))]
    if w and rng.random() < 0.5:
        a, p = rng.randrange(len(w)), rng.randint(1, 5)
        for i in range(a + p, len(w)):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("settings", [runs.Settings(), runs.Settings(2, 2), runs.Settings(7, 3)])
def test_runs_of_random_texts(settings):
    rng = random.Random(2)
    texts = [periodic(rng) for _ in range(600)]
    listed, collapsed = runs._results([" ".join(w).encode() for w in texts], settings)
    for w, found, left in zip(texts, listed, collapsed):
        want = brute_runs(w, settings.least, settings.exponent)
        assert [tuple(r.values()) for r in found] == want, w
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert left == " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_runs_digest(spark, odd):
    rng = random.Random(3)
    data = [(i, " ".join(periodic(rng)), "en", "x", "y") for i in range(1000, 1400)]
    docs = spark.createDataFrame(data, SCHEMA).unionByName(odd)
    got = Counter(runs.runs_digest(docs).collect())
    want = Counter()
    for r in docs.collect():
        w = planted(r.doc_id, r.text)
        found = brute_runs(w, 6, 4) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
        want[(r.doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], *digests)] += 1
    assert got == want
    assert any(k[1] > 1 for k in want)


def test_runs_keep_columns(spark, odd):
    found = runs.periodic_runs(odd)
    assert found.columns == ["doc_id", "text", "lang", "row", "runs", "collapsed"]  # RUNS is replaced
    assert found.count() == odd.count()
    assert runs.runs_digest(odd.limit(0)).count() == 0


# ---- packing


def test_ids_are_those_of_the_tokenizer():
    encoder, rng = packing.WordIds(packing.tokenizer_path()), random.Random(5)
    parts = ["a", "b", "S", "'", "'s", "'RE", " ", "  ", "\n", "\x1c", "\x01", " ", "é", "É", "İ", "ñ", "×", "́", "日", "🙂", "23", "²", ",", "<|", "|>",
             "<|endoftext|>", "<|ENDOFTEXT|>", "”", "Σ", "ŉ", "\x85", "_", "K", "Å", "ﬁ", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    assert encoder.encode([t.encode() for t in texts]) == encoder._ids(texts)


def test_a_worker_keeps_its_encoder(spark):
    documents = spark.range(8).selectExpr("id as doc_id", "concat('word ', id) as text").coalesce(1)
    for _ in range(6):  # more tasks than workers
        assert packing.pieces(documents.repartition(32), None).count() == 8

    def kept(batches):
        import pyarrow as pa

        from bagscope.llm import packing as own

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([own.encoder.cache_info().hits])], names=["hits"])

    assert spark.range(0, 64, 1, 64).mapInArrow(kept, "hits bigint").agg({"hits": "max"}).first()[0] > 0


def brute_least(lengths, capacity):
    """The least number of sequences by trying all assignments."""
    best = [len(lengths)]
    order = sorted(lengths, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(order):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= order[i]}):
            rest = list(rooms)
            rest.remove(room)
            place(i + 1, rest + [room - order[i]])
        place(i + 1, rooms + [capacity - order[i]])

    place(0, [])
    return best[0]


def test_bounds_never_exceed_the_least_and_best_fit_is_valid():
    rng, met = random.Random(6), 0
    for _ in range(300):
        capacity = rng.randint(4, 40)
        lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randint(1, 8))])
        least = brute_least(lengths.tolist(), capacity)
        bound, shares = packing.bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        bins, offsets = packing.best_fit(lengths, capacity)
        number = bins.max() + 1
        assert bound <= least <= number
        assert np.bincount(bins, shares[lengths]).max() <= 1 + 1e-9
        met += bound == least
        for b in range(number):
            own = sorted(zip(offsets[bins == b], lengths[bins == b]))
            assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()
            assert sum(n for _, n in own) <= capacity
    assert met > 250  # the bound is the least in nearly all of these


def check_packed(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()
        assert sum(n for _, n in own) <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("low, high", [(1, 100), (30, 60), (51, 100), (1, 20)])
def test_repacking_closes_gaps(spark, low, high):
    settings = packing.Settings(capacity=100, pieces=200, fan=3)
    rng = random.Random(low)
    data = [(i, i, 0, rng.randint(low, high)) for i in range(5000)]
    rows = spark.createDataFrame(data, "doc_id bigint, row bigint, piece int, length bigint")
    packed = packing.pack(rows, settings).collect()
    assert Counter((r.doc_id, r.length) for r in packed) == Counter((d[0], d[3]) for d in data)
    number, bound = check_packed(packed, 100), packing.certificate(rows, settings)
    alone = rows.selectExpr("*", "pmod(xxhash64(row, piece), 25) as part").toPandas().groupby("part")["length"]
    apart = sum(packing.best_fit(x.to_numpy(), 100)[0].max() + 1 for _, x in alone)
    assert bound <= number <= apart
    together = packing.best_fit(np.array([d[3] for d in data]), 100)[0].max() + 1
    assert number <= together * 1.015


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    got = packing.packing(odd, settings=packing.Settings(capacity=64)).collect()
    tokenizer, want = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for r in odd.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[r.doc_id, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_packed(got, 64)
    assert packing.packing(odd.limit(0)).count() == 0


# ---- alignment


def test_merge_in_pieces_equals_a_plain_merge():
    rng = random.Random(8)
    for work in (1, 2, 3, 7, 256):
        for _ in range(80):
            end = rng.randint(1, 60)
            a, b = (sorted({end, *rng.sample(range(1, end + 1), rng.randint(0, end))}) for _ in "ab")
            left, right, group_a, group_b = alignment.merged(np.array(a), np.array(b), work)
            begin_a, begin_b = [0, *a], [0, *b]
            want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(begin_a[i], begin_b[j]) < min(a[i], b[j])]
            assert sorted(zip(left.tolist(), right.tolist())) == want
            both = sorted(set(a) & set(b))
            for ends, groups in ((a, group_a), (b, group_b)):
                assert groups.tolist() == [sum(c < e for c in both) for e in ends]


def brute_alignment(texts):
    tokens = alignment.Tokens(*alignment.tokenizer_paths())
    out, holders = [], Counter()
    for text in texts:
        full, a, b = " " + (text or ""), [], []
        if text:
            a, b = tokens.a.encode(full, add_special_tokens=False).ids, tokens.b.encode(text)
            if not b"".join(tokens.a_bytes[i] for i in a) == full.encode() == b"".join(tokens.b_bytes[i] for i in b):
                a, b = [], []
        ends_a, ends_b = (np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((tokens.a_bytes, a), (tokens.b_bytes, b)))
        links, j = [], 0
        for i, end in enumerate(ends_a):
            start = ends_a[i - 1] if i else 0
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(b) and (ends_b[k - 1] if k else 0) < end:
                links.append((a[i], b[k]))
                k += 1
        groups, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, ends) if low < e <= cut) for ids, ends in ((a, ends_a), (b, ends_b))))
            low = cut
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        holders.update(set(links))
    top = {}
    for (x, _), n in holders.items():
        top[x] = max(n, top.get(x, 0))
    return [(n_a, n_b, n_groups, len(links), sum(holders[x] == top[x[0]] for x in links), sum(holders[x] for x in links), digest) for n_a, n_b, n_groups, links, digest in out]


@pytest.mark.parametrize("broadcast", [True, False])
def test_alignment(spark, odd, broadcast, monkeypatch):
    if not broadcast:
        from bagscope.operators.joins import lookup_join

        monkeypatch.setattr(alignment, "lookup_join", lambda *args: lookup_join(*args, broadcast_rows=0, hot_rows=20))
    rng = random.Random(9)
    parts = ["a", "the", "bc", "S", "▁", "'s", " ", "  ", "   ", "\n", "\t", "\x0b", "\x1c", "\x00", " ", "é", "́", "日", "🙂", "23", ",", "<|endoftext|>", "<unk>", "<0x41>", "\x85", " ", "ﬁ"]
    data = [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), "en", "x", "y") for i in range(400)]
    docs = spark.createDataFrame(data, SCHEMA).unionByName(odd.where("coalesce(doc_id, 0) <> 9"))
    rows = docs.collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((r.doc_id, *found) for r, found in zip(rows, brute_alignment([r.text for r in rows])))
    found = alignment.alignment(docs)
    assert Counter(tuple(r) for r in found.select("doc_id", *names).collect()) == want


def test_alignment_of_long_and_no_rows(spark, odd):
    long = alignment.alignment(odd.where("doc_id = 9")).first()
    assert (long.n_a, long.n_groups) == (brute_alignment([ODD[9]])[0][0], brute_alignment([ODD[9]])[0][2])
    assert alignment.alignment(odd.limit(0)).count() == 0
