"""Native operators, near duplicates, neighbours and the pipeline against brute force."""

import os
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from bagscope.llm import graph, licences, mixing, neighbours, registry, secret_scan, simhash, toxicity

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def rows(texts, source="s"):
    return [(i, t, "en", source, None if t is None else len(t), "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "   ", "alpha beta gamma " * 6000, "same text here", "same text here", "123 456"]
    data = rows(texts) + [(4, "same text here", "en", "s", 14, "x"), (None, "no key", None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


# ---- secrets


def test_candidates_against_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1+/=_- \n.") for _ in range(rng.randint(0, 70))) for _ in range(300)] + [None, "", "a1" * 40000]
    got = spark.createDataFrame(rows(texts), SCHEMA).select("doc_id", secret_scan.candidates(F.col("text")).alias("c")).collect()
    for r in got:
        text, want = texts[r.doc_id] or "", []
        for m in re.finditer(r"[A-Za-z0-9+/_.-]+", text):
            if len(m.group()) >= 12 and re.search("[0-9]", m.group()):
                tail = re.match("={0,2}", text[m.end() :]).end()
                want.append(text[m.start() : m.end() + tail])
        assert [c.value for c in r.c] == want


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train(secret_scan.seed_findings(spark), ["the", "and", "mail", "example"])


def test_forest_expression_equals_a_walk_down_the_trees(spark, forest):
    named = secret_scan.features(*(F.col(c) for c in ("value", "before", "after", "path")), forest.words)
    found = secret_scan.seed_findings(spark).withColumn("f", F.struct(*[c.alias(n) for n, c in named.items()]))
    got = found.select("f", "label", forest.score(F.col("f")).alias("score")).collect()

    def walk(node, f):
        while not isinstance(node, float):
            node = node[2] if f[node[0]] <= node[1] else node[3]
        return node

    assert all(r.score == pytest.approx(np.mean([walk(t, r.f) for t in forest.trees])) for r in got)
    assert np.mean([(r.score >= 0.5) == bool(r.label) for r in got]) > 0.95


def test_scan_finds_secrets_and_leaves_checksums(spark, forest):
    secret, other = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    texts = [f'Here é token = "{secret}" it is', f'commit = "{other}" of x', f'a {secret[:11]} b', None, "", f'token="{secret}" token="{secret}"']
    docs = spark.createDataFrame(rows(texts), SCHEMA).withColumn("findings", F.lit(1))
    got = {r.doc_id: r for r in secret_scan.scan(docs, forest).collect()}
    assert [(f.value, texts[0][f.start : f.end]) for f in got[0].findings] == [(secret, secret)]
    assert got[0].redacted == texts[0].replace(secret, "[SECRET]") and got[1].redacted == texts[1] and got[2].redacted == texts[2]
    assert got[3].redacted is None and got[4].redacted == "" and got[5].redacted.count("[SECRET]") == 2 and got[0].extra == "x"
    assert secret_scan.scan(docs.limit(0), forest).count() == 0


def test_secret_query_on_odd_rows(odd):
    got = secret_scan.secrets(odd).collect()
    assert len(got) == odd.count() and all(r.n_secrets == 0 for r in got)


# ---- licences


def text_of(*ids):
    return "\n\n".join(licences.SENTENCES[i].capitalize() + "." for i in ids)


def test_known_sentences_hold_a_trigger():
    assert all(re.search(licences.TRIGGER, s) for s in licences.known_sentences())


def test_licence_rules(spark, odd):
    cases = [
        (text_of("mit-grant", "mit-notice", "as-is"), "MIT"), (text_of("mit-notice", "mit-grant"), ""),
        (text_of("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"), (text_of("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), "BSD-3-Clause"),
        ("junk here\nReleased under the MIT License.\nmore", "MIT"), ("Licensed under CC BY-NC 4.0. Also\nlicensed under the Apache License, Version 2.0.", "Apache-2.0,CC-BY-NC-4.0"),
        ("we talk about licensing and permission", ""), (None, ""), ("", ""),
    ]
    docs = spark.createDataFrame(rows([c[0] for c in cases]), SCHEMA).withColumn("licences", F.lit("clash"))
    got = {r.doc_id: r.licences for r in licences.licences(docs).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}
    assert licences.scan(odd).count() == odd.count() and licences.licences(odd.limit(0)).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_punctuated_notices(spark):
    def comment(text):
        return "".join(f"# {line}".rstrip() + "\n" for line in ("Copyright 2020 Somebody\n\n" + text).split("\n"))

    notices = [(APACHE, "Apache-2.0"), (GPL.format(":", ",", 3), "GPL-3.0"), (GPL.format(";", ";", 2), "GPL-2.0"), (GPL.format(";", ",", 2), "GPL-2.0")]
    cases = [(shape(text), licence) for text, licence in notices for shape in (str, comment, lambda t: " ".join(t.split()), lambda t: f"Some words. {t} Others.")]
    first = APACHE.split("You may")[0]
    cases += [(first, ""), (APACHE.replace(first, "") + first, ""), (GPL.format(":", ",", 3).split("This program is distributed")[0], ""), (GPL.format(":", ",", 4), "")]
    got = {r.doc_id: r.licences for r in licences.licences(spark.createDataFrame(rows([c[0] for c in cases]), SCHEMA)).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


BSD = """Copyright 2011 The Somebody Authors. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
"""
BSD_NAME = """   * Neither the name of {} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
BSD_AUTHOR = """3. The name of the author may not be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
CC0 = "To the extent possible under law, Jane Q. Doe has waived all copyright and related or neighboring rights to this work.\n"


def every_notice():
    """(text, licences) of every licence's usual notice, with names and marks as they are found."""
    family = {"LGPL-2.1": ("Lesser ", "2.1", "library"), "LGPL-3.0": ("Lesser ", "3", "program"), "AGPL-3.0": ("Affero ", "3", "program")}
    other = [
        (GPL.format(*marks, n).replace("GNU General", f"GNU {word}General").replace("This program", f"This {noun}"), licence)
        for licence, (word, n, noun) in family.items()
        for marks in ((":", ","), (";", ";"))
    ]
    names = ["Google Inc.", "the copyright holder", "Foo, Bar & Co. Ltd.", "the University"]
    return other + [
        (APACHE, "Apache-2.0"), (GPL.format(":", ",", 3), "GPL-3.0"), (GPL.format(";", ";", 2), "GPL-2.0"),
        (GPL.format(":", ",", 3).replace("This program", "Foo Bar"), "GPL-3.0"),
        (BSD, "BSD-2-Clause"), (BSD + BSD_AUTHOR, "BSD-3-Clause"), *[(BSD + BSD_NAME.format(name), "BSD-3-Clause") for name in names],
        (MPL, "MPL-2.0"), (MPL.split("If a")[0], ""), (UNLICENSE, "Unlicense"), (UNLICENSE.split("Anyone")[0], ""), (CC0.replace("Q. ", ""), "CC0-1.0"),
        (text_of("mit-grant", "mit-notice", "as-is"), "MIT"), (text_of("isc-grant"), "ISC"), ("Released under the CC BY 4.0.", "CC-BY-4.0"),
    ]


def test_every_notice_is_known_to_the_query_and_its_sql(spark):
    comment = lambda text: "".join(f"// {line}".rstrip() + "\n" for line in text.split("\n"))
    cases = [(shape(text), licence) for text, licence in every_notice() for shape in (str, comment, lambda t: " ".join(t.split()))]
    texts = [c[0] for c in cases] + [None, "", BSD_NAME.format("x"), "\n\n".join(text for text, _ in every_notice())]
    frame = spark.createDataFrame(rows(texts), SCHEMA)
    got = licences.licences(frame).toPandas()
    assert dict(zip(got["doc_id"], got["licences"])) == {i: c[1] for i, c in enumerate(cases)} | {
        len(cases): "", len(cases) + 1: "", len(cases) + 2: "",
        len(cases) + 3: "AGPL-3.0,Apache-2.0,BSD-3-Clause,CC-BY-4.0,CC0-1.0,GPL-2.0,GPL-3.0,ISC,LGPL-2.1,LGPL-3.0,MIT,MPL-2.0,Unlicense",
    }
    con = duckdb.connect()
    documents = frame.toPandas()  # noqa: F841 - read by name
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    want = con.execute(licences.SQL).fetchdf()
    columns = ["doc_id", "n_known", "sentence_ids", "licences"]
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None))


# ---- mixing


def brute_mix(data, settings):
    import hashlib

    tokens = {}
    for key, text, _, source, *_ in data:
        tokens.setdefault(source, []).append((key, len(re.findall(r"[^ \t\n\x0B\f\r]+", text or ""))))
    total = {s: sum(n for _, n in d) for s, d in tokens.items()}
    some = {s: n for s, n in total.items() if n}
    low, high, lo, hi = min(some.values()), max(some.values()), 0.0, 1.0
    a = 0.0 if (low / high) ** -1 <= settings.repetition else None
    if a is None:
        for _ in range(settings.steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if (low / high) ** (mid - 1) <= settings.repetition else (mid, hi)
        a = hi
    out = []
    for s, docs in tokens.items():
        n = total[s]
        quota = int(np.floor(n * round((n / sum(some.values())) ** (a - 1) / (high / sum(some.values())) ** (a - 1), 9))) if n else 0
        full, rest = (quota // n, quota % n) if n else (1, 0)
        key = lambda d, b: hashlib.md5(f"{settings.seed}:{b}:{'' if d is None else d}".encode()).hexdigest()
        sums = {}
        for d, t in docs:
            sums[key(d, full + 1)] = sums.get(key(d, full + 1), 0) + t
        before, at = {}, 0
        for k in sorted(sums):
            before[k], at = at, at + sums[k]
        for d, _ in docs:
            for b in range(1, full + 1 + (before[key(d, full + 1)] < rest)):
                out.append((d, s, b, key(d, b)))
    return sorted(out, key=repr)


def test_mixing_against_brute_force(spark, odd):
    rng = random.Random(2)
    data = [(i, " ".join(["w"] * rng.randint(0, 9)), "en", rng.choice(["a"] * 12 + ["b", "b", "c", None]), 0, "x") for i in range(300)]
    data += [(7, "again here", "en", "a", 0, "x")] * 3 + [(None, None, "en", "empty", 0, "x")]
    settings = mixing.Settings(repetition=1.7)
    got = mixing.mixed(spark.createDataFrame(data, SCHEMA), settings).collect()
    assert sorted(((r.doc_id, r.source, r.block, r.order_key) for r in got), key=repr) == brute_mix(data, settings)
    assert mixing.mixed(odd).count() >= odd.count() and mixing.mixed(odd.limit(0)).count() == 0


def test_exponent_for_an_entropy(spark):
    totals = spark.createDataFrame([("a", 700), ("b", 200), ("c", 100)], "source string, total bigint")
    a = mixing.exponent(totals, mixing.Settings(entropy=0.9, repetition=None))
    p = np.array([0.7, 0.2, 0.1]) ** a
    p /= p.sum()
    assert -(p * np.log(p)).sum() == pytest.approx(0.9 * np.log(3), abs=1e-6)


# ---- near duplicates


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("aBé \t\n\x0bxÄ") for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    hashed = spark.sql("select xxhash64('a b c') h").first().h  # the same hash as Spark's own
    assert simhash.fingerprint("A b\nC") == hashed % (1 << 64)


def brute_components(points, radius=2):
    label = list(range(len(points)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def near_points(seed, n):
    rng = np.random.default_rng(seed)
    points = [0]
    for _ in range(n):
        base = int(rng.integers(0, 1 << 63)) if rng.random() < 0.3 else points[int(rng.integers(len(points)))]
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            base ^= 1 << int(b)
        points.append(base)
    return np.unique(np.array(points, np.uint64))


def test_tree_and_shards_link_what_brute_force_links(spark):
    points = near_points(5, 3000)
    want = brute_components(points)
    label = {int(p): int(p) for p in points}
    find = lambda p: p if label[p] == p else find(label[p])
    for u, v in simhash.tree_links(points):
        for a, b in zip(u.tolist(), v.tolist()):
            label[find(a)] = find(b)
    groups = {}
    for p, w in zip(points.tolist(), want):
        groups.setdefault(w, set()).add(find(p))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    prints = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in graph.components(simhash.links(prints)).collect()}
    found = [roots.get(int(x), int(x)) for x in points.view(np.int64)]
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_dense_group_is_linked_whole():
    points = np.unique(np.array([(1 << a) ^ (1 << b) for a in range(48) for b in range(a)], np.uint64))
    linked = {int(p) for u, v in simhash.tree_links(points) for p in [*u, *v]}
    assert linked == set(points.tolist())


def test_components_of_a_long_chain(spark):
    links = spark.range(400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert graph.components(links).select("root").distinct().count() == 1
    assert graph.components(links.limit(0)).count() == 0


def test_near_duplicates_on_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == "0" * 16 and by[0].component_id == by[1].component_id == by[2].component_id == 0
    assert by[5].component_id == by[4].component_id == 4
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# ---- neighbours


def brute_neighbours(ids, vectors, k=5):
    out = {}
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for i in np.flatnonzero(ids % 50 == 0):
        scores = unit @ unit[i]
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-round(scores[j], 12), ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def test_neighbours_reach_the_recall_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    vectors[::3] = vectors[0]  # one vector has a third of all rows
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got = {}
    settings = neighbours.Settings(leaf=60, block=200)
    for r in neighbours.nearest_neighbours(frame.withColumn("leaf", F.lit("clash")), settings).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_neighbours(np.arange(3000), vectors.astype(float))
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    assert all(got[q] == want[q] for q in want if q % 3 == 0)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (8, [1.0]), (None, [1.0, 0.0]), (50, [0.0, 0.0]), (1, [2.0, 0.0]), (9, [])]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    got = neighbours.nearest_neighbours(frame).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 7)] and got[0].score == 1.0
    assert neighbours.nearest_neighbours(frame.limit(0)).count() == 0
    assert neighbours.nearest_neighbours(frame.where("vec_id = 2")).count() == 0


def exact_neighbours(data, k=5):
    """Over (id, vector) rows: cosines of vectors divided by their largest component, within each length."""
    clean = [(i, np.array(v) / np.max(np.abs(v))) for i, v in data]
    out = {}
    for q, u in clean:
        if q % 50 == 0:
            scored = {i: u @ w / np.sqrt((u @ u) * (w @ w)) for i, w in clean if i != q and len(w) == len(u)}
            out[q] = sorted(scored, key=lambda i: (-round(scored[i], 12), i))[:k]
    return out


def found_neighbours(spark, data, settings=None):
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest_neighbours(frame, settings or neighbours.Settings()).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_vectors_of_any_length_and_size_are_answered(spark):
    rng = np.random.default_rng(4)
    long = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    short = [(i, rng.normal(size=3).tolist()) for i in range(400, 520)]  # queries of a length that is not the commonest
    tiny = [(i, (rng.normal(size=5) * 1e-200).tolist()) for i in range(520, 640)]
    huge = [(i, (rng.normal(size=6) * 1e200).tolist()) for i in range(640, 760)]
    alone = [(1000, [1.0, 2.0])]
    data = long + short + tiny + huge + alone
    got, want = found_neighbours(spark, data), exact_neighbours(data)
    assert got.keys() == want.keys() - {1000}  # no other vector of its length
    assert all(got[q] == want[q] for q in got)


def test_lengths_outside_the_sample_are_searched_whole(spark):
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=4 + i // 30).tolist()) for i in range(300)]
    got, want = found_neighbours(spark, data, neighbours.Settings(sample=20)), exact_neighbours(data)
    drawn_late = [q for q in want if got[q] == want[q]]
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values()) and drawn_late


def test_leaves_of_few_rows_do_not_cost_neighbours(spark):
    rng = np.random.default_rng(6)
    outliers = [(50 * i, (10.0 * np.eye(40)[i]).tolist()) for i in range(40)]  # each far from all others
    crowd = [(2001 + 2 * i, (np.ones(40) + 0.01 * rng.normal(size=40)).tolist()) for i in range(400)]
    settings = neighbours.Settings(leaf=8, recall=0.01)  # one leaf is visited
    got = found_neighbours(spark, outliers + crowd, settings)
    assert len(got) == 40 and all(len(set(v)) == 5 for v in got.values())


# ---- queries and pipeline


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def folder_of(spark, tmp_path, docs, labels=()):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_near_duplicates_go_by_row(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    data = [(7, words, "a"), (3, words, "b"), (3, "a clean text under a key that a copy has too", "c"), (3, words, "d"), (None, words, "e"),
            (None, "only without a key", "f"), (None, "only without a key", "g"), (8, "", "h"), (9, None, "i"), (10, "  ", "j")]
    docs = spark.createDataFrame([(k, t, "en", s, None if t is None else len(t), k) for k, t, s in data], SCHEMA.replace("extra string", "row bigint"))
    kept = stage("near_duplicates")(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    left = sorted((r.source for r in kept.collect()))
    assert [s for s in left if s in "abde"] in (["b"], ["d"])
    assert "c" in left and len(set(left) & set("fg")) == 1 and [s for s in left if s in "hij"] == ["h"]
    assert len(left) == 4


def test_stages_take_odd_rows_and_empty_tables(spark, odd, tmp_path):
    clash = odd.withColumn("row", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("toxicity", F.lit(0.9)).withColumn("_path", F.lit("x"))
    folder = folder_of(spark, tmp_path, clash)
    kept = clash
    counts = {}
    for name, apply in corpus_pipeline.STAGES:
        kept = corpus_pipeline.materialize(apply(spark, kept, folder))
        counts[name] = kept.count()
        assert name == "pieces" or kept.columns == corpus_pipeline.COLUMNS
    assert counts["toxicity"] == odd.count()  # nothing is labelled
    # the three empty texts are one group, and so are the three rows of the repeated text
    assert counts["near_duplicates"] == counts["secrets"] == odd.count() - 4
    assert counts["mixing"] >= counts["secrets"] and counts["pieces"] == counts["mixing"]
    none = clash.limit(0)
    for name, apply in corpus_pipeline.STAGES:
        assert apply(spark, none, folder).count() == 0, name


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")
def test_pipeline_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.toPandas().set_index("doc_id")
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_DIR))
        frames.append((name, docs.toPandas()))
    toxic, distinct, clean, mixture, encoded = (f for _, f in frames)
    model = toxicity.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert all(list(f.columns) == corpus_pipeline.COLUMNS for f in (toxic, distinct, clean, mixture))
    assert set(toxic["doc_id"]) == {k for k, t in before["text"].items() if model.score(t) < 0.5} and 0 < len(toxic) < len(before)
    prints = {k: brute_fingerprint(t) for k, t in zip(toxic["doc_id"], toxic["text"])}
    ids = sorted(prints)
    label = brute_components(np.array([prints[i] for i in ids], np.uint64))
    assert sorted(distinct["doc_id"]) == sorted(ids[i] for i in set(label))
    secret = re.compile(r"token = \"[0-9a-f]{40}\"", re.I)
    assert not any(secret.search(t) for t in clean["text"]) and len(clean) == len(distinct)
    assert (clean["n_chars"] == clean["text"].str.len()).all()
    assert set(mixture["doc_id"]) == set(clean["doc_id"]) and len(mixture) >= len(clean)
    assert len(encoded) == len(mixture) and encoded["round_trip"].all()


def test_queries_are_registered():
    assert {re.match(r"op(\d+)_", q)[1] for q in registry.QUERIES} == {str(n) for n in range(1, 11)}
    assert set(registry.SQL) <= set(registry.QUERIES)
