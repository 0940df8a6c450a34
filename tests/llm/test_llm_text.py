"""Operators on texts against brute force: toxicity, languages, pieces, personal data, fingerprints."""

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest

from bagscope.llm import fingerprints, langid, pieces, pii, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
LONG = "alpha beta gamma " * 6000


def rows(texts, lang="en"):
    return [(i, t, lang, "s", None if t is None else len(t), "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long, repeated and letterless texts, a null key, a repeated row."""
    texts = [None, "", "   ", LONG, "same text here", "same text here", "123 456", "ünï ☃ 🙂"]
    data = rows(texts) + [(4, "same text here", "en", "s", 14, "x"), (None, "no key", None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def crc(key):
    return zlib.crc32(("" if key is None else str(key)).encode())


# ---- toxicity


def toxic_texts(n, seed):
    rng = random.Random(seed)
    words = ["table", "window", "river", "green", "little", "morning", "paper", "stone", "garden", "letter"]
    bad = ["zorgh" + x for x in ("ak", "ik", "uk", "ek", "ok", "el", "ul", "an")]
    out = []
    for i in range(n):
        own = [rng.choice(words) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randint(5, 120))]
        label = i % 2
        if label:
            own[rng.randrange(len(own))] = rng.choice(bad[:4] if seed == 1 else bad[4:])
        out.append((" ".join(own), label))
    return out


def test_toxicity_learns_unseen_spellings():
    train, test = toxic_texts(300, 1), toxic_texts(200, 2)  # the test texts use endings that training never saw
    model = toxicity.train([t for t, _ in train], [y for _, y in train])
    wrong = sum((model.score(t) >= 0.5) != bool(y) for t, y in test)
    assert wrong <= 10


def test_toxicity_of_one_word_is_the_mean_over_its_ngrams():
    model = toxicity.train(*zip(*toxic_texts(60, 1)), toxicity.Settings(rounds=2, steps=3))
    word = "zorghak"
    from bagscope.llm.ngrams import bucket

    codes = np.array([0, *map(ord, word), 0], np.uint64)
    values = []
    for n in toxicity.SIZES:
        for i in range(len(codes) - n + 1):
            h = np.uint64(0)
            for c in codes[i : i + n]:
                h = np.uint64((int(h) * 0x100000001B3 + int(c)) & (2**64 - 1))
            h = np.uint64((int(h) + n * 0x632BE59BD9B4E019) & (2**64 - 1))
            values.append(model.weights[bucket(np.array([h]), model.bits)[0]])
    assert toxicity.best_word(word, model.weights, model.bias, model.bits) == pytest.approx(np.mean(values) + model.bias, rel=1e-5)


def test_toxicity_query_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (4, 0), (6, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(odd, labels, toxicity.Settings(rounds=1, steps=1)).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


# ---- languages


def test_languages_on_odd_rows_and_held_out(spark, odd):
    rng = random.Random(3)
    stems = {"aa": ["bal", "kor", "mun"], "bb": ["xee", "quii", "voo"]}
    data = [(i, " ".join(rng.choice(stems[l]) + rng.choice(stems[l]) for _ in range(12)), l, "s", 0, "x") for i in range(160) for l in [rng.choice("ab") * 2]]
    docs = spark.createDataFrame(data, SCHEMA)
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    assert all(got[d[0]].lang_pred == d[2] for d in data if crc(d[0]) % 4 == 2)
    assert all(r.held_out == (crc(k) % 4 == 2) for k, r in got.items())
    odd_rows = langid.languages(odd).collect()
    assert len(odd_rows) == odd.count()
    assert {r.doc_id: r.lang_pred for r in odd_rows}[0] == {r.doc_id: r.lang_pred for r in odd_rows}[6] == "und"
    assert langid.languages(odd.limit(0)).count() == 0


def test_ftrl_soft_threshold_gives_sparse_weights():
    rng = np.random.default_rng(0)
    rows_, y = [], rng.integers(0, 2, 200)
    for label in y:
        rows_.append((np.array([label, 2 + rng.integers(50)]), np.array([1.0, 0.05])))
    strong = langid.ftrl(rows_, y, 2, 60, langid.Settings(l1=2.0))[0]
    weak = langid.ftrl(rows_, y, 2, 60, langid.Settings(l1=0.0, l2=0.0))[0]
    assert (strong == 0).sum() > (weak == 0).sum() and (strong[:2] != 0).any()


def test_document_frequencies_count_every_text(spark):
    texts = ["ab", "ab ab", "cd", ""]
    n, found = langid.document_frequencies(spark.createDataFrame(rows(texts), SCHEMA), 15)
    want = sum((langid.counts(t, 15) > 0).astype(int) for t in texts)
    assert n == 4 and (found == want).all()


# ---- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def test_pieces_equal_the_library(vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    texts = ["", " ", "  a", "a\n\nb ☃ ﬁ①", " " * 40 + "x", "x" * 500, "日本語 🙂🙂", "Straße ünïcödé", "def f(x):\n    return  x**2"]
    texts += ["".join(rng.choice("aeinrst  .,\n123é") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    encoder = pieces.Encoder(vocabulary)
    for _ in range(2):  # the second time words come from memory
        ids, counts = encoder.encode(texts)
        ends = np.cumsum(counts)
        got = [ids[e - c : e].tolist() for e, c in zip(ends, counts)]
        assert got == library.encode(texts)
    assert [encoder.decode(np.array(g, int)) for g in got] == texts


def test_unigram_viterbi_against_all_segmentations():
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca"]
    scores = np.array([-2.0, -3, -3.1, -3.3, -4.05, -4.2, -6.6, -3.4, -5.1, -4.7])
    v = pieces.Vocabulary(["<unk>", *words], np.append(-50.0, scores), np.array([2] + [0] * len(words), np.int8), False, 0)
    encoder = pieces.Encoder(v)
    score = dict(zip(words, scores))

    def best(text):
        out = [(0.0, [])]
        for end in range(1, len(text) + 1):
            options = [(out[s][0] + score[text[s:end]], [*out[s][1], text[s:end]]) for s in range(end) if text[s:end] in score and out[s]]
            out.append(max(options, key=lambda o: o[0]) if options else None)
        return out[-1]

    for text in ("".join(p) for n in range(1, 6) for p in product("abc", repeat=n)):
        ids, _ = encoder.encode([text])
        got = [v.pieces[i] for i in ids]
        assert "".join(got) == "▁" + text
        assert sum(score[p] for p in got) == pytest.approx(best("▁" + text)[0])


def test_pieces_on_odd_rows(spark, odd):
    got = pieces.encoded(odd.withColumn("ids", odd.doc_id)).collect()
    assert len(got) == odd.count() and all(r.round_trip for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].n_tokens == by_id[1].n_tokens == 0 and len(by_id[3].ids) == by_id[3].n_tokens > 10000 and by_id[4].extra == "x"
    assert pieces.tokens(odd.limit(0)).count() == 0


# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for alphabet in ("a@.b-1", "12. 0", "+1 2()-.3", "a1@.+ -5é_", "0123456789 -"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("1" * 200_000 + "." * 50_000 + "x@" * 50_000) == brute_spans("1" * 13 + "x")[:0]


def test_terms_that_disclose_an_entity_are_marked(spark):
    texts = [f"{a} writes to jo.x@mail.example.com about {b} Zanzibarite today" for a, b in zip(["Sun", "Moon", "Star", "Tree"], ["red", "blue", "dim", "old"])]
    texts += [f"today somebody writes about thing {i} and about something else" for i in range(40)] + [None, ""]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    for i in range(4):
        shown = [(s.kind, texts[i][s.start : s.end]) for s in got[i].spans]
        assert ("email", "jo.x@mail.example.com") in shown and ("term", "Zanzibarite") in shown
        assert ("term", "about") not in shown and ("term", "writes") not in shown
        assert [tuple(s) for s in got[i].base] == pii.base_spans(texts[i])
        assert pii.redacted(texts[i], [tuple(s) for s in got[i].spans]).count("[EMAIL]") == 1
    assert all(not got[i].spans for i in range(4, 46))


def test_copies_of_a_passage_are_one_context(spark):
    texts = ["the Zanzibarite wrote to jo.x@mail.example.com yesterday"] * 10 + [f"plain text {i}" for i in range(30)]
    got = pii.sanitise(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert all(s.kind != "term" for r in got for s in r.spans)


def test_copies_of_one_passage_do_not_hide_a_term(spark):
    """Of four passages one stands in 100 documents: every document with the term holds the entity."""
    passages = [f"{a} Zanzibarite wrote to jo.x@mail.example.com {b}" for a, b in zip(["Sun", "Moon", "Star", "Tree"], ["red", "blue", "dim", "old"])]
    texts = passages + passages[:1] * 99 + [f"plain text {i}" for i in range(300)]
    got = pii.sanitise(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert all(("term", "Zanzibarite") in [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in got if r.doc_id < 103)
    assert all(not r.spans for r in got if r.doc_id >= 103)


def test_terms_far_from_the_entity_are_counted_and_marked_everywhere(spark):
    """The name is in the heading and the address in the signature; another text has the name alone."""
    body = [" ".join(f"filler{chr(97 + i)}{chr(97 + j % 26)}" for j in range(60)) for i in range(4)]
    texts = [f"Zanzibarite report\n{b}\nwrite to jo.x@mail.example.com" for b in body]
    texts += ["we met Zanzibarite twice, Zanzibarite said"] + [f"plain report {i}" for i in range(200)] + [None, ""]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    for i in range(4):
        assert ("term", 0, 11) in [tuple(s) for s in got[i].spans]
        assert got[i].redacted.startswith("[TERM] report") and got[i].redacted.endswith("[EMAIL]")
    assert got[4].redacted == "we met [TERM] twice, [TERM] said" and not got[4].base
    assert all(got[i].redacted == texts[i] and not got[i].spans for i in range(5, len(texts)))


def test_disclosure_against_brute_force(spark):
    import math

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    texts = [" ".join([word() for _ in range(rng.randint(0, 30))] + rng.choices(["jo@a.com", "x@b.org", "10.1.2.3", "and so"], k=rng.randint(0, 2)) + [word() for _ in range(rng.randint(0, 30))]) for _ in range(300)]
    texts += texts[:40]
    settings = pii.Settings(window=30, disclosure=0.2)
    entity, pair, term, support = {}, {}, {}, {}
    for text in texts:
        spans = pii.base_spans(text)
        words = [(m.group().lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", text) if not any(m.start() < b and m.end() > a for _, a, b in spans)]
        for w in {w for w, _, _ in words}:
            term[w] = term.get(w, 0) + 1
        for e in {(k, text[a:b]) for k, a, b in spans}:
            entity[e] = entity.get(e, 0) + 1
            windows = [tuple(w for w, s, t in words if s >= a - 30 and t <= b + 30) for k, a, b in spans if (k, text[a:b]) == e]
            for w in {w for w, _, _ in words}:
                pair[*e, w] = pair.get((*e, w), 0) + 1
                support.setdefault((*e, w), set()).update([x for x in windows if w in x] or [tuple(["all"] + [w for w, _, _ in words])])
    share = {p: math.log(len(texts) * n / (entity[p[:2]] * term[p[2]])) / math.log(len(texts) / entity[p[:2]]) for p, n in pair.items() if len(support[p]) >= settings.support}
    want = {p: x for p, x in share.items() if x >= settings.disclosure}
    got = {(r.kind, r.entity, r.term): r.disclosure for r in pii.disclosing(spark.createDataFrame(rows(texts), SCHEMA), settings).collect()}
    assert len(want) > 5 and got == pytest.approx(want)


def test_words_without_places_are_the_words_outside():
    rng = random.Random(11)
    parts = ["ab", "Cde", "ΣΑΣ", "İx", "ß", "é", "'", " ", "12", "_", "日本語", "ŉab", "ǅa"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.words_of(text) == [w for w, _, _ in pii.words_outside(text, [])], text


def test_texts_are_looked_through_once_and_joined_terms_mark_the_same(spark, monkeypatch):
    body = [" ".join(f"filler{chr(97 + i)}{chr(97 + j % 26)}" for j in range(60)) for i in range(4)]
    texts = [f"Zanzibarite report\n{b}\nwrite to jo.x@mail.example.com" for b in body]
    texts += ["we met Zanzibarite twice", "we met Zanzibarite twice"] + [f"plain report {i}" for i in range(200)] + [None, ""]
    docs = spark.createDataFrame(rows(texts) + [(None, "Zanzibarite", None, None, None, None)], SCHEMA)
    passes, detect = [], pii.detect
    monkeypatch.setattr(pii, "detect", lambda *args: passes.append(1) or detect(*args))
    key = lambda r: (str(r.doc_id), str(r.redacted), str(r.spans))
    sent = sorted(pii.sanitise(docs).collect(), key=key)
    assert passes == [1]
    monkeypatch.setattr(pii, "COUNTED", 3)
    joined = sorted(pii.sanitise(docs, terms=0).collect(), key=key)
    assert sent == joined and sum(r.redacted is not None and "[TERM]" in r.redacted for r in sent) == 7
    digests = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert digests[4].n_term == 1 and digests[4].redacted_sha256 == hashlib.sha256(b"we met [TERM] twice").hexdigest()


def test_personal_query_on_odd_rows(spark, odd):
    got = pii.personal_data(odd).collect()
    assert len(got) == odd.count() and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in got)
    assert pii.personal_data(odd.limit(0)).count() == 0


def test_toxicity_without_labels_rejects_nothing(spark, odd):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for given in (labels, spark.createDataFrame([(i, 1, None) for i in range(9)], "doc_id bigint, quality int, toxic int")):
        got = toxicity.toxicity(odd, given).collect()
        assert len(got) == odd.count() and all(r.predicted == 0 and r.score < 0.5 for r in got)


def test_toxicity_draws_different_texts_under_one_key(spark, monkeypatch):
    key = next(i for i in range(100) if crc(i) % 5)
    texts = [f"text number {i}" for i in range(30)] + ["the same text"] * 50
    labels = spark.createDataFrame([(key, 1, 1)], "doc_id bigint, quality int, toxic int")
    drawn = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, settings: drawn.append((texts, toxic)))
    docs = spark.createDataFrame([(key, t) for t in texts], "doc_id bigint, text string")
    toxicity.fit(docs, labels, toxicity.Settings(per_class=100))
    assert drawn == [(sorted(set(texts)), [1] * 31)]
    toxicity.fit(docs, labels, toxicity.Settings(per_class=7))
    assert len(drawn[1][0]) == len(set(drawn[1][0])) == 7


# ---- fingerprints


def test_walk_against_a_plain_loop():
    texts = ["", "a", "hello world", "x" * 300, "the quick brown fox " * 30]
    got = fingerprints.fingerprints(texts)
    records, moves, written = fingerprints._records(), fingerprints._moves(), fingerprints._written()
    for text, row in zip(texts, got):
        symbols, place, seen = [*fingerprints._symbols(text).tolist(), 0] if text else [0], 0, []
        for j in range(2 * len(text)):
            seen.append(symbols[place])
            place += int(moves[j % fingerprints.PERIOD, symbols[place]])
        for g in range(fingerprints.SLOTS):
            step = max((s for s in records[g] if s < len(seen)), default=None)
            assert row[g] == written[g, seen[step] if step is not None else 0]


def test_likeness_follows_edits():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    text = " ".join(word() for _ in range(400))
    few = text.replace(text[900:903], "", 1)
    other = " ".join(word() for _ in range(400))
    prints = fingerprints.fingerprints([text, few, other, text])
    like = lambda a, b: fingerprints.likeness(prints[a : a + 1], prints[b : b + 1])[0]
    assert like(0, 3) == 1 and like(0, 1) > 0.8 > 0.4 > like(0, 2)


def test_edited_against_brute_force(spark, odd):
    rng = random.Random(4)
    texts = [None, "", "ab", LONG] + ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(5)
    got = {r.doc_id: r for r in fingerprints.with_edited(docs).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after = plain[(i + 1) % len(plain)]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        own, edit, nxt = fingerprints.fingerprints([t, edited, after])
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == own.tobytes().hex() and got[i].edited_fingerprint == edit.tobytes().hex()
        assert got[i].near_edited == (own == edit).mean() and got[i].near_next == (own == nxt).mean()
    assert fingerprints.with_edited(odd).count() == odd.count()
    assert fingerprints.with_edited(odd.limit(0)).count() == 0 and fingerprints.with_edited(odd.limit(1)).count() == 1


def test_near_groups(spark, odd):
    rng = random.Random(6)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)) for _ in range(5)]
    texts = [b if k == 0 else b[:700] + rng.choice("xyz") + b[700:] for b in base for k in range(4)]
    got = {r.doc_id: r.group_id for r in fingerprints.near_groups(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert got == {i: i - i % 4 for i in range(20)}
    assert fingerprints.near_groups(odd).count() == odd.count() and fingerprints.near_groups(odd.limit(0)).count() == 0
