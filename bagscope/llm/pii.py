"""Personal data: base patterns, and terms that disclose what they match by corpus co-occurrence.

Base matches are the protected entities. The terms of their documents are measured against the whole corpus: the
pointwise mutual information of a term and an entity, as a share of the entity's own information, tells how strongly
the term reveals it. Terms beyond a threshold are marked in all texts, and generalised or removed with the entities.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagscope.llm.base import small_batches
from bagscope.operators.joins import fits_broadcast, lookup_join
from bagscope.session import materialize

# The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_ASCII_WORD = re.compile(r"[a-z]{3,}")
#: Marked terms, and their bytes, that are sent to all tasks; beyond that they are joined to the texts' words.
TERMS, TERM_BYTES = 500_000, 16 << 20
#: Different words that a task counts before it hands its counts on.
COUNTED = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``window``: code points on either side of an entity whose words are its context; ``support``: different
    contexts that must show a term with an entity; ``disclosure``: share of the entity's information from
    which a term is marked."""

    window: int = 80
    support: int = 3
    disclosure: float = 0.6


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches. Each is found from its @: back over the local part, but not into the match before."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four number parts between dots, each at most 255. Runs of digits and dots are cut into parts once."""
    out = []
    for run in _NUMBERS.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = [], run.start()
        for part in run.group().split("."):
            parts = [*parts, (at, part)] if part else []
            at += len(part) + 1
            if len(parts) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for _, p in parts):
                    out.append((parts[0][0], parts[3][0] + len(parts[3][1])))
                parts = []
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    text = text or ""
    finders = zip(KINDS, (emails, ips, cards, phones))
    return [(kind, a, b) for kind, find in finders for a, b in find(text)]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def words_outside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words of a text that touch no span, in order."""
    cuts: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if cuts and a <= cuts[-1][1]:
            cuts[-1][1] = max(b, cuts[-1][1])
        else:
            cuts.append([a, b])
    out, k = [], 0
    for m in _WORD.finditer(text):
        start, end = m.span()
        while k < len(cuts) and cuts[k][1] <= start:
            k += 1
        if k == len(cuts) or cuts[k][0] >= end:
            out.append((m.group().lower(), start, end))
    return out


def words_of(text: str) -> list[str]:
    """The words of a text without spans, in order, as :func:`words_outside` gives them."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    if "\u0130" in text or "\u03a3" in text:  # letters that lower case turns into more than one, or by what stands beside them
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def _hash(words) -> int:
    print_ = hashlib.blake2b("\x00".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(print_, "little", signed=True)


def occurrences(text: str, spans: list[tuple[str, int, int]], words: list[tuple[str, int, int]], window: int) -> list[dict]:
    """For each entity of a text its contexts and ``near``, the (term, context) of the words in the window around it.

    ``context`` is a hash of the words of the window: copies of a passage are one context. ``first`` is 1 for
    one context of each term and 0 for the others, so that its sum counts the text once.
    """
    starts, ends, found = [w[1] for w in words], [w[2] for w in words], {}
    for kind, a, b in spans:
        entity = text[a:b].lower() if kind == "email" else re.sub(r"[^0-9.+]", "", text[a:b])
        near = [w for w, _, _ in words[bisect_left(starts, a - window) : bisect_right(ends, b + window)]]
        contexts, pairs = found.setdefault((kind, entity), (set(), {}))
        context = _hash(near)
        contexts.add(context)
        for term in near:
            pairs[term, context] = None
    out = []
    for (kind, entity), (contexts, pairs) in found.items():
        seen: set[str] = set()
        near = [{"term": t, "context": c, "first": int(t not in seen and not seen.add(t))} for t, c in pairs]
        out.append({"kind": kind, "entity": entity, "contexts": len(contexts), "near": near})
    return out


NEAR = "array<struct<term: string, context: bigint, first: int>>"
DETECTED = f"entities array<struct<kind: string, entity: string, contexts: int, near: {NEAR}>>, words array<string>, context bigint, terms array<string>, counts array<bigint>"


def detect(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What one pass over the texts finds, as rows of two kinds.

    A document with entities gives ``entities`` (with the words in their windows), ``words`` (different ones outside the
    spans) and ``context`` (a hash of all words in order). Every task also gives its ``terms`` with ``counts``, the number
    of its documents that hold each, whenever it has met COUNTED different ones, and at its end.
    """
    small_batches(documents.sparkSession)
    near = pa.list_(pa.struct([("term", pa.string()), ("context", pa.int64()), ("first", pa.int32())]))
    entity = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("contexts", pa.int32()), ("near", near)]))
    kinds = {"entities": entity, "words": pa.list_(pa.string()), "context": pa.int64(), "terms": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}

    def rows(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * n), t) for k, t in kinds.items()], names=list(kinds))

    def counted(held: Counter):
        terms = list(held)
        for i in range(0, len(terms), 1 << 14):
            part = terms[i : i + (1 << 14)]
            yield rows(terms=[part], counts=[[held[t] for t in part]])

    def mapped(batches):
        held: Counter = Counter()
        for batch in batches:
            entities, words, context = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                if not spans:
                    held.update(set(words_of(text)))
                    continue
                outside = words_outside(text, spans)
                entities.append(occurrences(text, spans, outside, settings.window))
                words.append(list(dict.fromkeys(w for w, _, _ in outside)))
                context.append(_hash(w for w, _, _ in outside))
                held.update(words[-1])
            if entities:
                yield rows(entities=entities, words=words, context=context)
            if len(held) > COUNTED:
                yield from counted(held)
                held = Counter()
        yield from counted(held)

    return documents.select("text").mapInArrow(mapped, DETECTED)


def disclosing(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """kind, entity, term and ``disclosure`` of the terms that reveal an entity beyond the threshold.

    With N documents, n(e) of them with the entity, d(t) with the term and n(e, t) with both, near or not:
    log(N n(e, t) / (n(e) d(t))) / log(N / n(e)). All four count documents, copies too; a word within a span is no
    term. Different contexts are counted for the support only: the window where the term is near the entity, else
    all words of the document, so that copies of a passage or a document count once.

    What can't reach the threshold is left out before terms and entities meet: entities of too few contexts,
    and, as n(e, t) <= n(e), terms of more than N (n(e) / N) ** disclosure documents for the largest n(e).
    """
    every = materialize(detect(documents, settings))  # the texts are looked through once
    found = every.where("entities is not null").select(F.explode("entities").alias("e"), "words", "context")
    found = found.select("e.kind", "e.entity", "e.contexts", "e.near", "words", "context")
    entities = found.groupBy("kind", "entity").agg(F.count("*").alias("n_entity"), F.sum("contexts").alias("contexts"))
    entities = materialize(entities.where(F.col("contexts") >= settings.support).drop("contexts"))
    most = entities.agg(F.max("n_entity")).first()[0]
    if most is None:
        return entities.select("kind", "entity", F.lit("").alias("term"), F.lit(1.0).alias("disclosure"))
    counted = every.where("terms is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    counted = materialize(counted.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n_term")))
    total = float(max(2, documents.count()))
    bound = total * (most / total) ** settings.disclosure * (1 + 1e-9)
    common = counted.where(F.col("n_term") > bound).select("term")
    live = lookup_join(found.drop("contexts"), entities.select("kind", "entity"), ["kind", "entity"])
    far = F.transform(F.array_except("words", F.transform("near", lambda x: x["term"])), lambda t: F.struct(t.alias("term"), F.col("context").alias("context"), F.lit(1).alias("first")))
    met = live.select("kind", "entity", F.explode(F.concat("near", far)).alias("t")).select("kind", "entity", "t.term", "t.context", "t.first")
    met = lookup_join(met, common, ["term"], "left_anti")
    together = met.groupBy("kind", "entity", "term", "context").agg(F.sum("first").alias("n_both"))
    together = together.groupBy("kind", "entity", "term").agg(F.sum("n_both").alias("n_both"), F.count("*").alias("contexts"))
    together = together.where(F.col("contexts") >= settings.support).drop("contexts").join(entities, ["kind", "entity"])
    own = F.greatest(F.log(F.lit(total) / F.col("n_entity")), F.lit(1e-9))
    share = F.log(F.lit(total) * F.col("n_both") / (F.col("n_entity") * F.col("n_term"))) / own
    return together.join(counted, "term").select("kind", "entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= settings.disclosure)


def _words_of_rows(rows: DataFrame) -> DataFrame:
    """row and term of the different words of every text."""

    def mapped(batches):
        for batch in batches:
            words = [sorted(set(words_of(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(words, pa.list_(pa.string()))], names=["row", "words"])

    return rows.select("row", "text").mapInArrow(mapped, "row bigint, words array<string>").select("row", F.explode("words").alias("term"))


def sanitise(documents: DataFrame, settings: Settings = Settings(), generalise: bool = True, terms: int = TERMS) -> DataFrame:
    """doc_id, base and spans (arrays of spans) and ``redacted`` text of every document.

    ``spans`` are the base spans, and after them every occurrence of a term that discloses an entity of the
    corpus, in whichever text it stands. ``redacted`` has them replaced by their kind, or removed. A null text
    stays null and, like an empty one, has no spans; repeated rows each get their own; an empty table gives none.

    The terms go to all tasks while they are measured to be ``terms`` and TERM_BYTES at most, and the texts are not
    shuffled. Beyond that the words of the texts are joined to them, and each text gets its own terms.
    """
    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    listed = materialize(disclosing(documents, settings).select("term").distinct())
    rows = documents.select("doc_id", "text")
    if fits_broadcast(listed, terms, TERM_BYTES):
        marked = spark.sparkContext.broadcast(frozenset(r.term for r in listed.toLocalIterator()))
    else:
        marked = None
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
        own = lookup_join(_words_of_rows(rows), listed, ["term"], "left_semi").groupBy("row").agg(F.collect_set("term").alias("terms"))
        rows = rows.join(own, "row", "left").drop("row")

    def mapped(batches):
        for batch in batches:
            base, spans, texts = [], [], []
            every = batch.column("text").to_pylist()
            own_terms = [marked.value] * len(every) if marked else [frozenset(x or ()) for x in batch.column("terms").to_pylist()]
            for text, known in zip(every, own_terms):
                own = base_spans(text)
                # a text without any of the terms needs no places of words
                held = known and not known.isdisjoint(words_of(text or ""))
                more = own + [(TERM, a, b) for w, a, b in words_outside(text, own) if w in known] if held else own
                base.append([dict(zip(("kind", "start", "end"), x)) for x in own])
                spans.append([dict(zip(("kind", "start", "end"), x)) for x in more])
                texts.append(None if text is None else redacted(text, more, generalise) if more else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(spans, span), pa.array(texts, pa.string())], names=["doc_id", "base", "spans", "redacted"])

    of = "array<struct<kind: string, start: int, end: int>>"
    return rows.mapInArrow(mapped, f"doc_id {kind}, base {of}, spans {of}, redacted string")


def redacted(text: str, spans, generalise: bool = True) -> str:
    """A text with its spans replaced by their kind, or removed; overlapping spans are replaced as one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if b <= at:
            continue
        out.append(text[at : max(at, a)])
        if a >= at and generalise:
            out.append(f"[{kind.upper()}]")
        at = b
    return "".join([*out, text[at:]])


def personal_data(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, the number of base matches of each kind, base_sha256, all spans, n_term and redacted_sha256 of every document.

    ``n_term`` counts the marked terms; ``redacted_sha256`` is of the text with all spans replaced by their kind, null
    for a null text. Null and empty texts have no spans; repeated rows and null keys each get their own row; an empty
    table gives none; other columns are not looked at.
    """
    found = sanitise(documents.select("doc_id", "text"), settings)

    def text_of(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number_of(kind: str, spans: str = "base"):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    digests = F.sha2(text_of("base"), 256).alias("base_sha256"), text_of("spans").alias("spans")
    return found.select("doc_id", *map(number_of, KINDS), *digests, number_of(TERM, "spans"), F.sha2("redacted", 256).alias("redacted_sha256"))
