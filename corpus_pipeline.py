"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents it keeps.

A stage reads the columns of documents and returns these alone, so extra columns, whatever their names, don't pass.
Null and empty texts, null keys and repeated rows are rows like any other; what becomes of them is said at each stage.
Empty documents give empty results, and without labels no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagscope.llm import mixing, pieces, secret_scan, simhash, toxicity
from bagscope.llm.base import table
from bagscope.operators.joins import lookup_join
from bagscope.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from the labelled ones among them.

    Equal texts go or stay together. Without labels all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("toxicity < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the row of the smallest key, of rows with equal keys one.

    A row goes by its own fingerprint, not by its key: another text under the same key stays, and repeats of a text,
    under one key or under none, leave one row. A null key is after all others. Empty texts are copies of each other.
    """
    numbered = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    found = simhash.near_duplicates(numbered.select(place.alias("doc_id"), "text"))
    removed = materialize(found.where("doc_id <> component_id").select("doc_id.row"))
    return lookup_join(numbered, removed, ["row"], "left_anti", broadcast_rows=1_000_000).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and their length counted anew; a null text stays null."""
    found = secret_scan.scan(docs.select(*COLUMNS), secret_scan.fit(docs))
    text = F.col("redacted")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to even the sources out; each row is given once at least, so none is lost."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each row of the mixture; a null or empty text has no tokens."""
    return pieces.tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained classifiers and the encoder are outside SQL; tests compare with a brute-force version.
ORACLE_SQL = None
