"""Secret scan: candidates in whole texts, kept or dropped by a random forest trained on labelled findings.

Everything is built-in expressions: candidates, features, the forest itself (as nested conditions) and the
redaction are evaluated in the scan of the texts, so no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A whole run of token characters with at least one digit. The guards make every run be read once.
CANDIDATE = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])[A-Za-z0-9+/_.-]{12,}+={0,2}"
CONTEXT = 48
REPLACEMENT = "[SECRET]"

# Words beside a value that name a credential, and words that name another kind of token.
CREDENTIAL_WORDS = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "access_key", "private_key", "client_secret", "auth", "bearer", "credential"]
OTHER_WORDS = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "etag", "revision", "build", "version", "id", "isbn", "order", "serial"]
SAMPLE_PATHS = ["test", "spec", "example", "sample", "mock", "fixture", "docs"]

ASSIGNED = r"[=:]>?\s*[\"'`]?$"
FEATURES = ["size", "runs", "digits", "hexadecimal", "upper", "dots", "vowel_pairs", "coverage", "credential", "other", "assigned", "quoted", "sample_path"]


@dataclass(frozen=True)
class Settings:
    """``findings`` bounds the labelled findings taken from the corpus, ``dictionary`` the words of the dictionary."""

    findings: int = 4000
    dictionary: int = 150
    trees: int = 15
    depth: int = 5
    threshold: float = 0.5
    seed: int = 11


def _any(words: list[str]) -> str:
    return "(?i)(?<![a-z])(" + "|".join(words) + ")(?![a-z])"


def candidates(text: Column) -> Column:
    """An array of (value, before, after) of a text, in order; an empty array for null."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.split(text, CANDIDATE)
    return F.transform(
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)),
        lambda v, k: F.struct(
            v.alias("value"), F.right(F.get(pieces, k), F.lit(CONTEXT)).alias("before"), F.left(F.get(pieces, k + 1), F.lit(CONTEXT)).alias("after")
        ),
    )


def features(value: Column, before: Column, after: Column, path: Column, dictionary: list[str]) -> dict[str, Column]:
    """The named features of a candidate, all doubles: its length, its character transitions, how much of it
    dictionary words cover, the words beside it and its path."""
    size = F.length(value).cast("double")
    lower = F.lower(value)

    def share(pattern: str) -> Column:
        return (size - F.length(F.regexp_replace(value, pattern, ""))) / size

    words = "|".join(sorted(dictionary, key=lambda w: (-len(w), w))) or "(?!)"
    near = F.lower(F.right(before, F.lit(24)))
    return {
        "size": size,
        "runs": (F.length(F.regexp_replace(value, "[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+", "#")) - 1) / size,
        "digits": share("[0-9]"),
        "hexadecimal": share("[0-9a-f]"),
        "upper": share("[A-Z]"),
        "dots": share("[.]"),
        "vowel_pairs": (size - F.length(F.regexp_replace(lower, "[aeiou][b-df-hj-np-tv-z]", "#"))) / size,
        "coverage": (size - F.length(F.regexp_replace(lower, words, ""))) / size,
        "credential": near.rlike(_any(CREDENTIAL_WORDS)).cast("double"),
        "other": near.rlike(_any(OTHER_WORDS)).cast("double"),
        "assigned": before.rlike(ASSIGNED).cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
        "sample_path": F.coalesce(path, F.lit("")).rlike(_any(SAMPLE_PATHS)).cast("double"),
    }


def seed_findings(spark: SparkSession) -> DataFrame:
    """Labelled findings made by rule: each naming word before values of several shapes, taken from md5 sums.

    A value assigned to a credential's name is a true finding (1); the same shapes under the name of a
    checksum, commit or identifier, host names and numbers are false ones (0).
    """
    names = F.array(*[F.struct(F.lit(w).alias("name"), F.lit(1).alias("label")) for w in CREDENTIAL_WORDS], *[F.struct(F.lit(w).alias("name"), F.lit(0).alias("label")) for w in OTHER_WORDS])
    rows = spark.range(0, 12, numPartitions=1).select("id", F.explode(names).alias("n"))
    digest = F.md5(F.concat_ws(":", "n.name", F.col("id").cast("string")))
    mixed = F.translate(F.base64(F.unhex(digest)), "=", "")
    shapes = F.array(
        F.struct(F.concat(digest, F.left(digest, F.lit(8))).alias("value"), F.col("n.label").alias("label")),
        F.struct(mixed.alias("value"), F.col("n.label").alias("label")),
        F.struct(F.left(mixed, F.lit(20)).alias("value"), F.col("n.label").alias("label")),
        F.struct(F.concat(F.lit("mail"), F.left(F.regexp_replace(digest, "[a-f]", ""), F.lit(2)), F.lit(".example.com")).alias("value"), F.lit(0).alias("label")),
        F.struct(F.left(F.regexp_replace(F.concat(digest, digest), "[a-f]", ""), F.lit(16)).alias("value"), F.lit(0).alias("label")),
    )
    rows = rows.select("id", "n.name", F.explode(shapes).alias("s"))
    signs = F.array(F.lit(' = "'), F.lit(": "), F.lit("='"))
    sign = F.element_at(signs, (F.col("id") % 3 + 1).cast("int"))
    return rows.select(
        F.col("s.value").alias("value"),
        F.concat(F.lit("x "), "name", sign).alias("before"),
        F.concat(F.right(sign, F.lit(1)), F.lit(" y")).alias("after"),
        F.lit("src").alias("path"),
        F.col("s.label").alias("label"),
    )


def corpus_findings(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """At most ``findings`` candidates of the corpus, labelled by what is known of them without a model.

    A true finding is assigned to a credential's name and has 20 characters or more; a false one has no
    naming word before it and is neither assigned nor quoted. The rest stay without a label and are left out.
    The bound is met by a hash of the value, and equal findings count once.
    """
    path = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = documents.where(F.col("text").rlike("[0-9]")).select(F.explode(candidates(F.col("text"))).alias("c"), path.alias("path"))
    near = F.lower(F.right("c.before", F.lit(24)))
    named, other = near.rlike(_any(CREDENTIAL_WORDS)), near.rlike(_any(OTHER_WORDS))
    assigned = F.col("c.before").rlike(ASSIGNED)
    label = F.when(named & assigned & (F.length("c.value") >= 20), 1).when(~named & ~other & ~assigned, 0)
    rows = rows.select("c.value", "c.before", "c.after", "path", label.alias("label")).where("label is not null")
    return rows.distinct().orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after", "path").limit(settings.findings)


def dictionary(documents: DataFrame, settings: Settings = Settings()) -> list[str]:
    """The words of 3 to 12 plain letters that most documents hold; ties go to the first in the alphabet."""
    words = documents.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word"))
    counted = words.where(F.length("word").between(3, 12)).groupBy("word").count()
    return [r.word for r in counted.orderBy(F.desc("count"), "word").limit(settings.dictionary).collect()]


class Forest:
    """The trees of a fitted forest as one column expression over the features."""

    def __init__(self, trees: list, words: list[str]):
        self.trees, self.words = trees, words

    def score(self, named: Column) -> Column:
        """The mean share of true findings in the leaves that a struct of features falls into."""
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + self._node(tree, named)
        return total / F.lit(float(max(1, len(self.trees))))

    def _node(self, node, named: Column) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, threshold, left, right = node
        return F.when(named[name] <= threshold, self._node(left, named)).otherwise(self._node(right, named))


def _plain(node) -> float | tuple:
    if node.numDescendants() == 0:
        stats = list(node.impurityStats().stats())
        return float(stats[1] / sum(stats)) if len(stats) > 1 and sum(stats) else 0.0
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _plain(node.leftChild()), _plain(node.rightChild())


def train(findings: DataFrame, words: list[str], settings: Settings = Settings()) -> Forest:
    """Fit the forest on findings (value, before, after, path, label)."""
    named = features(*(F.col(c) for c in ("value", "before", "after", "path")), words)
    rows = findings.select(*[c.alias(n) for n, c in named.items()], F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip").transform(rows)
    learner = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, featureSubsetStrategy="sqrt")
    model = learner.fit(rows.select("features", "label"))
    return Forest([_plain(tree._java_obj.rootNode()) for tree in model.trees], words)


def fit(documents: DataFrame, settings: Settings = Settings()) -> Forest:
    """A forest from the seed findings and the labelled findings of the corpus."""
    findings = seed_findings(documents.sparkSession).unionByName(corpus_findings(documents, settings))
    return train(findings, dictionary(documents, settings), settings)


def scan(documents: DataFrame, forest: Forest, settings: Settings = Settings()) -> DataFrame:
    """``documents`` with ``findings`` (value, before, after, score, start, end) and ``redacted`` text.

    Findings are all candidates whose score reaches the threshold, with code-point offsets (end exclusive);
    ``redacted`` has each of them replaced, and ``n_candidates`` counts what was judged. A null text has no
    findings and stays null; an empty one stays empty. Columns of these names are replaced; repeated rows
    stay repeated.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [c for c in documents.columns if c not in ("findings", "redacted", "n_candidates")]
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in documents.columns else F.lit("")
    found = documents.select(*own, F.split(text, CANDIDATE).alias("_pieces"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_values"), path.alias("_path"))

    def before(k: Column) -> Column:
        return F.right(F.get("_pieces", k), F.lit(CONTEXT))

    def after(k: Column) -> Column:
        return F.left(F.get("_pieces", k + 1), F.lit(CONTEXT))

    described = F.transform(
        "_values", lambda v, k: F.struct(*[c.alias(n) for n, c in features(v, before(k), after(k), F.col("_path"), forest.words).items()])
    )
    found = found.withColumn("_scores", F.transform(described, lambda named: forest.score(named)))
    step = F.aggregate(
        F.sequence(F.lit(0), F.size("_values") - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda state, k: F.struct(
            (state["at"] + F.length(F.get("_pieces", k)) + F.length(F.get("_values", k))).alias("at"),
            F.concat(state["starts"], F.array(state["at"] + F.length(F.get("_pieces", k)))).alias("starts"),
        ),
    )
    found = found.withColumn("_starts", F.when(F.size("_values") > 0, step["starts"]).otherwise(F.array().cast("array<int>")))
    judged = F.transform(
        "_values",
        lambda v, k: F.struct(
            v.alias("value"), before(k).alias("before"), after(k).alias("after"), F.get("_scores", k).alias("score"),
            F.get("_starts", k).alias("start"), (F.get("_starts", k) + F.length(v)).alias("end"),
        ),
    )
    kept = F.get("_scores", F.lit(0)).isNotNull() & (F.array_max("_scores") >= settings.threshold)
    rebuilt = F.array_join(
        F.transform(
            "_pieces",
            lambda piece, k: F.concat(piece, F.when(F.get("_scores", k) >= settings.threshold, REPLACEMENT).otherwise(F.coalesce(F.get("_values", k), F.lit("")))),
        ),
        "",
    )
    return found.select(
        *own,
        F.size("_values").alias("n_candidates"),
        F.filter(judged, lambda x: x["score"] >= settings.threshold).alias("findings"),
        F.when(kept, rebuilt).otherwise(F.col("text")).alias("redacted"),
    )


def secrets(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans ("start:end", comma-joined) and redacted_sha256 of every document."""
    documents = documents.select("doc_id", "text", "source")
    found = scan(documents, fit(documents, settings), settings)
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id", "n_candidates", F.size("findings").alias("n_secrets"), spans.alias("spans"),
        F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"),
    )
