"""Reading directories of repertoire files and their metadata into long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagscope.functions.text import CLONE_COLUMNS, null_tokens_to_null, repertoire_id_from_name
from bagscope.operators.joins import lookup_join
from bagscope.session import materialize

ID = "repertoire_id"
#: Each layout is a read of the directories; more different header lines than this are taken for damaged files.
MAX_LAYOUTS = 64
_CSV = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


class InvalidInput(ValueError):
    """Input directories that cannot be used as they are."""


def _decoded(name: str) -> Column:
    """A path or name of ``_metadata`` as it is on disk: Spark encodes blanks and brackets, but not a plus sign."""
    return F.url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B")))


def _file_columns() -> list[Column]:
    """Dataset (the parent folder's name) and id (the file's name) of every row read from a file."""
    path = _decoded("_metadata.file_path")
    return [
        F.element_at(F.split(path, "/"), -2).alias("dataset"),
        repertoire_id_from_name(_decoded("_metadata.file_name")).alias(ID),
    ]


def file_headers(spark: SparkSession, paths: Sequence[str], pattern: str = "*.tsv") -> DataFrame:
    """(path, dataset, repertoire_id, header, usable) of every file that is not empty.

    ``header`` holds the tab-joined column names of the first line, quotes taken off; later lines are no
    headers, whatever they say. A file is ``usable`` if all clone columns are among them. Header-only files
    appear here, so an empty repertoire is not lost.
    """
    lines = spark.read.text(list(paths), pathGlobFilter=pattern).where(F.col("_metadata.file_block_start") == 0)
    lines = lines.select(
        F.col("_metadata.file_path").alias("path"), *_file_columns(), "value", F.monotonically_increasing_id().alias("__at")
    )
    first = lines.groupBy("path", "dataset", ID).agg(F.min_by("value", "__at").alias("line"))
    plain = F.regexp_replace("line", "^\ufeff|\r$", "")
    names = F.transform(
        F.split(plain, "\t"), lambda c: F.regexp_replace(F.regexp_replace(c, '^"(.*)"$', "$1"), '""', '"')
    )
    usable = F.lit(True)
    for column in CLONE_COLUMNS:
        usable = usable & F.array_contains(names, column)
    return first.select("path", "dataset", ID, F.array_join(names, "\t").alias("header"), usable.alias("usable"))


def _read_layout(spark: SparkSession, paths: list[str], header: str, pattern: str, enforce: bool = True) -> DataFrame:
    """All files read with a schema in this header's order; columns that are not asked for may repeat a name."""
    names = header.split("\t")
    unique = [c if c in CLONE_COLUMNS and names.index(c) == i else f"__{i}" for i, c in enumerate(names)] if enforce else names
    schema = T.StructType([T.StructField(c, T.StringType()) for c in unique])
    rows = spark.read.options(**_CSV, enforceSchema=str(enforce).lower()).schema(schema).csv(paths, pathGlobFilter=pattern)
    return rows.select(
        *_file_columns(), *[null_tokens_to_null(F.col(c)).alias(c) for c in CLONE_COLUMNS], F.col("_metadata.file_path").alias("__path")
    )


def read_sequences(
    spark: SparkSession, directories: str | Sequence[str], header: str | None = None, pattern: str = "*.tsv",
    headers: DataFrame | None = None,
) -> DataFrame:
    """(dataset, repertoire_id, junction_aa, v_call, j_call) of every usable file of the directories that matches ``pattern``.

    Files may order their columns differently and carry extra ones. A multi-file CSV read matches columns
    by position, so there is one read for each layout, of which only the files of that layout are kept;
    files without the clone columns are in none. When all files are known to share one ``header`` line,
    passing it saves the pass that looks at headers; Spark then fails on a file that differs instead of
    misreading it. ``headers`` is a stored :func:`file_headers` table of the directories, if there is one already.
    """
    dirs = [directories] if isinstance(directories, str) else list(directories)
    if header is not None:
        return _read_layout(spark, dirs, header, pattern, enforce=False).drop("__path")
    if headers is None:
        headers = materialize(file_headers(spark, dirs, pattern))
    counted = headers.where("usable").groupBy("header").agg(F.count(F.lit(1)).alias("n"))
    layouts = counted.orderBy("header").limit(MAX_LAYOUTS + 1).collect()
    if not layouts:
        raise InvalidInput(f"no .tsv file with the columns {', '.join(CLONE_COLUMNS)} in {dirs}")
    if len(layouts) > MAX_LAYOUTS:
        raise InvalidInput(f"more than {MAX_LAYOUTS} different header lines in {dirs}")
    alone = len(layouts) == 1 and headers.count() == layouts[0]["n"]
    out = None
    for layout in layouts:
        part = _read_layout(spark, dirs, layout["header"], pattern)
        if not alone:
            own = headers.where("usable").where(F.col("header") == layout["header"]).select(F.col("path").alias("__path"))
            part = lookup_join(part, own, ["__path"], "left_semi")
        out = part.drop("__path") if out is None else out.unionByName(part.drop("__path"))
    return out


def read_metadata(spark: SparkSession, path: str | Sequence[str], labelled: bool | None = None) -> DataFrame:
    """``metadata.csv`` with one normalised key and label.

    The key is ``repertoire_id``, else ``ID``, else ``filename`` without its extension. ``label_positive``
    may be absent in unlabelled data; other columns pass through. ``label`` is the label as 0 or 1.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.options(header="true", quote='"', escape='"').csv(paths)
    have = set(raw.columns)
    keys = [F.col(c) for c in (ID, "ID") if c in have]
    if "filename" in have:
        keys.append(repertoire_id_from_name(F.col("filename")))
    if not keys:
        raise InvalidInput("metadata needs repertoire_id, ID or filename")
    if labelled and "label_positive" not in have:
        raise InvalidInput("metadata has no label_positive column")
    dataset = F.element_at(F.split(_decoded("_metadata.file_path"), "/"), -2)
    columns = [dataset.alias("dataset"), F.coalesce(*keys).alias(ID)]
    if "filename" in have:
        columns.append(F.col("filename"))
    if "label_positive" in have:
        positive = F.lower("label_positive").isin("true", "1", "1.0")
        columns += [positive.alias("label_positive"), positive.cast("int").alias("label")]
    typed = {"age": "int"}
    for name in raw.columns:
        if name not in (ID, "ID", "filename", "label_positive"):
            columns.append(F.col(name).try_cast(typed[name]).alias(name) if name in typed else F.col(name))
    return raw.select(*columns)


def label_table(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("label").isNotNull()).select(ID, "label")


def repertoire_ids(spark: SparkSession, directory: str, metadata: DataFrame | None = None) -> DataFrame:
    """Ids of a directory: those of its metadata, or of its files when there is none."""
    if metadata is not None:
        return metadata.select(ID).distinct()
    return file_headers(spark, [directory]).where("usable").select(ID).distinct()


def full_dataset(sequences: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """All sequences with ``ID`` and, when labelled, ``label_positive``.

    With metadata only listed repertoires stay (listed ones without a file drop out); without it all do.
    """
    if metadata is None:
        return sequences.withColumn("ID", F.col(ID))
    columns = [ID, *[c for c in ("label_positive", "label") if c in metadata.columns]]
    return lookup_join(sequences, metadata.select(*columns), [ID]).withColumn("ID", F.col(ID))


def with_label(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of labelled repertoires; an error if none has a label."""
    joined = lookup_join(features, labels.select(ID, "label"), [ID])
    if joined.isEmpty():
        raise InvalidInput("no repertoire has both features and a label")
    return joined


def metadata_gaps(metadata: DataFrame, present: DataFrame) -> DataFrame:
    """Where metadata and files disagree: (repertoire_id, problem)."""
    listed, found = metadata.select(ID).distinct(), present.select(ID).distinct()
    missing = listed.join(found, ID, "left_anti").withColumn("problem", F.lit("missing_file"))
    extra = found.join(listed, ID, "left_anti").withColumn("problem", F.lit("not_in_metadata"))
    return missing.unionByName(extra)


def validate_inputs(
    spark: SparkSession, train_dir: str, test_dirs: Sequence[str], headers: DataFrame | None = None
) -> DataFrame:
    """Raise :class:`InvalidInput` when a directory has no usable file or the train set no metadata;
    otherwise return the gaps between train metadata and train files, and the files that can't be read
    (problem ``unusable_file``).

    ``headers`` is a stored :func:`file_headers` table of all the directories, if there is one already.
    """
    if headers is None:
        headers = read_headers(spark, [train_dir, *test_dirs])
    found = {row["dataset"] for row in headers.where("usable").select("dataset").distinct().toLocalIterator()}
    for directory in [train_dir, *test_dirs]:
        if folder_name(directory) not in found:
            raise InvalidInput(f"no usable .tsv file in {directory}")
    try:
        metadata = read_metadata(spark, f"{train_dir}/metadata.csv", labelled=True)
    except AnalysisException as error:
        raise InvalidInput(f"metadata.csv not found in {train_dir}") from error
    train = headers.where("usable").where(F.col("dataset") == folder_name(train_dir))
    unusable = headers.where("not usable").select(ID, F.lit("unusable_file").alias("problem"))
    return metadata_gaps(metadata, train).unionByName(unusable)


def read_headers(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """A stored :func:`file_headers` table; an error if a directory does not exist."""
    try:
        return materialize(file_headers(spark, directories))
    except AnalysisException as error:
        raise InvalidInput(f"cannot read {list(directories)}") from error


def folder_name(directory: str) -> str:
    """A dataset's name: the last part of its path."""
    return directory.rstrip("/").rsplit("/", 1)[-1]
