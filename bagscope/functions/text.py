"""Names, identifiers and fixed layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal what existing files and callers use.
CLONE_COLUMNS = ["junction_aa", "v_call", "j_call"]
RESULT_COLUMNS = ["ID", "dataset", "label_positive_probability", "junction_aa", "v_call", "j_call"]
SENTINEL = -999.0
DEFAULT_MODEL_ID = "t6_8M"
MODEL_ID_PATTERN = "esm2_([^_/]+_[^_/]+)"
MAX_TOKENS = 40
SPECIAL_TOKENS = 2
# Text read as null by the usual dataframe CSV readers.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# End of fixed values.


def null_tokens_to_null(col: Column) -> Column:
    return F.when(~col.isin(NULL_TOKENS), col)


def repertoire_id_from_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.tsv$", "")


def feature_name(k: Column, kmer: Column) -> Column:
    """``k3__CAS``: the display name of a k-mer feature."""
    return F.concat(F.lit("k"), k.cast("string"), F.lit("__"), kmer)


def feature_k(name: Column) -> Column:
    """The ``k`` of a display name, null when the name has another form."""
    return F.nullif(F.regexp_extract(name, r"^k(\d+)__", 1), F.lit("")).cast("int")


def feature_kmer(name: Column) -> Column:
    return F.regexp_replace(name, r"^k\d+__", "")


def model_id(model_name: Column) -> Column:
    """Short id inside an encoder's name, with a default when there is none."""
    found = F.regexp_extract(model_name, MODEL_ID_PATTERN, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(DEFAULT_MODEL_ID))


def truncate_for_encoder(sequence: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The residues an encoder sees once its special tokens have taken their places."""
    return F.substring(sequence, 1, max_tokens - SPECIAL_TOKENS)


def dataset_number(name: Column) -> Column:
    """``7_1`` from ``test_dataset_7_1`` or ``train_dataset_7_1``."""
    return F.regexp_replace(name, r"^(train|test)_dataset_", "")


def base_dataset(name: Column) -> Column:
    """The train dataset a test dataset belongs to: ``7`` from ``test_dataset_7_1``."""
    return F.substring_index(dataset_number(name), "_", 1)
