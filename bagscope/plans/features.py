"""Feature tables of many datasets, each built once: one job covers all datasets that are missing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagscope.models.encoder import Encoder, embed_sequences, hashed_residue_encoder
from bagscope.operators.clones import clone_presence
from bagscope.operators.kmers import kmer_counts
from bagscope.operators.pooling import POOLINGS, pool_bags
from bagscope.sources.repertoires import read_sequences
from bagscope.sources.store import FeatureStore

KEYS = ("dataset", "repertoire_id")


class DatasetFeatures:
    """Sequences, k-mers, clones, embeddings and pooled vectors of dataset folders, kept in a store."""

    def __init__(self, store: FeatureStore, folders: dict[str, str], headers: DataFrame | None = None):
        """``folders`` maps each dataset's name (its folder's name) to its path; ``headers`` is their stored
        header table, if there is one already."""
        self.store = store
        self.folders = dict(folders)
        self.headers = headers

    def _names(self, datasets: Sequence[str] | None) -> list[str]:
        return sorted(self.folders) if datasets is None else sorted(datasets)

    def sequences(self, datasets: Sequence[str] | None = None) -> DataFrame:
        def build(missing: list[str]) -> DataFrame:
            headers = None if self.headers is None else self.headers.where(F.col("dataset").isin(missing))
            return read_sequences(self.store.spark, [self.folders[name] for name in missing], headers=headers)

        return self.store.ensure("sequences", self._names(datasets), build)

    def kmers(self, k_list: Sequence[int], datasets: Sequence[str] | None = None) -> DataFrame:
        name = "kmers_" + "_".join(str(k) for k in sorted(k_list))

        def build(missing: list[str]) -> DataFrame:
            return kmer_counts(self.sequences(missing), k_list, by=KEYS)

        return self.store.ensure(name, self._names(datasets), build)

    def clones(self, datasets: Sequence[str] | None = None) -> DataFrame:
        def build(missing: list[str]) -> DataFrame:
            return clone_presence(self.sequences(missing), by=KEYS)

        return self.store.ensure("clones", self._names(datasets), build)

    def embeddings(
        self,
        datasets: Sequence[str] | None = None,
        make_encoder: Callable[[], Encoder] = hashed_residue_encoder,
        name: str = "embeddings",
    ) -> DataFrame:
        """Vectors and copies of every distinct sequence of a repertoire; give each encoder its own ``name``."""

        def build(missing: list[str]) -> DataFrame:
            return embed_sequences(self.sequences(missing), make_encoder, by=KEYS)

        return self.store.ensure(name, self._names(datasets), build)

    def pooled(
        self,
        token_pool: str,
        datasets: Sequence[str] | None = None,
        make_encoder: Callable[[], Encoder] = hashed_residue_encoder,
        name: str = "embeddings",
    ) -> DataFrame:
        """All bag poolings of one token pooling, one row per repertoire."""

        def build(missing: list[str]) -> DataFrame:
            vectors = self.embeddings(missing, make_encoder, name)
            return pool_bags(vectors, POOLINGS, by=KEYS, vector_col=token_pool, copies="copies")

        return self.store.ensure(f"{name}_pooled_{token_pool}", self._names(datasets), build)

    def build_each(self, step: Callable[[list[str]], DataFrame], datasets: Sequence[str] | None = None, parallelism: int = 4) -> DataFrame:
        """(dataset, built, n_rows, error): ``step`` for each dataset by itself, so that a damaged one is reported and the rest is built.

        ``step`` is a method of this object or a function of a list of one dataset. Its errors are kept as text; a job that
        fails leaves nothing in the store's manifest, and a later call tries it again.
        """

        def guarded(name: str) -> tuple:
            try:
                return name, True, step([name]).count(), None
            except Exception as error:  # whatever a dataset's files do to the job is that dataset's outcome
                return name, False, None, f"{type(error).__name__}: {str(error).strip().splitlines()[0][:500] if str(error).strip() else ''}"

        spark = self.store.spark
        with ThreadPool(parallelism) as pool:
            found = pool.map(inheritable_thread_target(spark)(guarded), self._names(datasets))
        return spark.createDataFrame(found, "dataset string, built boolean, n_rows bigint, error string")
