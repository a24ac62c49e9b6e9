"""One object with the verbs of a search engine; every result is a DataFrame."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions.analysis import AnalyzerConfig
from textloom.operators import index as tables, variants
from textloom.plans import search as plans
from textloom.plans.session import cut
from textloom.sources import files, storage
from textloom.streaming import log


#: Batches that are kept as segments of their own before they are written as one.
MOST_SEGMENTS = 8


class SearchEngine:
    """Documents, their index, and where both are kept.

    Batches of documents are pending until the index is next needed; then they alone are analysed
    and become a segment beside what is indexed. Replaced and deleted documents are passed by.
    ``commit`` writes everything as one index and empties the log. Adding is atomic: a batch with
    an id that is taken, or comes twice, is refused as a whole.
    """

    def __init__(
        self, spark: SparkSession, path: str | None = None, log_folder: str | None = None, *, k1: float = 1.2, b: float = 0.75,
        store_fields: bool = True, **analyzer,
    ) -> None:
        self.spark, self.path, self.log_folder = spark, path, log_folder
        self.config, self.k1, self.b, self.store_fields = AnalyzerConfig.of(**analyzer), k1, b, store_fields
        self._pending: DataFrame | None = None
        self._index: tables.Index | None = None
        self._segments = 0
        self._cleared: tuple | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, log_folder: str | None = None) -> SearchEngine:
        found = storage.load(spark, path)
        engine = cls(spark, path, log_folder, k1=found.k1, b=found.b)
        engine.config, engine._index, engine._segments = found.config, found, 1
        return engine

    @property
    def _docs(self) -> DataFrame | None:
        """All documents, pending ones included."""
        indexed = self._index.docs.drop("length") if self._index is not None else None
        if indexed is None or self._pending is None:
            return self._pending if indexed is None else indexed
        return indexed.unionByName(self._pending, allowMissingColumns=True)

    def add_documents(self, docs: DataFrame) -> SearchEngine:
        if "doc_id" not in docs.columns:
            docs = docs.withColumnRenamed("id", "doc_id")
        if self.log_folder:
            log.append(docs, self.log_folder)  # a refused batch stays in the log, as it was received
        tables.check_ids(docs, self._docs)
        return self._extend(docs)

    def _extend(self, docs: DataFrame) -> SearchEngine:
        self._pending = docs if self._pending is None else self._pending.unionByName(docs, allowMissingColumns=True)
        return self

    def add_document(self, doc_id: int, **fields: str) -> SearchEngine:
        row = {k: v for k, v in fields.items() if v is not None}
        kinds = ", ".join(["doc_id long", *(f"`{k}` string" for k in row)])
        return self.add_documents(self.spark.createDataFrame([(doc_id, *row.values())], kinds))

    def upload(self, uploads: DataFrame) -> SearchEngine:
        top = self._docs.agg(F.max("doc_id")).first()[0] if self._docs is not None else None
        return self.add_documents(files.uploaded(uploads, (top or 0) + 1).drop("item", "extra"))

    def index_folder(self, folder: str) -> SearchEngine:
        return self.add_documents(files.with_ids(files.read_folder(self.spark, folder)).drop("item", "extra"))

    @property
    def index(self) -> tables.Index:
        if self._pending is None and self._index is None:
            self._pending = self.spark.createDataFrame([], "doc_id long, text string")
        if self._pending is not None:
            built = tables.build_index(
                self._pending, self.config, check=False, store_fields=self.store_fields, k1=self.k1, b=self.b
            ).checkpointed()
            self._index = built if self._index is None else tables.merged(self._index, built)
            self._pending = None
            self._segments += 1
            if self._segments > MOST_SEGMENTS:
                self._index, self._segments = self._index.checkpointed(), 1
        return self._index

    def search(self, query: str, **options) -> DataFrame:
        return plans.search(self.index, query, **options)

    def suggest(self, prefix: str, limit: int = 5) -> DataFrame:
        return plans.suggest(self.index, prefix, limit)

    def stats(self) -> DataFrame:
        return self.index.stats()

    def documents(self) -> DataFrame:
        return self.index.docs

    def upsert(self, docs: DataFrame) -> SearchEngine:
        return self.delete(docs)._extend(docs)

    def delete(self, ids: DataFrame) -> SearchEngine:
        if self._pending is not None:
            self._pending = tables.delete(self._pending, ids)
        if self._index is not None:
            self._index = tables.without(self._index, ids)
            self._segments += 1  # one more pass over the postings
        return self

    def clear(self) -> SearchEngine:
        """Forget all documents; what was committed stays until the next commit, and ``undo`` brings
        them back."""
        self._cleared = (self._pending, self._index, self._segments)
        self._pending, self._index, self._segments = None, None, 0
        return self

    def undo(self) -> SearchEngine:
        """Bring back what the last ``clear`` forgot; documents added since then are kept too."""
        if self._cleared is not None:
            added, index = self._pending, self._index
            (self._pending, self._index, self._segments), self._cleared = self._cleared, None
            if index is not None:
                self._extend(index.docs.drop("length"))
            if added is not None:
                self._extend(added)
        return self

    def search_json(self, query: str, **options) -> str:
        """The rows of a search in an envelope with their number and the time taken."""
        began = time.perf_counter()
        rows = self.search(query, **options).collect()  # at most ``limit`` rows
        return variants.envelope(query, rows, (time.perf_counter() - began) * 1000)

    def restore(self, docs: DataFrame, paths: frozenset[str] = frozenset()) -> SearchEngine:
        """Add stored documents, samples left out."""
        return self.add_documents(variants.without_samples(docs, paths))

    def commit(self) -> str:
        if not self.path:
            raise ValueError("no path to write the index to")
        storage.save(self.index, self.path)
        if self.log_folder:
            log.checkpoint(self.spark, self.log_folder)
        return self.path

    def recover(self) -> int:
        """Add what the log holds and the index lacks; returns how many documents."""
        if not self.log_folder:
            return 0
        fresh = log.replay(log.read(self.spark, self.log_folder), self._docs)
        fresh = cut(fresh)
        if count := fresh.count():
            self._extend(fresh)
        return count
