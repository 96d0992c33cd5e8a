"""The eight extension points, as the shapes that the engine's functions take and give.

:class:`memlayer.sources.store.Table` is a storage provider; :func:`memlayer.plans.context.compile_context` takes a retriever, a
scorer and a classifier, :func:`memlayer.plans.harness.run_all` a compressor, :func:`memlayer.operators.detect.cascade_lazily` event
detectors, :func:`memlayer.operators.condense.summarize` summarisers, :func:`memlayer.operators.detect.classify_texts` an
embedding provider.
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class StorageProvider(Protocol):
    """A table of one entity: :class:`memlayer.sources.store.Table`."""

    def read(self) -> DataFrame: ...
    def save(self, rows: DataFrame, order: str | None = None) -> None: ...
    def load(self, id_: str) -> dict: ...
    def delete(self, id_: str) -> None: ...
    def list(self) -> DataFrame: ...


class EmbeddingProvider(Protocol):
    """``(df, id, text) -> (id, embedding)``."""

    def __call__(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame: ...


class Retriever(Protocol):
    """``(query, k) -> (id, score)``, best first."""

    def __call__(self, query: str, k: int) -> DataFrame: ...


class RelevanceScorer(Protocol):
    """A score expression over a chunk's columns and its hit's score."""

    def __call__(self, score: Column) -> Column: ...


class QueryClassifier(Protocol):
    """Text to query class."""

    def __call__(self, text: Column) -> Column: ...


class PromptCompressor(Protocol):
    """Text to shorter text."""

    def __call__(self, text: Column) -> Column: ...


class EventDetector(Protocol):
    """``df -> (id, label, matched)``."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


class Summarizer(Protocol):
    """``(df, id, text) -> (id, summary)``."""

    def __call__(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame: ...
