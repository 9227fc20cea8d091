"""What a retrieval pipeline is made of: interfaces for splitters, embedders, rerankers, stores and generators, and simple ones for tests.

Models behind them are services that this library does not call; whoever has one implements the interface.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirelake.operators import state, vectors


@dataclass(frozen=True)
class Document:
    id: str
    text: str
    metadata: dict[str, Any] = field(default_factory=dict)


class Splitter(Protocol):
    def split(self, text: str) -> list[tuple[str, str]]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    """Gives each of the rows (id, text) a score for the query."""

    def rerank(self, query: str, rows: DataFrame) -> DataFrame: ...


class VectorStore(Protocol):
    """Keeps rows of id, document_id, text and embedding."""

    def read(self) -> DataFrame: ...
    def write(self, rows: DataFrame) -> None: ...


class Generator(Protocol):
    def generate(self, query: str, texts: list[str], history: list[dict[str, str]]) -> dict[str, Any]: ...


class MemoryProvider(Protocol):
    def recall(self, conversation_id: str) -> list[str]: ...


class Labeller(Protocol):
    """Labels a paper, or judges whether it belongs to a topic; a service that is not called here."""

    def label(self, title: str, abstract: str) -> dict[str, str]: ...


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    parameters: dict[str, Any]
    run: Callable[..., Any]


@dataclass(frozen=True)
class MarkdownSplitter:
    max_chars: int = 2000

    def split(self, text: str) -> list[tuple[str, str]]:
        return vectors.split_markdown(text, self.max_chars)


@dataclass(frozen=True)
class HashEmbedder:
    """Unit vectors of hashed words: texts with common words are near. It needs no model."""

    size: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


@dataclass(frozen=True)
class Pipeline:
    splitter: Splitter
    embedder: Embedder
    reranker: Reranker | None = None

    def fingerprint(self) -> str:
        """Changes when a part of the pipeline does, so that what it indexed is known to be stale."""
        return hashlib.sha256(json.dumps([repr(self.splitter), repr(self.embedder)]).encode()).hexdigest()

    def ingest(self, documents: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """Rows (id, document_id, section, text, embedding) of the documents (document_id, text); with rows, those of the same documents are replaced."""
        splitter, embedder = self.splitter, self.embedder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(d, i, s, t) for d, text in zip(b.column("document_id").to_pylist(), b.column("text").to_pylist(), strict=True) for i, (s, t) in enumerate(splitter.split(text or ""))]
                vs = embedder.embed([g[3] for g in got])
                yield pa.RecordBatch.from_arrays([pa.array([f"{g[0]}:{g[1]}" for g in got], pa.string()), pa.array([g[0] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string()), pa.array([g[3] for g in got], pa.string()), pa.array(vs, pa.list_(pa.float64()))], names=["id", "document_id", "section", "text", "embedding"])

        new = documents.select("document_id", "text").mapInArrow(run, "id string, document_id string, section string, text string, embedding array<double>")
        return new if rows is None else state.without(rows, documents.select("document_id")).unionByName(new)

    def retrieve(self, rows: DataFrame, query: str, k: int, filters: dict[str, object] | None = None) -> DataFrame:
        """The k rows nearest to the query, with score, after the reranker if there is one."""
        some = rows.where(vectors.matches(filters)) if filters else rows
        rerank = None if self.reranker is None else lambda near: self.reranker.rerank(query, near)
        best = vectors.reranked(some, self.embedder.embed([query])[0], k, rerank)
        return best.join(some.select("id", "document_id", "section", "text"), "id").orderBy(F.desc("score"), "id")
