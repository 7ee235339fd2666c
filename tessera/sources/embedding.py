"""Embedding texts: a pluggable embedder, called once per Arrow batch. Vectors travel with their rows; positions are never matched."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text

DIMENSIONS = 768
#: Types of entities that are embedded.
EMBEDDED = ("function", "class", "script", "api_endpoint")


def embeddable(kind: Column, content: Column) -> Column:
    """Whether an entity is embedded: one of the types, with content that isn't blank."""
    return kind.isin(list(EMBEDDED)) & content.rlike(r"\S")


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float] | None]: ...


class HashEmbedder:
    """Deterministic unit vectors from a text's words, for use without a model: texts that share words are near each other."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def _word(self, w: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")
        return np.random.default_rng(seed).standard_normal(self.dimensions)

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            words = t.split()[1:]  # the first is the task's prefix
            v = sum((self._word(w.lower()) for w in words), np.zeros(self.dimensions))
            n = np.linalg.norm(v)
            out.append((v / n).astype("f4").tolist() if n else None)
        return out


class HttpEmbedder:
    """A server that takes ``{"model", "input": [texts]}`` and answers ``{"embeddings": [vectors]}``; if a batch fails, its texts are sent one by one, and those that fail have no vector."""

    def __init__(self, url: str, model: str, single_timeout: float = 30, batch_timeout: float = 120):
        self.url, self.model, self.single_timeout, self.batch_timeout = url, model, single_timeout, batch_timeout

    def _ask(self, texts: Sequence[str], timeout: float) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": list(texts)}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            return json.load(answer)["embeddings"]

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        try:
            return list(self._ask(texts, self.batch_timeout))
        except (OSError, ValueError, KeyError):
            out: list[list[float] | None] = []
            for t in texts:
                try:
                    out.append(self._ask([t], self.single_timeout)[0])
                except (OSError, ValueError, KeyError, IndexError):
                    out.append(None)
            return out


def embed(rows: DataFrame, embedder: Embedder, column: str, into: str = "embedding", query: bool = False) -> DataFrame:
    """``rows`` with the vector of each prepared text; null for null and blank texts."""
    kept = [f for f in rows.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ready = b.pop("_prepared")
            at = [i for i, x in enumerate(ready) if isinstance(x, str) and x]
            vectors: list = [None] * len(b)
            for i, v in zip(at, embedder.embed([ready.iloc[i] for i in at]) if at else [], strict=True):
                vectors[i] = v
            yield b.assign(**{into: vectors})

    prepared = F.when(F.col(column).rlike(r"\S"), text.prepared(F.col(column), query))
    return rows.select(*[f.name for f in kept], prepared.alias("_prepared")).mapInPandas(run, schema)


def embed_one(question: str, embedder: Embedder, query: bool = True) -> list[float] | None:
    """A question's vector, with the query's prefix; None for a blank one."""
    words = " ".join(question.split())
    prefix = "search_query: " if query else "search_document: "
    return embedder.embed([(prefix + words)[: text.EMBED_LIMIT]])[0] if words else None
