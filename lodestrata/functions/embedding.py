"""Embedding functions: text to dense or sparse vectors, by name, as batched Arrow functions."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import text as T
from .metadata import SPARSE_TAG, TAG, SparseVector

_DENSE: dict[str, Callable[..., DenseFunction]] = {}


class DenseFunction:
    """Turns a list of texts into a matrix; subclasses give ``encode`` and ``config``."""

    name = ""

    def encode(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def config(self) -> dict[str, Any]:
        return {}

    def column(self, text: Column) -> Column:
        """Vectors of a text column; null for null."""
        encode = self.encode

        @F.pandas_udf(ArrayType(FloatType()))
        def run(s: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            known = s[s.notna()]
            if len(known):
                out[known.index] = list(encode(known.tolist()).astype(np.float32))
            return out

        return run(text)


def register(name: str) -> Callable[[type], type]:
    """Make an embedding function known under a name."""

    def add(cls: type) -> type:
        cls.name = name
        _DENSE[name] = cls
        return cls

    return add


def build(name: str, config: dict[str, Any] | None = None) -> DenseFunction:
    """The embedding function of that name."""
    if name not in _DENSE:
        raise KeyError(f"no embedding function {name!r}; known: {', '.join(sorted(_DENSE))}")
    return _DENSE[name](**(config or {}))


@register("hashing")
class Hashing(DenseFunction):
    """Deterministic unit vectors from hashed words: needs no model, equal texts get equal vectors."""

    def __init__(self, dim: int = 64, seed: int = 0) -> None:
        self.dim, self.seed = dim, seed

    def config(self) -> dict[str, Any]:
        return {"dim": self.dim, "seed": self.seed}

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for n, t in enumerate(texts):
            for w in t.lower().split():
                h = T.murmur3(w, self.seed)
                out[n, h % self.dim] += 1.0 if (h >> 20) & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Bm25:
    """Sparse vectors of single texts, as ``operators.sparse.bm25_weights`` gives them for a table."""

    def __init__(self, k: float = 1.2, b: float = 0.75, mean_length: float = 256.0) -> None:
        self.k, self.b, self.mean_length = k, b, mean_length

    def __call__(self, text: str) -> SparseVector:
        raw = T.re.sub(r"[^\w\s]+", " ", text).lower().split()
        tokens = [T.stem(w) for w in raw if w not in T.STOP_WORDS and len(w) <= T.MOST_CHARS]
        counts: dict[int, int] = {}
        for t in tokens:
            h = T.murmur3(t)
            counts[h] = counts.get(h, 0) + 1
        scale = self.k * (1 - self.b + self.b * len(tokens) / self.mean_length)
        dims = sorted(counts)
        return SparseVector(tuple(dims), tuple(counts[d] * (self.k + 1) / (counts[d] + scale) for d in dims))


def embed_missing(records: DataFrame, function: DenseFunction, document: str = "document", embedding: str = "embedding") -> DataFrame:
    """``records`` with the vectors of their documents where they bring none; other documents do not reach the function."""
    given = F.col(embedding).cast("array<float>")
    return records.withColumn(embedding, F.coalesce(given, function.column(F.when(given.isNull(), F.col(document)))))


def with_sparse(records: DataFrame, key: str, document: str = "document", metadata: str = "metadata") -> DataFrame:
    """``records`` with the BM25 vector of each document under ``key`` of its metadata (JSON text)."""
    encode = Bm25()

    @F.pandas_udf("string")
    def added(documents: pd.Series, metas: pd.Series) -> pd.Series:
        out = []
        for d, m in zip(documents, metas, strict=True):
            if d is not None:
                v = encode(d)
                m = json.dumps({**(json.loads(m) if m else {}), key: {TAG: SPARSE_TAG, "indices": v.indices, "values": v.values}})
            out.append(m)
        return pd.Series(out, dtype=object)

    return records.withColumn(metadata, added(F.col(document), F.col(metadata)))
