"""Text → vector as an Arrow-batched pandas UDF, pluggable embedder.

The default embedder is feature hashing (no model is available offline):
lower-case, split on white space, bucket = first 8 hex digits of the word's
MD5 modulo ``dim``, counts, L2-normalised.  A real model plugs in as any
object with ``name``, ``dim`` and ``encode(list[str]) -> np.ndarray``; it is
built once per Python worker and fed whole Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)


#: Words whose bucket a worker remembers (some 200 bytes each); others are hashed each time.
CACHED_WORDS = 1 << 17


class HashEmbedder:
    name = "hash-md5"

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._cache: dict[str, int] = {}

    def bucket(self, w: str) -> int:
        b = self._cache.get(w)
        if b is None:
            b = int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16) % self.dim
            if len(self._cache) < CACHED_WORDS:
                self._cache[w] = b
        return b

    def encode(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for i, t in enumerate(texts):
            if not t:
                continue
            words = t.replace("\n", " ").lower().split()
            if not words:
                continue
            row = np.bincount([self.bucket(w) for w in words], minlength=self.dim).astype(np.float64)
            out[i] = row / np.sqrt(row @ row)
        return out


EMBEDDERS = {"hash": HashEmbedder}


def get_embedder(spec) -> object:
    """An embedder instance from a name, a class, a zero-arg factory or an instance."""
    if isinstance(spec, str):
        if spec not in EMBEDDERS:
            raise ValueError(f"unknown embedder {spec!r}; known: {sorted(EMBEDDERS)}")
        return EMBEDDERS[spec]()
    if isinstance(spec, type) or (callable(spec) and not hasattr(spec, "encode")):
        return spec()
    return spec


_MODELS: dict = {}


def worker_model(spec):
    """The model of a name, class or factory, built once in each Python worker process; instances are used as they are."""
    if not isinstance(spec, (str, type)) and hasattr(spec, "encode"):
        return spec
    key = spec if isinstance(spec, str) else (getattr(spec, "__module__", ""), getattr(spec, "__qualname__", repr(spec)))
    if key not in _MODELS:
        _MODELS[key] = get_embedder(spec)
    return _MODELS[key]


def embed_column(text: Column, embedder="hash") -> Column:
    """Vector column (``array<float>``) of a text column."""
    @F.pandas_udf(VECTOR)
    def vec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = worker_model(embedder)
        for texts in batches:
            m = model.encode(texts.tolist()).astype(np.float32)
            yield pd.Series(list(m))

    return vec(text)


def embed_documents(df: DataFrame, text: str = "text", embedder="hash", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, embed_column(F.col(text), embedder))


def embed_queries(questions: DataFrame, text: str = "query", embedder="hash", out: str = "qvec") -> DataFrame:
    return questions.withColumn(out, embed_column(F.col(text), embedder))


def embedder_info(embedder="hash") -> tuple[str, int]:
    if isinstance(embedder, type) and isinstance(getattr(embedder, "name", None), str) and isinstance(getattr(embedder, "dim", None), int):
        return embedder.name, embedder.dim  # class attributes: the driver never builds the model
    e = get_embedder(embedder)
    return e.name, int(e.dim)
