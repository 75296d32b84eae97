"""Embeddings by a model that can be plugged in; by default deterministic hashed ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 64


class Embedder(Protocol):
    """What makes vectors of texts. It travels to the tasks, so the model itself is loaded by ``load``, there."""

    name: str
    dims: int

    def load(self) -> Callable[[list[str]], np.ndarray]:
        """A function from texts to an array of a row of ``dims`` numbers each."""
        ...


@dataclass(frozen=True)
class HashedEmbedder:
    """Feature hashing of words and word pairs, in the place of a model; all zero for a text without words."""

    name: str = "hashed-2"
    dims: int = DIMS

    def load(self) -> Callable[[list[str]], np.ndarray]:
        return self.vectors

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Each different word of the batch is hashed once; words and pairs are then added up by text."""
        words = [t.lower().split() for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        codes, known = pd.factorize(np.array([x for w in words for x in w], object))
        h = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
        together = owner[1:] == owner[:-1]
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[together]
        pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        features, whose = np.concatenate([h, pair ^ (pair >> np.uint64(32))]), np.concatenate([owner, owner[1:][together]])
        out = np.zeros((len(texts), self.dims))
        np.add.at(out, (whose, (features % np.uint64(self.dims)).astype(int)), np.where(features >> np.uint64(63), 1.0, -1.0))
        return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Each row scaled to length one; a zero row stays zero."""
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)


def embed(text: Column, model: Embedder = HashedEmbedder()) -> Column:
    """The unit vector of each text, an Arrow batch at a time; a null text has that of an empty one.

    The model is loaded once for each task. An array of another shape than it declares is an error.
    """

    @F.pandas_udf("array<float>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors_of = model.load()
        for s in batches:
            made = np.asarray(vectors_of(s.fillna("").tolist()), float).reshape(len(s), -1)
            if len(s) and made.shape[1] != model.dims:
                raise ValueError(f"{model.name} gave vectors of {made.shape[1]} numbers, not {model.dims}")
            flat = pa.array(unit_rows(made).astype(np.float32).reshape(-1))
            yield pd.Series(list(flat.to_numpy().reshape(len(s), model.dims)))

    return of(text)


def embed_query(text: str, model: Embedder = HashedEmbedder()) -> list[float]:
    """The unit vector of one query, on the driver."""
    return unit_rows(np.asarray(model.load()([text]), float)).astype(np.float32)[0].tolist()


def unit(embedding: Column) -> Column:
    """Scaled to length one in double precision; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(embedding, lambda x: x / F.greatest(norm, F.lit(1e-8)))
