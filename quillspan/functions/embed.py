"""Embedders: column functions of a text for tables, plain calls for queries.

No model ships with the engine. ``FixedEmbedder`` returns one vector,
``HashingEmbedder`` signs and sums hashed terms and scales to length one, and any
pandas UDF from text to an array of floats can be passed instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tries to embed a query before keywords alone are searched.
ATTEMPTS = 2


class Embedder(Protocol):
    dim: int

    def query(self, text: str) -> list[float]: ...

    def column(self, text: Column) -> Column: ...


class FixedEmbedder:
    def __init__(self, values: Sequence[float]):
        self.values, self.dim = [float(v) for v in values], len(values)

    def query(self, text: str) -> list[float]:
        return self.values

    def column(self, text: Column) -> Column:
        return F.when(text.isNotNull(), F.array(*[F.lit(v).cast("float") for v in self.values]))


def hashed_vector(text: str, dim: int) -> np.ndarray:
    v = np.zeros(dim)
    for term in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    return v / max(np.linalg.norm(v), 1e-12)


class HashingEmbedder:
    def __init__(self, dim: int = 64):
        self.dim = dim

    def query(self, text: str) -> list[float]:
        return hashed_vector(text, self.dim).tolist()

    def column(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                yield s.map(lambda t: None if t is None else hashed_vector(t, dim).astype(np.float32))

        return embed(text)


def embed_query(embedder: Embedder, text: str, warn: Callable[[str], None] = lambda _: None) -> list[float] | None:
    """The query's vector, or None when it failed ATTEMPTS times; then all reasons are told at once."""
    reasons: list[str] = []
    while len(reasons) < ATTEMPTS:
        try:
            return embedder.query(text)
        except Exception as reason:  # an embedder may fail in any way
            reasons.append(f"{type(reason).__name__}: {reason}")
    warn(f"{text!r} is searched by keywords only; its embedding failed with " + ", then ".join(reasons))
    return None
