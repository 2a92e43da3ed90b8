"""A compressed static corpus: two bits and a sign per dimension, and a residual norm.

A coordinate is coded by the nearest of its dimension's four centroids (the
first of equals), the residual by the signs of its projection and its norm. A
record scores sum q*c[idx] + qjl_scale * gamma * sum (P q)*sign; a scale of 1 is
the defined score, others are a labelled extension.

Queries and projections are constants, so ``P q`` is computed once. Encoding and
scoring run on Arrow batches in numpy; with the identity as projection both have
forms in DataFrame functions as well.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.hashing import fnv1a
from quillspan.model import invalid
from quillspan.operators.vector import check_query, nearest_of_blocks

CENTROIDS = 4
# Seeds of generated assets.
CENTROIDS_SEED, PROJECTION_SEED = 7, 11


@dataclass(frozen=True)
class Codec:
    """centroids: dim x 4; projection: dim x dim, or None for the identity."""

    centroids: np.ndarray
    projection: np.ndarray | None = None
    qjl_scale: float = 1.0

    def __post_init__(self):
        if self.centroids.ndim != 2 or self.centroids.shape[1] != CENTROIDS or not len(self.centroids):
            raise invalid("centroids")
        if self.projection is not None and self.projection.shape != (self.dim, self.dim):
            raise invalid("projection")

    @property
    def dim(self) -> int:
        return len(self.centroids)

    @classmethod
    def generate(cls, dim: int, centroids_seed: int = CENTROIDS_SEED, projection_seed: int = PROJECTION_SEED) -> Codec:
        """Assets uniform in [-1, 1] from seeds, by numpy's generator."""
        return cls(
            np.random.default_rng(centroids_seed).uniform(-1, 1, (dim, CENTROIDS)).astype(np.float32),
            np.random.default_rng(projection_seed).uniform(-1, 1, (dim, dim)).astype(np.float32),
        )

    @classmethod
    def uniform(cls, dim: int, values: Sequence[float]) -> Codec:
        """The same centroids in every dimension, no projection."""
        return cls(np.tile(np.asarray(values, np.float32), (dim, 1)))

    def project(self, x: np.ndarray) -> np.ndarray:
        return x if self.projection is None else x @ self.projection.T

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed indexes, packed signs and residual norms of rows."""
        vectors = np.asarray(vectors, np.float32)
        if vectors.ndim != 2 or vectors.shape[1] != self.dim or not np.isfinite(vectors).all():
            raise invalid("embedding")
        index = np.abs(vectors[:, :, None] - self.centroids[None]).argmin(axis=2)
        residual = vectors - np.take_along_axis(self.centroids[None], index[:, :, None], axis=2)[:, :, 0]
        signs = self.project(residual) >= 0
        bits = np.stack([index & 1, index >> 1], axis=2).reshape(len(vectors), -1)
        return (
            np.packbits(bits.astype(np.uint8), axis=1, bitorder="little"),
            np.packbits(signs, axis=1, bitorder="little"),
            np.sqrt((residual.astype(np.float32) ** 2).sum(axis=1, dtype=np.float32)),
        )

    def unpack(self, idx: np.ndarray, qjl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(idx, axis=1, count=2 * self.dim, bitorder="little").reshape(len(idx), self.dim, 2)
        signs = np.unpackbits(qjl, axis=1, count=self.dim, bitorder="little")
        return bits[:, :, 0] + 2 * bits[:, :, 1], signs * 2.0 - 1.0

    def breakdown(self, query: Sequence[float], idx: np.ndarray, qjl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid and the sign term of packed rows."""
        q = np.asarray(query, np.float64)
        if q.shape != (self.dim,) or not np.isfinite(q).all():
            raise invalid("query_embedding")
        index, signs = self.unpack(idx, qjl)
        table = q[:, None] * self.centroids
        return table[np.arange(self.dim), index].sum(axis=1), signs @ self.project(q)

    def decode(self, idx: np.ndarray, qjl: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """The vectors whose dot product with a query is the packed rows' score."""
        index, signs = self.unpack(idx, qjl)
        signed = signs if self.projection is None else signs @ self.projection.astype(np.float64)
        return self.centroids.astype(np.float64)[np.arange(self.dim), index] + self.qjl_scale * gamma.astype(np.float64)[:, None] * signed

    def to_bytes(self) -> tuple[bytes, bytes]:
        """Centroids and projection as little-endian floats after two 32-bit sizes."""
        p = np.eye(self.dim, dtype="<f4") if self.projection is None else self.projection.astype("<f4")
        head = struct.pack("<II", self.dim, CENTROIDS)
        return head + self.centroids.astype("<f4").tobytes(), struct.pack("<II", self.dim, self.dim) + p.tobytes()

    @classmethod
    def from_bytes(cls, centroids: bytes, projection: bytes) -> Codec:
        def read(raw: bytes, name: str) -> np.ndarray:
            if len(raw) < 12:
                raise invalid(name)
            rows, cols = struct.unpack("<II", raw[:8])
            if not rows or not cols or len(raw) != 8 + 4 * rows * cols:
                raise invalid(name)
            return np.frombuffer(raw, "<f4", offset=8).reshape(rows, cols).astype(np.float32)

        return cls(read(centroids, "centroids"), read(projection, "projection"))


def encode_table(df: DataFrame, codec: Codec, vector: str = "embedding") -> DataFrame:
    """Adds idx, qjl (binary) and gamma to rows with a vector; others are left out. All other columns stay."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != vector)
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.drop(columns=[vector])
            if len(frame):
                idx, qjl, gamma = shared.value.encode(np.stack(frame[vector].to_numpy()))
                out = out.assign(idx=[r.tobytes() for r in idx], qjl=[r.tobytes() for r in qjl], gamma=gamma)
                yield out

    return df.where(F.col(vector).isNotNull()).mapInPandas(run, f"{fields}, idx binary, qjl binary, gamma float")


def score_encoded(df: DataFrame, codec: Codec, query: Sequence[float]) -> DataFrame:
    """Adds centroid_term, qjl_term and score to encoded rows."""
    shared = df.sparkSession.sparkContext.broadcast((codec, list(map(float, query))))
    codec.breakdown(query, np.zeros((1, -(-codec.dim // 4)), np.uint8), np.zeros((1, -(-codec.dim // 8)), np.uint8))  # refuses a bad query here

    @F.pandas_udf("centroid_term double, qjl_term double")
    def terms(idx: pd.Series, qjl: pd.Series) -> pd.DataFrame:
        own, q = shared.value
        if not len(idx):
            return pd.DataFrame({"centroid_term": [], "qjl_term": []}, dtype=float)
        a, b = own.breakdown(q, *[np.stack([np.frombuffer(x, np.uint8) for x in s]) for s in (idx, qjl)])
        return pd.DataFrame({"centroid_term": a, "qjl_term": b})

    scored = df.withColumn("__t", terms("idx", "qjl"))
    total = F.col("__t.centroid_term") + F.col("gamma").cast("double") * F.col("__t.qjl_term") * codec.qjl_scale
    return scored.select(*df.columns, "__t.centroid_term", "__t.qjl_term", total.alias("score"))


def search(encoded: DataFrame, codec: Codec, query: Sequence[float], k: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score) of the k best records; ties go to the lower unsigned FNV-1a hash of the id."""
    slim = encoded.select(F.col(id_col).cast("string").alias("doc_id"), "idx", "qjl", "gamma")
    scored = score_encoded(slim, codec, query).select("doc_id", "score", fnv1a(F.col("doc_id")).alias("h"))
    return scored.orderBy(F.desc("score"), F.asc("h")).limit(k).select("doc_id", "score")


def search_batch(encoded: DataFrame, codec: Codec, queries: dict[str, Sequence[float]], k: int, id_col: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, score) of the k best records a query, for any number of queries; ties as in ``search``."""
    for q in queries.values():
        check_query(q, codec.dim)
    doc_id = F.col(id_col).cast("string")
    tie = F.lpad(fnv1a(doc_id).cast("string"), 20, "0")
    rows = encoded.select(doc_id.alias("doc_id"), tie.alias("tie"), "idx", "qjl", "gamma")
    shared = encoded.sparkSession.sparkContext.broadcast(codec)

    def unpack(frame: pd.DataFrame) -> np.ndarray:
        idx, qjl = (np.stack([np.frombuffer(x, np.uint8) for x in frame[c]]) for c in ("idx", "qjl"))
        return shared.value.decode(idx, qjl, frame["gamma"].to_numpy())

    return nearest_of_blocks(rows, queries, k, unpack).withColumnRenamed("dot", "score")


def recall(near: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, recall, mean_recall, min_recall): of two lists of (query_id, doc_id), a row for each query of ``exact``."""
    pairs = near.select("query_id", "doc_id", F.lit(1).alias("hit"))
    hits = exact.select("query_id", "doc_id").join(pairs, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"))
    each = hits.withColumn("recall", F.col("hits") / float(k))
    return each.crossJoin(F.broadcast(each.agg(F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"))))


# --- DataFrame forms for codecs with the same centroids in all dimensions and no projection ---


def native_code(vector: Column, centroids: Sequence[float]) -> Column:
    """Per dimension a struct of idx, residual r and sign s (1 or -1)."""

    def one(x: Column) -> Column:
        x = x.cast("double")
        nearest, gap = F.lit(0), F.abs(x - float(centroids[0]))
        value = F.lit(float(centroids[0]))
        for i, c in enumerate(centroids[1:], 1):
            closer = F.abs(x - float(c)) < gap
            nearest, value = F.when(closer, i).otherwise(nearest), F.when(closer, float(c)).otherwise(value)
            gap = F.least(gap, F.abs(x - float(c)))
        return F.struct(nearest.alias("idx"), (x - value).alias("r"), value.alias("c"))

    return F.transform(vector, one)


def native_gamma(code: Column) -> Column:
    return F.sqrt(F.aggregate(code, F.lit(0.0), lambda s, e: s + e["r"] * e["r"]))


def native_terms(code: Column, query: Sequence[float]) -> tuple[Column, Column]:
    q = F.array(*[F.lit(float(x)) for x in query])
    weighed = F.zip_with(code, q, lambda e, x: e["c"] * x)
    signed = F.zip_with(code, q, lambda e, x: F.when(e["r"] >= 0, x).otherwise(-x))
    add = lambda s, x: s + x
    return F.aggregate(weighed, F.lit(0.0), add), F.aggregate(signed, F.lit(0.0), add)
