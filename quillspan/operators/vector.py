"""Exact vector search by dot product.

The top rows are chosen by the raw dot product, then scored by it clamped to
[0, 1], kept once per id and ordered by score and id. Ids are compared as text.
The query is a constant of the plan, so scoring compiles into the scan's stage
and ``orderBy.limit`` keeps a bounded heap per task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.functions.arrays import clamp01, dot, is_finite
from quillspan.model import ValidationError, invalid
from quillspan.operators.rank import best_per_id


def check_query(query: Sequence[float], dim: int | None = None) -> None:
    if not len(query) or not np.isfinite(np.asarray(query, float)).all() or (dim is not None and len(query) != dim):
        raise invalid("query_embedding")


def raw_scores(vectors: DataFrame, query: Sequence[float], id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(doc_id, dot); rows without a vector are left out, a dot product that is not finite raises."""
    scored = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), dot(F.col(vector), query).alias("dot"))
    return scored.withColumn("dot", F.when(is_finite(F.col("dot")), F.col("dot")).otherwise(F.raise_error(F.lit("distance has an invalid value"))))


def nearest(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("dot"), F.asc("doc_id")).limit(k)


def search(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(doc_id, score) of the k nearest rows, once per id."""
    check_query(query)
    found = nearest(raw_scores(vectors, query, id_col, vector), k)
    return best_per_id(found.select("doc_id", clamp01(F.col("dot")).alias("score")))


def search_shards(vectors: DataFrame, shard: Column, query: Sequence[float], k: int, id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of every shard, merged, once per id, then the k best; nothing is fetched to replace dropped repeats."""
    check_query(query)
    placed = vectors.where(F.col(vector).isNotNull()).select(shard.alias("shard"), F.col(id_col).cast("string").alias("doc_id"), dot(F.col(vector), query).alias("dot"))
    here = Window.partitionBy("shard").orderBy(F.desc("dot"), F.asc("doc_id"))
    kept = placed.withColumn("r", F.row_number().over(here)).where(F.col("r") <= k)
    merged = best_per_id(kept.select("doc_id", clamp01(F.col("dot")).alias("score")))
    return merged.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)


#: Queries of a block; a broadcast matrix has at most as many rows.
MAX_BATCH = 1024
#: Dot products that are equal to so many decimals tie: a matrix product's last bits depend on a row's place.
TIE_DECIMALS = 9


def nearest_of_block(rows: DataFrame, block: dict[str, Sequence[float]], k: int, unpack: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """(query_id, doc_id, dot) of the k best rows a query; ties go to the lesser ``tie``.

    ``rows`` have doc_id, tie and what ``unpack`` makes vectors of. Each Arrow
    batch is one matrix product; it passes on its k best rows a query, so what is
    shuffled is bounded by batches x queries x k, however many rows tie.
    """
    names = list(block)
    shared = rows.sparkSession.sparkContext.broadcast(np.array([block[q] for q in names], np.float64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            if not len(frame):
                continue
            frame = frame.sort_values("tie", kind="stable")
            dots = unpack(frame) @ m.T
            if not np.isfinite(dots).all():
                raise ValueError("distance has an invalid value")
            near = np.round(dots, TIE_DECIMALS)
            n = min(k, len(frame))
            floor = -np.partition(-near, n - 1, axis=0)[n - 1]
            above, level = near > floor, near == floor
            row, col = np.nonzero(above | (level & (level.cumsum(axis=0, dtype=np.int32) <= n - above.sum(axis=0))))
            found = {"query": col.astype(np.int32), "doc_id": frame["doc_id"].to_numpy()[row], "tie": frame["tie"].to_numpy()[row]}
            yield pd.DataFrame(found | {"dot": dots[row, col], "near": near[row, col]})

    partial = rows.mapInPandas(run, "query int, doc_id string, tie string, dot double, near double")
    here = Window.partitionBy("query").orderBy(F.desc("near"), F.asc("tie"))
    best = partial.withColumn("r", F.row_number().over(here)).where(F.col("r") <= k)
    return best.select(F.element_at(F.array(*map(F.lit, names)), F.col("query") + 1).alias("query_id"), "doc_id", "dot")


def nearest_of_blocks(rows: DataFrame, queries: dict[str, Sequence[float]], k: int, unpack: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """``nearest_of_block`` for any number of queries, in blocks of MAX_BATCH whose results are united."""
    if not queries:
        raise ValidationError("queries must not be empty")
    dim = len(next(iter(queries.values())))
    for q in queries.values():
        check_query(q, dim)
    items = list(queries.items())
    blocks = [dict(items[i : i + MAX_BATCH]) for i in range(0, len(items), MAX_BATCH)]
    return functools.reduce(DataFrame.unionByName, [nearest_of_block(rows, b, k, unpack) for b in blocks])


def stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["v"].to_numpy()).astype(np.float64)


def search_batch(vectors: DataFrame, queries: dict[str, Sequence[float]], k: int, id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score, rank) for any number of queries at once."""
    doc_id = F.col(id_col).cast("string")
    rows = vectors.where(F.col(vector).isNotNull()).select(doc_id.alias("doc_id"), doc_id.alias("tie"), F.col(vector).alias("v"))
    best = nearest_of_blocks(rows, queries, k, stacked).withColumn("score", clamp01(F.col("dot")))
    again = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return best.select("query_id", "doc_id", "score", F.row_number().over(again).alias("rank"))
