"""Order, best row per id, reciprocal-rank fusion and payload merge of ranked lists.

Lists here are already cut to a retrieval window of at most 100 rows, so the
positional ranks over all of a list run in one small task by design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Added to every rank.
RRF_K = 60


def best_per_id(df: DataFrame, *payload: str) -> DataFrame:
    """One row per doc_id: the one with the highest score (of equals, the least payload)."""
    least = F.struct(*[F.col(c) for c in payload]) if payload else None
    if least is None:
        return df.groupBy("doc_id").agg(F.max("score").alias("score"))
    best = df.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), least.alias("p"))).alias("b"))
    return best.select("doc_id", (-F.col("b.s")).alias("score"), *[F.col(f"b.p.{c}").alias(c) for c in payload])


def by_score() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id")]


def with_rank(df: DataFrame, to: str, *groups: str) -> DataFrame:
    """1-based positions by score and id; of a short list (or within groups)."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*groups or [F.lit(0)]).orderBy(*by_score())))


def reciprocal(rank: Column, k: int = RRF_K) -> Column:
    return (F.lit(1.0) / (F.lit(float(k)) + rank)).cast("float")


def rrf_score(vector_rank: Column, keyword_rank: Column, k: int = RRF_K) -> Column:
    """The sum of reciprocals in single precision, as many as there are ranks."""
    zero = F.lit(0.0).cast("float")
    both = F.coalesce(reciprocal(vector_rank, k), zero) + F.coalesce(reciprocal(keyword_rank, k), zero)
    return both.cast("float")


def fuse(vector: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """Two lists of (doc_id, score) to (doc_id, score, vector_rank, keyword_rank)."""
    v = with_rank(vector.select("doc_id", "score"), "vector_rank").drop("score")
    w = with_rank(keyword.select("doc_id", "score"), "keyword_rank").drop("score")
    return v.join(w, "doc_id", "full_outer").withColumn("score", rrf_score(F.col("vector_rank"), F.col("keyword_rank"), k))


def merge_metadata(first: Column, second: Column) -> Column:
    """The union of two JSON objects as maps of JSON texts, ``first``'s values winning; null only if both are."""
    a, b = F.coalesce(first, F.create_map().cast("map<string,string>")), F.coalesce(second, F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)), a)
    return F.when(first.isNotNull() | second.isNotNull(), merged)


def object_entries(metadata: Column) -> Column:
    """A JSON object's keys with their values as JSON texts; null if it is no object."""
    parsed = F.try_variant_get(F.try_parse_json(metadata), "$", "map<string,variant>")
    return F.transform_values(parsed, lambda _, v: F.to_json(v))


def entries_json(entries: Column) -> Column:
    """Entries back to one JSON object, keys in order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(entries)))
    return F.to_json(F.transform_values(ordered, lambda _, v: F.parse_json(v)))
