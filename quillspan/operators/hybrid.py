"""Hybrid search: vector and keyword lists fused by reciprocal rank, with typed post-filters.

Filters apply after fusion, so ranks and scores are those of the unfiltered
lists. With filters the retrieval window widens until enough rows pass. That
loop is laid out as data: both lists are retrieved once at the widest window
with their raw ranks, every window takes the rows it would have seen, ranks and
fuses them, and the first window with enough survivors is chosen; at most
2 x 100 x 8 rows. Retrieval, fusion, filtering and payload are one plan; texts and
metadata join only the candidates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.functions.arrays import clamp01
from quillspan.functions.hashing import fnv1a
from quillspan.functions.text import citation, static_citation
from quillspan.model import RESULT, SearchRequest, windows
from quillspan.operators import keyword as kw
from quillspan.operators import vector as vec
from quillspan.operators.filters import all_match
from quillspan.operators.rank import rrf_score


@dataclass
class Groups:
    static: DataFrame
    dynamic: DataFrame


def _ranked(df: DataFrame, score: Column, k: int) -> DataFrame:
    """(doc_id, value, raw): the k best by value with 1-based ranks; k is at most 100."""
    top = df.select("doc_id", score.alias("value")).orderBy(F.desc("value"), F.asc("doc_id")).limit(k)
    return top.withColumn("raw", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), F.asc("doc_id"))))


def _seen(ranked: DataFrame, tried: list[int], score: Column, rank: str) -> DataFrame:
    """Each window's rows, ranked again by their final score."""
    steps = F.posexplode(F.array(*map(F.lit, tried))).alias("step", "w")
    seen = ranked.select("doc_id", "raw", score.alias("score"), steps).where("raw <= w")
    here = Window.partitionBy("step").orderBy(F.desc("score"), F.asc("doc_id"))
    return seen.select("step", "doc_id", "score", F.row_number().over(here).alias(rank))


def keyword_candidates(docs: DataFrame, query: str, k: int) -> DataFrame:
    scored = kw.score_texts(docs, query)
    return _ranked(scored.groupBy("doc_id").agg(F.max("score").alias("score")), F.col("score"), k)


def search(
    docs: DataFrame,
    vectors: DataFrame,
    request: SearchRequest,
    query_vector: Sequence[float] | None,
    static: DataFrame | None = None,
    keyword_list: DataFrame | None = None,
) -> Groups:
    """docs: doc_id, text, metadata (JSON). vectors: doc_id, embedding. Both groups come with the schema of results.

    Without a query vector (its generation failed) only keywords count: the
    source is then keyword, scores are those of BM25, and the static group is
    empty. ``static``: (doc_id, score, text, metadata, corpus_type) of a static
    search for 100 rows; ties go to the lower hash of the id. ``keyword_list``: (doc_id, score) from an index.
    """
    request.validate()
    spark = docs.sparkSession
    tried = windows(request.top_k) if request.filters else [request.window]
    most = max(tried)
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    words = _ranked(keyword_list, F.col("score"), most) if keyword_list is not None else keyword_candidates(ids, request.query, most)
    by_words = _seen(words, tried, F.col("value"), "krank")
    if query_vector is None:
        fused = by_words.select("step", "doc_id", F.col("score").cast("float").alias("score"), F.lit(None).cast("int").alias("vrank"), "krank", F.lit("keyword").alias("source"))
    else:
        raw = _ranked(vec.raw_scores(vectors, query_vector), F.col("dot"), most)
        by_vector = _seen(raw, tried, clamp01(F.col("value")), "vrank").drop("score")
        both = by_vector.join(by_words.drop("score"), ["step", "doc_id"], "full_outer")
        fused = both.select("step", "doc_id", rrf_score(F.col("vrank"), F.col("krank")).alias("score"), "vrank", "krank", F.lit("hybrid").alias("source"))
    payload = ids.select("doc_id", "text", "metadata").join(F.broadcast(fused.select("doc_id").distinct()), "doc_id")  # at most 200 ids
    payload = payload.dropDuplicates(["doc_id"])
    kept = fused.join(payload, "doc_id").withColumn("metadata", F.when((F.col("metadata") == "{}") & F.col("krank").isNull(), None).otherwise(F.col("metadata")))
    passing = kept.where(all_match(F.col("metadata"), request.filters))
    # Every window is counted, those that nothing passes, too.
    counts = spark.range(len(tried)).select(F.col("id").cast("int").alias("step")).join(passing.groupBy("step").count(), "step", "left")
    chosen = counts.agg(F.coalesce(F.min(F.when(F.coalesce("count", F.lit(0)) >= request.top_k, F.col("step"))), F.lit(len(tried) - 1)).alias("step"))
    final = passing.join(F.broadcast(chosen), "step")
    dynamic = _result(final, request, "dynamic", F.lit(None).cast("string"), citation(F.col("metadata")))
    if static is None or query_vector is None:
        return Groups(spark.createDataFrame([], RESULT), dynamic)
    rows = static.withColumn("source", F.lit("static")).withColumn("score", F.col("score").cast("float")).withColumn("h", fnv1a(F.col("doc_id")))
    here = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc("h"))
    # The static list is cut at the chosen window, then filtered.
    width = F.element_at(F.array(*map(F.lit, tried)), chosen.scalar() + 1)
    cut = rows.withColumn("raw", F.row_number().over(here)).where(F.col("raw") <= width)
    cut = cut.where(all_match(F.col("metadata"), request.filters))
    return Groups(_result(cut, request, "static", F.col("corpus_type"), static_citation(F.col("metadata"), F.col("doc_id"), F.col("corpus_type")), "raw"), dynamic)


def _result(df: DataFrame, request: SearchRequest, group: str, corpus_type: Column, cited: Column, order: str | None = None) -> DataFrame:
    """The first window of a group, in its order, with the columns of results."""
    by = [F.col(order).asc()] if order else [F.desc("score"), F.asc("doc_id")]
    top = df.orderBy(*by).limit(request.window)
    return top.select(
        "doc_id",
        F.col("score").cast("float").alias("score"),
        "text",
        (F.col("metadata") if request.include_metadata else F.lit(None).cast("string")).alias("metadata"),
        "source",
        F.lit(group).alias("chunk_source"),
        corpus_type.alias("corpus_type"),
        cited.alias("citation"),
    )
