"""Validation of document tables as column expressions: each row's first broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.arrays import is_finite
from quillspan.model import DOC_ID_MAX_BYTES, METADATA_MAX_BYTES, MIN_EPOCH_MILLIS, TEXT_MAX_BYTES, ValidationError


def document_error(doc_id: Column, text: Column, embedding: Column, metadata: Column, timestamp: Column, dim: int | None = None) -> Column:
    """The message of the first rule a document breaks, or null."""
    bad_vector = F.exists(embedding, lambda x: ~is_finite(x))
    if dim is not None:
        bad_vector = bad_vector | (F.size(embedding) != dim)
    return (
        F.when(doc_id.isNull() | (doc_id == ""), "doc_id is required")
        .when(F.octet_length(doc_id) > DOC_ID_MAX_BYTES, f"doc_id must be between 1 and {DOC_ID_MAX_BYTES}")
        .when(text.isNull() | (text == ""), "text is required")
        .when(F.octet_length(text) > TEXT_MAX_BYTES, f"text exceeds the maximum size of {TEXT_MAX_BYTES} bytes")
        .when(embedding.isNotNull() & bad_vector, "embedding has an invalid value")
        .when(F.coalesce(~F.schema_of_variant(F.try_parse_json(metadata)).startswith("OBJECT"), F.lit(True)), "metadata has an invalid value")
        .when(F.octet_length(metadata) > METADATA_MAX_BYTES, f"metadata exceeds the maximum size of {METADATA_MAX_BYTES} bytes")
        .when(timestamp.isNull() | (timestamp < MIN_EPOCH_MILLIS), "timestamp has an invalid value")
    )


def require_valid(df: DataFrame, dim: int | None = None) -> DataFrame:
    """Raises the first message found in a table of documents; a batch with a bad document is refused whole."""
    error = document_error(*[F.col(c) for c in ("doc_id", "text", "embedding", "metadata", "timestamp")], dim)
    bad = df.select(error.alias("e")).where("e is not null").limit(1).collect()
    if bad:
        raise ValidationError(bad[0]["e"])
    return df


def duplicate_ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def hash_collisions(df: DataFrame, key: str, hashed: Column) -> DataFrame:
    """Hashes that different ids share."""
    return df.select(F.col(key).alias("k"), hashed.alias("h")).groupBy("h").agg(F.count_distinct("k").alias("n_ids")).where("n_ids > 1")
