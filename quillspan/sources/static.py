"""Static corpora from JSON lines, by source with a corpus type each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StaticSource:
    path: str
    corpus_type: str


def read_lines(spark: SparkSession, source: StaticSource) -> DataFrame:
    """(doc_id, text, metadata, corpus_type); blank lines are skipped, a bad line raises with its file."""
    lines = spark.read.text(source.path).select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    parsed = lines.select("file", "value", F.try_parse_json("value").alias("v"))
    doc_id, text = (F.try_variant_get("v", f"$.{c}", "string") for c in ("doc_id", "text"))
    bad = F.col("v").isNull() | doc_id.isNull() | text.isNull() | (doc_id == "") | (text == "")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad static line in "), "file", F.lit(": "), F.substring("value", 1, 80)))).otherwise(doc_id)
    meta = F.coalesce(F.to_json(F.try_variant_get("v", "$.metadata", "variant")), F.lit("{}"))
    return parsed.select(checked.alias("doc_id"), text.alias("text"), meta.alias("metadata"), F.lit(source.corpus_type).alias("corpus_type"))


def read_sources(spark: SparkSession, sources: Sequence[StaticSource]) -> DataFrame:
    """All sources, one after another."""
    if not sources:
        raise ValueError("sources is required")
    return reduce(lambda a, b: a.unionByName(b), [read_lines(spark, s) for s in sources])
