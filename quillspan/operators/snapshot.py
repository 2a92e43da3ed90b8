"""The last write of every document from a log of upserts and deletes.

The record with the greatest (timestamp, segment, event id) of an id wins; if it
deletes, the id is gone. Segments are replayed in order of their keys and event
ids are numbered in input order, so of equal timestamps the later row wins. Late
records are never dropped: an older timestamp loses whenever it arrives.
``max_by`` combines before the shuffle, so a hot id costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_writes(log: DataFrame, key: str = "doc_id", timestamp: str = "timestamp", ties: tuple[str, ...] = ("segment", "event_id")) -> DataFrame:
    """All columns of the winning record of each key."""
    row = F.struct(*[F.col(c) for c in log.columns])
    order = F.struct(F.col(timestamp), *[F.col(c) for c in ties])
    return log.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, order).alias("w")).select("w.*")


def live_documents(log: DataFrame) -> DataFrame:
    """The documents of winning upserts, in order of their ids."""
    return last_writes(log).where(F.col("op") == "upsert").select("document.*").orderBy("doc_id")


def resolve_embeddings(docs: DataFrame, embed) -> DataFrame:
    """Stored vectors where there are, else those of ``embed``, a column function of the text."""
    return docs.withColumn("embedding", F.coalesce(F.col("embedding"), embed(F.col("text"))))
