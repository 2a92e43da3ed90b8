"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import materialise


def remainder(key: str, divisor: int) -> Column:
    """CRC-32 of a key as text, modulo a divisor; the folds of the classifiers. A null key has the remainder of an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(divisor)).cast("int")


def sample(documents: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of at most ``per_class`` labelled rows of either class: key, text, label (0 or 1).

    Of the allowed rows those with the least hash of the key, so the choice is
    stable and no class's rows meet in one task; of an id with several labels the
    least counts, of one with several texts the least (null first). The ids
    chosen are bounded and are broadcast; the texts are written to the shared folder.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & allowed).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"))
    single = usable.groupBy("__key").agg(F.min("__label").alias("__label"))
    chosen = [single.where(F.col("__label") == c).orderBy(F.xxhash64("__key"), "__key").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    found = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(ids, F.col("key") == F.col("__key"))
    least = found.groupBy("key").agg(F.min(F.struct("text", F.col("__label").alias("label"))).alias("row"))
    return materialise(least.select("key", "row.text", "row.label"), "labelled")
