"""Sharding by rendezvous hashing of record keys over weighted shards.

Every shard scores every key by itself, ``weight / -ln(u)`` with ``u`` in (0, 1)
from an MD5 digest of key and shard; the highest score wins. The placement of a
key depends on the key and the shards alone, so a further shard only takes keys
into itself and a removed one only gives its own away.

Defined results: a null key is the key ``\\N``; a null text has no bytes and the
CRC of none; repeated rows share a shard and take slots of their own; an empty
table gives no rows; input columns named like the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import rank_within, table, without


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("\\N"))


def unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) of key and shard: the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(key_text(key), F.lit(f"#{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest rendezvous score; ties go to the lower number."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    scored = [F.struct((F.lit(float(w)) / -F.log(unit(key, i))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*scored))["shard"]).cast("int")


def digest_hash(digest: Column) -> Column:
    """The first 60 bits of a hex digest as a long, in the same order."""
    return F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") - (1 << 59), 4)


def assign(df: DataFrame, key: str, weights: Sequence[float], order: Sequence[str] = ()) -> DataFrame:
    """Adds ``shard`` and ``slot`` (0, 1, ... within the shard, gapless, by an MD5 digest of the key and ``order``)."""
    said = F.concat_ws("#", key_text(F.col(key)), *[F.col(c).cast("string") for c in order])
    placed = without(df, "shard", "slot").withColumn("shard", shard_of(F.col(key), weights)).withColumn("__digest", F.md5(said))
    ranked = rank_within(placed, "shard", digest_hash(F.col("__digest")), [F.col(c) for c in ("__digest", key, *order)], "slot", df.count())
    return ranked.drop("__digest")


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str) -> None:
    """Writes the rows as one folder a shard; a hot shard is spread over tasks by a salt of the key."""
    placed = without(df, "shard").withColumn("shard", shard_of(F.col(key), weights))
    placed.repartition("shard", F.pmod(F.xxhash64(F.col(key)), F.lit(64))).write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), [1.0] * 9).alias("grown_shard"),
    )
    return assign(docs, "doc_id", [1.0] * 8, ["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


_SCORE = "-ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\\N') || '#' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"

#: CRC-32 by a table of its bytes' remainders, made by eight steps each; DuckDB has none.
ORACLE = f"""
WITH t AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, strlen(text) + 1 AS size, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM d, t),
p AS (SELECT *, (SELECT arg_min(s, ({_SCORE}, s)) FROM range(8) r(s)) AS shard,
        (SELECT arg_min(s, ({_SCORE}, s)) FROM range(9) r(s)) AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY
    md5(coalesce(CAST(doc_id AS VARCHAR), '\\N') || '#' || text_crc32 || '#' || size), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard FROM p
"""
