"""Hashes: FNV-1a as a column, digests of contents and releases."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as DECIMAL(20,0), so that it orders without sign.

    XOR touches the lowest byte only; multiplication modulo 2**64 is done in
    decimals, which ANSI arithmetic does not overflow. An empty text has the
    offset, a null none.
    """
    raw = F.encode(text, "UTF-8")
    prime, modulus = F.lit(FNV_PRIME).cast("decimal(13,0)"), F.lit(str(2**64)).cast("decimal(20,0)")

    def step(h: Column, i: Column) -> Column:
        low = (h % 256).cast("bigint")
        byte = F.conv(F.hex(F.substring(raw, i + 1, F.lit(1))), 16, 10).cast("bigint")
        mixed = (h - low.cast("decimal(20,0)") + low.bitwiseXOR(byte).cast("decimal(20,0)")).cast("decimal(20,0)")
        return ((mixed * prime) % modulus).cast("decimal(20,0)")

    start = F.lit(str(FNV_OFFSET)).cast("decimal(20,0)")
    places = F.when(F.octet_length(text) > 0, F.sequence(F.lit(0), F.octet_length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(text.isNotNull(), F.aggregate(places, start, step))


def fnv1a_bytes(raw: bytes) -> int:
    h = FNV_OFFSET
    for b in raw:
        h = (h ^ b) * FNV_PRIME % 2**64
    return h


def sha256_hex(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _sized(raw: bytes) -> bytes:
    return struct.pack("<Q", len(raw)) + raw


def row_hash(*parts: Column) -> Column:
    """SHA-256 of texts, each after its length in bytes, so that no two rows of parts look alike; null counts as empty."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.sha2(F.concat(*[x for t in texts for x in (F.octet_length(t).cast("string"), F.lit(":"), t)]), 256)


def content_digest(hashes: DataFrame, column: str = "h") -> DataFrame:
    """One row (n, digest) for a table of row hashes, whatever the order of rows and their partitioning.

    Rows meet by the first three digits of their hash; a bucket's digest is that
    of its hashes in order, the whole one that of the at most 4096 buckets' in order.
    """

    def joined(name: str) -> Column:
        return F.sha2(F.array_join(F.sort_array(F.collect_list(name)), ""), 256)

    buckets = hashes.groupBy(F.substring(column, 1, 3).alias("k")).agg(joined(column).alias("b"), F.count(F.lit(1)).alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("k", "b")))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["b"]), ""), 256).alias("digest"))


def release_id(turbo_version: int, model_id: str, dim: int, codec: tuple[int, int, int, int], digest: str, outputs: Iterable[tuple[str, str, int]]) -> str:
    """Of a release's contents alone, not of where they came from. codec: dim, centroids a dimension, two seeds."""
    parts = [struct.pack("<I", turbo_version), _sized(model_id.encode()), struct.pack("<I", dim), struct.pack("<IIQQ", *codec), _sized(digest.encode())]
    for name, sha, size in sorted(outputs):
        parts.append(_sized(name.encode()) + sha.encode() + struct.pack("<Q", size))
    return sha256_hex(b"".join(parts))
