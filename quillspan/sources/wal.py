"""The write-ahead log: JSON lines, a file per batch, in folders by UTC day."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.model import Document, OperationError, WalRecord, check_doc_id, check_epoch_millis, required
from quillspan.operators.validate import document_error
from quillspan.sources.store import Store

RECORD = "event_id string, doc_id string, op string, document struct<doc_id string, text string, embedding array<float>, metadata variant, timestamp long>, timestamp long"
MALFORMED = "_malformed"


def now_millis() -> int:
    return time.time_ns() // 1_000_000


def segment_key(millis: int, segment: str) -> str:
    """``wal/YYYY/MM/DD/<segment>.jsonl`` by the UTC day."""
    day = datetime.fromtimestamp(millis // 1000, UTC)
    return f"wal/{day:%Y/%m/%d}/{segment}.jsonl"


class WriteLog:
    """Appends batches; landing a file is its queueing."""

    def __init__(self, store: Store, clock: Callable[[], int] = now_millis):
        self.store, self.clock = store, clock

    def _append(self, make: Callable[[str, int, int], WalRecord], n: int) -> dict[str, Any]:
        stamp = self.clock()
        check_epoch_millis(stamp)
        batch = f"batch-{uuid.uuid4().hex}"
        key = segment_key(stamp, batch)
        records = [make(f"{batch}-{i + 1:06d}", i, stamp) for i in range(n)]
        for r in records:
            r.validate()
        self.store.create(key, "".join(r.to_json() + "\n" for r in records).encode())
        return {"accepted_count": n, "wal_event_ids": [r.event_id for r in records], "batch_id": batch, "wal_key": key}

    def ingest(self, documents: Sequence[Document]) -> dict[str, Any]:
        """All documents are checked before anything is written."""
        if not documents:
            raise required("documents")
        for d in documents:
            d.validate()
        return self._append(lambda e, i, t: WalRecord(e, documents[i].doc_id, "upsert", t, documents[i]), len(documents))

    def delete(self, doc_ids: Sequence[str]) -> dict[str, Any]:
        if not doc_ids:
            raise required("doc_ids")
        for d in doc_ids:
            check_doc_id(d)
        return self._append(lambda e, i, t: WalRecord(e, doc_ids[i], "delete", t), len(doc_ids))

    def keys(self, trigger: str | None = None) -> list[str]:
        """All segments' keys and the trigger's, each once, in order."""
        found = {p.relative_to(self.store.root).as_posix() for p in (self.store.root / "wal").glob("*/*/*/*.jsonl")}
        return sorted(found | ({trigger} if trigger else set()))


def typed(lines: DataFrame) -> DataFrame:
    """Lines (value, segment) to records; a blank, bad or invalid line raises when it is read."""
    parsed = lines.select("segment", "value", F.from_json("value", f"{RECORD}, {MALFORMED} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}).alias("r"))
    d = F.col("r.document")
    meta = F.to_json(d["metadata"])
    document = document_error(d["doc_id"], d["text"], d["embedding"], meta, d["timestamp"])
    error = (
        F.when(F.trim("value") == "", "blank line")
        .when(F.col(f"r.{MALFORMED}").isNotNull() | F.col("r").isNull(), "malformed line")
        .when(F.coalesce(F.col("r.event_id"), F.lit("")) == "", "event_id is required")
        .when(F.coalesce(F.col("r.doc_id"), F.lit("")) == "", "doc_id is required")
        .when(F.coalesce(F.col("r.timestamp") < 1_000_000_000_000, F.lit(True)), "timestamp has an invalid value")
        .when(~F.coalesce(F.col("r.op").isin("upsert", "delete"), F.lit(False)), "op has an invalid value")
        .when((F.col("r.op") == "upsert") & d.isNull(), "document is required")
        .when((F.col("r.op") == "delete") & d.isNotNull(), "document has an invalid value")
        .when(d.isNotNull() & (d["doc_id"] != F.col("r.doc_id")), "doc_id must match document.doc_id")
        .when(d.isNotNull(), document)
    )
    checked = parsed.withColumn("op", F.when(error.isNotNull(), F.raise_error(F.concat("segment", F.lit(": "), error))).otherwise(F.col("r.op")))
    out = F.struct(d["doc_id"].alias("doc_id"), d["text"].alias("text"), d["embedding"].alias("embedding"), meta.alias("metadata"), d["timestamp"].alias("timestamp"))
    return checked.select("segment", "r.event_id", "r.doc_id", "op", F.when(F.col("op") == "upsert", out).alias("document"), "r.timestamp")


def read(spark: SparkSession, store: Store, keys: Iterable[str]) -> DataFrame:
    """Records of the segments named; a missing one raises."""
    paths = []
    for key in keys:
        if not store.path(key).is_file():
            raise OperationError(f"missing segment {key}", "build_error")
        paths.append(str(store.path(key)))
    if not paths:
        raise OperationError("no segments to build from", "build_error")
    root = len(str(store.root)) + 1
    lines = spark.read.text(paths).select("value", F.expr(f"substring(parse_url(_metadata.file_path, 'PATH'), {root + 1})").alias("segment"))
    return typed(lines)


def documents_from_json(body: bytes) -> tuple[str, list[Any]]:
    """The operation and payload of a write request: ingest documents or delete ids."""
    raw = json.loads(body)
    operation = raw.get("operation") if isinstance(raw, dict) else None
    if operation == "ingest":
        return operation, [Document.from_json(d) for d in raw.get("documents") or []]
    if operation == "delete":
        return operation, list(raw.get("doc_ids") or [])
    raise required("operation") if operation is None else OperationError("operation has an invalid value", "validation_error")
