"""Requests, results, documents and manifests, with their validation rules.

Lengths of queries are counted in characters, those of ids, texts and metadata
in UTF-8 bytes.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

# Limits.
QUERY_MAX_CHARS = 1000
TOP_K_MAX = 100
WINDOW_MAX = 100
DOC_ID_MAX_BYTES = 256
TEXT_MAX_BYTES = 100_000
METADATA_MAX_BYTES = 10_000
MIN_EPOCH_MILLIS = 1_000_000_000_000
CACHE_MAX_BYTES = 10 * 1024**3

# Names of corpus types by number, and their labels in contexts.
CORPUS_TYPES = {0: "legal", 1: "contract", 2: "rfc"}
CORPUS_LABELS = {"legal": "法规", "contract": "合同", "rfc": "RFC"}
OTHER_LABEL = "法规/合同"

CITATION = T.StructType([T.StructField(n, T.StringType()) for n in ("resource_id", "source_type", "source_ref", "title", "url")])
RESULT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("score", T.FloatType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("chunk_source", T.StringType()),
        T.StructField("corpus_type", T.StringType()),
        T.StructField("citation", CITATION),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)


class ValidationError(ValueError):
    """A request or record breaks a rule; the message names the field."""

    error_type = "validation_error"


class OperationError(RuntimeError):
    """A storage or build step failed."""

    def __init__(self, message: str, error_type: str = "operation_error"):
        super().__init__(message)
        self.error_type = error_type


# The wording of validation errors.
def required(name: str) -> ValidationError:
    return ValidationError(f"{name} is required")


def outside(name: str, low: int, high: int) -> ValidationError:
    return ValidationError(f"{name} must be between {low} and {high}")


def invalid(name: str) -> ValidationError:
    return ValidationError(f"{name} has an invalid value")


def mismatch(name: str, expected: str) -> ValidationError:
    return ValidationError(f"{name} must match {expected}")


def too_large(name: str, most: int) -> ValidationError:
    return ValidationError(f"{name} exceeds the maximum size of {most} bytes")


def status_of(error_type: str) -> int:
    return {"validation_error": 400, "not_found": 404}.get(error_type, 500)


def canonical_json(value: Any) -> str:
    """JSON without spaces, keys in order at every level, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def check_epoch_millis(value: Any, name: str = "timestamp") -> None:
    if not isinstance(value, int) or isinstance(value, bool) or value < MIN_EPOCH_MILLIS:
        raise invalid(name)


def check_doc_id(doc_id: Any) -> None:
    if not isinstance(doc_id, str):
        raise invalid("doc_id")
    if not doc_id:
        raise required("doc_id")
    if len(doc_id.encode()) > DOC_ID_MAX_BYTES:
        raise outside("doc_id", 1, DOC_ID_MAX_BYTES)


@dataclass
class CorpusWeights:
    static_bias: float
    dynamic_bias: float

    def validate(self) -> None:
        for name in ("static_bias", "dynamic_bias"):
            v = getattr(self, name)
            if not isinstance(v, (int, float)) or not 0.0 <= v <= 1.0:
                raise invalid(name)


@dataclass
class SearchRequest:
    query: str
    top_k: int
    filters: dict[str, str | bool | int | float] | None = None
    include_metadata: bool = True
    corpus_weights: CorpusWeights | None = None

    @classmethod
    def from_json(cls, raw: dict[str, Any]) -> SearchRequest:
        """From a request body; query, top_k and include_metadata have no defaults, unknown fields are ignored."""
        for name, kind in (("query", str), ("top_k", int), ("include_metadata", bool)):
            if name not in raw:
                raise required(name)
            if not isinstance(raw[name], kind) or (kind is int and isinstance(raw[name], bool)):
                raise invalid(name)
        w = raw.get("corpus_weights")
        try:
            weights = CorpusWeights(w["static_bias"], w["dynamic_bias"]) if w is not None else None
        except (KeyError, TypeError) as error:
            raise invalid("corpus_weights") from error
        return cls(raw["query"], raw["top_k"], raw.get("filters"), raw["include_metadata"], weights)

    def validate(self) -> None:
        if not self.query:
            raise required("query")
        if len(self.query) > QUERY_MAX_CHARS:
            raise outside("query", 1, QUERY_MAX_CHARS)
        if not 1 <= self.top_k <= TOP_K_MAX:
            raise outside("top_k", 1, TOP_K_MAX)
        for name, value in (self.filters or {}).items():
            if not name:
                raise required("filters.field")
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
                raise invalid("filters.field")
            if isinstance(value, str):
                if not value:
                    raise required("filters.value")
            elif isinstance(value, (bool, int, float)):
                if not math.isfinite(value):
                    raise invalid("filters.value")
            else:
                raise invalid("filters.value")
        if self.corpus_weights:
            self.corpus_weights.validate()

    def validate_direct(self, retriever: str) -> None:
        """As ``validate``, for a single retriever, which has neither filters nor metadata."""
        self.validate()
        for name, given in (("filters", self.filters is not None), ("include_metadata", self.include_metadata)):
            if given:
                raise OperationError(f"{name} are unsupported for {retriever} search" if name == "filters" else f"{name} is unsupported for {retriever} search", "execution_error")

    @property
    def window(self) -> int:
        return window(self.top_k)


def window(top_k: int) -> int:
    """Rows retrieved by each path, and kept of each group."""
    return min(3 * max(top_k, 1), WINDOW_MAX)


def windows(top_k: int) -> list[int]:
    """The windows tried in turn until enough rows pass the filters."""
    out, k = [], max(top_k, 1)
    while True:
        out.append(window(k))
        if k >= WINDOW_MAX:
            return out
        k = min(2 * k, WINDOW_MAX)


@dataclass
class Document:
    doc_id: str
    text: str
    metadata: dict[str, Any]
    timestamp: int
    embedding: list[float] | None = None

    @classmethod
    def from_json(cls, raw: Any) -> Document:
        if not isinstance(raw, dict):
            raise invalid("documents")
        for name in ("doc_id", "text", "metadata", "timestamp"):
            if name not in raw:
                raise required(name)
        return cls(raw["doc_id"], raw["text"], raw["metadata"], raw["timestamp"], raw.get("embedding"))

    def validate(self, dim: int | None = None) -> None:
        check_doc_id(self.doc_id)
        if not isinstance(self.text, str):
            raise invalid("text")
        if not self.text:
            raise required("text")
        if len(self.text.encode()) > TEXT_MAX_BYTES:
            raise too_large("text", TEXT_MAX_BYTES)
        if self.embedding is not None and not all(isinstance(x, (int, float)) and math.isfinite(x) for x in self.embedding):
            raise invalid("embedding")
        if not isinstance(self.metadata, dict):
            raise invalid("metadata")
        if len(canonical_json(self.metadata).encode()) > METADATA_MAX_BYTES:
            raise too_large("metadata", METADATA_MAX_BYTES)
        check_epoch_millis(self.timestamp)
        if dim is not None and self.embedding is not None and len(self.embedding) != dim:
            raise invalid("embedding")


@dataclass
class WalRecord:
    event_id: str
    doc_id: str
    op: str
    timestamp: int
    document: Document | None = None

    def validate(self) -> None:
        if not self.event_id:
            raise required("event_id")
        if not self.doc_id:
            raise required("doc_id")
        check_epoch_millis(self.timestamp)
        if self.op not in ("upsert", "delete"):
            raise invalid("op")
        if self.op == "upsert" and self.document is None:
            raise required("document")
        if self.op == "delete" and self.document is not None:
            raise invalid("document")
        if self.document is not None:
            if self.document.doc_id != self.doc_id:
                raise mismatch("doc_id", "document.doc_id")
            self.document.validate()

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)


@dataclass
class Shard:
    shard_id: int
    document_count: int
    table_path: str
    keyword_path: str


@dataclass
class IndexManifest:
    version_id: int
    created_at: int
    embedding_dim: int
    document_count: int
    num_shards: int
    shards: list[Shard] = field(default_factory=list)

    def validate(self) -> None:
        for name in ("num_shards", "embedding_dim"):
            if getattr(self, name) <= 0:
                raise ValidationError(f"{name} must be positive")
        check_epoch_millis(self.created_at, "created_at")
        if len(self.shards) != self.num_shards:
            raise mismatch("shards", "len(shards) == num_shards")
        if sum(s.document_count for s in self.shards) != self.document_count:
            raise mismatch("document_count", "sum(shard.document_count)")
        for s in self.shards:
            check_store_uri(s.table_path, "table_path")
            check_store_uri(s.keyword_path, "keyword_path")

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> IndexManifest:
        raw = json.loads(text)
        return cls(**{**raw, "shards": [Shard(**s) for s in raw["shards"]]})


def check_store_uri(uri: str, name: str) -> None:
    bucket, _, key = uri.removeprefix("s3://").partition("/")
    if not uri.startswith("s3://") or not bucket or not key:
        raise invalid(name)
