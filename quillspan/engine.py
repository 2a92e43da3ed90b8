"""The engine as one object: write, build, search, roll back, static releases, health."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.embed import Embedder, embed_query
from quillspan.model import Document, OperationError, SearchRequest, mismatch
from quillspan.operators import context, hybrid, keyword, turbo, validate
from quillspan.operators import vector as vec
from quillspan.sources import publish, release, wal
from quillspan.sources.store import Store
from quillspan.streaming import worker


class BuildQueue(Protocol):
    """What a write tells of its batch; ``JobQueue`` is one."""

    def enqueue(self, batch: str, body: str) -> None: ...


class HybridEngine:
    """Tables of the active version and release are kept by their names, and re-read when a pointer moves."""

    def __init__(self, spark: SparkSession, root: str | Path, embedder: Embedder, clock: Callable[[], int] = wal.now_millis, warn: Callable[[str], None] = print, queue: BuildQueue | None = None):
        self.spark, self.store, self.embedder, self.clock, self.warn = spark, Store(root), embedder, clock, warn
        self.log, self.queue = wal.WriteLog(self.store, clock), queue
        self._cached: tuple[tuple, Any] | None = None
        self.hits = self.misses = 0

    # --- writing ---

    def _landed(self, written: dict[str, Any]) -> dict[str, Any]:
        """A batch in the log asks for a build, if there is a queue to ask."""
        if self.queue is not None:
            self.queue.enqueue(written["batch_id"], json.dumps({"wal_key": written["wal_key"]}))
        return written

    def ingest(self, documents: Sequence[Document]) -> dict[str, Any]:
        return self._landed(self.log.ingest(documents))

    def delete(self, doc_ids: Sequence[str]) -> dict[str, Any]:
        return self._landed(self.log.delete(doc_ids))

    def build(self, version: int | None = None, wal_keys: Sequence[str] | None = None, shards: int = 1) -> dict[str, Any]:
        """Builds from all segments, or from those named alone, and publishes; several shards are for vector searches alone."""
        if version is None and shards == 1:
            return worker.rebuild(self.spark, self.store, self.embedder.column, self.embedder.dim, None, self.clock, list(wal_keys) if wal_keys else None)
        current = publish.active_version(self.store)
        version = (current or 0) + 1 if version is None else version
        if current is not None and version <= current:
            raise OperationError(f"publish conflict: version {version} is not above the active {current}", "publish_error")
        manifest = publish.build(self.spark, self.store, version, wal_keys or self.log.keys(), self.embedder.column, self.embedder.dim, self.clock, shards=shards)
        return publish.publish(self.store, manifest, self.clock())

    def rollback(self, target: int, expected: int | None) -> dict[str, Any]:
        return publish.rollback(self.store, target, self.clock(), expected)

    # --- static corpora ---

    def static_build(self, rows: DataFrame, codec: turbo.Codec, model_id: str, source: release.ReleaseSource, key: str) -> dict[str, Any]:
        return release.build_release(rows, codec, model_id, source, self.store, key)

    def static_build_version(self, version: int, codec: turbo.Codec, model_id: str, corpus_type: str, key: str) -> dict[str, Any]:
        """A release from the documents of an index version, pinned by its folder, with the vectors stored there."""
        body = self.store.read(publish.manifest_key(version))
        if body is None:
            raise OperationError(f"version {version} is missing", "build_error")
        manifest = publish.IndexManifest.from_json(body.decode())
        rows = publish.read_tables(self.spark, self.store, manifest).documents
        rows = validate.require_valid(rows, manifest.embedding_dim).select("doc_id", "text", "metadata", "embedding")
        source = release.ReleaseSource("table", manifest.shards[0].table_path, version, rows.count(), corpus_type)
        return self.static_build(rows, codec, model_id, source, key)

    def static_activate(self, key: str, model_id: str | None = None, dim: int | None = None) -> bool:
        """Verifies, installs and activates; False if the pointer was changed by someone else."""
        folder = self.store.path(key)
        manifest = release.verify(self.spark, folder, model_id, dim)
        release.install(self.store, folder, manifest)
        return release.activate(self.store, manifest["release_id"], self.clock())

    # --- reading ---

    def _tables(self):
        head, manifest = publish.load_active(self.store)
        static = release.active_release(self.store)
        key = (head["version_id"], static)
        if self._cached and self._cached[0] == key:
            self.hits += 1
            return self._cached[1]
        self.misses += 1
        if manifest.embedding_dim != self.embedder.dim:
            raise OperationError(f"embedding_dim {manifest.embedding_dim} of the index is not the embedder's {self.embedder.dim}", "execution_error")
        tables = publish.read_tables(self.spark, self.store, manifest)
        loaded = release.load(self.spark, self.store.path(release.release_key(static))) if static else None
        self._cached = (key, (head["version_id"], static, tables, loaded))
        return self._cached[1]

    def search_frames(self, request: SearchRequest) -> tuple[hybrid.Groups, int, str | None]:
        request.validate()
        version, static_id, tables, loaded = self._tables()
        query_vector = embed_query(self.embedder, request.query, self.warn)
        static = None
        if loaded is not None and query_vector is not None:
            rows, codec = loaded
            best = turbo.search(rows, codec, query_vector, 100)
            static = best.join(rows.select("doc_id", "text", "metadata", "corpus_type"), "doc_id")
        parsed = keyword.parse(request.query)
        words = keyword.search_index(tables.keyword, request.query, 100) if parsed.from_postings else None
        docs = tables.documents.drop("shard")
        return hybrid.search(docs, docs.select("doc_id", "embedding"), request, query_vector, static, words), version, static_id

    def search(self, request: SearchRequest) -> dict[str, Any]:
        began = time.monotonic()
        groups, version, static_id = self.search_frames(request)
        static, dynamic = ([_plain(r.asDict(recursive=True)) for r in g.collect()] for g in (groups.static, groups.dynamic))  # at most 100 rows each
        for rows, name in ((static, "static_chunks"), (dynamic, "dynamic_chunks")):
            if len(rows) > request.window:
                raise mismatch(name, f"a window of {request.window} rows")
        out = {
            "static_chunks": static,
            "static_count": len(static),
            "dynamic_chunks": dynamic,
            "dynamic_count": len(dynamic),
            "latency_ms": int((time.monotonic() - began) * 1000),
            "index_version": version,
        }
        return out | ({"static_release_id": static_id} if static_id else {})

    def vector_search(self, query_vector: Sequence[float], k: int) -> DataFrame:
        vec.check_query(query_vector, self.embedder.dim)
        tables = self._tables()[2]
        if tables.shards > 1:
            return vec.search_shards(tables.documents, F.col("shard"), query_vector, k)
        return vec.search(tables.documents.select("doc_id", "embedding"), query_vector, k)

    def keyword_search(self, query: str, k: int) -> DataFrame:
        return keyword.search_index(self._tables()[2].keyword, query, k)

    def search_vectors_only(self, request: SearchRequest, query_vector: Sequence[float]) -> DataFrame:
        request.validate_direct("vector")
        return self.vector_search(query_vector, request.top_k)

    def search_keywords_only(self, request: SearchRequest) -> DataFrame:
        request.validate_direct("keyword")
        return self.keyword_search(request.query, request.top_k)

    def context(self, request: SearchRequest, max_tokens: int | None = None) -> tuple[str, str]:
        """System prompt and context of a search."""
        found = self.search(request)
        args = (found["static_chunks"], found["dynamic_chunks"], request.query)
        text = context.build(*args) if max_tokens is None else context.build_bounded(*args, max_tokens)
        return context.system_prompt(request.corpus_weights), text

    def health(self) -> tuple[int, dict[str, Any]]:
        """200 with the active version (null before the first), 503 if pointer or embedder fail."""
        try:
            version = publish.active_version(self.store)
            self.embedder.query("health")
        except Exception as error:  # any failure makes the reader unfit
            return 503, {"status": "unavailable", "message": str(error)}
        return 200, {"status": "ok", "index_version": version}

    def cache_stats(self) -> dict[str, Any]:
        return {"hit_count": self.hits, "miss_count": self.misses, "current_version": self._cached[0][0] if self._cached else None}


def _plain(row: dict[str, Any]) -> dict[str, Any]:
    """A result without the optional fields that are null; metadata as an object."""
    row["metadata"] = None if row["metadata"] is None else json.loads(row["metadata"])
    return {k: v for k, v in row.items() if v is not None or k not in ("corpus_type", "citation")}
