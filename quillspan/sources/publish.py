"""Index versions: built from the log, staged, published behind a swapped pointer, rolled back.

A version's tables (documents, postings, frequencies, statistics) are Parquet
folders written by Spark under keys of the version and never changed; readers
pin the version that the pointer named when they began.
"""

from __future__ import annotations

import functools
import json
import shutil
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.model import IndexManifest, OperationError, Shard, check_epoch_millis, invalid, required
from quillspan.operators import keyword
from quillspan.operators.snapshot import live_documents, resolve_embeddings
from quillspan.operators.validate import require_valid
from quillspan.sources import wal
from quillspan.sources.store import Store

HEAD = "index/_head"
BUCKET = "local"


def manifest_key(version: int) -> str:
    return f"index/versions/{version}/manifest.json"


def head_json(version: int, updated_at: int) -> bytes:
    return json.dumps({"version_id": version, "manifest_path": manifest_key(version), "updated_at": updated_at}, indent=2).encode()


def parse_head(raw: bytes) -> dict:
    try:
        head = json.loads(raw)
        version, path, updated = head["version_id"], head["manifest_path"], head["updated_at"]
    except (ValueError, KeyError, TypeError) as error:
        raise OperationError(f"the pointer is not readable: {error}") from error
    if not isinstance(version, int) or version <= 0:
        raise OperationError("the pointer names no positive version")
    check_epoch_millis(updated, "updated_at")
    if path != manifest_key(version):
        raise OperationError(f"the pointer's manifest is not {manifest_key(version)}")
    return head


def load_active(store: Store) -> tuple[dict, IndexManifest]:
    """The pointer and its manifest; they must agree."""
    raw = store.read(HEAD)
    if raw is None:
        raise OperationError("no active index: the pointer is missing", "execution_error")
    head = parse_head(raw)
    body = store.read(head["manifest_path"])
    if body is None:
        raise OperationError(f"manifest {head['manifest_path']} is missing", "execution_error")
    manifest = IndexManifest.from_json(body.decode())
    manifest.validate()
    if manifest.version_id != head["version_id"]:
        raise OperationError("pointer and manifest name different versions", "execution_error")
    return head, manifest


def active_version(store: Store) -> int | None:
    raw = store.read(HEAD)
    return None if raw is None else parse_head(raw)["version_id"]


@dataclass
class IndexTables:
    """Documents of all shards, with the shard's number, and the keyword tables of an index of one shard."""

    documents: DataFrame
    words: keyword.KeywordIndex | None
    shards: int

    @property
    def keyword(self) -> keyword.KeywordIndex:
        if self.words is None:
            raise OperationError(f"keyword search needs exactly one shard, not {self.shards}", "execution_error")
        return self.words


def read_tables(spark: SparkSession, store: Store, manifest: IndexManifest) -> IndexTables:
    """The tables of a pinned version."""
    parts = [spark.read.parquet(str(store.resolve(s.table_path))).withColumn("shard", F.lit(s.shard_id)) for s in manifest.shards]
    docs = functools.reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        return IndexTables(docs, None, len(parts))
    return IndexTables(docs, read_words(spark, store.resolve(manifest.shards[0].keyword_path)), 1)


def read_words(spark: SparkSession, folder: Path | str) -> keyword.KeywordIndex:
    return keyword.KeywordIndex(*[spark.read.parquet(f"{folder}/{name}") for name in ("postings", "frequencies", "stats")])


def write_words(docs: DataFrame, folder: Path | str) -> None:
    """The keyword tables of documents, to a folder of any file system that Spark writes to. Texts are split once, for the postings; the rest comes from the postings written.

    Files hold ranges of terms with statistics, so a query reads the few files
    its terms lie in. Postings are dealt by term and id: those of a term that
    very many documents hold fill several files.
    """
    spark = docs.sparkSession

    def write(rows: DataFrame, name: str, *by: str) -> None:
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(f"{folder}/{name}")

    write(keyword.postings_of(docs), "postings", "term", "doc_id")
    index = keyword.from_postings(spark.read.parquet(f"{folder}/postings"), docs)
    write(index.frequencies, "frequencies", "term")
    index.stats.write.parquet(f"{folder}/stats")


def build(
    spark: SparkSession,
    store: Store,
    version: int,
    keys: Iterable[str],
    embed: Callable[[Column], Column],
    dim: int,
    clock: Callable[[], int] = wal.now_millis,
    before_commit: Callable[[], None] | None = None,
    shards: int = 1,
) -> IndexManifest:
    """Builds a version's folders and manifest from log segments; nothing is active yet. Documents go to shards by a hash of their ids."""
    docs = live_documents(wal.read(spark, store, keys))
    stage = store.staging()
    try:
        whole = stage / "whole"
        resolve_embeddings(docs, embed).write.parquet(str(whole))
        written = spark.read.parquet(str(whole))
        require_valid(written, dim)
        made, moves = [], []
        for i in range(shards):
            own = written.where(F.pmod(F.xxhash64("doc_id"), F.lit(shards)) == i) if shards > 1 else written
            table, words = stage / f"documents-{i}", stage / f"keywords-{i}"
            own.write.parquet(str(table)) if shards > 1 else whole.rename(table)
            own = spark.read.parquet(str(table))
            write_words(own, words)
            base = f"index/versions/{version}/shards/{i}"
            made.append(Shard(i, own.count(), f"s3://{BUCKET}/{base}/documents", f"s3://{BUCKET}/{base}/keywords"))
            moves += [(table, f"{base}/documents"), (words, f"{base}/keywords")]
        manifest = IndexManifest(version, clock(), dim, sum(s.document_count for s in made), shards, made)
        manifest.validate()
        if before_commit:
            before_commit()
        (stage / "manifest.json").write_text(manifest.to_json())
        store.commit_staged([*moves, (stage / "manifest.json", manifest_key(version))])
        return manifest
    finally:
        shutil.rmtree(stage, ignore_errors=True)


#: Says why the pointer must not move, given the active version; None if it may.
Objection = Callable[[int | None], str | None]


def _point_to(store: Store, version: int, updated_at: int, objections: Iterable[Objection]) -> dict:
    """Moves the pointer to a version unless anything objects, or the pointer moves meanwhile."""
    check_epoch_millis(updated_at, "updated_at")
    raw = store.read(HEAD)
    current = None if raw is None else parse_head(raw)["version_id"]
    for objection in objections:
        if said := objection(current):
            raise OperationError(said, "publish_error")
    if not store.compare_and_swap(HEAD, store.etag(raw), head_json(version, updated_at)):
        raise OperationError(f"conflict: version {active_version(store)} became active meanwhile", "publish_error")
    return {"activated_version_id": version, "previous_version_id": current}


def _unless_active(expected: int | None, kind: str) -> Objection:
    return lambda current: None if current == expected else f"{kind} conflict: {current} is active, not {expected}"


def _stored(store: Store, version: int) -> IndexManifest | None:
    body = store.read(manifest_key(version))
    return None if body is None else IndexManifest.from_json(body.decode())


def publish(store: Store, manifest: IndexManifest, updated_at: int, expected: int | None = None) -> dict:
    """Makes a built version active, if it is newer than the active one and nobody was faster."""
    manifest.validate()

    def older(current: int | None) -> str | None:
        if manifest.version_id > (current or 0):
            return None
        return f"publish conflict: version {manifest.version_id} is not above the active {current}"

    def incomplete(_: int | None) -> str | None:
        for shard in manifest.shards:  # raises for what is missing or leads elsewhere
            for uri in (shard.table_path, shard.keyword_path):
                store.check_tree(store.resolve(uri))
        return None if _stored(store, manifest.version_id) == manifest else "the stored manifest is missing or differs"

    first = [] if expected is None else [_unless_active(expected, "publish")]
    return _point_to(store, manifest.version_id, updated_at, [*first, older, incomplete])


def rollback(store: Store, target: int, updated_at: int, expected: int | None) -> dict:
    """Makes an older version active; ``expected`` must be the active one (None: there is none)."""

    def absent(_: int | None) -> str | None:
        manifest = _stored(store, target)
        if manifest is None:
            return f"there is no manifest to roll back to: {manifest_key(target)}"
        manifest.validate()
        return None if manifest.version_id == target else "the target's manifest names another version"

    if target <= 0:
        raise invalid("version_id")
    return _point_to(store, target, updated_at, [_unless_active(expected, "rollback"), absent])


def require_embeddings(docs: DataFrame) -> DataFrame:
    if docs.where(F.col("embedding").isNull()).limit(1).count():
        raise required("embedding")
    return docs


def folder_of(store: Store, version: int) -> Path:
    return store.path(f"index/versions/{version}")
