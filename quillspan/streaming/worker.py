"""Builds and publishes index versions from the log: by jobs of a queue, or as a stream.

Every trigger rebuilds the whole snapshot from all segments, so replays and late
records are harmless; the stream has no watermark, since an old record may come
at any time and merely loses. Losing the race for the pointer is retried once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.model import OperationError
from quillspan.operators.snapshot import live_documents
from quillspan.sources import publish, wal
from quillspan.sources.store import Store
from quillspan.streaming.queue import JobQueue

Embed = Callable[[Column], Column]


def rebuild(spark: SparkSession, store: Store, embed: Embed, dim: int, trigger: str | None = None, clock: Callable[[], int] = wal.now_millis, keys: list[str] | None = None) -> dict:
    """The next version from all segments (or the ones named), made active."""
    log = wal.WriteLog(store, clock)
    for attempt in (1, 2):
        current = publish.active_version(store)
        version = (current or 0) + 1
        while store.path(f"index/versions/{version}").exists():  # built by someone else, or not active after a rollback
            version += 1
        manifest = publish.build(spark, store, version, keys or log.keys(trigger), embed, dim, clock)
        try:
            return publish.publish(store, manifest, clock(), current)
        except OperationError as error:
            if "conflict" not in str(error) or attempt == 2:
                raise
    raise AssertionError


def work_once(spark: SparkSession, store: Store, queue: JobQueue, embed: Embed, dim: int) -> list[str]:
    """Serves all ready jobs; a failed one goes back to the queue. Returns errors."""
    errors = []
    for job in queue.receive():
        try:
            rebuild(spark, store, embed, dim, json.loads(job.body)["wal_key"], queue.clock)
            queue.ack(job)
        except Exception as error:  # the queue decides about another attempt
            queue.nack(job, str(error))
            errors.append(str(error))
    return errors


def stream_builds(spark: SparkSession, store: Store, embed: Embed, dim: int, checkpoint: str, available_now: bool = True):
    """A query that rebuilds and publishes whenever segments have landed."""
    lines = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl").load(f"{store.root}/wal/*/*/*")

    def run(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            rebuild(spark, store, embed, dim)

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")).start()


def stream_snapshot(spark: SparkSession, log_dir: str, schema: str, checkpoint: str, target: str):
    """Last writes of a directory of JSON lines (with columns doc_id, timestamp, segment, event_id, op, document), kept as a table.

    Each micro-batch is reduced to its last writes, united with the table's and
    reduced again; deletions stay as rows so that older upserts that come later
    lose. The table is written anew and its path replaced in the pointer file.
    """
    from quillspan.operators.snapshot import last_writes

    store = Store(target)

    def run(batch: DataFrame, number: int) -> None:
        fresh = last_writes(batch)
        pointer = store.read("current")
        whole = fresh if pointer is None else last_writes(spark.read.parquet(pointer.decode()).unionByName(fresh))
        path = f"{store.root}/state-{number}"
        whole.write.mode("overwrite").parquet(path)
        store.overwrite("current", path.encode())

    return spark.readStream.schema(schema).json(log_dir).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_snapshot(spark: SparkSession, target: str) -> DataFrame:
    pointer = Store(target).read("current")
    if pointer is None:
        raise OperationError("nothing has been streamed yet", "execution_error")
    return live_documents(spark.read.parquet(pointer.decode()))


def fixed_embedding(values: list[float]) -> Embed:
    return lambda text: F.when(text.isNotNull(), F.array(*[F.lit(float(v)).cast("float") for v in values]))
