import json
import threading

import pytest
from pyspark.sql import functions as F

from quillspan import service
from quillspan.engine import HybridEngine
from quillspan.functions.embed import FixedEmbedder, HashingEmbedder
from quillspan.model import Document, OperationError, SearchRequest, ValidationError, WalRecord
from quillspan.operators.turbo import Codec
from quillspan.sources import publish, release, static, wal
from quillspan.sources.store import Store
from quillspan.streaming import worker
from quillspan.streaming.queue import BACKOFF_MS, LEASE_MS, JobQueue

T0 = 1_700_000_000_000
DOCS = [
    ("rust-hybrid", "rust hybrid retrieval with vectors", {"lang": "en", "tenant": "a"}),
    ("rust-keyword", "rust keyword retrieval only", {"lang": "en", "tenant": "b"}),
    ("vector-near", "dense neighbours of meaning", {"lang": "en", "tenant": "a"}),
    ("python-noise", "python garden snakes", {"lang": "en", "tenant": "a"}),
    ("tenant-a", "filtered by tenant", {"lang": "zh", "tenant": "a", "resource_id": "r1", "source_type": "page", "source_ref": "p1", "title": "A title"}),
    ("tenant-b", "filtered by tenant", {"lang": "zh", "tenant": "b", "n": 3}),
]


class Clock:
    def __init__(self):
        self.now = T0

    def __call__(self):
        self.now += 1000
        return self.now


@pytest.fixture
def engine(spark, tmp_path):
    return HybridEngine(spark, tmp_path / "store", HashingEmbedder(16), Clock(), warn=lambda m: None)


def documents():
    return [Document(i, t, m, T0 + 100 * n) for n, (i, t, m) in enumerate(DOCS)]


def test_write_build_query_delete_rollback(engine):
    assert engine.health() == (200, {"status": "ok", "index_version": None})
    engine.ingest(documents())
    assert engine.build() == {"activated_version_id": 1, "previous_version_id": None}
    found = engine.search(SearchRequest("rust retrieval", 1))
    assert found["dynamic_count"] == 3 and found["index_version"] == 1  # the window, not top_k
    assert {c["doc_id"] for c in found["dynamic_chunks"][:2]} == {"rust-hybrid", "rust-keyword"}
    assert all(c["source"] == "hybrid" and "citation" not in c for c in found["dynamic_chunks"][:2])
    both = engine.search(SearchRequest("filtered tenant", 6, {"lang": "zh", "tenant": "a"}, False))
    assert [(c["doc_id"], c["metadata"], c["citation"]["title"]) for c in both["dynamic_chunks"]] == [("tenant-a", None, "A title")]
    assert engine.search(SearchRequest("filtered tenant", 6, {"n": 3.0}))["dynamic_count"] == 1
    assert engine.search(SearchRequest("filtered tenant", 6, {"n": "3"}))["dynamic_count"] == 0
    engine.delete(["python-noise"])
    engine.ingest([Document("go", "golang concurrency", {}, T0)])
    assert engine.build()["activated_version_id"] == 2
    ids = {c["doc_id"] for c in engine.search(SearchRequest("golang python concurrency", 6))["dynamic_chunks"]}
    assert "go" in ids and "python-noise" not in ids
    assert [r.doc_id for r in engine.keyword_search("golang", 5).collect()] == ["go"]
    assert engine.rollback(1, 2)["activated_version_id"] == 1
    ids = {c["doc_id"] for c in engine.search(SearchRequest("golang python concurrency", 6))["dynamic_chunks"]}
    assert "go" not in ids and "python-noise" in ids
    with pytest.raises(OperationError, match="rollback conflict"):
        engine.rollback(2, 2)
    assert engine.build()["activated_version_id"] == 3
    with pytest.raises(OperationError, match="not above the active"):
        engine.build(3)
    assert engine.cache_stats()["hit_count"] > 0


def test_weights_change_nothing_but_the_prompt(engine):
    from quillspan.model import CorpusWeights

    engine.ingest(documents())
    engine.build()
    plain, heavy = SearchRequest("rust", 2), SearchRequest("rust", 2, None, True, CorpusWeights(1.0, 0.0))
    a, b = engine.search(plain), engine.search(heavy)
    a.pop("latency_ms"), b.pop("latency_ms")
    assert a == b and engine.context(plain)[0] != engine.context(heavy)[0]


def test_keywords_alone_when_embedding_fails(engine):
    engine.ingest(documents())
    engine.build()
    warned = []
    engine.warn = warned.append

    class Broken(HashingEmbedder):
        calls = 0

        def query(self, text):
            Broken.calls += 1
            raise RuntimeError("no model")

    engine.embedder = Broken(16)
    found = engine.search(SearchRequest("rust keyword", 2))
    assert [c["source"] for c in found["dynamic_chunks"]] == ["keyword"] * 2 and found["static_count"] == 0
    assert Broken.calls == 2 and len(warned) == 1 and found["dynamic_chunks"][0]["score"] > 0.1
    assert engine.health()[0] == 503


def test_log_wins_by_its_own_clock_and_later_rows(spark, tmp_path):
    store = Store(tmp_path)

    def line(event, doc, op, stamp, text=None):
        d = Document(doc, text, {"x": {"b": 1, "a": [1, 2]}}, T0) if op == "upsert" else None
        return WalRecord(event, doc, op, stamp, d).to_json() + "\n"

    store.create("wal/2023/11/14/b.jsonl", (line("e-000001", "a", "upsert", T0 + 5, "old") + line("e-000002", "a", "upsert", T0 + 5, "tie wins") + line("e-000003", "c", "delete", T0 + 9)).encode())
    store.create("wal/2023/11/14/a.jsonl", (line("z-000001", "a", "upsert", T0 + 1, "late") + line("z-000002", "c", "upsert", T0 + 8, "gone") + line("z-000003", "b", "upsert", T0 + 5, "tie")).encode())
    store.create("wal/2023/11/15/a.jsonl", line("a-000001", "b", "delete", T0 + 5).encode())
    keys = wal.WriteLog(store).keys("wal/2023/11/14/a.jsonl")
    assert keys == ["wal/2023/11/14/a.jsonl", "wal/2023/11/14/b.jsonl", "wal/2023/11/15/a.jsonl"]
    from quillspan.operators.snapshot import live_documents

    rows = live_documents(wal.read(spark, store, keys)).collect()
    assert [(r.doc_id, r.text) for r in rows] == [("a", "tie wins")]
    assert json.loads(rows[0].metadata) == {"x": {"a": [1, 2], "b": 1}}


@pytest.mark.parametrize("bad", ["", "{", '{"event_id":"e","doc_id":"a","op":"upsert","timestamp":1700000000000}', '{"event_id":"e","doc_id":"a","op":"delete","timestamp":5}'])
def test_bad_lines_fail_the_read(spark, tmp_path, bad):
    store = Store(tmp_path)
    store.create("wal/2023/11/14/a.jsonl", (WalRecord("e", "a", "delete", T0).to_json() + "\n" + bad + "\n").encode())
    with pytest.raises(Exception, match="segment|line|required|invalid"):
        wal.read(spark, store, ["wal/2023/11/14/a.jsonl"]).collect()
    with pytest.raises(OperationError, match="missing segment"):
        wal.read(spark, store, ["wal/2023/11/14/none.jsonl"])


def test_segment_keys():
    assert wal.segment_key(T0, "segment-000001") == "wal/2023/11/14/segment-000001.jsonl"
    assert wal.segment_key(1_709_164_800_000, "s") == "wal/2024/02/29/s.jsonl"


def test_store_keeps_to_its_root(tmp_path):
    store = Store(tmp_path / "s")
    (tmp_path / "out").mkdir()
    (store.root / "link").symlink_to(tmp_path / "out")
    for key in ("../x", "/x", "a/../../x", "link/x", "", "a//b", "."):
        with pytest.raises(OperationError):
            store.path(key)
    (store.root / "d").mkdir()
    (store.root / "d/l").symlink_to(tmp_path / "out")
    with pytest.raises(OperationError, match="outside"):
        store.check_tree(store.root / "d")
    store.create("k", b"1")
    with pytest.raises(OperationError, match="exists"):
        store.create("k", b"2")


def test_one_of_many_swaps_wins(tmp_path):
    store = Store(tmp_path)
    store.create("p", b"0")
    tag, won = store.etag(b"0"), []
    threads = [threading.Thread(target=lambda n=n: won.append(store.compare_and_swap("p", tag, str(n).encode()))) for n in range(1, 9)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 7 + [True]
    assert not store.compare_and_swap("q", tag, b"x") and store.compare_and_swap("q", None, b"x")


def test_locks_of_the_dead_expire(tmp_path):
    import os

    from quillspan.sources import store as module

    store = Store(tmp_path)
    lock = store.root / ".p.lock"
    lock.touch()
    os.utime(lock, (1, 1))
    assert store.compare_and_swap("p", None, b"x") and not lock.exists()
    assert [p.name for p in store.root.iterdir()] == ["p"] and module.LOCK_SECONDS > 10


def test_staged_commits_undo(tmp_path):
    store = Store(tmp_path)
    stage = store.staging()
    for n in "ab":
        (stage / n).write_text(n)
    store.create("there", b"")
    with pytest.raises(OperationError):
        store.commit_staged([(stage / "a", "x/a"), (stage / "b", "there")])
    assert (stage / "a").exists() and not store.path("x/a").exists()


def test_heads_are_checked(tmp_path):
    good = publish.head_json(3, T0)
    assert publish.parse_head(good)["version_id"] == 3
    for bad in (b"{", b"{}", good.replace(b": 3", b": 0"), good.replace(b"versions/3", b"versions/4"), good.replace(str(T0).encode(), b"7")):
        with pytest.raises((OperationError, ValidationError)):
            publish.parse_head(bad)


def test_static_release(spark, engine, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(["", *[json.dumps({"doc_id": f"s{i}", "text": f"static law {i}", "metadata": {"title": f"T{i}"}}) for i in range(6)], " "]))
    rows = static.read_sources(spark, [static.StaticSource(str(tmp_path / "s.jsonl"), "legal")]).drop("corpus_type")
    rows = rows.withColumn("embedding", engine.embedder.column(F.col("text")))
    source = release.ReleaseSource("table", "s.jsonl", 1, 6, "legal")
    a = engine.static_build(rows, Codec.generate(16), "hashing", source, "static/one")
    b = engine.static_build(rows, Codec.generate(16), "hashing", source, "static/two")
    assert a == b and len(a["release_id"]) == 64
    engine.ingest(documents())
    engine.build()
    assert engine.search(SearchRequest("law", 2))["static_count"] == 0
    assert engine.static_activate("static/one", "hashing", 16)
    found = engine.search(SearchRequest("law", 1))
    assert found["static_count"] == 3 and found["static_release_id"] == a["release_id"]
    chunk = found["static_chunks"][0]
    assert chunk["corpus_type"] == "legal" and chunk["citation"]["source_type"] == "法规" and chunk["citation"]["resource_id"] == chunk["doc_id"]
    prompt, text = engine.context(SearchRequest("law", 1), 40)
    assert text.startswith("=== 参考资料 ===") and text.endswith("law")
    folder = engine.store.path("static/two")
    part = next((folder / "records.parquet").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(OperationError, match="bytes, not"):
        release.verify(spark, folder)
    m = json.loads((engine.store.path("static/one") / release.MANIFEST).read_text())
    m["outputs"].reverse()
    (engine.store.path("static/one") / release.MANIFEST).write_text(json.dumps(m))
    with pytest.raises(OperationError, match="order of names"):
        release.verify(spark, engine.store.path("static/one"))
    engine.store.overwrite(release.HEAD, b"{}")
    with pytest.raises(OperationError, match="corrupt"):
        engine.search(SearchRequest("law", 1))


def test_static_build_refuses(spark, engine):
    source = release.ReleaseSource("table", "x", 1, 2, "rfc")
    twice = spark.createDataFrame([("a", "t", "{}", [1.0, 0.0])] * 2, "doc_id string, text string, metadata string, embedding array<float>")
    with pytest.raises(OperationError, match="duplicate"):
        engine.static_build(twice, Codec.generate(2), "m", source, "static/x")
    with pytest.raises(OperationError, match="dimensions"):
        engine.static_build(twice, Codec.generate(3), "m", source, "static/x")


def test_queue_leases_retries_and_dead_letters(tmp_path):
    clock = Clock()
    q = JobQueue(tmp_path / "q.db", clock)
    q.enqueue("b1", "one")
    (job,) = q.receive()
    assert q.receive() == []
    clock.now += LEASE_MS
    (again,) = q.receive()
    q.ack(job)  # late: a no-op
    q.nack(again, "first")
    clock.now += 2 * BACKOFF_MS
    (job,) = q.receive()
    q.nack(job, "second")
    assert q.receive() == []  # it backs off longer
    clock.now += 3 * BACKOFF_MS
    (job,) = q.receive()
    q.nack(job, "third")
    clock.now += 10 * BACKOFF_MS
    assert q.receive() == [] and q.dead() == [("b1", 3, "third")]


def test_worker_serves_jobs(spark, engine, tmp_path):
    q = JobQueue(tmp_path / "q.db", engine.clock)
    done = engine.ingest(documents())
    q.enqueue(done["batch_id"], json.dumps({"wal_key": done["wal_key"]}))
    q.enqueue("bad", json.dumps({"wal_key": "wal/2020/01/01/none.jsonl"}))
    errors = worker.work_once(spark, engine.store, q, engine.embedder.column, 16)
    assert len(errors) == 1 and "missing segment" in errors[0]
    assert publish.active_version(engine.store) == 1


def test_stream_builds_when_segments_land(spark, engine, tmp_path):
    engine.ingest(documents()[:2])

    def run():
        q = worker.stream_builds(spark, engine.store, engine.embedder.column, 16, str(tmp_path / "cp"))
        q.awaitTermination(120)

    run()
    assert publish.active_version(engine.store) == 1
    run()  # nothing new
    assert publish.active_version(engine.store) == 1
    engine.ingest(documents()[2:])
    engine.delete(["rust-hybrid"])
    run()
    assert publish.load_active(engine.store)[1].document_count == 5


def test_streamed_snapshot_takes_late_records(spark, tmp_path):
    schema = "doc_id string, timestamp long, segment string, event_id string, op string, document struct<doc_id: string, text: string>"
    log = tmp_path / "log"
    log.mkdir()

    def land(name, *records):
        (log / name).write_text("\n".join(json.dumps(dict(zip(("doc_id", "timestamp", "op", "document"), r)) | {"segment": name, "event_id": f"{i:06d}"}) for i, r in enumerate(records)))
        worker.stream_snapshot(spark, str(log), schema, str(tmp_path / "cp"), str(tmp_path / "t")).awaitTermination(120)
        return {r.doc_id: r.text for r in worker.read_snapshot(spark, str(tmp_path / "t")).collect()}

    d = lambda i, t: {"doc_id": i, "text": t}
    assert land("1.jsonl", ("a", 5, "upsert", d("a", "v5")), ("b", 5, "upsert", d("b", "v5"))) == {"a": "v5", "b": "v5"}
    assert land("2.jsonl", ("a", 3, "upsert", d("a", "late")), ("b", 9, "delete", None)) == {"a": "v5"}
    assert land("3.jsonl", ("b", 7, "upsert", d("b", "late")), ("a", 6, "upsert", d("a", "v6"))) == {"a": "v6"}


def test_writes_ask_for_builds_and_failed_ones_leave_nothing(spark, engine, tmp_path):
    engine.queue = JobQueue(tmp_path / "q.db", engine.clock)
    engine.ingest(documents())
    engine.delete(["python-noise"])
    assert worker.work_once(spark, engine.store, engine.queue, engine.embedder.column, 16) == []
    assert publish.load_active(engine.store)[1].document_count == 5 and engine.queue.receive() == []

    def broken():
        raise RuntimeError("before the commit")

    with pytest.raises(RuntimeError):
        publish.build(spark, engine.store, 9, engine.log.keys(), engine.embedder.column, 16, engine.clock, broken)
    assert not [p for p in engine.store.root.iterdir() if p.name.startswith(".staging")]


def test_several_shards(engine):
    engine.ingest(documents())
    engine.build(shards=3)
    manifest = publish.load_active(engine.store)[1]
    assert manifest.num_shards == 3 and manifest.document_count == 6
    found = engine.vector_search(engine.embedder.query("rust retrieval"), 6).collect()
    assert len(found) == 6 and found[0].doc_id.startswith("rust")
    with pytest.raises(OperationError, match="exactly one shard"):
        engine.keyword_search("rust", 2)


def test_all_that_is_wrong_is_told(spark, engine):
    rows = engine.spark.createDataFrame([("a", "t", "{}", [1.0, 0.0])], "doc_id string, text string, metadata string, embedding array<float>")
    m = engine.static_build(rows, Codec.generate(2), "m", release.ReleaseSource("table", "x", 1, 1, "rfc"), "static/x")
    folder = engine.store.path("static/x")
    assert release.verify(spark, folder, "m", 2) == m
    bad = json.loads(json.dumps(m))
    bad["source"] |= {"kind": "other", "table_row_count": 5}
    bad["turbo_version"] = 9
    del bad["codec"]["dim"]
    (folder / release.MANIFEST).write_text(json.dumps(bad))
    (folder / "centroids.bin").write_bytes(b"short")
    with pytest.raises(OperationError) as error:
        release.verify(spark, folder, "other")
    for said in ("source.kind is 'other'", "turbo_version is 9", "'m', not 'other'", "the id", "the table's rows 5", "centroids.bin has 5 bytes"):
        assert said in str(error.value), said


def test_http_contract(engine):
    post = lambda path, body: service.handle(engine, "POST", path, body if isinstance(body, bytes) else json.dumps(body).encode())
    ok = {"query": "rust", "top_k": 2, "include_metadata": True}
    for bad in ({**ok, "query": ""}, {**ok, "query": "x" * 1001}, {**ok, "top_k": 0}, {**ok, "top_k": 101}, {**ok, "filters": {"bad field!": 1}}, {**ok, "corpus_weights": {"static_bias": 1.5, "dynamic_bias": 0}}, {"query": "x", "top_k": 1}):
        status, out = post("/query", bad)
        assert (status, out["error_type"]) == (400, "validation_error"), bad
    assert post("/query", b"{")[0] == 400
    assert post("/query", ok)[1]["error_type"] == "execution_error"  # no index yet
    assert post("/write", {"operation": "ingest", "documents": []})[0] == 400
    assert post("/write", {"operation": "ingest", "documents": [{"doc_id": "a", "text": "t"}]})[0] == 400
    assert post("/write", {"operation": "delete", "doc_ids": []})[0] == 400
    assert post("/build", {"version_id": "x"})[0] == 400
    assert post("/build", {"version_id": 1, "wal_key": "wal/2020/01/01/x.jsonl"})[1]["error_type"] == "build_error"
    wrote = post("/write", {"operation": "ingest", "documents": [{"doc_id": i, "text": t, "metadata": m, "timestamp": T0} for i, t, m in DOCS]})
    assert wrote[0] == 200 and wrote[1]["accepted_count"] == 6 and wrote[1]["wal_event_ids"][5].endswith("-000006")
    assert post("/build", {"version_id": 4})[1] == {"activated_version_id": 4, "previous_version_id": None}
    status, out = post("/query", {**ok, "filters": {"tenant": "a"}})
    assert status == 200 and {c["metadata"]["tenant"] for c in out["dynamic_chunks"]} == {"a"}
    assert post("/nowhere", {})[0] == 404
    event = {"rawPath": "/query", "body": "@@", "isBase64Encoded": True}
    assert service.handle_event(engine, event)["statusCode"] == 400
    assert service.handle_event(engine, {"rawPath": "/query", "body": json.dumps(ok)})["statusCode"] == 200


def test_dimension_must_fit(engine):
    engine.ingest([Document("a", "t", {}, T0, [1.0, 2.0])])
    with pytest.raises(ValidationError, match="embedding"):
        engine.build()
    engine.embedder = FixedEmbedder([1.0] * 16)
    with pytest.raises(ValidationError, match="query_embedding"):
        engine.embedder.dim = 3
        engine.ingest(documents())
        engine.vector_search([1.0], 2)


def test_direct_searches_and_batches(engine):
    wrote = engine.ingest(documents())
    event = {"Records": [{"messageId": "m1", "body": json.dumps({"wal_key": wrote["wal_key"]})}, {"messageId": "m2", "body": "{"}, {"messageId": "m3"}]}
    warned = []
    assert service.handle_batch(engine, event, warned.append) == {"batchItemFailures": [{"itemIdentifier": "m2"}, {"itemIdentifier": "m3"}]}
    assert len(warned) == 2 and publish.active_version(engine.store) == 1
    bare = SearchRequest("rust", 2, None, False)
    assert {r.doc_id for r in engine.search_keywords_only(bare).collect()} == {"rust-hybrid", "rust-keyword"}
    assert engine.search_vectors_only(bare, engine.embedder.query("rust")).count() == 2
    for request, words in ((SearchRequest("rust", 2, {}, False), "filters are unsupported for keyword search"), (SearchRequest("rust", 2), "include_metadata is unsupported for keyword search")):
        with pytest.raises(OperationError, match=words):
            engine.search_keywords_only(request)


def test_release_of_a_version(engine):
    engine.ingest(documents())
    engine.build()
    made = engine.static_build_version(1, Codec.generate(16), "hashing", "rfc", "static/v1")
    assert made["source"]["table_version"] == 1 and made["input_fingerprint"]["doc_count"] == 6
    assert engine.static_activate("static/v1")
    assert engine.search(SearchRequest("rust", 2))["static_chunks"][0]["corpus_type"] == "rfc"
    with pytest.raises(OperationError, match="missing"):
        engine.static_build_version(9, Codec.generate(16), "hashing", "rfc", "static/v9")
