import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import arrays, hashing, text
from quillspan.model import CorpusWeights, Document, IndexManifest, SearchRequest, Shard, ValidationError, window, windows
from quillspan.operators import context, filters, hybrid, keyword, rank, turbo, validate, vector
from quillspan.plans import catalogue
from quillspan.sources import publish


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pairs(df):
    return [tuple(r) for r in df.collect()]


# --- vector ---

V = "doc_id string, embedding array<float>"


def test_vector_goldens(spark):
    five = frame(spark, [("1", [1.0, 0.0, 0.0]), ("2", [0.8, 0.6, 0.0]), ("3", [0.0, 1.0, 0.0]), ("4", [0.0, 0.0, 1.0]), ("5", [0.5, 0.5, 0.0])], V)
    assert [(i, round(s, 6)) for i, s in pairs(vector.search(five, [1, 0, 0], 3).orderBy(*rank.by_score()))] == [("1", 1.0), ("2", 0.8), ("5", 0.5)]
    shard = F.col("doc_id").cast("int") % 2
    assert [i for i, _ in pairs(vector.search_shards(five, shard, [1, 0, 0], 3))] == ["1", "2", "5"]
    ties = frame(spark, [(i, [x, 0.0, 0.0]) for i, x in (("z", 1.0), ("a", 1.0), ("b", 1.0), ("z", 0.4), ("c", 0.2))], V)
    assert [i for i, _ in pairs(vector.search(ties, [1, 0, 0], 5).orderBy(*rank.by_score()))] == ["a", "b", "z", "c"]


def test_clamped_scores_tie_by_text_id(spark):
    df = frame(spark, [("10", [-1.0]), ("9", [-0.5]), ("2", [0.5]), ("n", None)], V)
    assert pairs(vector.search(df, [1.0], 3).orderBy(*rank.by_score())) == [("2", 0.5), ("10", 0.0), ("9", 0.0)]


def test_bad_vectors(spark):
    df = frame(spark, [("1", [float("nan")])], V)
    with pytest.raises(Exception, match="invalid value"):
        vector.search(df, [1.0], 1).collect()
    for q in ([], [float("inf")]):
        with pytest.raises(ValidationError):
            vector.search(df, q, 1)
    with pytest.raises(ValidationError):
        vector.search_batch(df, {}, 1)


def test_long_vectors_take_the_folded_form(spark):
    x = np.random.default_rng(1).normal(size=200)
    df = frame(spark, [("1", [float(v) for v in x])], V)
    got = df.select(arrays.dot(F.col("embedding"), x.tolist())).first()[0]
    assert abs(got - float(np.dot(x.astype(np.float32).astype(float), x))) < 1e-9


def test_batch_search_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 4)).round(1).astype(np.float32)
    df = frame(spark, [(str(i), r.tolist()) for i, r in enumerate(x)], V).repartition(3)
    found = vector.search_batch(df, {str(i): x[i].tolist() for i in range(vector.MAX_BATCH + 3)}, 3).collect()
    assert len(found) == 3 * (vector.MAX_BATCH + 3)
    dots = (x.astype(float) @ x.astype(float).T).round(9)
    for q in (0, 7, vector.MAX_BATCH, vector.MAX_BATCH + 2):
        best = sorted(range(len(x)), key=lambda d: (-dots[q, d], str(d)))[:3]
        assert {r.doc_id for r in found if r.query_id == str(q)} == {str(d) for d in best}


def test_batches_refuse_what_single_searches_refuse(spark):
    df = frame(spark, [("1", [1.0, 0.0]), ("2", [float("nan"), 1.0])], V)
    with pytest.raises(Exception, match="distance has an invalid value"):
        vector.search_batch(df, {"q": [1.0, 1.0]}, 2).collect()
    for bad in ({"q": [1.0, 1.0], "r": [1.0]}, {"q": [float("inf"), 1.0]}, {}):
        with pytest.raises(ValidationError):
            vector.search_batch(df, bad, 2)


def test_digest_of_contents_needs_no_order(spark):
    from quillspan.functions import hashing

    rows = [(str(i), f"t{i}") for i in range(300)]
    digests = set()
    for parts, own in ((1, rows), (7, rows[::-1]), (3, rows[50:] + rows[:50])):
        h = frame(spark, own, "a string, b string").repartition(parts).select(hashing.row_hash(F.col("a"), F.col("b")).alias("h"))
        digests.add(tuple(hashing.content_digest(h).first()))
    assert len(digests) == 1 and digests.pop()[0] == 300
    pairs_ = frame(spark, [("ab", "c"), ("a", "bc"), ("a", None), ("a", "")], "a string, b string").select(hashing.row_hash(F.col("a"), F.col("b"))).collect()
    assert len({r[0] for r in pairs_}) == 3


def test_batch_queries_grow_with_the_table(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0]) for i in range(2001)]
    frame(spark, rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = catalogue.queries()["vector_batch_topk_hundredths"](spark, str(tmp_path))
    assert {r.query_id for r in found.collect()} == {str(i) for i in range(0, 2001, 100)}


# --- keyword ---

D = "doc_id string, text string"


def test_keyword_goldens(spark):
    three = frame(spark, [("doc-1", "rust keyword search in a somewhat longer text about engines"), ("doc-2", "rust keyword search"), ("doc-3", "cooking pasta")], D)
    assert [i for i, _ in pairs(keyword.search_texts(three, "rust keyword search", 2))] == ["doc-2", "doc-1"]
    assert [i for i, _ in pairs(keyword.search_index(keyword.build_index(three), "rust keyword search", 2))] == ["doc-2", "doc-1"]
    twice = frame(spark, [("doc-1", "rust rust rust rust"), ("doc-1", "rust rust rust"), ("doc-2", "rust and more")], D)
    assert [i for i, _ in pairs(keyword.search_texts(twice, "rust", 2))] == ["doc-1", "doc-2"]


def test_written_words_answer_as_texts_do(spark, tmp_path):
    rng = random.Random(5)
    rows = [(str(i), " ".join(rng.choices(["hot", "w1", "w2", "w3", "Rare-x", "é"], k=rng.randrange(9)))) for i in range(300)]
    docs = frame(spark, [*rows, ("n", None), ("e", ""), ("l", "hot " + "a" * 50)], D)
    publish.write_words(docs, tmp_path / "words")
    index = publish.read_words(spark, str(tmp_path / "words"))
    for query in ("hot", "w1 rare é", "w2 w3 hot x", "absent"):
        written = pairs(keyword.search_index(index, query, 400).select("doc_id", F.round("score", 9)))
        assert written == pairs(keyword.search_texts(docs, query, 400).select("doc_id", F.round("score", 9)))
    lengths = [len([t for t in re.split(r"[^\w]+", x.lower()) if t and len(t) < 40]) for _, x in docs.fillna("").collect()]
    assert pairs(index.stats) == [(303, pytest.approx(sum(lengths) / 303))]
    # Equal texts tie, whichever order their postings are added in, so ids decide.
    alike = keyword.build_index(frame(spark, [(str(i), "w1 w2 w3 é hot") for i in range(9)], D))
    found = pairs(keyword.search_index(alike, "hot é w3 w1 w2", 9))
    assert [i for i, _ in found] == [str(i) for i in range(9)] and len({score for _, score in found}) == 1


def test_words_of_no_documents(spark, tmp_path):
    for rows in ([], [("a", None), ("b", "")]):
        folder = tmp_path / str(len(rows))
        publish.write_words(frame(spark, rows, D), folder)
        index = publish.read_words(spark, folder)
        assert pairs(index.stats) == [(len(rows), 0.0 if rows else None)]
        assert not pairs(keyword.search_index(index, "any", 5)) and not pairs(keyword.search_texts(frame(spark, rows, D), "any", 5))


def test_a_term_of_all_documents_fills_several_files(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").cast("string").alias("doc_id"), F.lit("hot").alias("text"))
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}  # so small a table would be put in one file
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        publish.write_words(docs, tmp_path / "words")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    postings = publish.read_words(spark, tmp_path / "words").postings
    assert postings.count() == 4000 and postings.select(F.input_file_name()).distinct().count() > 1


def test_texts_are_read_once(spark, tmp_path):
    frame(spark, [(str(i), f"hot w{i}") for i in range(50)], D).write.parquet(str(tmp_path / "docs"))
    found = keyword.search_texts(spark.read.parquet(str(tmp_path / "docs")), "hot w1", 5)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange [doc_id" in final


def test_phrases_and_bad_queries(spark):
    df = frame(spark, [("1", "quick brown fox"), ("2", "brown quick fox"), ("3", None), ("4", "")], D)
    assert [i for i, _ in pairs(keyword.search_texts(df, '"quick brown" fox', 9))] == ["1", "2"]  # any clause; the phrase adds its score
    assert [i for i, _ in pairs(keyword.search_texts(df, '"quick brown"', 9))] == ["1"]
    assert [i for i, _ in pairs(keyword.search_texts(df, '+"quick brown" text:fox', 9))] == ["1"]
    assert [i for i, _ in pairs(keyword.search_texts(df, "fox AND nothing", 9))] == []
    assert [i for i, _ in pairs(keyword.search_texts(df, 'fox NOT "brown quick"', 9))] == ["1"]
    assert [i for i, _ in pairs(keyword.search_texts(df, '-"brown quick" brown OR nothing', 9))] == ["1"]
    assert pairs(keyword.search_texts(df, "-fox", 9)) == []
    fruit = frame(spark, [("1", "foo only here"), ("2", "apple pie and foo"), ("3", "pie apple")], D)
    assert [i for i, _ in pairs(keyword.search_texts(fruit, 'foo "apple pie"', 9))] == ["2", "1"]
    for bad in ("title:fox", "fox AND", "NOT", "fox - brown"):
        with pytest.raises(ValidationError):
            keyword.parse(bad)
    assert pairs(keyword.search_texts(df, "!!", 9)) == []
    with pytest.raises(ValidationError):
        keyword.parse('"open')


# --- fusion ---


def test_rrf_goldens(spark):
    v = frame(spark, [("1", 0.9), ("2", 0.8)], "doc_id string, score double")
    k = frame(spark, [("2", 9.0), ("3", 5.0)], "doc_id string, score double")
    fused = rank.fuse(v, k).orderBy(*rank.by_score()).collect()
    assert [r.doc_id for r in fused] == ["2", "1", "3"]
    assert fused[0].score == float(np.float32(np.float32(1 / 62) + np.float32(1 / 61)))


def test_metadata_merge(spark):
    df = frame(spark, [('{"a":1,"b":{"z":1,"y":"q\\"x"}}', '{"a":2,"c":[1,true,null]}'), (None, "{}"), (None, None), ("[1]", '{"k":"v"}')], "v string, k string")
    merged = rank.entries_json(rank.merge_metadata(rank.object_entries(F.col("v")), rank.object_entries(F.col("k"))))
    assert [r[0] for r in df.select(merged).collect()] == ['{"a":1,"b":{"y":"q\\"x","z":1},"c":[1,true,null]}', "{}", None, '{"k":"v"}']


def test_windows():
    assert [window(k) for k in (0, 1, 2, 33, 34, 100)] == [3, 3, 6, 99, 100, 100]
    assert windows(2)[:2] == [6, 12] and windows(100) == [100] and len(windows(1)) == 8


def loop_model(vec, words, top_k, passes):
    """The widening search as a loop over plain lists; (score desc, id) everywhere."""
    k = max(top_k, 1)
    while True:
        w = window(k)
        v = sorted(((max(0.0, min(1.0, s)), d) for s, d in vec[:w]), key=lambda x: (-x[0], x[1]))
        scores = {}
        for ranked in (v, words[:w]):
            for n, (_, d) in enumerate(ranked, 1):
                scores[d] = np.float32(scores.get(d, np.float32(0)) + np.float32(1.0 / (60 + n)))
        out = [d for d in sorted(scores, key=lambda d: (-scores[d], d)) if d in passes]
        if len(out) >= top_k or k >= 100:
            return out[: window(top_k)]
        k = min(2 * k, 100)


@pytest.mark.parametrize("seed", range(6))
def test_widening_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    n, top_k = rng.choice([8, 60, 150]), rng.choice([1, 2, 5])
    vectors = {str(i): rng.choice([-0.5, 0.25, rng.random()]) for i in range(n)}
    lists = {str(i): float(rng.randint(1, 9)) for i in range(0, n, 2)}
    passing = {d for d in vectors if rng.random() < rng.choice([0.03, 0.3])}
    docs = frame(spark, [(d, "t", '{"ok":%s}' % ("true" if d in passing else "false")) for d in vectors], "doc_id string, text string, metadata string")
    emb = frame(spark, [(d, [float(x)]) for d, x in vectors.items()], V)
    kws = frame(spark, list(lists.items()), "doc_id string, score double")
    found = hybrid.search(docs, emb, SearchRequest("q", top_k, {"ok": True}), [1.0], None, kws).dynamic
    f32 = {d: float(np.float32(x)) for d, x in vectors.items()}
    vec = sorted(((s, d) for d, s in f32.items()), key=lambda x: (-x[0], x[1]))
    words = sorted(((s, d) for d, s in lists.items()), key=lambda x: (-x[0], x[1]))
    assert [r.doc_id for r in found.collect()] == loop_model(vec, words, top_k, passing)


def test_empty_metadata_by_path(spark):
    docs = frame(spark, [("1", "alpha", "{}"), ("2", "beta", "{}")], "doc_id string, text string, metadata string")
    emb = frame(spark, [("1", [1.0]), ("2", [0.5])], V)
    rows = {r.doc_id: r.metadata for r in hybrid.search(docs, emb, SearchRequest("alpha", 1), [1.0]).dynamic.collect()}
    assert rows == {"1": "{}", "2": None}


# --- filters, citations, validation ---


def test_filters_are_typed(spark):
    rows = ['{"k":"1","n":1,"b":true,"f":1.5}', '{"k":1,"n":1.0,"b":"true"}', "{}", None, "[1]", "{", '{"n":1e0,"k":null}']
    df = frame(spark, [(i, m) for i, m in enumerate(rows)], "i int, metadata string")
    kept = lambda f: [r.i for r in filters.apply_filters(df, f).orderBy("i").collect()]
    assert kept({"k": "1"}) == [0] and kept({"k": 1}) == [1] and kept({"n": 1}) == [0, 1, 6] and kept({"b": True}) == [0]
    assert kept({"n": 1, "f": 1.5}) == [0] and kept({"missing": "x"}) == [] and kept({}) == kept(None) == list(range(7))


def test_citations(spark):
    rows = ['{"resource_id":"r","source_type":"s","source_ref":"f","title":5,"url":"u"}', '{"resource_id":"r","source_type":"s","source_ref":1,"title":"t"}', '{"title":""}', None]
    df = frame(spark, [(m,) for m in rows], "m string")
    got = [r[0] for r in df.select(text.citation(F.col("m"))).collect()]
    assert got[0].asDict() == {"resource_id": "r", "source_type": "s", "source_ref": "f", "title": None, "url": "u"} and got[1:] == [None] * 3
    fall = [r[0] for r in df.select(text.static_citation(F.col("m"), F.lit("d"), F.lit("contract"))).collect()]
    assert fall[0].resource_id == "r" and fall[1].asDict() == {"resource_id": "d", "source_type": "合同", "source_ref": "d", "title": "t", "url": None} and fall[2:] == [None, None]


def test_document_rules_agree_in_both_forms(spark):
    good = {"doc_id": "d", "text": "t", "embedding": [1.0], "metadata": {}, "timestamp": 10**12}
    cases = [{}, {"doc_id": ""}, {"doc_id": "é" * 129}, {"text": ""}, {"text": "é" * 50_001}, {"embedding": [float("nan")]}, {"metadata": {"k": "v" * 10_000}}, {"timestamp": 10**12 - 1}, {"embedding": None}]
    rows, expected = [], []
    import json

    for case in cases:
        raw = good | case
        try:
            Document(**raw).validate()
            expected.append(None)
        except ValidationError as e:
            expected.append(str(e))
        rows.append((raw["doc_id"], raw["text"], raw["embedding"], json.dumps(raw["metadata"], separators=(",", ":")), raw["timestamp"]))
    df = frame(spark, rows, "doc_id string, text string, embedding array<float>, metadata string, timestamp long")
    error = validate.document_error(*[F.col(c) for c in df.columns])
    assert [r[0] for r in df.select(error).collect()] == expected


def test_request_rules():
    SearchRequest("é" * 1000, 100, {"_a1": "x", "n": 2.5, "b": False}).validate()
    for bad in (SearchRequest("", 1), SearchRequest("q", 1, {"1a": "x"}), SearchRequest("q", 1, {"a": ""}), SearchRequest("q", 1, {"a": float("nan")}), SearchRequest("q", 1, {"": "x"}), SearchRequest("q", 1, None, True, CorpusWeights(0.5, -0.1))):
        with pytest.raises(ValidationError):
            bad.validate()


def test_manifest_rules():
    ok = IndexManifest(1, 10**12, 3, 5, 1, [Shard(0, 5, "s3://b/l", "s3://b/t")])
    ok.validate()
    assert IndexManifest.from_json(ok.to_json()) == ok
    for change in ({"embedding_dim": 0}, {"document_count": 4}, {"num_shards": 2}, {"created_at": 5}, {"shards": [Shard(0, 5, "file:///x", "s3://b/t")]}):
        with pytest.raises(ValidationError):
            IndexManifest(**{**ok.__dict__, **change}).validate()


# --- codec ---

TABLE = np.array([[-1, 0, 1, 2], [-2, -1, 0, 1], [0, 1, 2, 3], [-1, 0, 1, 3]], np.float32)


def test_codec_goldens(spark):
    codec = turbo.Codec(TABLE)
    idx, qjl, gamma = codec.encode(np.array([[1.2, -1.4, 0.3, 0.9]]))
    assert (idx[0, 0], qjl[0, 0]) == (0x86, 0x05) and abs(gamma[0] - 0.5477226) < 1e-6
    df = turbo.encode_table(frame(spark, [("10", [1.2, -1.4, 0.3, 0.9]), ("x", None)], V), codec)
    row = turbo.score_encoded(df, codec, [2, -1, 0.5, 3]).collect()
    assert len(row) == 1 and abs(row[0].score - 6.2738614) < 1e-5 and abs(row[0].centroid_term - 6.0) < 1e-6 and abs(row[0].qjl_term - 0.5) < 1e-6
    p = turbo.Codec(TABLE[:3], np.array([[1, 2, 3], [-1, 0.5, 4], [0, 0, 1]], np.float32))
    assert p.project(np.array([2, -1, 0.5]))[:2].tolist() == [1.5, -0.5]


def test_static_ties_go_to_the_lower_hash(spark):
    codec = turbo.Codec.uniform(2, (-1, 0, 0.5, 1))
    df = turbo.encode_table(frame(spark, [(i, [0.5, 1.0]) for i in ("20", "10", "3")], V), codec)
    got = [i for i, _ in pairs(turbo.search(df, codec, [1, 1], 3))]
    assert got == sorted(("20", "10", "3"), key=lambda i: hashing.fnv1a_bytes(i.encode()))


def test_codec_assets(spark):
    codec = turbo.Codec.generate(8)
    again = turbo.Codec.from_bytes(*codec.to_bytes())
    assert np.array_equal(again.centroids, codec.centroids) and np.array_equal(again.projection, codec.projection)
    assert np.array_equal(turbo.Codec.generate(8).projection, codec.projection)
    for bad in (b"", codec.to_bytes()[0][:-1], b"\0" * 12):
        with pytest.raises(ValidationError):
            turbo.Codec.from_bytes(bad, codec.to_bytes()[1])
    with pytest.raises(ValidationError):
        codec.encode(np.zeros((1, 7)))


def test_native_and_packed_codecs_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(str(i), [float(x) for x in rng.normal(size=12) * 0.2]) for i in range(40)]
    df, q = frame(spark, rows, V), [float(x) for x in rng.normal(size=12)]
    codec = turbo.Codec.uniform(12, catalogue.CODES)
    packed = {r.doc_id: (r.centroid_term, r.qjl_term) for r in turbo.score_encoded(turbo.encode_table(df, codec), codec, q).collect()}
    a, b = turbo.native_terms(turbo.native_code(F.col("embedding"), catalogue.CODES), q)
    for i, x, y in pairs(df.select("doc_id", a, b)):
        assert np.allclose((x, y), packed[i], atol=1e-5)


# --- hashes, contexts ---


def test_fnv(spark):
    words = ["", "a", "foobar", "Ünï合🎈", "x" * 300, None]
    df = frame(spark, [(w,) for w in words], "w string")
    got = [None if r[0] is None else int(r[0]) for r in df.select(hashing.fnv1a(F.col("w"))).collect()]
    assert got == [None if w is None else hashing.fnv1a_bytes(w.encode()) for w in words]
    assert hashing.fnv1a_bytes(b"foobar") == 0x85944171F73967E8


def test_token_estimates(spark):
    cases = {"你好世界": 4, "hello world": 3, "合同termination条款": 7, "\U00020000\U00020001\U0002a6d0\U00030000": 4, "": 0}
    df = frame(spark, [(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(text.token_estimate(F.col("t"))).collect()] == list(cases.values())
    assert [context.estimate_tokens(t) for t in cases] == list(cases.values())


def test_contexts():
    s = [{"text": "law", "corpus_type": "legal", "citation": {"title": "T"}}, {"text": "x", "corpus_type": None}]
    d = [{"text": "mine", "citation": None}]
    assert context.build(s, d, "q?") == "=== 参考资料 ===\n\n[法规 #1] T\nlaw\n\n[法规/合同 #2]\nx\n\n[用户数据 #1]\nmine\n\n=== 问题 ===\nq?"
    big = [{"text": "法" * 300, "corpus_type": "legal"} for _ in range(45)]
    mine = [{"text": "法" * 300} for _ in range(45)]
    whole, cut = context.build(big, mine, "q"), context.build_bounded(big, mine, "q", 9000)
    assert 27_000 <= context.estimate_tokens(whole) <= 28_500 and context.estimate_tokens(cut) <= 9000
    assert abs(cut.count("[法规") - cut.count("[用户")) <= 1
    assert context.build_bounded(big, mine, "q", 0) == context.build([], [], "q")
    same = [{"text": "abcd"}]
    fixed = context.estimate_tokens(context.build([], [], "q"))
    one = context.estimate_tokens(context.blocks([], same)[1][0])
    assert "用户数据" not in context.build_bounded([{"text": "abcd", "corpus_type": "rfc"}] , same, "q", fixed + one)
    for w, sentence in ((None, context.BALANCED), (CorpusWeights(0.8, 0.9), context.STATIC_FIRST), (CorpusWeights(0.7, 0.9), context.DYNAMIC_FIRST)):
        assert sentence in context.system_prompt(w)


# --- the catalogue against its SQL ---

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_codec_batch_equals_single_searches(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[30:40] = x[0]  # ties
    df = frame(spark, [(str(i), r.tolist()) for i, r in enumerate(x)], V)
    for codec in (turbo.Codec.generate(8), turbo.Codec.uniform(8, catalogue.CODES)):
        encoded = turbo.encode_table(df, codec)
        got = turbo.search_batch(encoded, codec, {str(i): x[i].tolist() for i in (0, 7)}, 6).collect()
        for i in (0, 7):
            one = {d: round(s, 6) for d, s in pairs(turbo.search(encoded, codec, x[i].tolist(), 6))}
            assert {r.doc_id: round(r.score, 6) for r in got if r.query_id == str(i)} == one


def test_recall_has_each_query_with_mean_and_least(spark):
    lists = "query_id string, doc_id string"
    exact = frame(spark, [("a", "1"), ("a", "2"), ("b", "1"), ("b", "3")], lists)
    near = frame(spark, [("a", "2"), ("a", "1"), ("b", "4"), ("b", "5")], lists)
    assert sorted(pairs(turbo.recall(near, exact, 2))) == [("a", 2, 1.0, 0.5, 0.0), ("b", 0, 0.0, 0.5, 0.0)]
    found = catalogue.queries()["turbo_recall_hundredths"](spark, DATA).collect()
    assert len(found) == 5 and len({r.mean_recall for r in found}) == 1


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    if name in catalogue.oracle_sql():
        found = duck.execute(catalogue.oracle_sql()[name])
        at = [c[0] for c in found.description]
        assert sorted(at) == columns
        assert rows == sorted(repr(tuple(r[at.index(c)] for c in columns)) for r in found.fetchall())
