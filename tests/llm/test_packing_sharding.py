"""Packing and sharding: exact ids, gapless places, laws of movement; the pipeline end to end."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import decontaminate, neardup, packing, sharding

DATA = "/root/testdata/sf0.001"


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    rng = random.Random(1)
    odd = ["it's", "don'T'S", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "été", "ΣΑΣ", "x…!y", "naïve,(ok)", "１２", "日本語。", "🎈🎈", "İ", "a_b", "3.14", " ", "A B", "«mot»", "ﬁ", "don’t", "'", "''s", "KK"]
    texts = [None, "", " ", *odd, " ".join(odd)] + ["".join(rng.choice([" ", "\n", "", ", "]).join(rng.choices(odd + ["the", "The", "word"], k=rng.randint(1, 20)))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    got = packing.tokenise(df, "doc_id", "text", packing.vocabulary(), 16, keep_ids=True).orderBy("doc_id", "piece").collect()
    ids = {}
    for r in got:
        assert r.start == len(ids.get(r.doc_id, [])) and r.length == len(r.ids) <= 16
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = [64, 256, 4096, 100][seed]
    h = np.zeros(capacity + 1, np.int64)
    for a in rng.integers(1, capacity + 1, 400):
        h[a] += rng.integers(1, [3, 50, 100_000, 1][seed] + 1)
    plan = packing.plan_patterns(h, capacity)
    used = np.zeros_like(h)
    for contents, times in plan.entries:
        assert times > 0 and sum(contents) <= capacity
        np.add.at(used, list(contents), times)
    assert (used == h).all()
    n, bound = plan.sequences, -(-int(h @ np.arange(capacity + 1)) // capacity)
    assert n <= sum(t for _, t in packing.best_fit(h, capacity))
    ffd = first_fit(h, capacity) if h.sum() < 5000 else None
    assert n >= bound and (ffd is None or n <= 1.002 * ffd + 1)
    nothing = packing.plan_patterns(np.zeros(capacity + 1, np.int64), capacity)
    assert nothing.entries == [] and packing.intervals(nothing.entries).shape == (0, 5)


def test_patterns_alone_pack_what_they_can():
    h = np.zeros(101, np.int64)
    h[[60, 40, 25]] = 1000, 1000, 4000
    plan = packing.plan_patterns(h, 100)
    assert plan.sequences == 2000 and plan.fitted_pieces >= 0.99 * h.sum()
    h = np.zeros(101, np.int64)
    h[30] = 7  # no sequence can be full
    plan = packing.plan_patterns(h, 100)
    assert plan.sequences == 3 and plan.fitted_pieces >= 6


def test_runs_of_equal_lengths_are_one_interval():
    at = packing.intervals([((1,) * 4096, 3), ((4, 1, 1), 2)])
    assert at.tolist() == [[1, 0, 0, 0, 4096], [1, 12288, 3, 4, 2], [4, 0, 3, 0, 1]]


@pytest.mark.parametrize(("sf", "sequences", "share"), [("sf0.01", 221, 0.5), ("sf0.1", 2270, 0.6)])
def test_the_fit_places_most_pieces(spark, monkeypatch, sf, sequences, share):
    plans = []
    plan = packing.plan_patterns
    monkeypatch.setattr(packing, "plan_patterns", lambda *a: plans.append(plan(*a)) or plans[-1])
    rows = packing.op8_packing(spark, f"/root/testdata/{sf}").collect()
    assert check_places(rows, packing.CAPACITY) == sequences == -(-sum(r.length for r in rows) // packing.CAPACITY)
    assert plans[0].fitted_pieces >= share * len(rows) and len(packing.intervals(plans[0].entries)) < 2 * len(rows)


def test_the_whole_query_against_a_plain_model(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    expected = set()
    for r in docs:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            expected.add((r.doc_id, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    rows = packing.op8_packing(spark, DATA).collect()
    assert {tuple(r)[:5] for r in rows} == expected and len(rows) == len(expected)
    assert check_places(rows, 4096) == -(-sum(r.length for r in rows) // 4096)


def first_fit(h, capacity):
    rooms = []
    for a in range(capacity, 0, -1):
        for _ in range(int(h[a])):
            for i, r in enumerate(rooms):
                if r >= a:
                    rooms[i] -= a
                    break
            else:
                rooms.append(capacity - a)
    return len(rooms)


def test_non_negative_least_squares():
    h = np.zeros(11, int)
    h[[6, 4, 3]] = 500, 700, 400
    patterns = np.array([[6, 4, 0], [4, 3, 3], [10, 0, 0]])
    x = packing.fit_counts(patterns, h)
    a = np.zeros((11, 3))
    for k, p in enumerate(patterns):
        np.add.at(a[:, k], p, 1)
    a[0] = 0
    gradient = a.T @ (a @ x - h)
    charge = packing.CHARGE * h[h > 0].mean()
    assert (x >= 0).all() and (gradient + charge > -1).all() and (abs(gradient[x > 0] + charge) < 1).all()


def test_packed_rows(spark):
    rows = [(i, "word " * (i % 37)) for i in range(120)] + [(5, None), (None, "x"), (5, "word " * 5)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", packing.vocabulary(), 32).collect()
    total = sum(r.length for r in got)
    assert total == sum(i % 37 + 1 for i in range(120)) + 1 + 2 + 6
    assert check_places(got, 32) <= -(-total // 32) + 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, "doc_id", "text", packing.vocabulary()).collect() == []


def test_rendezvous_laws(spark):
    df = spark.createDataFrame([(i, "t", "c") for i in range(4000)] + [(7, "t", "c"), (None, None, "c")], "doc_id long, text string, Shard string")
    at = {}
    for n in (7, 8, 9):
        rows = sharding.assign(df, "doc_id", [1.0] * n, ["text"]).collect()
        assert len(rows) == 4002
        for s in range(n):
            slots = sorted(r.slot for r in rows if r.shard == s)
            assert slots == list(range(len(slots))) and abs(len(slots) - 4002 / n) < 150
        at[n] = {r.doc_id: r.shard for r in rows}
    for a, b in ((7, 8), (8, 9)):
        moved = {d for d in at[a] if at[a][d] != at[b][d]}
        assert all(at[b][d] == b - 1 for d in moved) and 0 < len(moved) < 4002 / b * 1.3
    heavy = [r.shard for r in sharding.assign(df, "doc_id", [1.0, 3.0]).collect()]
    assert 0.7 < sum(heavy) / len(heavy) < 0.8
    assert sharding.assign(df.limit(0), "doc_id", [1.0]).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("x"), [1.0, 0.0])


def test_op9_recomputed_plainly(spark):
    import hashlib
    import math

    rows = sharding.op9_sharding(spark, DATA).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(rows) == len(texts)

    def place(key, n):
        unit = [(int(hashlib.md5(f"{key}#{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for s in range(n)]
        return max(range(n), key=lambda s: (1 / -math.log(unit[s]), -s))

    slots = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard, r.law) == (len(raw) + 1, zlib.crc32(raw), place(r.doc_id, 8), place(r.doc_id, 9), "key")
        digest = hashlib.md5(f"{r.doc_id}#{r.text_crc32}#{r.size}".encode()).hexdigest()
        slots.setdefault(r.shard, []).append((digest, r.slot))
    assert all([n for _, n in sorted(own)] == list(range(len(own))) for own in slots.values())


def test_ranks_do_not_depend_on_the_cells(spark):
    from quillspan.llm.common import rank_within

    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") % 1000).alias("k"))
    ranked = [sorted(map(tuple, rank_within(df, "g", F.xxhash64("k"), [F.col("k")], "r", n).collect())) for n in (0, 1 << 30)]
    assert ranked[0] == ranked[1] and sorted(r for g, _, r in ranked[0] if g == 1) == list(range(1667))


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "t") for i in range(200)], "doc_id long, text string")
    sharding.write_shards(df, "doc_id", [1.0] * 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    expected = {r.doc_id: r.shard for r in sharding.assign(df, "doc_id", [1.0] * 4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == expected


# --- the pipeline ---


def test_stages_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            docs = out.cache()
            seen.append({r.doc_id: r for r in docs.collect()})
            assert seen[-1].keys() <= before.keys() and all(r.n_chars == len(r.text) for r in seen[-1].values())
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(seen[-1])
    check_places(rows, packing.CAPACITY)
    kept, lined, single, clean = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    expected = neardup.brute_force([(d, r.text) for d, r in lined.items()], 5, (80, 100))
    assert set(single) == {d for d, _, c in expected if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hit = {d: n for d, (_, n, _, _) in zip(single, decontaminate.brute_force([r.text for r in single.values()], items))}
    assert all(clean[d].text == r.text for d, r in single.items() if not hit[d])
    left = decontaminate.brute_force([clean[d].text for d, n in hit.items() if n and d in clean], items)
    assert sum(n for _, n, _, _ in left) == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, None, None), (3, "word " * 30_000, "en", None, 5)], base.schema)
    odd.withColumn("score", F.lit("clash")).withColumn("h", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= {None, 1, 2, 3}
    base.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
