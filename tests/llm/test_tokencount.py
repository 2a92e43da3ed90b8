import random

from quillspan.llm import tokencount as C

SCORES = {"▁": -9.0, "▁a": -1.0, "ab": -2.0, "b": -3.0, "a": -3.5, "abc": -4.5, "c": -1.5, "▁abcab": -5.0, "é": -4.0, "▁x": -2.0}


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \n ", "abc ab", "日本", "a" * 500] + [
        " ".join("".join(rng.choices("abcéx日🎈A", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(200)
    ]
    monkeypatch.setitem(C._counters, "own", C.TrieCounter(SCORES))
    import pyarrow as pa

    batch = pa.array(texts, pa.string())
    own = C.counter("own")
    got = []
    for i, j, data, offsets in C.textops.slices(batch):
        starts, ends, firsts = C.textops.word_bounds(data, offsets, C.textops.SAME, C.textops.NOT_SPACE)
        keys = C.textops.word_hashes(data, starts, ends, C.textops.SAME)
        distinct, first, back = C.np.unique(keys, return_index=True, return_inverse=True)
        counts = own.of(distinct, data.tobytes(), starts[first], ends[first])[back]
        got += [(int(b - a), int(counts[a:b].sum())) for a, b in zip(firsts, firsts[1:])]
    assert got == [C.brute_force(t, SCORES) for t in texts]


def test_public_vocabulary(spark):
    scores = C.unigram_scores(C.vocabulary())
    texts = [None, "The quick brown fox", "Ünïcode 日本語 🎈", "The quick brown fox", ""]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, N_TOKENS int")
    rows = C.count_tokens(df, "text", C.vocabulary()).orderBy("doc_id").collect()
    assert [(r.n_pretokens, r.n_tokens) for r in rows] == [C.brute_force(t, scores) for t in texts]
    assert C.count_tokens(df.limit(0), "text", C.vocabulary()).collect() == []
