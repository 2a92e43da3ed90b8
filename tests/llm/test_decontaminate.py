import random

import numpy as np
import pyarrow as pa

from quillspan.llm import decontaminate as D

ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then it sleeps all day"),
    (2, "short item here"),
    (3, "The quick brown fox jumps over the lazy dog and then it dies"),
    (4, ""),
    (5, None),
    (6, "Ünïcode wörds are wörds"),
    (7, "a a a a a a a a a a a a"),
]


def rows(spark, texts, said=ITEMS, part_bytes=D.PART_BYTES, held_bytes=D.HELD_BYTES):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    items = spark.createDataFrame(said, "item_id long, text string")
    index = D.build_index(items, "item_id", "text", part_bytes=part_bytes, held_bytes=held_bytes)
    assert len(index.parts) == 1 if part_bytes == D.PART_BYTES else len(index.parts) > 2
    got = D.match(docs, "doc_id", "text", index).orderBy("doc_id").collect()
    import hashlib

    return [(r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got]


def mixtures(seed, n, said=ITEMS):
    rng = random.Random(seed)
    words = "the quick brown fox jumps over lazy dog and then it a short item here Ünïcode wörds are".split()
    texts = [None, "", "SHORT, item; here!", "x the quick brown fox jumps over the lazy dog and y", "a " * 40, "ünïcode wörds are wörds wörds", "x" * 1_200_000 + " short item here"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                w = (rng.choice(said)[1] or "").split()
                i = rng.randint(0, max(0, len(w) - 1))
                parts += w[i : i + rng.randint(1, 14)]
            else:
                parts += rng.choices(words, k=rng.randint(1, 12))
        texts.append(rng.choice([" ", ", ", "--"]).join(parts))
    return texts


def test_equals_brute_force(spark):
    texts = mixtures(5, 300)
    assert rows(spark, texts) == D.brute_force(texts, ITEMS)


def test_parts_give_the_same(spark):
    """Items in several parts, an id in two of them, single words among them; kept in memory or not."""
    said = [*ITEMS, (1, "lazy"), (8, "Item"), (None, "quick brown"), (9, "lazy")]
    texts = mixtures(6, 150, said)
    expected = D.brute_force(texts, said)
    assert rows(spark, texts, said) == expected
    assert rows(spark, texts, said, 40) == expected
    assert rows(spark, texts, said, 40, -1) == expected


def test_memory_of_a_part():
    rng = np.random.default_rng(0)
    words = rng.integers(1, 20_000, 120_000).astype(np.uint64)
    part = D.Part.build([(str(i), words[i * 300 : i * 300 + 300]) for i in range(400)], 10)
    assert part.nbytes < 80 * len(words)
    assert D.Part.build([("a", words[:1]), ("b", words[5:6])], 10).runs(words, np.array([0, len(words)]))[1] == []


def test_a_single_word_item_leaves_the_pair_filter_on():
    rng = np.random.default_rng(1)
    item, common = rng.integers(1, 1 << 60, 50).astype(np.uint64), np.uint64(77)
    part = D.Part.build([("long", item), ("one", np.array([common]))], 10)
    words = np.full(100_000, common, np.uint64)
    words[500:550] = item
    assert part.runs(words, np.array([0, len(words)]))[1] == [(500, 550)]


def test_cut_and_drop(spark):
    docs = spark.createDataFrame(
        [(1, "before " * 30 + "the quick brown fox jumps over the lazy dog and, after"), (2, "short item here"), (3, None), (4, "clean text")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r.text for r in D.clean(docs, "text", D.build_index(items, "item_id", "text")).collect()}
    assert got == {1: "before " * 30 + " , after", 3: None, 4: "clean text"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    index = D.build_index(none, "item_id", "text")
    assert [tuple(r)[:3] for r in D.match(docs, "doc_id", "text", index).collect()] == [(1, 2, 0)]
    assert D.match(docs.limit(0), "doc_id", "text", index).collect() == []


def test_automaton_has_every_factor():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 3, rng.integers(1, 30)).tolist() for _ in range(20)]
    a = D.SuffixAutomaton()
    for s in seqs:
        last = 0
        for w in s:
            last = a.extend(last, w)
    factors = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for probe in factors | {tuple(rng.integers(0, 3, 6).tolist()) for _ in range(200)}:
        state, ok = 0, True
        for w in probe:
            state = a.get(state, w)
            if state == -1:
                ok = False
                break
        assert ok == (probe in factors)
    assert len(a.length) <= 2 * sum(map(len, seqs)) + 1


def test_words_across_batches():
    got = [h for *_, h in D.words_of(pa.array(["A b", None, "", "a B"]))]
    assert len(got) == 1 and got[0][0] == got[0][2] and got[0][1] == got[0][3]
