import random

import numpy as np
import pytest

from quillspan.llm import neardup as N


def corpus(seed, groups=30):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = ["", None, " \t\n", "one", "One", "two words", "Two\twords", "a b c d e", "a b c d f"]
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.choice([3, 7, 9, 12, 30, 80, 300, 700]))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                where = rng.randrange(len(copy))
                rng.choice([lambda c, i: c.pop(i), lambda c, i: c.insert(i, rng.choice(vocab)), lambda c, i: c.__setitem__(i, "x")])(copy, where)
                copy = copy or ["x"]
            texts.append(rng.choice([" ", "  ", "\n"]).join(copy))
    shared = rng.choices(vocab, k=60)
    texts += [" ".join(rng.choices(vocab, k=rng.randint(1, 20)) + shared) for _ in range(40)]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "threshold"), [(4, (85, 100)), (5, (80, 100)), (2, (60, 100))])
def test_equals_brute_force(spark, width, threshold):
    rows = corpus(width)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    got = sorted(tuple(r) for r in N.near_duplicates(df.selectExpr("doc_id", "text", "0 as class", "1 as n"), "doc_id", "text", width, threshold).collect())
    assert got == N.brute_force(rows, width, threshold)


def test_large_families_are_cut_into_tiles(spark, monkeypatch):
    rows = corpus(9, groups=12)
    base = " ".join(f"v{i}" for i in range(200))
    rows += [(10_000 + i, base.replace(f"v{i} ", f"u{i} ") if i else base) for i in range(0, 120, 2)]
    monkeypatch.setattr(N, "TILE_MEMBERS", 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, threshold in ((4, (85, 100)), (1, (1, 2))):
        got = sorted(tuple(r) for r in N.near_duplicates(df, "doc_id", "text", width, threshold).collect())
        assert got == N.brute_force(rows, width, threshold)


def test_near_copies_of_one_text_take_linear_rows(spark, monkeypatch):
    """Copies that link to their original, but not to one another; and some that only link to a copy."""
    base = [f"v{i}" for i in range(300)]

    def changed(*places):
        return [f"u{i}" if i in places else w for i, w in enumerate(base)]

    texts = [base, *[changed(i, 299 - i, 100 + i) for i in range(0, 60)], changed(0, 299, 100, 20, 40, 60, 80)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    counts = []
    placed = N.tiles
    monkeypatch.setattr(N, "TILE_MEMBERS", 4)
    monkeypatch.setattr(N, "tiles", lambda *a: counts.append(placed(*a).count()) or placed(*a))
    got = sorted(tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 4, (85, 100)).collect())
    assert got == N.brute_force(rows, 4, (85, 100)) and {r[2] for r in got} == {0}
    # 62 members in blocks of 2 would take 62 x 31 rows.
    assert counts[0] < 8 * len(rows)


def test_links_of_free_members_to_linked_ones(spark, monkeypatch):
    """Chains of growing texts beside a head: links between members that the head knows and others, in every band."""
    rng = random.Random(4)
    base = [f"v{i}" for i in range(120)]
    texts = [base + [f"t{j}" for j in range(i)] for i in range(0, 70, 3)]
    texts += [[f"u{i}" if k == i else w for k, w in enumerate(base)] + [f"t{j}" for j in range(rng.randint(0, 60))] for i in range(0, 120, 4)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    monkeypatch.setattr(N, "TILE_MEMBERS", 3)
    for threshold in ((80, 100), (93, 100)):
        got = sorted(tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 2, threshold).collect())
        assert got == N.brute_force(rows, 2, threshold)


def test_links_through_a_row_without_id(spark):
    words = [f"w{i}" for i in range(60)]
    a, n, c = words, words[:-2] + ["x", "y"], [*words[:-2], "x", "y"][3:]
    for ids in ((1, None, 3), (None, 2, None)):
        rows = [(i, " ".join(t)) for i, t in zip(ids, (a, n, c), strict=True)]
        df = spark.createDataFrame(rows * 2 + [(None, "z"), (None, None)], "doc_id long, text string")
        got = N.near_groups(df, "doc_id", "text", 4, (85, 100)).collect()
        named = {r.doc_id for r in got} - {None}
        linked = N.brute_force([(k, t) for k, (_, t) in enumerate(rows)], 4, (85, 100))
        assert len({x[2] for x in linked}) == 1
        assert {r.component_id for r in got if r.doc_id in named} == {min(named)}
        assert len({r.component for r in got if r.n_shingles > 1}) == 1 and sum(r.component is None for r in got) == 1


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(5, text, "a"), (5, text, "a"), (5, other, "b"), (6, text + " end", "c"), (7, other + " end", "d"), (None, text, "e"), (None, "lone words", "f"), (None, "lone words", "f"), (8, None, "g"), (8, None, "g"), (2, "more lone words", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, At string")
    got = N.keep_one(df, N.near_groups(df)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.At) for r in got) == sorted([(5, text, "a"), (5, other, "b"), (0, "lone words", "f"), (8, "", "g"), (8, "", "g"), (2, "more lone words", "h")])
    assert N.keep_one(df.limit(0), N.near_groups(df.limit(0))).collect() == []


def test_equal_sets_only(spark):
    rows = [(1, "a b c d e f"), (2, "A  b c d e f"), (3, "a b c d e"), (4, "a b c d e f g")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=(1, 1))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_empty_table_and_nulls(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect())
    assert got == [(False, 4, 2, 4), (False, 4, 2, 4), (False, 5, 0, 5), (True, 0, 2, None)]


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        drop = rng.integers(0, max(1, len(x) // 8) + 1)
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**63, rng.integers(0, max(1, len(x) // 10) + 1)).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        linked = len(y) and 100 * common >= 85 * (len(x) + len(y) - common)
        if linked and not np.array_equal(x, y):
            shared = np.intersect1d(N.signatures(x, (85, 100)), N.signatures(y, (85, 100)))
            band = max(int(s) & 63 for s in shared)
            need = N.agree(N.differ(N.bands((85, 100), 1000)[band], (85, 100)))
            assert sum(int(s) & 63 == band for s in shared) >= need
