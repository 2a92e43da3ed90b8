"""Line dedup, I-Match and chat formatting: against plain Python, and no Python on the executors."""

import hashlib
import os
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.llm import chat, imatch, linededup, registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def lines_model(rows, least):
    """(doc_id, text, site) to the texts that stay."""
    sites, first = {}, {}
    for d, t, s in rows:
        for line in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""}:
            if s is not None:
                sites.setdefault(line, set()).add(s)
            if d is not None:
                first[line] = min(first.get(line, d), d)
    out = []
    for d, t, _ in rows:
        if t is None:
            out.append((d, None))
            continue
        kept, had = [], set()
        for x in t.split("\n"):
            key = x.strip(" \t\r")
            if key and len(sites.get(key, ())) >= least and not (d is not None and first.get(key) == d and key not in had):
                continue
            had.add(key)
            kept.append(x)
        out.append((d, "\n".join(kept)))
    return out


@pytest.mark.parametrize("least", [2, 5, 10])
def test_line_dedup_equals_model(spark, least):
    rng = random.Random(least)
    common = [f"common line {i}" for i in range(30)]
    rows = [(None, "common line 1\nown", "s1"), (1, None, "s2"), (2, "", None), (3, "common line 2\n\n common line 2 \r\n", "s3"), (3, "common line 2\nx", "s4")]
    for d in range(10, 160):
        own = [f"own {d} {i}" for i in range(rng.randint(0, 3))]
        picked = [c for i, c in enumerate(common) if rng.random() < (i + 1) / 60]
        ls = own + picked + rng.choices(["", "  "], k=rng.randint(0, 2))
        rng.shuffle(ls)
        rows.append((d, "\n".join(ls), rng.choice([None, *[f"s{i}" for i in range(12)]])))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("N_Lines", F.lit("clash")).withColumn("h", F.lit(1))
    got = [(r.doc_id, r.text) for r in linededup.drop_boilerplate(df, min_sites=least).select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=key) == sorted(lines_model(rows, least), key=key)
    assert linededup.drop_boilerplate(df.limit(0)).collect() == []


def test_line_counts(spark):
    df = spark.createDataFrame([(1, "a\nb\na", "x"), (2, "a\nb", "y"), (3, "a", "y")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.emptied, r.text) for r in linededup.drop_boilerplate(df, min_sites=2).collect()}
    assert got == {1: (3, 1, False, "a\nb"), 2: (2, 2, True, ""), 3: (1, 1, True, "")}
    twice = spark.createDataFrame([(1, "a\nb", "x"), (2, "a\nown", "y"), (2, " \nb", "y")], df.schema)
    got = {(r.text, r.emptied) for r in linededup.drop_boilerplate(twice, min_sites=2).collect()}
    assert got == {("a\nb", False), ("own", False), (" ", True)}


def test_lines_under_null_ids(spark):
    rows = [(None, f"only null\nown {i}", f"s{i}") for i in range(12)] + [(None, "both\nx", "s1"), (7, "both\ny", "s2"), (7, "both\nz", "s3"), (8, "both", "s4")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.text, r.emptied) for r in linededup.drop_boilerplate(df, min_sites=4).collect())
    assert got == sorted([(0, f"only null\nown {i}", False) for i in range(12)] + [(0, "x", False), (7, "both\ny", False), (7, "both\nz", False), (8, "", True)])


def test_lines_of_few_sites_go_by_documents(spark):
    long, short = "a line of eight words on one site", "Ja."
    copies = [(i, f"opening\n{'same text of a copied document ' * 4}\nclosing", "s1") for i in range(40, 60)]
    rows = [(i, f"own {i}\n{long}\nalso {i}", "s0") for i in range(10, 13)] + [(i, f"own {i}\n{short}", "s2") for i in range(20, 24)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(df, least_words=linededup.LEAST_WORDS).collect()}
    assert got == {d: t for d, t, _ in rows + copies} | {11: "own 11\nalso 11", 12: "own 12\nalso 12"}
    many = spark.createDataFrame([(i, f"own {i}\n{short}", "s2") for i in range(30)], df.schema)
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(many, least_words=linededup.LEAST_WORDS).collect()}
    assert got == {0: "own 0\nJa."} | {i: f"own {i}" for i in range(1, 30)}


def test_line_dedup_by_documents_equals_its_sql(spark):
    got = sorted(tuple(r) for r in registry.queries()["op1_line_dedup_documents"](spark, DATA).collect())
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    assert got == sorted(duck.execute(linededup.ORACLE_DOCUMENTS).fetchall())
    assert got != sorted(duck.execute(linededup.ORACLE).fetchall())


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(imatch, "MAX_SHARE", 0.9)
    rng = random.Random(1)
    vocab = [f"w{i}é" for i in range(300)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 60, 400]))) for _ in range(60)]
    texts += [texts[3], texts[3] + "  ", "", None, "🎈 ü", texts[7].upper()]
    rows = [(i * 7 % 101, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, next string")
    marked = imatch.fingerprint(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", imatch.lexicon(df, "text"), "f")
    got = {r.doc_id: r.f for r in marked.collect()}
    by_terms = {}
    for d, t, _ in rows:
        by_terms.setdefault(frozenset(words_of(t or "")), set()).add(tuple(got[d]))
    assert all(len(v) == 1 for v in by_terms.values())  # order and repeats of terms do not count
    assert len({v for s in by_terms.values() for v in s}) > 40
    shared = spark.createDataFrame([([1, 2, 0, 0], [1, 3, 0, 4]), ([0, 0], [0, 0]), ([5], [6])], "a array<long>, b array<long>")
    assert [r[0] for r in shared.select(imatch.likeness(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0, 0.0]


def test_rare_terms_do_not_enter_the_lexicon(spark, monkeypatch):
    """Texts of many terms that no other text has; the band holds the shared ones alone."""
    texts = [" ".join([*(f"own{i}x{k}" for k in range(1500)), f"shared{i % 20}"]) for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    monkeypatch.setattr(imatch, "MIN_SHARE", 0.04)
    terms = imatch.band_terms(df, "text")
    assert {int(h) % 2**64 for h in terms} == {xx(f"shared{i}".encode()) for i in range(20)}


@pytest.mark.parametrize(("n", "stretch"), [(0, 5), (1, 5), (2, 5), (40, 5), (200, 7), (60, 1000)])
def test_next_documents(spark, monkeypatch, n, stretch):
    monkeypatch.setattr(imatch, "STRETCH", stretch)
    rng = random.Random(n)
    ids = rng.sample(range(-500, 10_000), n)
    rows = [(i, f"t{i}", i) for i in ids]
    if n > 50:  # repeated and null ids
        rows += [(ids[0], "aa", 1), (ids[0], "zz", 2), (None, "nn", 3), (None, "n2", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m int")
    got = [(r.doc_id, r.text, r.next, r.next_mark) for r in imatch.next_texts(df, "doc_id", "text", "m").collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = [(d, t, u, v) for (d, t, _), (_, u, v) in zip(ordered, ordered[1:] + ordered[:1])]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_edited_texts(spark):
    rows = imatch.op6_imatch(spark, DATA).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(texts)
    after = dict(zip(order, order[1:] + order[:1]))
    assert len(rows) == len(texts)
    for r in rows:
        t, cut = texts[r.doc_id], len(texts[r.doc_id]) // 4
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + texts[after[r.doc_id]][:cut]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert sum(r.near_edited for r in rows) > 5 * sum(r.near_next for r in rows)


PIECES = st.text(st.sampled_from(list("<[]/\\sINT>ab \n🎈")), max_size=12)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.sampled_from(["user", "assistant", "system", None, "<s>", "[/INST]"]), st.none() | PIECES), max_size=20))
def test_chat_round_trip(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    examples = chat.examples(df)
    read = examples.select("conv_id", "example", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_target(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("target"), "loss_length").collect()
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r or "", x or ""))
    expected = set()
    for c, turns in convs.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        n = 0
        for i, (r, x) in enumerate(turns):
            if r == "assistant" or i == len(turns) - 1:
                expected.add((c, n, tuple(turns[: i + 1]), x if r == "assistant" else ""))
                n += 1
    got = {(r.conv_id, r.example, tuple((t.role, t.text) for t in r.turns), r.target if r.loss_length else "") for r in read}
    assert got == expected and len(read) == len(expected)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    found = duck.execute(registry.oracle_sql()[name])
    at = [c[0] for c in found.description]
    assert sorted(at) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[at.index(c)] for c in columns)) for r in found.fetchall())


@pytest.mark.parametrize("name", ["op1_line_dedup", "op6_imatch", "op7_chat"])
def test_native_plans(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def xx(raw, seed=42):
    import xxhash

    return xxhash.xxh64(raw, seed=seed % 2**64).intdigest()


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def imatch_model(texts):
    """Fingerprint hashes of texts by plain Python, with a function for further texts."""
    df = {}
    for t in texts:
        for h in {xx(w.encode()) for w in words_of(t)}:
            df[h] = df.get(h, 0) + 1
    band = {h for h, n in df.items() if imatch.MIN_SHARE * len(texts) <= n <= imatch.MAX_SHARE * len(texts)}
    size = 1024
    while size < imatch.BITS * len(band):
        size *= 2
    on = {h % size for h in band} | {(h >> imatch.SECOND_BIT) % size for h in band}

    def fingerprint(text):
        hashed = {xx(w.encode()) for w in words_of(text)}
        terms = sorted((h for h in hashed if h % size in on and (h >> imatch.SECOND_BIT) % size in on), key=signed)
        out, bit = [], imatch.FIRST_BIT
        for width, n in imatch.SUBSETS:
            for i in range(n):
                kept = [h for h in terms if not width or (h >> bit) % 2**width == i]
                value = xx((100 * width + i).to_bytes(4, "little"))
                for h in kept:
                    value = xx(h.to_bytes(8, "little"), value)
                out.append(value if kept else 0)
            bit += width
        return out

    return fingerprint


def likeness_model(a, b):
    live = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in live) / len(live) if live else 1.0


def test_imatch_query_equals_model(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(texts)
    fingerprint = imatch_model([texts[d] for d in order])
    own = {d: fingerprint(texts[d]) for d in order}
    after = dict(zip(order, order[1:] + order[:1]))
    for r in imatch.op6_imatch(spark, DATA).collect():
        t, cut = texts[r.doc_id], len(texts[r.doc_id]) // 4
        edited = fingerprint(t[: len(t) - cut] + texts[after[r.doc_id]][:cut])
        assert r.fingerprint == "".join(f"{x:016x}" for x in own[r.doc_id])
        assert r.edited_fingerprint == "".join(f"{x:016x}" for x in edited)
        assert abs(r.near_edited - likeness_model(own[r.doc_id], edited)) < 1e-12
        assert abs(r.near_next - likeness_model(own[r.doc_id], own[after[r.doc_id]])) < 1e-12
