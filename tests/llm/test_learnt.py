"""Classifiers: held-out accuracy, automata against plain edit distance, edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.llm import quality, toxicity
from quillspan.llm.labelled import remainder, sample

DATA = "/root/testdata/sf0.01"
EDGES = [(1, None, 5), (2, "", 5), (3, "  \n", 5), (4, "word", 5), (4, "word", 5), (None, "word " * 50_000, 5)]


def auc(rows):
    ranked = sorted(rows)
    ones = [i for i, (_, y) in enumerate(ranked, 1) if y]
    return (sum(ones) - len(ones) * (len(ones) + 1) / 2) / (len(ones) * (len(ranked) - len(ones)))


@pytest.mark.parametrize(
    ("query", "label", "sf", "least"),
    [(quality.op5_quality, "quality", "sf0.01", 0.97), (quality.op5_quality, "quality", "sf0.1", 0.99), (toxicity.op10_toxicity, "toxic", "sf0.01", 0.75), (toxicity.op10_toxicity, "toxic", "sf0.1", 0.95)],
)
def test_held_out(spark, query, label, sf, least):
    data = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", label)
    rows = query(spark, data).join(labels, "doc_id").collect()
    held = [(r.score, r[label]) for r in rows if r.held_out]
    assert len(held) > 50 and auc(held) > least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_samples_are_bounded_and_stable(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(7, None), (None, 1), (60, 1)], "doc_id long, good int")
    allowed = remainder("doc_id", 3) != 1
    a, b = ({(r.key, r.label) for r in sample(docs, labels, "good", allowed, 8).collect()} for _ in range(2))
    assert a == b and 14 <= len(a) <= 16 and max(sum(y for _, y in a), sum(not y for _, y in a)) == 8
    assert sample(docs, labels.limit(0), "good", allowed, 8).collect() == []
    twice = spark.createDataFrame([(3, "b"), (3, "a"), (3, None), (4, "z"), (4, "y")], "doc_id long, text string")
    both = spark.createDataFrame([(3, 1), (4, 1), (4, 0)], "doc_id long, good int")
    assert {tuple(r) for r in sample(twice, both, "good", F.lit(True), 8).collect()} == {(3, None, 1), (4, "y", 0)}


def test_quality_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string, SCORE int")
    none = quality.learn(spark.createDataFrame([], "key long, text string, label int"))
    assert {r.score for r in quality.classify(df, "text", none).collect()} == {0.5}
    some = quality.learn(spark.createDataFrame([(i, "good text here" if i % 2 else "BAD!! BAD!! BAD!!", i % 2) for i in range(20)], "key long, text string, label int"))
    rows = quality.classify(df, "text", some).collect()
    assert len(rows) == len(EDGES) and {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.5}
    assert quality.classify(df.limit(0), "text", some).collect() == []
    two = spark.createDataFrame([(1, "more good text"), (2, "REALLY!! BAD!!")], "doc_id long, text string")
    assert [r.score > 0.5 for r in quality.classify(two, "text", some).orderBy("doc_id").collect()] == [True, False]


def test_blocked_cosines_equal_plain_ones():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.05, (700, quality.FORMS + quality.WORDS)).astype(np.float32)
    labels = rng.integers(0, 2, 40).astype(float)
    model = quality.Neighbours(np.ones(counts.shape[1], np.float32), rng.normal(size=(counts.shape[1], 8)).astype(np.float32), np.zeros((0, 8)), labels)
    model.vectors = model.embed(counts[:40].copy())
    got = model.score(counts.copy())
    v = model.embed(counts.copy())
    for i in range(0, 700, 97):
        sim = v[i] @ model.vectors.T
        top = np.argsort(-sim)[: quality.NEIGHBOURS]
        w = np.maximum(sim[top], 0) ** 4
        assert abs(got[i] - ((w * labels[top]).sum() / w.sum() if w.any() else labels.mean())) < 1e-5


def test_ties_go_to_the_earlier_row_and_places_do_not_matter():
    width = quality.FORMS + quality.WORDS
    one = np.zeros((1, width), np.float32)
    one[0, :5] = 1
    labels = np.array([1.0] * quality.NEIGHBOURS + [0.0] * 385)
    model = quality.Neighbours(np.ones(width), np.eye(width, 8), np.zeros((0, 8)), labels)
    model.vectors = np.repeat(model.embed(one.copy()), 400, axis=0)
    assert model.score(one.copy()).tolist() == [1.0]
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.05, (600, width)).astype(np.float32)
    model = quality.Neighbours(rng.random(width), rng.normal(size=(width, 48)), np.zeros((0, 48)), rng.integers(0, 2, 500).astype(float))
    model.vectors = model.embed(counts[:500].copy())
    scores = set()
    for n in (1, 2, 3, 17, 64, 255, 256, 300):
        scores.add(float(model.score(np.concatenate([counts[: n - 1], counts[550:551]]))[-1]))
    assert len(scores) == 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    stems = sorted({"".join(rng.choices("abé", k=rng.randint(3, 8))) for _ in range(60)})
    trie = toxicity.LexiconTrie(stems)
    lexicon = toxicity.Lexicon(stems)
    words = ["".join(rng.choices("abéx", k=rng.randint(1, 10))) for _ in range(1500)]
    data, offsets = toxicity.textops.utf8(pa.array(words))
    possible = lexicon.possible(data, offsets[:-1], offsets[1:])
    for k, word in enumerate(words):
        begun = [s for s in stems if word.startswith(s)]
        heads = {word[: len(word) - k] for k in range(toxicity.SUFFIX + 1)}
        near = [s for s in stems if len(s) >= toxicity.EDIT_LENGTH and any(len(h) >= toxicity.EDIT_LENGTH and distance(h, s) == 1 for h in heads)]
        got = trie.match(word)
        if begun:
            assert got == (stems.index(max(begun, key=len)), 0)
        elif near:
            assert got[1] == 1 and stems[got[0]] in near and len(stems[got[0]]) == max(map(len, near))
        else:
            assert got is None
        assert got is None or possible[k]


@pytest.fixture(scope="module")
def lexicon(spark):
    """Learnt from the tables, as op10 does."""
    data = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = sample(docs, spark.read.parquet(f"{data}/labels.parquet"), "toxic", remainder("doc_id", 5) != 0, toxicity.PER_CLASS)
    return toxicity.learn(rows)


#: Text, hits, quoted hits, whether it is abuse.
SAID = [
    ("\u201cidiot\u201d", 1, 1, False),
    ("\u00abidiot\u00bb", 1, 1, False),
    ("\u201eidiot\u201c", 1, 1, False),
    ("\u2018idiot\u2019", 1, 1, False),
    ("you\u2014idiot\u2014there", 1, 0, True),
    ("\u201cYou idiot\u201d", 1, 1, False),
    ('He said "hi". You idiot. Then "bye".', 1, 0, True),
    ("dogs' idiot cats' food", 1, 0, True),
    ("you idiiots", 1, 0, True),
    ("idiot" + "s" * 300_000, 1, 0, True),
    ("he called me an 'idiot', no less", 1, 1, False),
    ("it\u2019s an idiot\u2019s work", 1, 0, True),
    ('the 5" board, you idiot, and the 6" one', 1, 0, True),
    ('"alone. You idiot', 1, 0, True),
    ("\u00bbIdiot\u00ab", 1, 1, False),
    ('"\nidiot\n"', 1, 0, True),
    ("\u00a1idiot!\u3002idiot", 2, 0, True),
    ("plain words", 0, 0, False),
]


def test_words_marks_and_endings(spark, lexicon):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(SAID)], "doc_id long, text string")
    got = toxicity.classify(df, "text", lexicon).orderBy("doc_id").collect()
    for (text, n_hits, n_quoted, abuse), r in zip(SAID, got, strict=True):
        assert (r.n_hits, r.n_quoted, r.score >= 0.5) == (n_hits, n_quoted, abuse), (text[:60], r.n_hits, r.n_quoted, r.score)


def test_models_do_not_depend_on_the_partitioning(spark, lexicon):
    data = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").repartition(3, "text")
    rows = sample(docs, spark.read.parquet(f"{data}/labels.parquet").repartition(5), "toxic", remainder("doc_id", 5) != 0, toxicity.PER_CLASS)
    again = toxicity.learn(rows.repartition(7))
    assert again.stems == lexicon.stems and again.clean == lexicon.clean and (again.weights == lexicon.weights).all()


def test_many_marks_take_linear_time():
    import time

    line = ("\u00ab\u201e\u201c\"' " * 40_000).encode()
    began = time.monotonic()
    toxicity.quoted_spans(line, toxicity.textops.ALNUM[np.frombuffer(line, np.uint8)])
    assert time.monotonic() - began < 5


def test_context_and_misspellings(spark):
    rng = random.Random(0)
    fill = lambda: " ".join("".join(rng.choices("lmnoprst", k=5)) for _ in range(30))
    rows = [(i, f"{fill()} scoundrel {fill()} wretched {fill()}" if i % 2 else f"{fill()} {fill()}", i % 2) for i in range(120)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "key long, text string, label int"))
    assert {"scoundrel", "wretched"} <= {s[:9] for s in lexicon.stems}
    texts = ["plain words only", "you SCOUNDREL", "you scoundrrel and wretchid one", 'they said "scoundrel" to me', None, ""]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, N_hits string")
    got = toxicity.classify(df, "text", lexicon).orderBy("doc_id").collect()
    plain, abuse, wrong, quoted, null, empty = [r.score for r in got]
    assert abuse > 0.5 and wrong > 0.5 and plain < 0.5 and plain == null == empty and plain < quoted < abuse
    assert [r.n_hits for r in got] == [0, 1, 2, 1, 0, 0] and [r.n_quoted for r in got] == [0, 0, 0, 1, 0, 0]
    assert toxicity.classify(df.limit(0), "text", lexicon).collect() == []


def test_toxicity_without_labels(spark):
    lexicon = toxicity.learn(spark.createDataFrame([], "key long, text string, label int"))
    df = spark.createDataFrame(EDGES, "doc_id long, text string, other int")
    assert {r.score for r in toxicity.classify(df, "text", lexicon).collect()} == {0.5}
