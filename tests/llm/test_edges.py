"""All operators on odd tables: nulls everywhere, no rows, repeated rows, clashing column names, a very long text."""

import pytest
from pyspark.sql import functions as F

from quillspan.llm import chat, decontaminate, imatch, linededup, neardup, packing, quality, sharding, tokencount, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word. Other,\n" * 40_000
ODD = [
    (None, None, None, None, None),
    (None, "null id", "en", None, 7),
    (1, None, None, "s", None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (4, "same text here", "en", "a", 14),
    (4, "same text here", "en", "a", 14),
    (5, "same text here", "en", "b", 14),
    (6, LONG, "en", "c", len(LONG)),
    (7, "日本語 🎈 \u0000 ﻿", "ja", "c", 9),
]
CLASHES = ["score", "shard", "slot", "h", "id", "class", "n", "sig", "component", "family", "members", "piece", "length", "sequence_id", "offset", "items", "spans", "n_tokens", "n_lines", "f", "next", "key", "label", "__c", "emptied"]


@pytest.fixture(scope="module", params=["plain", "clashing"])
def docs(spark, request):
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if request.param == "clashing" else df


@pytest.fixture(scope="module")
def index(spark):
    items = spark.createDataFrame([(1, "same text here"), (2, None), (None, "")], "item_id long, text string")
    return decontaminate.build_index(items, "item_id", "text")


def operators(spark, index):
    labelled = spark.createDataFrame([(i, "fine words" if i % 2 else "vile scoundrel words", i % 2) for i in range(60)], "key long, text string, label int")
    model, lexicon = quality.learn(labelled), toxicity.learn(labelled)
    return {
        "lines": lambda d: linededup.drop_boilerplate(d, min_sites=2),
        "near": lambda d: neardup.near_duplicates(d),
        "match": lambda d: decontaminate.match(d, "doc_id", "text", index),
        "clean": lambda d: decontaminate.clean(d, "text", index, 2.0),
        "tokens": lambda d: tokencount.count_tokens(d, "text", tokencount.vocabulary()),
        "quality": lambda d: quality.classify(d, "text", model),
        "fingerprint": lambda d: imatch.fingerprint(d, "text", imatch.lexicon(d, "text"), "fingerprints"),
        "next": lambda d: imatch.next_texts(d.select("doc_id", "text", "lang"), "doc_id", "text", "lang"),
        "shards": lambda d: sharding.assign(d, "doc_id", [1.0, 2.0], ["text"]),
        "toxic": lambda d: toxicity.classify(d, "text", lexicon),
    }


@pytest.fixture(scope="module")
def every(spark, index):
    return operators(spark, index)


NAMES = ["lines", "near", "match", "clean", "tokens", "quality", "fingerprint", "next", "shards", "toxic"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_come_back(docs, every, name):
    out = every[name](docs)
    rows = out.collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(r[0] or 0 for r in ODD)
    assert len({c.lower() for c in out.columns}) == len(out.columns)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(docs, every, name):
    assert every[name](docs.limit(0)).collect() == []


def test_pieces_of_odd_rows(docs):
    rows = packing.pack_documents(docs, "doc_id", "text", packing.vocabulary(), 512).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ODD}
    assert sum(r.piece == 0 for r in rows) == len(ODD)


def test_equal_rows_get_equal_answers(docs, every):
    for name, column in (("tokens", "n_tokens"), ("quality", "score"), ("fingerprint", "fingerprints"), ("toxic", "score"), ("match", "n_hit")):
        got = {str(r[column]) for r in every[name](docs).where("doc_id in (4, 5)").collect()}
        assert len(got) == 1, name
    near = {r.component_id for r in every["near"](docs).where("doc_id in (4, 5)").collect()}
    assert near == {4}


def test_conversations_with_nulls(spark):
    rows = [(None, None, None, None), (1, None, "assistant", None), (1, 2, None, "x"), (1, 2, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    got = {(r.conv_id, r.example, r.loss_length) for r in chat.examples(df).collect()}
    assert got == {(None, 0, 0), (1, 0, 0), (1, 1, 0)}
