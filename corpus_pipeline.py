"""The corpus pipeline over the table of documents: five stages, each one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return
the columns of documents, with n_chars of the text as it then stands.

Defined results: empty tables pass through; a null text is judged for quality as
an empty one, which the share of good texts in the sample decides, and no later
stage drops it; it packs as empty. Columns beyond those of documents go.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, linededup, neardup, packing, quality
from quillspan.llm.common import materialise, prepare, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if the neighbours' vote for quality is below this share: the classifier rejects it.
LEAST_QUALITY = 0.5
#: A document goes if benchmark items cover more of it than this.
MOST_COVERED = 0.5
#: Shorter spans are no passage of an item: items of so few words say nothing of where a text is from.
LEAST_SPAN = 4

#: SQL cannot express the stages; tests hold them against brute force and round trips.
ORACLE_SQL = None


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.quality_model(spark, docs, sf_dir)
    return _documents(quality.classify(docs, "text", model).where(F.col("score") >= LEAST_QUALITY))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, but for their first place in the corpus; a document that held nothing else goes, too."""
    return _documents(linededup.drop_boilerplate(docs, "doc_id", "text", "source", least_words=linededup.LEAST_WORDS).where(~F.col("emptied")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 of five-word shingles, the one with the least id stays.

    Rows are judged each by its own text, also if they share an id or have none;
    of equal rows one stays. Texts without words stay.
    """
    return _documents(neardup.keep_one(docs, neardup.near_groups(docs, "doc_id", "text", 5, (80, 100))))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of at least LEAST_SPAN words that benchmark items share are cut; documents that are mostly such spans go."""
    index = decontaminate.build_index(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return _documents(decontaminate.clean(docs.select(*COLUMNS), "text", index, MOST_COVERED, LEAST_SPAN))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences."""
    return packing.pack_documents(docs, "doc_id", "text", packing.vocabulary())


def _prepared(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality", _prepared(keep_quality)),
    ("line dedup", _prepared(drop_lines)),
    ("near duplicates", _prepared(keep_one_of_near_duplicates)),
    ("decontamination", _prepared(cut_benchmark)),
    ("packing", _prepared(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialise(docs, f"stage{number + 1}")
    return docs
