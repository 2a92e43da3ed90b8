"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are hashed word forms (letter case, length, digits, marks at the
end, whether it repeats the word before) and hashed words. Term counts are
damped, weighted by inverse document frequency, scaled to length one in each of
the two spaces, and projected onto the leading singular vectors of a bounded
sample of labelled texts: at most ``PER_CLASS`` of either class. The sample's
vectors, at most 2 x PER_CLASS x ``RANK`` numbers, are broadcast; every text's
cosine with each of them is computed exactly, a block of texts at a time, and
the labels of the ``NEIGHBOURS`` nearest vote with weights that grow with
similarity. Cosines count to ``DECIMALS``, so that scores don't depend on a
text's place in a block. Texts without words score by their (empty) vector: all neighbours
tie at cosine 0 and the share of label 1 in the sample decides.

Defined results: null texts are empty; ties of similarity go to the earlier
sample row (by hash of the key); repeated rows get equal scores wherever they
are; a very long text is counted whole; an empty table gives no rows; without
labels every score is 0.5; of an id that repeats in the documents the least
text is learnt from; further columns are kept by ``classify`` and its own output
names replace input columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm import textops
from quillspan.llm.common import table, without
from quillspan.llm.labelled import remainder, sample

FORMS, WORDS = 512, 512
WORD_WEIGHT = 0.35
RANK = 48
NEIGHBOURS = 15
#: At most so many labelled rows of either class are learnt from.
PER_CLASS = 2000
BLOCK = 256
DECIMALS = 9

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_MARK = np.zeros(256, np.int64)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1


def _within(table_: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(table_[data])])
    return sums[ends] - sums[starts]


def term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """For slices of a batch: first, last + 1, counts of FORMS + WORDS hashed terms for each text."""
    width = FORMS + WORDS
    for i, j, data, offsets in textops.slices(column, textops.SPAN):
        starts, ends, firsts = textops.word_bounds(data, offsets, textops.LOWER, textops.NOT_SPACE)
        if not len(starts):
            yield i, j, np.zeros((j - i, width), np.float32)
            continue
        words = textops.word_hashes(data, starts, ends, textops.LOWER)
        long = ends - starts
        upper, digit, mark = (_within(t, data, starts, ends) for t in (_UPPER, _DIGIT, _MARK))
        last = data[ends - 1].astype(np.int64)
        same = np.concatenate([[False], words[1:] == words[:-1]])
        same[firsts[:-1][firsts[:-1] < len(words)]] = False
        form = np.minimum(upper, 2) + 3 * (upper + mark >= long) + 6 * np.minimum(digit, 3) + 24 * np.minimum(mark, 4) + 120 * np.minimum(long, 15)
        form = (form * 131 + np.where(_MARK[last] > 0, last, 0)) * 2 + same
        doc = np.repeat(np.arange(j - i), np.diff(firsts)) * width
        at = np.concatenate([doc + (textops.mix(form.astype(np.uint64)) % np.uint64(FORMS)).astype(np.int64), doc + FORMS + (words % np.uint64(WORDS)).astype(np.int64)])
        yield i, j, np.bincount(at, minlength=(j - i) * width).reshape(j - i, width).astype(np.float32)


@dataclass
class Neighbours:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float64)) * self.idf
        for part, weight in ((slice(0, FORMS), 1.0), (slice(FORMS, None), WORD_WEIGHT)):
            norm = np.linalg.norm(x[:, part], axis=1, keepdims=True)
            x[:, part] *= weight / np.maximum(norm, 1e-12)
        return x

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = self.weigh(counts) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest neighbours."""
        out = np.full(len(counts), 0.5)
        n = len(self.labels)
        if not n:
            return out
        k = min(NEIGHBOURS, n)
        for i in range(0, len(counts), BLOCK):
            near = np.round(self.embed(counts[i : i + BLOCK]) @ self.vectors.T, DECIMALS)
            floor = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
            above, level = near > floor, near == floor
            chosen = above | (level & (level.cumsum(axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))
            top = np.nonzero(chosen)[1].reshape(-1, k)  # k of every row, in the sample's order
            w = np.maximum(np.take_along_axis(near, top, axis=1), 0.0) ** 4
            s = (w * self.labels[top]).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-300)
            out[i : i + BLOCK] = np.where(w.any(axis=1), s, self.labels.mean())
        return np.clip(out, 0.0, 1.0)


def learn(rows: DataFrame) -> Neighbours:
    """From a bounded sample (key, text, label); its term counts, not its texts, come to the driver."""

    @textops.trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts in term_counts(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([np.minimum(c, 65535).astype(np.uint16).tobytes() for c in counts], pa.binary())],
                    ["h", "label", "counts"],
                )

    got = rows.select(F.xxhash64("key"), "text", "label").mapInArrow(count, "h long, label int, counts binary").toArrow().sort_by("h")
    labels = np.array(got["label"].to_pylist(), np.float64)
    counts = np.stack([np.frombuffer(c, np.uint16) for c in got["counts"].to_pylist()]).astype(np.float32) if len(labels) else np.zeros((0, FORMS + WORDS), np.float32)
    idf = np.log((1.0 + len(counts)) / (1.0 + (counts > 0).sum(axis=0))) + 0.1
    model = Neighbours(idf, np.zeros((FORMS + WORDS, RANK)), np.zeros((0, RANK)), labels)
    if len(labels):
        x = model.weigh(counts)
        _, basis = np.linalg.eigh(x.T @ x)
        model.basis = np.ascontiguousarray(basis[:, ::-1][:, :RANK])
        model.vectors = model.embed(counts)
    return model


def classify(df: DataFrame, text: str, model: Neighbours) -> DataFrame:
    """All columns with ``score`` added."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = without(df, "score")
    at = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    @textops.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i, j, counts in term_counts(batch.column(at)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.score(counts))], [*part.schema.names, "score"])

    return kept.mapInArrow(run, schema)


def quality_model(spark: SparkSession, documents: DataFrame, sf_dir: str) -> Neighbours:
    """Learnt from labelled rows outside the held-out fold."""
    return learn(sample(documents, table(spark, sf_dir, "labels"), "quality", remainder("doc_id", 3) != 1, PER_CLASS))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, "text", quality_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
