"""Toxicity by a learnt lexicon: a trie met by Levenshtein automata, hits weighed in context.

Learning, from at most ``PER_CLASS`` labelled texts of either class: word stems
that toxic texts have and others hardly ever do form the lexicon, at most
``MAX_TERMS``. A logistic model over a text's hits is fitted on the same sample.

Words are runs of letters, combining marks and numbers of any script; all other
characters, typographic quotation marks and dashes included, end a word.

Matching: a word hits a stem it begins with, or one that it, or it without an
ending of at most ``SUFFIX`` characters, equals but for one edit (words and
stems of ``EDIT_LENGTH`` characters on). For every distinct word of a slice a
bit-parallel Levenshtein automaton of the word is run along the lexicon's trie,
so shared prefixes of stems are read once. A word whose beginning and end fit no
stem's halves cannot be within one edit of it; numpy sets those aside first, and
every worker process remembers words it has met.

Context: a hit between an opening quotation mark and its closing one, on one
line and both within ``WINDOW`` words, counts as quoted; an apostrophe is no
mark. Hits in each other's windows reinforce each other.

Weights: labelled samples hardly hold quoted or misspelled terms, so the fit
also sees, for every toxic text with hits, its hits made one, made misspelled
(both toxic still) and made quoted (of which only the share ``MEANT`` is taken to
be abuse, the rest a mention). All weights are the fit's own.

Defined results: a null or empty text has no hits; repeated rows score alike;
an empty table gives no rows; without labels the lexicon is empty and every
score is 0.5 or the labels' share; a very long text or word is read whole, in
linear time; of an id that repeats in the documents the least text is learnt
from; further columns are kept and the operator's own output names replace
input columns of those names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm import textops
from quillspan.llm.common import table, without
from quillspan.llm.labelled import remainder, sample

PER_CLASS = 3000
MAX_TERMS = 512
STEM_LENGTHS = range(4, 13)
EDIT_LENGTH = 5
#: Endings that a misspelled word may have beyond a stem.
SUFFIX = 3
#: Of quoted terms, the share taken for abuse.
MEANT = 0.25
#: Words to either side that count as a hit's context.
WINDOW = 8
CACHE_WORDS = 1 << 21
FEATURES = 8

#: A stem's least share of texts in favour of toxic, with classes weighing the same, and its least log-likelihood ratio.
PURITY, EVIDENCE = 0.95, 30.0
#: What a text that has a stem already still counts for the next.
AGAIN = 0.6

#: A stem with unlisted near words in a larger share of clean texts is matched exactly.
EXACT_SHARE = 0.0005
#: Quotation marks: what opens, and what closes it.
QUOTES = {'"': '"', "'": "'", "\u201c": "\u201d", "\u201e": "\u201c\u201d", "\u00ab": "\u00bb", "\u00bb": "\u00ab", "\u2018": "\u2019", "\u201a": "\u2018\u2019"}
_MARKS = re.compile("|".join(sorted(set("".join(QUOTES) + "".join(QUOTES.values())))).encode())


def quoted_spans(line: bytes, word: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of a line between an opening quotation mark and its closing one; ``word``: the bytes that are parts of words.

    A mark opens before what is no space and not after a word, and closes after
    what is no space; a single one closes before no word, else it is an
    apostrophe. An opening mark that stays alone is no mark.
    """
    found = [(m[0].decode(), m.start(), m.end()) for m in _MARKS.finditer(line)]
    out: list[tuple[int, int]] = []
    alone: set[str] = set()
    begin = 0
    while begin < len(found):
        opened: int | None = None
        closed = False
        for k in range(begin, len(found)):
            mark, a, b = found[k]
            tight = b < len(line) and line[b : b + 1] not in b" \t"
            opens = mark in QUOTES and mark not in alone and tight and not (a and word[a - 1])
            if opened is None:
                opened = k if opens else None
                continue
            own, _, inner = found[opened]
            if mark in QUOTES[own] and a > inner and line[a - 1 : a] not in b" \t" and not (mark in "'\u2019" and b < len(line) and word[b]):
                out.append((inner, a))
                begin, closed = k + 1, True
                break
            if mark == own and opens:  # the one before was alone
                opened = k
        if not closed:
            if opened is None:
                break
            alone.add(found[opened][0])  # nothing closes this kind from here on
            begin = opened + 1
    return out


class LexiconTrie:
    """Stems in a trie; a node is {character: node}, with a stem's number under ''."""

    def __init__(self, stems: list[str]):
        self.stems = stems
        self.reach = max(map(len, stems), default=0) + SUFFIX + 2
        self.root: dict = {}
        for number, stem in enumerate(stems):
            node = self.root
            for c in stem:
                node = node.setdefault(c, {})
            node[""] = number

    def match(self, word: str) -> tuple[int, int] | None:
        """(stem, edits): the longest stem the word begins with, else a stem at one edit from the word, without an ending maybe."""
        word = word[: self.reach]  # what follows decides nothing
        n = len(word)
        masks: dict[str, int] = {}
        for j, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << j
        whole, fuzzy, ending = 1 << n, n >= EDIT_LENGTH, max(n - SUFFIX, EDIT_LENGTH)
        best: tuple[int, int, int] | None = None  # edits, -depth, stem
        # Bit j of a state: the word's first j characters are within 0 or 1 edits of the path so far.
        stack = [(self.root, 0, 1, 3 if fuzzy else 0)]
        while stack:
            node, depth, exact, near = stack.pop()
            if "" in node:
                if exact:
                    best = min(best or (9, 0, 0), (0, -depth, node[""]))
                elif near >> ending and depth >= EDIT_LENGTH:
                    best = min(best or (9, 0, 0), (1, -depth, node[""]))
            for c, child in node.items():
                if c == "":
                    continue
                m = masks.get(c, 0)
                exact2 = (exact & m) << 1
                near2 = ((near & m) << 1 | exact | exact << 1 | exact2 << 1 | exact2) & (whole * 2 - 1) if fuzzy else 0
                if exact2 or near2:
                    stack.append((child, depth + 1, exact2, near2))
        return None if best is None else (best[2], best[0])


@dataclass
class Lexicon:
    stems: list[str]
    #: Words one edit from a stem that labelled texts without toxicity have too.
    clean: frozenset[str] = frozenset()
    #: Numbers of stems among whose near words too many are clean: matched exactly only.
    exact: frozenset[int] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def __post_init__(self):
        self.trie = LexiconTrie(self.stems)
        halves: dict[tuple[bool, int], set[int]] = {}
        for stem in self.stems:
            cut = max(1, len(stem) // 2)
            for tail, part in ((False, stem[:cut].encode()[:8]), (True, stem[cut:].encode()[-8 + SUFFIX :])):
                halves.setdefault((tail, len(part)), set()).add(int.from_bytes(part, "big"))
        self.halves = {k: np.array(sorted(v), np.uint64) for k, v in halves.items()}
        self.known = np.zeros(0, np.uint64)
        self.codes = np.zeros(0, np.int32)

    def __getstate__(self):
        return {"stems": self.stems, "clean": self.clean, "exact": self.exact, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def possible(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Words that share their first bytes, or their last ones before an ending, with half a stem."""
        n = ends - starts
        first, last = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        lower = textops.LOWER
        top = len(data) - 1
        for k in range(8):
            head, tail = lower[data[np.minimum(starts + k, top)]].astype(np.uint64), lower[data[np.maximum(ends - 1 - k, 0)]].astype(np.uint64)
            first = first << np.uint64(8) | np.where(k < n, head, 0).astype(np.uint64)
            last |= np.where(k < n, tail, 0).astype(np.uint64) << np.uint64(8 * k)
        out = np.zeros(len(n), bool)
        for (tail, size), values in self.halves.items():
            if not tail:
                out |= (n >= size) & np.isin(first >> np.uint64(8 * (8 - size)), values)
                continue
            for ending in range(SUFFIX + 1):
                out |= (n >= size + ending) & np.isin(last >> np.uint64(8 * ending) & np.uint64((1 << 8 * size) - 1), values)
        return out

    def code(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For distinct words: 0, or twice the stem's number and the edits, and 1."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.codes = self.known[:0], self.codes[:0]
        at = np.searchsorted(self.known, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == keys[inside]
        new = np.flatnonzero(~hit)
        if len(new):
            s, e = starts[new], ends[new]
            codes = np.zeros(len(new), np.int32)
            for k in np.flatnonzero(self.possible(data, s, e)).tolist():
                word = textops.LOWER[data[s[k] : e[k]]].tobytes().decode()
                found = self.trie.match(word)
                if found and not (found[1] and (word in self.clean or found[0] in self.exact)):
                    codes[k] = 2 * found[0] + found[1] + 1
            put = np.searchsorted(self.known, keys[new])
            self.known, self.codes = np.insert(self.known, put, keys[new]), np.insert(self.codes, put, codes)
            at = np.searchsorted(self.known, keys)
        return self.codes[at]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -40, 40)))


#: A hit: stem, edits, whether it is quoted, hits in its window, the word.
Hit = tuple[int, int, bool, int, str]


def hits(column: pa.Array, lexicon: Lexicon) -> Iterator[tuple[int, int, list[list[Hit]], np.ndarray]]:
    """For slices of a batch: first, last + 1, each text's hits, numbers of words."""
    for i, j, raw, offsets in textops.slices(column):
        data = textops.blank_marks(raw)
        starts, ends, firsts = textops.word_bounds(data, offsets, textops.LOWER, textops.ALNUM)
        found: list[list[Hit]] = [[] for _ in range(j - i)]
        if len(starts) and lexicon.stems:
            keys = textops.word_hashes(data, starts, ends, textops.LOWER)
            distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
            codes = lexicon.code(distinct, data, starts[first], ends[first])[back]
            at = np.flatnonzero(codes)
            doc = np.searchsorted(firsts, at, "right") - 1
            lines = np.concatenate([np.flatnonzero(raw == 10), offsets[1:]]) if len(at) else np.zeros(0, np.int64)
            lines.sort()
            line_end, spans, begun = -1, [], []
            for place, k in zip(at.tolist(), doc.tolist(), strict=True):
                a, b = int(starts[place]), int(ends[place])
                if a >= line_end:  # another line
                    n = int(np.searchsorted(lines, a, "right"))
                    line_end = int(lines[n])
                    begin = max(int(offsets[k]), int(lines[n - 1]) if n else 0)
                    own = textops.ALNUM[textops.LOWER[data[begin:line_end]]]
                    spans = [(begin + x, begin + y) for x, y in quoted_spans(raw[begin:line_end].tobytes(), own)]
                    begun = [x for x, _ in spans]
                lo, hi = max(place - WINDOW, int(firsts[k])), min(place + WINDOW, int(firsts[k + 1]) - 1)
                from_, to = int(ends[lo - 1]) if lo > firsts[k] else 0, int(starts[hi + 1]) if hi + 1 < firsts[k + 1] else len(raw)
                near = int(np.searchsorted(at, hi, "right") - np.searchsorted(at, lo)) - 1
                code = int(codes[place]) - 1
                span = bisect.bisect_right(begun, a) - 1  # spans are apart and in order
                quoted = span >= 0 and from_ <= spans[span][0] and b <= spans[span][1] <= to
                found[k].append((code // 2, code % 2, quoted, near, textops.LOWER[data[a:b]].tobytes().decode()))
        yield i, j, found, np.diff(firsts)


def features_of(found: list[Hit], n_words: int) -> list[float]:
    """Whether there are plain true hits, plain misspelled ones, quoted ones; how many of each; how close together; how dense."""
    true, wrong, quoted = sum(1 for h in found if not h[2] and not h[1]), sum(1 for h in found if not h[2] and h[1]), sum(1 for h in found if h[2])
    counts = [true, wrong, quoted]
    near = sum(h[3] for h in found if not h[2])
    return [*(float(n > 0) for n in counts), *map(np.log1p, counts), np.log1p(near), np.log1p(100.0 * (true + wrong) / max(n_words, 1))]


def imagined(found: list[Hit], n_words: int) -> list[tuple[float, float, list[float]]]:
    """Labels, their shares and features of a toxic text's variants: with one hit alone, with its hits misspelled, with its hits quoted."""
    plain = [h for h in found if not h[2]]
    if not plain:
        return []
    stem, edits, _, _, word = plain[0]
    quoted = features_of([(s, e, True, near, w) for s, e, _, near, w in plain], n_words)
    return [
        (1.0, 1.0, features_of([(stem, edits, False, 0, word)], n_words)),
        (1.0, 1.0, features_of([(s, 1, False, near, w) for s, _, _, near, w in plain], n_words)),
        (1.0, MEANT, quoted),
        (0.0, 1.0 - MEANT, quoted),
    ]


def lexicon_stems(rows: DataFrame) -> list[str]:
    """Stems from a bounded sample (key, text, label).

    Candidates are told by document frequencies in either class. They are taken
    one by one, the one with the most toxic texts first, where a text counts
    ``AGAIN`` times as much for every stem it already has: words that merely
    stand in copies of a toxic text have nothing left once its real terms are
    taken. Candidates and texts are bounded, so their incidence is.
    """
    rows = rows.groupBy("text", "label").agg(F.min("key").alias("key"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, other = counts.get(1, 0), max(counts.get(0, 0), 1)
    if not toxic:
        return []
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.split(lower, r"[^\p{L}\p{M}\p{N}]+"))
    long = F.explode(F.filter(words, lambda w: F.length(w) >= min(STEM_LENGTHS))).alias("w")
    heads = F.array_distinct(F.transform(F.array(*map(F.lit, STEM_LENGTHS)), lambda n: F.substring(F.col("w"), F.lit(1), n)))
    stems = rows.select(F.xxhash64("key").alias("d"), "label", long).select("d", "label", F.explode(heads).alias("stem")).distinct()
    by = stems.groupBy("stem").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    a, b, base = F.col("a"), F.col("b"), toxic / (toxic + other)

    def term(n, p):  # n ln(n / expected), 0 for none
        return F.when(n > 0, n * F.log(n / ((a + b) * p))).otherwise(0.0)

    share = (a / toxic) / (a / toxic + b / other)
    strong = (share >= PURITY) & (2 * (term(a, base) + term(b, 1 - base)) >= EVIDENCE)
    chosen = F.broadcast(by.where(strong).orderBy(F.desc("a"), "stem").limit(8 * MAX_TERMS).select("stem"))
    texts_of = {r["stem"]: set(r["ds"]) for r in stems.where("label = 1").join(chosen, "stem").groupBy("stem").agg(F.collect_list("d").alias("ds")).collect()}
    weight = dict.fromkeys((d for ds in texts_of.values() for d in ds), 1.0)
    least = EVIDENCE / (-2 * np.log(base))
    kept: list[str] = []
    while texts_of and len(kept) < MAX_TERMS:
        support = {s: sum(weight[d] for d in ds) for s, ds in texts_of.items()}
        stem = max(support, key=lambda s: (support[s], s))
        if support[stem] < least:
            break
        while ext := [s for s in texts_of if len(s) == len(stem) + 1 and s.startswith(stem) and len(texts_of[s]) >= 0.9 * len(texts_of[stem])]:
            stem = max(ext, key=lambda s: (len(texts_of[s]), s))  # as long a stem as nearly the same texts have
        kept.append(stem)
        for d in texts_of[stem]:
            weight[d] *= AGAIN
        texts_of = {s: ds for s, ds in texts_of.items() if support[s] >= least and not s.startswith(stem) and not stem.startswith(s)}
    return kept


def fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.003) -> np.ndarray:
    """Logistic weights, the last the intercept, rows weighing their share and classes the same; by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = share * np.where(y == 1, 0.5 / max(share[y == 1].sum(), 1e-9), 0.5 / max(share[y == 0].sum(), 1e-9)) * share.sum()
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(rows: DataFrame) -> Lexicon:
    """The lexicon and its weights from a bounded sample (key, text, label).

    Clean near words come from one half of the sample (by hash of the key);
    stems that still have near words in over ``EXACT_SHARE`` of the clean texts
    of the other half are matched exactly only. Weights are fitted on all.
    """
    lexicon = Lexicon(lexicon_stems(rows))
    hashed = rows.select("text", "label", F.pmod(F.xxhash64("key"), F.lit(2)).cast("int").alias("half"))

    @textops.trimmed
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found, _ in hits(batch.column(0), lexicon):
                words = [sorted({(h[0], h[4]) for h in f if h[1]}) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(i, j - i), pa.array([[w[0] for w in ws] for ws in words], pa.list_(pa.int32())), pa.array([[w[1] for w in ws] for ws in words], pa.list_(pa.string()))],
                    ["half", "stems", "words"],
                )

    texts = hashed.where("label = 0").mapInArrow(near, "half int, stems array<int>, words array<string>").toArrow().to_pylist()
    lexicon.clean = frozenset(w for t in texts if t["half"] == 0 for w in t["words"])
    second = [t for t in texts if t["half"] == 1]
    counts = np.zeros(max(len(lexicon.stems), 1), int)
    for t in second:
        for k in {k for k, w in zip(t["stems"], t["words"], strict=True) if w not in lexicon.clean}:
            counts[k] += 1
    lexicon.exact = frozenset(np.flatnonzero(counts > max(1, EXACT_SHARE * len(second))).tolist())
    lexicon.clean |= frozenset(w for t in second for w in t["words"])
    lexicon = Lexicon(lexicon.stems, lexicon.clean, lexicon.exact)

    @textops.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for i, j, found, n in hits(batch.column(0), lexicon):
                x = []
                for y, f, k in zip(labels[i:j], found, n, strict=True):
                    x.append((float(y), 1.0, features_of(f, int(k))))
                    x += imagined(f, int(k)) if y else []
                columns = [pa.array(c) for c in list(zip(*x, strict=True))[:2]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([v[2] for v in x], pa.list_(pa.float64()))], ["label", "share", "features"])

    labels = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if len(labels) < 2:
        lexicon.weights[-1] = 0.0 if not labels else (4.0 if labels[0] else -4.0)
        return lexicon
    got = rows.select("text", "label").mapInArrow(run, "label double, share double, features array<double>").toArrow()
    x = np.array(got["features"].to_pylist(), float).reshape(len(got), FEATURES)
    y, share = np.array(got["label"].to_pylist(), float), np.array(got["share"].to_pylist(), float)
    order = np.lexsort((*x.T, y, share))  # so that sums don't depend on where rows were
    lexicon.weights = fit(x[order], y[order], share[order])
    return lexicon


def classify(df: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """All columns with ``score``, ``n_hits`` and ``n_quoted`` added."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    kept = without(df, "score", "n_hits", "n_quoted")
    at = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType()), T.StructField("n_quoted", T.LongType())])

    @textops.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i, j, found, n in hits(batch.column(at), own):
                x = np.array([features_of(f, int(k)) for f, k in zip(found, n, strict=True)], float).reshape(-1, FEATURES)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own.score(x)), pa.array([len(f) for f in found], pa.int64()), pa.array([sum(h[2] for h in f) for f in found], pa.int64())],
                    [*part.schema.names, "score", "n_hits", "n_quoted"],
                )

    return kept.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sample(docs, table(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 5) != 0, PER_CLASS)
    return classify(docs, "text", learn(rows)).select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_hits",
        "n_quoted",
    )
