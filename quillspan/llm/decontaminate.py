"""Benchmark decontamination with generalised suffix automata of the test items.

The items are dealt to parts of about ``PART_BYTES`` by a hash; a task builds each
part's generalised suffix automaton over its items' numbered words and packs it
into arrays (transitions in order of states, links, lengths, windows). Parts are
broadcast one by one; training texts stream through every part by Arrow batches
and the parts' hits are united, so a benchmark of any size gives exact results.
A worker keeps at most ``HELD_BYTES`` of parts in memory and reads the others
from its executor's disk for each batch.

At every word the automaton knows the longest suffix that occurs in an item, and
where that reaches a window's length the window's words are hit. Words that
cannot be part of any hit are skipped by numpy first: a hit needs a run of
consecutive word pairs, all of which occur in an item, as long as the shortest
window. Windows of one word are looked up by numpy alone.

A window is ``size`` consecutive words of an item; a shorter item, but not an
empty one, is one window of its own length.

Memory: a part's arrays take about 60 bytes a word; building takes about 150.

Defined results: a null or empty text has no words and is clean; a null or
empty item has no windows; items with equal words are all reported; repeated
rows are each reported; an empty benchmark hits nothing; a very long text or
word is read whole. ``match`` ignores further input columns; ``clean`` keeps them
all, whatever their names, and adds none.
"""

from __future__ import annotations

import bisect
import hashlib
import pickle
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import textops
from quillspan.llm.common import table

WINDOW = 10
#: Bytes of items that a part is made of, about; it has at most half as many words.
PART_BYTES = 1 << 20
#: Bytes of parts that a worker process keeps in memory.
HELD_BYTES = 256 << 20


class SuffixAutomaton:
    """The minimal automaton of all factors of the sequences added.

    Most states have one way on: it is kept in arrays, further ones in a
    dictionary of the state's own.
    """

    def __init__(self):
        self.word, self.to, self.link, self.length = (array("i", [-1]) for _ in range(4))
        self.length[0] = 0
        self.more: dict[int, dict[int, int]] = {0: {}}

    def get(self, state: int, word: int) -> int:
        """The state after one more word, -1 for none."""
        if self.word[state] == word:
            return self.to[state]
        more = self.more.get(state)
        return more.get(word, -1) if more else -1

    def _set(self, state: int, word: int, to: int) -> None:
        if state and self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _state(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """A copy of ``child`` for its factors of at most the parent's length and one."""
        clone = self._state(self.length[parent] + 1, self.link[child])
        self.word[clone], self.to[clone] = self.word[child], self.to[child]
        if child in self.more:
            self.more[clone] = dict(self.more[child])
        self.link[child] = clone
        while parent != -1 and self.get(parent, word) == child:
            self._set(parent, word, clone)
            parent = self.link[parent]
        return clone

    def extend(self, last: int, word: int) -> int:
        """The state of the sequence that ended in ``last``, longer by a word."""
        known = self.get(last, word)
        if known != -1:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p != -1 and self.get(p, word) == -1:
            self._set(p, word, new)
            p = self.link[p]
        if p != -1:
            q = self.get(p, word)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new


@dataclass
class Part:
    """Some items' automaton in arrays, and what each window's state stands for."""

    size: int
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: Ways on from the root by word; those of state s > 0 are ``starts[s]`` to ``starts[s + 1]``, in order of words.
    root: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int32))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    to: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    link: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int32))
    length: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    #: Pairs of words that follow one another in an item, and the fewest words of a window of two or more.
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shortest: int = 2
    #: Rows (window state, width, item) in that order; for every state the first row of the nearest state with windows on its chain of links, or -1.
    windows: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int32))
    nearest: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int32))
    items: list[str] = field(default_factory=list)
    #: Windows of one word: hashes in order, and their items.
    single: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    single_items: list[list[int]] = field(default_factory=list)

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in self.__dict__.values() if isinstance(v, np.ndarray)) + sum(len(i) + 60 for i in self.items)

    @classmethod
    def build(cls, items: Iterable[tuple[str, np.ndarray]], size: int) -> Part:
        """From (item, word hashes)."""
        kept = sorted(((i, w) for i, w in items if len(w)), key=lambda x: (x[0], x[1].tobytes()))
        out = cls(size, items=sorted({i for i, _ in kept}))
        number = {item: n for n, item in enumerate(out.items)}
        alone: dict[int, set[int]] = {}
        for item, w in kept:
            if min(size, len(w)) == 1:
                for h in w.tolist():
                    alone.setdefault(h, set()).add(number[item])
        out.single = np.array(sorted(alone), np.uint64)
        out.single_items = [sorted(alone[h]) for h in out.single.tolist()]
        long = [(number[i], w) for i, w in kept if min(size, len(w)) > 1]
        if not long:
            return out
        out.vocabulary = np.unique(np.concatenate([w for _, w in long]))
        a = SuffixAutomaton()
        numbered = [(i, np.searchsorted(out.vocabulary, w).astype(np.int32)) for i, w in long]
        for _, w in numbered:
            last = 0
            for word in w.tolist():
                last = a.extend(last, word)
        out._pack(a)
        del a
        pairs = [w[:-1].astype(np.int64) * (len(out.vocabulary) + 1) + w[1:] for _, w in numbered]
        out.pairs = np.unique(np.concatenate(pairs))
        out.shortest = min(min(size, len(w)) for _, w in numbered)
        out._mark(numbered)
        return out

    def _pack(self, a: SuffixAutomaton) -> None:
        n = len(a.length)
        self.link, self.length = np.array(a.link, np.int32), np.array(a.length, np.int32)
        self.root = np.full(len(self.vocabulary), -1, np.int32)
        for word, to in a.more.pop(0).items():
            self.root[word] = to
        first = np.array(a.word, np.int32)
        own = np.flatnonzero(first >= 0)
        further = [(s, w, t) for s, more in a.more.items() for w, t in more.items()]
        more = np.array(further, np.int32).reshape(-1, 3)
        state = np.concatenate([own.astype(np.int32), more[:, 0]])
        word = np.concatenate([first[own], more[:, 1]])
        to = np.concatenate([np.array(a.to, np.int32)[own], more[:, 2]])
        order = np.lexsort((word, state))
        self.words, self.to = word[order], to[order]
        self.starts = np.searchsorted(state[order], np.arange(n + 1)).astype(np.int32)

    def _mark(self, numbered: list[tuple[int, np.ndarray]]) -> None:
        rows = array("i")
        for item, w in numbered:
            width = min(self.size, len(w))
            state, matched = 0, 0
            for word in w.tolist():
                state, matched = self.step(state, matched, word)
                if matched >= width:  # the state of the last words alone
                    while self.length[self.link[state]] >= width:
                        state = int(self.link[state])
                    matched = width
                    rows.extend((state, width, item))
        self.windows = np.unique(np.array(rows, np.int32).reshape(-1, 3), axis=0)
        nearest = np.full(len(self.length), -1, np.int32)
        states, at = np.unique(self.windows[:, 0], return_index=True)
        nearest[states] = at
        # By length, so that a link's own entry is there before it is asked for.
        for state in np.argsort(self.length, kind="stable").tolist():
            if state and nearest[state] < 0:
                nearest[state] = nearest[self.link[state]]
        self.nearest = nearest

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """The longest suffix of what was read, with one more word, that is a factor; and its length."""
        starts, words = self.starts, self.words
        while state:
            lo, hi = starts[state], starts[state + 1]
            if hi - lo > 1:
                lo = bisect.bisect_left(words, word, lo, hi)
            if lo < hi and words[lo] == word:
                return int(self.to[lo]), matched + 1
            state = int(self.link[state])
            matched = int(self.length[state])
        following = int(self.root[word])
        return (0, 0) if following < 0 else (following, 1)

    def runs(self, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Word numbers, and the ranges of words that may hold windows of two words or more."""
        if not len(self.vocabulary) or len(hashes) < 2:
            return np.zeros(len(hashes), np.int64), []
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        joined = np.zeros(len(hashes) - 1, bool)
        both = np.flatnonzero(known[:-1] & known[1:])
        if len(both):
            code = at[both] * (len(self.vocabulary) + 1) + at[both + 1]
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[both] = self.pairs[place] == code
        inner = firsts[(firsts > 0) & (firsts < len(hashes))]
        joined[inner - 1] = False  # not across documents
        starts = np.flatnonzero(joined & np.concatenate([[True], ~joined[:-1]]))
        ends = np.flatnonzero(joined & np.concatenate([~joined[1:], [True]])) + 2
        long = ends - starts >= self.shortest
        return at, list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int], list[int]]:
        """Hit windows as ranges of words, the items they belong to, and the matched length at every word."""
        hits, items, lengths = [], set(), []
        state, matched = 0, 0
        for i, word in enumerate(words):
            state, matched = self.step(state, matched, word)
            lengths.append(matched)
            row = int(self.nearest[state])
            while row >= 0:
                here = int(self.windows[row, 0])
                last = -1
                while row < len(self.windows) and self.windows[row, 0] == here:
                    width = int(self.windows[row, 1])
                    if width <= matched:
                        if width != last:
                            hits.append((i + 1 - width, i + 1))
                            last = width
                        items.add(int(self.windows[row, 2]))
                    row += 1
                row = int(self.nearest[self.link[here]])
        return hits, items, lengths


@dataclass
class ItemIndex:
    """The parts of a benchmark, as broadcasts with their sizes in bytes."""

    parts: list[tuple[Broadcast, int]]
    held_bytes: int = HELD_BYTES

    def each(self) -> Iterator[Part]:
        """All parts, one at a time; those beyond ``held_bytes`` are let go after use and read again from the executor's disk."""
        held = 0
        for shared, size in self.parts:
            yield shared.value
            held += size
            if held > self.held_bytes:
                shared.__dict__.pop("_value", None)


@dataclass
class Found:
    """What some documents' words hit: for each document ranges of words, items, and the longest match."""

    ranges: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    items: dict[int, set[str]] = field(default_factory=dict)
    longest: dict[int, int] = field(default_factory=dict)


def find(index: ItemIndex, hashes: np.ndarray, firsts: np.ndarray) -> Found:
    """Ranges are of all words handed in; ``firsts``: where each document's words begin."""
    out = Found()
    for part in index.each():
        if len(part.single) and len(hashes):
            at = np.minimum(np.searchsorted(part.single, hashes), len(part.single) - 1)
            places = np.flatnonzero(part.single[at] == hashes)
            of = np.searchsorted(firsts, places, "right") - 1
            for place, k, n in zip(places.tolist(), of.tolist(), at[places].tolist(), strict=True):
                out.ranges.setdefault(k, []).append((place, place + 1))
                out.items.setdefault(k, set()).update(part.items[i] for i in part.single_items[n])
                out.longest[k] = max(out.longest.get(k, 0), 1)
        numbers, ranges = part.runs(hashes, firsts)
        for a, b in ranges:
            hits, items, lengths = part.scan(numbers[a:b].tolist())
            k = int(np.searchsorted(firsts, a, "right")) - 1
            out.longest[k] = max(out.longest.get(k, 0), max(lengths))
            if hits:
                out.ranges.setdefault(k, []).extend((a + x, a + y) for x, y in hits)
                out.items.setdefault(k, set()).update(part.items[i] for i in items)
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in textops.slices(column):
        starts, ends, firsts = textops.word_bounds(data, offsets, textops.LOWER, textops.ALNUM)
        yield i, j, starts, ends, firsts, textops.word_hashes(data, starts, ends, textops.LOWER)


def build_index(items: DataFrame, key: str, text: str, size: int = WINDOW, part_bytes: int = PART_BYTES, held_bytes: int = HELD_BYTES) -> ItemIndex:
    """The automata of the items' parts; each part's arrays pass the driver once."""
    sc = items.sparkSession.sparkContext
    said = items.select(F.col(key).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    volume = said.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-volume // part_bytes))
    dealt = said.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))

    def build(group: pa.Table) -> pa.Table:
        words: list[tuple[str, np.ndarray]] = []
        names = [str(i) for i in group["item"].to_pylist()]
        for chunk, begin in _chunks(group["text"]):
            for i, _, _, _, firsts, hashes in words_of(chunk):
                words += [(names[begin + i + k], hashes[a:b].copy()) for k, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True))]
        return pa.table({"part": group["part"].slice(0, 1), "built": pa.array([pickle.dumps(Part.build(words, size))], pa.binary())})

    built = dealt.groupBy("part").applyInArrow(build, "part long, built binary")
    out = []
    for row in built.toLocalIterator():
        part = pickle.loads(row["built"])
        shared = sc.broadcast(part)
        out.append((shared, part.nbytes))
        shared.__dict__.pop("_value", None)  # the driver's copy; a file of it stays
    return ItemIndex(out, held_bytes)


def _chunks(column: pa.ChunkedArray) -> Iterator[tuple[pa.Array, int]]:
    begin = 0
    for chunk in column.chunks:
        yield chunk, begin
        begin += len(chunk)


def match(df: DataFrame, key: str, text: str, index: ItemIndex) -> DataFrame:
    """Per text: key, n_words, n_hit, spans (byte ranges that hits cover, one array of start, end, words per span), longest, items."""
    kind = df.schema[key].dataType.simpleString()

    @textops.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, starts, ends, firsts, hashes in words_of(batch.column(1)):
                found = find(index, hashes, firsts)
                begin = textops.utf8(batch.column(1).slice(i, j - i))[1] if found.ranges else np.zeros(j - i, np.int64)
                spans = []
                n_hit = np.zeros(j - i, np.int64)
                for k in range(j - i):
                    whole = merged(found.ranges.get(k, []))
                    n_hit[k] = sum(y - x for x, y in whole)
                    spans.append([[int(starts[x] - begin[k]), int(ends[y - 1] - begin[k]), y - x] for x, y in whole])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(firsts), pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                        pa.array([found.longest.get(k, 0) for k in range(j - i)], pa.int64()),
                        pa.array([sorted(found.items.get(k, ())) for k in range(j - i)], pa.list_(pa.string())),
                    ],
                    [key, "n_words", "n_hit", "spans", "longest", "items"],
                )

    fields = f"`{key}` {kind}, n_words long, n_hit long, spans array<array<long>>, longest long, items array<string>"
    return df.select(key, text).mapInArrow(run, fields)


def clean(df: DataFrame, text: str, index: ItemIndex, max_coverage: float = 0.5, min_span: int = 1) -> DataFrame:
    """The rows with hit spans of at least ``min_span`` words cut out; rows of which such spans are more than ``max_coverage`` go.

    All columns are kept; a cut leaves one space.
    """
    schema = df.schema
    at = df.columns.index(text)

    @textops.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, starts, ends, firsts, hashes in words_of(batch.column(at)):
                found = find(index, hashes, firsts)
                part = batch.slice(i, j - i)
                if found.ranges:
                    data, offsets = textops.utf8(part.column(at))
                    raw = data.tobytes()
                    keep = np.ones(j - i, bool)
                    texts = part.column(at).to_pylist()
                    for k, ranges in found.ranges.items():
                        whole = [s for s in merged(ranges) if s[1] - s[0] >= min_span]
                        if sum(y - x for x, y in whole) > max_coverage * (firsts[k + 1] - firsts[k]):
                            keep[k] = False
                        pieces, begin = [], int(offsets[k])
                        for x, y in whole:
                            pieces.append(raw[begin : starts[x]])
                            begin = int(ends[y - 1])
                        pieces.append(raw[begin : offsets[k + 1]])
                        texts[k] = b" ".join(pieces).decode() if whole else texts[k]
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.column(at).type)).filter(pa.array(keep))
                yield part

    return df.mapInArrow(run, schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "benchmark"), "item_id", "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return match(docs, "doc_id", "text", index).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least({WINDOW}, len(ws)) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark)),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS g
      FROM b, unnest(generate_series(1, len(ws) - n + 1)) AS t(i) WHERE n > 0),
p AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g
      FROM d, (SELECT DISTINCT n FROM w) z, unnest(generate_series(1, len(ws) - n + 1)) AS t(i) WHERE len(ws) >= n),
h AS (SELECT p.* FROM p SEMI JOIN w USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS place FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h JOIN w USING (n, g)) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]], size: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same by comparing every window with every place; for tests."""
    import re

    def split(s: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))

    windows = []
    for item, said in items:
        w = split(said)
        width = min(size, len(w))
        windows += [(item, tuple(w[i : i + width])) for i in range(len(w) - width + 1) if width]
    out = []
    for said in texts:
        w, hit, found = split(said), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()))
    return out
