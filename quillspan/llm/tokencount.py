"""Token counts under a unigram model, by dynamic programming along a trie of distinct pre-tokens.

The vocabulary is a public file's; its pieces' scores as a unigram model are
-log(rank + 1) by their order in it, one for each white-space delimited word
(the pre-token) with the word mark before it. A character that is no piece is
spelt in bytes, a token each.

The distinct pre-tokens of a slice of texts are put in order, which is a walk
through their trie: the best score of a segmentation of a prefix depends on the
prefix alone, so it is computed once and kept on the stack for all words below
it; the pieces that end at a node come from an automaton of the vocabulary whose
state is kept beside it. The token count of the best segmentation is stored at
the node where a word ends; ties of score go to fewer tokens. Worker processes
remember the counts of words they have met, in a bounded table.

Defined results: a null, empty or blank text has no tokens; repeated rows count
alike; an empty table gives no rows; further columns are kept and the operator's
own output names replace input columns of those names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspan.llm import textops
from quillspan.llm.common import table, without

MARK = "▁"
CACHE_WORDS = 1 << 21
#: A byte costs this much more than the rarest piece.
BYTE_PENALTY = 2.0


class PieceAutomaton:
    """The pieces' Aho-Corasick automaton; moves are resolved when first made."""

    def __init__(self, scores: dict[str, float]):
        self.moves: list[dict[str, int]] = [{}]
        ends: list[list[tuple[int, float]]] = [[]]
        for piece, score in scores.items():
            state = 0
            for c in piece:
                if c not in self.moves[state]:
                    self.moves[state][c] = len(self.moves)
                    self.moves.append({})
                    ends.append([])
                state = self.moves[state][c]
            ends[state].append((len(piece), score))
        self.back = [0] * len(self.moves)
        order = [0]
        for state in order:
            for c, child in self.moves[state].items():
                order.append(child)
                if state:
                    self.back[child] = self._move(self.back[state], c)
                    ends[child] = ends[child] + ends[self.back[child]]
        self.resolved: dict[tuple[int, str], int] = {}
        #: Lengths and scores of the pieces that end where a state is.
        self.ends = [tuple(e) for e in ends]

    def _move(self, state: int, c: str) -> int:
        while True:
            to = self.moves[state].get(c)
            if to is not None:
                return to
            if not state:
                return 0
            state = self.back[state]

    def move(self, state: int, c: str) -> int:
        to = self.moves[state].get(c)
        if to is None:
            to = self.resolved.setdefault((state, c), self._move(state, c)) if len(self.resolved) < 4_000_000 else self._move(state, c)
        return to

class TrieCounter:
    def __init__(self, scores: dict[str, float]):
        self.pieces = PieceAutomaton(scores)
        self.byte = min(scores.values()) - BYTE_PENALTY
        self.known = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int32)

    def count_sorted(self, words: Iterable[str]) -> Iterator[int]:
        """Token counts of words that come in order; what a word shares with the one before is not computed again."""
        move, ends, byte = self.pieces.move, self.pieces.ends, self.byte
        root = move(0, MARK)
        start = max(((s, -1) for n, s in ends[root] if n == 1), default=(byte * 3, -3))
        states, best, used = [0, root], [0.0, start[0]], [0, -start[1]]
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 2 :], best[shared + 2 :], used[shared + 2 :]
            for at in range(shared, len(word)):
                c = word[at]
                state = move(states[at + 1], c)
                states.append(state)
                top, tokens, single = -math.inf, 0, False
                for n, score in ends[state]:
                    if n == 1:
                        single = True
                    v, u = best[at + 2 - n] + score, used[at + 2 - n] + 1
                    if v > top or (v == top and u < tokens):
                        top, tokens = v, u
                if not single:
                    spelt = len(c.encode())
                    v, u = best[at + 1] + spelt * byte, used[at + 1] + spelt
                    if v > top or (v == top and u < tokens):
                        top, tokens = v, u
                best.append(top)
                used.append(tokens)
            before = word
            yield used[len(word) + 1]

    def of(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts of distinct words, given their hashes in order and their places."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.counts = self.known[:0], self.counts[:0]
        at = np.searchsorted(self.known, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == keys[inside]
        new = np.flatnonzero(~hit)
        if len(new):
            words = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            order = sorted(range(len(words)), key=words.__getitem__)
            counts = np.zeros(len(new), np.int32)
            counts[order] = np.fromiter(self.count_sorted(words[k] for k in order), np.int32, len(words))
            put = np.searchsorted(self.known, keys[new])
            self.known, self.counts = np.insert(self.known, put, keys[new]), np.insert(self.counts, put, counts)
            at = np.searchsorted(self.known, keys)
        return self.counts[at]


def unigram_scores(path: str) -> dict[str, float]:
    """Pieces of a public vocabulary that can stand in a pre-token, with -log(rank + 1); controls, bytes and unknown have none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and MARK not in piece[1:]:
            out.setdefault(piece, -math.log(i + 1))
    return out


_counters: dict[str, TrieCounter] = {}


def counter(path: str) -> TrieCounter:
    if path not in _counters:
        _counters[path] = TrieCounter(unigram_scores(path))
    return _counters[path]


def count_tokens(df: DataFrame, text: str, path: str) -> DataFrame:
    """All columns with n_pretokens and n_tokens added."""
    kept = without(df, "n_pretokens", "n_tokens")
    at = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    @textops.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for i, j, data, offsets in textops.slices(batch.column(at), 8 * textops.SPAN):
                starts, ends, firsts = textops.word_bounds(data, offsets, textops.SAME, textops.NOT_SPACE)
                total = np.zeros(len(starts) + 1, np.int64)
                if len(starts):
                    keys = textops.word_hashes(data, starts, ends, textops.SAME)
                    distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
                    np.cumsum(own.of(distinct, data.tobytes(), starts[first], ends[first])[back], out=total[1:])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(firsts).astype(np.int64)), pa.array(np.diff(total[firsts]))], [*part.schema.names, "n_pretokens", "n_tokens"]
                )

    return kept.mapInArrow(run, schema)


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", vocabulary()).select("doc_id", "n_pretokens", "n_tokens")


def brute_force(text: str | None, scores: dict[str, float]) -> tuple[int, int]:
    """Words and tokens by a plain Viterbi per word; for tests."""
    import re

    byte = min(scores.values()) - BYTE_PENALTY
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    total = 0
    for word in words:
        w = MARK + word
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(w)
        for e in range(1, len(w) + 1):
            options = [(best[b][0] + scores[w[b:e]], -best[b][1] - 1) for b in range(e) if w[b:e] in scores]
            if w[e - 1] not in scores:
                k = len(w[e - 1].encode())
                options.append((best[e - 1][0] + k * byte, -best[e - 1][1] - k))
            score, tokens = max(options)
            best[e] = (score, -tokens)
        total += best[-1][1]
    return len(words), total
