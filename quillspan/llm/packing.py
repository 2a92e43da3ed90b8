"""Best-fit packing of tokenised documents by patterns.

1. Tokenise (``tokenise``): one pass over the texts gives a row per piece, at
   most ``capacity`` tokens long. Units that a text's ASCII white space and
   letter/punctuation edges separate are tokenised once for each distinct unit;
   every worker process keeps a bounded table of units it has met.
2. Plan (``plan_patterns``): the histogram of piece lengths, at most
   ``capacity`` bins whatever the corpus, comes to the driver. Patterns of at
   most FEW lengths that fill a sequence are enumerated, and their repeat counts
   are fitted to the histogram by non-negative least squares. The counts are
   rounded by largest remainders within the histogram; patterns and fit are made
   again for what is left, and the residual is packed best-fit decreasing.
3. Assign (``pack``): a piece's rank among those of its length, counted in
   cells, selects its place in the plan by binary search. The plan is broadcast:
   at most len(WASTE) x KEPT x FEW x ``capacity`` rows of the fits, and runs of
   equal lengths of the residual's packing, whose different sequences are at
   most three a length. Neither bound grows with the corpus.

Defined results: a null text is empty and gives one piece of the end token; ties
of length are filled by hash, id, piece; rows repeated under one id are
documents of their own; a very long text is cut into as many pieces as it needs;
an empty table packs to none; input columns other than the id and the text are
ignored, and the operator's own output names replace input columns of those names.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm import textops
from quillspan.llm.common import materialise, rank_within, table, without

END_ID = 1
CAPACITY = 4096
#: Units that a worker process remembers, and ids of them; beyond either the table starts anew.
CACHE_UNITS, CACHE_IDS = 1 << 20, 1 << 23
#: Lengths in a pattern at most; the shares of the room that the second and the third one take.
FEW = 6
SECOND, THIRD = (1.0, 0.85, 0.7, 0.55, 0.45, 0.35, 0.25, 0.15), (1.0, 0.6, 0.3)
#: Patterns kept for each length; rounds of a fit, and what a sequence costs in it, as a share of the mean count of a length.
KEPT, ROUNDS, CHARGE = 2, 200, 0.02
#: What the patterns of each fit may leave empty, in 256ths of a sequence; the parts of a fit that are tried.
WASTE, PARTS = (0, 0, 0, 1, 256), (1.0, 0.95, 0.85, 0.7, 0.5)
#: A residual of at most this share of the pieces is not fitted again.
SMALL = 0.05

_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
#: ASCII punctuation that always ends a run of letters; not the apostrophe of contractions, nor what special tokens are made of.
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>_"]] = True
_SPACE = ~textops.NOT_SPACE


class UnitTokens:
    """Token ids of units, kept by the units' hashes in sorted arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for word, i in vocab.items():
            ends[i] = word.endswith("</w>")
        self.ends = ends
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another, and each unit's number of ids."""
        plain = np.fromiter((_LETTERS.fullmatch(u) is not None for u in units), bool, len(units))
        lens = np.zeros(len(units), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        of = np.flatnonzero(plain)
        for i in range(0, len(of), 1000):  # a unit of letters alone is one word, whose last id says so
            some = of[i : i + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join([units[k] for k in some.tolist()]).decode(), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(some):
                plain[some] = False
                continue
            lens[some] = np.diff(last, prepend=-1)
            parts.append((some, ids))
        rest = np.flatnonzero(~plain)
        for i in range(0, len(rest), 4000):
            some = rest[i : i + 4000]
            got = [e.ids for e in self.tokenizer.encode_batch_fast([units[k].decode() for k in some.tolist()], add_special_tokens=False)]
            lens[some] = np.fromiter(map(len, got), np.int64, len(got))
            parts.append((some, np.fromiter(itertools.chain.from_iterable(got), np.uint32)))
        out = np.zeros(int(lens.sum()), np.uint32)
        at = np.cumsum(lens) - lens
        for some, ids in parts:
            out[spread(at[some], lens[some])] = ids
        return out, lens

    def of(self, keys: np.ndarray, bytes_of) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each key start in self.ids, and how many there are; bytes_of(indexes) gives new keys' bytes."""
        if len(self.keys) > CACHE_UNITS or len(self.ids) > CACHE_IDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~hit)
        if len(new):
            ids, lens = self.encode(bytes_of(new))
            starts = len(self.ids) + np.cumsum(lens) - lens
            self.ids = np.concatenate([self.ids, ids])
            put = np.searchsorted(self.keys, keys[new])
            self.keys, self.at, self.len = np.insert(self.keys, put, keys[new]), np.insert(self.at, put, starts), np.insert(self.len, put, lens)
            at = np.searchsorted(self.keys, keys)
        return self.at[at], self.len[at]


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All indexes of the ranges that start and are as long as given."""
    ends = np.cumsum(lens)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    return out + np.repeat(starts - (ends - lens), lens)


_known: dict[str, UnitTokens] = {}


def unit_tokens(path: str) -> UnitTokens:
    if path not in _known:
        _known[path] = UnitTokens(path)
    return _known[path]


def token_ids(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of some documents one after another, and where each document's begin."""
    units = unit_tokens(path)
    raw = data.tobytes()
    lower = textops.SAME if b"<|" in raw else textops.LOWER  # special tokens are told apart by case, all else is not
    starts, ends, firsts = textops.word_bounds(data, offsets, textops.SAME, textops.NOT_SPACE)
    if len(data) > 1:  # cut units where letters meet punctuation
        a, p = _ALPHA[data], _PUNCT[data]
        edge = np.flatnonzero((a[:-1] & p[1:]) | (p[:-1] & a[1:])) + 1
        edge = edge[~np.isin(edge, offsets)] if len(edge) else edge
        starts, ends = np.sort(np.concatenate([starts, edge])), np.sort(np.concatenate([ends, edge]))
        firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    keys = textops.word_hashes(data, starts, ends, lower)
    distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    at, lens = units.of(distinct, lambda new: [raw[i:j] for i, j in zip(s[new].tolist(), e[new].tolist(), strict=True)])
    n = lens[back]
    ids = units.ids[spread(at[back], n)]
    return ids, np.concatenate([[0], np.cumsum(n)])[firsts]


def tokenise(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of the documents: key, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    kind = df.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    @textops.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in textops.slices(batch.column(1)):
                ids, begin = token_ids(path, data, offsets)
                rows: list[tuple] = []
                for k in range(j - i):
                    own = np.append(ids[begin[k] : begin[k + 1]], np.uint32(end_id)).astype("<u4")
                    for p, at in enumerate(range(0, len(own), capacity)):
                        piece = own[at : at + capacity]
                        rows.append((i + k, p, at, len(piece), zlib.crc32(piece.tobytes()), piece if keep_ids else None))
                cols = list(zip(*rows, strict=True))
                arrays = [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array([p.astype(np.int32) for p in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(key, text).mapInArrow(run, fields)


def _sum_at(patterns: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """A x: how many pieces of each length the patterns use; place 0 is padding."""
    out = np.bincount(patterns.ravel(), weights=np.repeat(x, patterns.shape[1]), minlength=size)
    out[0] = 0.0
    return out


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 of patterns (rows, padded by 0) that bring A x near the histogram.

    Projected gradients with momentum, dropped when it points uphill; the step is
    the inverse of A's largest squared singular value. ``CHARGE``, a small price
    of every sequence, makes one of the many equally good fits the one to go to.
    """
    size = len(histogram)
    h = histogram.astype(np.float64).copy()
    h[0] = 0.0
    scale = h[h > 0].mean()
    h /= scale
    x, bound = np.ones(len(patterns)), 1.0
    for _ in range(12):
        y = _sum_at(patterns, x, size)[patterns].sum(axis=1)
        bound = float(np.linalg.norm(y) / np.linalg.norm(x))
        x = y / np.linalg.norm(y)
    step = 1.0 / (1.05 * bound)
    x = np.zeros(len(patterns))
    ahead, momentum = x, 1.0
    for _ in range(rounds):
        residual = h - _sum_at(patterns, ahead, size)
        fresh = np.maximum(ahead + step * (residual[patterns].sum(axis=1) - CHARGE), 0.0)
        if float((ahead - fresh) @ (fresh - x)) > 0:
            momentum = 1.0
        following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = np.maximum(fresh + (momentum - 1) / following * (fresh - x), 0.0)
        x, momentum = fresh, following
    return x * scale


def few_patterns(histogram: np.ndarray, capacity: int, waste: int = 0) -> np.ndarray:
    """Patterns of at most FEW lengths, longest first, padded by 0, that leave at most ``waste`` of a sequence empty.

    Every length at hand, beside a second and a third one that take the shares
    SECOND and THIRD of the room (or the next shorter), then what fits best.
    """
    lengths = np.flatnonzero(histogram)
    below = np.zeros(capacity + 1, np.int64)  # the largest length at hand that is no longer
    below[lengths] = lengths
    below = np.maximum.accumulate(below)
    found = [np.zeros((0, FEW), np.int64)]
    for second, third in itertools.product(SECOND, THIRD):
        p = np.zeros((len(lengths), FEW), np.int64)
        p[:, 0] = lengths
        room = capacity - lengths
        for k in range(1, FEW):
            share = {1: second, 2: third}.get(k, 1.0)
            p[:, k] = below[np.minimum(p[:, k - 1], (room * share).astype(np.int64))]
            room = room - p[:, k]
        found.append(p[room <= waste])
    return np.unique(np.concatenate(found), axis=0)[::-1]


def sparse_fit(patterns: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and counts, fitted again with the ``KEPT`` patterns a length that the first fit uses most, so that counts are not all fractions."""
    x = fit_counts(patterns, histogram)
    most = KEPT * int((histogram > 0).sum())
    if len(patterns) > most:
        patterns = patterns[np.sort(np.argsort(-x, kind="stable")[:most])]
        x = fit_counts(patterns, histogram)
    return patterns, x


def rounded(patterns: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole counts within the histogram: the fit's whole parts, largest first, then one more for the largest remainders."""
    left, whole = histogram.tolist(), np.floor(x + 1e-9).astype(np.int64)
    rest = x - whole
    wanted = [(k, int(whole[k])) for k in np.argsort(-whole, kind="stable").tolist() if whole[k] > 0]
    wanted += [(k, 1) for k in np.argsort(-rest, kind="stable").tolist() if rest[k] > 1e-3]
    contents = [tuple(v for v in p if v) for p in patterns.tolist()]
    out = []
    for k, times in wanted:
        runs = [(a, len(list(run))) for a, run in itertools.groupby(contents[k])]
        times = min(times, *(left[a] // n for a, n in runs))
        if times > 0:
            for a, n in runs:
                left[a] -= times * n
            out.append((contents[k], times))
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (contents, how many such sequences), same lengths handled together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room -> contents and how many
    rooms = np.zeros(capacity + 1, bool)
    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            fits = np.flatnonzero(rooms[a:])
            if len(fits):
                room = a + int(fits[0])
                contents, have = bins[room].pop()
                take = min(n, have)
                if have > take:
                    bins[room].append((contents, have - take))
                if not bins[room]:
                    del bins[room]
                    rooms[room] = False
                bins.setdefault(room - a, []).append(((*contents, a), take))
                rooms[room - a] = True
                n -= take
            else:
                each = capacity // a  # new sequences hold as many of this length as fit
                whole, rest = divmod(n, each)
                for contents, k in (((a,) * each, whole), ((a,) * rest, 1 if rest else 0)):
                    if k:
                        bins.setdefault(capacity - sum(contents), []).append((contents, k))
                        rooms[capacity - sum(contents)] = True
                n = 0
    return [x for some in bins.values() for x in some]


def _left(histogram: np.ndarray, plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    out = histogram.tolist()
    for contents, times in plan:
        for a in contents:
            out[a] -= times
    return np.array(out, np.int64)


def _sequences(plan: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(times for _, times in plan)


@dataclass(frozen=True)
class Plan:
    """What the fit placed, and the residual's best-fit packing: (contents, how many such sequences)."""

    fitted: list[tuple[tuple[int, ...], int]]
    residual: list[tuple[tuple[int, ...], int]]

    @property
    def sequences(self) -> int:
        return _sequences(self.fitted) + _sequences(self.residual)

    @property
    def fitted_pieces(self) -> int:
        return sum(len(contents) * times for contents, times in self.fitted)

    @property
    def entries(self) -> list[tuple[tuple[int, ...], int]]:
        return self.fitted + self.residual


def plan_patterns(histogram: np.ndarray, capacity: int) -> Plan:
    """Patterns with repeat counts that use every piece exactly once.

    Patterns are fitted and rounded, then fitted again to what is left, full ones
    first (``WASTE``). Rounding up may use up the short pieces that the residual
    needs, so of each fit as large a part is used (``PARTS``) as adds no sequence
    to what best-fit packing of the same pieces needs; a part of all counts leaves
    a residual that is mixed like the whole.
    """
    left, fitted = histogram.astype(np.int64), []
    left[0] = 0
    total = left.sum()
    residual = best_fit(left, capacity)
    for waste in WASTE:
        if left.sum() <= SMALL * total:
            break
        patterns = few_patterns(left, capacity, waste * capacity // 256)
        if not len(patterns):
            continue
        patterns, x = sparse_fit(patterns, left)
        for part in PARTS:
            own = rounded(patterns, part * x, left)
            after = _left(left, own)
            rest = best_fit(after, capacity)
            if own and _sequences(own) + _sequences(rest) <= _sequences(residual):
                fitted, left, residual = fitted + own, after, rest
                break
    return Plan(fitted, residual)


def intervals(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces a sequence), in order of length and rank.

    From the first rank on, a length's pieces fill the run of that many pieces at
    the offset of one sequence after the other. Runs of a plan are few: a
    sequence has at most sqrt(2 x capacity) different lengths.
    """
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for contents, times in plan:
        offset = 0
        for length, run in itertools.groupby(contents):
            n = len(list(run))
            first = ranks.get(length, 0)
            rows.append((length, first, sequence, offset, n))
            ranks[length] = first + times * n
            offset += n * length
        sequence += times
    at = np.array(rows, np.int64).reshape(-1, 5)
    return at[np.lexsort((at[:, 1], at[:, 0]))]


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length; ``order`` makes ranks stable."""
    counted = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counted:
        histogram[length] = n
    shared = pieces.sparkSession.sparkContext.broadcast(intervals(plan_patterns(histogram, capacity).entries))
    ranked = rank_within(without(pieces, "sequence_id", "offset"), "length", F.xxhash64(*order), [F.col(c) for c in order], "__rank", int(histogram.max(initial=0)))
    columns = [c for c in ranked.columns if c != "__rank"]
    schema = T.StructType([*[ranked.schema[c] for c in columns], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @textops.trimmed
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        starts = at[:, 0] << 40 | at[:, 1]  # a length has less than 2**40 pieces
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            own = at[np.searchsorted(starts, length << 40 | rank, "right") - 1]
            nth = rank - own[:, 1]
            places = [pa.array(own[:, 2] + nth // own[:, 4]), pa.array(own[:, 3] + nth % own[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *places], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY) -> DataFrame:
    pieces = materialise(tokenise(df, key, text, path, capacity), "pieces")
    return pack(pieces, [key, "piece", "ids_crc32"], capacity)


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, "doc_id", "text", vocabulary()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
