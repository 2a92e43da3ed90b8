"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

Sets are a document's distinct word shingles, as 64-bit hashes. Documents with
equal sets form a class; classes stand for their copies.

1. Signatures. Sizes fall into bands; for a band whose largest size is U, two
   linked sets differ in at most d = (1-t)/(1+t) * 2U members. The hash space
   is cut into d + SPARE + g equal parts, so two linked sets agree on at least
   SPARE + g whole parts; each non-empty part's members give one signature. A
   set with more than SPARE empty parts gives signatures of those, too, so
   linked sets share at least g signatures and no link is lost. Sets near a
   band's top also sign for the next band.
2. Families. Signatures that only one class has go. By a prefix argument each
   set may leave out its g - 1 commonest signatures, too: of g that two sets
   share, the least common one stays with both. Those of passages that many
   documents have go that way. Sets that share what is left are connected by
   stars from the least class to the others: as many rows as signatures, never
   pairs. Connected components are families.
3. Heads. In a family beyond ``TILE_MEMBERS`` or ``TILE_SHINGLES`` every member
   is compared with one head, the class that shares most signatures: the text
   that near copies were made of. Members linked to it are connected, so pairs
   of them need no look.
4. Tiles. A smaller family is one tile; of a larger one, members that are not
   linked to the head are cut into bands by size, bands into blocks by hash, and
   every pair of their blocks whose sizes may link is a tile, and so is each of
   their blocks with each block of linked members. In a tile, ordered by size,
   ANDed bitmaps' bit counts bound overlaps from above; what passes and is not
   yet connected is intersected exactly as sorted arrays.
5. Components of the links found, over classes, then over documents.

A family of m near copies of one text costs m comparisons and rows, not m blocks
of each. All rows of a signature are read by one task, as a stream of 16 bytes a
class.

Defined results: a text without words (or null, or empty) has an empty set and
links with nothing, its component is its own id; texts with fewer words than a
shingle are one shingle; a very long text is one set of all its shingles;
repeated rows of an id are one class or linked by their id's rows only through
texts; a row with a null id takes part like all others, links through it count,
and it is returned with a null component_id; an empty table gives no rows; other
columns are ignored. 64-bit hashes stand for shingles and sets: of n different
sets about n * n / 2**65 pairs are taken for equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspan.llm import textops
from quillspan.llm.common import materialise, table
from quillspan.llm.components import components

#: Ratio of a band's largest size to the one before.
BAND = 1.6
#: Parts beyond those that pigeonholes need, so that a few empty parts need no signature.
SPARE = 2
#: Parts beyond those, as a share of d, that linked sets must agree on.
AGREE = 0.4
#: Signatures held by so many classes or more are equally common.
MANY = 1 << 18
TILE_MEMBERS = 3000
TILE_SHINGLES = 4_000_000
#: Bits of a bitmap signature.
BITS = 512


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For slices of a batch: first, last + 1, each text's sorted distinct shingle hashes."""
    weights = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) | 1) for k in range(width)]
    for i, j, data, offsets in textops.slices(column):
        starts, ends, firsts = textops.word_bounds(data, offsets, textops.LOWER, textops.NOT_SPACE)
        words = textops.word_hashes(data, starts, ends, textops.LOWER)
        if len(words) >= width:
            n = len(words) - width + 1
            grams = words[:n] * weights[0]
            for k in range(1, width):
                grams += words[k : k + n] * weights[k]
            grams = textops.mix(grams)
        else:
            grams = np.zeros(0, np.uint64)
        sets = []
        for k in range(j - i):
            a, b = int(firsts[k]), int(firsts[k + 1])
            if b - a >= width:
                sets.append(distinct(grams[a : b - width + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64) * np.uint64(0x2545F4914F6CDD1D)
                for q in range(a, b):
                    short = textops.mix(short * np.uint64(0x9FB21C651E98DF25) + words[q : q + 1])
                sets.append(short)
            else:
                sets.append(grams[:0])
        yield i, j, sets


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def set_hash(members: np.ndarray) -> np.ndarray:
    """64 bits for a whole set, and of its size."""
    total = textops.mix(members * np.uint64(0xA24BAED4963EE407) + np.uint64(1)).sum(dtype=np.uint64, keepdims=True)
    return textops.mix(total + np.array([len(members)], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


def bands(threshold: tuple[int, int], top: int) -> list[int]:
    """Largest sizes of the bands, until one holds ``top``; a band reaches at least as far as sets of the last can link."""
    tops = [1]
    while tops[-1] < top:
        tops.append(max(tops[-1] + 1, math.floor(tops[-1] * BAND), tops[-1] * threshold[1] // threshold[0]))
    return tops


def band_of(size: int, tops: list[int]) -> int:
    return int(np.searchsorted(tops, size))


def differ(largest: int, threshold: tuple[int, int]) -> int:
    """At most so many members are in only one of two linked sets of at most this size."""
    t = threshold[0] / threshold[1]
    return math.floor((1 - t) / (1 + t) * 2 * largest + 1e-9)


def agree(d: int) -> int:
    return max(1, math.ceil(AGREE * d))


def signatures(members: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """All signatures of a non-empty set, for its band and, if it may link into it, the next. The lowest 6 bits hold the band."""
    n = len(members)
    reach = n * threshold[1] // threshold[0]
    tops = bands(threshold, max(reach, n))
    out = []
    for band in {band_of(n, tops), band_of(reach, tops)}:
        d = differ(tops[band], threshold)
        if not d:  # only equal sets link, and those are one class
            continue
        parts = d + SPARE + agree(d)
        of = ((members >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        begin = np.searchsorted(of, np.arange(parts))
        full = np.diff(np.append(begin, n)) > 0
        mixed = textops.mix(members + np.uint64(0x632BE59BD9B4E019))
        sums = np.zeros(parts, np.uint64)
        sums[full] = np.add.reduceat(mixed, begin[full])
        signed = full if parts - int(full.sum()) <= SPARE else np.ones(parts, bool)
        label = np.flatnonzero(signed).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(band * 0x1000003)
        out.append(textops.mix(sums[signed] + label) & ~np.uint64(63) | np.uint64(band))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _pass(df: DataFrame, key: str, text: str, width: int, threshold: tuple[int, int], sign: bool) -> DataFrame:
    """Of every row key, at (hash of the text), n (set size) and class (hash of the set, 0 if empty); or signatures of classes, each once per task where memory allows."""
    kind = df.schema[key].dataType.simpleString()

    @textops.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i, j, sets in shingle_sets(batch.column(1), width):
                classes = np.array([set_hash(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                if not sign:
                    own = [batch.column(k).slice(i, j - i) for k in (0, 2)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(classes)], [key, "at", "n", "class"])
                    continue
                sigs = [np.zeros(0, np.uint64)] * len(sets)
                for k, (s, c) in enumerate(zip(sets, classes.tolist(), strict=True)):
                    if len(s) and c not in seen:
                        if len(seen) < 200_000:
                            seen.add(c)
                        sigs[k] = signatures(s, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(classes, [len(s) for s in sigs]))], ["sig", "class"]
                )

    if sign:
        return df.select(key, text).mapInArrow(run, "sig long, class long")
    return df.select(key, text, F.xxhash64(text).alias("at")).mapInArrow(run, f"`{key}` {kind}, at long, n long, class long")


@textops.trimmed
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sig, class) rows to (sig, class, held) of signatures of more than one class, each class once.

    held: how many classes have the signature, ``MANY`` for that many or more. The
    rows of the last signature of a batch wait for the next, at most MANY.
    """
    sig, cls = np.zeros(0, np.int64), np.zeros(0, np.int64)
    over: int | None = None  # a signature already known to be held by MANY

    def done(s: np.ndarray, c: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        keep = held > 1
        return pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(c[keep]), pa.array(held[keep].astype(np.int32))], ["sig", "class", "held"])

    def counted(s: np.ndarray) -> np.ndarray:
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        n = np.minimum(np.diff(np.append(begin, len(s))), MANY)
        if over is not None and s[0] == over:
            n[0] = MANY
        return np.repeat(n, np.diff(np.append(begin, len(s))))

    for batch in batches:
        sig, cls = np.append(sig, batch.column(0).to_numpy()), np.append(cls, batch.column(1).to_numpy())
        if not len(sig):
            continue
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])
        sig, cls = sig[fresh], cls[fresh]
        last = int(np.searchsorted(sig, sig[-1]))
        if len(sig) - last >= MANY or over == sig[-1]:  # too many to wait for: all but the last row can go
            held = counted(sig)
            held[last:] = MANY
            over, last = int(sig[-1]), len(sig) - 1
        else:
            held = counted(sig)
        if last:
            yield done(sig[:last], cls[:last], held[:last])
        sig, cls = sig[last:], cls[last:]
    if len(sig):
        yield done(sig, cls, counted(sig))


@textops.trimmed
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sig, class) rows to edges (a, b) from the least class of a signature to each other one, and (class, null, signatures)."""
    last, head = None, 0
    for batch in batches:
        sig, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        new = np.concatenate([[sig[0] != last], sig[1:] != sig[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        first = np.where(at >= 0, cls[np.maximum(at, 0)], head)
        edges = np.unique(np.stack([first[~new], cls[~new]], axis=1), axis=0)
        own, n = np.unique(cls, return_counts=True)
        a, b = np.append(edges[:, 0], own), np.append(edges[:, 1], own)
        counted = np.append(np.zeros(len(edges), np.int64), n)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=counted > 0), pa.array(counted)], ["a", "b", "n"])
        last, head = sig[-1], first[-1]


def families(df: DataFrame, key: str, text: str, width: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(id, component) of classes that may link, and (id, degree): how many signatures a class shares."""
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def by_signature(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions, "sig").sortWithinPartitions("sig", "class")

    shared = by_signature(_pass(df, key, text, width, threshold, True)).mapInArrow(_shared, "sig long, class long, held int")
    banded = shared.withColumn("band", F.col("sig").bitwiseAND(F.lit(63)).cast("int"))
    needed = F.element_at(F.array(*[F.lit(agree(differ(t, threshold))) for t in bands(threshold, 1 << 40)]), F.col("band") + 1)
    order = Window.partitionBy("class", "band").orderBy(F.desc("held"), "sig")
    kept = banded.withColumn("r", F.row_number().over(order)).where(F.col("r") >= needed).select("sig", "class")
    stars = materialise(by_signature(kept).mapInArrow(_stars, "a long, b long, n long"), "stars")
    degrees = stars.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("degree"))
    return materialise(components(stars.where("b is not null").select("a", "b")), "families"), degrees


def bitmap(members: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[(members & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def tile_links(sets: list[np.ndarray], threshold: tuple[int, int], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets; between the two sides only, if ``side`` is given.

    The bound: members that map to a bit of x that y lacks are not in y. With
    c members of x on bits that y has, the overlap is at most c; bit counts give
    c <= |x| - (bits of x that y lacks).
    """
    num, den = threshold
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    maps = np.stack([bitmap(sets[k]) for k in order]) if len(sets) else np.zeros((0, BITS // 64), np.uint64)
    bits = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
    root = np.arange(len(sets))
    links = []
    sides = side[order] if side is not None else None
    for y in range(1, len(sets)):
        x0 = int(np.searchsorted(sizes[:y], -(-num * sizes[y] // den)))  # smaller sets cannot reach the share
        if x0 == y:
            continue
        both = np.bitwise_count(maps[x0:y] & maps[y]).sum(axis=1).astype(np.int64)
        most = np.minimum(sizes[x0:y] - (bits[x0:y] - both), sizes[y] - (bits[y] - both))
        fit = den * most >= num * (sizes[x0:y] + sizes[y] - most)
        if sides is not None:
            fit &= sides[x0:y] != sides[y]
        maybe = np.flatnonzero(fit) + x0
        maybe = maybe[np.argsort(-most[maybe - x0], kind="stable")]
        while len(maybe):
            x, rest = int(maybe[0]), maybe[1:]
            if root[x] != root[y]:
                a, b = sets[order[x]], sets[order[y]]
                place = np.searchsorted(b, a)
                place[place == len(b)] = len(b) - 1
                common = int((b[place] == a).sum())
                if den * common >= num * (len(a) + len(b) - common):
                    links.append((int(order[x]), int(order[y])))
                    root[root == root[y]] = root[x]
                    rest = rest[root[rest] != root[y]]
            else:
                rest = rest[root[rest] != root[y]]
            maybe = rest
    return links


def _linked(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> bool:
    """Whether two non-empty sorted sets are as similar as the threshold."""
    num, den = threshold
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if den * len(small) < num * len(large):
        return False
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[place] == small).sum())
    return den * common >= num * (len(a) + len(b) - common)


def against_heads(large: DataFrame, texts: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Members (family, class, n, doc, at, degree) of large families with ``head``, the family's, and whether they link to it.

    Members are dealt to as many tasks as there are tiles of them; the head's
    text goes to each.
    """
    heads = large.groupBy("family").agg(F.max_by(F.struct("class", "doc", "at"), F.struct("degree", "class")).alias("h"), F.count(F.lit(1)).alias("m"))
    heads = heads.withColumn("parts", F.ceil(F.col("m") / TILE_MEMBERS).cast("int"))
    numbered = large.join(heads.select("family", F.col("h.class").alias("head"), "parts"), "family")
    members = numbered.withColumn("part", F.pmod("class", "parts").cast("int")).drop("parts", "degree").withColumn("kind", F.lit(1))
    copies = heads.select("family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("h.class").alias("class"), "h.doc", "h.at")
    rows = members.unionByName(copies.withColumns({"head": F.col("class"), "kind": F.lit(0), "n": F.lit(0).cast("long")}))
    found = texts.withColumnsRenamed({"doc": "__doc", "at": "__at"}).join(rows, F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__at") == F.col("at")))
    columns = ["family", "class", "n", "doc", "at", "head"]
    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("linked", T.BooleanType())])
    parts = max(int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = found.select("text", "kind", "part", *columns).repartition(parts, "family", "part").sortWithinPartitions("family", "part", "kind")

    @textops.trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for i, j, sets in shingle_sets(batch.column(0), width):
                kind, cls, top = (batch.column(c).slice(i, j - i).to_numpy(zero_copy_only=False) for c in ("kind", "class", "head"))
                linked = np.zeros(j - i, bool)
                own = np.array([set_hash(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                meant = own == cls  # of rows that share an id and a text's hash
                for k in range(j - i):
                    if meant[k] and kind[k] == 0:
                        head, held = int(cls[k]), sets[k]
                    elif meant[k]:
                        linked[k] = head == top[k] and _linked(sets[k], held, threshold)
                keep = pa.array(meant & (kind == 1))
                part = batch.slice(i, j - i).select(columns).filter(keep)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(linked).filter(keep)], [*columns, "linked"])

    return dealt.mapInArrow(compare, schema).dropDuplicates(["class"])


TILE = ("family", "u", "i", "v", "j")


def _tile(u, i, v, j, side):
    return F.struct(F.col("family"), *[c.cast("int").alias(n) for n, c in (("u", u), ("i", i), ("v", v), ("j", j), ("side", side))])


def _upto(n):
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def tiles(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Members (family, class, n, doc, at, linked) to rows with tile and side: 0 in tiles of one block or two, else which of the two.

    ``linked`` is null in families of one tile. Bands are powers of 1/t, so sets link within a band or the next.
    """
    num, den = threshold
    den = den if den > num else num + 1  # equal sets only: any ratio will do
    whole = members.where("linked is null").select("class", "n", "doc", "at", F.array(_tile(*[F.lit(0)] * 5)).alias("ts"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9).cast("int")  # powers round down alike
    large = members.where("linked is not null").withColumn("band", band)
    size = F.greatest(F.ceil(2 * F.count(F.lit(1)) / TILE_MEMBERS), F.ceil(2 * F.sum("n") / TILE_SHINGLES), F.lit(1)).cast("int")
    volume = large.groupBy("family", "band", "linked").agg(size.alias("blocks"))
    near = large.join(volume, ["family", "band", "linked"])
    for step, name in ((0, "level"), (1, "above"), (-1, "below")):
        # Of members that are not linked to the head, and of those that are.
        for kind in (False, True):
            other = volume.where(F.col("linked") == kind).select("family", (F.col("band") - step).alias("band"), F.col("blocks").alias(f"{name}_{kind}"))
            near = near.join(other, ["family", "band"], "left")
    own = F.pmod(F.col("class"), F.col("blocks").cast("long")).cast("int")
    b = F.col("band")

    def blocks(name: str, kind: bool):
        return _upto(F.coalesce(f"{name}_{kind}", F.lit(0)))

    same = F.transform(blocks("level", False), lambda q: _tile(b, F.least(q, own), b, F.greatest(q, own), F.when(q == own, 0).when(q > own, 1).otherwise(2)))
    above = F.transform(blocks("above", False), lambda q: _tile(b, own, b + 1, q, F.lit(1)))
    below = F.transform(blocks("below", False), lambda q: _tile(b - 1, q, b, own, F.lit(2)))
    # Pairs of a block of either kind; told from the others by negative bands.
    steps = (("level", b), ("above", b + 1), ("below", b - 1))

    def with_linked(name: str, other):
        return F.transform(blocks(name, True), lambda q: _tile(-1 - b, own, other, q, F.lit(1)))

    def with_free(name: str, other):
        return F.transform(blocks(name, False), lambda q: _tile(-1 - other, q, b, own, F.lit(2)))

    free = F.concat(same, above, below, *[with_linked(*step) for step in steps])
    bound = F.concat(*[with_free(*step) for step in steps])
    grid = near.select("class", "n", "doc", "at", F.when(F.col("linked"), bound).otherwise(free).alias("ts"))
    return whole.unionByName(grid).select("class", "doc", "at", F.explode("ts").alias("t")).select("class", "doc", "at", "t.*")


def classes_linked(df: DataFrame, key: str, text: str, width: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Features of every row, and (id, component) for classes on a link."""
    feats = materialise(_pass(df, key, text, width, threshold, False), "classes")
    joined, degrees = families(df, key, text, width, threshold)
    # A row of every class, told by id and text, so that rows without an id are found, too.
    least = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("doc"), "at")).alias("r")
    reps = feats.where("n > 0").groupBy("class").agg(least, F.max("n").alias("n")).select("class", "n", "r.doc", "r.at")
    members = joined.select(F.col("id").alias("class"), F.col("component").alias("family")).join(reps, "class")
    limits = members.groupBy("family").agg(F.count(F.lit(1)).alias("__m"), F.sum("n").alias("__s"))
    beyond = (F.col("__m") > TILE_MEMBERS) | (F.col("__s") > TILE_SHINGLES)
    sized = materialise(members.join(limits, "family").select("family", "class", "n", "doc", "at", beyond.alias("beyond")), "members")
    texts = df.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("at"))
    large = sized.where("beyond").drop("beyond")
    placed = sized.where("not beyond").drop("beyond").withColumn("linked", F.lit(None).cast("boolean"))
    to_heads = None
    if large.limit(1).count():
        judged = large.join(degrees.withColumnRenamed("id", "class"), "class").select(*large.columns, "degree")
        compared = materialise(against_heads(judged, texts, width, threshold), "heads")
        to_heads = compared.where("linked and class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
        placed = placed.unionByName(compared.drop("head"))
    dealt = materialise(tiles(placed, threshold), "tiles")

    @textops.trimmed
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, ...]] = set()  # a class stands once in a tile, however many rows its id and text have
        for batch in batches:
            for i, j, sets in shingle_sets(batch.column(0), width):
                rest = batch.slice(i, j - i).select([1, 2, 3, 4, 5, 6, 7])
                own = np.array([set_hash(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                keep = []
                for k, place in enumerate(zip(*[c.to_pylist() for c in rest.columns], strict=True)):
                    if own[k] == place[0] and place not in seen:
                        if len(seen) < 200_000:
                            seen.add(place)
                        keep.append(k)
                rest = rest.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([sets[k].tobytes() for k in keep], pa.binary())], [*rest.schema.names, "members"])

    def link(group: pa.Table) -> pa.Table:
        cls, first = np.unique(group["class"].to_numpy(), return_index=True)
        group = group.take(pa.array(first))
        sets = [np.frombuffer(m, np.uint64) for m in group["members"].to_pylist()]
        side = group["side"].to_numpy()
        found = tile_links(sets, threshold, side if side.any() else None)
        return pa.table({"a": pa.array([cls[x] for x, _ in found], pa.int64()), "b": pa.array([cls[y] for _, y in found], pa.int64())})

    meant = F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__at") == F.col("at"))
    tiled = (
        texts.withColumnsRenamed({"doc": "__doc", "at": "__at"})
        .join(dealt.hint("merge"), meant)  # one plan at every size
        .select("text", "class", *TILE, "side")
        .mapInArrow(sets_of, "class long, family long, u int, i int, v int, j int, side int, members binary")
    )
    links = tiled.groupBy(*TILE).applyInArrow(link, "a long, b long")
    return feats, components(links if to_heads is None else links.unionByName(to_heads))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """key, n_shingles, component_id (the least key of the document's component)."""
    return near_groups(df, key, text, width, threshold).drop("at", "component")


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """As ``near_duplicates``, with at (``xxhash64`` of the text) and component, which names the group of all rows, those without a key, too; null for empty sets."""
    if not 0 < threshold[0] <= threshold[1]:
        raise ValueError("the threshold is a share above 0")
    feats, linked = classes_linked(df, key, text, width, threshold)
    base = feats.where("n > 0").groupBy("class").agg(F.min(key).alias("__least"))
    grouped = base.join(linked.withColumnRenamed("id", "class"), "class", "left").withColumn("__c", F.coalesce("component", "class")).drop("component")
    least = grouped.groupBy("__c").agg(F.min("__least").alias("component_id"))
    of_class = grouped.join(least, "__c").select(F.col("class").alias("__class"), "component_id", F.col("__c").alias("component"))
    return (
        feats.select(key, "at", "n", "class")
        .join(of_class, (F.col("class") == F.col("__class")) & (F.col("n") > 0), "left")
        .select(key, F.col("n").alias("n_shingles"), F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id"), "at", "component")
    )


def keep_one(df: DataFrame, near: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates, by its ``near_groups``: of every component one row, that with the least key (a null one last), then text's hash.

    Rows are told by key and text, so rows of a repeated key are judged each by
    its own text, and of rows with equal key and text one stays. Texts without
    words belong to no component and stay.
    """
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "at")
    judged = near.where("component is not null").select(key, "at", "component")
    counted = judged.groupBy(key, "at", "component").agg(F.count(F.lit(1)).alias("n"))
    best = judged.groupBy("component").agg(F.min(place).alias("best"))
    verdict = counted.join(best, "component").select(F.col(key).alias("__key"), F.col("at").alias("__at"), "n", (place == F.col("best")).alias("stays"))
    verdict = materialise(verdict.where("not stays or n > 1"), "verdict")
    rows = df.withColumn("__own", F.xxhash64(text))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__at"))
    rest = rows.join(verdict, same, "left_anti")
    once = rows.join(verdict.where("stays"), same, "left_semi").dropDuplicates([key, "__own"])
    return rest.unionByName(once).drop("__own")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, "doc_id", "text", 4, (85, 100))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM d, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str | None]], width: int, threshold: tuple[int, int]) -> list[tuple[int, int, int]]:
    """The same over all pairs; for tests."""
    import re

    sets, root = [], list(range(len(rows)))
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and threshold[1] * len(sets[i] & sets[j]) >= threshold[0] * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))
