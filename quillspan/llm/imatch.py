"""I-Match fingerprints of documents, in DataFrame functions only.

Lexicon. Every term's document frequency is counted (by its 64-bit hash); terms
within the band of inverse document frequencies, MIN_SHARE to MAX_SHARE of the
documents, are the lexicon: at most (terms per document) / MIN_SHARE of them,
whatever the number of documents. In the plan they are a constant bit set, BITS
for each and two of them set (a Bloom filter), so a term beyond the lexicon
passes for one of it with odds below 0.4 %, equally in all texts.

Fingerprint. A text's distinct terms within the lexicon are sorted by hash; each
randomised subset of the lexicon (``SUBSETS``) keeps a share of the terms by
other bits of the hash, and the kept terms, in order, are hashed. Small subsets
survive edits of long texts, large ones tell short texts apart. The
likeness of two fingerprints is the share of subsets with equal hashes among
those in which either text has terms; of two texts without such terms it is 1
if the fingerprints are equal.

Defined results: a null text is empty; an empty text, or one without terms in
the lexicon, has the fingerprint of empty subsets; equal texts have equal
fingerprints; a very long text is split whole, in its row; documents are ordered
by id (null first), then text; the last one's next is the first, and a lone
document's next is itself; an empty table gives no rows. Rows of one id, or
without one, are ordered within one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import table

#: Bits of the lexicon's bit set for each term of it.
BITS = 32
#: The band: -log of these shares of the documents.
MIN_SHARE, MAX_SHARE = 0.001, 0.25
#: (w, n): n randomised subsets, each of one in 2**w of the lexicon's terms; w bits of a term's hash, from FIRST_BIT on and after those of the widths before, say which.
SUBSETS = ((0, 1), (4, 4), (6, 7), (8, 5), (10, 4))
FIRST_BIT = 24
#: Where the second bit of the bit set comes from.
SECOND_BIT = 36
#: Documents in a stretch of ids; the stretches' first ids are at most MAX_BOUNDS x MAX_BOUNDS.
STRETCH, MAX_BOUNDS = 2000, 256
#: Words of digits, letters and what isn't ASCII.
NOT_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def term_hashes(text: Column) -> Column:
    """Hashes of a text's terms, with repeats; of a text that begins or ends with separators that of the empty text, too."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.split(lower, NOT_TERM), lambda w: F.xxhash64(w))


def band_terms(texts: DataFrame, text: str) -> np.ndarray:
    """Hashes of the terms within the band."""
    terms = texts.select(F.explode(F.array_distinct(term_hashes(F.col(text)))).alias("h")).where(F.col("h") != F.xxhash64(F.lit("")))
    n = max(texts.count(), 1)
    chosen = terms.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= MIN_SHARE * n) & (F.col("df") <= MAX_SHARE * n))
    return chosen.select("h").toArrow()["h"].to_numpy()


def bit_set(terms: np.ndarray) -> np.ndarray:
    """Longs with two bits set for each term; their number is a power of two."""
    size = 1 << max(BITS * len(terms) - 1, 1023).bit_length()
    bits = np.zeros(size // 64, np.uint64)
    for shift in (0, SECOND_BIT):
        at = (terms.view(np.uint64) >> np.uint64(shift)) & np.uint64(size - 1)
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits.view(np.int64)


def lexicon(texts: DataFrame, text: str) -> np.ndarray:
    """The band's bit set."""
    return bit_set(band_terms(texts, text))


def in_lexicon(h: Column, bits: Column, size: int) -> Column:
    def on(shift: int) -> Column:
        at = F.shiftrightunsigned(h, shift).bitwiseAND(size - 1) if shift else h.bitwiseAND(size - 1)
        return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1

    return on(0) & on(SECOND_BIT) & (h != F.xxhash64(F.lit("")))


def fingerprint(df: DataFrame, text: str, bits: np.ndarray, to: str) -> DataFrame:
    """Adds ``to``: an array with one hash per randomised subset of the lexicon, 0 where the text has none of its terms."""
    constant = F.lit(bits)
    found = F.filter(term_hashes(F.col(text)), lambda h: in_lexicon(h, constant, 64 * len(bits)))
    held = df.withColumn("__terms", F.array_sort(F.array_distinct(found)))
    # Terms of any subset of a width are picked once; the subsets then look at those few.
    at, bit = {}, FIRST_BIT
    for width, n in SUBSETS:
        at[width] = bit
        bit += width
        if width:
            held = held.withColumn(f"__terms{width}", _picked("__terms", at[width], width, lambda i, n=n: i < n))

    def part(width: int, number: int) -> Column:
        kept = _picked(f"__terms{width}", at[width], width, lambda i: i == number) if width else F.col("__terms")
        return F.when(F.size(kept) > 0, F.xxhash64(F.lit(100 * width + number), kept)).otherwise(F.lit(0).cast("long"))

    marked = held.withColumn(to, F.array(*[part(w, i) for w, n in SUBSETS for i in range(n)]))
    return marked.drop("__terms", *[f"__terms{w}" for w, _ in SUBSETS if w])


def _picked(terms: str, bit: int, width: int, chosen: Callable[[Column], Column]) -> Column:
    """The terms whose number by ``width`` bits of their hash is chosen."""
    return F.filter(terms, lambda h: chosen(F.shiftrightunsigned(h, bit).bitwiseAND((1 << width) - 1)))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 1).otherwise(2))
    same, other = F.size(F.filter(pairs, lambda p: p == 1)), F.size(F.filter(pairs, lambda p: p == 2))
    return F.when(same + other == 0, 1.0).otherwise(same / F.greatest(same + other, F.lit(1)))


def bounds(ids: DataFrame, key: str) -> np.ndarray:
    """First ids of stretches of about STRETCH documents, at most MAX_BOUNDS x MAX_BOUNDS, in order."""
    n = ids.count()
    parts = max(1, min(MAX_BOUNDS * MAX_BOUNDS, n // STRETCH))
    found = ids.agg(F.percentile_approx(key, [i / parts for i in range(parts)], 10 * parts + 100), F.min(key)).first()
    return np.array(sorted({found[1], *found[0]}) if found[1] is not None else [0], np.int64)


def next_texts(df: DataFrame, key: str, text: str, mark: str) -> DataFrame:
    """key, text, mark, next and next_mark: those of the next document by ascending key, then text; the last one's are the first's.

    The key is a number. Texts are dealt once, to stretches of ids. The first
    document of a stretch is also dealt to the stretch before it, so a window
    within a stretch sees every document's next.
    """
    starts = bounds(df.select(key).where(F.col(key).isNotNull()), key)
    total = len(starts)
    size = max(1, -(-total // MAX_BOUNDS))
    flat = F.lit(starts)

    def upto(some: Column) -> Column:
        return F.greatest(F.size(F.filter(some, lambda x: x <= F.col(key))) - 1, F.lit(0))

    # The stretch of an id is looked up in two steps of at most MAX_BOUNDS comparisons.
    group = upto(F.lit(starts[::size])) * size
    members = F.slice(flat, group + 1, F.lit(size))
    low = group + upto(members)
    placed = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text), F.col(mark), F.when(F.col(key).isNull(), 0).otherwise(low).alias("__at"))
    # Candidates for a stretch's first document: those whose id is a bound, or null.
    first = F.col(key).isNull() | F.exists(members, lambda x: x == F.col(key))
    to = F.when(first, F.array(F.col("__at"), F.pmod(F.col("__at") - 1, F.lit(total)))).otherwise(F.array(F.col("__at")))
    if total == 1:
        to = F.array(F.col("__at"))
    dealt = placed.select(key, text, mark, "__at", F.explode(to).alias("__to"))
    after = ((F.col("__to") != F.col("__at")) & (F.col("__to") > F.col("__at"))).cast("int")  # wrapped round: comes last
    here = Window.partitionBy("__to").orderBy(after.asc(), F.col("__at").asc(), F.col(key).asc_nulls_first(), F.col(text).asc())
    pair = F.struct(F.col(text).alias("next"), F.col(mark).alias("next_mark"))
    seen = dealt.withColumn("__next", F.lead(pair).over(here))
    if total == 1:  # one stretch: the last document's next is its first
        begin = Window.partitionBy("__to").orderBy(F.col(key).asc_nulls_first(), F.col(text).asc())
        seen = seen.withColumn("__next", F.coalesce("__next", F.first(pair).over(begin)))
    return seen.where("__to = __at").select(key, text, mark, "__next.next", "__next.next_mark")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bits = lexicon(docs, "text")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    marked = fingerprint(docs, "text", bits, "f")
    pairs = next_texts(marked, "doc_id", "text", "f").select(
        "doc_id",
        "f",
        "next_mark",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut)).alias("edited"),
    )
    return fingerprint(pairs, "edited", bits, "e").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("f")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"),
        likeness(F.col("f"), F.col("next_mark")).alias("near_next"),
    )
