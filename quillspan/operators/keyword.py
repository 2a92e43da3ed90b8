"""BM25 keyword search: an index of postings, or a direct scan of texts.

idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a clause adds
idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), k1 = 1.2, b = 0.75.

A query is a list of clauses, each a term or a quoted phrase. A phrase is a
clause of its own: tf is how often its terms stand one after another, idf the
sum of theirs. A text matches if any clause does. A clause after ``+`` or on
either side of ``AND`` must match; one after ``-`` or ``NOT`` must not, and adds
nothing; ``OR`` changes nothing; if some must match, the others only add to
scores. ``text:`` before a clause names the one field there is. An unbalanced
quote, another field or a sign without a clause is refused.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import TERM_MAX_BYTES, terms
from quillspan.model import ValidationError

K1, B = 1.2, 0.75
#: Weights of postings are added as whole numbers of this part, so a sum is the same in any order and equal texts tie.
PART = 2.0**-40


@dataclass(frozen=True)
class Clause:
    """Terms one after another (a term alone is a phrase of one), and whether they must ("+") or must not ("-") be there."""

    terms: tuple[str, ...]
    occur: str = ""


@dataclass(frozen=True)
class ParsedQuery:
    clauses: tuple[Clause, ...]

    @property
    def terms(self) -> tuple[str, ...]:
        """All terms that statistics are needed of, each once."""
        return tuple(dict.fromkeys(t for c in self.clauses for t in c.terms))

    @property
    def from_postings(self) -> bool:
        """Whether postings alone answer the query: single terms, any of which may match."""
        return all(len(c.terms) == 1 and not c.occur for c in self.clauses)


_TOKEN = re.compile(r"""(?P<sign>[+-]?)(?:(?P<field>[A-Za-z_]\w*):(?=\S))?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s"]+))""")


def _split(said: str) -> tuple[str, ...]:
    return tuple(t for t in re.split(r"[\W_]+", said.lower()) if t and len(t.encode()) < TERM_MAX_BYTES)


def parse(query: str) -> ParsedQuery:
    """Clauses of a query, equal ones once."""
    if query.count('"') % 2:
        raise ValidationError("query has an unbalanced quote")
    found: list[Clause] = []
    both, negated = False, False  # after AND, after NOT
    for token in _TOKEN.finditer(query):
        sign, name, phrase, word = token["sign"], token["field"], token["phrase"], token["word"]
        if not sign and not name and word in ("AND", "OR", "NOT"):
            if word == "AND" and found:
                both, last = True, found[-1]
                found[-1] = Clause(last.terms, last.occur or "+")
            negated = negated or word == "NOT"
            continue
        if name and name != "text":
            raise ValidationError(f"query names an unknown field: {name}")
        occur = "-" if negated or sign == "-" else "+" if both or sign else ""
        # A word of several terms ("rock-and-roll") is any of them.
        own = [_split(phrase)] if phrase is not None else [(t,) for t in _split(word)]
        found += [Clause(terms, occur) for terms in own if terms]
        both = negated = False
    if both or negated or re.search(r"(?:^|\s)[+-](?:\s|$)", query):
        raise ValidationError("query has a sign without a clause")
    return ParsedQuery(tuple(dict.fromkeys(found)))


def rarity(df: Column, n: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    return rarity(df, n) * saturation(tf, dl, avgdl)


@dataclass
class KeywordIndex:
    """postings (term, doc_id, tf, dl), frequencies (term, df), stats (n, avgdl: one row)."""

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame


def postings_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf, dl) by one explode; counts combine before the shuffle."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), terms(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    sized = rows.select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    return sized.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc_id", "tf", "dl")


def from_postings(postings: DataFrame, docs: DataFrame) -> KeywordIndex:
    """Frequencies and statistics from postings; of the documents only their number is asked."""
    frequencies = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return KeywordIndex(postings, frequencies, total.select(n.alias("n"), F.try_divide("total", n).alias("avgdl")))


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> KeywordIndex:
    return from_postings(postings_of(docs, id_col, text), docs)


def search_index(index: KeywordIndex, query: str, k: int) -> DataFrame:
    """(doc_id, score) from postings: the terms are a pushed-down filter, statistics one broadcast row."""
    parsed = parse(query)
    if not parsed.from_postings:
        raise ValidationError("phrases and signs need the texts: use search_texts")
    some = index.postings.where(F.col("term").isin(list(parsed.terms)))
    df = F.broadcast(index.frequencies.where(F.col("term").isin(list(parsed.terms))))  # a row per query term at most
    stats = index.stats.select(F.struct("n", "avgdl").alias("s")).scalar()
    scored = some.join(df, "term").select("doc_id", weight(F.col("tf"), F.col("dl"), F.col("df"), stats["n"], stats["avgdl"]).alias("w"))
    total = F.sum(F.round(F.col("w") / PART).cast("long")) * PART
    return scored.groupBy("doc_id").agg(total.alias("score")).orderBy(F.desc("score"), F.asc("doc_id")).limit(k)


def _occurrences(ts: Column, phrase: tuple[str, ...]) -> Column:
    if len(phrase) == 1:
        return F.size(ts) - F.size(F.array_remove(ts, phrase[0]))
    starts = F.sequence(F.lit(1), F.greatest(F.size(ts) - len(phrase) + 1, F.lit(1)))
    return F.size(F.filter(starts, lambda i: F.slice(ts, i, F.lit(len(phrase))) == F.array(*map(F.lit, phrase))))


def counted_texts(docs: DataFrame, sought: list[tuple[str, ...]], id_col: str, text: str) -> DataFrame:
    """(doc_id, c) of every text: c holds its length in terms, then how often each phrase sought occurs.

    The rows, a few dozen bytes a text, are exchanged by id before anything else
    is done with them. Statistics and scores, and every other use in a plan, need
    all of ``c``, so nothing is pruned or pushed below that exchange for one of
    them alone: it is the same for all and runs once, texts are read once.
    """

    def counts(ts: Column) -> Column:
        return F.array(F.size(ts), *[_occurrences(ts, phrase) for phrase in sought])

    # Within a lambda the terms are bound once, however many counts there are of them.
    read = F.transform(F.array(terms(F.coalesce(F.col(text), F.lit("")))), counts)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), read.alias("cs")).repartition("doc_id")
    # No filter on what a generator makes passes below it; the outer form adds none of its own.
    return rows.select("doc_id", F.explode_outer("cs").alias("c"))


def score_texts(docs: DataFrame, query: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every matching text: texts are read once, for statistics and scores; no postings, no shuffle of texts."""
    parsed = parse(query)
    wanted = [c for c in parsed.clauses if c.occur != "-"]
    if not wanted:
        return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    sought = list(dict.fromkeys([*[(t,) for t in parsed.terms], *[c.terms for c in parsed.clauses]]))
    place = {phrase: i + 1 for i, phrase in enumerate(sought)}
    counted = counted_texts(docs, sought, id_col, text)
    dl = F.col("c")[0]
    dfs = F.array(*[F.count_if(F.col("c")[place[(t,)]] > 0) for t in parsed.terms])
    # One subquery for all statistics: every use of it is the same plan, which runs once.
    stats = counted.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(dl).alias("avgdl"), dfs.alias("df")).alias("s")).scalar()
    number = {t: i for i, t in enumerate(parsed.terms)}
    total, passes = F.lit(0.0), F.lit(True)
    for clause in parsed.clauses:
        x = F.col("c")[place[clause.terms]]
        if clause.occur:
            passes = passes & ((x > 0) if clause.occur == "+" else (x == 0))
        if clause.occur != "-":
            idf = sum((rarity(stats["df"][number[t]], stats["n"]) for t in clause.terms), F.lit(0.0))
            total = total + F.when(x > 0, idf * saturation(x, dl, stats["avgdl"])).otherwise(0.0)
    if not any(c.occur == "+" for c in wanted):
        any_of = [F.col("c")[place[c.terms]] > 0 for c in wanted]
        passes = passes & functools.reduce(lambda a, b: a | b, any_of)
    return counted.where(passes).select("doc_id", total.alias("score"))


def search_texts(docs: DataFrame, query: str, k: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best ids, each once, so that repeats never take a place."""
    scored = score_texts(docs, query, id_col, text)
    return scored.groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), F.asc("doc_id")).limit(k)
