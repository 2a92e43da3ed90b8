"""Removal of boilerplate lines by the spread of their sites, in DataFrame functions only.

1. Spread. Every distinct line of a document, trimmed, becomes a 64-bit hash
   with its site. One aggregation by hash merges HyperLogLog++ sketches of the
   sites (fixed-size registers, combined before the shuffle) and keeps the
   least id of a document that has the line.
2. Verdict. A line whose estimate is clear of the threshold by more than the
   sketch's error band is decided by it; the lines near the threshold, and only
   they, get exact distinct counts of their sites, from pairs of line and site
   that are made distinct before they meet.
3. Documents. With ``least_words``, a line also goes by the number of different
   documents that hold it, on however few sites: at least LEAST_DOCUMENTS, and
   so many that words x documents is ``least_words``. Documents differ for a line
   if their first or last other line, in the order of the lines' bytes, does, so
   copies of one document count once, near copies unless those ends differ. The counts are
   exact: pairs of line and such ends are made distinct before they meet.
4. Removal. A line on at least ``min_sites`` sites goes from all documents but
   stays once in the document with the least id (its first place there), so no
   text is lost to the corpus. Only hashes travel to the documents, by id and
   hash of the text; the text is rebuilt in its row.

Defined results: empty lines (after trimming) always stay; a null text has no
lines and stays null; a null site counts for no line; a null id is never the
first, and a line that only rows without an id hold stays in all of them; rows
that share an id are judged each by its own text, and all of them are the least
if their id is; a text all of whose lines go becomes empty; a very long text is
split whole, in its row; an empty table gives no rows; further columns are kept,
and the operator's own output names replace input columns of those names.
64-bit hashes stand for lines: of n different lines about n * n / 2**65 pairs
are taken for equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import materialise, table, without

MIN_SITES = 10
#: Of the count by documents: few for lines of many words, more for short ones.
LEAST_DOCUMENTS, LEAST_WORDS = 3, 24
#: Relative standard error of the sketches, and how many of them "near" the threshold means.
ERROR, BAND = 0.1, 4.0
BLANK = " \t\r"


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANK)))


def _spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h, first) of the lines on at least ``min_sites`` sites."""
    sketched = lines.groupBy("h").agg(F.approx_count_distinct("site", ERROR).alias("sites"), F.min("id").alias("first"))
    low, high = min_sites * (1 - BAND * ERROR), min_sites * (1 + BAND * ERROR)
    candidates = sketched.where(F.col("sites") >= low)
    clear = candidates.where(F.col("sites") > high).select("h", "first")
    near = candidates.where(F.col("sites") <= high).select("h", "first")
    pairs = lines.groupBy("h", "site").agg(F.count(F.lit(1)).alias("n")).where("site is not null")
    counted = pairs.join(near, "h").groupBy("h").agg(F.count(F.lit(1)).alias("sites"), F.min("first").alias("first"))
    return clear.unionByName(counted.where(F.col("sites") >= min_sites).select("h", "first")).where("first is not null")


def _repeated(lines: DataFrame, least_words: int) -> DataFrame:
    """(h, first) of the lines in enough different documents for their words."""
    pairs = lines.groupBy("h", "ends").agg(F.min("id").alias("first"), F.min("words").alias("words"))
    counted = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("documents"), F.min("first").alias("first"), F.min("words").alias("words"))
    enough = (F.col("documents") >= LEAST_DOCUMENTS) & (F.col("documents") * F.col("words") >= least_words)
    return counted.where(enough & F.col("first").isNotNull()).select("h", "first")


def _ends(h: Column) -> Column:
    """A hash of the least and the greatest line of ``sorted`` other than ``h``; the same for all documents without another line."""

    def other(one: int, next_to_it: int) -> Column:
        a, b = (F.xxhash64(F.try_element_at("sorted", F.lit(i))) for i in (one, next_to_it))
        return F.when(a != h, a).when(F.size("sorted") > 1, b)

    return F.xxhash64(other(1, 2), other(-1, -2))


def drop_boilerplate(
    df: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, least_words: int | None = None
) -> DataFrame:
    """All columns, the text without boilerplate lines, with n_lines, n_removed and emptied (only blank lines are left)."""
    split = F.split(F.col(text), "\n")
    kept_lines = F.filter(split, lambda x: F.btrim(x, F.lit(BLANK)) != "")
    own = [F.col(key).alias("id"), F.xxhash64(text).alias("at"), F.when(F.col(site).isNotNull(), F.xxhash64(F.col(site))).alias("site")]
    # Texts are split and hashed once; what follows reads the hashes three times.
    if least_words is None:
        hashed = df.select(*own, F.array_distinct(F.transform(kept_lines, line_hash)).alias("hs"))
        lines = materialise(hashed.select("id", "at", "site", F.size("hs").alias("of"), F.explode("hs").alias("h")), "lines")
        spread = _spread(lines, min_sites)
    else:
        trimmed = F.transform(kept_lines, lambda x: F.btrim(x, F.lit(BLANK)))
        listed = df.select(*own, F.sort_array(F.array_distinct(trimmed)).alias("sorted"))
        single = listed.select("id", "at", "site", F.size("sorted").alias("of"), "sorted", F.explode("sorted").alias("line"))
        h = F.xxhash64("line")
        words = F.size(F.split("line", f"[{BLANK}]+"))
        lines = materialise(single.select("id", "at", "site", "of", h.alias("h"), words.alias("words"), _ends(h).alias("ends")), "lines")
        spread = _spread(lines, min_sites).unionByName(_repeated(lines, least_words)).dropDuplicates(["h"])
    flagged = (
        lines.select("id", "at", "of", "h")
        .join(spread, "h")
        .groupBy("id", "at")
        .agg(
            F.collect_set("h").alias("__gone"),
            F.collect_set(F.when(F.col("id") == F.col("first"), F.col("h"))).alias("__once"),
            F.max("of").alias("__of"),
        )
        .withColumnsRenamed({"id": "__id", "at": "__at"})
    )
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__at"))
    rows = without(df, "n_lines", "n_removed", "emptied").join(flagged, same, "left")
    rows = rows.withColumn("__hashes", F.when(F.col("__gone").isNotNull(), F.transform(split, line_hash)))

    def stays(line: Column, i: Column) -> Column:
        h = F.element_at("__hashes", i + 1)
        return (
            F.when(F.btrim(line, F.lit(BLANK)) == "", True)
            .when(~F.array_contains("__gone", h), True)
            .otherwise(F.array_contains("__once", h) & (F.array_position("__hashes", h) == i + 1))
        )

    rows = rows.withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.filter(split, stays)).otherwise(split))
    # Only where a document's lines are all marked need its new text be looked at.
    all_marked = F.coalesce((F.size("__gone") >= F.col("__of")) & (F.size("__once") == 0), F.lit(False))
    blank = F.size(F.filter("__kept", lambda x: F.btrim(x, F.lit(BLANK)) != "")) == 0
    return rows.withColumns(
        {
            "emptied": F.when(all_marked, blank).otherwise(False),
            "n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size(split) - F.size("__kept"), F.lit(0)).cast("long"),
            text: F.when(F.col("__gone").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col(text)),
        }
    ).drop("__id", "__at", "__of", "__gone", "__once", "__hashes", "__kept")


def _result(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op1_line_dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sites, as op1_line_dedup, and by different documents."""
    return _result(drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), least_words=LEAST_WORDS))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
s AS (SELECT k, count(DISTINCT source) AS sites, min(doc_id) AS first FROM t WHERE k <> '' GROUP BY k),
r AS (SELECT t.doc_id, t.i, t.line,
        coalesce(s.sites >= {MIN_SITES}, false) AND NOT (t.doc_id = s.first
          AND row_number() OVER (PARTITION BY t.doc_id, t.k ORDER BY t.i) = 1) AS gone
      FROM t LEFT JOIN s ON t.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS BIGINT) AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

#: The same with the count by documents.
ORACLE_DOCUMENTS = f"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
s AS (SELECT k, count(DISTINCT source) AS sites, min(doc_id) AS first FROM t WHERE k <> '' GROUP BY k),
b AS (SELECT doc_id, list_sort(list(DISTINCT k)) AS ks FROM t WHERE k <> '' GROUP BY doc_id),
u AS (SELECT ks, unnest(ks) AS k FROM b),
e AS (SELECT DISTINCT k, CASE WHEN ks[1] = k THEN ks[2] ELSE ks[1] END AS lo, CASE WHEN ks[-1] = k THEN ks[-2] ELSE ks[-1] END AS hi FROM u),
c AS (SELECT k, count(*) AS documents, len(regexp_split_to_array(k, '[ ' || chr(9) || chr(13) || ']+')) AS words FROM e GROUP BY k),
g AS (SELECT k, first, sites >= {MIN_SITES} OR (documents >= {LEAST_DOCUMENTS} AND documents * words >= {LEAST_WORDS}) AS goes
      FROM s JOIN c USING (k)),
r AS (SELECT t.doc_id, t.i, t.line,
        coalesce(g.goes, false) AND NOT (t.doc_id = g.first
          AND row_number() OVER (PARTITION BY t.doc_id, t.k ORDER BY t.i) = 1) AS gone
      FROM t LEFT JOIN g ON t.k = g.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS BIGINT) AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
