"""The registered queries of the retrieval engine and their SQL.

The driver's tables stand in for the engine's: documents for texts, embeddings
(by vec_id = doc_id) for vectors, events for the write-ahead log (keyed by user,
``error`` deletes), labels, pages and conversations for metadata.
"""

from __future__ import annotations

import dataclasses
import json
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.functions import arrays, hashing, text
from quillspan.functions.embed import HashingEmbedder
from quillspan.model import Document, IndexManifest, SearchRequest, Shard
from quillspan.operators import filters, hybrid, keyword, rank, snapshot, turbo, validate, vector
from quillspan.sources import publish, release, static, wal
from quillspan.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Words of the keyword queries.
WORDS = "idiot thonere inoror shedre eaux licensed"
CODES = (-0.19, -0.06, 0.06, 0.19)
K = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query of the vector searches: the vector with id 0."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding")


def hundredths(spark: SparkSession, sf_dir: str) -> dict[str, list[float]]:
    """The queries of the batch searches: the vectors whose id is divisible by 100."""
    own = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0 and embedding is not null").orderBy("vec_id").collect()
    return {str(r.vec_id): r.embedding for r in own}


def scratch(spark: SparkSession) -> Path:
    """A folder for a store, which needs a mounted one: in that which driver and executors share, a local one only where none is named."""
    shared = re.sub(r"^file:(//)?(?=/)", "", spark.conf.get("spark.checkpoint.dir", None) or "")
    if not shared:
        return Path(tempfile.mkdtemp(prefix="quillspan-store-"))
    if not shared.startswith("/"):
        raise ValueError(f"a store needs a mounted folder, not {shared}")
    return Path(shared) / f"quillspan-store-{uuid.uuid4().hex}"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with metadata of language, source and length."""
    d = table(spark, sf_dir, "documents")
    meta = F.to_json(F.struct("lang", "source", "n_chars"))
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), "text", meta.alias("metadata"))


#: Folders of keyword tables by application, table and its state.
_WORDS: dict[tuple, str] = {}


def words_index(spark: SparkSession, sf_dir: str) -> keyword.KeywordIndex:
    """Keyword tables of the documents as an index version has them: written once an application, again if the documents change."""
    jvm, where = spark.sparkContext._jvm, f"{sf_dir}/documents.parquet"
    path = jvm.org.apache.hadoop.fs.Path(where)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, where, files.getFileStatus(path).getModificationTime(), files.getContentSummary(path).getLength())
    done = jvm.org.apache.hadoop.fs.Path(f"{_WORDS[key]}/stats") if key in _WORDS else None
    if done is None or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillspan-words-")
        folder = f"{shared.rstrip('/')}/quillspan-words-{uuid.uuid4().hex}"
        publish.write_words(table(spark, sf_dir, "documents"), folder)
        _WORDS[key] = folder
    return publish.read_words(spark, _WORDS[key])


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- SQL that several queries share -------------------------------------------------------------

DOT = "list_dot_product(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"
VEC = f"vec AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, {DOT} AS dot FROM embeddings e)"
CLAMP = "greatest(0.0, least(1.0, dot))"
TERMS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) < 40)"
_LIST = ", ".join(f"'{w}'" for w in WORDS.split())
BM25 = f"""
ts AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {TERMS} AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM ts),
po AS (SELECT doc_id, len(ts) AS dl, q.term, len(list_filter(ts, lambda t: t = q.term)) AS tf
       FROM ts, (SELECT unnest([{_LIST}]) AS term) q),
hits AS (SELECT * FROM po WHERE tf > 0),
fr AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
kw AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM hits JOIN fr USING (term), st GROUP BY doc_id)"""
RRF = "CAST(coalesce(CAST(1.0::DOUBLE / (60 + vrank) AS FLOAT), 0) + coalesce(CAST(1.0::DOUBLE / (60 + krank) AS FLOAT), 0) AS FLOAT)"
W30 = "SELECT *, row_number() OVER (ORDER BY {s} DESC, doc_id) AS raw FROM {t} QUALIFY raw <= {n}"
META = "json_object('lang', lang, 'source', source, 'n_chars', n_chars)"


# --- vector search ------------------------------------------------------------------------------


@query(f"WITH {VEC}, t AS (SELECT * FROM vec ORDER BY dot DESC, doc_id LIMIT {K}) SELECT doc_id, round({CLAMP}, 6) AS score FROM t")
def vector_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search(vectors(spark, sf_dir), first_vector(spark, sf_dir), K).select("doc_id", r6("score").alias("score"))


@query(
    f"""WITH {VEC}, n AS (SELECT doc_id, -dot AS dot FROM vec), t AS (SELECT * FROM n ORDER BY dot DESC, doc_id LIMIT 400)
    SELECT doc_id, round({CLAMP}, 6) AS score, row_number() OVER (ORDER BY {CLAMP} DESC, doc_id) AS rank FROM t"""
)
def vector_clamp_resort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep enough that scores clamp to 0 and tie: ids order them."""
    opposite = [-x for x in first_vector(spark, sf_dir)]
    found = vector.search(vectors(spark, sf_dir), opposite, 400)
    return rank.with_rank(found, "rank").select("doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {VEC}, s AS (SELECT *, row_number() OVER (PARTITION BY CAST(doc_id AS BIGINT) % 4 ORDER BY dot DESC, doc_id) AS r FROM vec),
    b AS (SELECT doc_id, max({CLAMP}) AS score FROM s WHERE r <= {K} GROUP BY doc_id)
    SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT {K}"""
)
def vector_sharded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = F.pmod(F.col("doc_id").cast("long"), F.lit(4))
    return vector.search_shards(vectors(spark, sf_dir), shard, first_vector(spark, sf_dir), K).select("doc_id", r6("score").alias("score"))


@query(
    """WITH q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS doc_id, list_dot_product(CAST(embedding AS DOUBLE[]), qv) AS dot FROM embeddings, q),
    t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 9) DESC, doc_id) <= 10)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY greatest(0.0, least(1.0, dot)) DESC, doc_id) AS rank FROM t"""
)
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the hits of every vector whose id is divisible by 100."""
    found = vector.search_batch(vectors(spark, sf_dir), hundredths(spark, sf_dir), K)
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS doc_id, list_dot_product(CAST(embedding AS DOUBLE[]), qv) AS dot FROM embeddings, q),
    t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 9) DESC, doc_id) <= 10)
    SELECT query_id, doc_id, round(greatest(0.0, least(1.0, dot)), 6) AS score FROM t"""
)
def vector_batch_topk_hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all: the queries grow with the table."""
    found = vector.search_batch(vectors(spark, sf_dir), hundredths(spark, sf_dir), K)
    return found.select("query_id", "doc_id", r6("score").alias("score"))


# --- keyword search -----------------------------------------------------------------------------


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM kw ORDER BY kw.score DESC, doc_id LIMIT 20")
def keyword_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.search_texts(table(spark, sf_dir, "documents"), WORDS, 20).select("doc_id", r6("score").alias("score"))


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM kw ORDER BY kw.score DESC, doc_id LIMIT 20")
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through written postings."""
    return keyword.search_index(words_index(spark, sf_dir), WORDS, 20).select("doc_id", r6("score").alias("score"))


#: A phrase, a term, a term that must not be there, and a phrase without hits.
CLAUSES = 'idiot "apache license" -trash "license apache"'


@query(
    f"""WITH ts AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {TERMS} AS ts FROM documents),
    st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl, count_if(list_contains(ts, 'idiot')) AS a, count_if(list_contains(ts, 'apache')) AS b,
      count_if(list_contains(ts, 'license')) AS c FROM ts),
    tf AS (SELECT doc_id, len(ts) AS dl, list_contains(ts, 'trash') AS bad, len(list_filter(ts, lambda t: t = 'idiot')) AS x,
      len(list_filter(list_zip(ts, ts[2:]), lambda p: p[1] = 'apache' AND p[2] = 'license')) AS y FROM ts)
    SELECT doc_id, round(ln(1 + (n - a + 0.5) / (a + 0.5)) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * dl / avgdl))
      + (ln(1 + (n - b + 0.5) / (b + 0.5)) + ln(1 + (n - c + 0.5) / (c + 0.5))) * y * 2.2 / (y + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score
    FROM tf, st WHERE NOT bad AND x + y > 0"""
)
def keyword_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.score_texts(table(spark, sf_dir, "documents"), CLAUSES).select("doc_id", r6("score").alias("score"))


@query(
    f"""WITH {BM25}, f AS (SELECT CAST(CAST(doc_id AS BIGINT) % 50 AS VARCHAR) AS doc_id, score FROM kw)
    SELECT doc_id, round(max(score), 6) AS score FROM f GROUP BY doc_id ORDER BY max(f.score) DESC, doc_id LIMIT 20"""
)
def keyword_backfill_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty different ids although ids repeat."""
    scored = keyword.score_texts(table(spark, sf_dir, "documents"), WORDS)
    folded = scored.select(F.pmod(F.col("doc_id").cast("long"), F.lit(50)).cast("string").alias("doc_id"), "score")
    return rank.best_per_id(folded).orderBy(*rank.by_score()).limit(20).select("doc_id", r6("score").alias("score"))


@query(
    f"""WITH ts AS (SELECT doc_id, {TERMS} AS ts FROM documents), p AS (SELECT DISTINCT doc_id, unnest(ts) AS term FROM ts)
    SELECT (SELECT count(*) FROM ts) AS n_docs, (SELECT round(avg(len(ts)), 6) FROM ts) AS avgdl,
      count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM p"""
)
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = keyword.build_index(table(spark, sf_dir, "documents"))
    terms = index.frequencies.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))
    return terms.select(
        index.stats.select("n").scalar().alias("n_docs"), F.round(index.stats.select("avgdl").scalar(), 6).alias("avgdl"), "n_terms", "n_postings"
    )


# --- ranking and fusion -------------------------------------------------------------------------


@query(
    """WITH u AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, n_chars / 1000.0::DOUBLE AS score FROM documents
      UNION ALL SELECT CAST(doc_id AS VARCHAR), quality * 2.0::DOUBLE + toxic FROM labels)
    SELECT doc_id, round(max(score), 6) AS score FROM u GROUP BY doc_id"""
)
def dedupe_best_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("n_chars") / 1000.0).alias("score"))
    b = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("quality") * 2.0 + F.col("toxic")).alias("score"))
    return rank.best_per_id(a.unionByName(b)).select("doc_id", r6("score").alias("score"))


_FUSED = f"""WITH {VEC}, {BM25},
v AS (SELECT doc_id, row_number() OVER (ORDER BY {CLAMP} DESC, doc_id) AS vrank FROM ({W30.format(s="dot", t="vec", n=30)})),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS krank FROM ({W30.format(s="score", t="kw", n=30)})),
f AS (SELECT doc_id, vrank, krank, {RRF} AS score FROM v FULL OUTER JOIN k USING (doc_id))"""


@query(_FUSED + " SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score, coalesce(vrank, 0) AS vector_rank, coalesce(krank, 0) AS keyword_rank FROM f")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vector.search(vectors(spark, sf_dir), first_vector(spark, sf_dir), 30)
    w = keyword.search_texts(table(spark, sf_dir, "documents"), WORDS, 30)
    f = rank.fuse(v, w)
    return f.select("doc_id", r6(F.col("score").cast("double")).alias("score"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("vector_rank", "keyword_rank")])


@query(
    """SELECT e.event_id, json_merge_patch(json_object('k', d.n_chars, 'lang', d.lang, 'source', d.source), e.props) ->> '$.k' AS k,
      d.lang AS lang, d.source AS source FROM events e JOIN documents d ON e.event_id = d.doc_id"""
)
def rrf_payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two payloads of an id: keys of the first win, the rest is united."""
    e, d = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    both = e.join(d, e.event_id == d.doc_id)
    second = F.to_json(F.struct(F.col("n_chars").alias("k"), "lang", "source"))
    merged = rank.entries_json(rank.merge_metadata(rank.object_entries(F.col("props")), rank.object_entries(second)))
    out = both.select("event_id", merged.alias("m"))
    return out.select("event_id", *[F.get_json_object("m", f"$.{c}").alias(c) for c in ("k", "lang", "source")])


# --- hybrid search ------------------------------------------------------------------------------


@query(
    _FUSED
    + f""", j AS (SELECT f.*, {META} AS metadata, d.text FROM f JOIN documents d ON f.doc_id = CAST(d.doc_id AS VARCHAR) ORDER BY f.score DESC, f.doc_id LIMIT 30)
    SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score, 'hybrid' AS source, sha256(text) AS text_sha256, metadata ->> '$.lang' AS lang FROM j"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = SearchRequest(WORDS, 10)
    words = keyword.search_index(words_index(spark, sf_dir), WORDS, 100)
    found = hybrid.search(docs(spark, sf_dir), vectors(spark, sf_dir), request, first_vector(spark, sf_dir), keyword_list=words).dynamic
    return found.select(
        "doc_id",
        r6(F.col("score").cast("double")).alias("score"),
        "source",
        F.sha2("text", 256).alias("text_sha256"),
        F.get_json_object("metadata", "$.lang").alias("lang"),
    )


@query(f"WITH {BM25} SELECT doc_id, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 4) AS score, 'keyword' AS source FROM kw ORDER BY kw.score DESC, doc_id LIMIT 30")
def keyword_only_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query has no vector: keyword scores stay as they are."""
    found = hybrid.search(docs(spark, sf_dir), vectors(spark, sf_dir), SearchRequest(WORDS, 10), None).dynamic
    return found.select("doc_id", F.round(F.col("score").cast("double"), 4).alias("score"), "source")


_STEPS = [(0, 15), (1, 30), (2, 60), (3, 100), (4, 100), (5, 100)]
_STEP_ROWS = ", ".join(f"({i}, {w})" for i, w in _STEPS)


@query(
    f"""WITH {VEC}, {BM25}, w AS (SELECT * FROM (VALUES {_STEP_ROWS}) x(step, win)),
    v AS (SELECT step, doc_id, row_number() OVER (PARTITION BY step ORDER BY {CLAMP} DESC, doc_id) AS vrank
          FROM ({W30.format(s="dot", t="vec", n=100)}), w WHERE raw <= win),
    k AS (SELECT step, doc_id, row_number() OVER (PARTITION BY step ORDER BY score DESC, doc_id) AS krank
          FROM ({W30.format(s="score", t="kw", n=100)}), w WHERE raw <= win),
    f AS (SELECT step, doc_id, {RRF} AS score FROM v FULL OUTER JOIN k USING (step, doc_id)),
    p AS (SELECT f.*, d.source AS src FROM f JOIN documents d ON f.doc_id = CAST(d.doc_id AS VARCHAR) WHERE d.lang = 'en'),
    c AS (SELECT coalesce(min(step), 5) AS step FROM (SELECT step FROM p GROUP BY step HAVING count(*) >= 5))
    SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score, src FROM p JOIN c USING (step) ORDER BY p.score DESC, doc_id LIMIT 15"""
)
def filtered_hybrid_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = SearchRequest(WORDS, 5, {"lang": "en"})
    words = keyword.search_index(words_index(spark, sf_dir), WORDS, 100)
    found = hybrid.search(docs(spark, sf_dir), vectors(spark, sf_dir), request, first_vector(spark, sf_dir), keyword_list=words).dynamic
    return found.select("doc_id", r6(F.col("score").cast("double")).alias("score"), F.get_json_object("metadata", "$.source").alias("src"))


# --- filters, citations, validation -------------------------------------------------------------


@query("SELECT event_id, event_type FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(props ->> '$.k' AS DOUBLE) = 7 AND event_type = 'click'")
def metadata_filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    flat = e.select("event_id", "event_type", F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","k":'), k, F.lit("}")).alias("metadata"))
    return filters.apply_filters(flat, {"k": 7, "type": "click"}).select("event_id", "event_type")


@query(
    """SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(page_id AS VARCHAR) AS resource_id, url, CAST(NULL AS VARCHAR) AS metadata
    FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT CAST(page_id AS VARCHAR), NULL, NULL, NULL FROM pages WHERE page_id % 2 = 1"""
)
def strip_metadata_keep_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd pages lack a source type and so a citation."""
    p = table(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 2 == 0, F.lit("page"))
    meta = F.to_json(F.struct(F.col("page_id").cast("string").alias("resource_id"), kind.alias("source_type"), F.col("url").alias("source_ref"), "url"))
    cited = p.select(F.col("page_id").cast("string").alias("doc_id"), meta.alias("metadata")).withColumn("c", text.citation(F.col("metadata")))
    return filters.strip_metadata(cited).select("doc_id", "c.resource_id", "c.url", "metadata")


@query(
    """SELECT CAST(page_id AS VARCHAR) AS doc_id,
      CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'page ' || page_id END AS title,
      CASE WHEN page_id % 3 = 0 THEN 'page' WHEN page_id % 3 = 1 THEN '法规' END AS source_type FROM pages"""
)
def citation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole citation, else the title's, else none."""
    p = table(spark, sf_dir, "pages")
    third = F.col("page_id") % 3
    page_id = F.col("page_id").cast("string")
    meta = F.when(third == 0, F.to_json(F.struct(page_id.alias("resource_id"), F.lit("page").alias("source_type"), F.col("url").alias("source_ref"), F.col("url").alias("title"))))
    meta = meta.when(third == 1, F.to_json(F.struct(F.concat(F.lit("page "), page_id).alias("title")))).otherwise('{"title": 5}')
    cited = text.static_citation(meta, page_id, F.lit("legal"))
    return p.select(page_id.alias("doc_id"), cited.alias("c")).select("doc_id", "c.title", "c.source_type")


@query(
    """SELECT coalesce(CASE WHEN text IS NULL OR text = '' THEN 'text is required'
        WHEN strlen(text) > 100000 THEN 'text exceeds the maximum size of 100000 bytes'
        WHEN d.doc_id % 7 = 0 THEN 'metadata has an invalid value' WHEN d.doc_id % 11 = 0 THEN 'timestamp has an invalid value' END, 'valid') AS verdict,
      count(*) AS n FROM documents d GROUP BY 1"""
)
def document_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").alias("d").join(table(spark, sf_dir, "embeddings").alias("e"), F.col("d.doc_id") == F.col("e.vec_id"), "left")
    n = F.col("d.doc_id")
    meta = F.when(n % 7 == 0, "[1]").otherwise(F.to_json(F.struct("lang")))
    stamp = F.when(n % 11 == 0, F.lit(999)).otherwise(F.lit(1_700_000_000_000)).cast("long")
    error = validate.document_error(n.cast("string"), F.col("text"), F.col("embedding"), meta, stamp, 64)
    return d.select(F.coalesce(error, F.lit("valid")).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, len(embedding) = 64 AS valid, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def embedding_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", arrays.valid_embedding(F.col("embedding"), 64).alias("valid"), r6(arrays.norm(F.col("embedding"))).alias("norm"))


# --- write-ahead log ----------------------------------------------------------------------------


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("doc_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.date_format("ts", "yyyy/MM/dd").alias("segment"),
        F.format_string("%012d", "event_id").alias("event_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.struct(F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("text"), F.col("props").alias("metadata"), "value").alias("document"),
    )


_LWW = """SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type AS text, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, strftime(ts, '%Y/%m/%d') DESC, event_id DESC) AS r FROM events)
  WHERE r = 1 AND event_type <> 'error'"""


@query(_LWW)
def wal_lww_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.live_documents(change_log(spark, sf_dir)).select("doc_id", "text", r6("value").alias("value"))


@query("SELECT event_id, 'wal/' || strftime(ts, '%Y/%m/%d') || '/segment-' || (event_id % 10) || '.jsonl' AS wal_key FROM events")
def wal_segment_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select("event_id", text.segment_key(millis, F.concat(F.lit("segment-"), (F.col("event_id") % 10).cast("string"))).alias("wal_key"))


@query(
    """SELECT event_id AS source_id, 'batch-' || (event_id // 1000) || '-' || lpad(CAST(row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS VARCHAR), 6, '0') AS event_id,
      CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events"""
)
def wal_batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids number a batch's records in input order."""
    e = table(spark, sf_dir, "events").withColumn("b", F.floor(F.col("event_id") / 1000))
    n = F.row_number().over(Window.partitionBy("b").orderBy("event_id"))
    name = F.concat(F.lit("batch-"), F.col("b").cast("string"))
    return e.select(F.col("event_id").alias("source_id"), text.event_id(name, n).alias("event_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))


@query("SELECT DISTINCT 'wal/' || strftime(ts, '%Y/%m/%d') || '/s.jsonl' AS wal_key FROM events UNION SELECT 'wal/2001/02/03/late.jsonl'")
def wal_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for every day; the log's keys and a trigger's that is not listed yet, each once."""
    log = wal.WriteLog(Store(scratch(spark)))
    days = table(spark, sf_dir, "events").select(F.unix_millis(F.date_trunc("day", "ts").cast("timestamp")).alias("ms")).distinct()
    for row in days.toLocalIterator():
        log.store.create(wal.segment_key(row["ms"], "s"), b"")
    return spark.createDataFrame([(k,) for k in log.keys("wal/2001/02/03/late.jsonl")], "wal_key string")


@query(
    """SELECT strftime(ts, '%Y/%m/%d') AS segment, 'e-' || event_id AS event_id, CAST(user_id AS VARCHAR) AS doc_id,
      CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN event_type <> 'error' THEN event_type END AS text, epoch_us(ts) // 1000 AS timestamp FROM events"""
)
def wal_records_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the log, read and checked."""
    e = table(spark, sf_dir, "events")
    stamp = F.unix_millis(F.col("ts").cast("timestamp"))
    doc_id, live = F.col("user_id").cast("string"), F.col("event_type") != "error"
    document = F.when(live, F.struct(doc_id.alias("doc_id"), F.col("event_type").alias("text"), F.struct(F.col("props").alias("p")).alias("metadata"), stamp.alias("timestamp")))
    record = F.struct(
        F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("event_id"),
        doc_id.alias("doc_id"),
        F.when(live, "upsert").otherwise("delete").alias("op"),
        document.alias("document"),
        stamp.alias("timestamp"),
    )
    lines = e.select(F.to_json(record).alias("value"), F.date_format("ts", "yyyy/MM/dd").alias("segment"))
    return wal.typed(lines).select("segment", "event_id", "doc_id", "op", "document.text", "timestamp")


@query(_LWW)
def wal_late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd half of the log first, then the even half as late records: the older timestamp loses whenever it comes."""
    log = change_log(spark, sf_dir)
    odd = F.col("event_id").cast("long") % 2 == 1
    state = snapshot.last_writes(log.where(odd))
    return snapshot.live_documents(state.unionByName(log.where(~odd))).select("doc_id", "text", r6("value").alias("value"))


# --- stores, versions and releases --------------------------------------------------------------

STAMP = 1_700_000_000_000


def nations(spark: SparkSession, sf_dir: str) -> list[Document]:
    rows = table(spark, sf_dir, "nation").collect()  # a batch of a writer's: 25 rows at every scale
    return [Document(f"n{r.n_nationkey}", f"{r.n_name} of region {r.n_regionkey}", {"region": r.n_regionkey, "title": r.n_name}, STAMP) for r in rows]


def built(spark: SparkSession, sf_dir: str, shards: int = 1) -> tuple[Store, IndexManifest, HashingEmbedder]:
    """Nations written to a log, those of region 0 deleted, the log built and published as version 1."""
    store, embedder = Store(scratch(spark)), HashingEmbedder(32)
    stamps = iter(range(STAMP + 1, STAMP + 1000))
    log = wal.WriteLog(store, lambda: next(stamps))
    written = nations(spark, sf_dir)
    log.ingest(written)
    log.delete([d.doc_id for d in written if d.metadata["region"] == 0])
    manifest = publish.build(spark, store, 1, log.keys(), embedder.column, embedder.dim, lambda: STAMP, shards=shards)
    publish.publish(store, manifest, STAMP)
    return store, manifest, embedder


@query(
    """SELECT 'n' || n_nationkey AS doc_id, n_name || ' of region ' || n_regionkey AS text, n_name AS title, 1 AS version_id,
      (SELECT count(*) FROM nation WHERE n_regionkey <> 0) AS document_count FROM nation WHERE n_regionkey <> 0"""
)
def index_version_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, built, published, and read through the pointer."""
    store = built(spark, sf_dir)[0]
    head, manifest = publish.load_active(store)
    found = publish.read_tables(spark, store, manifest).documents
    title = text.title(F.col("metadata"))
    return found.select("doc_id", "text", title.alias("title"), F.lit(head["version_id"]).alias("version_id"), F.lit(manifest.document_count).cast("long").alias("document_count"))


@query(
    """WITH d AS (SELECT 'n' || n_nationkey AS doc_id, unnest(regexp_split_to_array(lower(n_name || ' of region ' || n_regionkey), '[^\\p{L}\\p{N}]+')) AS term
      FROM nation WHERE n_regionkey <> 0)
    SELECT term, count(*) AS postings, count(DISTINCT doc_id) AS df FROM d GROUP BY term"""
)
def index_version_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword tables of the published version."""
    store, manifest, _ = built(spark, sf_dir)
    words = publish.read_tables(spark, store, manifest).keyword
    summed = words.postings.groupBy("term").agg(F.sum("tf").alias("postings"))
    return summed.join(words.frequencies, "term").select("term", "postings", "df")


@query("SELECT 'n' || n_nationkey AS doc_id FROM nation WHERE n_regionkey <> 0")
def index_version_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of three shards, searched for all its vectors."""
    store, manifest, embedder = built(spark, sf_dir, 3)
    found = publish.read_tables(spark, store, manifest)
    return vector.search_shards(found.documents, F.col("shard"), embedder.query("nation of region"), 100).select("doc_id")


@query("SELECT * FROM (VALUES ('publish', 1, 2), ('rollback', 2, 1), ('publish', 1, 3)) t(move, previous_version_id, activated_version_id)")
def index_version_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pointer through a second version, back, and on to a third."""
    store, _, embedder = built(spark, sf_dir)
    log, moves = wal.WriteLog(store), []
    for move, version in (("publish", 2), ("rollback", 1), ("publish", 3)):
        if move == "publish":
            manifest = publish.build(spark, store, version, log.keys(), embedder.column, embedder.dim)
            done = publish.publish(store, manifest, STAMP, publish.active_version(store))
        else:
            done = publish.rollback(store, version, STAMP, publish.active_version(store))
        moves.append((move, done["previous_version_id"], done["activated_version_id"]))
    return spark.createDataFrame(moves, "move string, previous_version_id int, activated_version_id int")


@query(
    """SELECT 'd' || doc_id AS doc_id, sha256(text) AS text_sha256, CASE WHEN doc_id % 2 = 0 THEN 'legal' ELSE 'rfc' END AS corpus_type, lang
    FROM documents WHERE text <> ''"""
)
def static_sources_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines of two sources, blank lines among them, read back as one corpus."""
    folder = scratch(spark)
    d = table(spark, sf_dir, "documents").where("text <> ''")
    line = F.to_json(F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text", F.struct("lang").alias("metadata")))
    sources = []
    for n, kind in enumerate(("legal", "rfc")):
        path = f"file://{folder}/{kind}"
        d.where(F.col("doc_id") % 2 == n).select(F.explode(F.array(F.lit(" "), line)).alias("value")).write.text(path)
        sources.append(static.StaticSource(path, kind))
    return static.read_sources(spark, sources).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "corpus_type", F.get_json_object("metadata", "$.lang").alias("lang"))


@query("SELECT 'n' || n_nationkey AS doc_id, n_name || ' of region ' || n_regionkey AS text, 'rfc' AS corpus_type, (SELECT count(*) FROM nation) AS doc_count FROM nation")
def static_release_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release built, verified, installed, activated, and read through the pointer."""
    store, embedder = Store(scratch(spark)), HashingEmbedder(32)
    made = [(d.doc_id, d.text, json.dumps(d.metadata)) for d in nations(spark, sf_dir)]
    rows = spark.createDataFrame(made, "doc_id string, text string, metadata string").withColumn("embedding", embedder.column(F.col("text")))
    source = release.ReleaseSource("table", "nation", 1, len(made), "rfc")
    release.build_release(rows, turbo.Codec.generate(32), "hashing-32", source, store, "static/staged")
    manifest = release.verify(spark, store.path("static/staged"), "hashing-32", 32)
    release.install(store, store.path("static/staged"), manifest)
    release.activate(store, manifest["release_id"], STAMP)
    records, _ = release.load(spark, store.path(release.release_key(release.active_release(store))))
    return records.select("doc_id", "text", "corpus_type", F.lit(manifest["input_fingerprint"]["doc_count"]).cast("long").alias("doc_count"))


# --- compressed static search -------------------------------------------------------------------

_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_NEAR = "CASE WHEN abs(x + 0.19) <= abs(x + 0.06) AND abs(x + 0.19) <= abs(x - 0.06) AND abs(x + 0.19) <= abs(x - 0.19) THEN 0 WHEN abs(x + 0.06) <= abs(x - 0.06) AND abs(x + 0.06) <= abs(x - 0.19) THEN 1 WHEN abs(x - 0.06) <= abs(x - 0.19) THEN 2 ELSE 3 END"
_ENC = f"""WITH x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: {_NEAR}) AS idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
y AS (SELECT vec_id, idx, list_transform(idx, lambda i: [-0.19::DOUBLE, -0.06, 0.06, 0.19][i + 1]) AS c, v FROM x),
z AS (SELECT vec_id, idx, c, list_transform(list_zip(v, c), lambda p: p[1] - p[2]) AS r FROM y),
e AS (SELECT vec_id, idx, c, r, sqrt(list_dot_product(r, r)) AS gamma FROM z),
s AS (SELECT vec_id, gamma, list_dot_product(c, {_Q}) AS centroid_term,
  list_sum(list_transform(list_zip(r, {_Q}), lambda p: CASE WHEN p[1] >= 0 THEN p[2] ELSE -p[2] END)) AS qjl_term FROM e)"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", turbo.native_code(F.col("embedding"), CODES).alias("code"))


@query(_ENC + " SELECT vec_id, array_to_string(idx, '') AS idx, array_to_string(list_transform(r, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END), '') AS signs, round(gamma, 6) AS gamma FROM e")
def turbo_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coded(spark, sf_dir)
    digits = F.array_join(F.transform("code", lambda e: e["idx"].cast("string")), "")
    signs = F.array_join(F.transform("code", lambda e: F.when(e["r"] >= 0, "1").otherwise("0")), "")
    return c.select("vec_id", digits.alias("idx"), signs.alias("signs"), r6(turbo.native_gamma(F.col("code"))).alias("gamma"))


@query(_ENC + " SELECT vec_id, round(centroid_term, 6) AS centroid_term, round(qjl_term, 6) AS qjl_term, round(gamma, 6) AS gamma FROM s")
def turbo_score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coded(spark, sf_dir)
    a, b = turbo.native_terms(F.col("code"), first_vector(spark, sf_dir))
    return c.select("vec_id", r6(a).alias("centroid_term"), r6(b).alias("qjl_term"), r6(turbo.native_gamma(F.col("code"))).alias("gamma"))


@query(_ENC + " SELECT CAST(vec_id AS VARCHAR) AS doc_id, round(centroid_term + gamma * qjl_term, 4) AS score FROM s ORDER BY centroid_term + gamma * qjl_term DESC LIMIT 15")
def turbo_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the packed records."""
    codec = turbo.Codec.uniform(64, CODES)
    encoded = turbo.encode_table(vectors(spark, sf_dir), codec)
    return turbo.search(encoded, codec, first_vector(spark, sf_dir), 15).select("doc_id", F.round("score", 4).alias("score"))


# Fixed values of the 64-bit FNV-1a hash, in SQL.
_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS HUGEINT))),
  lambda h, b: ((h - h % 256 + CAST(xor(CAST(h % 256 AS BIGINT), CAST(b AS BIGINT)) AS HUGEINT)) % 16777216 * 1099511628211
    + ((h - h % 16777216) // 16777216 * 1099511628211 % 1099511627776) * 16777216) % 18446744073709551616::HUGEINT)"""

_ENC_ALL = _ENC[: _ENC.index("s AS (SELECT")].rstrip().rstrip(",")


def _recall_sql(scale: float) -> str:
    return (
        _ENC_ALL
        + f""", h AS (SELECT vec_id, {_FNV.format("CAST(vec_id AS VARCHAR)")} AS h FROM embeddings),
    q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0),
    w AS (SELECT e.vec_id, h.h, v, list_transform(list_zip(c, r), lambda p: p[1] + {scale}::DOUBLE * gamma * CASE WHEN p[2] >= 0 THEN 1 ELSE -1 END) AS d
          FROM e JOIN x USING (vec_id) JOIN h USING (vec_id)),
    p AS (SELECT query_id, vec_id, h, list_dot_product(d, qv) AS score, list_dot_product(v, qv) AS dot FROM w, q),
    a AS (SELECT query_id, vec_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, h) <= {K}),
    b AS (SELECT query_id, vec_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 9) DESC, CAST(vec_id AS VARCHAR)) <= {K}),
    r AS (SELECT b.query_id, count(a.vec_id) AS hits, count(a.vec_id) / {K}.0::DOUBLE AS recall
          FROM b LEFT JOIN a ON a.query_id = b.query_id AND a.vec_id = b.vec_id GROUP BY b.query_id)
    SELECT CAST(query_id AS VARCHAR) AS query_id, hits, recall, round(avg(recall) OVER (), 6) AS mean_recall, min(recall) OVER () AS min_recall FROM r"""
    )


def _recall(spark: SparkSession, sf_dir: str, scale: float) -> DataFrame:
    queries, codec = hundredths(spark, sf_dir), dataclasses.replace(turbo.Codec.uniform(64, CODES), qjl_scale=scale)
    near = turbo.search_batch(turbo.encode_table(vectors(spark, sf_dir), codec), codec, queries, K)
    found = turbo.recall(near, vector.search_batch(vectors(spark, sf_dir), queries, K), K)
    return found.select("query_id", "hits", "recall", r6("mean_recall").alias("mean_recall"), "min_recall")


@query(_recall_sql(1.0))
def turbo_recall_hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of every vector whose id is divisible by 100 as a query, with its mean and minimum."""
    return _recall(spark, sf_dir, 1.0)


@query(_recall_sql(0.125))
def turbo_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the sign term scaled by one over the square root of the dimension, an extension that finds more."""
    return _recall(spark, sf_dir, 0.125)


@query(
    _ENC_ALL
    + """ SELECT vec_id, array_to_string(list_transform(range(0, 16), lambda k: printf('%02X', CAST(idx[4 * k + 1] + 4 * idx[4 * k + 2] + 16 * idx[4 * k + 3] + 64 * idx[4 * k + 4] AS INTEGER))), '') AS idx,
      array_to_string(list_transform(range(0, 8), lambda k: printf('%02X', CAST(list_sum(list_transform(range(0, 8), lambda j: CASE WHEN r[8 * k + j + 1] >= 0 THEN 1 << j ELSE 0 END)) AS INTEGER))), '') AS qjl,
      round(gamma, 4) AS gamma FROM e"""
)
def turbo_packed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed records' bytes: two bits and one bit a dimension, the first dimension lowest."""
    e = turbo.encode_table(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), turbo.Codec.uniform(64, CODES))
    return e.select("vec_id", F.hex("idx").alias("idx"), F.hex("qjl").alias("qjl"), F.round(F.col("gamma").cast("double"), 4).alias("gamma"))


# --- hashes, digests, contexts ------------------------------------------------------------------



@query(f"SELECT doc_id, CAST({_FNV.format('CAST(doc_id AS VARCHAR)')} AS VARCHAR) AS doc_hash FROM documents")
def fnv1a_doc_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hashing.fnv1a(F.col("doc_id").cast("string")).cast("string").alias("doc_hash"))


@query(
    f"""WITH h AS (SELECT DISTINCT doc_id, {_FNV.format('CAST(doc_id AS VARCHAR)')} AS h FROM documents),
    c AS (SELECT h, count(*) AS n FROM h GROUP BY h)
    SELECT (SELECT count(*) FROM h) AS n_ids, count(*) AS n_hashes, CAST(count_if(n > 1) AS BIGINT) AS n_collisions FROM c"""
)
def hash_collision_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    h = hashing.fnv1a(F.col("doc_id"))
    collisions = validate.hash_collisions(d, "doc_id", h).agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.count_distinct("doc_id").alias("n_ids"), F.count_distinct(h).alias("n_hashes")).select("n_ids", "n_hashes", collisions.scalar().alias("n_collisions"))


@query(
    """WITH r AS (SELECT sha256(strlen(i) || ':' || i || '0:' || strlen(t) || ':' || t || strlen(l) || ':' || l) AS h
      FROM (SELECT CAST(doc_id AS VARCHAR) AS i, coalesce(text, '') AS t, coalesce(lang, '') AS l FROM documents)),
    b AS (SELECT substr(h, 1, 3) AS k, sha256(string_agg(h, '' ORDER BY h)) AS b, count(*) AS n FROM r GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(b, '' ORDER BY k)) AS digest FROM b"""
)
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ids, (no) vectors, texts and languages of all documents, whatever their order."""
    d = table(spark, sf_dir, "documents")
    return hashing.content_digest(d.select(hashing.row_hash(F.col("doc_id"), F.lit(None), F.col("text"), F.col("lang")).alias("h")))


# The ranges of functions.text, in SQL.
_CJK = "[\\x{3000}-\\x{303F}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}\\x{20000}-\\x{2FA1F}\\x{30000}-\\x{3134F}]"


@query(
    f"""WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '.' || turn, text || '合同条款' FROM conversations),
    n AS (SELECT id, length(text) AS a, length(regexp_replace(text, '{_CJK}', '', 'g')) AS o FROM t)
    SELECT id, CAST(a - o + ceil(o / 4.0) AS BIGINT) AS tokens FROM n"""
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    c = table(spark, sf_dir, "conversations")
    c = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), F.concat("text", F.lit("合同条款")).alias("text"))
    return d.unionByName(c).select("id", text.token_estimate(F.col("text")).alias("tokens"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS n FROM documents QUALIFY n <= 5)
    SELECT lang, string_agg('[用户数据 #' || n || ']' || CASE WHEN n % 2 = 0 THEN ' ' || source ELSE '' END || chr(10) || text || chr(10) || chr(10), '' ORDER BY n) AS context FROM r GROUP BY lang"""
)
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    here = Window.partitionBy("lang").orderBy("n_chars", "doc_id")
    top = d.withColumn("n", F.row_number().over(here)).where("n <= 5")
    made = top.select("lang", "n", text.block(F.lit("用户数据"), F.col("n"), F.when(F.col("n") % 2 == 0, F.col("source")), F.col("text")).alias("b"))
    return made.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "b"))), lambda x: x["b"]), "").alias("context"))


@query("SELECT doc_id % 4 AS shard_id, count(*) AS document_count, sum(count(*)) OVER () = (SELECT count(*) FROM documents) AS matches FROM documents GROUP BY 1")
def shard_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's rule on the counts of four shards."""
    d = table(spark, sf_dir, "documents")
    counts = d.groupBy((F.col("doc_id") % 4).alias("shard_id")).agg(F.count(F.lit(1)).alias("document_count"))
    shards = [Shard(r.shard_id, r.document_count, "s3://b/t", "s3://b/k") for r in counts.collect()]
    try:
        IndexManifest(1, STAMP, 64, d.count(), len(shards), shards).validate()
        matches = True
    except ValueError:
        matches = False
    return counts.select("shard_id", "document_count", F.lit(matches).alias("matches"))
