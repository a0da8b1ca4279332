"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentgrade.llm import ann, extraction, jaccard, lexical, linededup, mixing, neardup, packing, quality, runs, sharding, topk, warc
from contentgrade.llm.common import read, stored, word_count
from contentgrade.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extraction.extract_main_text(read(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(read(spark, sf_dir, "pages"), path)
    whole = warc.read_warc_chunks(spark, path, with_payload=False).filter("last")
    return whole.select(
        warc.page_key(F.col("record_id")).cast("bigint").alias("page_id"),
        F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"),
        "record_type",
        warc.page_key(F.col("refers_to")).cast("bigint").alias("refers_to"),
    )


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("group"),
    )
    placed = sharding.shard_by_bytes(rows, size=F.col("size"), group=F.col("group"), order=["doc_id"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(read(spark, sf_dir, "documents"))


@query
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20)


@query
def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), words=3, similarity_percent=85)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), capacity=1024)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.fit_quality(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0, k=10)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    narrow = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    mix = mixing.mix_sources(narrow, size=F.col("size"), key=F.col("doc_id"))
    return mix.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_times")).alias("taken"),
    )


@query
def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(read(spark, sf_dir, "documents"), words=5, similarity_percent=80)


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_lexical(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = runs.find_runs(docs, tail_seed=runs.tail_seed_of(F.col("doc_id")), with_text=False)
    return found.select("doc_id", "n_runs", "best.*", "runs_sha256", "collapsed_sha256")


ORACLE["op10_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total,
             [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
      FROM d GROUP BY source),
a AS (SELECT 1.5::DOUBLE * sum(total)::DOUBLE AS amount FROM s),
w(level, clamped, step) AS (
  SELECT 0.0::DOUBLE, -1::BIGINT, 0
  UNION ALL
  SELECT (SELECT (amount - coalesce(sum(2 * total) FILTER (weight * w.level > 2 * total), 0)::DOUBLE)
               / sum(weight) FILTER (NOT weight * w.level > 2 * total)::DOUBLE FROM s, a GROUP BY amount),
         (SELECT count(*) FILTER (weight * w.level > 2 * total) FROM s), step + 1
  FROM w WHERE clamped < (SELECT count(*) FILTER (weight * w.level > 2 * total) FROM s)),
t AS (SELECT source, total, least((2 * total)::DOUBLE, weight * (SELECT level FROM w ORDER BY step DESC LIMIT 1)) AS target FROM s),
x AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS whole FROM t),
e AS (SELECT *, target - whole * total AS extra, CASE WHEN total > 0 THEN (target - whole * total) / total ELSE 0 END AS fraction FROM x),
j AS (SELECT d.*, e.total, e.target, e.whole, e.extra, e.fraction, d.size * 20 > e.total AS large
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
g AS (SELECT source, u, large, extra, fraction, sum(size) AS s FROM j GROUP BY ALL),
c AS (SELECT *, sum(s) OVER (PARTITION BY source, large ORDER BY u)::DOUBLE AS cum,
             sum(s) OVER (PARTITION BY source, large)::DOUBLE AS all_s FROM g),
b AS (SELECT source, max(u) + 1 AS cut, sum(s)::DOUBLE AS got FROM c
      WHERE large AND 2 * cum - s <= 2 * (fraction * all_s) GROUP BY source),
k AS (SELECT c.source, max(u) + 1 AS cut FROM c LEFT JOIN b ON c.source IS NOT DISTINCT FROM b.source
      WHERE NOT large AND 2 * cum - s <= 2 * (extra - coalesce(got, 0)) GROUP BY c.source)
SELECT j.doc_id, j.size::BIGINT AS size, j.total AS source_size, j.target,
       (j.size * (j.whole + CASE WHEN j.u < coalesce(CASE WHEN large THEN b.cut ELSE k.cut END, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j LEFT JOIN b ON j.source IS NOT DISTINCT FROM b.source LEFT JOIN k ON j.source IS NOT DISTINCT FROM k.source
"""

ORACLE["op9_topk"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.x, d.x)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.x) = len(d.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE["op2_warc"] = """
WITH d AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
x AS (SELECT *, sha1(h) AS hex FROM d)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, (5 * (i // 4) + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM x
"""

ORACLE["op6_neardup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
             ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS grams
      FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
         WHERE 20 * least(a.n, b.n) >= 17 * greatest(a.n, b.n)
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
twoway AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM twoway UNION SELECT r.a, l.b FROM reach r JOIN twoway l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS other FROM reach GROUP BY a)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, least(s.doc_id, coalesce(other, s.doc_id)) AS component_id,
       s.doc_id <= coalesce(other, s.doc_id) AS kept
FROM s LEFT JOIN low ON s.doc_id = low.doc_id
"""

ORACLE["op12_lexical"] = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row_no,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS total, sum(len(terms))::BIGINT AS l FROM t),
e AS (SELECT row_no, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM t),
f AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM e GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, total),
i AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
c AS (SELECT item_id, text, term, count(*) AS times FROM q GROUP BY ALL),
x AS (SELECT item_id, text, row_no, doc_id,
             sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total) // l))))::BIGINT AS score
      FROM c JOIN w USING (term) JOIN f USING (term), s WHERE doc_id IS NOT NULL GROUP BY item_id, text, row_no, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLE["op11_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
      FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
         WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
twoway AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM twoway UNION SELECT r.a, l.b FROM reach r JOIN twoway l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS other FROM reach GROUP BY a)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, least(s.doc_id, coalesce(other, s.doc_id)) AS component_id
FROM s LEFT JOIN low ON s.doc_id = low.doc_id
"""
