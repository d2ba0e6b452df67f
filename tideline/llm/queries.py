"""The registered queries of this package, as thin as their contracts allow, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.batches import held_out
from tideline.llm.language import identify_language, learn_profiles
from tideline.llm.lines import dedup_lines
from tideline.llm.media import media_digests
from tideline.llm.mixing import mix
from tideline.llm.near import near_duplicates
from tideline.llm.pieces import encode_documents
from tideline.llm.quality import robust_outliers
from tideline.llm.toxicity import learn_toxicity, score_toxicity
from tideline.llm.urls import filter_urls
from tideline.llm.warc import archive_pages

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The contract's rules: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, learn_profiles(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_media": op2_media,
    "op3_warc": op3_warc,
    "op4_lines": op4_lines,
    "op5_urls": op5_urls,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language": op7_language,
    "op8_mixing": op8_mixing,
    "op9_near": op9_near,
    "op10_quality": op10_quality,
}

#: A-Z lower-cased, nothing else, in DuckDB.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_HEX = "(instr('0123456789abcdef', substr(hex || '00', {}, 1)) - 1)"
_OP3 = f"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
           (({_HEX.format("5 * i // 4 + 1")} * 256 + {_HEX.format("5 * i // 4 + 2")} * 16 + {_HEX.format("5 * i // 4 + 3")}) >> (7 - 5 * i % 4)) & 31) AS BIGINT), 1)), '') AS payload_digest
  FROM d
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""

_OP4 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), k AS (
  SELECT doc_id, place, line, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
), twice AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), j AS (
  SELECT k.doc_id, k.place, k.line, coalesce(k.doc_id <> t.keeper, false) AS gone FROM k LEFT JOIN twice t ON k.key = t.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_OP5 = f"""
WITH rules(host, path, verdict) AS (VALUES {', '.join(map(repr, URL_RULES))}),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (
  SELECT page_id, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")}, '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM r
), f AS (
  SELECT u.page_id, u.host, u.path, s.host || s.path AS rule, s.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(s.host || s.path) DESC NULLS LAST) AS n
  FROM u LEFT JOIN rules s ON (u.host = s.host OR ends_with(u.host, '.' || s.host)) AND starts_with(u.path, s.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""

_OP9 = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [hash(w)]
         ELSE list_transform(range(1, len(w) - 2), lambda i: hash(w[i:i+3])) END) AS g
  FROM d
), n AS MATERIALIZED (
  SELECT d.doc_id, count(s.g) AS n_shingles FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
), e AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  WHERE 100 * least(p.n_shingles, q.n_shingles) >= 80 * greatest(p.n_shingles, q.n_shingles)
  GROUP BY x.doc_id, y.doc_id, p.n_shingles, q.n_shingles
  HAVING 100 * count(*) >= 80 * (p.n_shingles + q.n_shingles - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE e.b > r.c
), m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN m USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op3_warc": _OP3, "op9_near": _OP9, "op4_lines": _OP4, "op5_urls": _OP5}
