"""The queries that apply the training-data operators to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, jaccard, language, mixing, revisits, rules, secrets, url_filter, vector_search
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed values of the derived captures: page p is fetched at second START + 60 p and asked for again a day later.
START, DAY, CHANGED = 1_700_000_000, 86_400, 1_690_000_000


def captures(pages: DataFrame) -> DataFrame:
    """A full response and a revisit for each page.

    The table has no capture records, so they are derived: every 7th page has no entity tag, every 13th no time of last
    change, every 5th revisit has another tag, and every 11th revisit is earlier than its response.
    """
    second, page = F.lit(START) + F.col("page_id") * 60, F.col("page_id")
    again = second + F.when(page % 11 == 0, -30).otherwise(DAY)
    tag = F.when(page % 7 != 0, F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"')))
    changed = F.when(page % 13 != 0, CHANGED + page * 60)
    text = F.coalesce(F.length("html"), F.lit(0)).cast("string")
    full = pages.select(
        (page * 2).alias("record_id"), "url", F.timestamp_seconds(second).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), changed.alias("last_modified"), F.concat(F.lit("sha1:"), F.sha1("html")).alias("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text, F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), second.cast("string")).alias("headers"),
    )
    asked = pages.select(
        (page * 2 + 1).alias("record_id"), "url", F.timestamp_seconds(again).alias("ts"), F.lit("revisit").alias("kind"), F.when(page % 5 == 0, F.when(tag.isNotNull(), F.concat(F.lit('"changed-'), page, F.lit('"')))).otherwise(tag).alias("etag"), changed.alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"), F.lit("DATE"), again.cast("string"), F.lit("Age"), F.lit("0")).alias("headers"),
    )
    return full.unionByName(asked)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.withColumn("headers", lines)


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, html, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_.*|ref|gclid|fbclid|sessionid)(=.*)?$'))) AS query
  FROM pages),
keyed AS (
  SELECT page_id, html, 1700000000 + page_id * 60 AS us,
    CASE WHEN url IS NOT NULL THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS url_key,
    CASE WHEN page_id % 7 <> 0 THEN '"' || substr(md5(html), 1, 16) || '"' END AS etag,
    CASE WHEN page_id % 13 <> 0 THEN 1690000000 + page_id * 60 END AS changed
  FROM parts),
asked AS (
  SELECT page_id, url_key, us + CASE WHEN page_id % 11 = 0 THEN -30 ELSE 86400 END AS us, changed,
    CASE WHEN page_id % 5 = 0 AND etag IS NOT NULL THEN '"changed-' || page_id || '"' ELSE etag END AS etag
  FROM keyed),
hits AS (
  SELECT a.*, f.page_id AS full_id, f.html, f.etag AS full_etag, f.changed AS full_changed,
    row_number() OVER (PARTITION BY a.page_id ORDER BY f.us DESC NULLS LAST, f.page_id DESC) AS place
  FROM asked a LEFT JOIN keyed f ON a.url_key = f.url_key AND f.us < a.us),
judged AS (
  SELECT *, CASE WHEN full_id IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL AND full_etag IS NOT NULL THEN CASE WHEN etag = full_etag THEN 'resolved' ELSE 'mismatch' END
    WHEN changed IS NOT NULL AND full_changed IS NOT NULL THEN CASE WHEN changed = full_changed THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unverified' END AS outcome
  FROM hits WHERE place = 1)
SELECT page_id * 2 + 1 AS record_id, url_key, full_id * 2 AS refers_to, outcome,
  CASE WHEN outcome = 'resolved' THEN 'sha1:' || sha1(html) END AS digest,
  CASE WHEN outcome = 'resolved' THEN 'age: 0' || chr(10) || 'cache-control: max-age=600' || chr(10) || 'content-length: ' || coalesce(length(html), 0) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || us END AS headers
FROM judged
"""

URL_RULES = """
SELECT * FROM VALUES
  ('net', '/', 'net/', 'block'),
  ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'),
  ('org', '/fr/', 'org/fr/', 'allow')
AS rules(host, path, rule, verdict)
"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), spark.sql(URL_RULES))


OP2_SQL = r"""
WITH rules(r_host, r_path, r_rule, r_verdict) AS (
  VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
         ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
urls AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY length(r_rule) DESC NULLS LAST) AS place
  FROM urls LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, r_rule AS rule, coalesce(r_verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = labels.select(F.col("doc_id").alias("id"), classifier.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return classifier.grade_documents(docs, classifier.fit_classifier(docs, rated))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs.where(~language.held_out("doc_id")))
    found = language.predict_languages(docs, model)
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vector_search.whole_components(F.col("embedding")).alias("v"))
    return vector_search.search(rows, F.col("id") % 50 == 0)


OP9_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS place
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 5
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), jaccard.JaccardParams(shingle=3, over=90))


OP10_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN least ON a = doc_id
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_warc_revisits, op2_url_filter, op3_quality_classifier, op4_secret_scan, op5_language_id, op6_byte_bpe, op7_source_mix, op8_quality_rules, op9_exact_top_k, op10_jaccard_join)
}
#: The others have no SQL: trained models, counts by code point of spans, a vocabulary file, hashed draws or exact binomials.
ORACLE_SQL: dict[str, str] = {"op1_warc_revisits": OP1_SQL, "op2_url_filter": OP2_SQL, "op9_exact_top_k": OP9_SQL, "op10_jaccard_join": OP10_SQL}
