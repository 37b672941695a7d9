"""The registered queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, graph_ann, mixing, packing, quality, sharding, simhash, unigram, url_filter, wavelet
from .common import table

RULES = [url_filter.Rule.host_path(a, t) for a, t in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op3_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_ann.search(vectors.where(F.col("vec_id") % 50 == 0), graph_ann.index(vectors), k=5)


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars"), details=True)  # other columns may have the names of the details
    return mixed.select("doc_id", "source", "n_chars", F.octet_length("text").alias("n_bytes"), F.col("_copy").alias("copy"), F.col("_copies").alias("copies"), F.round("_rate", 9).alias("rate"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.documents(wavelet.write(table(spark, sf_dir, "documents")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(table(spark, sf_dir, "embeddings"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.link(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.concat(*[F.substring(F.lower(F.hex("fp")), k, 2) for k in range(15, 0, -2)]).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_url_filter, op3_graph_ann, op4_poisson_mixing, op5_token_counts, op6_sharding, op7_best_fit_packing, op8_wavelet_tokens, op9_embedding_dedup, op10_simhash_dedup)}

SQL = {
    "op2_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
rules(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best AS (
  SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM best""",
    "op4_poisson_mixing": r"""
WITH sized AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (SELECT source, n, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM sized),
terms AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rated, range(0, 400) AS r(k)),
tables AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM terms),
drawn AS (
  SELECT doc_id, source, n_chars, strlen(text)::INT AS n_bytes,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':null'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT doc_id, d.source, n_chars, n_bytes, rate, count(*) FILTER (WHERE cdf <= u) AS copies
  FROM drawn AS d JOIN tables AS t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL)
SELECT doc_id, source, n_chars, n_bytes, unnest(range(0, copies))::INT AS copy, copies::INT AS copies, round(rate, 9) AS rate FROM counted""",
    "op9_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach AS r JOIN links AS l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.y, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(l.y, e.vec_id)) AS kept
FROM embeddings AS e LEFT JOIN least AS l ON l.x = e.vec_id LEFT JOIN counts AS c ON c.x = e.vec_id""",
}
