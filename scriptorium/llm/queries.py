"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import (
    bestfit_packing, compression_quality, embedding_whitening, host_reputation, license_scan, minhash_tensored, nra_search, pca_neardup, pii_pseudonyms,
    pivotal_mixing, sentencepiece_bpe, substring_dedup, token_counts,
)
from scriptorium.llm.common import table
from scriptorium.llm.registry import register

MAX_TOKENS = 2048


@register("op4_compression_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compression_quality.with_quality(docs).select("doc_id", "quality.*")


@register("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs).withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


@register("op9_bestfit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bestfit_packing.best_fit_pack(docs).select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"),
        F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), x AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], chr(31))) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 34, 0) + 1)) AS i FROM w)
), gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(range(i, i + 35)) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM x) WHERE c > 1)
), per AS (
  SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(per.c, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN per ON w.doc_id = per.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


@register("op2_substring_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = substring_dedup.repeat_classes(docs).select(
        *substring_dedup.CLASS, "cut.n_words", "cut.n_removed", F.sha2(F.col("cut.kept"), 256).alias("kept_sha256"))
    return substring_dedup.attach(docs, digests).drop("text")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], chr(31)) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM common JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * k >= 80 * (nu.c + nv.c - k)
), reach AS (
  SELECT doc_id AS root, doc_id AS node FROM documents
  UNION
  SELECT root, v FROM reach JOIN links ON node = u
), comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON d.doc_id = node LEFT JOIN n ON n.doc_id = d.doc_id
"""


@register("op10_minhash_tensored", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_tensored.near_duplicates(docs)


@register("op6_pivotal_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pivotal_mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS root, vec_id AS node FROM embeddings
  UNION
  SELECT root, w FROM reach JOIN links ON node = u
), comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node
), n AS (SELECT u, count(*) AS c FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON vec_id = node LEFT JOIN n ON vec_id = u
"""


@register("op8_pca_neardup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca_neardup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: key of the registered query; a real run passes its own
PSEUDONYM_KEY = "change-me-per-corpus"
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


@register("op1_pii_pseudonyms")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_pseudonyms.pseudonymise(docs, PSEUDONYM_KEY, count="n_values")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page shows the document that its path numbers; bad is a
    document labelled poor or toxic."""
    number = F.regexp_extract(host_reputation.url_parts(F.col("url"))[1], "/([0-9]{1,18})", 1)
    marked = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return pages.select("url", F.when(number != "", number).cast("bigint").alias("doc_id")).join(marked, "doc_id").select("url", "bad")


@register("op3_host_reputation")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = page_outcomes(pages, table(spark, sf_dir, "labels"))
    return host_reputation.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "rate", "lower")


@register("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_hits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op13_sentencepiece_rounds")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.round_trip(docs).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op11_multiplicity_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), i AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM benchmark
), size AS (
  SELECT doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size
), tf AS (
  SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY doc_id, t
), w AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY t
), impact AS (
  SELECT tf.doc_id, tf.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))) AS v
  FROM tf JOIN w ON tf.t = w.t JOIN size ON size.doc_id = tf.doc_id, whole
), scored AS (
  SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM i JOIN impact ON i.t = impact.t GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@register("op12_nra_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
