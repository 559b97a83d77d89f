"""Queries for chunking, hashing vectors and exact top-k (V1-V6)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from scriptorium.operators import chunks as C
from scriptorium.operators import vectors as V
from scriptorium.functions.text import py_strip
from scriptorium.plans import sqlfrag as Q
from scriptorium.plans.registry import register
from scriptorium.session import checkpoint_dir, read_table

R6 = 6  # decimals kept for floating results in both engines


def _r(c: str):
    return F.round(F.col(c), R6).alias(c)


# ---- SQL fragments shared by the oracles (DuckDB dialect) ----------------

SQL_FIXED_CHUNKS = """
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substring(text, i * 800 + 1, 1000) AS chunk
FROM documents,
     LATERAL (SELECT unnest(generate_series(0, CASE WHEN length(text) = 0 THEN -1
                                                    WHEN length(text) <= 1000 THEN 0
                                                    ELSE CAST(ceil((length(text) - 200) / 800.0) AS BIGINT) - 1 END)) AS i)
"""


def sql_hash_embed(src: str, keys: str, text: str) -> str:
    """Hashing embedder in SQL: keys of ``src`` -> embedding DOUBLE[64]."""
    return f"""
      (WITH tok AS (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {src}),
            hb AS (SELECT {keys}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b,
                          CASE WHEN ('0x' || substr(md5(w), 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM tok),
            agg AS (SELECT {keys}, b, sum(s)::DOUBLE AS v FROM hb GROUP BY ALL),
            allk AS (SELECT DISTINCT {keys} FROM {src}),
            dense AS (SELECT {", ".join("k." + x.strip() for x in keys.split(","))}, g.i, coalesce(a.v, 0.0) AS v
                      FROM allk k CROSS JOIN range(0, 64) g(i)
                      LEFT JOIN agg a ON {" AND ".join(f"a.{x.strip()} = k.{x.strip()}" for x in keys.split(","))} AND a.b = g.i),
            nrm AS (SELECT {keys}, list(v ORDER BY i) AS vec, sqrt(sum(v * v)) AS n FROM dense GROUP BY ALL)
       SELECT {keys}, CASE WHEN n > 0 THEN list_transform(vec, lambda x: x / n) ELSE list_transform(vec, lambda x: x * 0.0) END AS embedding
       FROM nrm)"""


def sql_knn(queries: str, qkey: str, corpus: str, ckeys: str, k: int = 5) -> str:
    order = ", ".join(f"c.{x.strip()}" for x in ckeys.split(","))
    return f"""
      (WITH d AS (
         SELECT q.{qkey}, {order},
                list_reduce(list_transform(generate_series(1, len(q.embedding)),
                    lambda j: (q.embedding[j]::DOUBLE - c.embedding[j]::DOUBLE) * (q.embedding[j]::DOUBLE - c.embedding[j]::DOUBLE)),
                    lambda a, b: a + b) AS distance
         FROM {queries} q, {corpus} c),
       r AS (SELECT *, row_number() OVER (PARTITION BY {qkey} ORDER BY distance, {", ".join(x.strip() for x in ckeys.split(","))}) AS rank FROM d)
       SELECT * FROM r WHERE rank <= {k})"""


SQL_CENTROIDS = """
  (SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY i) AS embedding
   FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
         FROM embeddings, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i)
         GROUP BY label, i)
   GROUP BY label)"""


def _centroid_hits(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    q = V.centroids(emb.withColumn("query_id", F.col("label").cast("bigint")), "query_id", "embedding")
    return V.knn(q, emb, "query_id", ["vec_id"], top_k=5)


@register("vector_topk", f"""
SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(distance, 6) AS distance,
       round(1.0 / (1.0 + distance), 6) AS score
FROM {sql_knn(SQL_CENTROIDS, "query_id", "embeddings", "vec_id")}
""")
def vector_topk(spark, sf):
    """Top-5 vectors nearest to each label centroid of ``embeddings``."""
    return _centroid_hits(spark, sf).select("query_id", "rank", "vec_id", _r("distance"), _r("score"))


@register("vector_topk_packed", f"""
SELECT query_id, list(vec_id ORDER BY rank) AS chunks, list(round(1.0 / (1.0 + distance), 6) ORDER BY rank) AS scores
FROM {sql_knn(SQL_CENTROIDS, "query_id", "embeddings", "vec_id")}
GROUP BY query_id
""")
def vector_topk_packed(spark, sf):
    hits = _centroid_hits(spark, sf).withColumn("score", F.round("score", R6))
    return V.pack_results(hits, "query_id", item="vec_id")


@register("chunk_fixed", SQL_FIXED_CHUNKS)
def chunk_fixed(spark, sf):
    return C.fixed_chunks(read_table(spark, sf, "documents"))


@register("chunk_recursive")
def chunk_recursive(spark, sf):
    return C.recursive_chunks(read_table(spark, sf, "documents"))


@register("chunk_recursive_check", f"""
SELECT doc_id, CASE WHEN length(text) <= 1000 THEN CAST(t <> '' AS BIGINT) END AS n_if_short,
       CASE WHEN length(text) <= 1000 AND t <> '' THEN md5(t) END AS md5_if_short,
       true AS begins, true AS ends, true AS bounded, true AS inside
FROM (SELECT doc_id, text, {Q.strip('text')} AS t FROM documents)""")
def chunk_recursive_check(spark, sf):
    """V1, what SQL can state: a short text is one stripped chunk; the first chunk
    begins as the text does, the last ends as it does; all are in it and at most
    1000 long."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    got = C.recursive_chunks(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))["chunk"].alias("c"))
    both = docs.join(got, "doc_id", "left").withColumns({"c": F.coalesce("c", F.array().cast("array<string>")), "t": py_strip("text")})
    short, some = F.length("text") <= 1000, F.size("c") > 0
    return both.select(
        "doc_id", F.when(short, F.size("c").cast("bigint")).alias("n_if_short"), F.when(short & some, F.md5(F.get("c", F.lit(0)).cast("binary"))).alias("md5_if_short"),
        F.when(some, F.startswith("t", F.get("c", F.lit(0)))).otherwise(F.col("t") == "").alias("begins"),
        F.when(some, F.endswith("t", F.element_at("c", -1))).otherwise(F.col("t") == "").alias("ends"),
        F.forall("c", lambda x: F.length(x) <= 1000).alias("bounded"), F.forall("c", lambda x: F.contains(F.col("text"), x)).alias("inside"))


def doc_chunk_vectors(spark, sf):
    chunks = C.fixed_chunks(read_table(spark, sf, "documents"))
    return V.hash_embed(chunks, "chunk", ["doc_id", "chunk_no"])


@register("hash_embed", f"""
SELECT doc_id, chunk_no, list_transform(embedding, lambda x: round(x, 6)) AS embedding
FROM {sql_hash_embed("(" + SQL_FIXED_CHUNKS + ")", "doc_id, chunk_no", "chunk")}
""")
def hash_embed(spark, sf):
    return doc_chunk_vectors(spark, sf).select(
        "doc_id", "chunk_no", F.transform("embedding", lambda x: F.round(x, R6)).alias("embedding"))


@register("retrieve_topk", f"""
SELECT item_id, CAST(rank AS BIGINT) AS rank, doc_id, chunk_no, round(distance, 6) AS distance,
       round(1.0 / (1.0 + distance), 6) AS score
FROM {sql_knn(sql_hash_embed("benchmark", "item_id", "text"), "item_id",
              sql_hash_embed("(" + SQL_FIXED_CHUNKS + ")", "doc_id, chunk_no", "chunk"), "doc_id, chunk_no")}
""")
def retrieve_topk(spark, sf):
    """Benchmark texts as questions against all document chunks."""
    return retrieve(spark, sf).select("item_id", "rank", "doc_id", "chunk_no", _r("distance"), _r("score"))


def retrieve(spark, sf, method: str = "auto"):
    corpus = doc_chunk_vectors(spark, sf)
    queries = V.hash_embed(read_table(spark, sf, "benchmark"), "text", ["item_id"])
    return V.knn(queries, corpus, "item_id", ["doc_id", "chunk_no"], top_k=5, method=method)


# ------------------------------------------------------------------ stores

from scriptorium.operators import fields as X  # noqa: E402
from scriptorium.sources import stores as ST  # noqa: E402


def _store_chunk_keys(spark, sf):
    """Chunk rows per store without embeddings (for listing and counts)."""
    docs = read_table(spark, sf, "documents").withColumnRenamed("source", "store_id")
    return C.fixed_chunks(docs, keys=("store_id", "doc_id"))


SQL_STORE_COUNTS = f"""
SELECT d.store_id, CAST(d.n AS BIGINT) AS num_docs, CAST(d.chars AS BIGINT) AS total_chars,
       CAST(coalesce(c.n, 0) AS BIGINT) AS num_chunks
FROM (SELECT source AS store_id, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY source) d
LEFT JOIN (SELECT d.source AS store_id, count(*) AS n FROM ({SQL_FIXED_CHUNKS}) x JOIN documents d USING (doc_id)
           GROUP BY d.source) c USING (store_id)"""


@register("store_stats", f"SELECT *, '{V.EMBEDDING_MODEL}' AS embedding_model FROM ({SQL_STORE_COUNTS})")
def store_stats(spark, sf):
    """V3 + V7: one store per source; chunk and character counts."""
    docs = read_table(spark, sf, "documents").withColumnRenamed("source", "store_id")
    st = ST.store_stats(C.fixed_chunks(docs, keys=("store_id", "doc_id")), docs)
    return st.select("store_id", "num_docs", "total_chars", "num_chunks", "embedding_model")


@register("store_list", "SELECT DISTINCT source AS store_id FROM documents")
def store_list(spark, sf):
    """V8: store ids, from the store column alone (a store of empty texts counts)."""
    return ST.list_stores(read_table(spark, sf, "documents").select(F.col("source").alias("store_id")))


@register("store_delete", f"SELECT store_id, num_chunks FROM ({SQL_STORE_COUNTS}) WHERE store_id <> 'src0'")
def store_delete(spark, sf):
    """V9: stores left after deleting store 'src0', with their chunk counts."""
    left = ST.drop_store(_store_chunk_keys(spark, sf), "src0")
    return left.groupBy("store_id").agg(F.count("*").cast("bigint").alias("num_chunks"))


@register("store_index", f"""
SELECT store_id, num_docs, total_chars, num_chunks, 'md5-hashing-64' AS embedding_model, 'second' AS title
FROM ({SQL_STORE_COUNTS}) WHERE store_id <> 'src0'""")
def store_index(spark, sf):
    """An index written in two appends (English documents, then all
    others), one store deleted, and its table of stores read back."""
    docs = read_table(spark, sf, "documents").select(F.col("source").alias("store_id"), "doc_id", "text", "lang")
    path = os.path.join(checkpoint_dir(spark), f"store-index-{uuid.uuid4().hex}")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for version, (part, title) in enumerate([(english, "first"), (~english, "second")]):
        ST.write_index(docs.where(part).drop("lang"), path, append=True, metadata={"title": title}, version=version, splitter="fixed")
    ST.delete_index(spark, path, "src0")
    return ST.read_stores(spark, path).select("store_id", "num_docs", "total_chars", "num_chunks", "embedding_model", F.col("metadata")["title"].alias("title"))


#: ids that look like numbers: one source is three stores
SQL_NUMBER_IDS = """
SELECT CASE doc_id % 3 WHEN 0 THEN n WHEN 1 THEN '00' || n ELSE n || 'e1' END AS store_id, doc_id, text
FROM (SELECT *, substr(source, 4) AS n FROM documents)"""


def _write_number_index(spark, sf) -> str:
    n = F.substr("source", F.lit(4))
    docs = read_table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 3 == 0, n).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("00"), n)).otherwise(F.concat(n, F.lit("e1"))).alias("store_id"), "doc_id", "text")
    path = os.path.join(checkpoint_dir(spark), f"store-index-{uuid.uuid4().hex}")
    ST.write_index(docs, path, metadata={"title": "whole"}, splitter="fixed", version="all")
    ST.write_index(docs, path, metadata={"title": "again"}, splitter="fixed", version="all")  # committed already: nothing is written
    return path


@register("index_number_ids", f"""
SELECT d.store_id, CAST(count(*) AS BIGINT) AS num_docs, CAST(sum(length(d.text)) AS BIGINT) AS total_chars,
       CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS num_chunks, 'whole' AS title
FROM ({SQL_NUMBER_IDS}) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({SQL_FIXED_CHUNKS}) GROUP BY doc_id) c USING (doc_id)
GROUP BY d.store_id""")
def index_number_ids(spark, sf):
    """An index whose store ids look like numbers ('7', '007', '7e1'), its
    write repeated under the same version."""
    path = _write_number_index(spark, sf)
    return ST.read_stores(spark, path).select("store_id", "num_docs", "total_chars", "num_chunks", F.col("metadata")["title"].alias("title"))


@register("index_query", f"""
WITH dd AS ({SQL_NUMBER_IDS}),
q AS (SELECT item_id, CASE WHEN item_id % 4 = 3 THEN 'none' ELSE (item_id % 5) || CASE item_id % 3 WHEN 2 THEN 'e1' ELSE '' END END AS store_id, text FROM benchmark),
qv AS {sql_hash_embed("q", "item_id", "text")},
ch AS (SELECT x.doc_id, x.chunk_no, x.chunk, dd.store_id FROM ({SQL_FIXED_CHUNKS}) x JOIN dd USING (doc_id)),
cv AS (SELECT e.*, ch.store_id, ch.chunk FROM {sql_hash_embed("ch", "doc_id, chunk_no", "chunk")} e JOIN ch USING (doc_id, chunk_no)),
d AS (SELECT q.item_id, c.chunk, c.doc_id, c.chunk_no,
             list_reduce(list_transform(generate_series(1, len(v.embedding)),
               lambda j: (v.embedding[j] - c.embedding[j]) * (v.embedding[j] - c.embedding[j])), lambda a, b: a + b) AS distance
      FROM q JOIN qv v USING (item_id) JOIN cv c ON c.store_id = q.store_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id, chunk_no) AS rank FROM d),
p AS (SELECT item_id, list(md5(chunk) ORDER BY rank) AS chunks, list(round(1.0 / (1.0 + distance), 6) ORDER BY rank) AS scores FROM r WHERE rank <= 5 GROUP BY item_id)
SELECT q.item_id, q.store_id, CASE WHEN s.store_id IS NULL THEN 'not found' ELSE 'ok' END AS status,
       CASE WHEN s.store_id IS NOT NULL THEN coalesce(p.chunks, []) END AS chunks, CASE WHEN s.store_id IS NOT NULL THEN coalesce(p.scores, []) END AS scores,
       CASE WHEN s.store_id IS NOT NULL THEN 'whole' END AS title
FROM q LEFT JOIN p USING (item_id) LEFT JOIN (SELECT DISTINCT store_id FROM dd) s ON s.store_id = q.store_id""")
def index_query(spark, sf):
    """Benchmark questions against single stores of a stored index."""
    path = _write_number_index(spark, sf)
    store = F.when(F.col("item_id") % 4 == 3, "none").otherwise(F.concat((F.col("item_id") % 5).cast("string"), F.when(F.col("item_id") % 3 == 2, "e1").otherwise("")))
    asked = V.hash_embed(read_table(spark, sf, "benchmark").withColumn("store_id", store), "text", ["item_id", "store_id"])
    return ST.query_index(spark, path, asked, "item_id").select(
        "item_id", "store_id", "status", F.transform("chunks", lambda c: F.md5(c.cast("binary"))).alias("chunks"),
        F.transform("scores", lambda x: F.round(x, R6)).alias("scores"), F.col("metadata")["title"].alias("title"))


SQL_STORE_QUERIES = """
(SELECT item_id, 'src' || CAST(item_id % 25 AS VARCHAR) AS store_id, text FROM benchmark)"""


@register("store_query", f"""
WITH q AS {SQL_STORE_QUERIES},
qv AS {sql_hash_embed("q", "item_id", "text")},
ch AS (SELECT x.doc_id, x.chunk_no, x.chunk, d.source AS store_id FROM ({SQL_FIXED_CHUNKS}) x JOIN documents d USING (doc_id)),
cv AS (SELECT e.*, ch.store_id FROM {sql_hash_embed("ch", "doc_id, chunk_no", "chunk")} e JOIN ch USING (doc_id, chunk_no)),
d AS (SELECT q.item_id, q.store_id, c.doc_id, c.chunk_no,
             list_reduce(list_transform(generate_series(1, len(v.embedding)),
               lambda j: (v.embedding[j] - c.embedding[j]) * (v.embedding[j] - c.embedding[j])), lambda a, b: a + b) AS distance
      FROM q JOIN qv v USING (item_id) JOIN cv c ON c.store_id = q.store_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id, chunk_no) AS rank FROM d)
SELECT item_id, store_id, 'ok' AS status, CAST(rank AS BIGINT) AS rank, doc_id, chunk_no,
       round(distance, 6) AS distance, round(1.0 / (1.0 + distance), 6) AS score FROM r WHERE rank <= 5
UNION ALL
SELECT item_id, store_id, 'not found', NULL, NULL, NULL, NULL, NULL FROM q
WHERE store_id NOT IN (SELECT DISTINCT source FROM documents)""")
def store_query(spark, sf):
    """V4 + V11: every benchmark question searches one store (src<id mod 25>);
    unknown stores answer 'not found'."""
    docs = read_table(spark, sf, "documents").withColumnRenamed("source", "store_id")
    chunks = ST.build_chunks(docs, with_text=False)
    b = read_table(spark, sf, "benchmark").withColumn(
        "store_id", F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")))
    q = V.hash_embed(b, "text", ["item_id", "store_id"])
    res = ST.query_stores(q, chunks, "item_id", stores=docs.select("store_id"))
    return res.select("item_id", "store_id", "status", "rank", "doc_id", "chunk_no", _r("distance"), _r("score"))


@register("question_answer", f"""
WITH h AS {sql_knn(sql_hash_embed("benchmark", "item_id", "text"), "item_id",
                   sql_hash_embed("(" + SQL_FIXED_CHUNKS + ")", "doc_id, chunk_no", "chunk"), "doc_id, chunk_no", 1)},
c AS ({SQL_FIXED_CHUNKS}),
a AS (SELECT h.item_id, c.chunk FROM h JOIN c ON c.doc_id = h.doc_id AND c.chunk_no = h.chunk_no WHERE 1.0 / (1.0 + h.distance) >= 0.5)
SELECT b.item_id, CASE WHEN regexp_matches(b.text, '[\\p{{L}}\\p{{N}}_]') THEN coalesce(a.chunk, 'Information not found in the documents.')
                       ELSE 'Information not found in the documents.' END AS answer
FROM benchmark b LEFT JOIN a USING (item_id)""")
def question_answer(spark, sf):
    """X4 (extractive): the best matching chunk answers each benchmark question if
    it is near enough; otherwise the not-found sentence does."""
    docs, asked = read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")
    qs = V.hash_embed(asked, "text", ["item_id"])
    best = V.best_answers(qs, doc_chunk_vectors(spark, sf), "item_id", ["doc_id", "chunk_no"])
    # the text of the few chunks found, cut from their documents again
    step = C.CHUNK_SIZE - C.CHUNK_OVERLAP
    ans = docs.join(best.select("item_id", "doc_id", "chunk_no"), "doc_id") \
        .select("item_id", F.substr("text", F.col("chunk_no") * step + 1, F.lit(C.CHUNK_SIZE)).alias("chunk"))
    return asked.select("item_id").join(ans, "item_id", "left").select(
        "item_id", F.coalesce("chunk", F.lit(X.NOT_IN_DOCUMENTS)).alias("answer"))
