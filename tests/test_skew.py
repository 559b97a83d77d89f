"""Hot keys: one group holding most rows must give the same answers."""

from pyspark.sql import functions as F

from scriptorium.operators import keywords as K
from scriptorium.operators import lines as L
from scriptorium.operators import vectors as V
from scriptorium.session import read_table

from conftest import SF_SMALL


def test_rake_hot_batch_equals_per_batch(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    hot = docs.withColumn("batch", F.when(F.col("doc_id") % 10 < 8, F.lit("hot")).otherwise(F.col("source")))
    a = {r.batch: r.keywords for r in K.extract_keywords(hot, ["batch"], "text").collect()}
    b = {r.batch: r.keywords for r in K.extract_keywords(hot.repartition(7), ["batch"], "text", colocate=True).collect()}
    assert a == b and "hot" in a


def test_content_reuse_with_many_copies(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    copies = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("same\nsame\nline")).otherwise(F.col("text")))

    def work(u):
        return u.select("content_md5", F.length("text").alias("n"))

    out = L.content_reuse(copies, "doc_id", "text", work)
    assert out.count() == docs.count()
    assert out.select("content_md5").distinct().count() == copies.select(F.md5("text")).distinct().count()


def test_knn_query_blocks(spark, monkeypatch):
    emb = read_table(spark, SF_SMALL, "embeddings")
    q = emb.select(F.col("vec_id").alias("qid"), "embedding")
    one = V.knn(q, emb, "qid", ["vec_id"], top_k=3, method="native")
    monkeypatch.setattr(V, "BLOCK_QUERIES", 7)
    blocked = V.knn(q, emb, "qid", ["vec_id"], top_k=3)
    cols = ["qid", "rank", "vec_id"]
    assert one.select(*cols).exceptAll(blocked.select(*cols)).count() == 0
    assert blocked.count() == one.count()
