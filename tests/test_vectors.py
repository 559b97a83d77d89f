import pytest
from pyspark.sql import functions as F

from scriptorium.operators import vectors as V
from scriptorium.session import read_table

from conftest import SF_SMALL


def test_knn_golden(spark):
    corpus = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "qid long, embedding array<double>")
    for method in ("native", "blocks"):
        got = [(r.vec_id, r.distance, round(r.score, 6))
               for r in V.knn(q, corpus, "qid", ["vec_id"], top_k=3, method=method).orderBy("rank").collect()]
        assert got == [(0, 0.0, 1.0), (2, 1.0, 0.5), (1, 25.0, 0.038462)]


def test_k_bounds():
    for bad in (0, 21, 2.5, True):
        with pytest.raises(ValueError):
            V.check_top_k(bad)
    assert V.check_top_k(20) == 20


def test_blocks_equal_native(spark):
    emb = read_table(spark, SF_SMALL, "embeddings")
    q = emb.filter(F.col("vec_id") % 5 == 0).withColumnRenamed("vec_id", "qid").select("qid", "embedding")
    a = V.knn(q, emb, "qid", ["vec_id"], top_k=4, method="native").select("qid", "rank", "vec_id", F.round("distance", 9).alias("d"))
    b = V.knn(q, emb, "qid", ["vec_id"], top_k=4, method="blocks").select("qid", "rank", "vec_id", F.round("distance", 9).alias("d"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hash_embed_unit_norm(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "")], "k long, text string")
    rows = {r.k: r.embedding for r in V.hash_embed(df, "text", ["k"]).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1.0) < 1e-12
    assert all(x == 0.0 for x in rows[2]) and len(rows[2]) == V.EMBED_DIM


def test_knn_contract(spark):
    """Both methods: odd vectors take no part, large norms and ties are exact."""
    import random

    rng = random.Random(1)
    rows = [(i, [8e6 + rng.gauss(0, 1e-3) for _ in range(6)]) for i in range(300)] + [(1000 + i, rows_) for i, rows_ in enumerate([[8e6] * 6] * 40)]
    rows += [(5000, None), (5001, [1.0]), (5002, [float("nan")] * 6), (5003, [None] * 6), (5004, [])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, [8e6 + rng.gauss(0, 1e-3) for _ in range(6)]) for i in range(40)] + [(90, [8e6] * 6), (91, None), (92, [2.0]), (93, [float("inf")] * 6)],
                              "qid long, embedding array<double>")
    vectors = {i: v for i, v in rows if v and len(v) == 6 and all(x is not None and x == x for x in v)}

    def brute(v):
        return [i for _, i in sorted((sum((a - b) * (a - b) for a, b in zip(v, w)), i) for i, w in vectors.items())][:5]
    want = {r["qid"]: brute(r["embedding"]) for r in q.collect() if r["qid"] < 91} | {92: [5001]}
    for method in ("native", "blocks", "auto"):
        got = {}
        for r in V.knn(q, corpus, "qid", ["vec_id"], top_k=5, method=method).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["vec_id"])
        assert got == want


def test_embed_keeps_equal_keys_and_has_no_exchange(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "k long, text string")
    out = V.hash_embed(df, "text", ["k"])
    assert out.count() == 3 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_answers_need_a_near_chunk(spark):
    chunks = spark.createDataFrame([(1, 0, "the red fox sleeps"), (2, 0, "taxes are due in april")], "doc_id long, chunk_no int, chunk string")
    asked = spark.createDataFrame([(1, "where the red fox sleeps"), (2, "quantum chromodynamics lattice"), (3, "?!"), (4, None)], "item_id long, text string")
    corpus = V.hash_embed(chunks, "chunk", ["doc_id", "chunk_no"])
    got = V.best_answers(V.hash_embed(asked, "text", ["item_id"]), corpus, "item_id", ["doc_id", "chunk_no"]).collect()
    assert [(r.item_id, r.doc_id) for r in got] == [(1, 1)]


def test_knn_blocks_of_any_size(spark, monkeypatch):
    """Many small blocks, a query set larger than a block, one vector in a third of
    the rows, search within a store; nothing is gathered by the driver."""
    import random

    from pyspark.sql import DataFrame

    rng = random.Random(3)
    rows = [(i, f"s{i % 3}" if i % 11 else None, [1.0, 2.0] if i % 3 == 0 else [float(rng.randrange(6)), float(rng.randrange(6))]) for i in range(400)]
    corpus = spark.createDataFrame(rows, "vec_id long, store string, embedding array<double>")
    asked = [(i, rng.choice(["s0", "s1", "none", None]), [float(rng.randrange(6)), float(rng.randrange(6))]) for i in range(90)]
    q = spark.createDataFrame(asked, "qid long, store string, embedding array<double>")

    def brute(v, store=None):
        return [i for _, i in sorted(((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2, i) for i, s, w in rows if store is None or s == store)][:5]
    monkeypatch.setattr(V, "BLOCK_ROWS", 32)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(V, "SCREEN", 100)
    with monkeypatch.context() as m:
        for name in ("collect", "toArrow", "toPandas"):
            m.setattr(DataFrame, name, None)
        every = V.knn(q, corpus, "qid", ["vec_id"])
        inside = V.knn(q, corpus, "qid", ["vec_id"], within=["store"])
    for found, want in ((every, {i: brute(v) for i, _, v in asked}), (inside, {i: brute(v, s) for i, s, v in asked if s in ("s0", "s1")})):
        got = {}
        for r in found.orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["vec_id"])
        assert got == want


def test_words_are_hashed_once_a_batch_and_vectors_made_once(spark):
    import hashlib

    texts = ["b a b c", "", None, "a", "x y z x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    vectors = V.hash_embed(df, "text", ["id"], dim=8)
    for r in vectors.collect():
        want = [0.0] * 8
        for w in (texts[r["id"]] or "").split():
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:8], 16) % 8] += 1.0 if int(h[8], 16) % 2 == 0 else -1.0
        norm = sum(x * x for x in want) ** 0.5
        assert r["embedding"] == [x / norm if norm else 0.0 for x in want]
    used = vectors.where(V.comparable("embedding"))._jdf.queryExecution().optimizedPlan().toString()
    assert used.count("ArrowEvalPython") == 1
