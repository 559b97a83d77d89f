from pyspark.sql import functions as F

from scriptorium.operators import chunks as C
from scriptorium.session import read_table

from conftest import SF_SMALL


def test_fixed_counts(spark):
    df = spark.createDataFrame([(n, "a" * n) for n in (0, 1000, 1001, 1800, 1801)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in C.fixed_chunks(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1000: 1, 1001: 2, 1800: 2, 1801: 3}
    starts = C.fixed_chunks(spark.createDataFrame([(1, "".join(chr(65 + i % 26) for i in range(2500)))], "doc_id long, text string"))
    txt = "".join(chr(65 + i % 26) for i in range(2500))
    for r in starts.collect():
        assert r.chunk == txt[r.chunk_no * 800: r.chunk_no * 800 + 1000]


def test_recursive_invariants(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    chunks = C.recursive_chunks(docs)
    assert chunks.filter(F.length("chunk") > 1000).count() == 0
    by_doc = {}
    for r in chunks.collect():
        by_doc.setdefault(r.doc_id, []).append((r.chunk_no, r.chunk))
    for d in docs.collect():
        pieces = [c for _, c in sorted(by_doc.get(d.doc_id, []))]
        # every non-blank token is covered, in order
        pos = 0
        joined = " ".join(pieces)
        for tok in d.text.split():
            i = joined.find(tok, max(0, pos - 1200))
            assert i >= 0
            pos = i
        assert all(p == p.strip() and p for p in pieces)


def test_recursive_small():
    assert C.split_recursive("") == []
    assert C.split_recursive("abc") == ["abc"]
    out = C.split_recursive("word " * 400, 100, 20)
    assert all(len(c) <= 100 for c in out)


def test_recursive_chunks_go_on_in_parts(spark, monkeypatch):
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(400 * i))) for i in range(8)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(C, "HELD_CHARS", 1500)
    got = sorted((r.doc_id, r.chunk_no, r.chunk) for r in C.recursive_chunks(df).collect())
    assert got == [(i, n, c) for i, t in texts for n, c in enumerate(C.split_recursive(t))]
