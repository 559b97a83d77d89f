"""Merge rounds against the library: ids, digests and decoded texts."""
import hashlib
import random

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

from scriptorium.llm import queries, sentencepiece_bpe as S  # noqa: E402

SF = "/root/testdata/sf0.001"
PARTS = list("the ing  \n\t\r.,;(){}'\"ab ▁ é中文字ñ𝒳\x000123") + ["the", "▁▁", "    ", "<s>", "thethe", "inging", "<0x41>", "﻿", "é"]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=S.model_path())


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 120))) for _ in range(800)]
    return texts + [None, "", " ", "  ", "\n", "a" * 5000, " " * 3000, "ab" * 3000 + " " * 40 + "中" * 3000, "the" * 4000, "same", "same"]


@pytest.mark.parametrize("long", [4, 512])
def test_encode_and_decode_equal_the_library(sp, odd, long, monkeypatch):
    monkeypatch.setattr(S, "LONG", long)
    m = S.Model(S.model_path())
    texts = [t or "" for t in odd]
    want = sp.encode(texts, num_threads=1)
    got = list(m.encode(texts))
    assert [g.tolist() for g in got] == want
    at = np.concatenate(([0], np.cumsum([len(g) for g in got])))
    assert S.pieces().decode(np.concatenate(got), at) == sp.decode(want)


def test_decode_any_ids(sp):
    m, rng = S.pieces(), random.Random(2)
    runs = [[rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randrange(12))] for _ in range(500)]
    at = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    assert m.decode(np.array([i for r in runs for i in r], np.int32), at) == [sp.decode(r) for r in runs]


def test_small_memory_of_words(sp, odd, monkeypatch):
    monkeypatch.setattr(S, "CACHE_WORDS", 10)
    monkeypatch.setattr(S, "GROUP_CHARS", 500)
    texts = [t or "" for t in odd]
    assert [g.tolist() for g in S.Model(S.model_path()).encode(texts)] == sp.encode(texts, num_threads=1)


def test_columns_pass_and_nulls(spark, sp, odd):
    rows = spark.createDataFrame([(i if i % 7 else None, t, "kept", 3) for i, t in enumerate(odd)], "doc_id bigint, text string, ids_ string, _n int")
    out = S.decode(S.encode(rows), "ids", "decoded")
    assert out.columns == ["doc_id", "text", "ids_", "_n", "ids", "decoded"]
    for r in out.collect():
        ids = sp.encode(r["text"] or "")
        assert (r["ids"], r["decoded"], r["ids_"], r["_n"]) == (ids, sp.decode(ids), "kept", 3)
    both = S.round_trip(rows)
    assert both.columns == out.columns and both.exceptAll(out).count() == 0
    assert S.encode(rows.where("false")).count() == 0 and S.round_trip(rows.where("false")).count() == 0
    null = spark.createDataFrame([(None,), ([],), ([5, None, 99999],)], "ids array<int>")
    assert [r[0] for r in S.decode(null).select("text").collect()] == [None, "", sp.decode([5]) + " ⁇  ⁇ "]


def test_query_equals_library(spark, sp):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
