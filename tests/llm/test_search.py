"""NRA search against a plain scan of every document."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import nra_search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=10):
    counts = [(d, Counter(split(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        ts, scores = set(split(text)), []
        for k, (d, c) in enumerate(counts):
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, k))
        out += [(item, r, None if none else d, -s) for r, (s, none, d, _) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["The", "the", "été", "中文", "É", "x9", "a"]
    docs = [(i, " ".join(rng.choice(vocab[: rng.choice([5, 20, 67])]) for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    docs += [(n + i, "w1 w2 w3 same text") for i in range(40)] + [(7, "w1 w2 w3 same text")] * 15 + [(None, "w1 w59"), (None, None), (n + 50, ""), (n + 51, " .;-"), (n + 52, "w58 " * 20_000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 25)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "unheard"), (93, "W1-w1_w2"), (93, "w3"), (None, "same;TEXT")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_scan(spark, seed, monkeypatch):
    docs, items = corpus(seed, 500)
    monkeypatch.setattr(S, "FIRST_READ", 2 if seed == 1 else 64)
    monkeypatch.setattr(S, "SHARD_DOCS", 100 if seed == 1 else 16_384)
    monkeypatch.setattr(S, "BLOCK_ITEMS", 7 if seed == 1 else 2_000)
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, score int, rank int")
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id bigint, text string, n int")
    got = [tuple(r) for r in S.search(d, q).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a")], "item_id string, text string")
    assert S.search(d.where("false"), q).collect() == []
    assert S.search(d, q.where("false")).collect() == []
    assert [tuple(r)[:3] for r in S.search(d, q).collect()] == [("1", 1, 1)]
    assert S.search(d, q).dtypes == S.search(d, q.where("false")).dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_reads_stop_before_the_lists_end():
    """A document that stands first in every list decides a ranking of one; the tail is not read."""
    docs = np.concatenate([np.arange(1000)] * 3)
    value = np.concatenate([np.r_[10**6, np.full(999, 1)]] * 3).astype(np.int64)
    reads = []

    class Log(np.ndarray):
        def __getitem__(self, i):
            if isinstance(i, np.ndarray) and i.dtype.kind == "i":
                reads.append(len(i))
            return np.asarray(super().__getitem__(i))

    found, score = S.nra(np.array([0, 1000, 2000]), np.array([1000, 2000, 3000]), docs.view(Log), value, 1000, 1)
    assert found.tolist() == [0] and score.tolist() == [3 * 10**6] and sum(reads) == 3 * S.FIRST_READ
