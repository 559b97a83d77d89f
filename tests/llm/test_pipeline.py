"""The pipeline against a plain version of every stage."""
import collections
import random
import re
import zlib

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from scriptorium.llm import compression_quality as C  # noqa: E402
from scriptorium.llm import pii_pseudonyms, queries  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text, k=5):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(3000)]

    def prose(n):
        return " ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(n // 12 + 1))
    out = [(i, prose(rng.randint(60, 400)), "en", rng.choice(["hot", "hot", "a", None])) for i in range(60)]
    near = out[3][1].split()
    near[50] = "changed"
    out += [(70, " ".join(near), "en", "b"), (71, out[5][1], "en", "b"), (71, out[5][1], "en", "b"), (None, out[6][1], "en", "b"), (None, prose(90), None, None),
            (72, None, "en", "a"), (73, "", "en", "a"), (74, "too short", "en", "a"), (75, "the same words again " * 60, "en", "a"),
            (76, prose(100) + " mail jo.81@mail7.example.com card 4539 1488 0343 6467 " + prose(20), "en", "a"), (77, prose(9000), "en", "hot")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in out]


def test_stages_equal_plain_versions(spark, rows):
    stages = dict(pipeline.STAGES)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = stages["quality"](spark, docs, "")
    judged = C.with_quality(docs).collect()
    want = [tuple(r[:5]) for r in judged if r["quality"]["band"] == "ok" and len((r["text"] or "").split()) >= 50 and not r["quality"]["base_failed"]]
    now = [tuple(r) for r in kept.collect()]
    assert sorted(map(str, now)) == sorted(map(str, want)) and {75, 72, 73, 74}.isdisjoint(r[0] for r in now) and {0, 3, 70, 71, 76, 77} <= {r[0] for r in now}

    one = [tuple(r) for r in stages["near_duplicates"](spark, spark.createDataFrame(now, SCHEMA), "").collect()]
    up = list(range(len(now)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    sets = [shingles(r[1]) for r in now]
    for a in range(len(now)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    groups = collections.defaultdict(list)
    for k, r in enumerate(now):
        groups[find(k)].append(r)
    assert sorted(map(str, one)) == sorted(str(min(g, key=lambda r: (r[0] is None, r[0] or 0, r[1]))) for g in groups.values())

    new = [tuple(r) for r in stages["pseudonyms"](spark, spark.createDataFrame(one, SCHEMA), "").collect()]
    assert [(r[0], r[2], r[3]) for r in new] == [(r[0], r[2], r[3]) for r in one] and all(r[4] == len(r[1]) for r in new)
    changed = [(a[1], b[1]) for a, b in zip(one, new) if a[1] != b[1]]
    assert len(changed) == 1 and "jo.81" not in changed[0][1] and "4539 1488 0343 6467" not in changed[0][1]
    assert re.sub(pii_pseudonyms.PATTERN, "#", changed[0][0]) == re.sub(pii_pseudonyms.PATTERN, "#", changed[0][1])

    mixed = [tuple(r) for r in stages["mixing"](spark, spark.createDataFrame(new, SCHEMA), "").collect()]
    times = collections.Counter(mixed)
    assert set(times) <= set(new) and max(times.values()) <= 2
    sizes = collections.Counter()
    for r in new:
        sizes[r[3]] += len(r[1].split())
    taken = collections.Counter()
    for r in mixed:
        taken[r[3]] += len(r[1].split())
    longest = max(len(r[1].split()) for r in new)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= longest * len(sizes)

    pieces = stages["packing"](spark, spark.createDataFrame(mixed, SCHEMA), "").collect()
    tok = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in mixed:
        ids = tok.encode(r[1], add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k:k + 2048], dtype="<u4")
            want[r[0], k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    seqs = collections.defaultdict(list)
    for r in pieces:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_empty_tables(spark):
    now = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0, name
        if name != "packing":
            assert now.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_run_leaves_one_folder(spark, tmp_path):
    import os

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base))
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    (own,) = [d for d in set(os.listdir(base)) - before if d.startswith("corpus-pipeline-")]
    assert os.listdir(os.path.join(base, own)) == ["packing"]
    assert queries.MAX_TOKENS == 2048
