"""Pivotal mixing and PCA-ordered vector comparison."""
import collections
import random
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import pca_neardup, pivotal_mixing


def filled(sizes, weights, share, limit):
    """Water filling by bisection, independent of the operator's loop."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    lo, hi, total = 0.0, 1e12, share * sum(sizes.values())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w[s], limit * sizes[s]) for s in sizes) < total else (lo, mid)
    return {s: min(hi * w[s], limit * sizes[s]) for s in sizes}


def test_targets():
    rng = random.Random(4)
    for _ in range(30):
        sizes = {f"s{i}": rng.choice([0, 5, 100, 10_000]) + rng.randint(0, 50) for i in range(rng.randint(1, 9))} | {None: 70}
        got = pivotal_mixing.targets(sizes, (3, 1, 2), Fraction(3, 2), 2)
        for s, t in filled(sizes, (3, 1, 2), 1.5, 2).items():
            assert float(got[s]) == pytest.approx(t, rel=1e-6, abs=1e-6)
    assert pivotal_mixing.targets({}, (3, 1, 2), Fraction(3, 2), 2) == {}


def test_block_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 50, 200)
    sums = np.zeros(200)
    for k in range(400):
        names = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        p = pivotal_mixing._round_block(names, sizes, np.full(200, 0.3), False)
        assert ((p > 0) & (p < 1)).sum() <= 1
        some = sizes > 0
        assert (p[some] * sizes[some]).sum() == pytest.approx(0.3 * sizes.sum(), abs=1e-6)
        sums += p
    assert abs(sums / 400 - 0.3).max() < 0.12


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(pivotal_mixing, "BLOCK", 16)
    monkeypatch.setattr(pivotal_mixing, "FAN", 3)
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) + f" d{i}", rng.choice(["hot", "hot", "hot", "a", "b", None]), 1, "x") for i in range(900)]
    rows += [(7000, None, "a", 1, "x"), (None, "no id", "b", 1, "x"), (7001, "twice over", "c", 1, "x"), (7001, "twice over", "c", 1, "x"), (7002, "", None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, target string")
    got = pivotal_mixing.mix(docs.repartition(3)).collect()
    again = pivotal_mixing.mix(docs.repartition(5)).collect()
    plain = sorted((str(r["doc_id"]), r["copies"]) for r in got)
    assert plain == sorted((str(r["doc_id"]), r["copies"]) for r in again)
    assert len(got) == len(rows)
    sizes, taken, goal = collections.Counter(), collections.Counter(), {}
    for r in got:
        n = len((r["text"] or "").split())
        assert r["size"] == n and 0 <= r["copies"] <= 2
        sizes[r["source"]] += n
        taken[r["source"]] += r["copies"] * n
        goal[r["source"]] = r["target"]
    want = filled(sizes, (3, 1, 2), 1.5, 2)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 42
    assert collections.Counter(map(tuple, pivotal_mixing.repeat(docs).collect())) == collections.Counter(
        tuple(r) for r, c in zip_copies(docs, got) for _ in range(c))


def zip_copies(docs, mixed):
    """(row, copies) pairs: rows of one id, text and source have the same columns here."""
    copies = {}
    for r in mixed:
        copies.setdefault((r["doc_id"], r["text"], r["source"]), []).append(r["copies"])
    for r in docs.collect():
        yield r, copies[r["doc_id"], r["text"], r["source"]].pop()


def test_repeated_rows_reach_the_target(spark, monkeypatch):
    """Half of each source is one repeated row without an id; columns of the caller stay."""
    monkeypatch.setattr(pivotal_mixing, "NUMBER_ROWS", 30)
    rng = random.Random(9)
    rows = []
    for s in ("a", "b", "c"):
        rows += [(None, "w " * 50 + s, s, 7, "k", k) for k in range(200)]
        rows += [(len(rows) + i, "w " * rng.randint(1, 99) + s, s, 7, "k", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _k1 int, _copies string, n int")
    seen = []
    for parts in (2, 5):
        monkeypatch.setattr(pivotal_mixing, "SENT_UNITS", parts - 2)
        got = pivotal_mixing.mix(docs.repartition(parts)).collect()
        assert len(got) == len(rows) and all(r["_k1"] == 7 and r["_copies"] == "k" for r in got)
        seen.append(sorted((str(r["doc_id"]), r["source"], r["copies"]) for r in got))
        for s in ("a", "b", "c"):
            mine = [r for r in got if r["source"] == s]
            assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 101
            assert all(0 <= r["copies"] <= 2 for r in mine)
    assert seen[0] == seen[1]
    out = pivotal_mixing.repeat(docs)
    assert out.columns == docs.columns and out.where("_k1 = 7 and _copies = 'k'").count() == sum(c for _, _, c in seen[0])
    assert pivotal_mixing.mix(docs.where("false")).count() == 0 and pivotal_mixing.repeat(docs.where("false")).count() == 0


def brute(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = collections.Counter(), {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[i] += 1
                n[j] += 1
                r, s = sorted((find(i), find(j)))
                up[s] = r
    return sorted((i, n[i], find(i), find(i) == i) for i, _ in rows if i is not None)


@pytest.mark.parametrize("threshold,tile", [(0.9, 4096), (0.9, 20), (0.6, 25)])
def test_vectors_equal_brute_force(spark, threshold, tile):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 20))
    rows = [(i, (centre[i % 6] + rng.normal(scale=0.25 + 0.1 * (i % 4), size=20)).astype(np.float32).tolist()) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(70)] + [(400 + i, [2 * x for x in rows[5][1]]) for i in range(3)]
    rows += [(500, None), (501, [0.0] * 20), (502, [float("nan")] + [1.0] * 19), (503, [None] + [1.0] * 19), (504, []), (505, [1.0, 0.0]), (506, [0.5, 0.0]),
             (507, [float("inf")] + [1.0] * 19), (508, [1e30] * 20), (509, [1e-30] * 20)]
    df = spark.createDataFrame([(i, v, 4, "z") for i, v in rows], "vec_id bigint, embedding array<float>, id int, v string").repartition(4)
    got = sorted(map(tuple, pca_neardup.near_vectors(df, threshold, tile=tile).collect()))
    assert got == brute(rows, threshold)


def test_vectors_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = sorted(map(str, map(tuple, pca_neardup.near_vectors(df).collect())))
    assert got == sorted(["(None, 0, None, False)", "(3, 1, 3, True)", "(3, 1, 3, True)"])
    assert pca_neardup.near_vectors(df.limit(0)).count() == 0


def test_several_vectors_of_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (1, None)]
    got = pca_neardup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (1, 0, 1, True)])


def test_forest():
    rng = np.random.default_rng(0)
    for same in (True, False):
        m = rng.random((40, 40)) < 0.03
        if same:
            m &= np.triu(np.ones((40, 40), bool), 1)
        label = pca_neardup.forest(m, same)
        up = list(range(40 if same else 80))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x
        for i, j in zip(*np.nonzero(m)):
            a, b = sorted((find(i), find(j + (0 if same else 40))))
            up[b] = a
        assert label.tolist() == [find(i) for i in range(len(up))]
