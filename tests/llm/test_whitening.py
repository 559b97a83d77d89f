"""Whitening against numpy over the whole table."""
import math
import random

import numpy as np
import pytest

from scriptorium.llm import embedding_whitening as W, queries

SF = "/root/testdata/sf0.001"


def check(got, vectors, components=32, weighting="count"):
    """``vectors``: (id, x row) of the fit list; ids are unique."""
    x = np.array([v for _, v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object) if weighting == "one" else x
    n, d = len(fit), x.shape[1]
    s = fit.sum(axis=0)
    z = ((n * fit - s).astype(float)) / n
    v = z.T @ z / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, d)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(by) == len(vectors) and len(got) == k * len(vectors)
    white = np.array([[by[i][c + 1]["whitened"] if by[i][c + 1]["whitened"] is not None else np.nan for c in range(k)] for i, _ in vectors])
    own = ((n * x - s).astype(float) / n) @ axes[:, :k]
    for c in range(k):
        some = by[vectors[0][0]][c + 1]
        assert some["n"] == n
        if e[c] > e[0] * d * np.finfo(float).eps:
            assert math.isclose(some["explained"], e[c] / np.trace(v), rel_tol=1e-6)
            want = own[:, c] / math.sqrt(e[c])
            assert min(np.abs(white[:, c] - want).max(), np.abs(white[:, c] + want).max()) < 1e-6
        else:
            assert some["explained"] == 0 and np.isnan(white[:, c]).all()
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-6
    for (i, _), y in zip(vectors, n * x - s):
        exact = sum(int(a) ** 2 for a in y)
        assert {r["deviation"] for r in by[i].values()} == {exact if exact < 1 << 63 else None}


def x_of(v):
    return [math.floor(64 * float(c)) + 1_000_000 for c in v]


def test_query_equals_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(queries.op11(spark, SF).collect(), [(r["vec_id"], x_of(r["embedding"])) for r in rows])


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    good = [[rng.gauss(0, 1) * (c + 1) for c in range(5)] + [7.0] for _ in range(60)]
    good += [good[0]] * 200 + [good[1]] * 3  # a hot vector
    bad = [None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [1.0, float("inf")] + [0.0] * 4, [1e30] * 6, []]
    return good, bad


@pytest.mark.parametrize("weighting,hot", [("count", 4096), ("one", 4096), ("count", 2)])
def test_repeats_nulls_and_constant_entries(spark, odd, weighting, hot, monkeypatch):
    monkeypatch.setattr(W, "HOT", hot)
    good, bad = odd
    rows = [(i, v, 1.0, "x") for i, v in enumerate(good)] + [(1000 + i, v, 1.0, "x") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, whitened double, key string")
    check(W.whiten(df, weighting=weighting).collect(), [(i, x_of(v)) for i, v in enumerate(good)], weighting=weighting)


def test_each_length_is_a_space(spark, odd):
    good, _ = odd
    short = [[a, b] for a, b, *_ in good[:30]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(good + short)], "vec_id bigint, embedding array<double>")
    got = W.whiten(df).collect()
    check([r for r in got if r["vec_id"] < len(good)], [(i, x_of(v)) for i, v in enumerate(good)])
    check([r for r in got if r["vec_id"] >= len(good)], [(len(good) + i, x_of(v)) for i, v in enumerate(short)])


def test_null_ids_single_vector_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0])] * 3, "vec_id string, embedding array<float>")
    got = W.whiten(df).collect()
    assert [(r["vec_id"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(None, 3, 0, None, 0.0, 0.0)] * 6
    none = W.whiten(df.where("false"))
    assert none.collect() == [] and none.dtypes == W.whiten(df).dtypes


def test_large_entries_stay_exact(spark):
    big = [[float(1 << 33), 1.5], [-float(1 << 33), 2.5], [3.0, 8.0], [float(1 << 33) - 9, 0.0]]
    df = spark.createDataFrame(list(enumerate(big)), "vec_id bigint, embedding array<double>")
    got = W.whiten(df, components=2).collect()
    n, x = 4, [x_of(v) for v in big]
    s = [sum(c) for c in zip(*x)]
    for r in got:
        exact = sum((n * a - b) ** 2 for a, b in zip(x[r["vec_id"]], s))
        assert r["deviation"] == (exact if exact < 1 << 63 else None)
