"""Whitening of embeddings by weighted multiplicity covariance.

Entries become integers x = floor(scale * c) + shift, so that equal vectors are equal
exactly, and sums over the corpus have no rounding.

1. Identical x-vectors are one class with a count (partial aggregate, so a vector that
   holds a third of all rows collapses before the shuffle).  The classes are written once.
2. Fit: exact sums S over the fit list (each class weighted by its count, or by one),
   then the covariance as a weighted product of centred matrices.  Each task adds up its
   batches and sends one d x d matrix as rows; Spark adds those per entry.  Only the sums
   (d numbers) and the covariance (d * d numbers) reach the driver, which finds the
   eigenvectors.
3. Every class is whitened once, in numpy batches, and written; the covariance of the
   whitened classes is taken in the same way to measure its distance from the identity.
4. Rows get the values of their class by a join on the class key (SHA-256 of the entries).
   Classes with more than 1 / HOT of all rows, so fewer than HOT of them, are broadcast;
   the rows of any other are few enough for one task.

Edge cases: null vectors and those with null, NaN or infinite entries get no rows; an
entry of magnitude 2**34 or more, whose sums no 64-bit number holds, counts as infinite.
Vectors of each length are a space of their own, fitted alone; vectors without entries
have no components.  Repeated rows and repeated or null ids are rows like others.  A
component without variance (constant entries, a single vector) has ``whitened`` null and
``explained`` 0.  Equal eigenvalues: any basis of their space, the same for all rows.  A
``deviation`` beyond 64 bits is null.  Extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import materialise

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: classes with more than one HOTth of all rows are joined by broadcast
HOT = 4096
LARGEST = float(1 << 34)
LIMIT = 1 << 62


def x_vectors(rows: DataFrame, vec_id: str, embedding: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x, key) of the rows whose entries are all finite numbers."""
    e = F.transform(F.col(embedding), lambda c: c.cast("double"))
    x = rows.select(F.col(vec_id).alias("vec_id"), e.alias("e")).where(F.col("e").isNotNull() & F.forall("e", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))) \
        .select("vec_id", F.transform("e", lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * scale) + shift)).alias("x"))
    return x.withColumn("key", F.unhex(F.sha2(F.array_join("x", ","), 256)))


def _matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _weights(batch: pa.RecordBatch, weighting: str) -> np.ndarray:
    n = batch.column("n").to_numpy()
    return n if weighting == "count" else np.ones(len(n), np.int64)


def _total(classes: DataFrame, d: int, weighting: str) -> tuple[int, list[int]]:
    """(n, S): length of the fit list and its exact sums per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for b in batches:
            x, w = _matrix(b, "x", d), _weights(b, weighting)
            if not len(w):
                continue
            n = sum(w.tolist())
            if int(np.abs(x).max()) * n >= LIMIT:
                x, w = x.astype(object), w.astype(object)
            total = [a + int(s) for a, s in zip(total, [*(w @ x), n])]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d + 1), pa.int32()), "s": pa.array(map(str, total))})

    found = classes.mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    s = {r["i"]: int(r["s"]) for r in found}
    return s[d], [s[i] for i in range(d)]


def _deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, s)) < LIMIT:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def _squares(y: np.ndarray) -> list[int | None]:
    """Sum of squares of every row, exactly; None beyond 64 bits."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < LIMIT:
        return (y * y).sum(axis=1).tolist()
    sums = (y.astype(object) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in sums.tolist()]


def _covariance(table: DataFrame, d: int, n: int, weighting: str, centred) -> np.ndarray:
    """sum of weight * z z' over n; ``centred(batch)`` gives the rows z of a batch."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            z, w = centred(b), _weights(b, weighting)
            total += (z * w[:, None]).T @ z
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d * d), pa.int32()), "s": pa.array(total.ravel())})

    found = table.mapInArrow(multiply, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    v = np.zeros(d * d)
    for r in found:
        v[r["i"]] = r["s"]
    v = v.reshape(d, d) / n
    return (v + v.T) / 2


def _whiten_classes(classes: DataFrame, n: int, s: list[int], axes: np.ndarray, root: np.ndarray) -> DataFrame:
    """(key, n, deviation, w) of every class: w has one value per component."""
    k = axes.shape[1]

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _deviations(_matrix(b, "x", len(s)), n, s)
            w = (y.astype(np.float64) / n) @ axes / root
            at = pa.array(np.arange(0, k * len(w) + 1, k), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(_squares(y), pa.int64()),
                                              pa.ListArray.from_arrays(at, pa.array(w.ravel()))], names=["key", "n", "deviation", "w"])

    return classes.select("key", "n", "x").mapInArrow(whiten, "key binary, n bigint, deviation bigint, w array<double>")


def _identity_error(white: DataFrame, n: int, weighting: str, live: np.ndarray) -> float:
    """Largest absolute entry of the whitened covariance minus the identity, over
    components with variance."""
    d = int(live.sum())
    if not d:
        return 0.0
    picked = white.select("n", F.slice("w", 1, d).alias("w"))  # falling eigenvalues: those without variance come last
    weight = F.col("n") if weighting == "count" else F.lit(1)
    sums = picked.select(F.posexplode("w").alias("i", "v"), weight.alias("n")).groupBy("i").agg(F.sum(F.col("v") * F.col("n")).alias("s")).collect()
    mean = np.zeros(d)
    for r in sums:
        mean[r["i"]] = r["s"] / n
    v = _covariance(picked, d, n, weighting, lambda b: _matrix(b, "w", d) - mean)
    return float(np.abs(v - np.eye(d)).max())


def _space(rows: DataFrame, classes: DataFrame, d: int, components: int, weighting: str) -> DataFrame:
    """Whitened rows of the vectors of length ``d``."""
    n, s = _total(classes, d, weighting)
    v = _covariance(classes, d, n, weighting, lambda b: _deviations(_matrix(b, "x", d), n, s).astype(np.float64) / n)
    e, axes = np.linalg.eigh(v)
    e, axes = np.maximum(e[::-1], 0.0), axes[:, ::-1]
    k, trace = min(components, d), float(np.trace(v))
    live = e > e[0] * d * np.finfo(float).eps
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    root = np.sqrt(np.where(live, e, 1.0))
    white = materialise(_whiten_classes(classes, n, s, axes[:, :k], root[:k]))
    error = _identity_error(white, n, weighting, live[:k])
    total = classes.agg(F.sum("n")).first()[0]
    hot = white.where(F.col("n") * HOT > F.lit(total)).select("key", "deviation", "w")
    cold = white.where(F.col("n") * HOT <= F.lit(total)).select("key", "deviation", "w")
    own = rows.where(F.size("x") == d).select("vec_id", "key")
    placed = own.join(F.broadcast(hot), "key").unionByName(own.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key"))
    shares = [float(e[i] / trace) if live[i] else None for i in range(k)]
    alive = _by_component(shares)
    return placed.select("vec_id", "deviation", F.posexplode("w").alias("i", "v")).select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.when(alive.isNotNull(), F.col("v")).alias("whitened"), F.coalesce(alive, F.lit(0.0)).alias("explained"), F.lit(error).alias("identity_error"))


def _by_component(values: list[float | None]) -> Column:
    return F.get(F.array(*[F.lit(v).cast("double") for v in values]), F.col("i"))


SCHEMA = T.StructType([T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                       T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS,
           weighting: str = "count", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per
    remaining row and component.  ``weighting`` is "count" (the fit list holds every
    vector) or "one" (every distinct vector once)."""
    if weighting not in ("count", "one"):
        raise ValueError(f"weighting must be 'count' or 'one', got {weighting!r}")
    vectors = x_vectors(rows, vec_id, embedding, scale, shift)
    classes = materialise(vectors.groupBy("key", "x").agg(F.count("*").alias("n")))
    lengths = sorted(r[0] for r in classes.select(F.size("x")).distinct().collect() if r[0])
    spaces = [_space(vectors, classes.where(F.size("x") == d) if len(lengths) > 1 else classes.where(F.size("x") > 0), d, components, weighting) for d in lengths]
    if not spaces:
        schema = T.StructType([T.StructField("vec_id", rows.schema[vec_id].dataType), *SCHEMA.fields])
        return rows.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, spaces)
