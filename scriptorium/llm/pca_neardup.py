"""Near-duplicate vectors by PCA-ordered tiled comparison.

All vectors are rotated onto the eigenvectors of their second-moment matrix
(summed over the whole table), largest first.  They are cut into tiles along the
first coordinate; tiles whose boxes in the leading coordinates are further apart
than the threshold allows are never compared.  Inside a tile pair products are
accumulated over the leading dimensions; after each step the rest of a product
is at most the product of the two suffix norms, and pairs that cannot reach the
threshold stop there.

A tile pair returns, per vector, the number of its links and at most one forest
edge, never its pairs, so dense groups stay linear.  Equal vectors are one class
with a count.

Edge cases: null vectors, vectors with a null, NaN or infinite component, zero
vectors and rows with a null id link with nothing and are their own component;
lengths are compared within themselves; repeated rows are linked like any equal
vectors; an empty table gives no rows; extra columns are ignored.  Links are counted
per vector; an id that names several vectors joins their components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import materialise
from scriptorium.llm.components import connected_components

TILE = 4096
LEAD = 8
_ROWS = 256  # rows of a tile compared at a time
_SLACK = 1e-9
_SINGLE = 1e-4  # error allowed to single-precision bounds
CLASS = ["k1", "k2"]


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    return np.asarray(col.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(batches):
    """One row per vector length and task: the sum of outer products."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        size = np.asarray(batch.column("dim"))
        for d in np.unique(size).tolist():
            x = _unit(_matrix(batch.column("v").filter(pa.array(size == d))))
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["dim", "m"])


def bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length the rotation (columns by falling eigenvalue); the driver
    sees length * length sums, whatever the number of vectors."""
    sums = vectors.select("dim", "v").mapInArrow(_moments, "dim int, m array<double>") \
        .select("dim", F.posexplode("m").alias("i", "x")).groupBy("dim", "i").agg(F.sum("x").alias("x")).toArrow()
    out = {}
    dims = np.asarray(sums.column("dim"))
    for d in np.unique(dims).tolist():
        m = np.zeros(d * d)
        m[np.asarray(sums.column("i"))[dims == d]] = np.asarray(sums.column("x"))[dims == d]
        out[d] = np.ascontiguousarray(np.linalg.eigh(m.reshape(d, d))[1][:, ::-1])
    return out


def _project_udf(shared):
    @F.arrow_udf("array<double>")
    def project(v: pa.Array) -> pa.Array:
        size = np.diff(np.asarray(v.offsets))
        out = np.zeros((len(v), LEAD))
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            y = _unit(_matrix(v.take(pa.array(at)))) @ shared.value[d][:, :LEAD]
            out[at, :y.shape[1]] = y
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, LEAD), pa.int32()), pa.array(out.ravel()))

    return project


def _steps(d: int) -> list[int]:
    """Numbers of leading dimensions after which products are bounded: three
    eighths first (at least LEAD), in one matrix product, then doubling."""
    out, k = [], min(max(LEAD, -(-3 * d // 8)), d)
    while k < d:
        out.append(k)
        k *= 2
    return [*out, d]


def linked(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Boolean matrix of the pairs of unit vectors with cosine >= threshold."""
    ra, rb = a @ basis, b @ basis
    steps = _steps(a.shape[1])
    rest = [[np.sqrt(np.maximum(0.0, (r[:, k:] ** 2).sum(axis=1))) for k in steps] for r in (ra, rb)]
    k = steps[0]
    # the suffix norm as one more coordinate: the product of two rows is the bound itself
    fa, fb = (np.hstack((r[:, :k], n[0][:, None])).astype(np.float32) for r, n in zip((ra, rb), rest))
    out = np.zeros((len(a), len(b)), dtype=bool)
    for lo in range(0, len(a), _ROWS):
        bound = fa[lo:lo + _ROWS] @ fb.T
        i, j = np.divmod(np.flatnonzero(bound.ravel() >= threshold - _SINGLE), len(b))
        i += lo
        if same:
            i, j = i[j > i], j[j > i]
        dot = np.zeros(len(i))
        for s, (begin, end) in enumerate(zip([0, *steps], steps)):
            for c in range(0, len(i), 1 << 14):  # bounds the gathered rows
                p = slice(c, c + (1 << 14))
                dot[p] += np.einsum("ij,ij->i", ra[i[p], begin:end], rb[j[p], begin:end])
            go = dot + rest[0][s][i] * rest[1][s][j] >= threshold - _SLACK
            i, j, dot = i[go], j[go], dot[go]
        near = np.flatnonzero(np.abs(dot - threshold) <= 2 * _SLACK)  # decided on the vectors as given
        dot[near] = np.einsum("ij,ij->i", a[i[near]], b[j[near]])
        out[i[dot >= threshold], j[dot >= threshold]] = True
    return out


def forest(m: np.ndarray, same: bool) -> np.ndarray:
    """For rows then columns of a link matrix the smallest index of their
    component (columns count on after the rows unless they are the ``same``)."""
    na, nb = m.shape
    label = np.arange(na if same else na + nb)
    rows, cols = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
    if not len(rows):
        return label
    shift = 0 if same else na
    sub = m[np.ix_(rows, cols)]
    while True:
        before = label.copy()
        for lo in range(0, len(rows), 512):
            r = rows[lo:lo + 512]
            part = sub[lo:lo + 512]
            least = np.where(part, label[cols + shift][None, :], len(label)).min(axis=1)
            label[r] = np.minimum(label[r], least)
            least = np.where(part, label[r][:, None], len(label)).min(axis=0)
            label[cols + shift] = np.minimum(label[cols + shift], least)
        label = label[label]
        if (label == before).all():
            return label


def _compare(shared, threshold: float):
    def compare(batch: pa.Table) -> pa.Table:
        left = np.asarray(batch.column("left"))
        same = bool(batch.column("same")[0].as_py())
        ids, copies = batch.column("id").to_numpy(), batch.column("copies").to_numpy()
        x = _unit(_matrix(batch.column("v")))
        ia = np.flatnonzero(left)
        ib = ia if same else np.flatnonzero(~left)
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(ia) and len(ib):
            m = linked(x[ia], x[ib], shared.value[x.shape[1]], threshold, same)
            np.add.at(n, ia, m @ copies[ib])
            np.add.at(n, ib, m.T @ copies[ia])
            at = ia if same else np.concatenate((ia, ib))
            root[at] = at[forest(m, same)]
        some = np.flatnonzero(n)
        return pa.table({"id": pa.array(ids[some]), "n": pa.array(n[some]), "root": pa.array(ids[root[some]])})

    return compare


def _tiles(reps: DataFrame, tile: int) -> DataFrame:
    """``reps`` with ``tile``: cut at quantiles of the first coordinate, and split
    by a hash where one value holds more than a tile."""
    counts = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    cell = F.lit(0)
    for d, n in counts.items():
        if n > tile:
            parts = -(-n // tile)
            cuts = reps.where(F.col("dim") == d).agg(F.percentile_approx(F.col("y")[0], [i / parts for i in range(1, parts)], 10_000)).first()[0]
            cell = F.when(F.col("dim") == d, F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda a, c: a + (F.col("y")[0] > c).cast("int"))).otherwise(cell)
    placed = reps.withColumn("cell", cell)
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (1.5 * tile)).alias("parts"))
    return placed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("tile", F.struct("dim", "cell", F.pmod(F.xxhash64("id"), "parts").alias("part"))) \
        .drop("cell", "parts")


def _tile_pairs(tiled: DataFrame, threshold: float) -> DataFrame:
    """(a, b) tiles, a <= b, whose boxes come as near as linked unit vectors do."""
    reach = float(np.sqrt(2 - 2 * threshold)) + _SLACK if threshold < 1 else 1e-4
    box = tiled.groupBy("tile").agg(*[f(F.col("y")[i]).alias(f"{n}{i}") for i in range(LEAD) for n, f in (("lo", F.min), ("hi", F.max))])
    # meet in slabs of the first coordinate; a pair counts in the slab where it begins to overlap
    slab = lambda c: F.floor(c / reach).cast("int")
    box = box.withColumn("slab", F.explode(F.sequence(slab(F.col("lo0") - reach), slab(F.col("hi0") + reach))))
    a, b = box.alias("a"), box.alias("b")
    gap = sum((F.pow(F.greatest(F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.col(f"b.lo{i}") - F.col(f"a.hi{i}"), F.lit(0.0)), 2) for i in range(LEAD)), F.lit(0.0))
    return a.join(b, (F.col("a.slab") == F.col("b.slab")) & (F.col("a.tile") <= F.col("b.tile")) & (F.col("a.tile.dim") == F.col("b.tile.dim"))
                  & (gap <= reach * reach) & (F.col("a.slab") == slab(F.greatest("a.lo0", "b.lo0") - reach))) \
        .select(F.col("a.tile").alias("a"), F.col("b.tile").alias("b"))


def _several_vectors(given: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (u, v) that tie the classes of an id."""
    named = given.where("v is not null").select("id", F.struct(*CLASS).alias("c"))
    more = named.groupBy("id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("id")
    tied = named.join(more, "id").distinct().select("id", "c.*").join(reps.select(*CLASS, F.col("id").alias("class")), CLASS).select("id", "class")
    return tied.join(tied.groupBy("id").agg(F.min("class").alias("u")), "id").where("class <> u").select("u", F.col("class").alias("v"))


def near_vectors(rows: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``rows``."""
    spark: SparkSession = rows.sparkSession
    v = F.col("v")
    fine = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    given = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")) \
        .select("id", F.when(F.coalesce(fine, F.lit(False)), v).alias("v")) \
        .withColumns({"k1": F.when(v.isNotNull(), F.xxhash64("v")), "k2": F.when(v.isNotNull(), F.hash("v"))})
    # classes are numbered: an id may name several
    reps = materialise(given.where("v is not null").groupBy(*CLASS).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
                       .withColumns({"dim": F.size("v"), "id": F.monotonically_increasing_id()}))
    shared = spark.sparkContext.broadcast(bases(reps))
    tiled = materialise(_tiles(reps.withColumn("y", _project_udf(shared)(F.col("v"))), tile).select("id", "copies", "v", "y", "tile"))
    pairs = _tile_pairs(tiled, threshold)
    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("tile"), F.lit(True).alias("left"))))
                                             .otherwise(F.array(F.struct(F.col("a").alias("tile"), F.lit(True).alias("left")),
                                                                F.struct(F.col("b").alias("tile"), F.lit(False).alias("left"))))).alias("s"))
    there = sides.select("a", "b", "s.left", (F.col("a") == F.col("b")).alias("same"), "s.tile").join(tiled, "tile") \
        .select("a", "b", "left", "same", "id", "copies", "v")
    # a key of its own per tile pair; groups hold two tiles at most
    found = materialise(there.withColumn("pair", F.struct("a", "b")).drop("a", "b").groupBy("pair")
                        .applyInArrow(_compare(shared, threshold), "id bigint, n bigint, root bigint"))
    edges = found.select(F.col("id").alias("u"), F.col("root").alias("v")).union(_several_vectors(given, reps))
    parts = connected_components(edges)
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    label = reps.select(*CLASS, "id", "rep", "copies").join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left") \
        .select(*CLASS, "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    label = label.join(label.groupBy("component").agg(F.min("rep").alias("component_id")), "component").drop("component", "rep")
    return given.select("id", *CLASS).join(label, CLASS, "left") \
        .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
