"""Vectors and exact nearest-neighbour retrieval.

Design for scale: queries and corpus are dealt to blocks of bounded size and meet
block by block in a cogroup, so neither side is ever held whole by the driver or a
task.  A pair of blocks keeps its local top-k per query; the final top-k is a
``row_number`` window, which Spark plans as a partial ``WindowGroupLimit`` before
the shuffle, so only k rows per query and partition move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scriptorium.functions.text import words

DEFAULT_TOP_K = 5
MAX_TOP_K = 20
EMBED_DIM = 64
#: corpus rows and queries of a pair of blocks, at most about; corpus rows worth a block of their own
BLOCK_ROWS, BLOCK_QUERIES, LEAST_ROWS = 16_384, 4_096, 1_024
#: distances screened at a time by one task
SCREEN = 1 << 21
#: score of squared distance 1, cosine 0.5 between unit vectors
MIN_ANSWER_SCORE = 0.5
EMBEDDING_MODEL = "md5-hashing-64"


def check_top_k(top_k: int) -> int:
    """Parameter bound of the reference: 1 <= top_k <= 20 (F8)."""
    if not isinstance(top_k, int) or isinstance(top_k, bool) or not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be an integer in [1, {MAX_TOP_K}], got {top_k!r}")
    return top_k


# ------------------------------------------------------------------ embed


def hash_embed(df: DataFrame, text: str, keys: Sequence[str], dim: int = EMBED_DIM,
               out: str = "embedding") -> DataFrame:
    """Hashing embedder (V2): lower-cased word tokens -> md5 bucket and sign,
    summed per row and L2-normalised.  Rows without tokens get a zero vector.

    Row-local: one Arrow function over the words of each row, no exchange, and
    rows with equal keys stay apart.
    """
    @F.arrow_udf("array<double>")
    def embed(tokens: pa.Array) -> pa.Array:
        size = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        found = tokens.flatten().dictionary_encode()  # each word is hashed once a batch
        hashes = [hashlib.md5(w.encode()).hexdigest() for w in found.dictionary.to_pylist()]
        bucket = np.array([int(h[:8], 16) % dim for h in hashes], dtype=np.int64)
        sign = np.array([1.0 if int(h[8], 16) % 2 == 0 else -1.0 for h in hashes])
        word = found.indices.to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(tokens)) * dim, size) + bucket[word]
        out = np.bincount(at, weights=sign[word], minlength=len(tokens) * dim).astype(float).reshape(len(tokens), dim)  # whole numbers if no word is there
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        np.divide(out, norm, out=out, where=norm > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), pa.array(out.ravel()))

    # evaluated once, also under a filter on the vectors
    return df.select(*keys, embed.asNondeterministic()(words(text)).alias(out))


def centroids(df: DataFrame, key: str, vec: str, out: str = "embedding") -> DataFrame:
    """Mean vector per key (element-wise, in DOUBLE).  Partial aggregation per
    (key, position) keeps a hot key from landing whole on one task."""
    per_dim = (
        df.select(key, F.posexplode(vec).alias("_i", "_x"))
        .groupBy(key, "_i")
        .agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    )
    return per_dim.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out)
    )


# ------------------------------------------------------------------ kNN


def squared_l2(a: str, b: str):
    """Squared Euclidean distance of two array columns, summed in DOUBLE."""
    diffs = F.zip_with(F.col(a), F.col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def comparable(v: str):
    """Vectors that take part in a search: not null, without null, NaN or infinite
    components.  Vectors of different lengths never meet."""
    return F.col(v).isNotNull() & F.forall(F.col(v), lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))


def _final_top_k(cands: DataFrame, query_key: str, corpus_keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(query_key).orderBy(F.col("distance"), *[F.col(c) for c in corpus_keys])
    return (
        cands.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def _knn_native(queries: DataFrame, corpus: DataFrame, query_key: str, corpus_keys: list[str],
                qvec: str, cvec: str, k: int, within: Sequence[str] = ()) -> DataFrame:
    within = list(within)
    q = queries.select(query_key, *within, F.col(qvec).alias("_q"))
    c = corpus.select(*corpus_keys, *[w for w in within if w not in corpus_keys], F.col(cvec).alias("_c"))
    joined = c.join(F.broadcast(q), within) if within else c.join(F.broadcast(q))
    cands = joined.where(F.size("_q") == F.size("_c")).select(query_key, *corpus_keys, squared_l2("_q", "_c").alias("distance"))
    return _final_top_k(cands, query_key, corpus_keys, k)


def _nearest(qm: np.ndarray, cm: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact distance) of the k nearest rows of ``cm`` to every row of
    ``qm``, and of all rows tied with the last of them.  One matrix product screens;
    rows that rounding (relative to the norms) may hide are computed exactly, in the
    summation order of the SQL form."""
    d, m = cm.shape[1], min(k, len(cm))
    qn, cn = (qm * qm).sum(axis=1), (cm * cm).sum(axis=1)
    norms = qn[:, None] + cn
    slack = (8.0 * (d + 4) * np.finfo(float).eps) * norms
    approx = norms - 2.0 * (qm @ cm.T)
    q, row = np.nonzero(approx - slack <= np.partition(approx + slack, m - 1, axis=1)[:, m - 1:m])
    dist = np.zeros(len(q))
    for t in range(d):
        diff = qm[q, t] - cm[row, t]
        dist += diff * diff
    order = np.lexsort((dist, q))
    starts = np.searchsorted(q[order], np.arange(len(qm)))
    near = dist <= dist[order][starts + m - 1][q]
    return q[near], row[near], dist[near]


def _vectors(col: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (positions, matrix) of the vectors of a list column."""
    lists = col.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        out[d] = (at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d))
    return out


def _compare_blocks(query_key: str, corpus_keys: list[str], schema: pa.Schema, k: int):
    """The k best rows of one corpus block for each query of one query block."""
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            corpus = _vectors(right.column("_c"))
            for d, (at, qm) in _vectors(left.column("_q")).items():
                mine, cm = corpus.get(d, (None, None))
                if mine is None:
                    continue
                step = max(1, SCREEN // len(cm))
                for lo in range(0, len(qm), step):
                    q, row, dist = _nearest(qm[lo:lo + step], cm, k)
                    part = right.select([f"_k{i}" for i in range(len(corpus_keys))]).take(pa.array(mine[row]))
                    part = part.append_column("distance", pa.array(dist)).append_column("_n", pa.array(at[lo + q]))
                    found.append(_first_k(part, ["distance", *part.column_names[:len(corpus_keys)]], k))
        if not found:
            return schema.empty_table()
        table = pa.concat_tables(found)
        cols = [left.column("_key").take(table.column("_n")), *[table.column(f"_k{i}") for i in range(len(corpus_keys))], table.column("distance")]
        return pa.Table.from_arrays(cols, schema=schema)

    return compare


def _first_k(part: pa.Table, order: list[str], k: int) -> pa.Table:
    """The first k rows of each query, so that rows tied in distance stay few."""
    ranked = part.take(pc.sort_indices(part, sort_keys=[(c, "ascending") for c in ["_n", *order]], null_placement="at_start"))
    n = ranked.column("_n").to_numpy()
    starts = np.maximum.accumulate(np.where(np.append(True, n[1:] != n[:-1]), np.arange(len(n)), 0)) if len(n) else n
    return ranked.filter(pa.array(np.arange(len(n)) - starts < k))


def _blocks(rows: int, most: int, least: int, tasks: int) -> int:
    """Blocks of at most about ``most`` rows; more, down to ``least``, to busy ``tasks``."""
    return max(1, -(-rows // most), min(tasks, -(-rows // least)))


def _knn_blocks(queries: DataFrame, corpus: DataFrame, query_key: str, corpus_keys: list[str],
                qvec: str, cvec: str, k: int, within: Sequence[str] = ()) -> DataFrame:
    """Query blocks and corpus blocks, both DataFrames, meet by key in one cogroup;
    each pair of blocks keeps its k best rows per query.  The corpus moves once for
    every query block, the queries once for every corpus block, and nothing passes
    through the driver but two counts."""
    spark, within = corpus.sparkSession, list(within)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_c = _blocks(corpus.count(), BLOCK_ROWS, LEAST_ROWS, tasks)
    n_q = _blocks(queries.count(), BLOCK_QUERIES, BLOCK_QUERIES, tasks)

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.where(comparable(qvec)).dropna(subset=within) if within else queries.where(comparable(qvec))
    c = corpus.where(comparable(cvec))
    names = [f"_w{i}" for i in range(len(within))]
    q = q.select(*[F.col(w).alias(n) for w, n in zip(within, names)], F.col(query_key).alias("_key"), F.col(qvec).alias("_q"),
                 F.pmod(F.xxhash64(query_key), F.lit(n_q)).cast("int").alias("_qb"), each(n_c).alias("_cb"))
    c = c.select(*[F.col(w).alias(n) for w, n in zip(within, names)], *[F.col(x).alias(f"_k{i}") for i, x in enumerate(corpus_keys)], F.col(cvec).alias("_c"),
                 each(n_q).alias("_qb"), F.pmod(F.xxhash64(*corpus_keys, cvec), F.lit(n_c)).cast("int").alias("_cb"))
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), *[T.StructField(x, corpus.schema[x].dataType) for x in corpus_keys],
                           T.StructField("distance", T.DoubleType())])
    grid = [*names, "_qb", "_cb"]
    cands = q.groupBy(*grid).cogroup(c.groupBy(*grid)).applyInArrow(_compare_blocks(query_key, corpus_keys, to_arrow_schema(schema), k), schema)
    return _final_top_k(cands, query_key, corpus_keys, k)


def knn(queries: DataFrame, corpus: DataFrame, query_key: str, corpus_keys: Sequence[str],
        qvec: str = "embedding", cvec: str = "embedding", top_k: int = DEFAULT_TOP_K,
        method: str = "auto", within: Sequence[str] = ()) -> DataFrame:
    """Exact k nearest neighbours by squared L2 (V4) with score 1/(1+d) (V5).

    Output: query_key, rank BIGINT (1-based), corpus_keys..., distance, score.
    ``k`` is clamped to the corpus size by construction (row_number <= k).
    ``within`` names columns present on both sides (e.g. a store id): a
    query only meets corpus rows with equal values; null equals nothing.
    Vectors that are not ``comparable`` take no part on either side; both
    methods give the same rows, whatever the number of queries.  ``native`` joins
    rows in SQL expressions and is for small query sets.
    """
    k = check_top_k(top_k)
    corpus_keys = list(corpus_keys)
    if method == "native":
        res = _knn_native(queries.where(comparable(qvec)), corpus.where(comparable(cvec)), query_key, corpus_keys, qvec, cvec, k, within)
    else:
        res = _knn_blocks(queries, corpus, query_key, corpus_keys, qvec, cvec, k, within)
    return res.select(query_key, "rank", *corpus_keys, "distance",
                      (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("score"))


def best_answers(questions: DataFrame, corpus: DataFrame, query_key: str, corpus_keys: Sequence[str],
                 min_score: float = MIN_ANSWER_SCORE) -> DataFrame:
    """The nearest row of ``corpus`` for each question whose score reaches
    ``min_score``.  Questions without a word (a zero vector) and those without a
    row near enough give none: their answer is not in the documents."""
    asked = questions.where(F.exists("embedding", lambda x: x != 0))
    return knn(asked, corpus, query_key, corpus_keys, top_k=1).where(F.col("score") >= min_score)


def pack_results(hits: DataFrame, query_key: str, item: str = "chunk") -> DataFrame:
    """Parallel arrays in rank order per query (V6): items, scores."""
    s = F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("_it"), "score")))
    return hits.groupBy(query_key).agg(
        F.transform(s, lambda x: x["_it"]).alias("chunks"),
        F.transform(s, lambda x: x["score"]).alias("scores"),
    )
