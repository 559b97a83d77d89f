"""Ranked lexical search by sequential reads with score intervals (NRA).

Terms are maximal runs of ASCII digits, ASCII letters and characters from U+0080 on,
A-Z lower-cased.  All arithmetic but one logarithm per term is on integers, so scores
are equal on every run and in SQL.

1. The queries are taken in blocks of bounded size (``BLOCK_ITEMS``, ``BLOCK_CHARS``);
   a block's items and its distinct terms are what the driver holds and sends.
2. One Arrow pass over all documents counts each whole text's terms, and the occurrences
   of the block's terms.  Document frequencies are a partial aggregate over that table.
3. Documents are dealt to shards by row, not by id or text, so copies spread.  A shard
   holds a bounded number of documents and postings.  Its postings form one list per
   term, by falling impact.
4. For each query the lists are read front to back in growing steps.  A document's
   score lies between what was read for it (lower) and that plus the next unread impact
   of every list it was not met in (upper).  Documents whose upper end is under the k-th
   best lower end leave.  Reading stops when no unseen document can reach or tie with
   the k-th best and every document left has one value, not an interval.
5. The shards' best rows meet in one ranking per query, cut to k before the shuffle.

Edge cases: null and empty texts and those without a term are no documents of the
count; null, empty or unmatched queries return no rows; repeated documents are ranked
one by one; equal scores go by id, null ids last, then by row; repeated query rows are
queries of their own; very long texts are counted whole; extra columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import materialise, partitions

TOP = 10
BLOCK_ITEMS, BLOCK_CHARS = 2_000, 4_000_000
#: documents and postings of a shard at most (about), and documents that make a shard worth its own task
SHARD_DOCS, SHARD_POSTINGS, LEAST_DOCS = 16_384, 2_000_000, 2_048
#: entries read from each list in the first round; every round reads twice as many
FIRST_READ = 64

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _term_counts(shared):
    """(n, terms, tfs): all terms of a text, and its terms of the shared vocabulary."""

    @F.arrow_udf("struct<n:bigint,terms:array<int>,tfs:array<int>>")
    def term_counts(texts: pa.Array) -> pa.Array:
        vocab = shared.value
        n, at, found, tfs = [], [0], [], []
        for x in texts.cast(pa.large_string()).cast(pa.large_binary()):
            words = terms(x.as_py() or b"")
            count = Counter(words)
            for t in count.keys() & vocab.keys():
                found.append(vocab[t])
                tfs.append(count[t])
            n.append(len(words))
            at.append(len(found))
        at = pa.array(at, pa.int32())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(found, pa.int32())),
                                           pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], names=["n", "terms", "tfs"])

    return term_counts.asNondeterministic()


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """w * ((10**9 * tf) div (1000 * tf + 8 * m)) with m = 10 + (90 * n * N) div L."""
    if 90 * n_docs * int(n.max(initial=0)) >= 1 << 63:
        m = np.array([10 + 90 * int(x) * n_docs // length for x in n], np.int64)
    else:
        m = 10 + 90 * n * n_docs // length
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def nra(lo: np.ndarray, hi: np.ndarray, docs: np.ndarray, value: np.ndarray, n_docs: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) among which the ``top`` best are, with all that tie with the
    last of them.  List i is ``docs[lo[i]:hi[i]]``, its impacts ``value`` fall."""
    lists = np.flatnonzero(hi > lo)
    at, hi = lo[lists].copy(), hi[lists]
    lower = np.zeros(n_docs, np.int64)
    left = np.ones(n_docs, dtype=bool)  # documents that may still be among the best
    met_docs, met_lists = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = FIRST_READ
    while True:
        take = np.minimum(step, hi - at)
        which = np.repeat(np.arange(len(at)), take)
        read = np.repeat(at - np.cumsum(take) + take, take) + np.arange(len(which))
        at, step = at + take, 2 * step
        d = docs[read]
        known = left[d]
        d, which, read = d[known], which[known], read[known]
        np.add.at(lower, d, value[read])
        met_docs, met_lists = np.concatenate((met_docs, d)), np.concatenate((met_lists, which))
        open_ = at < hi
        front = np.where(open_, value[np.minimum(at, len(value) - 1)], 0)
        rest = int(front.sum())
        if not rest:
            break
        last = int(np.partition(lower, n_docs - top)[n_docs - top]) if n_docs >= top else 0
        reach = np.full(n_docs, rest, np.int64)  # what lists in which the document was not met may add
        np.subtract.at(reach, met_docs, front[met_lists])
        left &= lower + reach >= max(last, 1)
        if not reach[left].any():
            break
        keep = left[met_docs]
        met_docs, met_lists = met_docs[keep], met_lists[keep]
    lower[~left] = 0
    found = np.flatnonzero(lower > 0)
    if len(found) > top:
        found = found[lower[found] >= np.partition(lower[found], len(found) - top)[len(found) - top]]
    return found, lower[found]


def _search_shard(queries: list[list[int]], weights: np.ndarray, n_docs: int, length: int, top: int):
    def search(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        rows = batch.num_rows
        lists = batch.column("terms").combine_chunks() if rows else pa.array([], pa.list_(pa.int32()))
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = batch.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(rows), size)
        value = impacts(tf, batch.column("n").to_numpy()[doc], weights[term], n_docs, length)
        order = np.lexsort((doc, -value, term))
        term, doc, value = term[order], doc[order], value[order]
        ends = np.searchsorted(term, np.arange(len(weights) + 1))
        ids = batch.column("doc_id").combine_chunks()
        row = batch.column("row").to_numpy()
        name, missing = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        item, at, score = [], [], []
        for i, q in enumerate(queries):
            found, s = nra(ends[q], ends[np.asarray(q, np.int64) + 1], doc, value, rows, top)
            best = np.lexsort((row[found], name[found], missing[found], -s))[:top]
            item.append(np.full(len(best), i, np.int32))
            at.append(found[best])
            score.append(s[best])
        at = np.concatenate(at)
        return pa.table({"item": pa.array(np.concatenate(item)), "row": batch.column("row").combine_chunks().take(pa.array(at)),
                         "doc_id": ids.take(pa.array(at)), "score": pa.array(np.concatenate(score), pa.int64())})

    return search


def _search_block(docs: DataFrame, names: list, texts: list, item_id: T.DataType, top: int) -> DataFrame | None:
    """Ranking for one block of queries."""
    spark = docs.sparkSession
    split = [sorted(set(terms((t or "").encode("utf-8", "replace")))) for t in texts]
    vocab = {t: i for i, t in enumerate(sorted(set().union(*split)))}
    if not vocab:
        return None
    shared = spark.sparkContext.broadcast(vocab)
    counted = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _term_counts(shared)(F.col("text")).alias("c"))
                          .select("row", "doc_id", "c.*").where("n > 0"))
    n_docs, length, postings = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms").cast("bigint")), F.lit(0))).first()
    if not postings:
        return None
    weights = np.zeros(len(vocab), np.int64)
    for t, df in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        weights[t] = weight(n_docs, df)
    queries = [[vocab[t] for t in s if weights[vocab[t]] > 0] for s in split]
    shards = max(min(partitions(spark), n_docs // LEAST_DOCS), -(-n_docs // SHARD_DOCS), -(-postings // SHARD_POSTINGS), 1)
    found = counted.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))) \
        .groupBy("shard").applyInArrow(_search_shard(queries, weights, n_docs, length, top), "item int, row bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    labels = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_id)]))
    return ranked.join(F.broadcast(labels), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each row of ``items``."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS), 1)
    found = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        part = _search_block(docs, [r["item_id"] for r in block], [r["text"] for r in block], items.schema["item_id"].dataType, top)
        if part is not None:
            found.append(part)
    if not found:
        return docs.sparkSession.createDataFrame([], T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()),
                                                                   T.StructField("score", T.LongType())]))
    return reduce(DataFrame.unionByName, found)
