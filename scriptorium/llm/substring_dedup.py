"""Removal of repeated passages by Rabin-Karp window hashes.

Every window of ``k`` consecutive words gets a Rabin-Karp hash; windows whose
word sequence starts at two or more places of the corpus are removed, and
overlapping ones merge into maximal removal intervals.

Only a small part of all windows has to travel to be counted.  A window's anchor
is its leftmost smallest ``ANCHOR``-word hash.  Equal windows have equal anchors,
at different places, so a window whose anchor sequence is an anchor at one place
only is certainly single.  Anchors (one in about 14 words) are counted first;
the windows above repeated anchors are then hashed whole and counted.  Nothing is
lost by it: it is a proof that a count is one, not a sample.

Equal texts form one class with a count, so a group of copies costs one text.
What a batch of texts repeats within itself is settled there: one row per distinct
window and batch travels to be counted, so a passage that a third of all
documents share is as many rows as there are batches, not documents.

Edge cases: null and empty texts have no words and nothing to remove; texts
shorter than ``k`` words stay whole; repeated rows (same text, whatever the id)
are copies of each other and lose every window; long texts are hashed in parts;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import inside, signed, window_hashes, word_hashes

WINDOW = 35
ANCHOR = 8
CLASS = ["k1", "k2"]


def class_key(text: Column) -> list[Column]:
    """96 bits naming a text; a null text is the empty text."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.hash(t).alias("k2")]


def _leftmost_min(g: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest of every w consecutive values."""
    best, pos, width = g, np.arange(len(g)), 1
    while width < w:
        step = min(width, w - width)
        right, left = best[step:], best[:len(best) - step]
        take = right < left
        best, pos = np.where(take, right, left), np.where(take, pos[step:], pos[:len(pos) - step])
        width += step
    return pos


def _windows(texts: pa.Array, k: int, anchor: int):
    """Per group of documents: (first document, word offsets, anchor hashes,
    window starts inside one document, the anchor position of each, word hashes)."""
    for d, h, at in word_hashes(texts):
        n = len(h) - k + 1
        if n <= 0:
            continue
        g = window_hashes(h, anchor)
        pos = _leftmost_min(g, k - anchor + 1)
        ok = np.flatnonzero(inside(at, k, n))
        if len(ok):
            yield d, at, g, ok, pos[ok], h


ROW = "array<struct<start:int,end:int,key:bigint,tag:int,weight:int>>"


def _ask(doc: np.ndarray, pos: np.ndarray, key: np.ndarray, tag: np.ndarray, copies: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """What one batch has to say about its (document, position, key) rows, sorted
    by document and position: (document, start, end, key, tag, weight) rows.

    Weight 3: [start, end) is repeated for certain (the key is meaningless).
    Weight 2: the key occurs twice or more here; nothing is marked by the answer.
    Weight 1: one occurrence, marked if the key turns out to occur elsewhere.
    """
    order = np.lexsort((pos, doc, key))
    sorted_key = key[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.cumsum(first) - 1
    many = np.bincount(group) > 1
    sure = np.zeros(len(order), dtype=bool)
    sure[order] = many[group]
    weight = 1 + many.astype(np.int64)
    if copies is not None:
        weight[np.bincount(group, copies[doc[order]]) > 1] = 2
    lead = order[first]
    mark = np.flatnonzero(sure)
    cut = np.ones(len(mark), dtype=bool)
    cut[1:] = (doc[mark[1:]] != doc[mark[:-1]]) | (pos[mark[1:]] != pos[mark[:-1]] + 1)
    heads = mark[cut]
    tails = mark[np.concatenate((cut[1:], [True]))] if len(mark) else mark
    zeros = np.zeros(len(heads), np.int64)
    rows = (np.concatenate((doc[lead], doc[heads])), np.concatenate((pos[lead], pos[heads])),
            np.concatenate((0 * lead, pos[tails] + 1)),  # the end of one position is not sent
            np.concatenate((signed(sorted_key[first]), zeros)), np.concatenate((tag[lead], zeros)),
            np.concatenate((weight, zeros + 3)))
    by_doc = np.argsort(rows[0], kind="stable")
    return tuple(r[by_doc] for r in rows)


def _lists(n: int, found: list[tuple[np.ndarray, ...]], copies: np.ndarray | None = None) -> pa.Array:
    """The rows of a batch, one list per document."""
    cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
    cols[2] = cols[2].astype(np.uint64)
    doc, *rest = _ask(*cols, copies)
    at = np.searchsorted(doc, np.arange(n + 1))
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    items = pa.StructArray.from_arrays([pa.array(c).cast(t) for c, t in zip(rest, types)], names=["start", "end", "key", "tag", "weight"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)


def _anchors_udf(k: int, anchor: int):
    @F.arrow_udf(ROW)
    def anchors(texts: pa.Array) -> pa.Array:
        found = []
        for d, at, g, _, pos, _ in _windows(texts, k, anchor):
            first = pos[np.concatenate(([True], pos[1:] != pos[:-1]))]
            doc = np.searchsorted(at, first, side="right") - 1
            found.append((d + doc, first - at[doc], g[first], np.zeros(len(first), np.int64)))
        return _lists(len(texts), found)

    return anchors


def _windows_udf(k: int, anchor: int):
    @F.arrow_udf(ROW)
    def windows(texts: pa.Array, copies: pa.Array, spans: pa.Array) -> pa.Array:
        found = []
        lists = np.asarray(spans.offsets)
        lo, hi = (np.asarray(spans.values.field(i)) for i in (0, 1))
        for d, at, g, start, pos, h in _windows(texts, k, anchor):
            edge = np.zeros(len(h) + 1, dtype=np.int32)  # marked anchor positions by their ends
            a, b = lists[d], lists[d + len(at) - 1]
            base = np.repeat(at[:-1], np.diff(lists[d:d + len(at)]))
            np.add.at(edge, lo[a:b] + base, 1)
            np.add.at(edge, hi[a:b] + base, -1)
            hit = np.cumsum(edge)[pos] > 0
            start, pos = start[hit], pos[hit]
            if len(start):
                doc = np.searchsorted(at, start, side="right") - 1
                found.append((d + doc, start - at[doc], window_hashes(h, k)[start], (g[pos] & np.uint64(0x7FFFFFFF)).astype(np.int64)))
        return _lists(len(texts), found, copies.to_numpy(zero_copy_only=False))

    return windows


def _cut_udf(k: int):
    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,spans:array<struct<start:int,end:int>>,kept:string>")
    def cut(texts: pa.Array, copies: pa.Array, starts: pa.Array) -> pa.Array:
        n_words, n_removed, at, lo, hi, kept = [], [], [0], [], [], []
        for x, many, s in zip(texts.cast(pa.large_string()).cast(pa.large_binary()), copies.to_pylist(), starts.to_pylist()):
            words = (x.as_py() or b"").split()
            found = sorted((r["start"], r["end"] - 1 + k) for r in s or ())  # in words
            if many > 1 and len(words) >= k:
                found = [(0, len(words))]
            out, gone, done = [], 0, 0
            for i, (a, b) in enumerate(found):
                if i and a <= done:  # touching windows merge
                    gone, done = gone + max(b - done, 0), max(b, done)
                    hi[-1] = done
                    continue
                lo.append(a)
                hi.append(b)
                out += words[done:a]
                gone, done = gone + b - a, b
            out += words[done:]
            n_words.append(len(words))
            n_removed.append(gone)
            at.append(len(lo))
            kept.append(b" ".join(out))
        spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["start", "end"]))
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), spans, pa.array(kept, pa.binary()).cast(pa.string())],
            names=["n_words", "n_removed", "spans", "kept"])

    return cut.asNondeterministic()


def _repeated(rows: DataFrame, out: str) -> DataFrame:
    """Per class the marked [start, end) of rows whose key has a weight above one."""
    own = F.when(F.col("weight") == 3, F.xxhash64(*CLASS, "start")).otherwise(F.col("key"))  # spreads settled rows
    total = F.sum("weight").over(Window.partitionBy("key", "tag"))
    marks = rows.withColumn("key", own).withColumn("total", total).where("total > 1 and weight <> 2")
    return marks.withColumn("end", F.when(F.col("weight") == 3, F.col("end")).otherwise(F.col("start") + 1)) \
        .groupBy(*CLASS).agg(F.collect_list(F.struct("start", "end")).alias(out))


def repeat_classes(docs: DataFrame, text: str = "text", k: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per distinct text: (k1, k2, cut) with ``cut`` = n_words, n_removed, spans
    (maximal removal intervals of words) and the kept text."""
    classes = docs.select(*class_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("t")) \
        .groupBy(*CLASS).agg(F.first("t").alias("t"), F.count("*").alias("copies"))
    anchors = classes.select(*CLASS, F.explode(_anchors_udf(k, anchor)(F.col("t"))).alias("a")).select(*CLASS, "a.*")
    windows = classes.join(_repeated(anchors, "marked"), CLASS) \
        .select(*CLASS, F.explode(_windows_udf(k, anchor)(F.col("t"), F.col("copies"), F.col("marked"))).alias("w")).select(*CLASS, "w.*")
    return classes.join(_repeated(windows, "starts"), CLASS, "left") \
        .select(*CLASS, _cut_udf(k)(F.col("t"), F.col("copies"), F.col("starts")).alias("cut"))


def attach(docs: DataFrame, classes: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with the columns of its text's class."""
    return docs.select("*", *class_key(F.col(text))).join(classes, CLASS).drop(*CLASS)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) per row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return attach(rows, repeat_classes(docs, text, k, anchor), "t").select("doc_id", "cut.*")
