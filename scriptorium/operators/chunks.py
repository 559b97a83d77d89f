"""Chunking of document text.

``fixed_chunks`` is pure SQL (explode of computed windows).
``recursive_chunks`` follows the recursive character splitter contract
(separators blank line, newline, space, character; greedy merge with
overlap) and runs as a row-local Arrow function: each document is split on
the executor that holds it, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default splitter parameters of the reference.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS: tuple[str, ...] = ("\n\n", "\n", " ", "")
#: characters of chunks that a task holds before they go on
HELD_CHARS = 1 << 22


def n_fixed_chunks(length, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Number of windows: 0 if empty, 1 if it fits, else ceil((len-overlap)/(size-overlap))."""
    step = size - overlap
    return (
        F.when(length == 0, F.lit(0))
        .when(length <= size, F.lit(1))
        .otherwise(F.ceil((length - F.lit(overlap)) / F.lit(step)).cast("int"))
    )


def fixed_chunks(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",),
                 size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Character windows of ``size`` starting every ``size - overlap``.

    Output: keys..., chunk_no INT (0-based), chunk STRING.  Narrow: no shuffle.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = n_fixed_chunks(F.length(text), size, overlap)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return (
        df.select(*keys, F.col(text).alias("_t"), F.posexplode(starts).alias("chunk_no", "_i"))
        .select(*keys, F.col("chunk_no").cast("int").alias("chunk_no"),
                F.expr(f"substring(_t, _i * {step} + 1, {size})").alias("chunk"))
    )


# ---------------------------------------------------------------- recursive


def _cuts(text: str, lo: int, hi: int, sep: str) -> list[int]:
    """Piece boundaries of text[lo:hi]: before every separator, or every character."""
    if not sep:
        return list(range(lo, hi + 1))
    inner = [m.start() for m in re.finditer(re.escape(sep), text[lo:hi])]
    return [lo, *(lo + i for i in inner if i), hi]


def _runs(text: str, size: int, separators: Sequence[str]) -> Iterator[list[int]]:
    """Boundaries of consecutive pieces shorter than ``size``, in text order.  A
    longer piece ends a run and is cut again at the next finer separator; a
    piece that nothing can cut is a run of its own."""
    work = [(0, len(text), 0)]
    while work:
        lo, hi, level = work.pop()
        while level < len(separators) - 1 and separators[level] and text.find(separators[level], lo, hi) < 0:
            level += 1
        at = _cuts(text, lo, hi, separators[level])
        run, later = [lo], []
        for i, (a, b) in enumerate(zip(at, at[1:])):
            if b - a < size:
                run.append(b)
                continue
            if level + 1 < len(separators):
                later = [(b, hi, level)] if b < hi else []
                later.append((a, b, level + 1))
                break
            if len(run) > 1:
                yield run
            yield [a, b]
            run = [b]
        if len(run) > 1:
            yield run
        work += later


def _spans(run: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Greedy spans of whole pieces: at most ``size`` long, each beginning at most
    ``overlap`` before the last one ended."""
    first = 0
    for i in range(1, len(run) - 1):
        if run[i + 1] - run[first] > size:
            yield run[first], run[i]
            while first < i and (run[i] - run[first] > overlap or run[i + 1] - run[first] > size):
                first += 1
    yield run[first], run[-1]


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of ``text``: spans of its pieces, stripped, without blank ones."""
    chunks = (text[a:b].strip() for run in _runs(text, size, separators) for a, b in _spans(run, size, overlap)) if text else ()
    return [c for c in chunks if c]


def recursive_chunks(df: DataFrame, text: str = "text", key: str | Sequence[str] = "doc_id",
                     size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Recursive character chunks (V1): key columns, chunk_no INT (0-based), chunk.
    A null or blank text has none."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    keys = [key] if isinstance(key, str) else list(key)
    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["chunk_no int", "chunk string"])

    def split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nos, texts, held = [], [], [], 0
            for row, t in enumerate(batch.column(len(keys))):
                for i, c in enumerate(split_recursive(t.as_py() or "", size, overlap)):
                    rows.append(row)
                    nos.append(i)
                    texts.append(c)
                    held += len(c)
                    if held >= HELD_CHARS:
                        yield made(batch, rows, nos, texts)
                        rows, nos, texts, held = [], [], [], 0
            yield made(batch, rows, nos, texts)

    def made(batch: pa.RecordBatch, rows: list[int], nos: list[int], texts: list[str]) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i).take(at) for i in range(len(keys))), pa.array(nos, pa.int32()), pa.array(texts, pa.string())],
            names=[*keys, "chunk_no", "chunk"])

    return df.select(*keys, text).mapInArrow(split_batches, schema)
