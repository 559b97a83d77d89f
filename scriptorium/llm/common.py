"""Shared helpers of the corpus operators: table reads, checkpoints, word hashing.

Words are runs of characters other than space and U+0009..U+000D everywhere in
this package (``bytes.split()`` splits on exactly these six bytes).  Hashes are
unsigned 64-bit and computed by numpy over whole Arrow buffers, so no Python
object is made per word.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import checkpoint_dir

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: bytes of text hashed at a time; bounds the numpy temporaries of one task
CHUNK_BYTES = 1 << 18
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` under ``sf_dir``, read by Spark alone (any file system)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder: lineage ends here and a
    lost executor never replays what came before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until ``df`` has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(col: str) -> Column:
    """Words of a text column; null text has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often and
    inside whatever lambda the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, start: int = 1) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix64((np.arange(start, start + n, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate((
                np.ones(1, np.uint64), np.full(size - 1, b & _MASK, dtype=np.uint64)))) for b in (self.base, self.inv))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_EXACT = seeds(256)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first byte, end byte, first doc, end doc) pieces of at most about
    CHUNK_BYTES: whole documents, or parts of one long document cut at white space."""
    d, n = 0, len(offsets) - 1
    while d < n:
        e = int(np.searchsorted(offsets, offsets[d] + CHUNK_BYTES, side="right")) - 1
        if e > d:
            e = min(e, n)
            yield int(offsets[d]), int(offsets[e]), d, e
            d = e
            continue
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        while lo < hi:
            cut = min(lo + CHUNK_BYTES, hi)
            while cut < hi:  # the next white space, scanned in steps
                step = _SPACE[data[cut:min(cut + 4096, hi)]]
                if step.any():
                    cut += int(step.argmax())
                    break
                cut = min(cut + 4096, hi)
            yield lo, cut, d, d + 1
            lo = cut
        d += 1


def _hash_segment(data, offsets, lo, hi, d, e, letters):
    b = data[lo:hi]
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(e - d + 1, np.int64)
    bounds = np.clip(offsets[d:e + 1] - lo, 0, hi - lo)
    solid = ~_SPACE[b]
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(len(b), dtype=bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(len(b), dtype=bool)
    after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = _BYTE_POWERS.get(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(letters[b] * up[:-1], out=total[1:])
    h = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, bounds)


def word_hashes(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, hashes of its and the following documents' words, word
    offsets) groups over a string array, in order.  A null text has no words."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, raw, body = texts.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    letters = _LOWER if lower else _EXACT
    held: list[np.ndarray] = []  # parts of one long document
    for lo, hi, d, e in _segments(data, offsets):
        h, at = _hash_segment(data, offsets, lo, hi, d, e, letters)
        if e == d + 1 and hi < offsets[e]:
            held.append(h)
            continue
        if held:
            h = np.concatenate([*held, h])
            held, at = [], np.array([0, len(h)])
        yield d, h, at.astype(np.int64)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive words: differences of one prefix
    sum over the word polynomial, shifted back by the inverse power."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORD_POWERS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix64((total[k:] - total[:n]) * down[:n])


def inside(offsets: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of n window starts whether the window of k words stays in its document."""
    ok = np.ones(n, dtype=bool)
    for cut in offsets[1:-1]:
        ok[max(0, cut - k + 1):cut] = False
    return ok


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
