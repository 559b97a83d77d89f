"""Quality rules by compression bands.

A document is judged by the zstandard ratio (compressed / raw UTF-8 bytes) of
its whole text and of its fixed chunks.  Repetitive text compresses too well,
keys and encoded junk hardly at all; what is usual depends on the length, so the
limits are a table by length.  Both are the same for every script: the low ones count
letters, not bytes, and the high ones take the ratio of a form with one byte for a
letter (three for kana, ideographs and syllables), which for Latin text is the text.
Simple base rules (length, repeated 3-word windows) are reported beside it.

One row in, one row out, no shuffle: the work is a per-row Arrow function, so a
hot source or group of copies changes nothing and a lost task is simply rerun.

Edge cases: null, empty and blank texts have zero counts and fail the base
rules; very long texts are compressed whole, chunk by chunk for the chunk rule;
repeated rows are judged one by one; every other column passes unchanged, and
the result column replaces one of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import inside, mix64, window_hashes, word_hashes

FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, ratio double, n_chunks int, n_bad_chunks int, band string, kept boolean")


@dataclass(frozen=True)
class Bands:
    """Allowed ratios of the whole text.  ``lows``: (letters below which the row
    holds, fewest compressed bytes per letter, see ``letters``); ``highs``: (bytes of
    the folded text, see ``folded``, below which the row holds, its highest ratio).  The last row holds for all longer
    texts.  The low limits follow repetition: a text said three times over is
    below them, license texts, the most formulaic prose, are well above."""

    lows: tuple[tuple[float, float], ...] = (
        (2048, 0.28), (8192, 0.25), (32768, 0.22), (131072, 0.20), (float("inf"), 0.17))
    highs: tuple[tuple[float, float], ...] = (
        (128, 1.10), (256, 0.95), (512, 0.80), (1024, 0.74), (2048, 0.68), (4096, 0.62), (8192, 0.60),
        (16384, 0.58), (32768, 0.56), (float("inf"), 0.55))
    level: int = 3
    chunk_bytes: int = 4096
    #: per letter
    chunk_low: float = 0.25
    chunk_high: float = 0.64
    #: share of chunks outside the chunk limits from which a text is rejected
    bad_share: float = 0.25
    min_words: int = 50
    max_repeat_percent: int = 50


_SYMBOLS = b"#*$%&|<>"
_CONTINUATION, _BELOW_U3000 = bytes(range(0x80, 0xC0)), bytes(range(0xE3))


def letters(raw: bytes) -> int:
    """Length of UTF-8 text whatever its script: code points, those from U+3000
    on (kana, ideographs, syllables: about two letters' content) counted twice."""
    return len(raw.translate(None, _CONTINUATION)) + len(raw.translate(None, _BELOW_U3000))


def folded(raw: bytes) -> bytes:
    """UTF-8 text with one byte a letter: the low byte of code points under U+3000,
    which tells the letters of one script apart; all others keep their three bytes."""
    if raw.isascii():
        return raw
    units = np.frombuffer(raw.decode("utf-8", "ignore").encode("utf-16-le", "ignore"), dtype="<u2")
    wide = units >= 0x3000
    one = np.stack((np.where(wide, 0xE0 | units >> 12, units & 0xFF), 0x80 | units >> 6 & 0x3F, 0x80 | units & 0x3F), axis=1).astype(np.uint8)
    keep = np.ones(one.shape, dtype=bool)
    keep[:, 1:] = wide[:, None]
    return one[keep].tobytes()


def _limit(rows: tuple, size: int) -> float:
    return next(limit for below, limit in rows if size < below)


def _repeated(h: np.ndarray, at: np.ndarray, k: int = 3) -> np.ndarray:
    """Per document the words inside k-word windows that its text holds twice or more."""
    n = len(h) - k + 1
    out = np.zeros(len(at) - 1, dtype=np.int64)
    if n <= 0:
        return out
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    w = mix64(window_hashes(h, k) + doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    pos = np.flatnonzero(inside(at, k, n))
    order = pos[np.argsort(w[pos])]
    same = w[order[1:]] == w[order[:-1]]
    hit = np.concatenate((order[1:][same], order[:-1][same]))
    covered = np.zeros(len(h), dtype=bool)
    for j in range(k):
        covered[hit + j] = True
    return np.bincount(doc[covered], minlength=len(at) - 1)


def _judge(raw: bytes, n_words: int, n_repeat: int, b: Bands, z: zstandard.ZstdCompressor) -> tuple:
    lines, seen, dup = raw.split(b"\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += bool(line.split(None, 1))
            seen.add(line)
    base_failed = n_words < b.min_words or 100 * n_repeat > b.max_repeat_percent * n_words
    if not raw:
        return dup, base_failed, None, 0, 0, "empty", False
    packed, size = len(z.compress(raw)), letters(raw)
    ratio = packed / len(raw)
    n_chunks = bad = 0
    if len(raw) >= 2 * b.chunk_bytes:
        n_chunks = len(raw) // b.chunk_bytes  # the rest joins the last chunk
        for i in range(n_chunks):
            part = raw[i * b.chunk_bytes:(i + 1) * b.chunk_bytes if i + 1 < n_chunks else len(raw)]
            low = b.chunk_low * letters(part)
            bad += len(z.compress(part)) < low or _folded_ratio(part, z)[0] > b.chunk_high
    high, n_folded = _folded_ratio(raw, z, packed)
    band = "repetitive" if packed < _limit(b.lows, size) * size else \
        "incompressible" if high > _limit(b.highs, n_folded) else \
        "chunks" if bad > b.bad_share * n_chunks else "ok"
    return dup, base_failed, ratio, n_chunks, bad, band, band == "ok" and not base_failed


def _folded_ratio(raw: bytes, z: zstandard.ZstdCompressor, packed: int | None = None) -> tuple[float, int]:
    """(ratio, length) of the folded form; ``packed`` is the compressed size of ``raw``."""
    one = folded(raw)
    if one is raw and packed is not None:
        return packed / max(1, len(raw)), len(raw)
    return len(z.compress(one)) / max(1, len(one)), len(one)


def _quality_udf(bands: Bands):
    @F.arrow_udf(FIELDS)
    def quality(texts: pa.Array) -> pa.Array:
        n = len(texts)
        n_words, n_repeat = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d, h, at in word_hashes(texts):
            n_words[d:d + len(at) - 1] = np.diff(at)
            n_repeat[d:d + len(at) - 1] = _repeated(h, at)
        z = zstandard.ZstdCompressor(level=bands.level)
        chars, symbols, rows = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        for i, raw in enumerate(x.as_py() for x in texts.cast(pa.large_string()).cast(pa.large_binary())):
            raw = raw or b""
            symbols[i] = len(raw) - len(raw.translate(None, _SYMBOLS))
            chars[i] = len(b"".join(raw.split()).decode()) if n_words[i] else 0
            rows.append(_judge(raw, int(n_words[i]), int(n_repeat[i]), bands, z))
        dup, failed, ratio, chunks, bad, band, kept = zip(*rows) if rows else [[]] * 7
        return pa.StructArray.from_arrays(
            [pa.array(n_words), pa.array(chars), pa.array(symbols), pa.array(dup, pa.int64()), pa.array(n_repeat),
             pa.array(failed, pa.bool_()), pa.array(ratio, pa.float64()), pa.array(chunks, pa.int32()),
             pa.array(bad, pa.int32()), pa.array(band, pa.string()), pa.array(kept, pa.bool_())],
            names=[f.split()[0] for f in FIELDS.split(", ")])

    return quality.asNondeterministic()  # evaluate once, also under a filter on its result


def with_quality(docs: DataFrame, text: str = "text", out: str = "quality", bands: Bands = Bands()) -> DataFrame:
    """``docs`` with a struct column ``out`` of FIELDS."""
    return docs.withColumn(out, _quality_udf(bands)(F.col(text)))


def keep_quality(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the bands, columns unchanged."""
    out = "_quality"
    while out in docs.columns:
        out += "_"
    return with_quality(docs, text, out, bands).filter(F.col(out)["kept"]).drop(out)
