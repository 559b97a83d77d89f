"""SentencePiece encoding and decoding by vectorised merge rounds.

Encoding follows a SentencePiece BPE model exactly.  A text becomes symbols (blanks
as U+2581, one in front) and is cut where no piece of the model spans the cut, so
each part, a *word* here, is merged on its own.  The words a worker has not met yet
are merged together:

1. Their symbols stand in one flat numpy array, with the rank of every adjacent pair.
2. A round takes the smallest rank of each word (a segmented minimum), merges all its
   leftmost occurrences that do not overlap, and closes the gaps.  Only pairs beside a
   merge are looked up again.  Words without a mergeable pair leave the array.
3. Rounds end when no pair remains.  Symbols outside the vocabulary become bytes.

Merging all occurrences at once equals merging them one by one unless a merged piece
can form a pair of better or equal rank; such ranks (``solo``) merge only their
leftmost occurrence in a round.  A word of more than ``LONG`` symbols keeps its pairs
by rank and touches, in each round, the pairs of the smallest rank only; so its cost
does not grow with rounds times length.

Decoding gathers the bytes of all pieces of a batch in one flat array.

Both are row-local: no shuffle, nothing sent to the driver; a worker loads the model
from a path.  Edge cases: null and empty texts have no ids; a null id array decodes to
null; ids that the model lacks, and null ids, decode as the unknown piece; byte pieces
that are no UTF-8 decode to U+FFFD for each byte, control pieces to nothing; very long
texts are encoded whole; repeated rows and ties are rows like others; all columns pass
unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import fresh

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: symbols from which a word's pairs are kept by rank
LONG = 512
#: words remembered by one Python worker, twice
CACHE_WORDS = 100_000
#: characters of text encoded, and ids decoded, at a time
GROUP_CHARS, GROUP_IDS = 1 << 18, 1 << 18
NONE = np.iinfo(np.int32).max
#: texts that a normaliser other than plain blank escaping changes
PROBES = ("ﬁn Ａ  x ", " a", "é　 b", "\t​\r\n", "")

codecs.register_error("scriptorium.each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def escape(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def alternate(linked: np.ndarray) -> np.ndarray:
    """Which candidates merge, left to right: ``linked[i]`` tells that candidate i
    overlaps the one before it, so every second one of a run of them is taken."""
    at = np.arange(len(linked))
    run = np.maximum.accumulate(np.where(linked, 0, at))
    return (at - run) % 2 == 0


class Pieces:
    """What the pieces of a SentencePiece model decode to."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        self.size = len(ids)
        unknown = sp.decode([sp.unk_id()]).encode()
        pieces = [sp.id_to_piece(i) for i in ids]
        raw = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else unknown if sp.is_unknown(i)
               else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)] + [unknown]  # and of ids that the model lacks
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.concatenate(([0], np.cumsum(self.raw_len)[:-1]))
        self.control = np.array([sp.is_control(i) for i in ids] + [False])
        own = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in ids]
        self.blank = np.array([o and p.startswith(BLANK) for o, p in zip(own, pieces)] + [False])
        self.strip = sp.decode(sp.encode("a")) == "a"

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the id runs ``ids[at[i]:at[i + 1]]``."""
        ids = np.where((ids < 0) | (ids >= self.size), self.size, ids)
        n = self.raw_len[ids]
        to = np.concatenate(([0], np.cumsum(n)))
        data = self.raw[np.repeat(self.raw_at[ids] - to[:-1], n) + np.arange(to[-1])].tobytes()
        # the blank that encoding puts in front: of the first piece that is no control piece
        spoken = np.append(np.flatnonzero(~self.control[ids]), len(ids))
        head = spoken[np.searchsorted(spoken, at[:-1])]
        drop = head < at[1:]
        drop[drop] = self.blank[ids[head[drop]]] & self.strip
        lo = to[at[:-1]] + drop
        return [data[a:b].decode("utf-8", "scriptorium.each_byte") for a, b in zip(lo.tolist(), to[at[1:]].tolist())]


class Model:
    """Merge tables of one SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        self.size = len(ids)
        pieces = [sp.id_to_piece(i) for i in ids]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in ids]
        if any(sp.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        own = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.bytes = np.full(256, sp.unk_id(), np.int32)
        for i in ids:
            if sp.is_byte(i):
                self.bytes[int(pieces[i][1:-1], 16)] = i
        if (self.bytes == sp.unk_id()).any():
            raise ValueError("models without byte pieces are not supported")
        # ranks by falling score; equal scores share a rank
        score = np.array([sp.get_score(i) for i in ids])
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        self.solo = np.zeros(rank.max() + 1, dtype=bool)
        used, n = np.unique(rank[list(own.values())], return_counts=True)
        self.solo[used[n > 1]] = True
        pairs: dict[int, int] = {}
        spanned, within = set(), set()
        for p, i in own.items():
            for k in range(1, len(p)):
                spanned.add((ord(p[k - 1]) << 21) | ord(p[k]))
                a, b = own.get(p[:k]), own.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
                    for part in (a, b):
                        if rank[part] >= rank[i]:
                            self.solo[rank[part]] = True
            if len(p) > 1:
                within.update(p)
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = rank[self.made]
        self.pairs = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        self.spanned = np.array(sorted(spanned), np.int64)
        self.symbol = -np.arange(1, 0x110001, dtype=np.int32)  # -1 - code point where no piece is that character
        for p, i in own.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        # characters that no longer piece holds stand alone; a piece holds a blank in front only
        if any(BLANK in p.lstrip(BLANK) for p in own):
            cut = r".+"
        else:
            alone = "".join(c for c in "\n\t" if c not in within)
            cut = (f"[{alone}]|" if alone else "") + f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+"
        self.word = re.compile(cut, re.DOTALL)
        self.normalise = escape if all(sp.normalize(t) == escape(t) for t in PROBES) else sp.normalize
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # a model that needs more than this (user-defined symbols, other algorithms) fails here
        texts = [*own, "".join(own)]
        if [x.tolist() for x in self.encode(texts)] != sp.encode(texts, num_threads=1):
            raise ValueError(f"{path} is no plain BPE model")

    # ------------------------------------------------------------- merging

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of symbol pairs; NONE where no piece is made."""
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.made[at], -1)

    def merge(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, their first symbols) of all words; ``first`` holds the symbols that
        begin a word, the first one included."""
        ends = np.append(first[1:], len(sym))
        size = ends - first
        kept, where = [], []
        for lo, hi in zip(first[size > LONG].tolist(), ends[size > LONG].tolist()):
            pieces, at = self.merge_long(sym[lo:hi])
            kept.append(pieces)
            where.append(at + lo)
        short = np.repeat(size <= LONG, size)
        at = np.flatnonzero(short)
        sym = sym[at]
        size = size[size <= LONG]
        word = np.repeat(np.arange(len(size)), size)
        rank = np.full(len(sym), NONE, np.int32)
        made = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            going = np.repeat(least < NONE, size)
            if not going.all():
                kept.append(sym[~going])
                where.append(at[~going])
                sym, at, word, rank, made = (x[going] for x in (sym, at, word, rank, made))
                continue
            least = np.repeat(least, size)
            c = np.flatnonzero(rank == least)
            take = alternate(np.append(False, c[1:] == c[:-1] + 1))
            lone = self.solo[rank[c]]
            if lone.any():
                take = np.where(lone, np.append(True, word[c[1:]] != word[c[:-1]]), take)
            c = c[take]
            sym[c] = made[c]
            stay = np.ones(len(sym), dtype=bool)
            stay[c + 1] = False
            c -= np.arange(len(c))  # where the merged symbols stand once the gaps close
            sym, at, word, rank, made = (x[stay] for x in (sym, at, word, rank, made))
            touched = np.zeros(len(sym), dtype=bool)
            touched[c] = touched[c[c > 0] - 1] = True
            again = np.flatnonzero(touched)
            last = again == len(sym) - 1
            last[~last] = word[again[~last]] != word[again[~last] + 1]
            rank[again[last]], made[again[last]] = NONE, -1
            again = again[~last]
            rank[again], made[again] = self.pair(sym[again], sym[again + 1])
        if not kept:
            return sym, at
        sym, at = np.concatenate(kept), np.concatenate(where)
        order = np.argsort(at, kind="stable")
        return sym[order], at[order]

    def merge_long(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, their first symbols) of one long word: pairs wait by rank."""
        n = len(sym)
        sym, after, before = sym.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, made = np.full(n + 1, NONE, np.int32), np.full(n + 1, -1, np.int32)
        rank[:n - 1], made[:n - 1] = self.pair(sym[:-1], sym[1:])
        waiting: dict[int, list] = {}
        ranks: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            if not len(at):
                return
            r = rank[at]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                k = int(r[lo])
                if k not in waiting:
                    waiting[k] = []
                    heapq.heappush(ranks, k)
                if self.solo[k]:
                    for x in at[lo:hi].tolist():
                        heapq.heappush(waiting[k], x)
                else:
                    waiting[k].append(at[lo:hi])

        def one(c: int) -> None:
            """Merges the pair at ``c`` alone."""
            gone = int(after[c])
            sym[c], rank[gone], sym[gone] = made[c], NONE, NONE
            end = int(after[gone])
            after[c] = end
            if end < n:
                before[end] = c
            for x in (int(before[c]), c):
                if x < 0:
                    continue
                a, b = int(sym[x]), int(sym[after[x]]) if after[x] < n else -1
                rank[x], made[x] = self.pairs.get(a * self.size + b, (NONE, -1)) if a >= 0 and b >= 0 else (NONE, -1)
                k = int(rank[x])
                if k == NONE:
                    continue
                if k not in waiting:
                    waiting[k] = []
                    heapq.heappush(ranks, k)
                if self.solo[k]:
                    heapq.heappush(waiting[k], x)
                else:
                    waiting[k].append(np.array([x]))

        put(np.arange(n - 1))
        while ranks:
            k = ranks[0]
            if self.solo[k]:
                c = heapq.heappop(waiting[k])
                if not waiting[k]:
                    del waiting[k]
                    heapq.heappop(ranks)
                if rank[c] == k:
                    one(c)
                continue
            heapq.heappop(ranks)
            c = np.unique(np.concatenate(waiting.pop(k)))
            c = c[rank[c] == k]
            if not len(c):
                continue
            c = c[alternate(np.append(False, after[c[:-1]] == c[1:]))]
            gone = after[c]
            sym[c] = made[c]
            rank[gone] = NONE
            sym[gone] = NONE
            after[c] = after[gone]
            inner = after[c] < n
            before[after[c[inner]]] = c[inner]
            again = np.unique(np.concatenate((c, before[c][before[c] >= 0])))
            rank[again[after[again] >= n]] = NONE
            again = again[after[again] < n]
            rank[again], made[again] = self.pair(sym[again], sym[after[again]])
            put(again)
        at = np.flatnonzero(sym != NONE)
        return sym[at], at

    # ------------------------------------------------------------ encoding

    def learn(self, words: list[str]) -> None:
        """Adds the ids of new words to ``known``."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        size = np.array([len(w) for w in words])
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        pair = (code[:-1] << 21) | code[1:]
        at = np.minimum(np.searchsorted(self.spanned, pair), len(self.spanned) - 1)
        cut = np.append(True, self.spanned[at] != pair)  # no piece spans this place
        cut[begin] = True
        pieces, at = self.merge(self.symbol[code], np.flatnonzero(cut))
        # unknown characters as their UTF-8 bytes
        point = np.where(pieces < 0, -1 - pieces.astype(np.int64), 0)
        wide = np.where(pieces < 0, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
        if (pieces < 0).any():
            of = np.repeat(np.arange(len(pieces)), wide)
            left = np.repeat(np.cumsum(wide), wide) - 1 - np.arange(len(of))  # bytes that follow
            lead, n = left == wide[of] - 1, wide[of]
            bits = (point[of] >> (6 * left)) & 0x3F
            first = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n] | (point[of] >> (6 * (n - 1)))
            byte = np.where(n == 1, point[of], np.where(lead, first, 0x80 | bits))
            pieces = np.where(pieces[of] < 0, self.bytes[byte & 0xFF], pieces[of])
            at = at[of]
        raw = pieces.astype("<i4").tobytes()
        ends = (4 * np.append(np.searchsorted(at, begin[1:]), len(pieces))).tolist()
        lo = 0
        for w, hi in zip(words, ends):
            self.known[w] = raw[lo:hi]
            lo = hi

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, as the library gives them without begin or end."""
        group: list[list[str]] = []
        held = 0
        for t in texts:
            group.append(self.word.findall(self.normalise(t)))
            held += len(t)
            if held > GROUP_CHARS:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known = self.known
        new = set().union(*group).difference(known)
        again = [w for w in new if w in self.older]
        known.update((w, self.older[w]) for w in again)
        new.difference_update(again)
        if new:
            self.learn(list(new))
        for words in group:
            yield np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4")


_LOADED: dict[tuple[type, str], object] = {}  # one per Python worker, kind and path


def _load(kind: type, path: str | None):
    key = (kind, path or model_path())
    if key not in _LOADED:
        _LOADED[key] = kind(key[1])
    return _LOADED[key]


def model(path: str | None = None) -> Model:
    return _load(Model, path)


def pieces(path: str | None = None) -> Pieces:
    return _load(Pieces, path)


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    """Texts (null as empty) in lists of about GROUP_CHARS characters."""
    part, held = [], 0
    for x in texts.cast(pa.large_string()).cast(pa.large_binary()):
        part.append((x.as_py() or b"").decode("utf-8", "replace"))
        held += len(part[-1])
        if held > GROUP_CHARS:
            yield part
            part, held = [], 0
    yield part


def _encoded(texts: pa.Array, path: str | None, each=None) -> pa.Array:
    """Id lists of texts, written to one buffer; ``each`` gets the ids of every chunk
    and where its texts begin."""
    ids, at = bytearray(), [np.zeros(1, np.int64)]
    for part in _chunks(texts):
        found = list(model(path).encode(part))
        ends = np.cumsum([len(x) for x in found], dtype=np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        ids += flat.tobytes()
        at.append(at[-1][-1] + ends)
        if each is not None:
            each(flat, np.append(0, ends))
    offsets = np.concatenate(at).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(ids)]))


def encode_column(text: Column | str, path: str | None = None) -> Column:
    """Ids (array of int) of a text column."""

    @F.arrow_udf("array<int>")
    def sentencepiece_ids(texts: pa.Array) -> pa.Array:
        return _encoded(texts, path)

    return sentencepiece_ids.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def round_trip_column(text: Column | str, path: str | None = None) -> Column:
    """Struct of the ids of a text column and the text they decode to, in one pass."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def sentencepiece_round_trip(texts: pa.Array) -> pa.Array:
        out: list[str] = []
        ids = _encoded(texts, path, lambda flat, at: out.extend(pieces(path).decode(flat, at)))
        return pa.StructArray.from_arrays([ids, pa.array(out, pa.string())], names=["ids", "decoded"])

    return sentencepiece_round_trip.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def decode_column(ids: Column | str, path: str | None = None) -> Column:
    """Text of a column of id arrays."""

    @F.arrow_udf("string")
    def sentencepiece_text(runs: pa.Array) -> pa.Array:
        m, out = pieces(path), []
        at = np.concatenate(([0], np.cumsum(runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        flat = runs.flatten()
        flat = (flat.fill_null(-1) if flat.null_count else flat).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < len(runs):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + GROUP_IDS, side="right")) - 1)
            out += m.decode(flat[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
            lo = hi
        return pa.array(out, pa.string(), mask=runs.is_null().to_numpy(zero_copy_only=False))

    return sentencepiece_text.asNondeterministic()(F.col(ids) if isinstance(ids, str) else ids)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` of its texts."""
    return docs.withColumn(ids, encode_column(F.col(text), path))


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """``rows`` with the column ``text`` of its id arrays."""
    return rows.withColumn(text, decode_column(F.col(ids), path))


def round_trip(docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs`` with the ids of its texts and what they decode to."""
    (both,) = fresh(docs, "_both")
    out = docs.withColumn(both, round_trip_column(F.col(text), path))
    return out.withColumns({ids: F.col(both)["ids"], decoded: F.col(both)["decoded"]}).drop(both)
