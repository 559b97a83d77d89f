"""Best-fit packing planned on the length histogram.

1. Documents are tokenised and cut into pieces of at most ``capacity`` ids in
   one Arrow function per batch; pieces keep a length and a checksum only.
2. ``plan`` runs best-fit decreasing over the counts of each length (at most
   ``capacity`` numbers, whatever the corpus size).  A run of equal sequences is
   one class with a count, so the plan's size is bounded by the number of
   lengths, not by the number of documents.
3. Pieces get a rank within their length and take the planned slot that covers
   the rank.  Ranks come from per-(length, block) counts and a row number inside
   a block, so a length that holds a third of all pieces is spread over blocks.

Edge cases: a null or empty text is the single closing id; repeated rows are
packed one by one; a very long text is cut, only there; an empty table packs
into nothing; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import materialise

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: pieces per numbering block
BLOCK_ROWS = 50_000
#: words remembered by one Python worker, twice (about 200 bytes each)
CACHE_WORDS = 500_000
GROUP_BYTES = 2 << 20
#: words whose ids are put in place at a time
BLOCK_WORDS = 1 << 20
PIECES = "array<struct<piece:int,start:bigint,length:int,crc:bigint>>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_word(word: bytes) -> tuple[bytes, ...]:
    """The pre-tokens of one word (see ``fold``): full stops and commas after
    plain letters stand alone, as the tokenizer splits there.  Letters up to
    U+024F are letters in every Unicode version, so the split is its own."""
    core = word.rstrip(b".,")
    if len(core) < len(word) and core and plain(core):
        return core, word[len(core):]
    return (word,)


def fold(raw: bytes) -> list[bytes]:
    """The words of a text, ASCII case folded except in words with "<|": there the
    tokenizer looks for its added tokens before it folds case itself."""
    if b"<|" not in raw:
        return raw.lower().split()
    return [w if b"<|" in w else w.lower() for w in raw.split()]


def plain(core: bytes) -> bool:
    """Only letters up to U+024F whose lower case is one letter: one pre-token."""
    if core.isascii():
        return core.isalpha()
    s = core.decode()
    return s.isalpha() and max(s) <= "\u024f" and "\u0130" not in s


#: ``plain``, as a pattern
PLAIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"
#: what a tokenizer does to a text before its merges, where a word of letters can skip it
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_LETTERS = "|[\\p{L}]+|"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: the characters by which a byte-level model writes bytes that do not print; the space parts words here
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: chr(0x100 + n) for n, b in enumerate(sorted(set(range(256)) - _PRINTED)) if b != 0x20}


def _letters_alone(tokenizer: dict) -> bool:
    """Whether a word of letters is lower-cased and written in byte characters, and
    nothing else is done to it, before the merges of a tokenizer."""
    normal, split = tokenizer.get("normalizer") or {}, tokenizer.get("pre_tokenizer") or {}
    if normal.get("normalizers") != _NORMALIZER or len(split.get("pretokenizers", [])) != 2:
        return False
    first, second = split["pretokenizers"]
    pattern = first.get("pattern", {}).get("Regex", "")
    return first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" \
        and _LETTERS in pattern and all(x.startswith("'") for x in pattern.split(_LETTERS)[0].split("|")) and second == _BYTE_LEVEL


class WordIds:
    """Token ids (little-endian unsigned 32-bit) of white-space separated words.

    Exact for tokenizers that drop white space before their merges: no token
    then spans two words.  ASCII case is folded first, as such a tokenizer folds
    case itself.  A group's distinct words are numbered by Arrow and looked up once;
    numpy sets their ids in place.  Words not met before are encoded together: plain
    ones as a list of words that only the library's merges still see (as one text
    where the tokenizer does more to them), cut again at the tokens that end a word;
    the others one by one.  When the memory is full it becomes the older one, from
    which words in use return.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        size = max(model["vocab"].values()) + 1
        self.ends = self.merges = None
        if suffix:
            self.ends = np.zeros(max(size, self.tok.get_vocab_size()), dtype=bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
            if _letters_alone(spec):
                self.merges = Tokenizer.from_str(json.dumps(
                    spec | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each of a group of texts (large strings, none null)."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        found = pc.ascii_split_whitespace(texts)
        words, at = found.flatten(), np.asarray(found.offsets).astype(np.int64)
        special = pc.match_substring(words, "<|")
        folded = pc.ascii_lower(words)
        words = (pc.if_else(special, words, folded) if pc.any(special).as_py() else folded).dictionary_encode()
        word = np.asarray(words.indices)
        # full stops and commas after a plain word are a token of their own, often none
        core = pc.utf8_rtrim(words.dictionary, ".,")
        easy = pc.match_substring_regex(core, PLAIN)
        head = pc.if_else(easy, core, words.dictionary).dictionary_encode()
        tail = pc.if_else(easy, pc.replace_substring_regex(words.dictionary, "^[^.,]+", ""), "").dictionary_encode()
        heads, tails = self._ids(head.dictionary), self._ids(tail.dictionary)
        ids = [heads[h] + tails[t] for h, t in zip(np.asarray(head.indices).tolist(), np.asarray(tail.indices).tolist())]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size
        end = np.concatenate(([0], np.cumsum(size[word])))
        placed = np.empty(end[-1], dtype="<u4")
        for lo in range(0, len(word), BLOCK_WORDS):
            part, ends = word[lo:lo + BLOCK_WORDS], end[lo:lo + BLOCK_WORDS + 1]
            placed[ends[0]:ends[-1]] = flat[np.repeat(first[part] - ends[:-1], size[part]) + np.arange(ends[0], ends[-1])]
        cuts = end[at - at[0]].tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            yield placed[lo:hi].tobytes()

    def _ids(self, tokens: pa.Array) -> list[bytes]:
        """Ids of each of several distinct tokens."""
        found, known, older = _bytes(tokens), self.known, self.older
        if older:
            again = [t for t in found if t not in known and t in older]
            known.update(zip(again, map(older.__getitem__, again)))
        new = tokens.filter(pa.array([t not in known for t in found], pa.bool_()))
        easy = pc.match_substring_regex(new, PLAIN)
        self._learn(_bytes(new.filter(easy)), _bytes(new.filter(pc.invert(easy))))
        return list(map(known.__getitem__, found))

    def _learn(self, easy: list[bytes], hard: list[bytes]) -> None:
        known = self.known
        if self.ends is None:
            easy, hard = [], easy + hard
        easy.sort(key=bytes.isascii)  # the few others are spelled in byte characters first
        for i in range(0, len(easy), 1024):
            part = easy[i:i + 1024]
            ids = np.array(self._plain_ids(b" ".join(part)), dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("the tokenizer does not end every word with an end-of-word token")
            raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
            known.update(zip(part, [raw[lo:hi] for lo, hi in zip(at, at[1:])]))
        for i in range(0, len(hard), 1024):
            part = hard[i:i + 1024]
            for t, e in zip(part, self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                known[t] = np.array(e.ids, dtype="<u4").tobytes()

    def _plain_ids(self, words: bytes) -> list[int]:
        """Ids of plain words with a space between them."""
        if self.merges is None:
            return self.tok.encode_batch_fast([words.decode()], add_special_tokens=False)[0].ids
        text = words.decode()
        if not text.isascii():
            text = text.lower().encode().decode("latin-1").translate(_BYTE_CHARS)
        return self.merges.encode_batch_fast([text.split(" ")], is_pretokenized=True, add_special_tokens=False)[0].ids


def _bytes(tokens: pa.Array) -> list[bytes]:
    return tokens.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


_WORDS: dict[str, WordIds] = {}  # one per Python worker and tokenizer


def text_ids(path: str, texts: pa.Array) -> Iterator[bytes]:
    """Ids of each text (null: none); texts are read in groups of about GROUP_BYTES."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    texts = texts.cast(pa.large_string()).fill_null("")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + GROUP_BYTES, side="right")))
        yield from _WORDS[path].of(texts.slice(lo, hi - lo))
        lo = hi


def _pieces_udf(path: str | None, capacity: int, closing: int):
    @F.arrow_udf(PIECES)
    def pieces(texts: pa.Array) -> pa.Array:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        where = path or tokenizer_path()
        end = np.uint32(closing).astype("<u4").tobytes()
        at, no, start, length, crc = [0], [], [], [], []
        for body in text_ids(where, texts):
            ids = body + end
            view, n = memoryview(ids), len(ids) // 4
            for i, s in enumerate(range(0, n, capacity)):
                e = min(s + capacity, n)
                no.append(i)
                start.append(s)
                length.append(e - s)
                crc.append(zlib.crc32(view[4 * s:4 * e]))
            at.append(len(no))
        items = pa.StructArray.from_arrays(
            [pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
            names=["piece", "start", "length", "crc"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)

    return pieces.asNondeterministic()


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 path: str | None = None, closing: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, crc): the ids of every document, then
    ``closing``, cut into ``capacity`` ids where longer.  ``path`` None: found by
    each worker."""
    udf = _pieces_udf(path, capacity, closing)
    return docs.select(F.col(doc_id).alias("doc_id"), udf(F.col(text)).alias("p")) \
        .select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.*")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, how many, first
    sequence, offset) runs.  ``open_``: by free room the runs [first, count) of
    open sequences.  Lengths of at least 1 and at most ``capacity``."""
    open_: dict[int, list[list[int]]] = {}
    out, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:  # new sequences, each filled with as many of this length as fit
                each = capacity // length
                full = max(1, left // each) if left >= each else 1
                here = min(each, left)
                for k in range(here):
                    out.append((length, rank + k * full, full, sequences, k * length))
                rank, left = rank + here * full, left - here * full
                open_.setdefault(capacity - here * length, []).append([sequences, full])
                sequences += full
                continue
            run = open_[room].pop()
            n = min(left, run[1])
            out.append((length, rank, n, run[0], capacity - room))
            if n < run[1]:
                open_[room].append([run[0] + n, run[1] - n])
            elif not open_[room]:
                del open_[room]
            if room > length:
                open_.setdefault(room - length, []).append([run[0], n])
            rank, left = rank + n, left - n
        open_.pop(0, None)
    return out


def rank_within(pieces: DataFrame, n_rows: int, by: str = "length", order: Iterable[str] = ("doc_id", "piece"),
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``pieces`` with ``rank`` from 0 within ``by``: rows before this block plus
    the place inside the block.  A block is a hash of the row's key, so none holds
    much more than ``block_rows`` rows of a length."""
    blocks = max(1, -(-n_rows // block_rows))
    keyed = pieces.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = keyed.groupBy(by, "_block").agg(F.count("*").alias("_n"))
    before = sizes.select(by, "_block", (F.sum("_n").over(
        Window.partitionBy(by).orderBy("_block")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(by, "_block").orderBy(*order)) - 1
    return keyed.withColumn("_place", place).join(before, [by, "_block"]) \
        .withColumn("rank", F.col("_before") + F.col("_place")).drop("_block", "_place", "_before")


def pack(pieces: DataFrame, capacity: int = CAPACITY,
         planner: Callable[[dict[int, int], int], list] = plan) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    pieces = materialise(pieces)  # tokenised once; the histogram and the slots read it
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = planner(counts, capacity)
    # bounded by the number of lengths (capacity), not by the corpus: safe to send
    plan_rows = spark.createDataFrame(slots, "length int, _first bigint, _n bigint, _seq bigint, offset bigint")
    ranked = rank_within(pieces, sum(counts.values()))
    return ranked.join(F.broadcast(plan_rows), "length") \
        .where((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_n"))) \
        .withColumn("sequence_id", F.col("_seq") + F.col("rank") - F.col("_first")) \
        .drop("rank", "_first", "_n", "_seq")


def best_fit_pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                  path: str | None = None, closing: int = 0) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece."""
    return pack(token_pieces(docs, doc_id, text, capacity, path, closing), capacity)
