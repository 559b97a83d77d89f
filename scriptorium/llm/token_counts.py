"""Token counts by pre-token frequencies.

A subword tokenizer that drops white space never joins two words, so a text's
token count is the sum over its pre-tokens of the pieces of each.

1. The distinct pre-tokens of the corpus are gathered (each task sends its own
   distinct ones) and the library counts the pieces of each exactly once.
2. Every document's pre-token frequencies meet those counts and are summed.  The
   most frequent pre-tokens (at most ``head``, a proven size bound; the threshold
   comes from a histogram of frequencies) travel to the tasks; all others are joined on the pre-token, one row per
   document and pre-token, and summed per document.  No id is ever made.

A pre-token is a word with ASCII case folded, except where it may hold a special
string ("<|"), which is matched as it is written; full stops and commas after a word
of plain letters are a pre-token of their own, as the tokenizer splits there.

Edge cases: null text counts as empty with 0 tokens; repeated rows and repeated
or null ids are counted one by one (a row number keys the sums); long texts are
counted word by word; ties in frequency stay together in or out of the head; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.bestfit_packing import fold, split_word, tokenizer_path
from scriptorium.llm.common import materialise

HEAD = 1 << 17
#: frequency classes for each factor of e
STEPS = 64
#: distinct pre-tokens held by one task before it sends them on
FLUSH = 200_000
_BATCH = 4096


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
        seen.clear()
        return out

    for batch in batches:
        for x in batch.column(0).cast(pa.large_string()).cast(pa.large_binary()):
            for word, n in Counter(fold(x.as_py() or b"")).items():
                for t in split_word(word):
                    seen[t] += n
            if len(seen) > FLUSH:
                yield flush()
    if seen:
        yield flush()


def _count_pieces(path: str | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path or tokenizer_path())
        for batch in batches:
            for i in range(0, batch.num_rows, _BATCH):
                part = batch.slice(i, _BATCH)
                words = [w.decode() for w in part.column(0).to_pylist()]
                pieces = [len(e.ids) for e in tok.encode_batch_fast(words, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pieces, pa.int32())], names=["token", "n", "pieces"])

    return count


def vocabulary(texts: DataFrame, path: str | None = None) -> DataFrame:
    """(token, n, pieces): distinct pre-tokens of the single column of
    ``texts``, how often each occurs and how many pieces the library gives."""
    found = texts.mapInArrow(_distinct, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return found.mapInArrow(_count_pieces(path), "token binary, n bigint, pieces int")


class _Known(dict):
    """Pieces of a word's head pre-tokens, or -1 when one is not in the head."""

    def __init__(self, head: dict[bytes, int]):
        super().__init__()
        self.head = head

    def __missing__(self, word: bytes) -> int:
        n = 0
        for t in split_word(word):
            p = self.head.get(t)
            if p is None:
                n = -1
                break
            n += p
        if len(self) > FLUSH:
            self.clear()
        self[word] = n
        return n


def _frequencies(head_var):
    known: dict[int, _Known] = {}  # made on a worker: the closure is sent without it

    @F.arrow_udf("struct<bytes:bigint,head:bigint,tail:array<struct<token:binary,n:bigint>>>")
    def frequencies(texts: pa.Array) -> pa.Array:
        get = known.setdefault(0, None) or _Known(head_var.value)
        known[0] = get
        size, total, at, tokens, counts = [], [], [0], [], []
        for x in texts.cast(pa.large_string()).cast(pa.large_binary()):
            raw = x.as_py() or b""
            words = fold(raw)
            pieces = np.fromiter(map(get.__getitem__, words), np.int64, len(words))
            rare = np.flatnonzero(pieces < 0)
            rest = int(pieces.sum()) + len(rare)
            if len(rare):
                tail = Counter(t for i in rare.tolist() for t in split_word(words[i]))
                for t, n in tail.items():
                    p = get.head.get(t)
                    if p is None:
                        tokens.append(t)
                        counts.append(n)
                    else:
                        rest += p * n
            size.append(len(raw))
            total.append(rest)
            at.append(len(tokens))
        items = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(counts, pa.int64())], names=["token", "n"])
        return pa.StructArray.from_arrays(
            [pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)],
            names=["bytes", "head", "tail"])

    return frequencies.asNondeterministic()


def most_frequent(vocab: DataFrame, head: int) -> DataFrame:
    """The pre-tokens from the smallest frequency class on that leaves at most ``head``
    of them.  Classes are steps of log n, so their histogram is small whatever the corpus;
    no rows are sorted or sent to one task."""
    step = F.floor(F.log("n") * STEPS)
    seen, least = 0, None
    for r in sorted(vocab.groupBy(step.alias("b")).agg(F.count("*").alias("c")).collect(), reverse=True):
        seen += r["c"]
        if seen > head:
            break
        least = r["b"]
    return vocab.where(F.lit(False) if least is None else step >= least)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
                 head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row of ``docs``."""
    spark = docs.sparkSession
    vocab = materialise(vocabulary(docs.select(text), path))
    top = most_frequent(vocab, head).select("token", "pieces").toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                       _frequencies(shared)(F.col(text)).alias("f"))
    # a document's head sum travels as one more row whose key no vocabulary row has
    own = F.struct(F.concat(F.lit(b" "), F.col("row").cast("string").cast("binary")).alias("token"), F.col("f.head").alias("n"))
    flat = rows.select("row", "doc_id", F.col("f.bytes").alias("n_bytes"), F.explode(F.concat(F.array(own), "f.tail")).alias("t")) \
        .select("row", "doc_id", "n_bytes", "t.token", "t.n")
    counted = flat.join(vocab.select("token", "pieces"), "token", "left")
    return counted.groupBy("row", "doc_id", "n_bytes") \
        .agg(F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")).drop("row")
