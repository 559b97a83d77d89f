"""RAKE keyphrases (K1 per document, K2 per batch of documents).

Phrases are runs of words between delimiters (stop words, punctuation runs,
line breaks).  Word score = degree / frequency, where frequency counts the
word's occurrences and degree adds the length of the phrase for each of
them; a phrase scores the sum of its word scores.  Phrases are ranked by
(score, phrase) both descending, repeated phrases kept.

Plan: phrases are built row-locally (array expressions, no shuffle); all
statistics derive from the table of *distinct* phrases per group with their
occurrence counts, which is a partial (map-side) aggregate, so a hot group
is collapsed before any exchange.  The top-n keeps the n best distinct
phrases per group through a partial window limit, then expands repeats.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import TOKEN_RE, ordered_concat
from scriptorium.session import checkpoint_dir, spread

# The English stop-word list used by default (the common
# 179-word list of the NLTK corpus, in its usual order).
ENGLISH_STOP_WORDS: tuple[str, ...] = tuple("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split())

DEFAULT_TOP_N = 100
QUESTION_TOP_N = 150
WORD_FULL_RE = r"^[\p{L}\p{N}_]+$"
SCORE_DECIMALS = 9  # scores are rounded before ranking so both engines tie alike


def phrases(text: str | F.Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS):
    """Array of candidate phrases (words joined by one space) of a text column."""
    c = F.col(text) if isinstance(text, str) else text
    toks = F.regexp_extract_all(F.lower(c), F.lit(TOKEN_RE), 0)
    stops = list(stop_words)
    marked = F.transform(toks, lambda t: F.when(t.isin(stops) | ~t.rlike(WORD_FULL_RE), F.lit("|")).otherwise(t))
    pieces = F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda p: F.trim(p))
    return F.filter(pieces, lambda p: p != "")


def phrase_counts(df: DataFrame, group: Sequence[str], text: str,
                  stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """(group..., phrase, cnt): distinct phrases with their occurrence counts."""
    return (df.select(*group, F.explode(phrases(text, stop_words)).alias("phrase"))
            .groupBy(*group, "phrase").agg(F.count("*").alias("cnt")))


def scored_phrases(counts: DataFrame, group: Sequence[str], colocated: bool = False) -> DataFrame:
    """(group..., phrase, cnt, score) from the distinct-phrase table.

    ``colocated=True`` (``counts`` already partitioned by ``group``, e.g. one
    document): word statistics are window aggregates over (group, word), so
    the phrase table is computed once and no exchange is added.  Otherwise
    (batch groups that can be hot) the word statistics are a partial
    aggregate joined back on (group, word), where adaptive skew handling can
    split a hot word; the phrases are written once to the shared folder and
    only their numbers move with their words.
    """
    group = list(group)
    key = ["phrase"]
    if not colocated:
        # written once and numbered, so that a phrase's words move with its number
        at = os.path.join(checkpoint_dir(counts.sparkSession), f"phrases-{uuid.uuid4().hex}")
        counts.withColumn("_id", F.monotonically_increasing_id()).write.parquet(at)
        counts, key = counts.sparkSession.read.parquet(at), ["_id"]
    pw = counts.select(*group, *key, "cnt", F.split("phrase", " ").alias("_w")) \
        .select(*group, *key, "cnt", F.size("_w").alias("_len"), F.explode("_w").alias("word"))
    if colocated:
        w = Window.partitionBy(*group, "word")
        scored = pw.withColumn("word_score", F.sum(F.col("cnt") * F.col("_len")).over(w) / F.sum("cnt").over(w))
        scores = scored.groupBy(*group, "phrase").agg(F.first("cnt").alias("cnt"), F.sum("word_score").alias("score"))
    else:
        ws = pw.groupBy(*group, "word").agg(
            (F.sum(F.col("cnt") * F.col("_len")) / F.sum("cnt")).alias("word_score"))
        sums = pw.select(*group, "_id", "word").join(ws, [*group, "word"]).groupBy("_id").agg(F.sum("word_score").alias("score"))
        scores = counts.join(sums, "_id").select(*group, "phrase", "cnt", "score")
    return scores.withColumn("score", F.round("score", SCORE_DECIMALS))


def top_phrases(scored: DataFrame, group: Sequence[str], top_n: int = DEFAULT_TOP_N) -> DataFrame:
    """The top-n phrase occurrences per group: (group..., rank, phrase, score)."""
    group = list(group)
    order = [F.col("score").desc(), F.col("phrase").desc()]
    w = Window.partitionBy(*group).orderBy(*order)
    best = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_n)
    before = F.coalesce(F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = best.withColumn("_before", before).filter(F.col("_before") < top_n)
    copies = F.least(F.col("cnt"), F.lit(top_n) - F.col("_before"))
    out = best.select(*group, "phrase", "score", "_before",
                      F.posexplode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_k", "_one"))
    return out.select(*group, (F.col("_before") + F.col("_k") + 1).cast("bigint").alias("rank"), "phrase", "score")


def extract_keywords(df: DataFrame, group: Sequence[str], text: str, top_n: int = DEFAULT_TOP_N,
                     stop_words: Sequence[str] = ENGLISH_STOP_WORDS, colocate: bool = False) -> DataFrame:
    """Keyword string per group: the top-n ranked phrases joined by a space.

    ``colocate=True`` hash-partitions the input once by ``group`` (use it when
    the group is the row key, e.g. one document): every later aggregate,
    join and window is keyed by a superset and reuses that partitioning; the texts
    are not put together again, as a task sorts many times their size.
    Leave it off for batch groups that can be hot.
    """
    group = list(group)
    src = df.select(*group, text)
    if colocate:
        src = spread(src, *group)
    top = top_phrases(scored_phrases(phrase_counts(src, group, text, stop_words), group, colocated=colocate),
                      group, top_n)
    kw = top.groupBy(*group).agg(ordered_concat("phrase", "rank", " ").alias("keywords"))
    return src.select(*group).distinct().join(kw, group, "left") \
        .withColumn("keywords", F.coalesce("keywords", F.lit("")))
