"""License texts and notices by MinHash bands over overlapping text windows, in
DataFrame functions only.

A text's words (letters and digits, lower case) give ``SHINGLE``-word shingles.  The
templates are full license texts, standard headers and one-line notices; they come
from files or from the caller.  Two kinds of windows serve two kinds of templates:

* *wide* windows, 32 shingles at every 16th place of a text, for templates of 24 or more
  shingles, whose windows stand at every 4th place.  Any 17 shingles in a row lie in
  one window of the text.  With containment 0.8 spread over a template of 24 shingles a
  window pair is 0.4 similar at least, and one of 16 one-row bands meets with
  probability 1 - 0.6**16 = 0.9997; longer templates have several windows.
* *narrow* windows, 2 shingles at every 2nd place, for shorter ones.  A window that
  shares a shingle with a template window is retrieved by one of 14 bands with
  probability 1 - 0.5**14 = 0.9999.

A band's value names the shingle that is smallest under its seed, so a text without any
such shingle cannot be retrieved; that test, on each row alone, comes first and leaves
few texts.  Retrieved pairs are verified exactly: the template's distinct shingles
found in the whole text, as a share of all, must reach ``share``.  A notice of fewer
than 100 shingles that has a word with a digit (a version) must match a shingle with each such
word, so "version 2" is never taken for "version 3".

Templates are a parameter; the number of their band values is checked against MAX_KEYS
before they become literals and broadcast tables.

Edge cases: null, empty and short texts have no shingle and no hit; long texts are
windows like any other; every row is judged on its own, so repeated rows give repeated
results and rows without an id results without one; equal shares of two templates of a
license give one result; extra columns are ignored; an empty table gives no rows; a
template of fewer than SHINGLE words is refused.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import bind, materialise, quoted

SHINGLE = 5
MAX_KEYS = 400_000
#: shingles from which a template gets wide windows, and up to which its versions must match
WIDE_FROM, VERSIONED = 24, 100
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")


@dataclass(frozen=True)
class Windows:
    span: int       # shingles
    step: int       # of a text's windows
    own_step: int   # of a template's windows
    bands: int


WIDE, NARROW = Windows(32, 16, 4, 16), Windows(2, 2, 1, 14)


def load_templates(folder: str = TEXTS) -> list[tuple[str, str]]:
    """(license, text) of a folder: ``<license>.txt`` holds a full text, ``notices.txt``
    shorter ones, each after a line "== <license>"."""
    found = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            text = f.read()
        if name == "notices.txt":
            parts = re.split(r"^== (.+)$", text, flags=re.MULTILINE)
            found += list(zip(parts[1::2], (p.strip() for p in parts[2::2])))
        elif name.endswith(".txt"):
            found.append((name.removesuffix(".txt"), text))
    return found


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingles(words: Column) -> Column:
    """Hashes of all SHINGLE-word runs; none for shorter texts."""
    def runs(w: Column) -> Column:
        n = F.size(w) - (SHINGLE - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))) \
            .otherwise(F.array().cast("array<bigint>"))

    return bind(words, runs)


def _smallest(h: Column, bands: int) -> Column:
    """Per band the shingle of ``h`` that is smallest under the band's seed."""
    def least(band: int) -> Column:
        return F.array_min(F.transform(h, lambda x: F.struct(F.xxhash64(x, F.lit(band)).alias("v"), x.alias("x"))))["x"]

    return F.array(*map(least, range(bands)))


def _windows(h: str, span: int, step: int) -> Column:
    """Windows of a shingle array; the last ones may be shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(h) - (span - step), F.lit(1)), F.lit(step))
    return F.when(F.size(h) > 0, F.transform(starts, lambda at: F.slice(h, at, span))).otherwise(F.array().cast("array<array<bigint>>"))


def _templates(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, license, th, t, need): shingles, their distinct number, and per word
    with a digit of a short template the shingles that hold it."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, license string, text string").withColumn("w", _words(F.col("text")))
    t = t.withColumn("th", _shingles(F.col("w"))).withColumn("t", F.size(F.array_distinct("th")))
    if t.where("t = 0").count():
        raise ValueError(f"a template needs at least {SHINGLE} words")
    digits = F.array_distinct(F.filter("w", lambda x: x.rlike("[0-9]")))
    with_word = lambda d: F.array_distinct(F.filter(F.transform("th", lambda h, i: F.when(F.array_contains(F.slice("w", i + 1, SHINGLE), d), h)), lambda h: h.isNotNull()))
    return t.withColumn("need", F.when(F.col("t") < VERSIONED, F.transform(digits, with_word)).otherwise(F.array().cast("array<array<bigint>>"))) \
        .select("template", "license", "th", "t", "need")


def _keys(known: DataFrame, kind: Windows) -> DataFrame:
    """(band, value, template): values of all windows of the templates."""
    return known.select("template", F.explode(_windows("th", kind.span, kind.own_step)).alias("win")) \
        .select("template", F.posexplode(_smallest(F.col("win"), kind.bands)).alias("band", "value")).distinct()


def _holds(hashes: str, values: list[int]) -> Column:
    """Whether an array holds one of the values (a set, looked up per element)."""
    return F.expr(f"exists({hashes}, x -> x IN ({', '.join(f'{v}L' for v in values)}))") if values else F.lit(False)


def _retrieved(texts: DataFrame, keys: DataFrame, values: list[int], kind: Windows) -> DataFrame:
    """(row, template) pairs that share a band value in a window."""
    wins = texts.select("row", F.explode(_windows("h", kind.span, kind.step)).alias("win")).where(_holds("win", values))
    return wins.select("row", F.posexplode(_smallest(F.col("win"), kind.bands)).alias("band", "value")).join(F.broadcast(keys), ["band", "value"]) \
        .select("row", "template").distinct()


def license_hits(docs: DataFrame, templates: Sequence[tuple[str, str]] | None = None, doc_id: str = "doc_id", text: str = "text",
                 share: float = 0.8) -> DataFrame:
    """(doc_id, license, containment, n_matched, first_word) per row and license found:
    the largest verified containment, the shingles of that template found, and the word
    (from 0) at which the first of them begins."""
    spark = docs.sparkSession
    known = materialise(_templates(spark, load_templates() if templates is None else templates))
    kinds = []
    for kind, fits in ((WIDE, F.col("t") >= WIDE_FROM), (NARROW, F.col("t") < WIDE_FROM)):
        rows = [tuple(r) for r in _keys(known.where(fits), kind).select("band", "value", "template").limit(MAX_KEYS + 1).collect()]  # of templates, checked next
        if len(rows) > MAX_KEYS:
            raise ValueError("too many templates for one plan")
        if rows:
            kinds.append((kind, spark.createDataFrame(rows, "band int, value bigint, template int"), sorted({v for _, v, _ in rows})))
    every = sorted({v for _, _, values in kinds for v in values})
    # a text without any of the band values cannot be retrieved
    texts = docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).alias("doc_id"), _shingles(_words(quoted(text))).alias("h")) \
        .where(_holds("h", every))
    texts = materialise(texts)
    pairs = None
    for kind, keys, values in kinds:
        part = _retrieved(texts, keys, values, kind)
        pairs = part if pairs is None else pairs.unionByName(part)
    own = known.select("template", "license", "t", "need", F.explode(F.array_distinct("th")).alias("x"))
    wanted = texts.join(pairs.groupBy("row").agg(F.collect_set("template").alias("templates")), "row")  # at most one entry per template
    places = wanted.select("row", "doc_id", "templates", F.posexplode("h").alias("pos", "x")).join(F.broadcast(own), "x") \
        .where(F.array_contains("templates", F.col("template")))
    found = places.groupBy("row", "doc_id", "template", "license", "t", "need").agg(F.collect_set("x").alias("xs"), F.min("pos").cast("bigint").alias("first_word")) \
        .withColumn("n", F.size("xs")).withColumn("containment", F.col("n") / F.col("t")) \
        .where((F.col("containment") >= share) & F.forall("need", lambda xs: F.arrays_overlap(xs, "xs")))
    best = found.groupBy("row", "doc_id", "license").agg(F.max(F.struct("containment", "n", (-F.col("first_word")).alias("first"))).alias("best"))
    return best.select("doc_id", "license", "best.containment", F.col("best.n").cast("bigint").alias("n_matched"), (-F.col("best.first")).alias("first_word"))
