"""Mixing sources to target word counts by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times on
average, a number between 0 and ``limit``.  The whole part is sure; the fraction
is rounded pairwise: two fractional documents exchange word mass at random until
one of them is taken or left whole, with odds that keep every expectation.  Mass
is counted in words, so a source's taken words stay at its target up to the one
document that is left over at the end.

Documents are rounded in blocks of bounded size; each block leaves at most one
fractional document, and these residuals meet in the next level of a reduction
tree of fan-in ``FAN``.  A source with a third of all rows just has more blocks.

Equal rows (same id, source and text) are one unit: of its rows a sure part is taken
once more and at most one row is fractional, so a unit weighs one row in its block
however often it is repeated.  Only where a part of a unit's rows is taken once more
are its rows numbered, in blocks, from a written table.

Random numbers are hashes of the documents met, so reruns agree (of equal rows, on how
many are taken how often).

Edge cases: null text has size 0; a null source is a source of its own, last in
the order of weights; null ids are ordinary; documents of size 0 take part with any
number of copies but no words; very long texts count whole; an empty table gives no
rows; extra columns pass unchanged, whatever their names, and columns that clash with
a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import fresh, materialise, mix64, quoted, word_count

BLOCK = 4096
FAN = 256
KEY = ["_k1", "_k2"]
#: equal rows numbered together
NUMBER_ROWS = 50_000
#: units of a counted table sent to the tasks (some 100 bytes each); more are joined
SENT_UNITS = 100_000


def targets(sizes: dict[str | None, int], weights: Sequence[int], share: Fraction, limit: int) -> dict[str | None, float]:
    """Words wanted of each source: ``share`` of all words by weight (repeating in
    code-point order, null last), at most ``limit`` times its own words, the excess
    going to the others by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left = share * sum(sizes.values())
    free, out = list(order), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * rate > limit * sizes[s]]
        if not full:
            return out | {s: weight[s] * rate for s in free}
        for s in full:
            out[s] = Fraction(limit * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def _uniform(a: int, b: int) -> float:
    x = np.array([(a * 0x9E3779B97F4A7C15 + b * 0xD1B54A32D192ED03) & ((1 << 64) - 1)], dtype=np.uint64)
    return int(mix64(mix64(x))[0]) / 2.0 ** 64


def _round_block(names: np.ndarray, sizes: np.ndarray, parts: np.ndarray, last: bool) -> np.ndarray:
    """Fractions of one block after pairwise rounding: 0 or 1, except for at most
    one residual (none if ``last``: it is drawn)."""
    p = parts.astype(float).copy()
    draws = mix64(names ^ np.uint64(0xA0761D6478BD642F)).astype(np.float64) / 2.0 ** 64
    empty = sizes == 0
    p[empty] = (draws[empty] < p[empty]).astype(float)
    keep = -1
    for i in np.flatnonzero((p > 0) & (p < 1)).tolist():
        if keep < 0:
            keep = i
            continue
        r = keep
        to_i = min((1 - p[i]) * sizes[i], p[r] * sizes[r])
        to_r = min(p[i] * sizes[i], (1 - p[r]) * sizes[r])
        if _uniform(int(names[i]), int(names[r])) * (to_i + to_r) < to_r:
            full_i, none_r = (1 - p[i]) * sizes[i] <= to_i, p[r] * sizes[r] <= to_i
            p[i], p[r] = (1.0 if full_i else p[i] + to_i / sizes[i]), (0.0 if none_r else p[r] - to_i / sizes[r])
        else:
            none_i, full_r = p[i] * sizes[i] <= to_r, (1 - p[r]) * sizes[r] <= to_r
            p[i], p[r] = (0.0 if none_i else p[i] - to_r / sizes[i]), (1.0 if full_r else p[r] + to_r / sizes[r])
        keep = next((x for x in (i, r) if 0 < p[x] < 1), -1)
    if last and keep >= 0:
        p[keep] = float(draws[keep] < p[keep])
    return p


def _rounder(last: bool):
    def run(batch: pa.Table) -> pa.Table:
        names = batch.column("_k1").to_numpy().view(np.uint64) ^ batch.column("_k2").to_numpy().astype(np.uint64)
        order = np.lexsort((batch.column("_k2").to_numpy(), batch.column("_k1").to_numpy()))
        batch, names = batch.take(order), names[order]
        p = _round_block(names, batch.column("size").to_numpy(), batch.column("part").to_numpy(), last)
        return batch.set_column(batch.column_names.index("part"), "part", pa.array(p))

    return run


def _key(doc_id: str, source: str, text: str):
    """The unit key: 96 bits of id, source and text."""
    given = [quoted(doc_id).cast("string"), quoted(source), quoted(text)]
    seen = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in given])
    return F.xxhash64(seen, *given), F.hash(*reversed(given), seen)


def plan_copies(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), limit: int = 2,
                doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(units, sources): per unit key its size, its rows (``many``), the copies that all
    of them get and the number of rows (``extra``) that get one more; per source its
    index, words and target."""
    spark = docs.sparkSession
    k1, k2 = _key(doc_id, source, text)
    keyed = docs.select(k1.alias("_k1"), k2.alias("_k2"), quoted(source).alias("source"), quoted(text).alias("_text")) \
        .select(*KEY, "source", word_count("_text").alias("size"))
    units = materialise(keyed.groupBy(*KEY).agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("many")))
    # one row per source
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("size"), F.count("*").alias("n")).collect()
    sizes = {r["source"]: r["size"] for r in totals}
    goal = targets(sizes, weights, share, limit)
    rows = []
    for i, r in enumerate(totals):
        rate = goal[r["source"]] / r["size"] if r["size"] else Fraction(0)
        rows.append((i, r["source"], r["size"], float(goal[r["source"]]), int(rate), float(rate - int(rate)), -(-r["n"] // BLOCK)))
    sources = spark.createDataFrame(rows, "_s int, source string, source_size bigint, target double, base int, rate double, blocks bigint")
    wanted = F.col("many") * F.col("rate")
    here = units.join(sources, units["source"].eqNullSafe(sources["source"])) \
        .select(*KEY, "_s", "size", "many", "base", F.floor(wanted).alias("sure"), (wanted - F.floor(wanted)).alias("part"), "blocks")
    done, width = [], max([r[6] for r in rows], default=1)
    schema = "_k1 bigint, _k2 int, _s int, size bigint, many bigint, base int, sure bigint, part double, blocks bigint, block bigint"
    here = here.withColumn("block", F.pmod(F.xxhash64(*KEY), F.col("blocks")))
    while True:
        level = materialise(here.groupBy("_s", "block").applyInArrow(_rounder(width <= 1), schema))
        done.append(level.where("part = 0 or part = 1"))
        if width <= 1:
            break
        width = -(-width // FAN)
        here = level.where("part > 0 and part < 1").withColumns({"block": F.floor(F.col("block") / FAN)})
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*KEY, "_s", "size", "many", "base", (F.col("sure") + F.col("part").cast("bigint")).alias("extra")), sources


def _taken(docs: DataFrame, units: DataFrame, names: dict[str, str], more: Sequence[str] = ()) -> tuple[DataFrame, str, list[str]]:
    """(rows of ``docs`` with the columns ``more`` of ``units`` and the copies, the name
    of the copies' column, those of ``more``)."""
    k1, k2 = _key(**names)
    n1, n2, copies, base, extra, many, row, block, place, before = fresh(docs, "_k1", "_k2", "_copies", "_base", "_extra", "_many", "_row", "_block", "_place", "_before")
    own = fresh(docs, *[f"_{c}" for c in more])
    known = units.select(F.col("_k1").alias(n1), F.col("_k2").alias(n2), F.col("base").alias(base), F.col("extra").alias(extra), F.col("many").alias(many),
                         *[F.col(c).alias(o) for c, o in zip(more, own)])
    rows = docs.withColumns({n1: k1, n2: k2})
    some = (F.col(extra) > 0) & (F.col(extra) < F.col(many))
    kept = [quoted(c) for c in (*docs.columns, copies, *own)]
    whole = rows.join(known.where(~some), [n1, n2]).withColumn(copies, F.col(base) + F.when(F.col(extra) > 0, 1).otherwise(0)).select(*kept)
    # units of which some rows are taken once more: their rows are numbered
    few = known.where(some)
    n_few = few.count()
    if not n_few:
        return whole, copies, own
    found = rows.join(F.broadcast(few) if n_few <= SENT_UNITS else few, [n1, n2])
    split = materialise(found.withColumn(row, F.monotonically_increasing_id())).withColumn(block, F.floor(F.col(row) / NUMBER_ROWS))
    sizes = split.groupBy(n1, n2, block).agg(F.count("*").alias(before))
    ahead = Window.partitionBy(n1, n2).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(ahead), F.lit(0)))
    inside = Window.partitionBy(n1, n2, block).orderBy(row)
    split = split.withColumn(place, F.row_number().over(inside)).join(sizes, [n1, n2, block]) \
        .withColumn(copies, F.col(base) + F.when(F.col(before) + F.col(place) <= F.col(extra), 1).otherwise(0))
    return whole.unionByName(split.select(*kept)), copies, own


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), limit: int = 2,
        doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with size, source_size, target and copies."""
    units, sources = plan_copies(docs, weights, share, limit, doc_id, source, text)
    units = units.join(sources.select("_s", "source_size", "target"), "_s")
    new = ["size", "source_size", "target"]
    rows, copies, own = _taken(docs, units, {"doc_id": doc_id, "source": source, "text": text}, new)
    kept = [quoted(c) for c in docs.columns if c not in (*new, "copies")]
    return rows.select(*kept, *[F.col(o).alias(c) for o, c in zip(own, new)], F.col(copies).alias("copies"))


def repeat(docs: DataFrame, **given) -> DataFrame:
    """The mixed corpus: every row as often as it is taken, columns unchanged."""
    units, _ = plan_copies(docs, **given)
    names = {k: given.get(k, k) for k in ("doc_id", "source", "text")}
    rows, copies, _ = _taken(docs, units.where("base > 0 or extra > 0"), names)
    (each,) = fresh(rows, "_each")
    return rows.where(F.col(copies) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[quoted(c) for c in docs.columns])
