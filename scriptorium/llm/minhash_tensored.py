"""MinHash near-duplicates by tensored banding.

A table key is a pair (a_i, b_j) of two half keys from two small collections of
``m`` half keys, each made of ``r`` minhashes.  2 * m * r minhashes thus serve
m * m tables of 2 * r hashes each, about the square root of what separate tables
would need.  A pair of similarity s shares a table key with probability
(1 - (1 - s**r)**m)**2: 0.99991 at 0.8 with the defaults, more above.

1. One Arrow pass makes each row's shingle set size, fingerprint and half keys.
   Equal sets form one class, named by its first row; only the class goes on.
2. A table key can only be shared if both its halves are, so half keys that
   occur once are dropped before the keys are formed.
3. Of the smallest members of its table buckets each class is paired with the
   one it meets most often, and the pairs are verified on full sets; verified
   links give components.
4. Buckets that still hold several components tie those components to a family.
   Members outside their family's largest component are compared exactly with
   every member of the family, tile by tile inside Arrow tasks of bounded size,
   which return one link per component found.  So each candidate pair is either
   joined already or verified, and no list of all pairs of a group ever exists.
   A tile is dealt by one composed key, so the tiles of a family spread over tasks.

Edge cases: documents without words (null, empty, blank) have an empty set and
link with nothing; shorter than ``width`` words: the whole sequence is the one
shingle; repeated rows and equal texts are one class; classes that share an id are
tied, so an id with several texts joins the components of all of them; rows without an
id get their component's smallest id (null if it has none) and are never kept;
very long texts give long sets and are compared whole; an empty table gives no
rows; extra columns are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import WORD_PATTERN, materialise, mix64, seeds, signed, window_hashes, word_hashes
from scriptorium.llm.components import connected_components

WIDTH = 4
ROWS = 3
HALVES = 14
#: shingles of the members compared in one task, and of those that ask
TILE = 150_000
SET = ["n_shingles", "f1", "f2"]


def shingle_sets(texts: pa.Array, width: int):
    """(document, sorted distinct shingle hashes) for every text with a word."""
    for d, h, at in word_hashes(texts, lower=True):
        n = np.diff(at)
        w = window_hashes(h, width)
        for i in np.flatnonzero(n):
            lo, hi = at[i], at[i + 1]
            if n[i] >= width:
                yield d + i, np.unique(w[lo:hi - width + 1])
            else:  # the whole sequence; its length keeps it apart from wider shingles
                yield d + i, mix64(window_hashes(h[lo:hi], int(n[i])) + np.uint64(n[i]))


def _sketch_udf(width: int, r: int, m: int):
    salt = seeds(2 * m * r, 1000)
    odd = seeds(2 * m * r, 5000) | np.uint64(1)
    tag = seeds(2 * m * r, 9000) | np.uint64(1)
    names = ["n_shingles", "f1", "f2", "a", "b"]

    @F.arrow_udf("struct<n_shingles:bigint,f1:bigint,f2:bigint,a:array<bigint>,b:array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        n = len(texts)
        size, f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        keys = np.zeros((n, 2 * m), np.uint64)
        docs: list[int] = []
        sets: list[np.ndarray] = []

        def flush():
            if not docs:
                return
            at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
            x = np.concatenate(sets)
            size[docs] = [len(s) for s in sets]
            f1[docs] = np.add.reduceat(mix64(x ^ np.uint64(0x5851F42D4C957F2D)), at)
            f2[docs] = np.add.reduceat(mix64(x ^ np.uint64(0x14057B7EF767814F)), at)
            half = np.zeros((len(docs), 2 * m), np.uint64)
            for k in range(2 * m * r):
                half[:, k // r] += mix64(np.minimum.reduceat((x ^ salt[k]) * odd[k], at)) * tag[k]
            keys[docs] = half
            docs.clear()
            sets.clear()

        held = 0
        for d, s in shingle_sets(texts, width):
            docs.append(d)
            sets.append(s)
            held += len(s)
            if held > 50_000:
                flush()
                held = 0
        flush()
        at = pa.array(np.arange(0, n * m + 1, m), pa.int32())
        half = [pa.ListArray.from_arrays(at, pa.array(signed(np.ascontiguousarray(keys[:, c]).ravel()))) for c in (slice(0, m), slice(m, 2 * m))]
        return pa.StructArray.from_arrays([pa.array(size), pa.array(signed(f1)), pa.array(signed(f2)), *half], names=names)

    return sketch.asNondeterministic()


def _set_udf(width: int):
    @F.arrow_udf("array<bigint>")
    def full_set(texts: pa.Array) -> pa.Array:
        n = len(texts)
        at, found = np.zeros(n + 1, np.int64), []
        for d, s in shingle_sets(texts, width):
            at[d + 1] = len(s)
            found.append(s)
        values = signed(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(at), pa.int32()), pa.array(values))

    return full_set


def _shared_halves(reps: DataFrame, side: str) -> DataFrame:
    """(id, side: array of half keys that another id has too, with their index)."""
    one = reps.select("id", "n_shingles", F.posexplode(side).alias("i", "h"))
    often = one.groupBy("i", "h").agg(F.count("*").alias("_c")).filter("_c > 1").select("i", "h")
    return one.join(often, ["i", "h"]).groupBy("id", "n_shingles").agg(F.collect_list(F.struct("i", "h")).alias(side))


def table_keys(reps: DataFrame) -> DataFrame:
    """(id, n_shingles, key) for the pairs of surviving half keys."""
    return _shared_halves(reps, "a").join(_shared_halves(reps, "b").drop("n_shingles"), "id") \
        .select("id", "n_shingles", F.explode("a").alias("x"), "b") \
        .select("id", "n_shingles", "x", F.explode("b").alias("y")) \
        .select("id", "n_shingles", F.xxhash64("x.i", "x.h", "y.i", "y.h").alias("key"))


def _size_can_match(a: str, b: str, percent: int):
    return (F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("u"), F.col("s").alias("su"))
    right = sets.select(F.col("id").alias("v"), F.col("s").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(left, "u").join(right, "v") \
        .where(F.lit(100) * both >= F.lit(percent) * (F.size("su") + F.size("sv") - both)).select("u", "v")


def _compare(percent: int):
    def compare(batch: pa.Table) -> pa.Table:
        """Links of one tile: a forest over the parts in which askers have a match
        there, so fewer links than the tile has parts."""
        ask = batch.column("ask").to_numpy()
        ids, part = batch.column("id").to_numpy(), batch.column("part").to_numpy()
        sets = batch.column("s").combine_chunks()
        at, body = np.asarray(sets.offsets), np.asarray(sets.values)
        size = np.diff(at)
        there, asking = np.flatnonzero(~ask), np.flatnonzero(ask)
        own, label = np.unique(part, return_inverse=True)[1], np.arange(len(part))  # of a member its part, of a part the tree
        u, v = [], []
        if len(there) and len(asking):
            value = np.concatenate([body[at[i]:at[i + 1]] for i in there])
            owner = np.repeat(np.arange(len(there)), size[there])
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            for q in asking:
                x = body[at[q]:at[q + 1]]
                lo, hi = np.searchsorted(value, x, "left"), np.searchsorted(value, x, "right")
                n = hi - lo
                hits = owner[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                both = np.bincount(hits, minlength=len(there))
                linked = there[(100 * both >= percent * (size[there] + size[q] - both)) & (part[there] != part[q])]
                mine = label[own[q]]
                tree = label[own[linked]]
                trees, one = np.unique(tree[tree != mine], return_index=True)
                if len(trees):
                    u += [ids[q]] * len(one)
                    v += ids[linked[tree != mine][one]].tolist()
                    label[np.isin(label, trees)] = mine
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return compare


def family_links(members: DataFrame, sets: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Links (u, v) between different parts of each family of ``members`` (id,
    part, family): members outside the family's largest part ask all members.  A
    tile holds about ``tile`` shingles of members and as many of askers."""
    sized = members.join(sets.select("id", F.size("s").alias("w")), "id")
    sizes = sized.groupBy("family", "part").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    shape = sizes.groupBy("family").agg(F.max(F.struct("n", "part", "w")).alias("big"), F.sum("w").alias("w")) \
        .select("family", F.col("big.part").alias("big"),
                F.ceil(F.col("w") / tile).alias("tiles"), F.ceil((F.col("w") - F.col("big.w")) / tile).alias("asks")).where("asks > 0")
    # narrow rows meet the shape of their family, then each id its set
    known = sized.drop("w").join(shape, "family").join(sets, "id")
    own = F.xxhash64("id")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    asked = known.select("family", F.pmod(own, F.col("tiles")).alias("tile"), each("asks").alias("asker"), F.lit(False).alias("ask"), "id", "part", "s")
    asking = known.where("part <> big").select("family", each("tiles").alias("tile"), F.pmod(own, F.col("asks")).alias("asker"), F.lit(True).alias("ask"), "id", "part", "s")
    # one composed key: grouping by the columns would reuse a partitioning by family
    return asked.unionByName(asking).select(F.struct("family", "tile", "asker").alias("at"), "ask", "id", "part", "s") \
        .groupBy("at").applyInArrow(_compare(percent), "u bigint, v bigint")


def _several_texts(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) that tie the classes of an id."""
    named = sketched.where("n_shingles > 0 and id is not null").select("id", F.struct(*SET).alias("c"))
    more = named.groupBy("id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("id")
    tied = named.join(more, "id").distinct().select("id", "c.*").join(classes.select(*SET, "cid"), SET).select("id", "cid")
    return tied.join(tied.groupBy("id").agg(F.min("cid").alias("u")), "id").where("cid <> u").select("u", F.col("cid").alias("v"))


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, r: int, m: int) -> tuple[DataFrame, DataFrame]:
    """(sketched rows, classes with their component and its representative)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    sketched = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", "t", _sketch_udf(width, r, m)(F.col("text")).alias("k"))
                           .select("row", "id", "t", "k.*"))
    # the representative: the smallest id and, of its texts in the class, the smallest hash
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t"))
    classes = sketched.where("n_shingles > 0").groupBy(*SET).agg(F.min("row").alias("cid"), first.alias("rep"), F.first("a").alias("a"), F.first("b").alias("b"))
    keys = materialise(table_keys(classes.select(F.col("cid").alias("id"), "n_shingles", "a", "b")))

    # one pair per class: the bucket centre it shares most keys with
    centre = keys.groupBy("key").agg(F.min(F.struct("id", "n_shingles")).alias("c"), F.count("*").alias("n")).filter("n > 1")
    pairs = keys.join(centre.select("key", F.col("c.id").alias("u"), F.col("c.n_shingles").alias("nu")), "key") \
        .where((F.col("id") != F.col("u")) & _size_can_match("n_shingles", "nu", percent)).groupBy("id", "u").agg(F.count("*").alias("c"))
    stars = pairs.groupBy("id").agg(F.max(F.struct("c", (-F.col("u")).alias("u"))).alias("x")).select((-F.col("x.u")).alias("u"), F.col("id").alias("v"))
    # full sets of every class that shares a bucket
    member = keys.join(centre.select("key"), "key").select("id").distinct()
    found = classes.select("cid", F.col("rep.id").alias("rep_id"), F.col("rep.t").alias("rep_t")).join(member.withColumnRenamed("id", "cid"), "cid")
    wanted = rows.join(found, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("t") == F.col("rep_t"))).select("cid", _set_udf(width)(F.col("text")).alias("s"))
    sets = materialise(wanted.groupBy(F.col("cid").alias("id")).agg(F.max("s").alias("s")))
    links = materialise(verify(stars, sets, percent).union(_several_texts(sketched, classes)))
    parts = connected_components(links)

    # buckets that still hold several components
    at = keys.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    sizes = at.groupBy("key", "part").agg(F.count("*").alias("n"))
    split = materialise(sizes.groupBy("key").agg(F.max(F.struct("n", "part")).alias("big"), F.count("*").alias("c"))
                        .filter("c > 1").select("key", F.col("big.part").alias("big")))
    open_ = materialise(at.join(split, "key"))
    families = connected_components(open_.select(F.col("part").alias("u"), F.col("big").alias("v")))
    members = open_.select("id", "part").distinct().join(families.withColumnRenamed("node", "part"), "part") \
        .select("id", "part", F.col("component").alias("family"))
    whole = connected_components(links.union(family_links(members, sets, percent)))

    # every class gets the smallest representative of its component
    placed = classes.select(*SET, "rep", "cid").join(whole.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    best = placed.groupBy("component").agg(F.min("rep").alias("best"))
    return sketched, placed.join(best, "component").select(*SET, "best")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = 80,
                    r: int = ROWS, m: int = HALVES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``; links are
    pairs with 100 * intersection >= percent * union of their shingle sets."""
    sketched, classes = _grouped(docs, doc_id, text, width, percent, r, m)
    out = sketched.select("id", *SET).join(classes.select(*SET, F.col("best.id").alias("component_id")), SET, "left") \
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = 80,
             r: int = ROWS, m: int = HALVES) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: of the smallest id, of a
    row without an id only where the group has no other.  Rows of that id and
    text are one document, even if other columns differ.  Rows without words, which
    are near nothing, all stay."""
    _, classes = _grouped(docs, doc_id, text, width, percent, r, m)
    wordy = F.coalesce(F.col(text).rlike(WORD_PATTERN), F.lit(False))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    once = docs.where(wordy).select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("t"), whole, F.lit(False).alias("best"))
    best = classes.select("best.id", "best.t", F.lit(None).cast(once.schema["row"].dataType).alias("row"), F.lit(True).alias("best"))
    # copies collapse before the shuffle; the names of the best rows come by the same grouping, so
    # whole rows move once (a null-safe join would deal them again by other keys)
    kept = once.unionByName(best).groupBy("id", "t").agg(F.first("row", ignorenulls=True).alias("row"), F.max("best").alias("best")) \
        .where("best and row is not null")
    return kept.select("row.*").unionByName(docs.where(~wordy))
