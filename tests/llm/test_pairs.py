"""Near duplicates, components, repeated passages against brute force."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import minhash_tensored, substring_dedup
from scriptorium.llm.components import connected_components


def roots(n, edges):
    up = {i: i for i in n}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components_path_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (7, 6), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == want
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def shingles(text, k=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def family():
    """One large family of edited copies (many pairs just under the threshold),
    exact copies, short and empty texts, null ids and texts."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two three"), (6, "one two three four"), (None, "one two three four"), (None, None)]
    for i in range(10, 150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[20][1].upper()) for i in range(200, 220)] + [(i, " ".join(f"r{rng.randrange(50)}" for _ in range(80))) for i in range(300, 340)]
    return rows


def test_near_duplicates_equal_brute_force(spark, family):
    docs = spark.createDataFrame([(i, t, 9, "c") for i, t in family], "doc_id bigint, text string, n_shingles int, key string")
    for percent in (80, 90):
        got = sorted(map(tuple, minhash_tensored.near_duplicates(docs, percent=percent, r=2 if percent == 80 else 3).collect()), key=str)
        sets = [shingles(t) for _, t in family]
        nodes = {i for i, _ in family if i is not None}
        by_set = {}
        for (i, _), s in zip(family, sets):
            if i is not None and s:
                by_set.setdefault(s, i)
                by_set[s] = min(by_set[s], i)
        distinct = list(by_set)
        edges = [(by_set[a], by_set[b]) for x, a in enumerate(distinct) for b in distinct[:x] if 100 * len(a & b) >= percent * len(a | b)]
        edges += [(i, by_set[s]) for (i, _), s in zip(family, sets) if i is not None and s]
        comp = roots(nodes, edges)
        want = []
        for (i, _), s in zip(family, sets):
            c = comp[by_set[s]] if s else i
            want.append((i, len(s), c, i is not None and i == c))
        assert got == sorted(want, key=str)


def test_family_links_tiles(spark):
    rng = random.Random(2)
    sets = {i: sorted(rng.sample(range(60), 40)) for i in range(60)}
    members = spark.createDataFrame([(i, i if i > 20 else 0, 0) for i in sets], "id bigint, part bigint, family bigint")
    table = spark.createDataFrame(list(sets.items()), "id bigint, s array<bigint>")
    got = {tuple(sorted(r)) for r in minhash_tensored.family_links(members, table, 60, tile=280).collect()}
    part = {i: i if i > 20 else 0 for i in sets}

    def linked(a, b):
        return 100 * len(set(sets[a]) & set(sets[b])) >= 60 * len(set(sets[a]) | set(sets[b]))
    assert got and all(linked(a, b) and part[a] != part[b] for a, b in got)
    assert roots(sets, got | {(0, i) for i in range(21)}) == roots(
        sets, [(a, b) for a in sets for b in sets if a < b and linked(a, b)] + [(0, i) for i in range(21)])


def test_a_large_family_is_dealt_by_tile(spark):
    """Its tiles are separate keys of an exchange of their own, not one key."""
    members = spark.createDataFrame([(i, i if i > 20 else 0, 0) for i in range(60)], "id bigint, part bigint, family bigint")
    sets = spark.createDataFrame([(i, list(range(i, i + 40))) for i in range(60)], "id bigint, s array<bigint>")
    plan = minhash_tensored.family_links(members, sets, 60, tile=280)._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("FlatMapGroupsInArrow"):].split("\n")
    first = next(line for line in above if "Exchange" in line)
    assert "hashpartitioning(at#" in first, plan


def test_links_of_a_family_are_a_forest(spark):
    """Hundreds of single parts, all near each other, give links in proportion, not pairs."""
    members = spark.createDataFrame([(i, i, 0) for i in range(300)], "id bigint, part bigint, family bigint")
    sets = spark.createDataFrame([(i, [*range(60), 1000 + i]) for i in range(300)], "id bigint, s array<bigint>")
    for tile, most in ((10**6, 299), (6000, 4 * 4 * 299)):
        got = minhash_tensored.family_links(members, sets, 80, tile=tile).collect()
        assert len(got) <= most and len(set(roots(range(300), [tuple(r) for r in got]).values())) == 1


def test_several_texts_of_an_id(spark):
    """An id with two texts ties what is near to either; rows without an id take part."""
    a, b = [" ".join(f"{k}{i}" for i in range(23)) for k in "ab"]
    rows = [(1, a), (1, b), (2, a.replace("a0 ", "x ")), (3, b.replace("b0 ", "y ")), (None, b), (None, a + " z"), (7, "on its own here it stands"), (None, "nobody near this one at all"), (8, None), (8, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_tensored.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, 1, False), (7, 7, True), (None, None, False),
                          (8, 8, True), (8, 1, False)], key=str)


def test_keep_one_row_of_each_group(spark, family):
    docs = spark.createDataFrame([(i, t, k, "r") for k, (i, t) in enumerate(family * 2)], "doc_id bigint, text string, t int, row string")
    kept = minhash_tensored.keep_one(docs)
    assert kept.columns == docs.columns and minhash_tensored.keep_one(docs.where("false")).count() == 0
    got = kept.collect()
    groups = {r.doc_id: r.component_id for r in minhash_tensored.near_duplicates(docs).where("n_shingles > 0").collect()}
    wordless = [r for r in got if not (r.text or "").split()]
    assert len(wordless) == 8 and sorted(r.doc_id for r in got if (r.text or "").split()) == sorted(set(groups.values()))
    only = spark.createDataFrame([(None, "alone without an id"), (None, "alone without an id"), (5, "five")], "doc_id bigint, text string")
    assert sorted(map(str, (r.doc_id for r in minhash_tensored.keep_one(only).collect()))) == ["5", "None"]


def cut(rows, k):
    words = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - k + 1):
            seen.setdefault(tuple(w[i:i + k]), []).append((d, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + k))
    return [(i, len(w), len(g), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in g)).hexdigest())
            for (i, _), w, g in zip(rows, words, gone)]


@pytest.mark.parametrize("k,anchor", [(35, 8), (6, 3), (5, 5), (4, 1)])
def test_repeats_equal_brute_force(spark, k, anchor):
    rng = random.Random(k)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None), (2, ""), (None, "a b c"), (4, passage), (5, passage), (5, passage), (6, "x " * 90), (7, "ab cd " * 40 + passage),
            (8, " ".join(rng.choice("abc") for _ in range(400))), (9, passage[:150] + " tail " + passage[100:]), (10, "\t" + passage + "\né")]
    rows += [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60))) + " " + passage[rng.randint(0, 50):]) for i in range(20, 60)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, k1 int, spans int").repartition(5)
    out = substring_dedup.remove_repeats(docs, k=k, anchor=anchor)
    got = out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cut(rows, k)))
    for r in out.collect():
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert sum(e - s for s, e in spans) == r["n_removed"]
        assert all(e < s for (_, e), (s, _) in zip(spans, spans[1:]))  # maximal: no two touch


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash_tensored.near_duplicates(none).count() == 0
    assert minhash_tensored.keep_one(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0


def test_kept_rows_move_once(spark):
    """Whole rows are grouped by id and text together with the names of the kept ones; no
    join deals them a second time."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(2, words, "a"), (2, words, "b"), (3, words + " more", "c"), (None, words, "d"), (None, "alone here now again", "e"), (None, "alone here now again", "f"),
            (4, None, "g"), (4, " ", "h"), (5, "alone here now again", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, best string")
    kept = minhash_tensored.keep_one(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [id") < plan.index("Join")  # printed from the result down
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == 4 and set(got) < set(rows)
    assert sorted(r[0] for r in got) == [2, 4, 4, 5]
