from pyspark.sql import functions as F

from scriptorium.operators import graph as G

FIELDS = ("invoice_number string, date string, total string, "
          "items array<struct<name:string, quantity:int, price:string>>")


def fixture(spark):
    return spark.createDataFrame(
        [("d1", "INV-12345", "2024-01-15", "$1,234.56",
          [("Item 1", 2, "$500.00"), ("Item 2", 1, "$734.56")])], "doc string, " + FIELDS)


def test_field_graph_golden(spark):
    nodes, edges = G.fields_to_graph(fixture(spark), "doc")
    n = {r.node: r for r in nodes.collect()}
    assert len(n) == 10 and edges.count() == 12
    assert (n["Document"].node_type, n["Document"].level) == ("document", 0)
    assert n["items"]["count"] == 2 and n["items"].node_type == "list"
    assert n["name"].value == "Item 2" and n["name"].level == 3
    assert n["quantity"].value == "1" and n["price"].value == "$734.56"
    assert n["total"].value == "$1,234.56"
    order = [r.node for r in nodes.orderBy("node_ord").collect()]
    assert order == ["Document", "invoice_number", "date", "total", "items", "items_item_1",
                     "name", "quantity", "price", "items_item_2"]
    types = {r.node_type: r.n for r in G.node_type_counts(nodes).collect()}
    assert types == {"document": 1, "value": 6, "list": 1, "list_item": 2}
    cen = [(r.node, round(r.centrality, 6)) for r in G.degree_centrality(nodes, edges).orderBy("rank").collect()]
    assert cen == [("Document", round(4 / 9, 6)), ("items_item_1", round(4 / 9, 6)), ("items_item_2", round(4 / 9, 6)),
                   ("items", round(3 / 9, 6)), ("name", round(2 / 9, 6))]
    conn = G.connectivity(nodes, edges).first()
    assert conn.is_connected
    st = G.graph_counts(nodes, edges).first()
    assert (st.num_nodes, st.num_edges, st.is_directed) == (10, 12, True)


def test_invoice_graph_golden(spark):
    inv = spark.createDataFrame([("d1", "INV-12345", "2024-01-15", "$1,234.56", None, None)],
                                "doc_id string, invoice_number string, date string, total string, vendor string, customer string")
    items = spark.createDataFrame([("d1", 1, "Item 1", "2", "$500.00"), ("d1", 2, "Item 2", "1", "$734.56")],
                                  "doc_id string, item_no int, name string, quantity string, price string")
    nodes, edges = G.invoice_graph(inv, items, ["name", "quantity", "price"])
    names = [r.node for r in nodes.orderBy("node_ord").collect()]
    assert names[:5] == ["Invoice_INV-12345", "date_2024-01-15", "total_$1,234.56", "Items", "Item_1"]
    assert len(names) == 12 and edges.count() == 11


def test_disconnected_and_self_loop(spark):
    nodes = spark.createDataFrame([("g", "a", 1, "value", 1, None, None), ("g", "b", 2, "value", 1, None, None),
                                   ("g", "c", 3, None, 1, None, None)],
                                  "doc_id string, node string, node_ord long, node_type string, level int, value string, count int")
    edges = spark.createDataFrame([("g", "a", "b", "r"), ("g", "c", "c", "self")],
                                  "doc_id string, src string, dst string, relationship string")
    c = G.connectivity(nodes, edges).first()
    assert c.n_components == 2 and not c.is_connected
    cen = {r.node: r.centrality for r in G.degree_centrality(nodes, edges).collect()}
    assert cen["c"] == 1.0 and cen["a"] == 0.5
    assert {r.node_type for r in G.node_type_counts(nodes).collect()} == {"value", "unknown"}


def test_json_export(spark):
    import json

    nodes, edges = G.fields_to_graph(fixture(spark), "doc")
    doc = json.loads(G.graph_json(nodes, edges).first().json)
    assert doc["directed"] is True and doc["multigraph"] is False
    assert len(doc["nodes"]) == 10 and len(doc["links"]) == 12
    assert doc["nodes"][0]["id"] == "Document"


def test_components_of_a_long_path(spark):
    from scriptorium.operators import graph as G

    n = 108
    nodes = spark.createDataFrame([(1, f"n{i}", i) for i in range(n)], "doc_id long, node string, node_ord long")
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}") for i in range(n - 1)], "doc_id long, src string, dst string")
    assert G.connectivity(nodes, edges).first()["n_components"] == 1


def names(nodes):
    return [(r.node, r.node_type, r.level, r.value) for r in nodes.orderBy("node_ord").collect()]


def test_maps_and_lists_at_any_depth(spark):
    df = spark.sql("""SELECT 1 AS id, map('a', map('b', array(1, 2))) AS m,
                      array(map('x', named_struct('y', 5)), CAST(NULL AS map<string, struct<y: int>>)) AS l""")
    nodes, edges = G.fields_to_graph(df, "id")
    assert [(n, t, lv) for n, t, lv, _ in names(nodes)] == [
        ("Document", "document", 0), ("m", "category", 1), ("a", "category", 2), ("b", "list", 3), ("b_item_1", "value", 4),
        ("b_item_2", "value", 4), ("l", "list", 1), ("l_item_1", "list_item", 2), ("x", "category", 3), ("y", "value", 4), ("l_item_2", "value", 2)]
    assert edges.filter("src = 'l_item_1' and dst = 'x' and relationship = 'has_field'").count() == 1


def test_json_graphs_skip_absent_keys(spark):
    import json

    rows = [(1, '{"z": 1.50, "a": {"b": null, "c": [true, "t"]}}'), (2, '{"q": []}'), (3, "no json"), (4, None), (5, "[1]"), (6, "{}")]
    nodes, edges = G.json_to_graph(spark.createDataFrame(rows, "id long, j string"), "id", "j")
    by = lambda d: names(nodes.filter(nodes.doc_id == d))
    assert [(n, v) for n, _, _, v in by("1") if n in ("b", "c_item_1", "c_item_2")] == [("c_item_1", "true"), ("c_item_2", "t")]
    assert [n for n, _, _, _ in by("2")] == ["Document", "q"]
    assert [len(by(str(d))) for d in (3, 4, 6)] == [1, 1, 1]
    links = json.loads(G.graph_json(nodes, edges).filter("doc_id = '1'").first().json)["links"]
    assert [x["target"] for x in links] == ["a", "z", "c", "c_item_1", "c_item_2"]


def test_json_graph_without_any_object(spark):
    nodes, edges = G.json_to_graph(spark.createDataFrame([(1, "x"), (2, None)], "id long, j string"), "id", "j")
    assert nodes.count() == 2 and edges.count() == 0
    empty = spark.createDataFrame([], "id long, j string")
    assert G.json_to_graph(empty, "id", "j")[0].count() == 0


def random_graphs(seed):
    import random

    rng = random.Random(seed)
    nodes, edges = [], []
    for d in range(40):
        n = rng.randrange(1, 30)
        nodes += [(str(d), f"n{i}", i + 1) for i in range(n)]
        edges += [(str(d), f"n{rng.randrange(n + 2)}", f"n{rng.randrange(n + 2)}", k) for k in range(rng.randrange(0, n + 3))]  # some ends are no nodes
    return nodes, list({e[:3]: e for e in edges}.values())


def labels(nodes, edges):
    up = {(d, x): (d, x) for d, x, _ in nodes}
    number = {(d, x): i for d, x, i in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for d, a, b, *_ in edges:
        if (d, a) in up and (d, b) in up:
            x, y = sorted((find((d, a)), find((d, b))), key=number.get)
            up[y] = x
    return {k: number[find(k)] for k in up}


def test_components_equal_union_find(spark):
    for seed, largest in ((1, 10**6), (2, 8), (3, 0)):  # rows alone, both ways, rounds alone
        nodes, edges = random_graphs(seed)
        n = spark.createDataFrame(nodes, "doc_id string, node string, node_ord bigint")
        e = spark.createDataFrame(edges, "doc_id string, src string, dst string, edge_ord bigint")
        want = labels(nodes, edges)
        assert {(r.doc_id, r.node): r.label for r in G.weak_components(n, e, largest).collect()} == want
        parts = {d: len({v for k, v in want.items() if k[0] == d}) for d, _, _ in nodes}
        got = G.connectivity(n, e, largest).collect()
        assert {r.doc_id: (r.n_components, r.is_connected) for r in got} == {d: (c, c == 1) for d, c in parts.items()} and len(got) == len(parts)


def test_a_long_path_takes_few_rounds(spark):
    import random

    n = 10_000
    names = random.Random(1).sample(range(n), n)  # the numbers along the path are in no order
    pairs = spark.createDataFrame([("p", names[i], names[i + 1]) for i in range(n - 1)], "doc_id string, u long, v long")
    found, rounds = G.contract(pairs)
    assert rounds < 20 and found.count() == n and found.where("label <> 0").count() == 0


def test_invoice_centrality_equals_the_graphs(spark):
    inv = spark.createDataFrame([(1, 10, "d", "t", None, "c"), (2, None, None, None, None, None), (3, 30, None, "t", "v", "c"), (4, 40, "d", None, None, None)],
                                "doc_id long, invoice_number long, date string, total string, vendor string, customer string")
    items = spark.createDataFrame([(1, i, "a") for i in range(1, 4)] + [(3, i, None) for i in range(1, 9)] + [(4, i, "x") for i in range(1, 60)] + [(9, 1, "no invoice")],
                                  "doc_id long, item_no int, name string")
    nodes, edges = G.invoice_graph(inv, items, ["name"])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(G.invoice_centrality(inv, items, ["name"])) == rows(G.degree_centrality(nodes, edges))


def test_graph_job_exports(spark):
    import pytest

    graph = G.fields_to_graph(fixture(spark), "doc")
    jobs = {f: G.graph_job(*graph, export_format=f).first() for f in ("json", "png", "both")}
    assert jobs["json"].json == jobs["both"].json == G.graph_json(*graph).first().json and jobs["png"].json is None and jobs["json"].drawing is None
    assert jobs["png"].drawing == jobs["both"].drawing and jobs["png"].drawing.startswith("digraph {") and '"Document" [fillcolor="#FF6B6B"];' in jobs["png"].drawing
    with pytest.raises(ValueError):
        G.graph_job(*graph, export_format="pdf")
    plan = G.graph_report(*graph)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange " in line for line in plan.split("== Initial Plan ==")[0].split("\n")) <= 4


def test_writes_are_made_after_the_exchange(spark):
    """Documents move once, before their writes are made, to a named number of
    partitions; repeated and null ids are one graph each."""
    df = spark.createDataFrame([("a", "x", [1, 2]), ("a", "x", [1, 2]), (None, "y", [3]), (None, "y", [3])], "doc string, name string, tags array<int>").coalesce(1)
    nodes, edges = G.fields_to_graph(df, "doc")
    for t in (nodes, edges):
        plan = t._jdf.queryExecution().sparkPlan().toString() + t._jdf.queryExecution().executedPlan().toString()
        executed = t._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and executed.count("Exchange ") == 1
        assert executed.index("Generate") < executed.index("Exchange ")  # printed from the result down
    assert sorted((r.doc_id or "", r.node_ord, r.node) for r in nodes.collect()) == [
        ("", 1, "Document"), ("", 2, "name"), ("", 3, "tags"), ("", 4, "tags_item_1"),
        ("a", 1, "Document"), ("a", 2, "name"), ("a", 3, "tags"), ("a", 4, "tags_item_1"), ("a", 5, "tags_item_2")]


def test_json_texts_are_dealt(spark):
    df = spark.createDataFrame([(i, '{"k": %d}' % i) for i in range(40)], "id long, t string").coalesce(1)
    nodes, _ = G.json_to_graph(df, "id", "t")
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert plan.index("from_json") < plan.rindex("Exchange ")
    assert nodes.where("node = 'k' and value = doc_id").count() == 40


def test_documents_of_one_row_are_merged_inside_their_row(spark):
    rows = [("1", "x", ["p", "q"], ("y", "z")), ("2", None, [], (None, "z")), ("3", "a", None, None),  # alone
            ("4", "b", ["r"], ("c", "d")), ("4", "b", ["r"], ("c", "d")), (None, "e", ["s", None], ("f", "g"))]
    df = spark.createDataFrame(rows, "id string, name string, tags array<string>, of struct<name:string,tags:string>")
    nodes, edges = G.fields_to_graph(df, "id")
    want = G.merge_writes(*G.graph_writes(df, "id"))
    for got, all_rows in zip((nodes, edges), want):
        assert got.columns == all_rows.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, all_rows.collect()))
    records, plain = G.fields_to_records(df, "id"), G.graph_records(*want)
    assert sorted(map(repr, records.collect())) == sorted(map(repr, plain.collect()))
    # the branch of single rows makes their nodes with no aggregate or sort above them
    union = nodes._jdf.queryExecution().optimizedPlan().toString()
    alone = union.split("_rows")[0]
    assert "Generate" in alone and "Aggregate" not in alone


def test_invoice_connectivity_is_that_of_the_graph(spark):
    inv = spark.createDataFrame([("1", "7", "d", "9", None, "c"), ("2", None, None, None, None, None), ("3", "8", "d", "9", None, "c"),
                                 ("3", "8", "d", "9", None, "c"), (None, "9", "d", None, None, None)],
                                "doc_id string, invoice_number string, date string, total string, vendor string, customer string")
    items = spark.createDataFrame([("1", 1, "p", "2"), ("1", 2, "q", None), ("3", 1, "p", "1"), ("5", 1, "x", "1"), (None, 1, "y", "1")],
                                  "doc_id string, item_no int, name string, quantity string")
    fields = ["name", "quantity"]
    want = sorted(map(repr, G.connectivity(*G.invoice_graph(inv, items, fields)).collect()))
    got = G.invoice_connectivity(inv, items, fields)
    assert sorted(map(repr, got.collect())) == want
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # nodes and edges are never rows
    few = inv.where("doc_id in ('1', '2')")
    parted = G.invoice_connectivity(few, items, fields, largest=9)  # "1" is contracted
    assert sorted(map(repr, parted.collect())) == sorted(map(repr, G.connectivity(*G.invoice_graph(few, items, fields)).collect()))


def test_item_writes_are_not_filtered(spark):
    inv = spark.createDataFrame([("1", "7", None, "9", None, "c")], "doc_id string, invoice_number string, date string, total string, vendor string, customer string")
    items = spark.createDataFrame([("1", 1, None)], "doc_id string, item_no int, name string")
    nodes = G.invoice_graph(inv, items, ["name"])[0]
    assert [(r["node"], r["value"]) for r in nodes.orderBy("node_ord").collect()] == [
        ("Invoice_7", None), ("total_9", "9"), ("customer_c", "c"), ("Items", None), ("Item_1", None), ("Item_1_name", None)]
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 2  # the invoice's own, and its size
