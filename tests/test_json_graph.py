"""Graphs from JSON text keep its order and tell null from absent."""
import json

from scriptorium.operators import graph as G
from scriptorium.operators import json_graph as J


def test_order_nulls_and_digits(spark):
    text = '{"z": 1.50, "a": {"n": null, "list": [true, "t", [1, {"q": 2}], {"k": -0.0, "z": "again"}, null]}, "m": {}, "é": [], "z2": 12345678901234567890}'
    nodes, edges = J.json_graph(spark.createDataFrame([(1, text)], "id long, j string"), "id", "j")
    got = [(r.node, r.node_type, r.level, r.value, r["count"]) for r in nodes.orderBy("node_ord").collect()]
    assert got == [
        ("Document", "document", 0, None, None), ("z", "value", 4, "again", None), ("a", "category", 1, '{"n":null,"list":[true,"t",[1,{"q":2}],{"k":-0.0,"z":"again"},null]}', None),
        ("n", "value", 2, None, None), ("list", "list", 2, None, 5), ("list_item_1", "value", 3, "true", None), ("list_item_2", "value", 3, "t", None),
        ("list_item_3", "value", 3, '[1,{"q":2}]', None), ("list_item_4", "list_item", 3, None, None), ("k", "value", 4, "-0.0", None), ("list_item_5", "value", 3, None, None),
        ("m", "category", 1, "{}", None), ("é", "list", 1, None, 0), ("z2", "value", 1, "12345678901234567890", None)]
    links = [(r.src, r.dst, r.relationship) for r in edges.orderBy("edge_ord").collect()]
    assert links[:4] == [("Document", "z", "has_value"), ("Document", "a", "has_field"), ("a", "n", "has_value"), ("a", "list", "has_list")]
    assert ("list", "list_item_3", "contains") in links and ("list_item_4", "z", "has_value") in links


def test_text_that_is_no_object(spark):
    deep = "{" + '"a":{' * 5000 + "}" * 5001
    rows = [(1, None), (2, ""), (3, "[1]"), (4, "{bad"), (5, '{"x": NaN}'), (6, "{}"), (7, deep[:-1])]
    nodes, edges = J.json_graph(spark.createDataFrame(rows, "id long, j string"), "id", "j")
    assert sorted((r.doc_id, r.node) for r in nodes.collect()) == [(str(i), "Document") for i in range(1, 8)] and edges.count() == 0
    assert J.json_graph(spark.createDataFrame([], "id long, j string"), "id", "j")[0].count() == 0


def test_equals_columns_of_the_same_content(spark):
    record = {"b": "x", "a": {"c": "y", "d": ["p", "q"]}, "l": [{"k": "v"}, {"k": "w"}]}
    df = spark.createDataFrame([("1", "x", ("y", ["p", "q"]), [("v",), ("w",)])], "id string, b string, a struct<c:string,d:array<string>>, l array<struct<k:string>>")
    ours, theirs = J.json_graph(spark.createDataFrame([("1", json.dumps(record))], "id string, j string"), "id", "j"), G.fields_to_graph(df, "id")
    for x, y in zip(ours, theirs):
        assert sorted(map(str, x.select(*sorted(y.columns)).collect())) == sorted(map(str, y.select(*sorted(y.columns)).collect()))
