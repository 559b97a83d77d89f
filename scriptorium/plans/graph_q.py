"""Graph queries: invoice graphs of orders (G4-G8) and nested-field graphs of
customers (G1-G3, G9, S9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import graph as G
from scriptorium.operators import json_graph as JG
from scriptorium.plans.registry import register
from scriptorium.session import read_table

ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ITEM_FIELDS = ["name", "quantity", "price"]


def money(c):
    return F.col(c).cast("decimal(18,2)").cast("string")


def _invoice_parts(spark, sf):
    orders = read_table(spark, sf, "orders")
    customer = read_table(spark, sf, "customer")
    lineitem = read_table(spark, sf, "lineitem")
    inv = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("invoice_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), money("o_totalprice").alias("total"),
        F.lit(None).cast("string").alias("vendor"), F.col("c_name").alias("customer"))
    # an order's items are few: a plain window, on the string key that the graph joins on
    li = lineitem.withColumn("doc_id", F.col("l_orderkey").cast("string"))
    items = li.select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(*ITEM_ORDER)).alias("item_no"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_quantity").cast("string").alias("quantity"), money("l_extendedprice").alias("price"))
    return inv.withColumn("doc_id", F.col("doc_id").cast("string")), items, ITEM_FIELDS


def invoice_graph(spark, sf):
    return G.invoice_graph(*_invoice_parts(spark, sf))


SQL_INVOICE = f"""
inv AS (SELECT CAST(o.o_orderkey AS VARCHAR) AS doc_id, 'Invoice_' || CAST(o.o_orderkey AS VARCHAR) AS root,
               strftime(o.o_orderdate, '%Y-%m-%d') AS date,
               CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total,
               CAST(NULL AS VARCHAR) AS vendor, c.c_name AS customer
        FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
inv2 AS (SELECT *, (date IS NOT NULL)::INT AS p1, (total IS NOT NULL)::INT AS p2, (vendor IS NOT NULL)::INT AS p3,
                (customer IS NOT NULL)::INT AS p4 FROM inv),
it AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ITEM_ORDER)}) AS item_no,
              'part_' || CAST(l_partkey AS VARCHAR) AS name, CAST(l_quantity AS VARCHAR) AS quantity,
              CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM lineitem),
it2 AS (SELECT it.*, 'Item_' || CAST(item_no AS VARCHAR) AS item, inv2.root,
               p1 + p2 + p3 + p4 + 2 + (item_no - 1) * 4 + 1 AS base
        FROM it JOIN inv2 USING (doc_id)),
gn AS (
  SELECT doc_id, root AS node, 1 AS node_ord, 'invoice' AS node_type, 0 AS level, CAST(NULL AS VARCHAR) AS value FROM inv2
  UNION ALL SELECT doc_id, 'date_' || date, 2, 'metadata', 1, date FROM inv2 WHERE date IS NOT NULL
  UNION ALL SELECT doc_id, 'total_' || total, 2 + p1, 'metadata', 1, total FROM inv2 WHERE total IS NOT NULL
  UNION ALL SELECT doc_id, 'vendor_' || vendor, 2 + p1 + p2, 'metadata', 1, vendor FROM inv2 WHERE vendor IS NOT NULL
  UNION ALL SELECT doc_id, 'customer_' || customer, 2 + p1 + p2 + p3, 'metadata', 1, customer FROM inv2 WHERE customer IS NOT NULL
  UNION ALL SELECT doc_id, 'Items', 2 + p1 + p2 + p3 + p4, 'items_list', 1, NULL FROM inv2
  UNION ALL SELECT doc_id, item, base, 'item', 2, NULL FROM it2
  UNION ALL SELECT doc_id, item || '_name', base + 1, 'item_detail', 3, name FROM it2
  UNION ALL SELECT doc_id, item || '_quantity', base + 2, 'item_detail', 3, quantity FROM it2
  UNION ALL SELECT doc_id, item || '_price', base + 3, 'item_detail', 3, price FROM it2),
ge AS (
  SELECT doc_id, root AS src, 'date_' || date AS dst, 'date' AS relationship FROM inv2 WHERE date IS NOT NULL
  UNION ALL SELECT doc_id, root, 'total_' || total, 'total' FROM inv2 WHERE total IS NOT NULL
  UNION ALL SELECT doc_id, root, 'vendor_' || vendor, 'vendor' FROM inv2 WHERE vendor IS NOT NULL
  UNION ALL SELECT doc_id, root, 'customer_' || customer, 'customer' FROM inv2 WHERE customer IS NOT NULL
  UNION ALL SELECT doc_id, root, 'Items', 'contains' FROM inv2
  UNION ALL SELECT doc_id, 'Items', item, 'has_item' FROM it2
  UNION ALL SELECT doc_id, item, item || '_name', 'name' FROM it2
  UNION ALL SELECT doc_id, item, item || '_quantity', 'quantity' FROM it2
  UNION ALL SELECT doc_id, item, item || '_price', 'price' FROM it2)"""


def sql_stats(nodes: str = "gn", edges: str = "ge") -> str:
    return f"""
SELECT n.doc_id, CAST(n.c AS BIGINT) AS num_nodes, CAST(coalesce(e.c, 0) AS BIGINT) AS num_edges, true AS is_directed
FROM (SELECT doc_id, count(*) AS c FROM {nodes} GROUP BY doc_id) n
LEFT JOIN (SELECT doc_id, count(*) AS c FROM {edges} GROUP BY doc_id) e USING (doc_id)"""


def sql_types(nodes: str = "gn") -> str:
    return f"SELECT doc_id, coalesce(node_type, 'unknown') AS node_type, CAST(count(*) AS BIGINT) AS n FROM {nodes} GROUP BY ALL"


def sql_centrality(nodes: str = "gn", edges: str = "ge") -> str:
    return f"""
SELECT doc_id, CAST(rank AS BIGINT) AS rank, node, round(centrality, 6) AS centrality FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY centrality DESC, node_ord) AS rank FROM (
    SELECT n.doc_id, n.node, n.node_ord,
           CASE WHEN s.n = 1 THEN 1.0 ELSE coalesce(d.deg, 0)::DOUBLE / (s.n - 1) END AS centrality
    FROM {nodes} n
    JOIN (SELECT doc_id, count(*) AS n FROM {nodes} GROUP BY doc_id) s USING (doc_id)
    LEFT JOIN (SELECT doc_id, node, count(*) AS deg FROM
                 (SELECT doc_id, src AS node FROM {edges} UNION ALL SELECT doc_id, dst FROM {edges}) GROUP BY ALL) d
      USING (doc_id, node)
    WHERE s.n < {G.CENTRALITY_MAX_NODES}))
WHERE rank <= {G.CENTRALITY_TOP}"""


def sql_components(nodes: str = "gn", edges: str = "ge") -> str:
    return f"""
SELECT doc_id, CAST(count(DISTINCT lab) AS BIGINT) AS n_components, count(DISTINCT lab) = 1 AS is_connected FROM (
  SELECT doc_id, node, min(lab) AS lab FROM reach GROUP BY ALL) GROUP BY doc_id"""


def sql_reach(nodes: str = "gn", edges: str = "ge") -> str:
    return f"""
und AS (SELECT doc_id, src AS a, dst AS b FROM {edges} WHERE src <> dst
        UNION SELECT doc_id, dst, src FROM {edges} WHERE src <> dst),
reach(doc_id, node, lab) AS (
  SELECT doc_id, node, node_ord FROM {nodes}
  UNION
  SELECT r.doc_id, u.b, r.lab FROM reach r JOIN und u ON r.doc_id = u.doc_id AND r.node = u.a)"""


@register("invoice_graph_nodes", f"WITH {SQL_INVOICE} SELECT doc_id, node, CAST(node_ord AS BIGINT) AS node_ord, node_type, "
          "CAST(level AS INTEGER) AS level, value, CAST(NULL AS INTEGER) AS count FROM gn")
def invoice_graph_nodes(spark, sf):
    """Invoice graph nodes for every order (items from lineitem)."""
    return invoice_graph(spark, sf)[0]


@register("invoice_graph_edges", f"WITH {SQL_INVOICE} SELECT doc_id, src, dst, relationship FROM ge")
def invoice_graph_edges(spark, sf):
    """Invoice graph edges."""
    return invoice_graph(spark, sf)[1]


@register("invoice_graph_stats", f"WITH {SQL_INVOICE} {sql_stats()}")
def invoice_graph_stats(spark, sf):
    """Node and edge counts per invoice graph."""
    return G.written_counts(G.invoice_writes(*_invoice_parts(spark, sf)))


@register("graph_node_types", f"WITH {SQL_INVOICE} {sql_types()}")
def graph_node_types(spark, sf):
    """Node-type distribution per invoice graph."""
    return G.node_type_counts(invoice_graph(spark, sf)[0])


@register("graph_centrality", f"WITH {SQL_INVOICE} {sql_centrality()}")
def graph_centrality(spark, sf):
    """Top-5 degree centrality per invoice graph (graphs < 100 nodes)."""
    c = G.invoice_centrality(*_invoice_parts(spark, sf))
    return c.withColumn("centrality", F.round("centrality", 6))


@register("graph_connected", f"WITH RECURSIVE {SQL_INVOICE}, {sql_reach()} {sql_components()}")
def graph_connected(spark, sf):
    """Weak connectivity of every invoice graph."""
    return G.invoice_connectivity(*_invoice_parts(spark, sf))


# ------------------------------------------------------------ field graphs


def customer_fields(spark, sf):
    """Nested record per customer: scalars, a nested dict (nation -> region),
    a list of scalars (name parts) and a list of dicts (parts with position)."""
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    nr = n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
        "n_nationkey", F.struct(F.col("n_name").alias("name"),
                                F.struct(F.col("r_name").alias("name")).alias("region")).alias("nation"))
    parts = F.split("c_name", "#")
    return c.join(nr, c.c_nationkey == nr.n_nationkey, "left").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        money("c_acctbal").alias("balance"), "nation", parts.alias("tags"),
        F.transform(parts, lambda x, i: F.struct(x.alias("part"), (i + 1).alias("pos"))).alias("parts"))


def field_graph(spark, sf):
    return G.fields_to_graph(customer_fields(spark, sf), "c_custkey")


def field_records(spark, sf):
    return G.fields_to_records(customer_fields(spark, sf), "c_custkey")


SQL_FIELD_WRITES = """
cf AS (SELECT CAST(c.c_custkey AS VARCHAR) AS doc_id, c.c_name AS name, c.c_mktsegment AS segment,
              CAST(CAST(c.c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS balance,
              n.n_name, r.r_name, string_split(c.c_name, '#') AS tags
       FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
                       LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
tg AS (SELECT doc_id, unnest(generate_series(1, len(tags))) AS i, unnest(tags) AS t FROM cf),
nw AS (
  SELECT doc_id, 'Document' AS node, [0] AS ord, 'document' AS node_type, 0 AS level, NULL::VARCHAR AS value, false AS hv, NULL::INTEGER AS cnt, false AS hc FROM cf
  UNION ALL SELECT doc_id, 'name', [1, 0], 'value', 1, name, true, NULL, false FROM cf
  UNION ALL SELECT doc_id, 'segment', [2, 0], 'value', 1, segment, true, NULL, false FROM cf
  UNION ALL SELECT doc_id, 'balance', [3, 0], 'value', 1, balance, true, NULL, false FROM cf
  UNION ALL SELECT doc_id, 'nation', [4, 0], 'category', 1,
                   CASE WHEN n_name IS NULL AND r_name IS NULL THEN NULL
                        ELSE '{"name":' || to_json(n_name) || ',"region":{"name":' || to_json(r_name) || '}}' END, true, NULL, false FROM cf
  UNION ALL SELECT doc_id, 'name', [4, 1, 0], 'value', 2, n_name, true, NULL, false FROM cf
  UNION ALL SELECT doc_id, 'region', [4, 2, 0], 'category', 2, '{"name":' || to_json(r_name) || '}', true, NULL, false FROM cf
  UNION ALL SELECT doc_id, 'name', [4, 2, 1, 0], 'value', 3, r_name, true, NULL, false FROM cf
  UNION ALL SELECT doc_id, 'tags', [5, 0], 'list', 1, NULL, false, len(tags)::INTEGER, true FROM cf
  UNION ALL SELECT doc_id, 'tags_item_' || i, [5, i::INTEGER, 0], 'value', 2, t, true, NULL, false FROM tg
  UNION ALL SELECT doc_id, 'parts', [6, 0], 'list', 1, NULL, false, len(tags)::INTEGER, true FROM cf
  UNION ALL SELECT doc_id, 'parts_item_' || i, [6, i::INTEGER, 0], 'list_item', 2, NULL, false, NULL, false FROM tg
  UNION ALL SELECT doc_id, 'part', [6, i::INTEGER, 1, 0], 'value', 3, t, true, NULL, false FROM tg
  UNION ALL SELECT doc_id, 'pos', [6, i::INTEGER, 2, 0], 'value', 3, CAST(i AS VARCHAR), true, NULL, false FROM tg),
ew AS (
  SELECT doc_id, 'Document' AS src, 'name' AS dst, 'has_value' AS relationship, [1, 0] AS ord FROM cf
  UNION ALL SELECT doc_id, 'Document', 'segment', 'has_value', [2, 0] FROM cf
  UNION ALL SELECT doc_id, 'Document', 'balance', 'has_value', [3, 0] FROM cf
  UNION ALL SELECT doc_id, 'Document', 'nation', 'has_field', [4, 0] FROM cf
  UNION ALL SELECT doc_id, 'nation', 'name', 'has_value', [4, 1, 0] FROM cf
  UNION ALL SELECT doc_id, 'nation', 'region', 'has_field', [4, 2, 0] FROM cf
  UNION ALL SELECT doc_id, 'region', 'name', 'has_value', [4, 2, 1, 0] FROM cf
  UNION ALL SELECT doc_id, 'Document', 'tags', 'has_list', [5, 0] FROM cf
  UNION ALL SELECT doc_id, 'tags', 'tags_item_' || i, 'contains', [5, i::INTEGER, 0] FROM tg
  UNION ALL SELECT doc_id, 'Document', 'parts', 'has_list', [6, 0] FROM cf
  UNION ALL SELECT doc_id, 'parts', 'parts_item_' || i, 'contains', [6, i::INTEGER, 0] FROM tg
  UNION ALL SELECT doc_id, 'parts_item_' || i, 'part', 'has_value', [6, i::INTEGER, 1, 0] FROM tg
  UNION ALL SELECT doc_id, 'parts_item_' || i, 'pos', 'has_value', [6, i::INTEGER, 2, 0] FROM tg),
fn AS (SELECT doc_id, node, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(ord)) AS BIGINT) AS node_ord,
              arg_max(node_type, ord) AS node_type, CAST(arg_max(level, ord) AS INTEGER) AS level,
              arg_max(value, ord) FILTER (WHERE hv) AS value, CAST(arg_max(cnt, ord) FILTER (WHERE hc) AS INTEGER) AS count
       FROM nw GROUP BY doc_id, node),
fe AS (SELECT doc_id, src, dst, arg_max(relationship, ord) AS relationship,
              CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(ord)) AS BIGINT) AS edge_ord
       FROM ew GROUP BY doc_id, src, dst)"""


@register("field_graph_nodes", f"WITH {SQL_FIELD_WRITES} SELECT * FROM fn")
def field_graph_nodes(spark, sf):
    """Nodes of each customer's nested record (equal keys merge)."""
    return field_graph(spark, sf)[0]


@register("field_graph_edges", f"WITH {SQL_FIELD_WRITES} SELECT * FROM fe")
def field_graph_edges(spark, sf):
    """Edges of each customer's nested record."""
    return field_graph(spark, sf)[1]


@register("field_graph_stats", f"WITH {SQL_FIELD_WRITES} {sql_stats('fn', 'fe')}")
def field_graph_stats(spark, sf):
    """G5 over the field graphs."""
    return G.graph_counts(*field_graph(spark, sf))


@register("field_graph_centrality", f"WITH {SQL_FIELD_WRITES} {sql_centrality('fn', 'fe')}")
def field_graph_centrality(spark, sf):
    """G8 over the field graphs."""
    return G.degree_centrality(*field_graph(spark, sf)).withColumn("centrality", F.round("centrality", 6))


@register("field_graph_colours", f"""WITH {SQL_FIELD_WRITES}
SELECT doc_id, node, CASE node_type WHEN 'document' THEN '#FF6B6B' WHEN 'category' THEN '#4ECDC4' WHEN 'list' THEN '#45B7D1'
                     WHEN 'value' THEN '#96CEB4' ELSE '#FFEAA7' END AS colour FROM fn""")
def field_graph_colours(spark, sf):
    """Display colour of every field-graph node."""
    return G.node_colours(field_graph(spark, sf)[0]).select("doc_id", "node", "colour")


@register("field_graph_json", f"""WITH {SQL_FIELD_WRITES},
nj AS (SELECT doc_id, string_agg('{{' || concat_ws(',', '"node_type":' || to_json(node_type),
                                             '"level":' || CAST(level AS VARCHAR),
                                             CASE WHEN value IS NOT NULL THEN '"value":' || to_json(value) END,
                                             CASE WHEN count IS NOT NULL THEN '"count":' || CAST(count AS VARCHAR) END,
                                             '"id":' || to_json(node)) || '}}', ',' ORDER BY node_ord) AS nodes
       FROM fn GROUP BY doc_id),
ej AS (SELECT fe.doc_id, string_agg('{{"relationship":' || to_json(relationship) || ',"source":' || to_json(src)
                                 || ',"target":' || to_json(dst) || '}}', ',' ORDER BY fn.node_ord, edge_ord) AS links
       FROM fe JOIN fn ON fn.doc_id = fe.doc_id AND fn.node = fe.src GROUP BY fe.doc_id)
SELECT nj.doc_id, '{{"directed":true,"multigraph":false,"graph":{{}},"nodes":[' || nodes || '],"links":['
                  || coalesce(links, '') || ']}}' AS json
FROM nj LEFT JOIN ej USING (doc_id)""")
def field_graph_json(spark, sf):
    """Node-link JSON document per customer graph."""
    return G.records_json(field_records(spark, sf))


@register("field_graph_report", f"""WITH RECURSIVE {SQL_FIELD_WRITES}, {sql_reach('fn', 'fe')},
st AS ({sql_stats('fn', 'fe')}),
cc AS ({sql_components('fn', 'fe')}),
ty AS (SELECT doc_id, string_agg(node_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY node_type) AS node_types
       FROM ({sql_types('fn')}) GROUP BY doc_id),
tp AS (SELECT doc_id, string_agg(node, ',' ORDER BY rank) AS top_nodes FROM ({sql_centrality('fn', 'fe')}) GROUP BY doc_id)
SELECT st.*, cc.is_connected, ty.node_types, tp.top_nodes
FROM st JOIN cc USING (doc_id) JOIN ty USING (doc_id) LEFT JOIN tp USING (doc_id)""")
def field_graph_report(spark, sf):
    """Graph job report (counts, connectivity, types, top nodes) per customer graph."""
    return G.records_report(field_records(spark, sf))


@register("field_graph_job", f"""WITH RECURSIVE {SQL_FIELD_WRITES}, {sql_reach('fn', 'fe')},
st AS ({sql_stats('fn', 'fe')}),
cc AS ({sql_components('fn', 'fe')}),
tp AS (SELECT doc_id, string_agg(node, ',' ORDER BY rank) AS top_nodes FROM ({sql_centrality('fn', 'fe')}) GROUP BY doc_id),
bx AS (SELECT doc_id, string_agg('"' || node || '" [fillcolor="' || CASE node_type WHEN 'document' THEN '#FF6B6B' WHEN 'category' THEN '#4ECDC4'
         WHEN 'list' THEN '#45B7D1' WHEN 'value' THEN '#96CEB4' ELSE '#FFEAA7' END || '"];', ' ' ORDER BY node_ord) AS t FROM fn GROUP BY doc_id),
ar AS (SELECT doc_id, string_agg('"' || src || '" -> "' || dst || '";', ' ' ORDER BY edge_ord) AS t FROM fe GROUP BY doc_id)
SELECT st.doc_id, num_nodes, num_edges, is_connected, top_nodes,
       md5('digraph {{node [style=filled]; edge [color="#95A5A6"]; ' || bx.t || ' ' || ar.t || '}}') AS drawing_md5
FROM st JOIN cc USING (doc_id) JOIN bx USING (doc_id) JOIN ar USING (doc_id) LEFT JOIN tp USING (doc_id)""")
def field_graph_job(spark, sf):
    """The graph job of every customer with its drawing, as chosen by "png"."""
    job = G.records_job(field_records(spark, sf), export_format="png")
    return job.select("doc_id", "num_nodes", "num_edges", "is_connected", "top_nodes", F.md5(F.col("drawing").cast("binary")).alias("drawing_md5"))


# ------------------------------------------------------------- JSON graphs


def event_json(spark, sf):
    """JSON text per event, in three shapes with different keys."""
    ev = read_table(spark, sf, "events")
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    text = (F.when(F.col("event_id") % 3 == 0, F.col("props"))
            .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"event": {"type": "'), t, F.lit('", "props": '), F.col("props"), F.lit("}, \"none\": null}")))
            .otherwise(F.concat(F.lit('{"users": [{"id": '), u, F.lit('}, {"id": '), u, F.lit(', "type": "'), t, F.lit('"}]}'))))
    return ev.select("event_id", text.alias("json"))


SQL_EVENT_GRAPH = """
e AS (SELECT CAST(event_id AS VARCHAR) AS doc_id, event_id % 3 AS shape, event_type AS t, CAST(user_id AS VARCHAR) AS u,
             json_extract_string(props, '$.k') AS k FROM events),
jn AS (SELECT doc_id, 'Document' AS node, 1 AS node_ord, 'document' AS node_type, 0 AS level, NULL::VARCHAR AS value, NULL::INTEGER AS count FROM e
       UNION ALL SELECT doc_id, 'k', 2, 'value', 1, k, NULL FROM e WHERE shape = 0
       UNION ALL SELECT doc_id, 'event', 2, 'category', 1, '{"props":{"k":' || k || '},"type":"' || t || '"}', NULL FROM e WHERE shape = 1
       UNION ALL SELECT doc_id, 'props', 3, 'category', 2, '{"k":' || k || '}', NULL FROM e WHERE shape = 1
       UNION ALL SELECT doc_id, 'k', 4, 'value', 3, k, NULL FROM e WHERE shape = 1
       UNION ALL SELECT doc_id, 'type', 5, 'value', 2, t, NULL FROM e WHERE shape = 1
       UNION ALL SELECT doc_id, 'users', 2, 'list', 1, NULL, 2 FROM e WHERE shape = 2
       UNION ALL SELECT doc_id, 'users_item_1', 3, 'list_item', 2, NULL, NULL FROM e WHERE shape = 2
       UNION ALL SELECT doc_id, 'id', 4, 'value', 3, u, NULL FROM e WHERE shape = 2
       UNION ALL SELECT doc_id, 'users_item_2', 5, 'list_item', 2, NULL, NULL FROM e WHERE shape = 2
       UNION ALL SELECT doc_id, 'type', 6, 'value', 3, t, NULL FROM e WHERE shape = 2),
je AS (SELECT doc_id, 'Document' AS src, 'k' AS dst, 'has_value' AS relationship, 1 AS edge_ord FROM e WHERE shape = 0
       UNION ALL SELECT doc_id, x.s, x.d, x.r, x.o FROM e, (VALUES ('Document', 'event', 'has_field', 1), ('event', 'props', 'has_field', 2),
                 ('props', 'k', 'has_value', 3), ('event', 'type', 'has_value', 4)) x(s, d, r, o) WHERE shape = 1
       UNION ALL SELECT doc_id, x.s, x.d, x.r, x.o FROM e, (VALUES ('Document', 'users', 'has_list', 1), ('users', 'users_item_1', 'contains', 2),
                 ('users_item_1', 'id', 'has_value', 3), ('users', 'users_item_2', 'contains', 4), ('users_item_2', 'id', 'has_value', 5),
                 ('users_item_2', 'type', 'has_value', 6)) x(s, d, r, o) WHERE shape = 2)"""


@register("json_graph_nodes", f"""WITH {SQL_EVENT_GRAPH}
SELECT doc_id, node, CAST(node_ord AS BIGINT) AS node_ord, node_type, CAST(level AS INTEGER) AS level, value, CAST(count AS INTEGER) AS count FROM jn""")
def json_graph_nodes(spark, sf):
    """G1: nodes of every event's JSON text; absent keys give none."""
    return G.json_to_graph(event_json(spark, sf), "event_id", "json")[0]


@register("json_graph_edges", f"""WITH {SQL_EVENT_GRAPH}
SELECT doc_id, src, dst, relationship, CAST(edge_ord AS BIGINT) AS edge_ord FROM je""")
def json_graph_edges(spark, sf):
    """G1: edges of every event's JSON text."""
    return G.json_to_graph(event_json(spark, sf), "event_id", "json")[1]


SQL_ORDERED_GRAPH = """
e AS (SELECT CAST(event_id AS VARCHAR) AS doc_id, event_id % 3 AS shape, event_type AS t, CAST(user_id AS VARCHAR) AS u,
             json_extract_string(props, '$.k') AS k FROM events),
jn AS (SELECT doc_id, 'Document' AS node, 1 AS node_ord, 'document' AS node_type, 0 AS level, NULL::VARCHAR AS value, NULL::INTEGER AS count FROM e
       UNION ALL SELECT doc_id, 'k', 2, 'value', 1, k, NULL FROM e WHERE shape = 0
       UNION ALL SELECT doc_id, 'event', 2, 'category', 1, '{"type":"' || t || '","props":{"k":' || k || '}}', NULL FROM e WHERE shape = 1
       UNION ALL SELECT doc_id, 'type', 3, 'value', 2, t, NULL FROM e WHERE shape = 1
       UNION ALL SELECT doc_id, 'props', 4, 'category', 2, '{"k":' || k || '}', NULL FROM e WHERE shape = 1
       UNION ALL SELECT doc_id, 'k', 5, 'value', 3, k, NULL FROM e WHERE shape = 1
       UNION ALL SELECT doc_id, 'none', 6, 'value', 1, NULL, NULL FROM e WHERE shape = 1
       UNION ALL SELECT doc_id, 'users', 2, 'list', 1, NULL, 2 FROM e WHERE shape = 2
       UNION ALL SELECT doc_id, 'users_item_1', 3, 'list_item', 2, NULL, NULL FROM e WHERE shape = 2
       UNION ALL SELECT doc_id, 'id', 4, 'value', 3, u, NULL FROM e WHERE shape = 2
       UNION ALL SELECT doc_id, 'users_item_2', 5, 'list_item', 2, NULL, NULL FROM e WHERE shape = 2
       UNION ALL SELECT doc_id, 'type', 6, 'value', 3, t, NULL FROM e WHERE shape = 2),
je AS (SELECT doc_id, 'Document' AS src, 'k' AS dst, 'has_value' AS relationship, 1 AS edge_ord FROM e WHERE shape = 0
       UNION ALL SELECT doc_id, x.s, x.d, x.r, x.o FROM e, (VALUES ('Document', 'event', 'has_field', 1), ('event', 'type', 'has_value', 2),
                 ('event', 'props', 'has_field', 3), ('props', 'k', 'has_value', 4), ('Document', 'none', 'has_value', 5)) x(s, d, r, o) WHERE shape = 1
       UNION ALL SELECT doc_id, x.s, x.d, x.r, x.o FROM e, (VALUES ('Document', 'users', 'has_list', 1), ('users', 'users_item_1', 'contains', 2),
                 ('users_item_1', 'id', 'has_value', 3), ('users', 'users_item_2', 'contains', 4), ('users_item_2', 'id', 'has_value', 5),
                 ('users_item_2', 'type', 'has_value', 6)) x(s, d, r, o) WHERE shape = 2)"""


@register("json_ordered_nodes", f"""WITH {SQL_ORDERED_GRAPH}
SELECT doc_id, node, CAST(node_ord AS BIGINT) AS node_ord, node_type, CAST(level AS INTEGER) AS level, value, CAST(count AS INTEGER) AS count FROM jn""")
def json_ordered_nodes(spark, sf):
    """G1: nodes of every event's JSON text in document order, null values included."""
    return JG.json_graph(event_json(spark, sf), "event_id", "json")[0]


@register("json_ordered_edges", f"""WITH {SQL_ORDERED_GRAPH}
SELECT doc_id, src, dst, relationship, CAST(edge_ord AS BIGINT) AS edge_ord FROM je""")
def json_ordered_edges(spark, sf):
    """G1: edges of every event's JSON text in document order."""
    return JG.json_graph(event_json(spark, sf), "event_id", "json")[1]
