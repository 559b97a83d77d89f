"""Nested fields -> property graph, graph statistics and export.

A graph is two tables: ``nodes(doc_id, node, node_ord, node_type, level,
value, count)`` and ``edges(doc_id, src, dst, relationship)``.

``fields_to_graph`` walks the DataFrame *schema* once on the driver and
builds one array expression of node writes and one of edge writes per row
(structs, arrays and maps become ``transform``/``flatten`` expressions), so
emission is narrow.  Node identity is the bare field name within a document:
of repeated writes the latest of each attribute wins and the first fixes the
order.  A document of one row is merged inside its row, so what a task sorts are
its rows, not their writes; rows that share a ``doc_id`` are merged by a
per-(doc, node) aggregate.

A document's graph is one record of its output (its JSON, say), so what is asked of
one graph (connectivity, the job's report) is found on one row per document.  Graphs
with more than ``RECORD_EDGES`` edges are contracted in rounds instead.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.session import checkpoint_dir, spread

CENTRALITY_MAX_NODES = 100
CENTRALITY_TOP = 5
#: edges of a graph that one row holds
RECORD_EDGES = 100_000
EXPORTS = ("json", "png", "both")

# Display colour per node type (others get the default).
NODE_COLOURS = {
    "document": "#FF6B6B",
    "category": "#4ECDC4",
    "list": "#45B7D1",
    "value": "#96CEB4",
}
DEFAULT_COLOUR = "#FFEAA7"

_ORD = T.ArrayType(T.IntegerType())


def _ord(base: Column, *tail) -> Column:
    return F.concat(base, F.array(*[t if isinstance(t, Column) else F.lit(t) for t in tail]).cast(_ORD))


def _node(name, ord_, node_type, level, value=None, count=None) -> Column:
    return F.struct(
        (name if isinstance(name, Column) else F.lit(name)).alias("node"),
        ord_.alias("ord"),
        F.lit(node_type).alias("node_type"),
        (level if isinstance(level, Column) else F.lit(level)).cast("int").alias("level"),
        (value if value is not None else F.lit(None)).cast("string").alias("value"),
        F.lit(value is not None).alias("has_value"),
        (count if count is not None else F.lit(None)).cast("int").alias("count"),
        F.lit(count is not None).alias("has_count"),
    )


def _edge(src, dst, rel, ord_) -> Column:
    return F.struct(
        (src if isinstance(src, Column) else F.lit(src)).alias("src"),
        (dst if isinstance(dst, Column) else F.lit(dst)).alias("dst"),
        F.lit(rel).alias("relationship"),
        ord_.alias("ord"),
    )


def _scalar_text(v: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(v)
    return v.cast("string")


def _emit(key, v: Column, dtype: T.DataType, parent, level: int, path: Column, skip_null: bool = False):
    """(nodes array, edges array) for one field written under ``parent``.  A null
    value is written as a plain value, or not at all with ``skip_null``."""
    name = key if isinstance(key, Column) else F.lit(key)
    here = _ord(path, 0)
    scalar = (F.array(_node(name, here, "value", level, _scalar_text(v, dtype))),
              F.array(_edge(parent, name, "has_value", here)))

    def below(i) -> Column:
        return F.concat(path, F.array(i if isinstance(i, Column) else F.lit(i)).cast(_ORD))

    if isinstance(dtype, (T.StructType, T.MapType)):
        nodes, edges = _children(v, dtype, name, level + 1, below, skip_null)
        res = (F.concat(F.array(_node(name, here, "category", level, F.to_json(v))), nodes),
               F.concat(F.array(_edge(parent, name, "has_field", here)), edges))
    elif isinstance(dtype, T.ArrayType):
        et = dtype.elementType

        def per_item(which: int):
            def emit(x, i):
                item, at = F.concat(name, F.lit("_item_"), (i + 1).cast("string")), _ord(path, i + 1, 0)
                edge = F.array(_edge(name, item, "contains", at))
                plain = F.array(_node(item, at, "value", level + 1, _scalar_text(x, et)))
                if not isinstance(et, (T.StructType, T.MapType)):
                    return (plain, edge)[which]
                kids = _children(x, et, item, level + 2, lambda j: F.concat(below(i + 1), F.array(j if isinstance(j, Column) else F.lit(j)).cast(_ORD)), skip_null)
                own = F.when(x.isNull(), plain).otherwise(F.array(_node(item, at, "list_item", level + 1)))
                head = (own, edge)[which]
                return F.when(x.isNull(), head).otherwise(F.concat(head, kids[which]))

            return F.flatten(F.transform(v, emit))

        res = (F.concat(F.array(_node(name, here, "list", level, count=F.size(v))), per_item(0)),
               F.concat(F.array(_edge(parent, name, "has_list", here)), per_item(1)))
    else:
        res = scalar
    if skip_null:
        return tuple(F.when(v.isNotNull(), r).otherwise(F.slice(plain, 1, 0)) for plain, r in zip(scalar, res))
    if res is scalar:
        return scalar
    return tuple(F.when(v.isNull(), plain).otherwise(r) for plain, r in zip(scalar, res))


def _children(v: Column, dtype: T.DataType, parent: Column, level: int, below, skip_null: bool):
    """(nodes array, edges array) of all entries of a struct or map, at any depth;
    ``below(i)`` is the path of the i-th entry."""
    if isinstance(dtype, T.StructType):
        parts = [_emit(f.name, v[f.name], f.dataType, parent, level, below(j + 1), skip_null) for j, f in enumerate(dtype.fields)]
        if not parts:
            nothing = _emit("", F.lit(None).cast("string"), T.StringType(), parent, level, below(0), True)
            return nothing
        return tuple(F.concat(*x) for x in zip(*parts))
    return tuple(F.flatten(F.transform(F.map_entries(v), lambda e, i: _emit(
        e["key"].cast("string"), e["value"], dtype.valueType, parent, level, below(i + 1), skip_null)[which])) for which in (0, 1))


def _row_writes(df: DataFrame, doc_id: str, fields: list[str] | None, root: str, skip_null: bool, parted: bool):
    """(doc_id, _n, _e), the node and edge writes of each row.  Rows are dealt by document
    while they are small: writes, many times larger, are made and merged where they are.
    ``parted``: two such tables, of rows that are a document's only one and of the others."""
    schema = df.schema
    fields = fields or [f.name for f in schema.fields if f.name != doc_id]
    df = spread(df.select(F.col(doc_id).cast("string").alias("doc_id"), F.struct(*fields).alias("_row")), "doc_id")
    nodes = [F.array(_node(F.lit(root), F.array(F.lit(0)).cast(_ORD), "document", 0))]
    edges = []
    for i, name in enumerate(fields):
        n, e = _emit(name, F.col("_row")[name], schema[name].dataType, F.lit(root), 1, F.array(F.lit(i + 1)).cast(_ORD), skip_null)
        nodes.append(n)
        edges.append(e)
    written = ["doc_id", F.concat(*nodes).alias("_n"), F.concat(*edges).alias("_e")]
    if not parted:
        return df.select(*written)
    df = df.withColumn("_rows", F.count("*").over(Window.partitionBy("doc_id")))
    return df.where("_rows = 1").select(*written), df.where("_rows > 1").select(*written)


def graph_writes(df: DataFrame, doc_id: str, fields: list[str] | None = None, root: str = "Document", skip_null: bool = False):
    """Node and edge write tables (before identity merge)."""
    w = _row_writes(df, doc_id, fields, root, skip_null, False)
    return w.select("doc_id", F.inline("_n")), w.select("doc_id", F.inline("_e"))


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merged(writes: Column, names: list[str], merge) -> Column:
    """One row's writes, an array in the order of writing, with those of equal ``names``
    merged: ``merge(run)`` of each run (structs of ``names``, place ``at`` and write ``x``,
    by place), in the order of the first writes.  One sort, whatever the array's length."""
    keyed = F.sort_array(F.transform(writes, lambda x, i: F.struct(*[x[n].alias(n) for n in names], i.alias("at"), x.alias("x"))))

    def merge_sorted(s: Column) -> Column:
        def begins(i: Column) -> Column:
            new = i == 0
            for n in names:
                new = new | (F.get(s, i - 1)[n] != F.get(s, i)[n])
            return new

        starts = F.filter(F.transform(s, lambda x, i: i), begins)
        return _once(starts, lambda b: F.sort_array(F.transform(
            b, lambda i, j: merge(F.slice(s, i + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - i)))))

    return _once(keyed, merge_sorted)


def _merged_nodes(writes: Column) -> Column:
    """G3 of one row: its nodes in order."""
    def merge(run: Column) -> Column:
        last = F.element_at(run, -1)["x"]

        def latest(name: str) -> Column:
            return F.try_element_at(F.filter(run, lambda r: r["x"][f"has_{name}"]), F.lit(-1))["x"][name].alias(name)

        return F.struct(F.get(run, F.lit(0))["at"].alias("at"), last["node"].alias("node"), last["node_type"].alias("node_type"),
                        last["level"].alias("level"), latest("value"), latest("count"))

    return F.transform(_merged(writes, ["node"], merge), lambda x, i: F.struct(
        (i + 1).cast("bigint").alias("node_ord"), *[x[c].alias(c) for c in ("node", "node_type", "level", "value", "count")]))


def _merged_edges(writes: Column) -> Column:
    """G3 of one row: its edges in order."""
    def merge(run: Column) -> Column:
        last = F.element_at(run, -1)["x"]
        return F.struct(F.get(run, F.lit(0))["at"].alias("at"), *[last[c].alias(c) for c in ("src", "dst", "relationship")])

    return F.transform(_merged(writes, ["src", "dst"], merge), lambda x, i: F.struct(
        (i + 1).cast("bigint").alias("edge_ord"), *[x[c].alias(c) for c in ("src", "dst", "relationship")]))


def _as_written(dtype: T.DataType) -> T.DataType:
    """``dtype`` with numbers that have a fraction, nulls and mixed types as text."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _as_written(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_as_written(dtype.elementType))
    return dtype if isinstance(dtype, (T.LongType, T.BooleanType)) else T.StringType()


def json_to_graph(df: DataFrame, doc_id: str, text: str, root: str = "Document"):
    """G1 from JSON text, one object per row: (nodes, edges).  One aggregate over the
    rows finds the keys; keys that a row lacks or holds null under are not written,
    keys come in alphabetical order.  Text that is null, no object or no JSON leaves
    the root node alone."""
    df = spread(df.select(F.col(doc_id), F.col(text)))  # texts are read in many tasks, whatever the scan's splits
    objects = df.where(F.col(text).rlike(r"^\s*\{"))
    found = objects.select(F.expr(f"schema_of_variant_agg(try_parse_json(`{text}`))")).first()[0]
    if not found or not found.startswith("OBJECT<"):
        fields = T.StructType([])
    else:
        fields = _as_written(T.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<")))
    if not fields.fields:
        bare = df.select(F.col(doc_id).alias("_id"), F.lit(None).cast("string").alias("none"))
        return fields_to_graph(bare, "_id", root=root, skip_null=True)
    rows = df.select(F.col(doc_id).alias("_id"), F.from_json(F.col(text), fields).alias("_j"))
    named = rows.select("_id", *[F.col("_j")[f.name].alias(f.name) for f in fields.fields])
    return fields_to_graph(named, "_id", [f.name for f in fields.fields], root, skip_null=True)


def merge_writes(node_writes: DataFrame, edge_writes: DataFrame):
    """One node per (doc, name): latest write of each attribute wins,
    absent attributes persist, first write fixes ``node_ord``; one edge per
    (doc, src, dst) with the latest relationship; ``edge_ord`` is the order in
    which the edges were first written."""
    nodes = node_writes.groupBy("doc_id", "node").agg(
        F.min("ord").alias("_first"),
        F.max_by("node_type", "ord").alias("node_type"),
        F.max_by("level", "ord").alias("level"),
        F.expr("max_by(value, ord) FILTER (WHERE has_value)").alias("value"),
        F.expr("max_by(count, ord) FILTER (WHERE has_count)").alias("count"),
    )
    w = Window.partitionBy("doc_id").orderBy("_first")
    nodes = nodes.withColumn("node_ord", F.row_number().over(w).cast("bigint")) \
        .select("doc_id", "node", "node_ord", "node_type", "level", "value", "count")
    edges = edge_writes.groupBy("doc_id", "src", "dst").agg(
        F.max_by("relationship", "ord").alias("relationship"), F.min("ord").alias("_first"))
    edges = edges.withColumn("edge_ord", F.row_number().over(w).cast("bigint")).drop("_first")
    return nodes, edges


def fields_to_graph(df: DataFrame, doc_id: str, fields: list[str] | None = None, root: str = "Document", skip_null: bool = False):
    """(nodes, edges) of every row's nested fields.  A null is a value, or
    with ``skip_null`` an absent key."""
    one, more = _row_writes(df, doc_id, fields, root, skip_null, True)
    nodes, edges = merge_writes(more.select("doc_id", F.inline("_n")), more.select("doc_id", F.inline("_e")))
    return (one.select("doc_id", F.inline(_merged_nodes(F.col("_n")))).select(*nodes.columns).unionByName(nodes),
            one.select("doc_id", F.inline(_merged_edges(F.col("_e")))).select(*edges.columns).unionByName(edges))


def fields_to_records(df: DataFrame, doc_id: str, fields: list[str] | None = None, root: str = "Document", skip_null: bool = False) -> DataFrame:
    """``graph_records`` of ``fields_to_graph``: the graph of a document of one row never
    leaves its row."""
    one, more = _row_writes(df, doc_id, fields, root, skip_null, True)
    records = graph_records(*merge_writes(more.select("doc_id", F.inline("_n")), more.select("doc_id", F.inline("_e"))))
    edges = _merged_edges(F.when(F.col("doc_id").isNotNull(), F.col("_e")).otherwise(F.slice("_e", 1, 0)))  # a null id joins no edges
    return one.select("doc_id", _merged_nodes(F.col("_n")).alias("n"), edges.alias("e")).unionByName(records)


# ---------------------------------------------------------------- statistics


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """num_nodes, num_edges, is_directed per document (one aggregation
    over the union of both tables)."""
    u = nodes.select("doc_id", F.lit(1).alias("_n"), F.lit(0).alias("_e")).unionByName(
        edges.select("doc_id", F.lit(0).alias("_n"), F.lit(1).alias("_e")))
    return u.groupBy("doc_id").agg(F.sum("_n").cast("bigint").alias("num_nodes"),
                                   F.sum("_e").cast("bigint").alias("num_edges")) \
        .filter(F.col("num_nodes") > 0).withColumn("is_directed", F.lit(True))


def node_type_counts(nodes: DataFrame) -> DataFrame:
    """Node count per (document, type); a missing type counts as 'unknown'."""
    return nodes.groupBy("doc_id", F.coalesce("node_type", F.lit("unknown")).alias("node_type")) \
        .agg(F.count("*").cast("bigint").alias("n"))


def node_colours(nodes: DataFrame) -> DataFrame:
    """Display colour per node from its type."""
    return nodes.withColumn("colour", _colour(F.col("node_type")))


def _colour(node_type: Column) -> Column:
    expr = F.lit(DEFAULT_COLOUR)
    for t, c in reversed(list(NODE_COLOURS.items())):
        expr = F.when(node_type == t, F.lit(c)).otherwise(expr)
    return expr


def degree_centrality(nodes: DataFrame, edges: DataFrame, top: int = CENTRALITY_TOP,
                      max_nodes: int = CENTRALITY_MAX_NODES) -> DataFrame:
    """Top nodes by (in+out degree)/(n-1), only for graphs below
    ``max_nodes`` nodes; ties by node order.  A one-node graph scores 1.0."""
    u = nodes.select("doc_id", "node", "node_ord", F.lit(0).alias("_d")).unionByName(
        edges.select("doc_id", F.explode(F.array("src", "dst")).alias("node"),
                     F.lit(None).cast("bigint").alias("node_ord"), F.lit(1).alias("_d")))
    # exchanged once by document; node count and top-k reuse that partitioning
    per_node = u.repartition("doc_id").groupBy("doc_id", "node").agg(
        F.max("node_ord").alias("node_ord"), F.sum("_d").alias("deg")).filter(F.col("node_ord").isNotNull())
    wdoc = Window.partitionBy("doc_id")
    scored = per_node.withColumn("n", F.count("*").over(wdoc)).filter(F.col("n") < max_nodes).withColumn(
        "centrality", F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("deg") / (F.col("n") - 1)))
    w = Window.partitionBy("doc_id").orderBy(F.col("centrality").desc(), F.col("node_ord"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top) \
        .select("doc_id", F.col("rank").cast("bigint").alias("rank"), "node", "centrality")


def graph_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per document: ``n`` and ``e``, its nodes and edges in order."""
    place = F.col("edge_ord") if "edge_ord" in edges.columns else F.lit(0)
    of_node = [c for c in ("node_ord", "node", "node_type", "level", "value", "count") if c in nodes.columns]
    of_edge = [place.alias("edge_ord"), *[c for c in ("src", "dst", "relationship") if c in edges.columns]]
    n = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*of_node))).alias("n"))
    e = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*of_edge))).alias("e"))
    return n.join(e, "doc_id", "left").withColumn("e", F.coalesce("e", F.array().cast(e.schema["e"].dataType)))


def _components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of each of n points' component: roots hook to smaller roots
    they touch, then every path is halved until it ends; at most log2(n) rounds."""
    up = np.arange(n)
    while True:
        a, b = up[u], up[v]
        open_ = a != b
        if not open_.any():
            return up
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, up[up]):
            up = up[up]


def _metrics():
    """Per row of (node names, sources, targets): component labels, their number and
    the degrees.  All graphs of a batch are one array of points."""

    @F.arrow_udf("struct<labels:array<int>,components:bigint,degrees:array<int>>")
    def graph_metrics(nodes: pa.Array, src: pa.Array, dst: pa.Array) -> pa.Array:
        size = nodes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        edges = src.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(size)))
        names = pa.chunked_array([nodes.flatten(), src.flatten(), dst.flatten()]).combine_chunks().dictionary_encode()
        code = names.indices.fill_null(len(names.dictionary)).to_numpy().astype(np.int64)
        doc, edge_doc = np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(size)), edges)
        key = np.concatenate((doc, edge_doc, edge_doc)) * (len(names.dictionary) + 1) + code
        point, ends = key[:begin[-1]], key[begin[-1]:].reshape(2, -1)
        order = np.argsort(point, kind="stable")
        at = np.searchsorted(point[order], ends)
        at[at == len(point)] = 0
        known = (point[order][at] == ends) if len(point) else np.zeros(ends.shape, dtype=bool)
        at = order[at] if len(point) else at
        degree = np.bincount(at[known], minlength=len(point))
        both = known.all(axis=0)
        label = _components(len(point), at[0][both], at[1][both])
        roots = np.bincount(doc[label == np.arange(len(point))], minlength=len(size))
        offsets = pa.array(begin, pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(label - begin[doc], pa.int32())), pa.array(roots, pa.int64()),
             pa.ListArray.from_arrays(offsets, pa.array(degree, pa.int32()))], names=["labels", "components", "degrees"])

    return graph_metrics


def _with_metrics(records: DataFrame) -> DataFrame:
    """``graph_records`` with the column ``m``."""
    return records.withColumn("m", _metrics()(F.col("n.node"), F.col("e.src"), F.col("e.dst")))


def contract(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, u, label) for each end of an edge (doc_id, u, v) between numbered nodes,
    and the rounds taken.  Every round links a node's larger neighbours to its smallest
    neighbour and then its smaller ones, so that paths shrink by a factor and stars
    stay.  A round is written to the shared folder and the one before it removed."""
    spark = pairs.sparkSession
    folder = os.path.join(checkpoint_dir(spark), f"contract-{uuid.uuid4().hex}")
    jvm = spark.sparkContext._jvm

    def written(df: DataFrame, rnd: int) -> DataFrame:
        at = os.path.join(folder, str(rnd))
        df.write.parquet(at)
        if rnd:
            old = jvm.org.apache.hadoop.fs.Path(os.path.join(folder, str(rnd - 1)))
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        return spark.read.parquet(at)

    def smallest(side: DataFrame) -> DataFrame:
        return side.groupBy("doc_id", "u").agg(F.min("v").alias("m"))

    now = written(pairs.where("u <> v").select("doc_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 0)
    rnd, before = 0, None
    while True:
        # a star of every component has one edge per node, all to its smallest node
        state = tuple(now.agg(F.count("*"), F.count_distinct("doc_id", "u"), F.sum(F.xxhash64("doc_id", "u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before, rnd = state, rnd + 1
        both = now.unionByName(now.select("doc_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), ["doc_id", "u"]).where("v > u").select("doc_id", F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        least = smallest(large)
        small = large.join(least, ["doc_id", "u"]).where("v <> m").select("doc_id", F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("doc_id", "u", F.col("m").alias("v"))).distinct()
        now = written(small, rnd)
    return now.select("doc_id", "u", F.col("v").alias("label")).unionByName(
        now.select("doc_id", F.col("v").alias("u"), F.col("v").alias("label")).distinct()), rnd


def _numbered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between known nodes as (doc_id, u, v) of node numbers."""
    at = nodes.select("doc_id", "node", "node_ord")
    return edges.join(at.select("doc_id", F.col("node").alias("src"), F.col("node_ord").alias("u")), ["doc_id", "src"]) \
        .join(at.select("doc_id", F.col("node").alias("dst"), F.col("node_ord").alias("v")), ["doc_id", "dst"]).select("doc_id", "u", "v")


def _split(nodes: DataFrame, edges: DataFrame, largest: int):
    """(records of graphs that one row holds, (nodes, edges) of the others or None)."""
    nodes, edges = nodes.select("doc_id", "node_ord", "node"), edges.select("doc_id", "src", "dst")
    large = edges.groupBy("doc_id").agg(F.count("*").alias("_n")).where(F.col("_n") > largest).select("doc_id")
    if large.isEmpty():
        return graph_records(nodes, edges), None
    few = [t.join(large, "doc_id", "left_anti") for t in (nodes, edges)]
    return graph_records(*few), [t.join(large, "doc_id", "left_semi") for t in (nodes, edges)]


def weak_components(nodes: DataFrame, edges: DataFrame, largest: int = RECORD_EDGES) -> DataFrame:
    """(doc_id, node, label), the smallest ``node_ord`` of the node's weak
    component.  Edge ends that are no nodes connect nothing."""
    records, large = _split(nodes, edges, largest)
    out = _with_metrics(records).select("doc_id", F.posexplode("n").alias("i", "x"), "n", "m.labels") \
        .select("doc_id", "x.node", F.get("n", F.get("labels", F.col("i")))["node_ord"].alias("label"))
    if large is None:
        return out
    found, _ = contract(_numbered(*large))
    return out.unionByName(large[0].join(found.withColumnRenamed("u", "node_ord"), ["doc_id", "node_ord"], "left")
                           .select("doc_id", "node", F.coalesce("label", "node_ord").alias("label")))


def connectivity(nodes: DataFrame, edges: DataFrame, largest: int = RECORD_EDGES) -> DataFrame:
    """is_connected per document (exactly one weak component)."""
    records, large = _split(nodes, edges, largest)
    out = _with_metrics(records).select("doc_id", F.col("m.components").alias("n_components"))
    if large is not None:
        found, _ = contract(_numbered(*large))
        # a component has one node that is its own label; nodes without an edge are one each
        loose = large[0].join(found.withColumnRenamed("u", "node_ord"), ["doc_id", "node_ord"], "left") \
            .where("label is null or label = node_ord")
        out = out.unionByName(loose.groupBy("doc_id").agg(F.count("*").alias("n_components")))
    return out.withColumn("is_connected", F.col("n_components") == 1)


def _node_link(n: str, e: str, edges_key: str = "links") -> Column:
    """Node-link JSON text of a record's nodes and edges, links in the order of their
    source nodes, then as they were written."""
    attributes = F.transform(n, lambda x: F.struct(x["node_type"].alias("node_type"), x["level"].alias("level"), x["value"].alias("value"),
                                                   x["count"].alias("count"), x["node"].alias("id")))
    keyed = F.transform(e, lambda x: F.struct(F.array_position(F.col(n)["node"], x["src"]).alias("at"), x["edge_ord"].alias("edge_ord"), x["dst"].alias("dst"),
                                              F.struct(x["relationship"].alias("relationship"), x["src"].alias("source"), x["dst"].alias("target")).alias("a")))
    links = F.transform(F.array_sort(keyed), lambda x: x["a"])
    return F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), F.create_map().cast("map<string,string>").alias("graph"),
                              attributes.alias("nodes"), links.alias(edges_key)))


def graph_json(nodes: DataFrame, edges: DataFrame, edges_key: str = "links") -> DataFrame:
    """Node-link JSON per document (directed, not a multigraph); links in the
    order of their source nodes, then as they were written (by target name for
    edges without ``edge_ord``)."""
    return records_json(graph_records(nodes, edges), edges_key)


def records_json(records: DataFrame, edges_key: str = "links") -> DataFrame:
    """S9 of ``graph_records``."""
    return records.select("doc_id", _node_link("n", "e", edges_key).alias("json"))


def _drawing(n: str, e: str) -> Column:
    """The graph as DOT text: nodes filled in the colour of their type, edges grey."""
    def name(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    boxes = F.transform(n, lambda x: F.concat(name(x["node"]), F.lit(' [fillcolor="'), _colour(x["node_type"]), F.lit('"];')))
    arrows = F.transform(e, lambda x: F.concat(name(x["src"]), F.lit(" -> "), name(x["dst"]), F.lit(";")))
    return F.concat(F.lit('digraph {node [style=filled]; edge [color="#95A5A6"]; '), F.array_join(F.concat(boxes, arrows), " "), F.lit("}"))


# ---------------------------------------------------------------- invoices


def invoice_writes(invoices: DataFrame, items: DataFrame, item_fields: list[str]) -> DataFrame:
    """(doc_id, _n, _e), arrays of nodes and edges of invoice graphs from flat
    tables, no nested collection.

    ``invoices``: doc_id, invoice_number, date, total, vendor, customer
    (a null field counts as absent).  ``items``: doc_id, item_no (1-based
    position in the item list), and the ``item_fields`` columns.  Node order
    is computed arithmetically: root, present metadata, Items, then each item
    followed by its details.  Each input row emits its nodes and edges as one
    array (single scan per input, no union of re-evaluated branches).
    """
    meta = ["date", "total", "vendor", "customer"]
    root = F.concat(F.lit("Invoice_"), F.coalesce(F.col("invoice_number").cast("string"), F.lit("Unknown")))
    present = [F.col(k).isNotNull().cast("int") for k in meta]
    inv = invoices.select(F.col("doc_id").cast("string").alias("doc_id"), root.alias("_root"), *meta,
                          *[p.alias(f"_p{i}") for i, p in enumerate(present)])
    n_meta = sum([F.col(f"_p{i}") for i in range(1, 4)], F.col("_p0"))

    def node(name, ord_, typ, level, value=None):
        return F.struct(name.alias("node"), ord_.cast("bigint").alias("node_ord"), F.lit(typ).alias("node_type"),
                        F.lit(level).alias("level"),
                        (value if value is not None else F.lit(None)).cast("string").alias("value"),
                        F.lit(None).cast("int").alias("count"))

    def edge(src, dst, rel):
        return F.struct(src.alias("src"), dst.alias("dst"), (rel if isinstance(rel, Column) else F.lit(rel)).alias("relationship"))

    inv_nodes = [node(F.col("_root"), F.lit(1), "invoice", 0)]
    inv_edges = []
    for i, k in enumerate(meta):
        before = sum([F.col(f"_p{j}") for j in range(i)], F.lit(0))
        name = F.concat(F.lit(k + "_"), F.col(k).cast("string"))
        inv_nodes.append(F.when(F.col(k).isNotNull(), node(name, before + 2, "metadata", 1, F.col(k))))
        inv_edges.append(F.when(F.col(k).isNotNull(), edge(F.col("_root"), name, k)))
    inv_nodes.append(node(F.lit("Items"), n_meta + 2, "items_list", 1))
    inv_edges.append(edge(F.col("_root"), F.lit("Items"), "contains"))
    inv_w = inv.select("doc_id", F.array(*inv_nodes).alias("_n"), F.array(*inv_edges).alias("_e"))

    it = items.select(F.col("doc_id").cast("string").alias("doc_id"), "item_no", *item_fields) \
        .join(inv.select("doc_id", n_meta.alias("_n_meta")), "doc_id")
    stride = 1 + len(item_fields)
    item = F.concat(F.lit("Item_"), F.col("item_no").cast("string"))
    base = F.col("_n_meta") + 2 + (F.col("item_no") - 1) * stride + 1
    it_nodes = [node(item, base, "item", 2)] + [
        node(F.concat(item, F.lit("_" + k)), base + j + 1, "item_detail", 3, F.col(k)) for j, k in enumerate(item_fields)]
    it_edges = [edge(F.lit("Items"), item, "has_item")] + [
        edge(item, F.concat(item, F.lit("_" + k)), k) for k in item_fields]
    it_w = it.select("doc_id", F.array(*it_nodes).alias("_n"), F.array(*it_edges).alias("_e"))

    keep = lambda c: F.filter(c, lambda x: x.isNotNull()).alias(c)
    return inv_w.select("doc_id", keep("_n"), keep("_e")).unionByName(it_w)  # an item's nodes and edges are all there


def invoice_graph(invoices: DataFrame, items: DataFrame, item_fields: list[str]):
    """(nodes, edges) of ``invoice_writes``."""
    writes = invoice_writes(invoices, items, item_fields)
    return writes.select("doc_id", F.inline("_n")), writes.select("doc_id", F.inline("_e"))


def invoice_connectivity(invoices: DataFrame, items: DataFrame, item_fields: list[str], largest: int = RECORD_EDGES) -> DataFrame:
    """G7 of ``invoice_graph``: items are counted per document before anything moves, and
    every graph is made whole on the row of its document, its nodes and edges never being
    rows.  Graphs of more than ``largest`` edges are contracted from ``invoice_graph``."""
    invoices, items = (t.withColumn("doc_id", F.col("doc_id").cast("string")) for t in (invoices, items))
    meta, stride = ["date", "total", "vendor", "customer"], 1 + len(item_fields)
    size = items.select("doc_id", F.lit(1).alias("_k"), F.lit(0).alias("_i")).unionByName(
        invoices.select("doc_id", F.lit(0).alias("_k"), F.lit(1).alias("_i"))).groupBy("doc_id").agg(F.sum("_k").alias("_k"), F.sum("_i").alias("_i"))
    large = size.where(F.col("_i") * (1 + len(meta) + F.col("_k") * stride) > largest).select("doc_id")
    if not large.isEmpty():
        few = [t.join(large, "doc_id", "left_anti") for t in (invoices, items)]
        rest = [t.join(large, "doc_id", "left_semi") for t in (invoices, items)]
        return invoice_connectivity(*few, item_fields, largest=1 << 62).unionByName(connectivity(*invoice_graph(*rest, item_fields), largest))

    root = F.concat(F.lit("Invoice_"), F.coalesce(F.col("invoice_number").cast("string"), F.lit("Unknown")))
    named = [F.concat(F.lit(f"{c}_"), F.col(c).cast("string")) for c in meta]
    heads = invoices.groupBy("doc_id").agg(F.collect_list(F.struct(root.alias("root"), F.array_compact(F.array(*named)).alias("meta"))).alias("_inv"))
    one = heads.join(items.groupBy("doc_id").agg(F.count("*").alias("_k")), "doc_id", "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    places = F.slice(F.sequence(F.lit(1).cast("bigint"), F.greatest("_k", F.lit(1))), 1, F.col("_k").cast("int"))
    item = lambda i: F.concat(F.lit("Item_"), i.cast("string"))
    details = lambda i: [F.concat(item(i), F.lit(f"_{c}")) for c in item_fields]
    edge = lambda src, dst: F.struct(src.alias("src"), dst.alias("dst"))
    of_items = F.flatten(F.transform(places, lambda i: F.array(item(i), *details(i))))
    under = F.flatten(F.transform(places, lambda i: F.array(edge(F.lit("Items"), item(i)), *[edge(item(i), d) for d in details(i)])))
    records = one.select("doc_id", "_inv", of_items.alias("_of_items"), under.alias("_under")).select(
        "doc_id", F.flatten(F.transform("_inv", lambda x: F.concat(F.array(x["root"], F.lit("Items")), x["meta"], F.col("_of_items")))).alias("n"),
        F.when(F.col("doc_id").isNotNull(), F.flatten(F.transform("_inv", lambda x: F.concat(  # a null id joins no edges
            F.array(edge(x["root"], F.lit("Items"))), F.transform(x["meta"], lambda m: edge(x["root"], m)), F.col("_under"))))).alias("e"))
    m = _metrics()(F.col("n"), F.coalesce("e.src", F.array().cast("array<string>")), F.coalesce("e.dst", F.array().cast("array<string>")))
    return records.select("doc_id", m["components"].alias("n_components")).withColumn("is_connected", F.col("n_components") == 1)


def written_counts(writes: DataFrame) -> DataFrame:
    """G5 from ``invoice_writes``, whose nodes and edges are all different."""
    return writes.groupBy("doc_id").agg(F.sum(F.size("_n")).cast("bigint").alias("num_nodes"),
                                        F.sum(F.size("_e")).cast("bigint").alias("num_edges")).withColumn("is_directed", F.lit(True))


def invoice_centrality(invoices: DataFrame, items: DataFrame, item_fields: list[str], top: int = CENTRALITY_TOP,
                       max_nodes: int = CENTRALITY_MAX_NODES) -> DataFrame:
    """G8 of ``invoice_graph``, found without its nodes: a tree's degrees follow from
    the number of items, so items are counted per document before anything moves, and
    only nodes that can be among the ``top`` are named: the root, the list, the first
    items, and leaves in node order."""
    meta, stride = ["date", "total", "vendor", "customer"], 1 + len(item_fields)
    counts = items.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count("*").alias("k"))
    root = F.concat(F.lit("Invoice_"), F.coalesce(F.col("invoice_number").cast("string"), F.lit("Unknown")))
    inv = invoices.select(F.col("doc_id").cast("string").alias("doc_id"), root.alias("root"), *[F.col(c).cast("string").alias(c) for c in meta],
                          sum((F.col(c).isNotNull().cast("int") for c in meta), F.lit(0)).alias("m"))
    one = inv.join(counts, "doc_id", "left").withColumn("k", F.coalesce("k", F.lit(0))).withColumn("n", F.col("m") + 2 + F.col("k") * stride).where(F.col("n") < max_nodes)

    def node(name: Column, place: Column, degree: Column) -> Column:
        return F.struct((-degree).cast("bigint").alias("d"), place.cast("bigint").alias("node_ord"), name.alias("node"))

    def item(i: Column) -> Column:
        return F.concat(F.lit("Item_"), i.cast("string"))

    def place(i: Column) -> Column:
        return F.col("m") + 2 + (i - 1) * stride + 1

    heads = [node(F.col("root"), F.lit(1), F.col("m") + 1), node(F.lit("Items"), F.col("m") + 2, F.col("k") + 1)]
    for j, c in enumerate(meta):
        before = sum((F.col(x).isNotNull().cast("int") for x in meta[:j]), F.lit(0))
        heads.append(F.when(F.col(c).isNotNull(), node(F.concat(F.lit(f"{c}_"), F.col(c)), before + 2, F.lit(1))))
    first = F.slice(F.sequence(F.lit(1).cast("bigint"), F.greatest("k", F.lit(1))), 1, F.least(F.lit(top), F.col("k")).cast("int"))
    own = F.transform(first, lambda i: F.array(node(item(i), place(i), F.lit(stride)), *[
        node(F.concat(item(i), F.lit(f"_{c}")), place(i) + j + 1, F.lit(1)) for j, c in enumerate(item_fields)]))
    best = F.slice(F.array_sort(F.concat(F.array_compact(F.array(*heads)), F.flatten(own))), 1, top)
    return one.select("doc_id", "n", F.posexplode(best).alias("i", "x")).select(
        "doc_id", (F.col("i") + 1).cast("bigint").alias("rank"), "x.node",
        F.when(F.col("n") == 1, F.lit(1.0)).otherwise(-F.col("x.d") / (F.col("n") - 1)).alias("centrality"))


def graph_job(nodes: DataFrame, edges: DataFrame, export_format: str = "json", top: int = CENTRALITY_TOP,
              max_nodes: int = CENTRALITY_MAX_NODES) -> DataFrame:
    """The graph job, one row per document in one pass over its record: counts,
    connectivity, node-type distribution and the top central nodes (both as text, types
    by name, nodes in rank order; none for graphs of ``max_nodes`` nodes or more), and
    the exports chosen: ``json`` (node-link text) for "json" and "both", ``drawing`` (DOT
    text with node colours) for "png" and "both", else null."""
    return records_job(graph_records(nodes, edges), export_format, top, max_nodes)


def records_job(records: DataFrame, export_format: str = "json", top: int = CENTRALITY_TOP, max_nodes: int = CENTRALITY_MAX_NODES) -> DataFrame:
    """G10 of ``graph_records``."""
    if export_format not in EXPORTS:
        raise ValueError(f"export_format must be one of {EXPORTS}, got {export_format!r}")
    rows = _with_metrics(records)
    types = F.transform("n", lambda x: F.coalesce(x["node_type"], F.lit("unknown")))
    spread = F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.concat(t, F.lit(":"), F.size(F.filter(types, lambda x: x == t)).cast("string")))
    ranked = F.array_sort(F.transform(F.arrays_zip(F.col("n.node").alias("node"), F.col("m.degrees").alias("d")), lambda x, i: F.struct((-x["d"]).alias("d"), i.alias("i"), x["node"].alias("node"))))
    chosen = lambda name, c: c if export_format in (name, "both") else F.lit(None).cast("string")
    return rows.select(
        "doc_id", F.size("n").cast("bigint").alias("num_nodes"), F.size("e").cast("bigint").alias("num_edges"), F.lit(True).alias("is_directed"),
        (F.col("m.components") == 1).alias("is_connected"), F.array_join(spread, ",").alias("node_types"),
        F.when(F.size("n") < max_nodes, F.array_join(F.transform(F.slice(ranked, 1, top), lambda x: x["node"]), ",")).alias("top_nodes"),
        chosen("json", _node_link("n", "e")).alias("json"), chosen("png", _drawing("n", "e")).alias("drawing"))


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph job's statistics alone."""
    return records_report(graph_records(nodes, edges))


def records_report(records: DataFrame) -> DataFrame:
    """``graph_report`` of ``graph_records``."""
    return records_job(records).drop("json", "drawing")
