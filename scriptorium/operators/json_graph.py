"""Graphs from JSON text in document order (G1).

One row-local walk over each text writes its nodes and edges in the order in which the
keys stand; a key that holds null is a value without text, an absent key is nothing.
Numbers keep the digits they are written with.  The writes then merge as those of nested
columns do (``graph.merge_writes``).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.graph import merge_writes

_NODE = [("node", pa.string()), ("ord", pa.list_(pa.int32())), ("node_type", pa.string()), ("level", pa.int32()), ("value", pa.string()),
         ("has_value", pa.bool_()), ("count", pa.int32()), ("has_count", pa.bool_())]
_EDGE = [("src", pa.string()), ("dst", pa.string()), ("relationship", pa.string()), ("ord", pa.list_(pa.int32()))]


class _Number(str):
    """A number as it is written."""


def _text(v) -> str | None:
    """A value as text: strings as they are, nested values as compact JSON."""
    return v if v is None or isinstance(v, str) else _compact(v)


def _compact(v) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_compact(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_compact, v)) + "]"
    return str(v) if isinstance(v, _Number) else json.dumps(v, ensure_ascii=False)


def _refuse(name: str):
    raise ValueError(name)  # NaN and Infinity are no JSON


def _parse(text: str | None) -> dict:
    try:
        v = json.loads(text or "", parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
        return v if isinstance(v, dict) else {}
    except (ValueError, RecursionError):
        return {}


def _walk(fields: dict, root: str) -> tuple[list, list]:
    """(nodes, edges) in the order of writing, children behind their parent."""
    nodes, edges = [(root, "document", 0, None, False, None)], []
    open_ = [(root, key, v, 1) for key, v in reversed(fields.items())]
    while open_:
        parent, name, v, level = open_.pop()
        if isinstance(v, dict):
            kind, rel = "category", "has_field"
            open_ += [(name, k, x, level + 1) for k, x in reversed(v.items())]
        elif isinstance(v, list) and not isinstance(parent, tuple):
            kind, rel = "list", "has_list"
            open_ += [((name,), f"{name}_item_{i}", v[i - 1], level + 1) for i in range(len(v), 0, -1)]
        else:
            kind, rel = "value", "has_value"
        if isinstance(parent, tuple):  # an item of a list: its keys stand one level further down
            (parent,), rel = parent, "contains"
            if kind == "category":
                kind = "list_item"
        nodes.append((name, kind, level, _text(v) if kind in ("category", "value") else None, kind in ("category", "value"), len(v) if kind == "list" else None))
        edges.append((parent, name, rel))
    return nodes, edges


def _writes(root: str):
    @F.arrow_udf("struct<n:array<struct<node:string,ord:array<int>,node_type:string,level:int,value:string,has_value:boolean,count:int,has_count:boolean>>,"
                 "e:array<struct<src:string,dst:string,relationship:string,ord:array<int>>>>")
    def json_writes(texts: pa.Array) -> pa.Array:
        ns, es = [], []
        for t in texts:
            nodes, edges = _walk(_parse(t.as_py()), root)
            ns.append([{"node": n, "ord": [i], "node_type": k, "level": lv, "value": v, "has_value": h, "count": c, "has_count": c is not None}
                       for i, (n, k, lv, v, h, c) in enumerate(nodes)])
            es.append([{"src": s, "dst": d, "relationship": r, "ord": [i]} for i, (s, d, r) in enumerate(edges)])
        return pa.StructArray.from_arrays([pa.array(ns, pa.list_(pa.struct(_NODE))), pa.array(es, pa.list_(pa.struct(_EDGE)))], names=["n", "e"])

    return json_writes.asNondeterministic()


def json_graph(df: DataFrame, doc_id: str, text: str, root: str = "Document") -> tuple[DataFrame, DataFrame]:
    """G1 from JSON text, one object per row: (nodes, edges) in document order.  Text
    that is null, no object or no JSON leaves the root node alone."""
    rows = df.select(F.col(doc_id).cast("string").alias("doc_id"), _writes(root)(F.col(text)).alias("w"))
    return merge_writes(rows.select("doc_id", F.inline("w.n")), rows.select("doc_id", F.inline("w.e")))
