"""Nodes and edges of several labels in one table: whole, or named fields of theirs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import edge_key
from ..graph import EDGE_COLUMNS, NODE_COLUMNS, Graph, _union

_PROPERTIES = "map<string,string>"


def json_text(c: Column, dtype: T.DataType) -> Column:
    """A property value as JSON: 1, 1.0, true and "1" stay apart; null where the object lacks it."""
    if isinstance(dtype, T.StructType):
        each = [json_text(c[f.name], f.dataType) for f in dtype.fields[1:]]
        return F.when(c["t"] == "null", F.lit("null")).otherwise(F.coalesce(*each))
    text = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))


def _properties(df: DataFrame, kind: str) -> list[T.StructField]:
    own = (*NODE_COLUMNS, "key") if kind == "node" else (*EDGE_COLUMNS, "key", "type")
    return [f for f in df.schema.fields if f.name not in own]


def whole(df: DataFrame, kind: str, label: str) -> Column:
    """The object in full: kind, id, label (or type, from, to), properties (JSON by name; missing ones are left out), last_modified_ms and version."""
    entries = [F.struct(F.lit(f.name).alias("k"), json_text(F.col(f"`{f.name}`"), f.dataType).alias("v")) for f in _properties(df, kind)]
    held = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull())) if entries else F.create_map().cast(_PROPERTIES)
    if kind == "node":
        own = [F.col("id"), F.lit(label).alias("label")]
    else:
        own = [edge_key(F.col("from"), F.lit(label), F.col("to")).alias("id"), F.lit(label).alias("type"), F.col("from"), F.col("to")]
    return F.struct(F.lit(kind).alias("kind"), *own, held.cast(_PROPERTIES).alias("properties"), F.col("last_modified_ms"), F.col("version"))


def fields_of(tables: Mapping[str, DataFrame], kind: str, names: Sequence[str]) -> dict[str, Column]:
    """For each label's table a struct of the named fields, of one type for all. Reserved names and types are those of scan.project. A
    property has its own type where all tables that have it agree, and is JSON where they don't; null where there is none."""
    types: dict[str, set[str]] = {n: set() for n in names}
    for df in tables.values():
        for f in _properties(df, kind):
            if f.name in types:
                types[f.name].add(f.dataType.simpleString())

    def one(df: DataFrame, label: str, n: str) -> Column:
        own = {"id": F.col("id") if kind == "node" else edge_key(F.col("from"), F.lit(label), F.col("to")), "label": F.lit(label), "type": F.lit(label), "kind": F.lit(kind), "version": F.col("version")}
        own |= {e: F.lit("") if kind == "node" else F.col(e) for e in ("from", "to")}
        if n in own:
            return own[n]
        held = {f.name: f.dataType for f in _properties(df, kind)}
        if n not in held:
            return F.lit(None).cast(next(iter(types[n])) if len(types[n]) == 1 else "string")
        return F.col(f"`{n}`") if len(types[n]) == 1 else json_text(F.col(f"`{n}`"), held[n])

    return {label: F.struct(*[one(df, label, n).alias(n) for n in names]) for label, df in tables.items()}


def node_objects(graph: Graph, few: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """(id, object) of the nodes that few (id, and label if it is known) names: whole, or the named fields. few is a small table, as a walk's
    results; labels read only what it names."""
    labels = sorted(graph.nodes)
    if "label" in few.columns:
        labels = [r["label"] for r in few.select("label").distinct().orderBy("label").collect()]  # labels of the graph at most
    tables: dict[str, DataFrame] = {}
    for k in labels:
        if k in graph.keyed:
            at = graph.keyed[k]
            some = few.select(at.decoded(F.col("id")).alias("key")).where("key is not null").distinct()
            tables[k] = at.table.join(some, "key", "left_semi")
        else:
            tables[k] = graph.nodes[k].join(few.select("id"), "id", "left_semi")
    made = fields_of(tables, "node", fields) if fields is not None else {k: whole(df, "node", k) for k, df in tables.items()}
    empty = graph.spark.createDataFrame([], f"id string, object struct<kind:string,id:string,label:string,properties:{_PROPERTIES},last_modified_ms:bigint,version:bigint>")
    return _union(graph.spark, [df.select("id", made[k].alias("object")) for k, df in tables.items()], "id string") if tables else empty


def edge_objects(graph: Graph, few: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """(type, from, to, object) of the edges that few (type, from, to; a small table) names: whole, or the named fields."""
    kinds = [r["type"] for r in few.select("type").distinct().orderBy("type").collect()]  # types of the graph at most
    tables: dict[str, DataFrame] = {}
    for k in kinds:
        some = few.where(F.col("type") == k)
        if k in graph.links:
            parts = []
            for link in graph.links[k]:
                a, b = graph.keyed[link.source], graph.keyed[link.target]
                ends = some.select(a.decoded(F.col("from")).alias("src"), b.decoded(F.col("to")).alias("dst")).where("src is not null and dst is not null")
                parts.append(graph.edge_rows(link, link.table.join(ends, ["src", "dst"], "left_semi")))  # before sums are made
            tables[k] = _union(graph.spark, parts, "")
        else:
            tables[k] = graph.edges[k].join(some.select("from", "to"), ["from", "to"], "left_semi")
    made = fields_of(tables, "edge", fields) if fields is not None else {k: whole(df, "edge", k) for k, df in tables.items()}
    names = "".join(f"{n}:{'bigint' if n == 'version' else 'string'}," for n in fields or ()).rstrip(",")
    kind = f"struct<{names}>" if fields is not None else f"struct<kind:string,id:string,type:string,from:string,to:string,properties:{_PROPERTIES},last_modified_ms:bigint,version:bigint>"
    each = [df.select(F.lit(k).alias("type"), "from", "to", made[k].alias("object")) for k, df in tables.items()]
    return _union(graph.spark, each, f"type string, from string, to string, object {kind}")
