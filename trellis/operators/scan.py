"""Point reads, label scans with one predicate, projection, and pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import Conflict, InvalidArgument, NotFound
from ..functions import edge_key, identifier, passes
from ..graph import EDGE_COLUMNS, NODE_COLUMNS, Graph, _union
from ..limits import Limits
from .objects import fields_of, whole

DEFAULT_LIMIT = 100


def project(df: DataFrame, kind: str, label: str, names: Sequence[str]) -> DataFrame:
    """The named fields in order. id, label, type, from, to, kind and version are the object's own
    and win over properties; label and type are one; from and to of a node are empty; an edge's id
    is its key. Anything else is a property, null where there is none. Names are case-sensitive
    and distinct."""
    if len(set(names)) < len(names):
        raise InvalidArgument("a field is named twice")
    key = edge_key(F.col("from"), F.lit(label), F.col("to"))
    own: dict[str, Column] = {"id": F.col("id") if kind == "node" else key, "label": F.lit(label), "type": F.lit(label), "kind": F.lit(kind), "version": F.col("version")}
    own |= {e: F.lit("") if kind == "node" else F.col(e) for e in ("from", "to")}
    props = set(df.columns) - set(NODE_COLUMNS if kind == "node" else EDGE_COLUMNS)
    return df.select(*[(own[n] if n in own else F.col(f"`{n}`") if n in props else F.lit(None).cast("string")).alias(n) for n in names])


def property_type(df: DataFrame, name: str):
    return df.schema[name].dataType if name in df.columns and name not in (*NODE_COLUMNS, *EDGE_COLUMNS) else None


def matching(df: DataFrame, where: tuple[str, str, Any] | None) -> DataFrame:
    """Rows that pass one comparison (property, operator, value). A property that no node has
    passes only !=. Fields that aren't properties (id, version) can't be compared."""
    if where is None:
        return df
    name, op, value = where
    dtype = property_type(df, name)
    if dtype is None:
        return df if op == "!=" else df.where(F.lit(False))
    return df.where(passes(F.col(f"`{name}`"), dtype, op, value))


def find_nodes(graph: Graph, label: str, where: tuple[str, str, Any] | None = None, limit: int | None = DEFAULT_LIMIT, fields: Sequence[str] | None = None, limits: Limits | None = None) -> DataFrame:
    """Nodes of a label that pass one comparison, by ascending id bytes, limit of them (None: all,
    in no order; a negative one: none). An unknown label has none. The comparison reaches the scan; a limit is one
    top-k over map-side heaps, not a sort. limits holds results to a ceiling. A declared index changes no row: saved labels are clustered by it,
    so that statistics skip the rest of their files."""
    if limits is not None:
        limits.check(results=limit or 0)
        if limit is None:
            raise InvalidArgument("a find without a limit needs limits=None")
    if label not in graph.nodes:
        return graph.spark.createDataFrame([], ", ".join(f"`{f}` string" for f in fields) if fields else "id string, version long, last_modified_ms long")
    df = matching(graph.nodes[label], where)
    if limit is not None:
        df = df.orderBy("id").limit(max(0, limit))
    return project(df, "node", label, fields) if fields else df


def find_equal(graph: Graph, label: str, prop: str, value: Any, limit: int = DEFAULT_LIMIT, fields: Sequence[str] | None = None) -> DataFrame:
    """Nodes whose property equals a value; label and property are plain identifiers."""
    return find_nodes(graph, identifier(label), (identifier(prop), "=", value), limit, fields)


def objects(graph: Graph, kind: str, label: str, df: DataFrame) -> DataFrame:
    """Rows of a label's nodes or a type's edges in full: kind, id, label (edges: type, from, to), properties, last_modified_ms, version."""
    return df.select(whole(df, kind, label).alias("object")).select("object.*")


def _node_rows(graph: Graph, node_id: str, label: str | None) -> dict[str, DataFrame]:
    """By label, the rows with that id, of labels that can hold it."""
    out = {}
    for k in [label] if label else sorted(graph.nodes):
        if k in graph.keyed:
            key = graph.keyed[k].decode(node_id)
            if key is not None:
                out[k] = graph.keyed[k].table.where(F.col("key") == F.lit(key)).drop("key")
        elif k in graph.nodes:
            out[k] = graph.nodes[k].where(F.col("id") == node_id)
    return out


def get_node(graph: Graph, node_id: str, label: str | None = None, fields: Sequence[str] | None = ("id", "label", "version")) -> DataFrame:
    """The node's fields, or (fields=None) all of it, one row; no rows if there is none (see one). Reads the labels that can hold the id; the
    key reaches the scan."""
    if fields is not None and len(set(fields)) < len(fields):
        raise InvalidArgument("a field is named twice")
    tables = _node_rows(graph, node_id, label)
    made = fields_of(tables, "node", fields) if fields is not None else {k: whole(df, "node", k) for k, df in tables.items()}
    names = ", ".join(f"`{f}` {'long' if f == 'version' else 'string'}" for f in fields or ("kind", "id", "label"))
    return _union(graph.spark, [df.select(made[k].alias("object")).select("object.*") for k, df in tables.items()], names)


def get_edge(graph: Graph, kind: str, source: str, target: str, fields: Sequence[str] | None = ("type", "from", "to", "version")) -> DataFrame:
    """The edge's fields, or all of it; both keys reach the scan."""
    if kind not in graph.edges:
        return graph.spark.createDataFrame([], ", ".join(f"`{f}` string" for f in fields or ("kind", "id", "type")))
    if kind in graph.links:
        parts = []
        for link in graph.links[kind]:
            a, b = graph.keyed[link.source].decode(source), graph.keyed[link.target].decode(target)
            if a is not None and b is not None:
                parts.append(graph.edge_rows(link, link.table.where((F.col("src") == F.lit(a)) & (F.col("dst") == F.lit(b)))))
        df = _union(graph.spark, parts, "") if parts else graph.edges[kind].limit(0)
    else:
        df = graph.edges[kind].where((F.col("from") == source) & (F.col("to") == target))
    return project(df, "edge", kind, fields) if fields is not None else objects(graph, "edge", kind, df)


def one(df: DataFrame, what: str = "object") -> Row:
    """The single row of a point read, or NotFound."""
    row = maybe(df)
    if row is None:
        raise NotFound(f"no such {what}")
    return row


def maybe(df: DataFrame) -> Row | None:
    """The single row of a point read, None if there is none; other errors are raised."""
    rows = df.take(1)
    return rows[0] if rows else None


@dataclass(frozen=True)
class Page:
    """items in key order, and the cursor of the next page, None after the last."""

    kind: str
    revision: int
    items: DataFrame
    cursor: str | None


_NODE_PAGE = "kind string, id string, label string, properties map<string,string>, last_modified_ms long, version long"
_EDGE_PAGE = "kind string, id string, type string, from string, to string, properties map<string,string>, last_modified_ms long, version long"


def _after(graph: Graph, kind: str, cursor: str | None, limit: int) -> str | None:
    if not 1 <= limit <= 100:
        raise InvalidArgument("a page has 1 to 100 items")
    if cursor is None:
        return None
    parts = cursor.split(":", 3)
    if len(parts) < 4 or parts[2] != kind or not parts[1].isdigit():
        raise InvalidArgument("no cursor of this kind")
    if parts[0] != graph.instance or int(parts[1]) != graph.revision:
        raise Conflict("the graph has changed since the page before")
    return parts[3]


def _nodes_after(graph: Graph, after: str | None, limit: int) -> list[Row]:
    """At most limit whole nodes behind a key, in order. Ids of a keyed label share its prefix, so labels are read one after another, in order of
    prefixes, until the page is full; those whose ids all come before aren't read."""
    prefix = lambda k: graph.keyed[k].prefix if k in graph.keyed else ""
    prefixes = [prefix(k) for k in graph.nodes]
    apart = all(prefixes) and not any(a is not b and b.startswith(a) for i, a in enumerate(prefixes) for j, b in enumerate(prefixes) if i != j)
    rows: list[Row] = []
    frames = []
    for k in sorted(graph.nodes, key=prefix):
        if apart and after is not None and after[: len(prefix(k))] > prefix(k):
            continue
        df = graph.nodes[k]
        df = df.where(F.col("id") > after) if after is not None else df
        frames.append(objects(graph, "node", k, df.orderBy("id").limit(limit)))
        if apart:
            rows += frames.pop().orderBy("id").collect()  # limit rows at most
            if len(rows) >= limit:
                break
    return (rows if apart else _union(graph.spark, frames, _NODE_PAGE).orderBy("id").limit(limit).collect())[:limit]


def _edges_after(graph: Graph, after: str | None, limit: int) -> list[Row]:
    frames = []
    for k in sorted(graph.edges):
        df = graph.edges[k].withColumn("key", edge_key(F.col("from"), F.lit(k), F.col("to")))
        frames.append(objects(graph, "edge", k, (df.where(F.col("key") > after) if after is not None else df).orderBy("key").limit(limit)))
    return _union(graph.spark, frames, _EDGE_PAGE).orderBy("id").limit(limit).collect()


def inspect(graph: Graph, kind: str, cursor: str | None = None, limit: int = 100) -> Page:
    """A page (1 to 100 items) of all nodes, edges or declared indexes ("node", "edge", "index") in key order. A cursor is that of the page before: of another
    kind or garbled it is InvalidArgument, of another state of the graph Conflict."""
    after = _after(graph, kind, cursor, limit)
    if kind == "node":
        rows, schema = _nodes_after(graph, after, limit + 1), _NODE_PAGE
    elif kind == "edge":
        rows, schema = _edges_after(graph, after, limit + 1), _EDGE_PAGE
    elif kind == "index":
        known = [(p, k) for k, p in sorted((f"{len(a.encode())}:{a}{len(b.encode())}:{b}", (a, b)) for a, b in graph.indexes)]
        rows, schema = [Row(id=k, label=p[0], property=p[1]) for p, k in known if after is None or k > after][: limit + 1], "id string, label string, property string"
    else:
        raise InvalidArgument(f"unknown kind {kind}")
    more = f"{graph.instance}:{graph.revision}:{kind}:{rows[limit - 1]['id']}" if len(rows) > limit else None
    return Page(kind, graph.revision, graph.spark.createDataFrame([tuple(r) for r in rows[:limit]], schema), more)


def inspect_nodes(graph: Graph, after: str | None = None, limit: int = 100) -> DataFrame:
    """Whole nodes by id: those after a key."""
    return graph.spark.createDataFrame([tuple(r) for r in _nodes_after(graph, after, max(1, min(100, limit)))], _NODE_PAGE)


def inspect_edges(graph: Graph, after: str | None = None, limit: int = 100) -> DataFrame:
    """Whole edges by key: those after one."""
    return graph.spark.createDataFrame([tuple(r) for r in _edges_after(graph, after, max(1, min(100, limit)))], _EDGE_PAGE)


def inspect_indexes(graph: Graph) -> DataFrame:
    return inspect(graph, "index").items.select("label", "property")
