"""A property graph as tables: one DataFrame per node label and one per edge type."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidArgument
from .functions import edge_key

NODE_COLUMNS = ("id", "version", "last_modified_ms")
EDGE_COLUMNS = ("from", "to", "version", "last_modified_ms")
#: Rows of two keys that one task of a shuffle over whole tables holds, about: some 100 bytes each in a hash table or a sort. Partitions that follow
#: the shuffle's compressed bytes hold ten times as many, as keys compress so well.
ROWS_A_TASK = 1 << 19


def tasks(rows: int) -> int:
    """Into how many tasks to deal so many rows."""
    return max(1, -(-rows // ROWS_A_TASK))


class Tables(Mapping[str, DataFrame]):
    """DataFrames by name, each made when it is first asked for: a query touches only the tables that it names."""

    def __init__(self, made: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self._made = dict(made or {})

    def __getitem__(self, name: str) -> DataFrame:
        found = self._made[name]
        if not isinstance(found, DataFrame):
            found = self._made[name] = found()
        return found

    def __iter__(self) -> Iterator[str]:
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)

    def some(self, names: tuple[str, ...]) -> Tables:
        return Tables({k: lambda k=k: self[k] for k in names})

    def put(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> Tables:
        return Tables({**self._made, name: df})


@dataclass(frozen=True)
class Keyed:
    """A label whose ids are a prefix and a native key: an integer, or (text) the id itself. rows gives the label's node
    rows with one more column, key, so that comparisons with a key reach the scan of what the rows come from."""

    prefix: str
    rows: Callable[[], DataFrame]
    text: bool = False

    @cached_property
    def table(self) -> DataFrame:
        return self.rows()

    def decode(self, node_id: str) -> Any | None:
        """The key of an id, None if it can't be one of this label."""
        rest = node_id.removeprefix(self.prefix)
        if not node_id.startswith(self.prefix) or self.text:
            return node_id if self.text and node_id.startswith(self.prefix) else None
        return int(rest) if rest.isascii() and rest.removeprefix("-").isdigit() and str(int(rest)) == rest and -(2**63) <= int(rest) < 2**63 else None

    def decoded(self, node_id: Column) -> Column:
        return F.when(node_id.startswith(self.prefix), node_id if self.text else F.substring(node_id, len(self.prefix) + 1, 1 << 20).try_cast("long"))

    def encode(self, key: Column) -> Column:
        return key if self.text else F.concat(F.lit(self.prefix), key.cast("string"))


@dataclass(frozen=True)
class Link:
    """Edges of one type between two labels by native keys. rows gives src, dst and what fold needs; fold makes of any of them
    the edges (src, dst, properties), one for each pair: it may sum repeated rows up, and pairs stay apart in it.
    sure: the ends that always exist, as edge rows come from their table ("source", "target")."""

    source: str
    target: str
    rows: Callable[[], DataFrame]
    fold: Callable[[DataFrame], DataFrame] = lambda df: df
    sure: frozenset[str] = frozenset()

    @cached_property
    def table(self) -> DataFrame:
        return self.rows()


@dataclass(frozen=True)
class Graph:
    """Immutable. nodes[label]: id, version, last_modified_ms and the label's properties;
    edges[type]: from, to, version, last_modified_ms and properties. A node has one label.
    An edge is named by its type and ends. Tables by label and type let scans, walks and
    filters read only what they name. indexes: declared (label, property) pairs, by which saved labels are clustered. keyed and links
    tell, for labels and types that have them, native keys and the labels that edges join. instance and revision name the state for page cursors."""

    spark: SparkSession
    nodes: Tables = field(default_factory=Tables)
    edges: Tables = field(default_factory=Tables)
    indexes: frozenset[tuple[str, str]] = frozenset()
    keyed: Mapping[str, Keyed] = field(default_factory=dict)
    links: Mapping[str, tuple[Link, ...]] = field(default_factory=dict)
    instance: str = field(default_factory=lambda: uuid.uuid4().hex)
    revision: int = 0

    def __post_init__(self):
        for name in ("nodes", "edges"):
            if not isinstance(getattr(self, name), Tables):
                object.__setattr__(self, name, Tables(getattr(self, name)))

    def only(self, labels: tuple[str, ...], kinds: tuple[str, ...]) -> Graph:
        """The graph of some labels and types. Edges whose ends are left out stay, as edges to nodes that don't exist."""
        held = {k: v for k, v in self.links.items() if k in kinds and all(x.source in labels and x.target in labels for x in v)}
        return replace(self, nodes=self.nodes.some(labels), edges=self.edges.some(kinds), keyed={k: v for k, v in self.keyed.items() if k in labels}, links=held)

    def with_nodes(self, label: str, df: DataFrame | Callable[[], DataFrame]) -> Graph:
        made = (lambda: _shaped(df(), NODE_COLUMNS)) if callable(df) else _shaped(df, NODE_COLUMNS)
        rest = {k: v for k, v in self.keyed.items() if k != label}
        return replace(self, nodes=self.nodes.put(_named(label), made), keyed=rest, links={k: v for k, v in self.links.items() if all(label not in (x.source, x.target) for x in v)})

    def with_edges(self, kind: str, df: DataFrame | Callable[[], DataFrame]) -> Graph:
        made = (lambda: _shaped(df(), EDGE_COLUMNS)) if callable(df) else _shaped(df, EDGE_COLUMNS)
        return replace(self, edges=self.edges.put(_named(kind), made), links={k: v for k, v in self.links.items() if k != kind})

    def with_keyed(self, label: str, prefix: str, rows: Callable[[], DataFrame], text: bool = False) -> Graph:
        """Adds a label by rows (key, properties...); ids are prefix and key (or the key itself, if text)."""
        one = Keyed(prefix, lambda: _shaped(rows().withColumn("id", Keyed(prefix, rows, text).encode(F.col("key"))), NODE_COLUMNS), text)
        return replace(self, nodes=self.nodes.put(_named(label), lambda: one.table.drop("key")), keyed={**self.keyed, label: one})

    def with_links(self, kind: str, *links: Link) -> Graph:
        """Adds an edge type by its links; the labels that they join are keyed."""
        return replace(self, edges=self.edges.put(_named(kind), lambda: reduce(DataFrame.unionByName, [self.edge_rows(x, x.table) for x in links])), links={**self.links, kind: links})

    def edge_rows(self, link: Link, rows: DataFrame) -> DataFrame:
        """The edges that rows of a link make, in the form of edges[type]."""
        made = link.fold(rows)
        a, b = self.keyed[link.source].encode(F.col("src")), self.keyed[link.target].encode(F.col("dst"))
        return _shaped(made.select(a.alias("from"), b.alias("to"), *[F.col(f"`{c}`") for c in made.columns if c not in ("src", "dst")]), EDGE_COLUMNS)

    def with_index(self, label: str, prop: str) -> Graph:
        """Declares an index; declaring it again changes nothing."""
        return replace(self, indexes=self.indexes | {(_named(label), _named(prop))})

    def kinds(self, over: str | None) -> list[str]:
        """One edge type, if there is such, or all."""
        return sorted(self.edges) if over is None else [k for k in (over,) if k in self.edges]

    def linked(self, over: str | None) -> bool:
        """Whether all types of a walk have links."""
        return all(k in self.links for k in self.kinds(over))

    def node_ids(self) -> DataFrame:
        """(id, label) of all nodes."""
        return _union(self.spark, [self.nodes[k].select("id", F.lit(k).alias("label")) for k in sorted(self.nodes)], "id string, label string")

    def adjacency(self, over: str | None = None, direction: str = "out", keyed: bool = True) -> DataFrame:
        """(src, dst, key) of the edges of one type, or of all, as a walk in that direction
        crosses them. key orders them: it is that of the stored edge, in either direction."""
        a, b = ends(direction)
        key = [lambda k: edge_key(F.col("from"), F.lit(k), F.col("to")).alias("key")] if keyed else []
        return _union(self.spark, [self.edges[k].select(F.col(a).alias("src"), F.col(b).alias("dst"), *[f(k) for f in key]) for k in self.kinds(over)], "src string, dst string" + ", key string" * keyed)


def row_counts(tables: list[DataFrame]) -> list[int]:
    """How many rows each table has, by one job; a table read from Parquet tells by its footers."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n") for i, df in enumerate(tables)]
    held = {r["i"]: r["n"] for r in reduce(DataFrame.unionByName, each).collect()} if each else {}
    return [held[i] for i in range(len(tables))]


def ends(direction: str) -> tuple[str, str]:
    if direction not in ("out", "in"):
        raise InvalidArgument(f"unknown direction {direction}")
    return ("from", "to") if direction == "out" else ("to", "from")


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    """The union of parts, in pairs of pairs, so that plans of many parts stay shallow."""
    while len(parts) > 1:
        parts = [parts[i].unionByName(parts[i + 1], allowMissingColumns=True) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else spark.createDataFrame([], schema)


def _named(name: str) -> str:
    if not name or len(name.encode()) > 1024:
        raise InvalidArgument("a name has 1 to 1024 bytes")
    return name


def _shaped(df: DataFrame, fixed: tuple[str, ...]) -> DataFrame:
    add = {"version": F.lit(1).cast("long"), "last_modified_ms": F.lit(0).cast("long")}
    missing = [c for c in fixed if c not in df.columns and c not in add]
    if missing:
        raise InvalidArgument(f"columns are missing: {missing}")
    rest = [c for c in df.columns if c not in fixed]
    return df.select(*[F.col(c) if c in df.columns else add[c].alias(c) for c in fixed], *[F.col(f"`{c}`") for c in rest])
