"""Changes to a graph: sets of rows in, a new graph out.

All changes that go together become two tables of events, of nodes and of edges, each event with its place in the
order. What exists before an event, its version and what stands at the end are windows over the events of one id, so any number of changes is one
plan over tables of the changes' own size; labels and types are read once, and only those that an event can touch."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import Closed, Conflict, GraphError, InvalidArgument, LimitExceeded, NotFound
from ..functions import identifier
from ..functions.scalars import SCALAR, property_kind
from ..graph import EDGE_COLUMNS, NODE_COLUMNS, Graph, _named, _union
from ..limits import STRICT, Limits
from ..scratch import materialize
from .objects import edge_objects

MOST_PROPERTIES = 4096
_EDGE = ["type", "from", "to"]
_ERRORS: dict[str, type[GraphError]] = {e.code: e for e in (NotFound, InvalidArgument)}


def _checked(rows: DataFrame, own: tuple[str, ...], fixed: tuple[str, ...]) -> DataFrame:
    """rows with what names an object as strings; only plain values are properties."""
    missing = [c for c in own if c not in rows.columns]
    if missing:
        raise InvalidArgument(f"columns are missing: {missing}")
    props = [f for f in rows.schema.fields if f.name not in fixed]
    if len(props) > MOST_PROPERTIES:
        raise InvalidArgument(f"an object has at most {MOST_PROPERTIES} properties")
    for f in props:
        _named(f.name)
        if f.dataType != SCALAR:
            property_kind(f.dataType)  # InvalidArgument for nested and other types
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in own], *[F.col(f"`{f.name}`") for f in props])


@dataclass
class Changes:
    """An ordered list of changes, applied all or not at all."""

    steps: list[tuple[str, Any]] = field(default_factory=list)

    def upsert_nodes(self, label: str, rows: DataFrame) -> Changes:
        """rows (id, properties...): a node that exists changes its label, loses its properties and has its version raised; others begin at version 1."""
        self.steps.append(("upsert_nodes", (_named(label), _checked(rows, ("id",), NODE_COLUMNS))))
        return self

    def upsert_edges(self, kind: str, rows: DataFrame) -> Changes:
        """rows (from, to, properties...): edges replaced or begun. Both ends must exist by then, unless changes are permissive."""
        self.steps.append(("upsert_edges", (_named(kind), _checked(rows, ("from", "to"), EDGE_COLUMNS))))
        return self

    def delete_nodes(self, ids: DataFrame) -> Changes:
        """ids (id): these nodes and all edges at them go. Each must exist."""
        self.steps.append(("delete_nodes", (_checked(ids.select("id"), ("id",), NODE_COLUMNS),)))
        return self

    def delete_edges(self, kind: str, rows: DataFrame) -> Changes:
        self.steps.append(("delete_edges", (_named(kind), _checked(rows.select("from", "to"), ("from", "to"), EDGE_COLUMNS))))
        return self

    def create_index(self, label: str, prop: str) -> Changes:
        self.steps.append(("create_index", (identifier(label), identifier(prop))))
        return self


def _held(graph: Graph, wanted: DataFrame) -> DataFrame:
    """(id, label, version) of the nodes among wanted (id), a small table."""
    parts = []
    for k in sorted(graph.nodes):
        if k in graph.keyed:
            at = graph.keyed[k]
            parts.append(at.table.join(wanted.select(at.decoded(F.col("id")).alias("key")).where("key is not null").distinct(), "key", "left_semi").select("id", F.lit(k).alias("label"), "version"))
        else:
            parts.append(graph.nodes[k].join(wanted, "id", "left_semi").select("id", F.lit(k).alias("label"), "version"))
    return _union(graph.spark, parts, "id string, label string, version long")


def _history(events: DataFrame, key: list[str], begins: Column) -> DataFrame:
    """events (key, seq, gone, base: the version before all, null if there was none) with existed (before each), version (after it) and final."""
    run = W.partitionBy(*key).orderBy("seq")
    events = events.withColumn("existed", F.coalesce(~F.lag("gone").over(run), begins)).withColumn("cut", F.sum(F.col("gone").cast("int")).over(run))
    since = F.sum((~F.col("gone")).cast("long")).over(W.partitionBy(*key, "cut").orderBy("seq"))
    version = since + F.when(F.col("cut") == 0, F.coalesce("base", F.lit(0))).otherwise(0)
    return events.withColumn("version", version.cast("long")).withColumn("final", F.lead("seq").over(run).isNull())


def _problem(df: DataFrame, when: Column, code: str, text: str) -> DataFrame:
    return df.where(when).select("seq", F.lit(code).alias("code"), F.lit(text).alias("text"))


def apply_changes(graph: Graph, changes: Changes, now: int | None = None, permissive: bool = False, limits: Limits = STRICT) -> Graph:
    """The graph after all changes in order, each seeing those before it. The first change that can't be made raises its error (NotFound for what must exist,
    InvalidArgument for a null or over-long id or one that a change names twice), and an error leaves graph as
    it was: nothing is changed in place. All changes carry one time. No changes are InvalidArgument."""
    if not changes.steps:
        raise InvalidArgument("there are no changes")
    limits.check(changes=len(changes.steps))
    now = int(time.time() * 1000) if now is None else now
    spark, stamp = graph.spark, F.lit(now).cast("long").alias("last_modified_ms")
    of_nodes, of_edges = [], []
    nodes: dict[str, list[DataFrame]] = {}
    edges: dict[str, list[DataFrame]] = {}
    for seq, (name, args) in enumerate(changes.steps):
        at, gone = F.lit(seq).alias("seq"), F.lit(name.startswith("delete")).alias("gone")
        if name in ("upsert_nodes", "delete_nodes"):
            label, rows = args if len(args) == 2 else (None, args[0])
            of_nodes.append(rows.select("id", at, gone, F.lit(label).cast("string").alias("label")))
            if label is not None:
                nodes.setdefault(label, []).append(rows.withColumn("seq", F.lit(seq)))
        elif name in ("upsert_edges", "delete_edges"):
            kind, rows = args
            of_edges.append(rows.select(F.lit(kind).alias("type"), "from", "to", at, gone))
            if name == "upsert_edges":
                edges.setdefault(kind, []).append(rows.withColumn("seq", F.lit(seq)))
        else:
            graph = graph.with_index(*args)
    n = materialize(_union(spark, of_nodes, "id string, seq int, gone boolean, label string"), "changes")
    e = materialize(_union(spark, of_edges, "type string, from string, to string, seq int, gone boolean"), "changes")
    touched = n.select("id").unionByName(e.select(F.explode(F.array("from", "to")).alias("id"))).where("id is not null").distinct()
    held = materialize(_held(graph, touched), "held").select("id", F.col("label").alias("was"), F.col("version").alias("base"))
    n = _history(n.join(held, "id", "left"), ["id"], F.col("base").isNotNull())
    # What happens to an edge: its own events, and deletions of its ends.
    ends = e.select(*_EDGE).distinct()
    deleted = n.where("gone").select("id", "seq")
    lost = [ends.join(deleted.withColumnRenamed("id", end), end).select(*_EDGE, "seq", F.lit(True).alias("gone"), F.lit(True).alias("cascade")) for end in ("from", "to")]
    own = e.withColumn("cascade", F.lit(False))
    before = edge_objects(graph, ends.where(F.col("type").isin(sorted(graph.edges))), ("version",)).select(*_EDGE, F.col("object.version").cast("long").alias("base"))
    known = _history(own.unionByName(lost[0]).unionByName(lost[1]).dropDuplicates([*_EDGE, "seq", "cascade"]).join(materialize(before, "held"), _EDGE, "left"), _EDGE, F.col("base").isNotNull())
    # Whether an edge's ends exist when it is made: the last event of the end before, or the graph.
    probes = e.where("not gone").select(F.explode(F.array("from", "to")).alias("id"), "seq", F.lit(None).cast("boolean").alias("gone"))
    seen = probes.unionByName(n.select("id", "seq", "gone")).join(held.select("id", "base"), "id", "left")
    seen = seen.withColumn("there", F.coalesce(~F.last("gone", True).over(W.partitionBy("id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.col("base").isNotNull())).where("gone is null")
    wrong = lambda c: F.col(c).isNull() | (F.octet_length(c) == 0) | (F.octet_length(c) > 1024)
    problems = [
        _problem(n, wrong("id"), "invalidArgument", "an id has 1 to 1024 bytes"),
        _problem(e, wrong("from") | wrong("to"), "invalidArgument", "an edge's end has 1 to 1024 bytes"),
        _problem(n.groupBy("seq", "id").count(), F.col("count") > 1, "invalidArgument", "a change names a node twice"),
        _problem(e.groupBy("seq", *_EDGE).count(), F.col("count") > 1, "invalidArgument", "a change names an edge twice"),
        _problem(n, F.col("gone") & ~F.col("existed"), "notFound", "a node to delete does not exist"),
        _problem(known, F.col("gone") & ~F.col("cascade") & ~F.col("existed"), "notFound", "an edge to delete does not exist"),
    ]
    if not permissive:
        problems.append(_problem(seen, ~F.col("there"), "notFound", "an edge's end does not exist"))
    first = _union(spark, problems, "").orderBy("seq", "code").limit(1).collect()
    if first:
        raise _ERRORS[first[0]["code"]](f"change {first[0]['seq'] + 1}: {first[0]['text']}")

    out = graph
    moved = {r["was"] for r in held.select("was").distinct().collect()}  # labels of the graph at most
    changed = n.select("id").distinct()
    for label in sorted(moved | set(nodes)) if of_nodes else []:
        parts = [graph.nodes[label].join(changed, "id", "left_anti")] if label in graph.nodes else []
        if label in nodes:
            last = n.where(F.col("final") & ~F.col("gone") & (F.col("label") == label)).select("id", "seq", "version", stamp)
            parts.append(_union(spark, nodes[label], "").join(last, ["id", "seq"]).drop("seq"))
        out = out.with_nodes(label, _union(spark, parts, ""))
    removed = deleted.select("id").distinct()
    cascades = any(name == "delete_nodes" for name, _ in changes.steps)
    gone_from = {r["was"] for r in held.join(removed, "id").select("was").distinct().collect()} if cascades else set()
    for kind in sorted({*graph.edges, *edges}):
        labels = {x for link in graph.links[kind] for x in (link.source, link.target)} if kind in graph.links else None
        cut = cascades and (labels is None or bool(labels & gone_from))
        named = kind in edges or any(name == "delete_edges" and args[0] == kind for name, args in changes.steps)
        if not cut and not named:
            continue
        parts = []
        if kind in graph.edges:
            old = graph.edges[kind]
            if named:
                old = old.join(e.where(F.col("type") == kind).select("from", "to").distinct(), ["from", "to"], "left_anti")
            for end in ("from", "to") if cut else ():
                old = old.join(removed.withColumnRenamed("id", end), end, "left_anti")
            parts.append(old)
        if kind in edges:
            last = known.where(F.col("final") & ~F.col("gone") & (F.col("type") == kind)).select("from", "to", "seq", "version", stamp)
            parts.append(_union(spark, edges[kind], "").join(last, ["from", "to", "seq"]).drop("seq"))
        out = out.with_edges(kind, _union(spark, parts, ""))
    return replace(out, revision=graph.revision + 1)


def run_program(graph: Graph, *steps: Changes | Callable[[Graph], DataFrame], now: int | None = None, permissive: bool = False, limits: Limits = STRICT) -> tuple[Graph, list[DataFrame]]:
    """Changes and reads in order, all or nothing: a read sees the changes before it, and its result is in the list; if anything fails, reads included, the
    error leaves graph as it was. All changes carry one time."""
    limits.check(changes=sum(len(s.steps) if isinstance(s, Changes) else 1 for s in steps))
    now, results, staged = int(time.time() * 1000) if now is None else now, [], graph
    for step in steps:
        if isinstance(step, Changes):
            staged = apply_changes(staged, step, now, permissive, limits)
        else:
            results.append(materialize(step(staged), "read"))  # a read that fails must fail here
    return (graph if staged is graph else replace(staged, revision=graph.revision + 1)), results


class Transaction(Changes):
    """with Transaction(graph) as t: t.upsert_nodes(...) ...; after the block t.graph is the graph with all changes, or, if the block was empty or raised, as it was."""

    def __init__(self, graph: Graph, now: int | None = None, permissive: bool = False):
        super().__init__()
        self.graph, self._how = graph, (now, permissive)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None and self.steps:
            self.graph = apply_changes(self.graph, self, *self._how)


class Snapshot:
    """One state of a graph for several reads under one budget of looked-at edges. with Snapshot(graph) as s: s.walk(...). Changes within it are a
    Conflict, as is opening it again; after the block it is Closed."""

    def __init__(self, graph: Graph, limits: Limits = STRICT):
        self._graph, self._left, self._limits, self._open = graph, limits.edges, limits, None

    def __enter__(self) -> Snapshot:
        if self._open is not None:
            raise Conflict("the snapshot is in use or was used")
        self._open = True
        return self

    def __exit__(self, *_) -> None:
        self._open = False

    @property
    def graph(self) -> Graph:
        if not self._open:
            raise Closed("the snapshot is closed")
        return self._graph

    def walk(self, start: str, over: str | None = None, direction: str = "out", depth: int = 1, limit: int = 100, **how) -> DataFrame:
        from .traverse import expanded_edges, walk

        self._limits.check(depth=depth, results=limit)
        n = expanded_edges(self.graph, start, over, direction, depth, limit)
        if n > self._left:
            raise LimitExceeded(f"the snapshot's reads look at more than {self._limits.edges} edges")
        self._left -= n
        return walk(self.graph, start, over, direction, depth, limit, None, **how)

    def find_nodes(self, *args, **how) -> DataFrame:
        from .scan import find_nodes

        return find_nodes(self.graph, *args, limits=self._limits, **how)

    def apply_changes(self, *_, **__) -> Graph:
        raise Conflict("a snapshot only reads")


def upsert_nodes(graph: Graph, label: str, rows: DataFrame, now: int = 0) -> Graph:
    return apply_changes(graph, Changes().upsert_nodes(label, rows), now)


def upsert_edges(graph: Graph, kind: str, rows: DataFrame, now: int = 0, permissive: bool = False) -> Graph:
    return apply_changes(graph, Changes().upsert_edges(kind, rows), now, permissive)


def delete_nodes(graph: Graph, ids: DataFrame) -> Graph:
    return apply_changes(graph, Changes().delete_nodes(ids))


def delete_edges(graph: Graph, kind: str, rows: DataFrame) -> Graph:
    return apply_changes(graph, Changes().delete_edges(kind, rows))
