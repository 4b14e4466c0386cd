"""Bounded breadth-first walks in a fixed order, as joins of frontiers with edges.

A reached node's path is the array of edge keys that leads to it; of all shortest ones the
smallest array is the one that a queue which visits edges in key order finds first, and (depth,
array) orders nodes as that queue does. So each level is one join of the frontier with the edges
and one minimum by node, which combines before it shuffles, however many starts there are and
however many edges a hub has.

Where edge types have links, the frontier is kept by label: a level reads only types that leave the labels
reached, joins native keys, and looks up only the labels that they lead to; the first level's key is a literal that the scan sees.
From a table of starts, every shuffle of a level is dealt by the rows that it is to hold: counted ones of edges, and for a frontier
its rows times the edges that a node of its label has on average. A wrong guess changes the number of tasks, never what is found."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import InvalidArgument, LimitExceeded
from ..functions import edge_key
from ..graph import Graph, _union, ends, row_counts, tasks
from ..limits import STRICT, Limits
from ..scratch import materialize
from .objects import edge_objects, node_objects

#: Levels that stay one query; beyond, every such number of levels is written to the shared folder.
LEVELS_A_QUERY = 3
_TAKEN = "id string, label string, depth int, keys array<string>, rank long"


def _keys(ordered: bool) -> Column:
    return (F.array() if ordered else F.lit(None)).cast("array<string>")


def _longer(ordered: bool, key: Column) -> Column:
    return F.concat("keys", F.array(key)) if ordered else F.lit(None).cast("array<string>")


def _by_name(graph: Graph, first: DataFrame, over: str | None, direction: str, depth: int, ordered: bool) -> DataFrame:
    """reach over ids, for graphs whose edge types don't tell the labels that they join. first: the starts that exist (id)."""
    exist = graph.node_ids().select("id")
    edges = graph.adjacency(over, direction, ordered)
    best = first.select(F.col("id").alias("start"), "id", F.struct(F.lit(0).alias("depth"), _keys(ordered).alias("keys")).alias("at"))
    for level in range(1, depth + 1):
        longer = F.concat("at.keys", F.array("key")) if ordered else F.lit(None).cast("array<string>")
        found = best.where(F.col("at.depth") == level - 1).join(edges, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"), F.struct(F.lit(level).alias("depth"), longer.alias("keys")).alias("at"))
        found = found.join(exist, "id").select("start", "id", "at")  # the frontier meets nodes, so that only reached ids are looked up
        best = best.unionByName(found).groupBy("start", "id").agg(F.min("at").alias("at"))
        if level % LEVELS_A_QUERY == 0 and level < depth:
            best = materialize(best, "walk")
            if best.where(F.col("at.depth") == level).isEmpty():
                break
    return best.where("at.depth > 0").select("start", "id", F.col("at.depth").alias("depth"), F.col("at.keys").alias("keys"))


def _dealt(df: DataFrame, n: int, *by: str) -> DataFrame:
    """df over n tasks, if several. Then a join sorts it: keys compress so well that Spark would take large tables of them for small ones, and broadcast them."""
    return df.repartition(n, *by).hint("merge") if n > 1 else df


def _by_label(graph: Graph, label: str, first: DataFrame | int | str, over: str | None, direction: str, depth: int, ordered: bool) -> dict[str, DataFrame]:
    """reach over native keys: (start, key, depth, keys) by label. first: the one start's key, or starts that exist (key)."""
    one = not isinstance(first, DataFrame)
    frontier = {} if one else {label: first.select(F.col("key").alias("start"), "key", _keys(ordered).alias("keys"))}
    links, labels = [x for kind in graph.kinds(over) for x in graph.links[kind]], list(graph.keyed)
    counts = [] if one else row_counts([first, *[graph.keyed[b].table.select("key") for b in labels], *[x.table for x in links]])
    starts, nodes, rows = (counts[0], dict(zip(labels, counts[1:])), {id(x): n for x, n in zip(links, counts[1 + len(labels) :])}) if counts else (1, {}, {})
    size = {label: starts}  # rows of each label's frontier, about
    reached: dict[str, list[DataFrame]] = {}
    for level in range(1, depth + 1):
        found: dict[str, list[tuple[DataFrame, bool]]] = {}
        makes: dict[str, int] = {}
        for kind in graph.kinds(over):
            for link in graph.links[kind]:
                (a, b, src, dst, end) = (link.source, link.target, "src", "dst", "target") if direction == "out" else (link.target, link.source, "dst", "src", "source")
                literal = one and level == 1
                if a != label if literal else a not in frontier:
                    continue
                key = edge_key(graph.keyed[link.source].encode(F.col("src")), F.lit(kind), graph.keyed[link.target].encode(F.col("dst")))
                edges = link.table.select("src", "dst")
                if literal:
                    step = edges.where(F.col(src) == F.lit(first)).withColumn("start", F.col(src)).withColumn("keys", _keys(ordered))
                else:
                    before = frontier[a].withColumnRenamed("key", src)
                    if not one:
                        n = tasks(rows[id(link)] + size[a])
                        before, edges = _dealt(before, n, src), _dealt(edges, n, src)
                        makes[b] = makes.get(b, 0) + size[a] * rows[id(link)] // max(1, nodes[a])
                    step = before.join(edges, src)
                    if level == 1:  # start by start: the join deals them so
                        step = step.withColumn("start", F.col(src))
                step = step.select("start", F.col(dst).alias("key"), _longer(ordered, key).alias("keys"))
                found.setdefault(b, []).append((step, end in link.sure))
        frontier = {}
        for b, steps in found.items():
            step = _union(graph.spark, [s for s, _ in steps], "")
            if not all(sure for _, sure in steps):
                exist = graph.keyed[b].table.select("key")
                if not one:
                    n = tasks(makes[b] + nodes[b])
                    step, exist = _dealt(step, n, "key"), _dealt(exist, n, "key")
                step = step.join(exist, "key")
            if b == label:
                step = step.where(F.col("key") != F.col("start"))
            if not one and not (level == 1 and len(steps) == 1 and steps[0][1]):  # else they are dealt by start already
                step = _dealt(step, tasks(makes[b]), "start", "key")
            step = step.groupBy("start", "key").agg(F.min("keys").alias("keys"))
            for before in reached.get(b, []):
                step = step.join(before, ["start", "key"], "left_anti")
            frontier[b] = step
        size = {b: min(n, starts * nodes[b]) for b, n in makes.items()}
        if level % LEVELS_A_QUERY == 0 and level < depth:
            frontier = {b: materialize(step, "walk") for b, step in frontier.items()}
            size = dict(zip(frontier, row_counts(list(frontier.values()))))
            frontier = {b: step for b, step in frontier.items() if size[b]}
        for b, step in frontier.items():
            reached.setdefault(b, []).append(step.withColumn("depth", F.lit(level)))
        if not frontier:
            break
    return {b: _union(graph.spark, steps, "") for b, steps in reached.items()}


def reach(graph: Graph, starts: DataFrame, over: str | None = None, direction: str = "out", depth: int = 1, ordered: bool = True, label: str | None = None) -> DataFrame:
    """starts (id) to (start, id, depth, keys): every node that depth edges or fewer lead to from
    each start, the start itself left out, at its shortest depth. keys is the canonical path,
    null unless ordered. Nodes that don't exist are neither reached nor crossed. label: that of all starts, if they share one."""
    ends(direction)
    if label in graph.keyed and graph.linked(over):
        at = graph.keyed[label]
        n = tasks(sum(row_counts([starts])))
        first = starts.select(at.decoded(F.col("id")).alias("key"))
        first = _dealt(first, n, "key").join(_dealt(at.table.select("key"), n, "key"), "key", "left_semi").distinct()
        parts = _by_label(graph, label, first, over, direction, max(0, depth), ordered)
        each = [df.select(at.encode(F.col("start")).alias("start"), graph.keyed[b].encode(F.col("key")).alias("id"), "depth", "keys") for b, df in parts.items()]
        return _union(graph.spark, each, "start string, id string, depth int, keys array<string>")
    return _by_name(graph, starts.select("id").join(graph.node_ids().select("id"), "id").distinct(), over, direction, max(0, depth), ordered)


def _found(graph: Graph, start: str, over, direction, depth: int) -> DataFrame:
    """id, label, depth, keys of all that a walk from one node reaches."""
    if graph.linked(over):
        for label, at in graph.keyed.items():
            key = at.decode(start)
            if key is not None and not at.table.where(F.col("key") == F.lit(key)).isEmpty():
                parts = _by_label(graph, label, key, over, direction, depth, True)
                return _union(graph.spark, [df.select(graph.keyed[b].encode(F.col("key")).alias("id"), F.lit(b).alias("label"), "depth", "keys") for b, df in parts.items()], "id string, label string, depth int, keys array<string>")
        return graph.spark.createDataFrame([], "id string, label string, depth int, keys array<string>")
    first = graph.node_ids().select("id").where(F.col("id") == start).distinct()
    return _by_name(graph, first, over, direction, depth, True).join(graph.node_ids(), "id").select("id", "label", "depth", "keys")


def _taken(graph: Graph, start: str, over, direction, depth: int, limit: int | None, limits: Limits | None) -> DataFrame:
    """What a walk gives, with rank: the place in discovery order, null where there is no limit (a rank of
    all would put them through one task; depth and keys order them)."""
    ends(direction)
    depth, limit = max(0, depth), None if limit is None else max(0, limit)
    if limits is not None:
        limits.check(depth=depth, results=limit or 0)
        if limit is None:
            raise InvalidArgument("a walk without a limit needs limits=None")
    if depth == 0 or limit == 0:
        return graph.spark.createDataFrame([], _TAKEN)
    found = _found(graph, start, over, direction, depth).select("id", "label", "depth", "keys")
    if limit is None:
        return found.withColumn("rank", F.lit(None).cast("long"))
    if limits is not None and expanded_edges(graph, start, over, direction, depth, limit, checks=False) > limits.edges:
        raise LimitExceeded(f"the walk looks at more than {limits.edges} edges")
    return found.orderBy("depth", "keys").limit(limit).withColumn("rank", F.row_number().over(W.orderBy("depth", "keys")).cast("long"))


def walk(graph: Graph, start: str, over: str | None = None, direction: str = "out", depth: int = 1, limit: int | None = 100, limits: Limits | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """rank, id, label, depth of the first limit nodes that a breadth-first walk discovers, and, if fields are named, these
    fields of theirs (see objects.fields_of; then only rank, depth and the fields). Depth 0, limit 0, negative ones and an unknown start give no rows. limits holds
    depth, results and looked-at edges to ceilings, and raises LimitExceeded before any row is given."""
    taken = _taken(graph, start, over, direction, depth, limit, limits)
    if fields is None:
        return taken.select("rank", "id", "label", F.col("depth").cast("long").alias("depth"))
    taken = materialize(taken, "walk")  # limit rows: then each label's table meets a small one
    return taken.select("rank", "id", F.col("depth").cast("long").alias("depth")).join(node_objects(graph, taken.select("id", "label"), fields), "id").select("rank", F.col("depth").alias("depth_"), *[F.col(f"object.`{f}`").alias(f) for f in fields]).withColumnRenamed("depth_", "depth")


def _unpacked(key: Column) -> list[Column]:
    """from, type and to of an edge key; lengths in it are bytes."""
    rest, out = key.cast("binary"), []
    for _ in range(3):
        n = F.substring_index(rest.cast("string"), ":", 1)
        begin = F.length(n) + 2
        out.append(F.substring(rest, begin, n.cast("int")).cast("string"))
        rest = F.substring(rest, begin + n.cast("int"), F.lit(1 << 20))
    return out


def paths(graph: Graph, start: str, over: str | None = None, direction: str = "out", depth: int = 1, limit: int = 100, limits: Limits | None = None, fields: Sequence[str] | None = None, whole: bool = False) -> DataFrame:
    """The edges of each discovered node's one path: rank and id of the node, hop (from 1), the
    edge's type, stored from and to and version, and the node that the hop leads to. A path
    starts at the walk's start; edges keep their stored direction. With fields, or whole, hop 0 is the start (without an
    edge), and at and edge hold the named fields of each hop's node and edge, or all that they have (see objects)."""
    taken = materialize(_taken(graph, start, over, direction, depth, limit, limits), "walk").select("rank", "id", "keys")
    source, kind, target = _unpacked(F.col("key"))
    hops = taken.select("rank", "id", F.posexplode("keys").alias("at", "key")).select("rank", "id", (F.col("at") + 1).cast("long").alias("hop"), kind.alias("type"), source.alias("from"), target.alias("to"))
    hops = hops.withColumn("node", F.col("to" if direction == "out" else "from"))
    distinct = hops.select("type", "from", "to").distinct()
    if fields is None and not whole:
        held = edge_objects(graph, distinct, ("version",))
        return hops.join(held, ["type", "from", "to"]).select("rank", "id", "hop", "type", "from", "to", "node", F.col("object.version").alias("version"))
    begin = taken.select("rank", "id", F.lit(0).cast("long").alias("hop"), *[F.lit(None).cast("string").alias(c) for c in ("type", "from", "to")], F.lit(start).alias("node"))
    hops = hops.unionByName(begin)
    edges = edge_objects(graph, distinct, fields).withColumnRenamed("object", "edge")
    nodes = node_objects(graph, hops.select(F.col("node").alias("id")).distinct(), fields).select(F.col("id").alias("node"), F.col("object").alias("at"))
    return hops.join(edges, ["type", "from", "to"], "left").join(nodes, "node").select("rank", "id", "hop", "type", "from", "to", "node", "at", "edge")


def expanded_edges(graph: Graph, start: str, over: str | None = None, direction: str = "out", depth: int = 1, limit: int = 100, most: int | None = None, checks: bool = True) -> int:
    """How many edges the walk looks at, each edge of each visited node, until the limit fills (in
    the middle of a node's edges); LimitExceeded beyond most. One pass over the reached nodes."""
    depth, limit, n = max(0, depth), max(0, limit), 0
    if depth and limit:
        all_ = materialize(_found(graph, start, over, direction, depth).select("id", "label", "depth", "keys"), "walk")
        begin = graph.spark.createDataFrame([(start, 0, [])], "id string, depth int, keys array<string>")
        seen = begin.unionByName(all_.drop("label")).where(F.col("depth") < depth).join(graph.adjacency(over, direction), F.col("id") == F.col("src"))
        seen = seen.select((F.col("depth") + 1).alias("depth"), F.concat("keys", F.array("key")).alias("keys"))
        last = all_.orderBy("depth", "keys").limit(limit).agg(F.count("*").alias("n"), F.max(F.struct("depth", "keys")).alias("last")).first()
        if last["n"] == limit:
            end = graph.spark.createDataFrame([(last["last"]["depth"], last["last"]["keys"])], "d int, k array<string>")
            seen = seen.join(F.broadcast(end), (F.col("depth") < F.col("d")) | ((F.col("depth") == F.col("d")) & (F.col("keys") <= F.col("k"))))
        n = seen.count() if last["n"] or not _missing(graph, start) else 0
    if most is not None and n > most:
        raise LimitExceeded(f"the walk looks at {n} edges, the limit is {most}")
    return n


def _missing(graph: Graph, node_id: str) -> bool:
    return graph.node_ids().where(F.col("id") == node_id).isEmpty()


@dataclass(frozen=True)
class Walk:
    """A walk put together step by step: Walk(graph, "ada").out("FOLLOWS").depth(2).paths().
    Every step returns a new one; the last direction wins."""

    graph: Graph
    start: str
    over: str | None = None
    direction: str = "out"
    levels: int = 1
    most: int = 100
    limits: Limits | None = STRICT

    def out(self, over: str | None = None) -> Walk:
        return replace(self, over=over, direction="out")

    def into(self, over: str | None = None) -> Walk:
        return replace(self, over=over, direction="in")

    def depth(self, n: int) -> Walk:
        return replace(self, levels=max(0, n))

    def limit(self, n: int) -> Walk:
        return replace(self, most=max(0, n))

    def unbounded(self) -> Walk:
        """The same walk without ceilings."""
        return replace(self, limits=None)

    def _how(self) -> tuple:
        return self.graph, self.start, self.over, self.direction, self.levels, self.most, self.limits

    def collect(self, fields: Sequence[str] | None = None) -> DataFrame:
        return walk(*self._how(), fields)

    def collect_as(self, model: type) -> list:
        """The nodes as instances of a dataclass, in order: its fields are the nodes' fields of these names. As many rows as the limit reach the driver."""
        names = list(model.__dataclass_fields__)
        rows = walk(*self._how(), names).orderBy("rank").collect()
        return [model(**{n: r[n] for n in names}) for r in rows]

    def paths(self, fields: Sequence[str] | None = None, whole: bool = False) -> DataFrame:
        return paths(*self._how(), fields, whole)
