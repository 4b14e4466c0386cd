"""Integrity of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, _union, row_counts, tasks
from ..scratch import materialize

_COUNTS = ("edges", "repeated edges", "dangling edges")


def _native(graph: Graph) -> bool:
    """Whether all is known by native keys, and no id can be of two labels."""
    prefixes = [graph.keyed[k].prefix for k in graph.nodes if k in graph.keyed]
    return len(prefixes) == len(graph.nodes) and all(k in graph.links for k in graph.edges) and not any(a.startswith(b) for i, a in enumerate(prefixes) for j, b in enumerate(prefixes) if i != j)


def _counted(df: DataFrame, n: int, *by: str) -> DataFrame:
    """How many rows each key has, dealt over n tasks before anything is gathered."""
    return df.repartition(n, *by).groupBy(*by).agg(F.count("*").alias("n"))


def _by_type(pairs: DataFrame, sources: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """pairs (type, source, src, target, dst, n) without nulls, and ids (key, n, and label where keys of several labels may be equal)
    of either end, to counts by type. Every join is one of sorted tables: no side of them is small, whatever a scan's size promises."""
    for end, key, ids in (("source", "src", sources), ("target", "dst", targets)):
        by = {"label": end, "key": key} if "label" in ids.columns else {"key": key}
        exist = ids.select(*[F.col(c).alias(d) for c, d in by.items()], F.lit(True).alias(f"has_{key}"))
        pairs = pairs.repartition(n, *by.values()).join(exist.hint("merge"), list(by.values()), "left")
    lost = F.col("has_src").isNull() | F.col("has_dst").isNull()
    return _totals(pairs, F.when(lost, F.col("n")).otherwise(0))


def _totals(pairs: DataFrame, lost) -> DataFrame:
    sums = (F.sum("n"), F.sum((F.col("n") > 1).cast("long")), F.sum(lost))
    return pairs.groupBy("type").agg(*[s.alias(c) for s, c in zip(sums, _COUNTS)])


def _tables(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes by label, edges by type and repeated ids of any graph, by ids."""
    kinds = sorted(graph.edges)
    edges = _union(graph.spark, [graph.edges[k].select(F.lit(k).alias("type"), "from", "to") for k in kinds], "type string, from string, to string")
    nodes, edges = materialize(graph.node_ids(), "verify"), materialize(edges, "verify")  # they tell their sizes now, and changes are made once
    n = tasks(sum(row_counts([nodes, edges])))
    ids = _counted(nodes.select(F.col("id").alias("key")), n, "key")
    pairs = _counted(edges, n, "type", "from", "to").select("type", F.col("from").alias("src"), F.col("to").alias("dst"), "n")
    return nodes.groupBy("label").agg(F.count("*").alias("nodes")), _by_type(pairs, ids, ids, n), ids.agg(F.sum((F.col("n") > 1).cast("long")).alias("n"))


def _keyed_tables(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same by native keys. Null keys, which are one id whatever the label, are counted apart."""
    labels, links = sorted(graph.nodes), {k: graph.links[k] for k in sorted(graph.edges)}
    held, ids = {k: graph.keyed[k].table.select("key") for k in labels}, {}
    every = [x for v in links.values() for x in v]
    counts = row_counts([*held.values(), *[x.table for x in every]])
    n, size = tasks(sum(counts)), {id(x): c for x, c in zip(every, counts[len(labels) :])}

    def among(those: list[str]) -> DataFrame:
        """Ids of labels of one kind of key. Texts tell their label, and one label needs none: a constant would only hide how its rows are dealt."""
        by = ["key"] if len(those) == 1 or graph.keyed[those[0]].text else ["label", "key"]
        return _counted(_union(graph.spark, [held[k].where("key is not null").select(F.lit(labels.index(k)).alias("label"), "key").select(*by) for k in those], ""), n, *by)

    for text in {graph.keyed[k].text for k in labels}:
        ids[text] = among([k for k in labels if graph.keyed[k].text == text])
    nulls = _union(graph.spark, [df.where("key is null").select(F.lit(1).alias("one")) for df in held.values()], "one int").agg((F.count("*") > 1).cast("long").alias("n"))
    repeated = reduce(DataFrame.unionByName, [nulls, *[df.agg(F.sum((F.col("n") > 1).cast("long")).alias("n")) for df in ids.values()]]).agg(F.sum("n").alias("n"))
    nodes = _union(graph.spark, [df.agg(F.count("*").alias("nodes")).select(F.lit(k).alias("label"), "nodes") for k, df in held.items()], "label string, nodes long")
    pairs: dict[tuple[bool, bool], list[tuple[str, str, DataFrame]]] = {}
    for kind, those in links.items():
        for a, b in sorted({(x.source, x.target) for x in those}):
            same = [x for x in those if (x.source, x.target) == (a, b)]
            rows = [x.fold(x.table.where("src is not null and dst is not null").repartition(tasks(size[id(x)]), "src", "dst")).select("src", "dst") for x in same]
            rows = rows[0] if len(rows) == 1 else reduce(DataFrame.unionByName, rows).repartition(tasks(sum(size[id(x)] for x in same)), "src", "dst")
            rows = rows.groupBy("src", "dst").agg(F.count("*").alias("n"))
            rows = rows.select(F.lit(kind).alias("type"), F.lit(labels.index(a)).alias("source"), "src", F.lit(labels.index(b)).alias("target"), "dst", "n")
            pairs.setdefault((graph.keyed[a].text, graph.keyed[b].text), []).append((a, b, rows))
    parts = []
    for texts, some in sorted(pairs.items(), key=lambda x: x[0]):
        at = [ids[text] if text or len(ends) > 1 else among(list(ends)) for text, ends in zip(texts, ({x[0] for x in some}, {x[1] for x in some}))]
        parts.append(_by_type(_union(graph.spark, [x[2] for x in some], ""), *at, n))
    half = [graph.edge_rows(x, x.table.where("src is null or dst is null")).select(F.lit(k).alias("type"), "from", "to") for k, v in links.items() for x in v]
    half = _union(graph.spark, half, "type string, from string, to string").groupBy("type", "from", "to").agg(F.count("*").alias("n"))
    by_type = _union(graph.spark, [*parts, _totals(half, F.col("n"))], "").groupBy("type").agg(*[F.sum(f"`{c}`").alias(c) for c in _COUNTS])
    return nodes, by_type, repeated


def verify(graph: Graph) -> DataFrame:
    """Rows (check, name, n): nodes and edges of each label and type, ids that several nodes have,
    edges given twice, and edges with an end that does not exist. Counts are longs.

    Edges are counted once by both ends, then meet the ids at either end, in as many tasks as there are rows for. Where all labels have native keys and
    all types have links, keys stay native; other graphs are counted by ids."""
    nodes, by_type, repeated = (_keyed_tables if _native(graph) else _tables)(graph)
    # Labels and types without rows have their row of zeros.
    named = lambda names, c: graph.spark.createDataFrame([(n,) for n in sorted(names)], f"{c} string")
    nodes = named(graph.nodes, "label").join(nodes, "label", "left").select(F.lit("nodes").alias("check"), F.col("label").alias("name"), F.coalesce("nodes", F.lit(0)).alias("n"))
    by_type = named(graph.edges, "type").join(by_type, "type", "left")
    by_type = by_type.select("type", F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n")) for c in _COUNTS])).alias("c")).select("c.check", F.col("type").alias("name"), "c.n")
    repeated = repeated.select(F.lit("repeated ids").alias("check"), F.lit("").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    return nodes.unionByName(by_type).unionByName(repeated)
