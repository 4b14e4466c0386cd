"""Graphs in Parquet, as numbered generations in a folder that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, CorruptData, UnsupportedVersion
from ..graph import Graph

_FORMAT = 1


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete generations, ascending."""
    at, fs = _files(spark, path)
    if not fs.exists(at):
        return []
    done = [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(_files(spark, f"{s.getPath()}/manifest/_SUCCESS")[0])]
    return sorted(int(n[4:]) for n in done if n.startswith("gen-") and n[4:].isdigit())


def save(graph: Graph, path: str, lsn: int = 0) -> int:
    """Writes a new generation and returns its number; a path elsewhere makes a consistent copy. Nodes are clustered by id, or by the first property that a declared
    index names for the label (then id, which has Bloom filters either way), and edges by source, so that point reads, finds by the property and frontiers skip row groups.
    The manifest comes last: without it a generation does not exist, so a failed save leaves
    the last one in force."""
    spark = graph.spark
    number = (generations(spark, path) or [0])[-1] + 1
    here = f"{path}/gen-{number}"
    at, fs = _files(spark, here)
    if fs.exists(at):
        raise Conflict(f"{here} is being written or was left unfinished")
    rows = []
    for i, k in enumerate(sorted(graph.nodes)):
        df = graph.nodes[k]
        declared = [p for label, p in sorted(graph.indexes) if label == k and p in df.columns]
        by = [F.col(f"`{declared[0]}`"), F.col("id")] if declared else [F.col("id")]
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{here}/nodes/{i}")
        rows.append(("nodes", k, i, lsn))
    for i, k in enumerate(sorted(graph.edges)):
        df = graph.edges[k]
        df.repartitionByRange("from", "to").sortWithinPartitions("from", "to").write.parquet(f"{here}/edges/{i}")
        rows.append(("edges", k, i, lsn))
    rows += [(f"index:{label}", prop, 0, lsn) for label, prop in sorted(graph.indexes)]
    rows.append(("format", str(_FORMAT), 0, lsn))
    spark.createDataFrame(rows, "part string, name string, at int, lsn long").coalesce(1).write.json(f"{here}/manifest")
    return number


def load(spark: SparkSession, path: str, generation: int | None = None) -> Graph:
    """The graph of a generation, by default the newest."""
    known = generations(spark, path)
    if not known or (generation is not None and generation not in known):
        raise CorruptData(f"{path} has no such generation")
    here = f"{path}/gen-{generation or known[-1]}"
    graph = Graph(spark)
    rows = spark.read.schema("part string, name string, at int, lsn long").json(f"{here}/manifest").collect()  # a row per label, type and index
    formats = {r["name"] for r in rows if r["part"] == "format"}
    if not formats:
        raise CorruptData(f"{here} has no format")
    if formats != {str(_FORMAT)}:
        raise UnsupportedVersion(f"{here} has format {', '.join(sorted(formats))}")
    for r in rows:
        if r["part"] == "nodes":
            graph = graph.with_nodes(r["name"], spark.read.parquet(f"{here}/nodes/{r['at']}"))
        elif r["part"] == "edges":
            graph = graph.with_edges(r["name"], spark.read.parquet(f"{here}/edges/{r['at']}"))
        elif r["part"].startswith("index:"):
            graph = graph.with_index(r["part"][6:], r["name"])
    return graph


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes all but the newest generations."""
    old = generations(spark, path)[:-keep] if keep > 0 else []
    for n in old:
        at, fs = _files(spark, f"{path}/gen-{n}")
        fs.delete(at, True)
    return old


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Nodes and edges by label and type in the newest generation."""
    from ..operators.verify import verify

    return verify(load(spark, path)).where(F.col("check").isin("nodes", "edges"))
