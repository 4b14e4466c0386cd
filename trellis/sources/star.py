"""The star-schema tables as a property graph."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, Link


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nodes Region, Nation, Customer, Supplier, Part, Order, Event, Document (quality only where
    labelled), Turn; edges IN_REGION, IN_NATION, PLACED, CONTAINS, SUPPLIED_BY, DID, NEXT. Lines of
    an order for the same part are one CONTAINS edge with their sum and count, as are lines of a
    part from the same supplier in SUPPLIED_BY. A table is opened when a query first names it, and scanned for the columns it uses;
    keys stay integers until a result shows them as ids, so that they reach the scans."""

    @cache
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    ms = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1000).cast("long")
    key = lambda c: F.col(c).cast("long").alias("key")

    def documents() -> DataFrame:
        quality = t("labels").select(F.col("doc_id").alias("labelled"), F.col("quality").cast("long").alias("quality"))
        return t("documents").join(quality, F.col("doc_id") == F.col("labelled"), "left").select(key("doc_id"), "lang", "source", "n_chars", "quality")

    turn = lambda n: F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), n.cast("string"))
    graph = (
        Graph(spark)
        .with_keyed("Region", "region:", lambda: t("region").select(key("r_regionkey"), F.col("r_name").alias("name")))
        .with_keyed("Nation", "nation:", lambda: t("nation").select(key("n_nationkey"), F.col("n_name").alias("name")))
        .with_keyed("Customer", "customer:", lambda: t("customer").select(key("c_custkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment")))
        .with_keyed("Supplier", "supplier:", lambda: t("supplier").select(key("s_suppkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")))
        .with_keyed("Part", "part:", lambda: t("part").select(key("p_partkey"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("retailprice")))
        .with_keyed("Order", "order:", lambda: t("orders").select(key("o_orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("totalprice"), ms("o_orderdate").alias("orderdate_ms"), F.col("o_orderpriority").alias("priority")))
        .with_keyed("Event", "event:", lambda: t("events").select(key("event_id"), "event_type", "value", ms("ts").alias("ts_ms")))
        .with_keyed("Document", "doc:", documents)
        .with_keyed("Turn", "turn:", lambda: t("conversations").select(turn(F.col("turn")).alias("key"), "role"), text=True)
    )

    def pairs(table: str, src: str, dst: str, *more: str) -> DataFrame:
        return t(table).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), *more)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("src", "dst").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))

    def next_turns() -> DataFrame:
        turns = t("conversations").select("conv_id", "turn")
        both = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"])
        return both.select(turn(F.col("turn")).alias("src"), turn(F.col("turn") + 1).alias("dst"))

    source, target, both = frozenset({"source"}), frozenset({"target"}), frozenset({"source", "target"})
    return (
        graph.with_links("IN_REGION", Link("Nation", "Region", lambda: pairs("nation", "n_nationkey", "n_regionkey"), sure=source))
        .with_links("IN_NATION", Link("Customer", "Nation", lambda: pairs("customer", "c_custkey", "c_nationkey"), sure=source), Link("Supplier", "Nation", lambda: pairs("supplier", "s_suppkey", "s_nationkey"), sure=source))
        .with_links("PLACED", Link("Customer", "Order", lambda: pairs("orders", "o_custkey", "o_orderkey"), sure=target))
        .with_links("CONTAINS", Link("Order", "Part", lambda: pairs("lineitem", "l_orderkey", "l_partkey", "l_quantity"), summed))
        .with_links("SUPPLIED_BY", Link("Part", "Supplier", lambda: pairs("lineitem", "l_partkey", "l_suppkey", "l_quantity"), summed))
        .with_links("DID", Link("Customer", "Event", lambda: pairs("events", "user_id", "event_id"), sure=target))
        .with_links("NEXT", Link("Turn", "Turn", next_turns, sure=both))
    )
