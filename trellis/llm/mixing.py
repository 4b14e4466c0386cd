"""Mixes sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD_CLASS, materialize, ranked


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes (source, source_size), a row per source, with target: weights repeat over the sources by code point, null last;
    targets are together share of all sizes; none is over most times its size, the excess going to the others by weight.

    Sources meet their cap in order of cap over weight: one does if the water that those before it leave, shared by
    weight, reaches its cap. Where all do (share above most), all targets are caps. What passes through one task is a row per source."""
    every = W.partitionBy()
    number = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    cap = F.col("source_size") * float(most)
    at = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))).withColumn("cap", cap)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    at = at.withColumn("total", share * F.sum("source_size").over(every)).withColumn("full", (F.col("total") - before) * F.col("weight") / after >= F.col("cap"))
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    return at.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(rest * F.col("weight") / open_).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """docs (doc_id, text, source, ...) with row_key (a hash of doc_id, text and source that names
    a row's content), size (words), source_size, target (both its source's), copies, taken
    (size * copies); texts and other columns are not in the result.

    A source's documents all expect target / source_size copies. They stand in order of size (then doc_id),
    every other stratum of one expected copy turned round so that errors of neighbours cancel;
    a document is taken once for each integer that its stretch of the prefix sum of expected
    copies, plus the source's one random offset, crosses. The offset comes from an MD5 of the seed and
    the source's name, so reruns agree.

    A null or empty text has size 0 and, as any other document, 0 to 2 copies. A null source is
    a source of its own, the last. Null doc_ids and repeated rows are rows like others. A
    source of size 0 has target 0 and is not taken. An empty table gives no rows.

    Expected copies are alike within a source, so prefix sums are ranks times the rate; ranks come from counts of ranges, and no
    source is sorted in one task. Nothing reaches the driver."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", F.coalesce("text", F.lit("")), "source").alias("row_key")
    )
    rows = materialize(rows.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))), "sizes")
    plan = targets(rows.groupBy("source", "name").agg(F.sum("size").alias("source_size")).select("source", "source_size"), weights, share, most)
    plan = plan.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "name").cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    plan = materialize(plan.withColumn("offset", draw), "plan")  # a row per source
    # The expected copies beyond whole ones; strata hold one expected copy each, and odd ones are turned round.
    ranks = ranked(rows, "name", ["size", "doc_id", "row_key"]).join(plan, "name").withColumn("part", F.col("rate") - F.floor("rate"))
    stratum = F.floor(F.col("rank") * F.col("part"))
    first, after = F.ceil(stratum / F.col("part")), F.ceil((stratum + 1) / F.col("part"))
    ranks = ranks.withColumn("at", F.when((F.col("part") > 0) & (stratum % 2 == 1), first + after - 1 - F.col("rank")).otherwise(F.col("rank")))
    crossed = F.floor((F.col("at") + 1) * F.col("part") + F.col("offset")) - F.floor(F.col("at") * F.col("part") + F.col("offset"))
    chosen = ranks.withColumn("copies", (F.floor("rate") + crossed).cast("long"))
    return chosen.select("doc_id", "source", "row_key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with all their columns: each as many times as it is taken."""
    picked = mix(docs, **how)
    # Rows alike in doc_id, text and source share a key; they are numbered so that each meets its own copies.
    numbered = picked.groupBy("row_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")), F.col("source")).alias("row_key"))
    alone = rows.join(numbered.where("copies > 0"), "row_key").withColumn(
        "nth", F.when(F.col("n") > 1, F.row_number().over(W.partitionBy("row_key").orderBy(F.xxhash64("row")))).otherwise(1)
    )
    times = (F.floor(F.col("copies") * F.col("nth") / F.col("n")) - F.floor(F.col("copies") * (F.col("nth") - 1) / F.col("n"))).cast("int")
    return alone.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("row.*")
