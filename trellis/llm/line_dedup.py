"""Drops lines that many documents hold, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, keep_first: bool = True, counts: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) with text less the lines that at least min_docs documents hold.

    Lines end at \\n. Lines are the same if their keys are, of at least min_chars code points.
    Such a line stays only in the smallest doc_id holding it (nowhere, without keep_first); all
    others stay in place. All columns of docs stay, then n_lines (before), n_dropped.
    A null or empty text is one empty line and comes out empty. A row without doc_id keeps all
    lines and counts for none. Rows that repeat a doc_id count as one document. An empty table
    gives no rows. Columns of docs of any name are left alone; where docs itself has an n_lines or n_dropped, that column
    stays and the new one is left out. Without counts the columns are those of docs.

    Exploded lines shuffle as two hashes (128 bits), document and position, never as text; the
    counts combine before the shuffle, and lines meet the repeated keys in a join whose skewed
    side adaptive execution splits. Texts move once, to meet their dropped positions."""
    other = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in other]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), F.split(text, "\n", -1).alias("lines")
    )
    lines = base.where("doc_id is not null").select("doc_id", "of", F.posexplode("lines").alias("at", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.length("key") >= min_chars).select("doc_id", "of", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"))
    if min_docs == 2:
        common = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    else:
        common = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # Written first, so that both sides of the join are plain shuffles, whose skewed parts are split.
    common = materialize(common.select("h1", "h2", "first"), "common")
    gone = lines.join(common, ["h1", "h2"])
    gone = gone.where("doc_id <> first") if keep_first else gone
    gone = gone.groupBy("doc_id", "of").agg(F.collect_set("at").alias("gone"))  # no more than the document's own lines
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), "gone")
    done = base.join(gone, ["doc_id", "of"], "left").select(
        "row",
        F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(kept, lambda i: F.col("lines")[i])).alias("kept"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    texts = F.array_join("kept", "\n")
    added = [c for c in ("n_lines", "n_dropped") if counts and c not in docs.columns]
    done = done.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
    return done.select(*[(texts if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns], *added)
