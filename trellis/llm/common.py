"""Shared helpers: tables by name and hashes of words, taken from Arrow's own text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..scratch import discard, materialize, new_path, remove

__all__ = ["discard", "materialize", "new_path", "remove"]

#: The bytes that separate words, [\x20\x09-\x0D].
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WINDOW = 1 << 17
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with rank: the place (from 0) of each among those of its group, by order. rows is a table that is read alike each time.

    Rows are dealt by ranges of group, order and their own place in the table, so that neither a large group nor equal rows
    share a task; each task counts as it streams, and counts of a group's tasks give where each begins."""
    ranged = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(group, *order, "nth").sortWithinPartitions(group, *order, "nth")

    def count(it):
        last, n = None, 0
        for batch in it:
            values = batch.column(group).to_pandas().to_numpy()
            if not len(values):
                continue
            starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            own = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
            if last is not None and values[0] == last:
                own[: starts[1] if len(starts) > 1 else len(own)] += n
            last, n = values[-1], int(own[-1]) + 1
            yield batch.append_column("own", pa.array(own))

    placed = ranged.drop("nth").withColumn("task", F.spark_partition_id())
    done = materialize(placed.mapInArrow(count, T.StructType([*placed.schema.fields, T.StructField("own", T.LongType())])), "ranked")
    sizes = done.groupBy("task", group).agg(F.count("*").alias("n"))  # a row per task and group in it
    before = F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = materialize(sizes.select("task", group, before.alias("before")), "begins")
    return done.join(begins, ["task", group]).withColumn("rank", F.col("before") + F.col("own")).drop("task", "before", "own")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z alone. lower() is quicker and does the same where every character is one byte."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads uint64 values (the splitmix64 finalizer)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def raw_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts end to end, and where each begins (one more entry than texts)."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


def arrow_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As raw_texts, of an Arrow column of strings, without a copy. Nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _windows(buf: np.ndarray, edges: np.ndarray, apart: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about _WINDOW that end between words."""
    at, last = int(edges[0]), int(edges[-1])
    while at < last:
        to = min(at + _WINDOW, last)
        edge = int(edges[np.searchsorted(edges, to)])
        while to < edge and not apart[buf[to - 1]]:
            step = np.flatnonzero(apart[buf[to : min(to + 4096, edge)]])
            to = to + int(step[0]) + 1 if len(step) else min(to + 4096, edge)
        yield at, to
        at = to


def word_hashes(buf: np.ndarray, edges: np.ndarray, apart: np.ndarray = _IS_SPACE, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words (A-Z lower-cased) of texts (bytes, and where each begins), one after
    another; for each of stems, hashes of the words' first so many bytes; and, last, where each text's
    words begin (one more entry than texts). apart tells the bytes that separate words. Works through windows of
    about 128 KB that end between words, so a long text needs no more memory."""
    hashes: list[list[np.ndarray]] = [[] for _ in range(1 + len(stems))]
    starts = []
    for at, to in _windows(buf, edges, apart):
        part = _LOWERED[buf[at:to]]
        space = apart[part]
        begins = np.concatenate(([True], space[:-1]))
        begins[edges[np.searchsorted(edges, at) : np.searchsorted(edges, to)] - at] = True
        first = np.flatnonzero(~space & begins)
        if len(first):
            part, space = part[first[0] :], space[first[0] :]
            rel = first - first[0]
            size = np.diff(np.append(rel, len(part)))
            place = np.arange(len(part)) - np.repeat(rel, size)
            value = _BYTE_VALUES[part]
            value[space] = 0
            value *= _powers(int(size.max()))[place]
            hashes[0].append(mix64(np.add.reduceat(value, rel)))
            for k, n in enumerate(stems):
                hashes[k + 1].append(mix64(np.add.reduceat(np.where(place < n, value, np.uint64(0)), rel)))
            starts.append(first + at)
    if not starts:
        return *[np.zeros(0, np.uint64) for _ in hashes], np.zeros(len(edges), np.int64)
    return *[np.concatenate(h) for h in hashes], np.searchsorted(np.concatenate(starts), edges, side="left")


def slices(edges: np.ndarray, budget: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about budget bytes each, given where each text begins."""
    at, n = 0, len(edges) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + budget, side="left")))
        yield at, min(to, n)
        at = min(to, n)


def shingle_sets(buf: np.ndarray, edges: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's width-word shingles; a text of fewer words
    has its whole sequence as its only shingle, one without words the empty set."""
    for lo, hi in slices(edges):
        words, bounds = word_hashes(buf, edges[lo : hi + 1])
        grams = words[: max(0, len(words) - width + 1)].copy()
        for j in range(1, width):
            grams = mix64(grams * _BASE + words[j : j + len(grams)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                acc = mix64(words[a : a + 1] + np.uint64(b - a))
                for w in words[a + 1 : b]:
                    acc = mix64(acc * _BASE + w)
                yield acc
            else:
                yield np.zeros(0, np.uint64)
