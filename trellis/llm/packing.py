"""Best-fit packing of tokenized documents by patterns of lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked
from .tokens import encode_words


def patterns(room: int, step: int) -> np.ndarray:
    """Rows of up to three lengths (0: none) that together fill a sequence: all of one and
    two, and of three those whose middle one is a multiple of step."""
    two = [(room - b, b, 0) for b in range(1, room // 2 + 1)]
    three = [(room - b - c, b, c) for b in range(step, room // 2 + 1, step) for c in range(1, min(b, room - 2 * b) + 1)]
    return np.array([(room, 0, 0), *two, *three], np.int64)


def fit(histogram: np.ndarray, kinds: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of least squares |A x - histogram|, A counting lengths in patterns,
    by accelerated projected gradient. histogram[n]: pieces of n tokens; entry 0 is not used."""
    used = (kinds > 0).astype(float)

    def ahead(x: np.ndarray) -> np.ndarray:
        return np.bincount(kinds.ravel(), (used * x[:, None]).ravel(), len(histogram))

    v = np.ones(len(kinds))
    for _ in range(20):  # largest eigenvalue of A'A
        v = (used * ahead(v)[kinds]).sum(1)
        big = float(np.linalg.norm(v))
        v /= big or 1
    x = y = np.zeros(len(kinds))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - (used * (ahead(y) - histogram)[kinds]).sum(1) / (1.01 * big))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: np.ndarray, room: int, step: int = 16) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where pieces go: runs (length, first, count, sequence, offset) mean that the pieces number
    first to first + count - 1 of that length start at offset in sequences sequence,
    sequence + 1, ...; and the number of sequences. Work and result depend on room alone:
    they follow lengths and counts, never single pieces."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    seen = np.zeros(len(left), np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    kinds = patterns(room, step)
    kinds = kinds[((kinds == 0) | (left[kinds] > 0)).all(1)]
    if len(kinds):
        x = fit(left.astype(float), kinds)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            parts = [n for n in kinds[k].tolist() if n]
            times = min(int(round(x[k])), *(int(left[n]) // parts.count(n) for n in parts))
            if times > 0:
                at = 0
                for n in parts:
                    runs.append((n, int(seen[n]), times, sequences, at))
                    seen[n] += times
                    left[n] -= times
                    at += n
                sequences += times
    # Residuals, the longest first, into the fullest sequences that they fit; open_[r] holds runs of sequences with r tokens to spare.
    open_: dict[int, list[tuple[int, int]]] = {}
    for n in range(room, 0, -1):
        while left[n]:
            spare = min((r for r in open_ if r >= n), default=None)
            if spare is None:
                times, first, spare = int(left[n]), sequences, room
                sequences += times
            else:
                first, many = open_[spare].pop()
                times = min(many, int(left[n]))
                if times < many:
                    open_[spare].append((first + times, many - times))
                if not open_[spare]:
                    del open_[spare]
            runs.append((n, int(seen[n]), times, first, room - spare))
            seen[n] += times
            left[n] -= times
            if spare > n:
                open_.setdefault(spare - n, []).append((first, times))
    return runs, sequences


def pieces(docs: DataFrame, tokenizer: str, room: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) to its pieces: doc_id, piece, start, length, ids_crc32 (and ids, the
    little-endian unsigned 32-bit ids, with_ids). Every document ends in the id ``end``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    last = np.array([end], "<u4").tobytes()

    def cut(it):
        for pdf in it:
            out = []
            for doc, missing, text in zip(pdf["doc_id"], pdf["missing"], pdf["text"], strict=True):
                ids = encode_words(tokenizer, text) + last
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    out.append((None if missing else doc, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            got = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            yield got.assign(doc_id=got["doc_id"].astype("Int64"))

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), "text")
    return rows.mapInPandas(cut, schema)


def pack(docs: DataFrame, tokenizer: str, room: int = 2048, end: int = 0, step: int = 16, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most room tokens: pieces() with sequence_id and
    offset. Only documents longer than room are cut. A null or empty text is its end id alone.
    A null doc_id stays null, repeated rows are documents of their own, other columns are
    ignored, and an empty table gives no rows.

    The driver sees a histogram of room lengths and plans on it (patterns of up to three lengths
    fitted by non-negative least squares, rounded; best fit for the rest). The plan's runs
    depend on room, not on the number of pieces, so they go to all tasks. Pieces are numbered
    within their length by ranges, so that a length that most
    pieces have, as full ones, and equal pieces of rows without doc_id are dealt over many tasks."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, room, end, with_ids), "pieces")
    lengths = cut.groupBy("length").agg(F.count("*").alias("n")).collect()
    histogram = np.zeros(room + 1, np.int64)
    for r in lengths:
        histogram[r["length"]] = r["n"]
    runs, _ = plan(histogram, room, step)
    keyed = ranked(cut, "length", ["doc_id", "piece", "ids_crc32"]).withColumnRenamed("rank", "number")
    table = spark.createDataFrame(pd.DataFrame(runs or [(0, 0, 0, 0, 0)], columns=["length", "first", "count", "sequence", "offset"]))
    # A run's pieces are found by length and cell: runs are cut at multiples of the cell width.
    wide = max(1, int(histogram.max()) // 64)
    cells = table.where("count > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / wide), F.floor((F.col("first") + F.col("count") - 1) / wide))))
    placed = keyed.withColumn("cell", F.floor(F.col("number") / wide)).join(F.broadcast(cells), ["length", "cell"])
    placed = placed.where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("count")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), F.col("offset"), *["ids"] * with_ids)
