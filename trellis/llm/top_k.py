"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

_BLOCKS = "number long, rows binary, ids binary, counts binary, terms binary, weights binary"
_ARRAYS = (("rows", np.int64), ("ids", np.int64), ("counts", np.int64), ("terms", np.int64), ("weights", np.float64))
_LONG = 2.0**63


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows (row, id, terms, weights) dealt evenly into blocks of at most about size rows, each one row of
    packed arrays; and how many blocks there are. They are numbered from 0."""
    parts = max(1, -(-rows.count() // size))

    def pack(it):
        held = [pdf for pdf in it if len(pdf)]
        if held:
            pdf = pd.concat(held).sort_values(["id", "row"])
            join = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in pdf[c]]).tobytes()
            counts = np.array([len(x) for x in pdf["terms"]], np.int64)
            yield pd.DataFrame([(int(pdf["row"].min()), pdf["row"].to_numpy(np.int64).tobytes(), pdf["id"].to_numpy(np.int64).tobytes(), counts.tobytes(), join("terms", np.int64), join("weights", np.float64))], columns=_BLOCKS.replace(" long", "").replace(" binary", "").split(", "))

    packed = materialize(rows.repartition(parts).mapInPandas(pack, _BLOCKS), name)
    numbers = packed.select("number").withColumn("at", F.row_number().over(W.orderBy("number")) - 1)  # a row per block
    return packed.join(numbers, "number").drop("number").withColumnRenamed("at", "number"), packed.count()


def _exact(weights: np.ndarray) -> np.ndarray:
    """Doubles of whole value as Python integers."""
    if not np.isfinite(weights).all():
        raise OverflowError("a weight is beyond the range of doubles")
    return np.array([int(w) for w in weights], object)


def score_block(q: tuple, c: tuple, k: int, at_once: int = 64) -> pd.DataFrame:
    """The k best candidates (of largest score, ties to smaller ids, then rows) of each query of a block.
    q and c: rows, ids, terms a row, terms, weights (doubles of whole value). Sums run in 64-bit integers where norms prove that
    scores fit them, in Python's integers elsewhere; OverflowError if a score among the best fits no 64 bits."""
    q_rows, q_ids, q_n, q_terms, q_weights = q
    c_rows, c_ids, c_n, c_terms, c_weights = c
    norm = lambda w, n: float(np.sqrt(np.bincount(np.repeat(np.arange(len(n)), n), w * w, len(n)).max(initial=0.0)))
    with np.errstate(over="ignore"):
        fits = norm(q_weights, q_n) * norm(c_weights, c_n) < _LONG * (1 - 1e-9) and max(np.abs(q_weights).max(initial=0), np.abs(c_weights).max(initial=0)) < _LONG
    kind, whole = (np.int64, lambda w: w.astype(np.int64)) if fits else (object, _exact)
    q_weights, c_weights = whole(q_weights), whole(c_weights)
    order = np.argsort(c_terms, kind="stable")
    row = np.repeat(np.arange(len(c_ids)), c_n)[order]
    weight, terms = c_weights[order], c_terms[order]
    names, begin = np.unique(terms, return_index=True)
    postings = {int(t): (row[a:b], weight[a:b]) for t, a, b in zip(names, begin, [*begin[1:], len(terms)], strict=True)}
    out = []
    ends = np.concatenate(([0], np.cumsum(q_n)))
    for lo in range(0, len(q_ids), at_once):
        hi = min(lo + at_once, len(q_ids))
        scores = np.zeros((hi - lo, len(c_ids)), kind)
        own_terms, own_weights = q_terms[ends[lo] : ends[hi]], q_weights[ends[lo] : ends[hi]]
        own_row = np.repeat(np.arange(hi - lo), q_n[lo:hi])
        by = np.argsort(own_terms, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], own_terms[by][1:] != own_terms[by][:-1]))) if len(by) else []
        for a, b in zip(starts, [*starts[1:], len(by)], strict=True):
            rows, w = postings.get(int(own_terms[by[a]]), (None, None))
            if rows is None:
                continue
            of, q_w = own_row[by[a:b]], own_weights[by[a:b]]
            if len(rows) == len(c_ids) and len(of) == hi - lo:
                scores += q_w[:, None] * w
            else:
                for i, x in zip(of.tolist(), q_w.tolist(), strict=True):
                    scores[i, rows] += x * w
        for i in range(hi - lo):
            others = np.flatnonzero(c_rows != q_rows[lo + i])
            s = scores[i, others]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                some = np.flatnonzero(s >= least)
                some = some[np.argsort(-s[some], kind="stable")][:k]  # ids ascend in a block
            else:
                some = np.argsort(-s, kind="stable")
            best = s[some]
            if not fits and len(best) and not (-(2**63) <= min(best) and max(best) < 2**63):
                raise OverflowError(f"a score of query {q_ids[lo + i]} fits no 64-bit integer")
            out.append(pd.DataFrame({"query_row": q_rows[lo + i], "query_id": q_ids[lo + i], "vec_id": c_ids[others[some]], "row": c_rows[others[some]], "score": best.astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "row": [], "score": []}, dtype="int64")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = 16_384, least_block: int = 1024) -> DataFrame:
    """queries and candidates (row long, id long, terms array<long>, weights array<double>; terms distinct in a
    row, weights of whole value) to query_id, rank (from 1), vec_id, score: for each query the k candidates of the
    largest inner product, ties to the smaller id, the query's own row left out; all, if fewer.

    row names a row on both sides (see numbered). Rows that share an id are queries and candidates of their own. Both sides are dealt evenly into blocks of bounded size, and each
    pair of blocks is a row of its own that meets by equal block numbers, so work is even whatever ids and values repeat; a block is copied
    once for every block of the other side. Each pair gives k rows a query, and a rank filter merges them, first inside each task.
    A side without rows gives no rows; a row without terms scores 0; rows that hold nulls (row, id, terms, weights) take no part.
    Scores are exact at any size; one among the best that fits no 64 bits is an OverflowError."""
    spark = queries.sparkSession
    cols = [F.col("row").cast("long").alias("row"), F.col("id").cast("long").alias("id"), F.col("terms").cast("array<long>").alias("terms"), F.col("weights").cast("array<double>").alias("weights")]
    whole = "row is not null and id is not null and terms is not null and weights is not null"
    queries, candidates = queries.select(*cols).where(whole), candidates.select(*cols).where(whole)
    share = -(-candidates.count() // (2 * spark.sparkContext.defaultParallelism))
    q, nq = _blocks(queries, block, "queries")
    c, nc = _blocks(candidates, min(block, max(least_block, share)), "candidates")
    if not nq or not nc:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    side = lambda df, p: [F.col(x).alias(f"{p}_{x}") for x, _ in _ARRAYS]
    left = q.select(F.col("number").alias("qn"), *side(q, "q"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cn"))
    right = c.select(F.col("number").alias("cn"), *side(c, "c"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qn"))

    def run(it):
        for pdf in it:
            for r in pdf.itertuples():
                arrays = lambda p: tuple(np.frombuffer(getattr(r, f"{p}_{x}"), kind) for x, kind in _ARRAYS)  # noqa: B023, E731
                yield score_block(arrays("q"), arrays("c"), k)

    best = left.join(right, ["qn", "cn"]).mapInPandas(run, "query_row long, query_id long, vec_id long, row long, score long")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with a column row that names each; written once, so that names stay."""
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vectors (vec_id, embedding) to id, terms, weights: floor(scale * x) of each component x, where
    not 0, exactly, as doubles. Rows whose vec_id or embedding is null, or that hold null or non-finite components, are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine)
    # Doubles from 2^53 on are whole, and floor gives a long.
    whole = lambda v: F.when(F.abs(v * scale) < 2.0**53, F.floor(v * scale).cast("double")).otherwise(v * scale)
    kept = F.filter(F.transform(x, lambda v, i: F.struct(i.cast("long").alias("t"), whole(v).alias("w"))), lambda s: s["w"] != 0)
    return rows.select(F.col("vec_id").cast("long").alias("id"), kept.alias("kept")).select("id", F.col("kept.t").alias("terms"), F.col("kept.w").alias("weights"))
