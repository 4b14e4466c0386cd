import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trellis.llm.embedding_dedup import near_duplicates
from trellis.llm.top_k import numbered, quantized, top_k

NAN, INF = float("nan"), float("inf")
ODD = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, [NAN, 1.0]), (5, [INF, 1.0]), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [1e30, 1.0]), (None, [1.0, 2.0]), (100, [1.0, -2.0]), (200, [0.0, 0.0]), (9, [])]


def brute_top(rows, k):
    """rows (vec_id, vector): every row of an id divisible by 100 against every other row."""
    whole = [(d, {i: w for i, x in enumerate(v) if (w := math.floor(Fraction(1024) * Fraction(x)))}) for d, v in rows]
    out = []
    for at, (a, q) in enumerate(whole):
        if a % 100 == 0:
            best = sorted((-sum(x * c.get(i, 0) for i, x in q.items()), b) for other, (b, c) in enumerate(whole) if other != at)[:k]
            out += [(a, i + 1, b, -s) for i, (s, b) in enumerate(best)]
    return sorted(out)


def got_top(df):
    return sorted(tuple(r) for r in df.collect())


def searched(spark, rows, k=10, *sizes):
    q = numbered(quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)))
    return got_top(top_k(q.where("id % 100 = 0"), q, k, *sizes))


@pytest.mark.parametrize("sizes", [(16_384, 1024), (7, 2)])
def test_top_k(spark, sf, sizes):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = numbered(quantized(df))
    out = top_k(rows.where("id % 100 = 0"), rows, 10, *sizes)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "bigint"]
    assert got_top(out) == brute_top([(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()], 10)


def test_top_k_ties_and_odd(spark):
    rows = [(i, [float(i % 3), 1.0, 0.0]) for i in range(300)]
    assert searched(spark, rows, 10, 50, 2) == brute_top(rows, 10)
    some = [r for r in ODD if r[0] != 8]
    fine = [(d, v) for d, v in some if d is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert searched(spark, some) == brute_top(fine, 10)
    none = numbered(quantized(spark.createDataFrame([], "vec_id long, embedding array<double>")))
    assert top_k(none, none).collect() == []


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (5, [2.0, 2.0]), (5, [2.0, 2.0]), (6, [0.5, 0.25])]
    assert searched(spark, rows, 3) == brute_top(rows, 3)
    assert searched(spark, rows, 10) == brute_top(rows, 10)


def test_top_k_of_large_values(spark):
    for big in (2e5, 1e6):
        rows = [(0, [big, 1.0]), (1, [big, -3.5]), (2, [-big, 0.1]), (100, [1.0, big]), (3, [0.3, 7.0])]
        assert searched(spark, rows) == brute_top(rows, 10)
    # Norms forbid 64-bit sums here, but the scores fit.
    rows = [(0, [3e9, 3e9]), (1, [3e9, -3e9]), (2, [1.0, 1e-3]), (100, [1e-3, 0.0]), (3, [-1e9, 1e9])]
    assert searched(spark, rows) == brute_top(rows, 10)
    # A component beyond 64 bits is exact; it comes last, so its score need not fit.
    rows = [(0, [1.0, 2.0]), (1, [-1e30, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0])]
    assert searched(spark, rows, 2) == brute_top(rows, 2)
    with pytest.raises(Exception, match="fits no 64-bit integer"):
        searched(spark, [(0, [1.0, 2.0]), (1, [1e30, 0.0])], 2)


def brute_links(rows, cosine):
    ids = [d for d, _ in rows]
    x = np.array([v for _, v in rows], float)
    x = x / np.sqrt((x * x).sum(1))[:, None]
    link = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    part = {d: d for d in ids}

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = find(ids[i]), find(ids[j])
        part[max(a, b)] = min(a, b)
    return {d: (int(link[i].sum()), find(d)) for i, d in enumerate(ids)}


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    near = [x[i % 40] + rng.normal(size=64) * rng.uniform(0.02, 0.25) for i in range(900)]
    hot = [x[50] + rng.normal(size=64) * 0.1 for _ in range(400)]
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate([*x, *near, *hot, *x[:50]])]
    want = brute_links(rows, 0.95)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    for block in (1024, 100):
        out = {r.vec_id: r for r in near_duplicates(df, block=block).collect()}
        assert len(out) == len(rows)
        found, true = sum(r.n_links for r in out.values()), sum(n for n, _ in want.values())
        assert 0.97 * true <= found <= true
        assert all(out[d].n_links <= n for d, (n, _) in want.items())
        same = np.mean([out[d].component_id == c for d, (_, c) in want.items()])
        assert same >= 0.99


def test_all_probes_lose_nothing(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    want = brute_links(rows, 0.9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for how in ({"plain": 0, "probes": 500, "sigmas": 8, "rows_a_list": 20, "block": 16}, {}):
        assert {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df, cosine=0.9, **how).collect()} == want


def test_recall_on_a_large_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(35_000, 64)).astype("f4")
    near = np.repeat(x[:1000], 5, axis=0)
    near = near + (rng.normal(size=near.shape) * rng.uniform(0.02, 0.25, (len(near), 1))).astype("f4")
    every = np.concatenate([x, near])
    rows = pa.table({"vec_id": np.arange(len(every)), "embedding": pa.FixedSizeListArray.from_arrays(every.ravel(), 64)})
    pq.write_table(rows, tmp_path / "vectors.parquet", row_group_size=20_000)
    df = spark.read.parquet(str(tmp_path / "vectors.parquet"))
    planted = [*range(1000), *range(35_000, 40_000)]
    want = brute_links([(i, every[i].astype(float)) for i in planted], 0.95)
    out = {r.vec_id: r.n_links for r in near_duplicates(df).collect()}
    found, true = sum(out.values()), sum(n for n, _ in want.values())
    assert len(out) == len(every) and 0.97 * true <= found <= true


def test_lengths_and_sizes(spark):
    rows = [(i, [float(i % 7 + 1), 2.0, float(i)]) for i in range(40)] + [(100, [1.0, 2.0]), (101, [1.0, 2.01]), (102, [-1.0, 2.0])]
    rows += [(200, [1e-200, 2e-200, 0.0, 0.0]), (201, [1e-200, 2.01e-200, 0.0, 0.0]), (202, [1e200, 2e200, 0.0, 0.0]), (203, [5e-324, 1e-323, 0.0, 0.0]), (204, [1e308, 0.0, 1e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for plain in (512, 2):
        out = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df, plain=plain).collect()}
        assert [out[i] for i in (100, 101, 102)] == [(1, 100), (1, 100), (0, 102)]
        assert [out[i] for i in (200, 201, 202, 203, 204)] == [(3, 200), (3, 200), (3, 200), (3, 200), (0, 204)]
        assert {i: out[i] for i in range(40)} == brute_links(rows[:40], 0.95)


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (7, [0.0, 2.0]), (8, [1.0, 0.01]), (9, [-1.0, 0.0])]
    out = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert out == [(1, 1, 1, True), (1, 1, 1, True), (7, 1, 1, False), (8, 1, 1, False), (9, 0, 9, True)]


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumn("h1", F.lit("x"))
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert out[0] == (2, 0, True) and out[1] == (2, 0, False) and out[2] == (2, 0, False)
    assert out[3] == (0, 3, True) and out[4] == (0, 4, True) and out[6] == (0, 6, True) and out[None] == (0, None, False) and out[9] == (0, 9, True)
    assert near_duplicates(df.limit(0)).collect() == []
