from collections import defaultdict

import pytest

from trellis.llm.components import components
from trellis.llm.ngram_join import jaccard_join


def brute(rows, percent=75):
    sets, links = [], defaultdict(int)
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is None or e is None or not s or not t:
                continue
            if 100 * len(s & t) >= percent * len(s | t):
                links[id(s)] += 1
                links[id(t)] += 1
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return sorted((str(d), len(s), links[id(s)], d if d is None else find(d)) for d, s in sets)


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, r.n_links, r.component_id) for r in df.collect())


@pytest.mark.parametrize("blocks", [2048, 3])
def test_table(docs, blocks):
    assert got(jaccard_join(docs, block_sets=blocks)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_short_lists_off_and_on(docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 60)
    assert got(jaccard_join(docs, percent=60, short_list=1)) == want
    assert got(jaccard_join(docs, percent=60, heavy_least=1, heavy_limit=10**6)) == want


def test_odd_rows(odd):
    assert got(jaccard_join(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_near_copies_of_all_degrees(spark):
    import random

    r = random.Random(4)
    base = [f"w{r.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for blocks in (2048, 16):
        assert got(jaccard_join(df, block_sets=blocks)) == brute(rows)


def test_empty(empty):
    assert jaccard_join(empty).collect() == []


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 20), (7, 7), (None, 1)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 240)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.id: r.component for r in components(df).collect()}
    want = {5: 3, 4: 3, 3: 3, 9: 3, 20: 20, 21: 20} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 241)}
    assert found == want
