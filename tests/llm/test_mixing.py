import hashlib
import math
import re
from collections import defaultdict

import pytest

from trellis.llm.common import ranked
from trellis.llm.mixing import mix, mixed_documents, targets


def by_hand(sizes):
    """Targets by raising one water level in small steps' place: a search for the level."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, lo, hi = 1.5 * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sizes[s], mid * weight[s]) for s in sizes) < goal else (lo, mid)
    return {s: min(2 * sizes[s], lo * weight[s]) for s in sizes}


def test_targets(spark):
    for sizes in ({"b": 1000, "a": 10, None: 500, "z": 77, "é": 0}, {"a": 5}, {"a": 0, None: 0}):
        found = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (3, 1, 2), 1.5, 2.0).collect()}
        want = by_hand(sizes)
        assert all(found[s] == pytest.approx(want[s], rel=1e-6, abs=1e-6) for s in sizes)


def sampled(rows, rate, name):
    """Copies of a source's rows (size, doc_id, ...): one offset, prefix sums of expected copies, one copy for each whole number crossed."""
    offset = int(hashlib.md5(f"1:{name}".encode()).hexdigest()[:8], 16) / 2**32
    part, copies = rate - math.floor(rate), []
    for rank in range(len(rows)):
        at, stratum = rank, math.floor(rank * part)
        if part and stratum % 2:
            at = math.ceil(stratum / part) + math.ceil((stratum + 1) / part) - 1 - rank
        copies.append(math.floor(rate) + math.floor((at + 1) * part + offset) - math.floor(at * part + offset))
    return dict(zip([r[1] for r in sorted(rows)], copies, strict=True))


def test_mix(docs):
    rows = docs.collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    total = defaultdict(int)
    for r in rows:
        total[r.source] += size[r.doc_id]
    want, out = by_hand(total), mix(docs).collect()
    assert sorted((r.doc_id, r["size"], r.source_size) for r in out) == sorted((r.doc_id, size[r.doc_id], total[r.source]) for r in rows)
    taken, rate = defaultdict(int), {}
    for r in out:
        assert r.target == pytest.approx(want[r.source], rel=1e-6)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        rate[r.source] = r.target / r.source_size
    for s in total:
        copies = sampled([(size[r.doc_id], r.doc_id) for r in rows if r.source == s], rate[s], "null" if s is None else f"s{s}")
        assert copies == {r.doc_id: r.copies for r in out if r.source == s}
    largest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= max(0.1 * want[s], 1.0 * largest) for s in total), [(taken[s], want[s]) for s in total]
    again = mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_ranked(spark):
    rows = [(g, i * 7 % 20, 0) for g, n in (("a", 400), ("b", 3), ("c", 1), ("d", 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v int, extra int").repartition(7)
    got = defaultdict(list)
    for r in sorted(ranked(df, "g", ["v"]).collect(), key=lambda r: (r.g, r["rank"])):
        got[r.g].append((r["rank"], r.v))
    want = {g: list(enumerate(sorted(v for h, v, _ in rows if h == g))) for g in "abcd"}
    assert got == want and ranked(df.limit(0), "g", ["v"]).collect() == []


def test_odd(odd, empty):
    out = mix(odd).collect()
    assert len(out) == odd.count()
    picked = mixed_documents(odd)
    assert picked.columns == odd.columns
    assert picked.count() == sum(r.copies for r in out)
    assert mix(empty).collect() == [] and mixed_documents(empty).collect() == []
