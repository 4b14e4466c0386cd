import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import quality, toxicity
from trellis.llm.common import raw_texts


@pytest.fixture(scope="module")
def big(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def accuracy(out, labels, name):
    want = {r.doc_id: r[name] for r in labels.collect()}
    rows = [(r.predicted, want[r.doc_id]) for r in out if r.doc_id in want and r.held_out]
    by = {k: np.mean([p == w for p, w in rows if w == k]) for k in (0, 1)}
    return len(rows), by


def test_quality(big):
    docs, labels = big
    out = quality.score_quality(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    n, by = accuracy(out, labels, "quality")
    assert n > 80 and min(by.values()) >= 0.9
    again = {r.doc_id: r.score for r in quality.score_quality(docs.repartition(5), labels.repartition(3)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-6) for r in out)


def test_held_out_labels_are_not_used(big):
    docs, labels = big
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score_quality(docs, turned).collect()}
    assert a == pytest.approx(b)


def test_toxicity(big):
    docs, labels = big
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    n, by = accuracy(out, labels, "toxic")
    assert n > 80 and by[0] >= 0.95 and by[1] >= 0.7
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 and 0 <= r.score <= 1 for r in out)


def test_ordinal_regression_finds_order():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        k = rng.integers(0, 4)
        rows.append(np.unique(np.concatenate([np.arange(k), rng.integers(5, 20, 4)])))
        grades.append(k)
    w, theta = toxicity.fit_ordinal(rows, np.array(grades), 20, 3)
    assert (w[:3] > 1).all() and np.abs(w[5:]).max() < 1 and (np.diff(theta) > 0).all()


def test_pairs_prefer_the_better():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    w = quality.fit_pairs(x, x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=400) > 0, pairs=5000)
    assert w[0] > 0.5 and w[1] < -0.5 and np.abs(w[2:]).max() < 0.3


def test_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, 0, 1), (8, 1, 0), (9, 1, 0), (11, 0, 1), (None, 1, 1), (12, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality.score_quality, toxicity.score_toxicity):
        for some in (labels, labels.limit(0)):
            out = f(odd, some).collect()
            assert len(out) == odd.count()
            assert f(empty, some).collect() == []
    assert quality.keep_good(odd, labels).columns == odd.columns


ASCII_SPACE = " \t\n\x0b\x0c\r"
TEXTS = ["", None, "One two\tTWO", "a!b|c  d#e\n\nLine Line 12", "é Ünï 9 " * 40, "x", "stupid idiot idiots idiotic, idiot! idiotic? " * 9, "word " * 300 + "\n" + "Other9 " * 50]


def split(text, more=""):
    for c in ASCII_SPACE + more:
        text = text.replace(c, " ")
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split(" ") if w]


def plain_shape(text):
    """The quality features by plain counting."""
    raw, w = (text or "").encode(), split(text or "")
    n, k = len(raw) + 60, len(w) + 10
    upper, digit = sum(65 <= b < 91 for b in raw), sum(48 <= b < 58 for b in raw)
    alpha, lines = upper + sum(97 <= b < 123 for b in raw), 1 + raw.count(b"\n")
    signs = sum(33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in raw)
    odd = sum(raw.count(c.encode()) for c in "!|#@")
    most = max([w.count(x) for x in set(w)], default=0)
    return [*(np.sqrt(raw.count(bytes([b])) / n) for b in range(128)), upper / (alpha + 40), alpha / n, digit / n, sum(b > 127 for b in raw) / n, len(raw) / k / 10, len(set(w)) / k, most / k,
            np.log1p(len(raw)) / 10, np.log1p(len(w)) / 10, np.log1p(len(w) / lines) / 5, lines / k, sum(a == b for a, b in zip(w, w[1:], strict=False)) / k, signs / n, odd / k]


def test_quality_features_by_plain_counting(docs):
    texts = TEXTS + [r.text for r in docs.limit(60).collect()]
    assert np.allclose(quality.shape_features(*raw_texts(texts)), [plain_shape(t) for t in texts])


def test_pair_weights_are_the_least_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    good = x[:, 0] + 0.5 * rng.normal(size=300) > 0
    w = quality.fit_pairs(x, good, pairs=4000, ridge=1e-2, seed=3)
    pick = np.random.default_rng(3)
    d = x[pick.choice(np.flatnonzero(good), 4000)] - x[pick.choice(np.flatnonzero(~good), 4000)]
    loss = lambda w: np.mean([np.log1p(np.exp(-sum(a * b for a, b in zip(row, w, strict=True)))) for row in d]) + 0.005 * sum(w * w)
    least = loss(w)
    for j in range(4):
        for step in (-1e-2, 1e-2):
            assert loss(w + step * np.eye(4)[j]) > least


def plain_toxic(text):
    """The toxicity features as names, by plain loops."""
    w = [x.encode() for x in split(text or "", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'")]
    out = {("word", x) for x in w}
    for k in (4, 5):
        stems = [x[:k] for x in w]
        for s in set(stems):
            n = stems.count(s)
            out |= {(k, j, s) for j, (least, rate) in enumerate(((1, 0), (3, 0), (2, 10), (2, 25), (3, 50))) if n >= least and 1000 * n >= rate * len(w)}
    return out


def test_toxicity_features_and_scores_by_plain_loops(docs):
    texts = TEXTS + [r.text for r in docs.limit(40).collect()]
    buf, edges = raw_texts(texts)
    found = [set() for _ in texts]
    for lo, _, owner, h, _, _ in toxicity.word_features(buf, edges):
        for o, x in zip(owner.tolist(), h.tolist(), strict=True):
            assert x not in found[lo + o]
            found[lo + o].add(x)
    want = [plain_toxic(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i + 1):
            assert len(found[i] & found[j]) == len(want[i] & want[j])
    known = sorted(set.union(*found))[::3]
    weights = np.linspace(-0.5, 0.5, len(known))
    model = toxicity.Model(np.array(known, np.uint64), weights, np.array([0.1, 0.7]), 0.5)
    by = dict(zip(known, weights, strict=True))
    lines = [sum(by.get(x, 0.0) for x in f) for f in found]
    assert np.allclose(model.at_least(buf, edges), [[1 / (1 + np.exp(-np.clip(z - t, -30, 30))) for t in (0.1, 0.7)] for z in lines])


def test_ordinal_fit_is_the_greatest_likelihood():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 6, rng.integers(0, 4))) for _ in range(200)]
    grades = np.array([min(3, len(r) + (rng.random() < 0.2)) if 0 in r else int(rng.random() < 0.3) for r in rows])
    w, theta = toxicity.fit_ordinal(rows, grades, 6, 3, ridge=1e-3, rounds=4000, rate=0.02)

    def value(w, theta):
        total = 0.0
        for r, y in zip(rows, grades, strict=True):
            p = [1.0, *(1 / (1 + np.exp(t - sum(w[i] for i in r))) for t in theta), 0.0]
            total += np.log(max(p[y] - p[y + 1], 1e-12))
        return total / len(rows) - 0.5e-3 * sum(w * w)

    best = value(w, theta)
    for j in range(6):
        for step in (-0.1, 0.1):
            assert value(w + step * np.eye(6)[j], theta) < best
    for j in range(3):
        for step in (-0.1, 0.1):
            assert value(w, theta + step * np.eye(3)[j]) < best


def test_severity_is_graded_among_toxic_documents(big):
    out = toxicity.score_toxicity(*big).collect()
    severe = [r.severity for r in out if r.predicted]
    assert len({round(s, 1) for s in severe}) > 3 and all(0 <= r.severity <= 3 for r in out)


def test_repeated_ids_are_fitted_once(spark, big):
    docs, labels = big
    labelled = labels.where("toxic is not null").select("doc_id")
    more = docs.unionByName(docs.join(labelled, "doc_id", "left_semi").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("copy"))
    a = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score_quality(more, labels).collect()}
    assert a == pytest.approx(b)
