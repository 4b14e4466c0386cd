"""Quality scores learned from preference pairs (Bradley-Terry)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_texts, raw_texts, slices, word_hashes

_UPPER, _SMALL, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
WIDTH = 128 + 14


def shape_features(buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A row of numbers per text (bytes, and where each begins), from all of it: the rate of each ASCII character, and rates of
    letters, words, lines and repetition. Rates are damped, so that a text of a few words says little.
    An empty text is all zeros but for its size."""
    out = np.zeros((len(edges) - 1, WIDTH))
    for lo, hi in slices(edges):
        words, bounds = word_hashes(buf, edges[lo : hi + 1])
        for i in range(lo, hi):
            raw = buf[edges[i] : edges[i + 1]]
            n = len(raw) + 60
            of = np.bincount(raw, minlength=256)
            w = words[bounds[i - lo] : bounds[i - lo + 1]]
            k = len(w) + 10
            distinct, times = np.unique(w, return_counts=True) if len(w) else (w, np.zeros(1, int))
            lines = int(of[10]) + 1
            alpha = of[_UPPER].sum() + of[_SMALL].sum()
            out[i, :128] = np.sqrt(of[:128] / n)
            out[i, 128:] = [
                of[_UPPER].sum() / (alpha + 40), alpha / n, of[_DIGIT].sum() / n, of[128:].sum() / n, len(raw) / k / 10, len(distinct) / k, times.max() / k,
                np.log1p(len(raw)) / 10, np.log1p(len(w)) / 10, np.log1p(len(w) / lines) / 5, lines / k, (w[1:] == w[:-1]).sum() / k,
                (of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()) / n, (of[33] + of[124] + of[35] + of[64]) / k,
            ]
    return out


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = 60_000, ridge: float = 1e-2, rounds: int = 25, seed: int = 3) -> np.ndarray:
    """Weights w such that sigmoid(w (x_i - x_j)) is the chance that i is preferred to j, over
    pairs of a good and a bad row, by Newton's method."""
    rng = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    d = x[rng.choice(better, pairs)] - x[rng.choice(worse, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -(d.T @ p) / pairs + ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


class Model:
    """mean, scale and weights of the features; the score at which a document passes; a slope."""

    def __init__(self, mean, scale, weights, cut, slope):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return self.scores(*raw_texts(texts))

    def scores(self, buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
        raw = ((shape_features(buf, edges) - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip((raw - self.cut) * self.slope, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 5_000) -> Model | None:
    """Learns from at most ``sample`` labelled rows of each label (those of the smallest hashes
    of their doc_id), never from held-out ones. None if either label is missing."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    ids = [named.where(f"quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    few = F.broadcast(ids[0].unionByName(ids[1]))  # 2 * sample rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id")

    def measure(it):
        for batch in it:
            x = shape_features(*arrow_texts(batch.column("text"))).astype("<f4")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array([r.tobytes() for r in x], pa.binary()), "quality": batch.column("quality")})

    # A doc_id that many rows repeat counts once, with one of its texts: at most 2 * sample rows reach the driver.
    measured = texts.mapInArrow(measure, "doc_id long, x binary, quality int").groupBy("doc_id").agg(F.max(F.struct("x", "quality")).alias("m"))
    got = measured.select("m.*").toPandas()
    good = got["quality"].to_numpy() == 1
    if not good.any() or good.all():
        return None
    rows = np.lexsort((got["x"].to_numpy(), good))  # independent of the order of tasks
    x, good = np.stack([np.frombuffer(b, "<f4") for b in got["x"]]).astype(float)[rows], good[rows]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = (x - mean) / scale
    w = fit_pairs(x, good)
    raw = np.sort(x @ w)
    # The cut is the quantile of the score that the share of rejected labels asks for, midway between its neighbours.
    k = int((~good).sum())
    cut = (raw[k - 1] + raw[k]) / 2
    return Model(mean, scale, w, float(cut), float(4 / max(1e-6, raw.std())))


def _scored(docs: DataFrame, model: Model | None, text: str) -> Column:
    if model is None:
        return F.lit(0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(*arrow_texts(texts)))

    return score(F.col(text))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 5_000) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, score (0 to 1, higher is better), predicted (1 from
    0.5). Scores use the text alone, whole; null and empty texts are scored as texts without any
    character. Without labels of both kinds every score is 0.5. Null doc_ids stay, repeated rows
    are scored again, other columns are ignored, an empty table gives no rows."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _scored(docs, fit(docs, labels, sample), "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 5_000) -> DataFrame:
    """The rows of docs, all columns, that score_quality predicts as 1."""
    return docs.where(_scored(docs, fit(docs, labels, sample), "text") >= 0.5)
