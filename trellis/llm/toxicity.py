"""Toxicity as an ordinal severity, by cumulative-link regression on sparse word features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BYTES, arrow_texts, discard, materialize, mix64, slices, word_hashes
from .quality import held_out

_SALT = 0xA0761D6478BD642F
_STEMS = (4, 5)
#: Words are apart at white space and at any ASCII sign.
_APART = np.zeros(256, bool)
_APART[[*SPACE_BYTES, *b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"]] = True
#: A stem's features: it occurs; it occurs at least so often and in at least so many of a thousand words.
_OFTEN = ((1, 0), (3, 0), (2, 10), (2, 25), (3, 50))


def _counted(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (owner, h), by owner, and how often each occurs."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))))
    return owner[first], h[first], np.diff(np.append(first, len(h)))


def word_features(buf: np.ndarray, edges: np.ndarray):
    """For ranges lo to hi of texts (bytes, and where each begins): lo, hi, the pairs (text, hash) of the texts' features, by text, and the
    hashes of all words and where each text's begin. Features are the lower-cased words and, for the words' first four and
    first five bytes, how often they occur; each feature of a text once."""
    for lo, hi in slices(edges):
        words, *stems, at = word_hashes(buf, edges[lo : hi + 1], _APART, _STEMS)
        of, size = np.repeat(np.arange(hi - lo), np.diff(at)), np.diff(at)
        owner, h, _ = _counted(of, words)
        owners, found = [owner], [h]
        for k, s in zip(_STEMS, stems, strict=True):
            owner, h, n = _counted(of, s)
            for j, (least, rate) in enumerate(_OFTEN):
                some = (n >= least) & (1000 * n >= rate * size[owner])
                owners.append(owner[some])
                found.append(mix64(h[some] ^ np.uint64(_SALT * (8 * k + j + 1) % 2**64)))
        owner, h = np.concatenate(owners), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        yield lo, hi, owner[order], h[order], words, at


class Model:
    """Known features, by hash, their shared weights, the ascending thresholds of the grades, and
    the chance of grade 1 from which a document counts as toxic."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, cut: float):
        self.features, self.weights, self.thresholds, self.cut = features, weights, thresholds, cut

    def at_least(self, buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a row per text."""
        line = np.zeros(len(edges) - 1)
        for lo, hi, owner, h, _, _ in word_features(buf, edges):
            if len(self.features) and len(h):
                at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
                line[lo:hi] = np.bincount(owner, np.where(self.features[at] == h, self.weights[at], 0.0), hi - lo)
        return 1 / (1 + np.exp(-np.clip(line[:, None] - self.thresholds, -30, 30)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, width: int, levels: int, ridge: float = 2e-4, rounds: int = 1500, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of P(y >= k) = sigmoid(w x - theta_k), by maximum likelihood (Adam).
    rows: each document's feature numbers. Thresholds ascend: each adds exp(.) to the last."""
    owner, feature = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    p = np.concatenate((np.zeros(width), [2.0], np.zeros(levels - 1)))
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = len(rows)
    for t in range(1, rounds + 1):
        w, theta = p[:width], p[width] + np.concatenate(([0.0], np.cumsum(np.exp(p[width + 1 :]))))
        line = np.bincount(owner, w[feature], n)
        upper = np.concatenate((np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(line[:, None] - theta, -30, 30))), np.zeros((n, 1))), 1)
        slope = upper * (1 - upper)
        i = np.arange(n)
        mass = np.maximum(upper[i, grades] - upper[i, grades + 1], 1e-12)
        by_line = (slope[i, grades] - slope[i, grades + 1]) / mass
        by_theta = np.zeros((n, levels))
        low, high = grades > 0, grades < levels
        by_theta[i[low], grades[low] - 1] -= (slope[i, grades] / mass)[low]
        by_theta[i[high], grades[high]] += (slope[i, grades + 1] / mass)[high]
        g_theta = by_theta.sum(0)
        g = np.concatenate((np.bincount(feature, by_line[owner], width) / n - ridge * w, [g_theta.sum() / n], [g_theta[k:].sum() / n * np.exp(p[width + k]) for k in range(1, levels)]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:width], p[width] + np.concatenate(([0.0], np.cumsum(np.exp(p[width + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4_000, levels: int = 3, clean: float = 0.997) -> Model | None:
    """Learns from at most ``sample`` toxic and 2 * sample other labelled rows (those of the
    smallest hashes of their doc_id, each with one of its texts), none of them held out. All features of these rows that tell (log odds
    over their error beyond 3) are kept. Grade 0 is not toxic. Labels say no more than toxic or not, so severity is how
    far toxic wording spreads: a toxic row's grade is the number of equal parts of its text (levels of them) that
    hold a word that marks toxic rows, 1 at least. Features know nothing of places, so grades aren't made from them."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [named.where(f"toxic = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for q, n in ((1, sample), (0, 2 * sample))]
    few = F.broadcast(ids[0].unionByName(ids[1]))  # 3 * sample rows at most

    def measure(it):
        for batch in it:
            ids, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "toxic"))
            for lo, hi, owner, h, words, at in word_features(*arrow_texts(batch.column("text"))):
                place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
                part = 1 + place * levels // np.maximum(1, np.repeat(np.diff(at), np.diff(at)))
                of, each, _ = _counted(np.repeat(np.arange(hi - lo), np.diff(at)) * (levels + 1) + part, words)
                who = lo + np.concatenate((owner, of // (levels + 1), np.arange(hi - lo)))
                where = np.concatenate((np.zeros(len(owner), np.int64), of % (levels + 1), np.full(hi - lo, -1)))
                what = np.concatenate((h, each, np.zeros(hi - lo, np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": ids[who], "toxic": toxic[who], "part": where.astype(np.int32), "h": what})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    # part -1: a row per document; 0: its features; 1 and more: the words of each part of its text.
    seen = materialize(texts.mapInArrow(measure, "doc_id long, toxic int, part int, h long"), "features")
    rows = seen.where("part = -1").select("doc_id", "toxic").toPandas().sort_values("doc_id")  # 3 * sample at most, as below
    toxic = rows["toxic"].to_numpy() == 1
    if not toxic.any() or toxic.all():
        return None
    a, b = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    count = seen.where("part = 0").groupBy("h").agg(a.alias("a"), b.alias("b")).where("a + b >= 4")
    odds = F.log((F.col("a") + 0.5) / (int(toxic.sum()) - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (int((~toxic).sum()) - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    known = count.withColumn("z", odds / error).where("abs(z) > 3").select("h", "z").toPandas()
    known = known.iloc[np.argsort(known["h"].to_numpy().view(np.uint64))]
    features = known["h"].to_numpy().view(np.uint64)
    numbers = docs.sparkSession.createDataFrame(pd.DataFrame({"h": known["h"].to_numpy(), "f": np.arange(len(known)), "mark": known["z"].to_numpy() > 3}), "h long, f int, mark boolean")
    hits = seen.where("part >= 0").join(F.broadcast(numbers), "h")
    hits = hits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("part") == 0, F.col("f")))).alias("f"), F.count_distinct(F.when((F.col("part") > 0) & F.col("mark"), F.col("part"))).alias("grade")).toPandas()
    discard(seen)
    rows = rows.merge(hits, "left", "doc_id")
    found = [np.array(f if isinstance(f, list | np.ndarray) else [], np.int64) for f in rows["f"]]
    grades = np.where(toxic, np.maximum(1, rows["grade"].fillna(0).to_numpy(np.int64)), 0)
    weights, thresholds = fit_ordinal(found, grades, len(features), levels)
    chance = 1 / (1 + np.exp(thresholds[0] - np.array([weights[f].sum() for f in found])))
    # The cut passes all but a few in a thousand of the clean rows.
    return Model(features, weights, thresholds, float(np.clip(np.quantile(chance[~toxic], clean), 0.05, 0.5)))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4_000, levels: int = 3) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, severity (expected grade, 0 to levels), grade (the
    likeliest), score (chance of grade 1 or more), predicted (1 from the model's cut, at most 0.5).

    Texts are read whole; null and empty ones have no words and get the grades' base rates.
    Without labels of both kinds severity, grade, score and predicted are 0. Null doc_ids stay,
    repeated rows are scored again, other columns are ignored, an empty table gives no rows."""
    model = fit(docs, labels, sample, levels=levels)
    named = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("score", T.DoubleType())])
    if model is None:
        return named.select("doc_id", "held_out", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the labelled sample

    @F.arrow_udf(schema)
    def judge(texts: pa.Array) -> pa.Array:
        p = shared.value.at_least(*arrow_texts(texts))
        mass = -np.diff(np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), 1), axis=1)
        return pa.StructArray.from_arrays([pa.array(p.sum(1)), pa.array(mass.argmax(1).astype("int32")), pa.array(p[:, 0])], ["severity", "grade", "score"])

    scored = named.withColumn("judged", judge("text")).select("doc_id", "held_out", "judged.*")
    return scored.withColumn("predicted", (F.col("score") >= model.cut).cast("int"))
