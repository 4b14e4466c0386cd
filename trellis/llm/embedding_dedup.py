"""Near-duplicate vectors by product quantisation: inverted lists, table lookups, exact rerank."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that links (a, b) reach from each of n places."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_ROWS = 2048


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, a slice of rows at a time."""
    square = (centre**2).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *[(square - 2 * x[lo : lo + _ROWS] @ centre.T).argmin(1) for lo in range(0, len(x), _ROWS)]])


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centre)
        n = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


class Index:
    """Centres of the lists and, for each subspace, codewords of residuals. Works on unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, words: int = 256, dims: int = 4, seed: int = 5):
        self.centre = k_means(sample, lists, 8, seed)
        rest = sample - self.centre[_nearest(sample, self.centre)]
        cut = np.linspace(0, sample.shape[1], -(-sample.shape[1] // dims) + 1).astype(int)
        self.spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        self.books = [k_means(np.ascontiguousarray(rest[:, a:b]), words, 6, seed + a) for a, b in self.spans]

    def probes(self, x: np.ndarray, margin: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's list; and, a row each, the most nearest lists at whose dividing plane from its own the row is
        at most margin away, the own list first, -1 where there are fewer."""
        d = (self.centre**2).sum(1) - 2 * x @ self.centre.T
        most = min(most, len(self.centre))
        some = np.argpartition(d, most - 1, axis=1)[:, :most] if most < len(self.centre) else np.tile(np.arange(most), (len(x), 1))
        far = np.take_along_axis(d, some, 1)
        by = np.argsort(far, axis=1, kind="stable")
        some, far = np.take_along_axis(some, by, 1), np.take_along_axis(far, by, 1)
        home = some[:, 0]
        gap = np.sqrt(np.maximum(((self.centre[some] - self.centre[home][:, None]) ** 2).sum(2), 1e-18))
        return home, np.where(far - far[:, :1] <= 2 * margin * gap, some, -1)

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of rows in their lists, and how far each row is from what its code stands for."""
        rest = x - self.centre[home]
        code = np.stack([_nearest(rest[:, s:e], b) for (s, e), b in zip(self.spans, self.books, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([b[code[:, m]] for m, b in enumerate(self.books)], 1)
        return code, np.sqrt(((rest - back) ** 2).sum(1))

    def distances(self, x: np.ndarray, of: int, code: np.ndarray) -> np.ndarray:
        """Squared distances from rows of x to the coded rows of list of, by table lookup."""
        rest = x - self.centre[of]
        total = np.zeros((len(x), len(code)))
        for m, ((s, e), b) in enumerate(zip(self.spans, self.books, strict=True)):
            table = (rest[:, s:e] ** 2).sum(1)[:, None] - 2 * rest[:, s:e] @ b.T + (b**2).sum(1)
            total += table[:, code[:, m]]
        return total


def _small(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in 8 bits a component, and how far each row is from what its bytes stand for."""
    byte = np.rint(unit * 127).astype(np.int8)
    return byte, np.sqrt(((unit - byte / 127.0) ** 2).sum(1))


def _unit(vectors) -> np.ndarray:
    raw = np.stack([np.asarray(v, float) for v in vectors])
    return raw / np.sqrt((raw * raw).sum(1))[:, None]  # components are at most 1: see near_duplicates


def _may_meet(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Which pairs of a visitor (of a) and an owned row (of b) are this list's to judge. Both rows may visit the
    other's list: then the pair is judged in the lower one."""
    theirs, own = np.stack([np.frombuffer(p, np.int32) for p in b["probes"]]), a["home"].to_numpy()
    first = (own > int(b["home"].iloc[0])) | (own < 0)
    ok = np.ones((len(a), len(b)), bool)
    for i in np.flatnonzero(~first):
        ok[i] = ~(theirs == own[i]).any(1)
    return ok


def _survivors(index: Index, of: int, a: pd.DataFrame, b: pd.DataFrame, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a and of b have a partner in the other that table lookups can't rule out. No
    pair within reach is ruled out: what bytes and codes lose is added to the threshold."""
    read = lambda df, c, kind: np.stack([np.frombuffer(v, kind) for v in df[c]])
    x, code = read(a, "bytes", np.int8) / 127.0, read(b, "code", np.uint8)
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6 + b["off"].to_numpy()
    far_a, keep_a, keep_b = a["lost"].to_numpy(), np.zeros(len(a), bool), np.zeros(len(b), bool)
    for lo in range(0, len(a), 256):
        hi = min(len(a), lo + 256)
        near = np.sqrt(np.maximum(0, index.distances(x[lo:hi], of, code))) <= reach + far_a[lo:hi, None]
        if same:
            near[np.arange(hi - lo), np.arange(lo, hi)] = False
        else:
            near &= _may_meet(a.iloc[lo:hi], b)
        keep_a[lo:hi] |= near.any(1)
        keep_b |= near.any(0)
    return keep_a | (keep_b if same else False), keep_b


def _linked(a: pd.DataFrame, b: pd.DataFrame | None, cosine: float, judged) -> pd.DataFrame:
    """Links between a and b (within a, if b is None): for each row that has any, how many and a row it reaches."""
    both = a if b is None else pd.concat([a, b])
    unit, n, base = _unit(both["v"]), len(a), 0 if b is None else len(a)
    w, links, tops = both["copies"].to_numpy(), np.zeros(len(both), np.int64), np.arange(len(both))
    for lo in range(0, n, 512):
        cos = unit[lo : min(n, lo + 512)] @ unit[base:].T
        if b is not None:
            cos[~judged(a.iloc[lo : min(n, lo + 512)], b)] = -2
        i, j = np.nonzero(cos >= cosine - 1e-9)
        i, j = i + lo, j + base
        if b is None:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            exact = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
            x, y = x[exact], y[exact]
            np.add.at(links, x, w[y])
            np.add.at(links, y, w[x])
            tops = np.minimum(tops, forest(len(both), np.concatenate([x, np.arange(len(both))]), np.concatenate([y, tops])))
    some = (links > 0) | (tops != np.arange(len(both)))
    ids = both["rep"].to_numpy()
    return pd.DataFrame({"a": ids[some], "b": ids[tops[some]], "links": links[some]})


_NOTHING = {"a": [], "b": [], "links": []}


def _tasks(listed: DataFrame, block: int) -> DataFrame:
    """Rows of lists (list, own, rep) dealt into blocks of about block rows, once for each pair of blocks that must meet:
    kind 0 is a pair of blocks of owned rows, kind 1 a block of visitors (first) with one of owned rows."""
    counts = listed.groupBy("list").agg(F.sum(F.col("own").cast("int")).alias("owned"), F.sum((~F.col("own")).cast("int")).alias("other"))
    counts = F.broadcast(counts.select("list", (1 + F.floor(F.col("owned") / block)).alias("nb"), (1 + F.floor(F.col("other") / block)).alias("nf")))  # a row per list
    dealt = listed.join(counts, "list").withColumn("mine", F.pmod(F.xxhash64("rep"), F.when(F.col("own"), F.col("nb")).otherwise(F.col("nf"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    inside = F.transform(upto(F.col("nb")), lambda o: F.struct(F.lit(0).alias("kind"), F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j"), (F.col("mine") < o).alias("first")))
    visited = F.transform(upto(F.col("nf")), lambda f: F.struct(F.lit(1).alias("kind"), f.alias("i"), F.col("mine").alias("j"), F.lit(False).alias("first")))
    visits = F.transform(upto(F.col("nb")), lambda o: F.struct(F.lit(1).alias("kind"), F.col("mine").alias("i"), o.alias("j"), F.lit(True).alias("first")))
    return dealt.select(*listed.columns, F.explode(F.when(F.col("own"), F.concat(inside, visited)).otherwise(visits)).alias("task")).select(*listed.columns, "task.*")


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    """The two sides of a task, or its one block and None."""
    pdf = pdf.sort_values("rep")
    if int(pdf["kind"].iloc[0]) == 0 and int(pdf["i"].iloc[0]) == int(pdf["j"].iloc[0]):
        return pdf, None
    return pdf[pdf["first"]], pdf[~pdf["first"]]


def _by_index(classes: DataFrame, width: int, total: int, cosine: float, sample: int, rows_a_list: int, most_lists: int, probes: int, sigmas: float, block: int) -> DataFrame:
    """(a, b, links) of the vectors of one length, by lists, codes and an exact rerank."""
    spark = classes.sparkSession
    few = [r["v"] for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").collect()]
    fit = _unit(few)
    shared = spark.sparkContext.broadcast(Index(fit, int(np.clip(total // rows_a_list, 1, min(most_lists, max(1, len(fit) // 8))))))  # bounded by sample and most_lists
    margin = float(np.sqrt(max(0.0, 2 - 2 * cosine)) * min(1.0, sigmas / np.sqrt(width)))

    def assign(it):
        index = shared.value
        for pdf in it:
            for lo in range(0, len(pdf), _ROWS):
                unit = _unit(pdf["v"].iloc[lo : lo + _ROWS])
                home, near = index.probes(unit, margin, probes)
                code, off = index.codes(unit, home)
                small, lost = _small(unit)
                r, k = np.nonzero(near >= 0)
                own = k == 0
                blank = np.full(len(r), None, object)
                blobs = lambda x: np.array([v.tobytes() for v in x], object)
                yield pd.DataFrame({
                    "list": near[r, k], "own": own, "rep": pdf["rep"].to_numpy()[lo : lo + _ROWS][r], "home": home[r], "probes": np.where(own, blobs(near.astype(np.int32))[r], blank),
                    "code": np.where(own, blobs(code)[r], blank), "off": off[r], "bytes": blobs(small)[r], "lost": lost[r],
                })

    listed = materialize(classes.select("rep", "v").mapInPandas(assign, "list int, own boolean, rep long, home int, probes binary, code binary, off double, bytes binary, lost double"), "lists")

    def rule_out(pdf):
        of = int(pdf["list"].iloc[0])
        a, b = _sides(pdf)
        if b is None:
            kept = a[_survivors(shared.value, of, a, a, cosine, True)[0]]
        elif len(a) and len(b):
            if int(pdf["kind"].iloc[0]) == 0:
                a = a.assign(home=-1)  # of the same list: all pairs are judged
            in_a, in_b = _survivors(shared.value, of, a, b, cosine, False)
            kept = pd.concat([a[in_a], b[in_b]])
        else:
            kept = pdf.iloc[:0]
        return kept[["list", "kind", "i", "j", "first", "rep", "home", "probes"]]

    task = ["list", "kind", "i", "j"]
    left = _tasks(listed, block).groupBy(task).applyInPandas(rule_out, "list int, kind int, i long, j long, first boolean, rep long, home int, probes binary")
    left = materialize(left, "survivors")
    discard(listed)

    def rerank(pdf):
        a, b = _sides(pdf)
        if b is not None and not (len(a) and len(b)):
            return pd.DataFrame(_NOTHING, dtype="int64")
        return _linked(a, b, cosine, _may_meet)

    found = left.join(classes, "rep").groupBy(task).applyInPandas(rerank, "a long, b long, links long")
    return materialize(found, "links")


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.95, sample: int = 20_000, rows_a_list: int = 256, most_lists: int = 4096, probes: int = 8, sigmas: float = 4.0, block: int = 1024, plain: int = 512
) -> DataFrame:
    """vectors (vec_id, embedding) to vec_id, n_links, component_id, kept (it is its component's id).

    Vectors link if they have the same length and their cosine, in double precision, is at least ``cosine``. Those that are null, empty, zero,
    or hold null or non-finite components link with nothing. Components are divided by the largest first, so no finite vector is too small or large. A null
    vec_id links with nothing and gets a null component. Rows that repeat a vec_id are rows of their own, each with its vector, and share an id in
    components. Exact copies are one vector with a count. Other columns are ignored; an empty table gives no rows.

    Vectors are compared among those of their length: at most ``plain`` distinct ones directly, in one task; more by an index of their own.
    Its lists and codewords are fitted on at most ``sample`` rows (smallest hashes of the id);
    every row is indexed: its code stands in its own list. It visits the ``probes`` nearest lists (its own among them), but none whose dividing plane is
    beyond ``sigmas`` standard deviations of how far a partner at the threshold would lie in a random direction. A pair is
    found if either visits the other's list. Lists hold codes, and visitors bring 8 bits a component; table lookups rule out what the threshold and both
    codes' own errors rule out for certain, so within a visited list no link is
    lost. Only vectors with a possible partner in a task are shipped to it, for exact cosines. Lists are cut into blocks of about ``block`` rows; a task has
    one pair of blocks and returns counts and a spanning forest, not pairs."""
    x = F.col("embedding").cast("array<double>")
    top = F.array_max(F.transform(x, lambda v: F.abs(v)))
    fine = F.coalesce(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (top > 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.transform(x, lambda v: v / top + 0.0)).alias("v"))
    keyed = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(3), "v").alias("h2"))
    key = ["h1", "h2"]
    classes = keyed.where("v is not null").groupBy(key).agg(F.min("vec_id").alias("name"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # Distinct vectors may share a vec_id, so rep numbers the classes; components are those of names.
    classes = materialize(classes.select(*key, "copies", "v", "name", F.size("v").alias("width"), F.monotonically_increasing_id().alias("rep")), "vectors")
    sizes = {r["width"]: r["n"] for r in classes.groupBy("width").agg(F.count("*").alias("n")).collect()}  # a row per length of vectors
    large = sorted(w for w, n in sizes.items() if n > plain)
    found = [_by_index(classes.where(F.col("width") == w).select("rep", "copies", "v"), w, sizes[w], cosine, sample, rows_a_list, most_lists, probes, sigmas, block) for w in large]
    few = classes.where(~F.col("width").isin(large)) if large else classes
    found.append(materialize(few.select("width", "rep", "copies", "v").groupBy("width").applyInPandas(lambda pdf: _linked(pdf.sort_values("rep"), None, cosine, None), "a long, b long, links long"), "links"))
    found = reduce(DataFrame.unionByName, found)
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    names = classes.select("rep", "name")
    ends = found.where("a <> b").select("a", "b").join(names.select(F.col("rep").alias("a"), F.col("name").alias("x")), "a").join(names.select(F.col("rep").alias("b"), F.col("name").alias("y")), "b")
    # A vec_id of several vectors is one place.
    several = keyed.where("v is not null").groupBy("vec_id").agg(F.min("h1").alias("l1"), F.max("h1").alias("m1"), F.min("h2").alias("l2"), F.max("h2").alias("m2")).where("l1 <> m1 or l2 <> m2").select("vec_id")
    same = keyed.join(several, "vec_id").join(classes.select(*key, "name"), key).select(F.col("vec_id").alias("a"), F.col("name").alias("b")).distinct()
    joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same)).withColumnRenamed("id", "name")
    known = classes.select(*key, "rep", "name", "copies").join(links, "rep", "left").join(joined, "name", "left").where("copies > 1 or links is not null or component is not null")
    known = known.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "name").alias("component"))
    known = materialize(known, "known")  # a plain shuffle then, so that a hot vector's rows can be split
    out = keyed.drop("v").join(known, key, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
