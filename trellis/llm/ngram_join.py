"""Exact Jaccard join of documents on word shingles, with set-relation skipping.

Sets of 64-bit shingle hashes come from numpy inside Spark tasks and are never kept for the
whole corpus. The steps, each a Spark job over rows that Spark partitions:

1. Signatures: equal sets form one class; only its smallest id goes on.
2. A global shingle order: rare first. Shingles that many documents hold are found by
   counting those that repeat inside a batch; the table of them is bounded (``heavy_limit``).
   Any fixed order gives the same links; this one only keeps lists short.
3. Prefix filter: linked sets share a shingle among the first n - ceil(t n) + 1 of both.
   Shingles that one document alone holds in its prefix go no further, nor do pairs of too
   different sizes, nor pairs that share too few prefix shingles to reach the threshold.
4. Sets that share prefix shingles are dealt into blocks of bounded size, those of one list together.
   Pairs of blocks with a shingle in common meet in one task (whole index lists are skipped
   by block); a set goes only to pairs of blocks in which it shares a shingle.
5. In a task, sets stand by size; an index list is read only from the block of positions whose
   sizes can link (index-level skipping), and where a similar set was answered before, its
   overlaps are corrected by the lists of the shingles in which the two differ (answer-level
   skipping). Both give exact overlaps. Out go link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, discard, materialize, mix64, shingle_sets, slices
from .components import components

_CHUNK = 1 << 22
_BLOCK = 64
_MARKS = 64
_NO = np.zeros(0, np.int64)


def _sets(it: Iterator[pa.RecordBatch], width: int, keep=None) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """doc_ids and shingle sets of batches' documents (of those that keep tells, if given), a few megabytes of text at a time."""
    for batch in it:
        if keep is not None:
            batch = batch.filter(pa.array(keep(batch)))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        buf, edges = arrow_texts(batch.column("text"))
        for lo, hi in slices(edges, _CHUNK):
            yield ids[lo:hi], list(shingle_sets(buf, edges[lo : hi + 1], width))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32), pa.array(np.concatenate([*parts, _NO]).astype(np.int64)))


def _signature(s: np.ndarray) -> tuple[int, int]:
    return int(mix64(s).sum().view(np.int64)), int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0


def _unlike(sets: list[np.ndarray]) -> list[int]:
    """Places of the first of each group of equal non-empty sets."""
    first: dict = {}
    for i, s in enumerate(sets):
        if len(s):
            first.setdefault((len(s), *_signature(s)), i)
    return list(first.values())


def survey(docs: DataFrame, width: int, least: int) -> tuple[DataFrame, DataFrame]:
    """One pass over all texts: a row per document (doc_id, n_shingles, s1, s2: its set's size and signature), and
    counts (h, n) of the shingles that at least ``least`` documents hold beside others of one stretch of the table."""

    def run(it):
        for ids, sets in _sets(it, width):
            sig = np.array([_signature(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"kind": np.zeros(len(ids), np.int32), "a": ids, "n": np.array([len(s) for s in sets], np.int64), "s1": sig[:, 0], "s2": sig[:, 1]})
            own = [sets[i] for i in _unlike(sets)]
            if own:
                h, n = np.unique(np.concatenate(own), return_counts=True)
                h, n = h[n > 1].view(np.int64), n[n > 1].astype(np.int64)
                yield pa.RecordBatch.from_pydict({"kind": np.ones(len(h), np.int32), "a": h, "n": n, "s1": np.zeros(len(h), np.int64), "s2": np.zeros(len(h), np.int64)})

    both = materialize(docs.mapInArrow(run, "kind int, a long, n long, s1 long, s2 long"), "signed", ["kind"])
    counts = both.where("kind = 1").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return both.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), "s1", "s2"), counts


def heavy_shingles(counts: DataFrame, limit: int) -> np.ndarray:
    """Hashes and levels (quarter powers of two of their counts) of widely shared shingles, sorted by hash: at most limit of them."""
    counts = materialize(counts.withColumn("level", F.floor(F.log2("n") * 4).cast("long")), "heavy")
    room, level = limit, None
    for lv, n in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # a row for each quarter power of two
        if n > room:
            break
        room, level = room - n, lv
    if level is None:
        return np.zeros((2, 0), np.int64)
    found = counts.where(F.col("level") >= level).select("h", "level").toPandas().to_numpy(np.int64)
    discard(counts)
    return found[np.argsort(found[:, 0].copy().view(np.uint64))].T.copy()


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _ranks(s: np.ndarray, known: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The levels of the shingles of s, 0 for those not known as shared; the order is level, then hash."""
    if not len(known):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return np.where(known[at] == s, level[at], 0)


def _prefixes(docs: DataFrame, heavy, width: int, percent: int) -> DataFrame:
    """doc_id and prefix (array of hashes) of each set, equal sets of one stretch of the table once."""

    def run(it):
        known, level = heavy.value[0].view(np.uint64), heavy.value[1]
        for ids, sets in _sets(it, width):
            some = _unlike(sets)
            parts = [sets[i][np.argsort(_ranks(sets[i], known, level), kind="stable")[: _prefix(len(sets[i]), percent)]].view(np.int64) for i in some]
            yield pa.RecordBatch.from_pydict({"doc_id": ids[some] if some else _NO, "prefix": _lists(parts)})

    return docs.mapInArrow(run, "doc_id long, prefix array<long>")


def _some_sets(docs: DataFrame, ids: DataFrame, width: int, make, schema: str, most_bits: int) -> DataFrame:
    """make(doc_ids, sets) over the documents named by ids (rep), and over a few more: a bitmap of the
    ids' hashes, of bounded size, keeps most other texts out before any shuffle."""
    slots = max(1 << 15, min(most_bits, 1 << (16 * ids.count()).bit_length()))
    at = (F.pmod(F.xxhash64("rep"), F.lit(slots)) + 1).alias("at")
    bits = ids.select(at).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bitmap = np.zeros(slots // 8, np.uint8)
    for r in bits.collect():  # most_bits / 32768 rows of 4 KB at most
        bitmap[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(bitmap)

    def keep(batch):
        at = batch.column("slot").to_numpy(zero_copy_only=False)
        return (known.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def run(it):
        for some, sets in _sets(it, width, keep):
            yield make(some, sets)

    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot")).mapInArrow(run, schema)


def _likely(entries: DataFrame, percent: int, short_list: int, marks_of) -> DataFrame:
    """Lists (h, rep) that hold every pair that can link, from lists of shared prefix shingles
    (h, band, rep, n, own, length).

    Where prefixes of two sets share c shingles, the sets share at most c and what either set has
    past the end of the prefix that ends first: at most ceil(percent max(n, m) / 100) - 1, and
    mostly less, as marks_of (rep) tells: the key of each prefix's end and of every
    _MARKS-th part of the set in the global order. Lists of at most short_list sets are counted
    pair by pair; a shingle of a longer list counts as shared by all pairs, and longer lists stay as they are."""
    short, long = entries.where(F.col("length") <= short_list), entries.where(F.col("length") > short_list)
    x = short.select("h", "band", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("own").alias("ox"))
    y = short.select("h", "band", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("own").alias("oy"))
    pairs = x.join(y, ["h", "band"]).where("x < y and band = greatest(ox, oy)").groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("c"))
    many = long.groupBy("rep").agg(F.countDistinct("h").alias("many"))
    pairs = pairs.join(many.withColumnsRenamed({"rep": "x", "many": "mx"}), "x", "left").join(many.withColumnsRenamed({"rep": "y", "many": "my"}), "y", "left")
    most = F.col("c") + F.when(F.col("mx").isNotNull() & F.col("my").isNotNull(), F.least("mx", "my")).otherwise(0)
    least = percent * (F.col("nx") + F.col("ny"))
    pairs = pairs.withColumn("c", most).where((F.col("c") + F.ceil(F.greatest("nx", "ny") * percent / 100.0) - 1) * (100 + percent) >= least)
    pairs = materialize(pairs.select("x", "y", "nx", "ny", "c"), "pairs")
    marks = marks_of(pairs.select(F.explode(F.array("x", "y")).alias("rep")).distinct())
    for side in "xy":
        pairs = pairs.join(marks.select(F.col("rep").alias(side), F.col("end").alias(f"e{side}"), F.col("marks").alias(f"m{side}")), side)
    end = F.least("ex", "ey")

    def beyond(side: str, other: str):
        """At most so many shingles of one set come after the end of the prefix that ends first."""
        n, passed = F.col(f"n{side}"), F.size(F.filter(f"m{side}", lambda m: m < end))
        own = F.when(F.col(f"e{side}") < F.col(f"e{other}"), n - F.ceil(n * percent / 100.0) + 1)
        return n - F.coalesce(own, F.when(passed > 0, F.floor((passed - 1) * n / _MARKS) + 1).otherwise(0))

    pairs = pairs.where((F.col("c") + F.least(beyond("x", "y"), beyond("y", "x"))) * (100 + percent) >= least)
    lists = pairs.select(F.xxhash64(F.lit(1), "x", "y").alias("h"), F.explode(F.array("x", "y")).alias("rep"))
    return lists.unionByName(long.select(F.xxhash64("h", "band").alias("h"), "rep"))


def _linked(a: list[np.ndarray], na: np.ndarray, b: list[np.ndarray], nb: np.ndarray, percent: int, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of a, the places in b of the sets that link with it (of a later place, if same).
    a and b: sets of local shingle numbers; na and nb: the whole sets' sizes, ascending."""
    flat = np.concatenate(b)
    owner = np.repeat(np.arange(len(b)), [len(y) for y in b])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.searchsorted(flat, np.arange(int(max(flat[-1], max(int(x[-1]) for x in a))) + 2))

    def lists(tokens: np.ndarray) -> np.ndarray:
        lo, n = begin[tokens], begin[tokens + 1] - begin[tokens]
        return owner[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(tokens) else _NO

    answered: list[tuple[np.ndarray, int, int, np.ndarray]] = []
    for i, x in enumerate(a):
        n = int(na[i])
        lo = int(np.searchsorted(nb, -(-percent * n // 100))) // _BLOCK * _BLOCK
        hi = min(len(b), -(-int(np.searchsorted(nb, n * 100 // percent, side="right")) // _BLOCK) * _BLOCK)
        if same:
            lo = max(lo, i // _BLOCK * _BLOCK)
        if lo >= hi:
            continue
        counts, best = None, None
        for y, l2, h2, c in answered[-4:]:
            if l2 <= lo and hi <= h2 and len(y) * 2 > len(x):
                more, less = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
                if len(more) + len(less) < len(x) and (best is None or len(more) + len(less) < len(best[0]) + len(best[1])):
                    best = more, less, l2, h2, c
        if best:
            more, less, lo, hi, c = best
            counts = c.copy()
            for tokens, sign in ((more, 1), (less, -1)):
                at = lists(tokens)
                counts += sign * np.bincount(at[(at >= lo) & (at < hi)] - lo, minlength=hi - lo)
        else:
            at = lists(x)
            counts = np.bincount(at[(at >= lo) & (at < hi)] - lo, minlength=hi - lo)
        answered.append((x, lo, hi, counts))
        del answered[:-8]
        linked = 100 * counts >= percent * (n + nb[lo:hi] - counts)
        places = np.flatnonzero(linked) + lo
        if same:
            places = places[places > i]
        if len(places):
            yield i, places


def _families(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that shared tokens reach from each of n places."""
    label = np.arange(n)
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    size = np.diff(np.append(starts, len(tokens)))
    while True:
        least = np.repeat(np.minimum.reduceat(label[owner], starts), size)
        new = label.copy()
        np.minimum.at(new, owner, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _evaluate(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The sets of a pair of blocks (c1, c2): links between the two, or within if they are one."""
    same = bool((pdf["c1"] == pdf["c2"]).all())
    pdf = pdf.sort_values(["n_shingles", "rep"], kind="stable")
    reps, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
    sides = (pdf["chunk"] == pdf["c2"]).to_numpy().astype(int)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1])))
    shared = np.bincount(number) > 1  # a shingle of one set alone never adds to an overlap; sizes still count it
    keep = shared[number]
    number, owner = number[keep], owner[keep]
    links, into = np.zeros(len(sets), np.int64), np.arange(len(sets))

    def root(i: int) -> int:
        while into[i] != i:
            into[i] = into[into[i]]
            i = int(into[i])
        return i

    if len(number):
        family = _families(number, owner, len(sets))
        back = np.argsort(owner, kind="stable")
        own = dict(zip((u := np.unique(owner[back], return_index=True))[0].tolist(), np.split(number[back], u[1][1:]), strict=True))
        members: dict[int, list[int]] = {}
        for i in own:
            members.setdefault(int(family[i]), []).append(i)
        full = pdf["n_shingles"].to_numpy()
        for group in members.values():
            a = [i for i in group if sides[i] == 0] if not same else group
            b = [i for i in group if sides[i] == 1] if not same else group
            if not a or not b or (same and len(group) < 2):
                continue
            names = np.unique(np.concatenate([own[i] for i in group]))
            local = {i: np.searchsorted(names, np.sort(own[i])) for i in group}
            for i, places in _linked([local[i] for i in a], full[a], [local[i] for i in b], full[b], percent, same):
                x = a[i]
                for p in places.tolist():
                    y = b[p]
                    links[x] += copies[y]
                    links[y] += copies[x]
                    rx, ry = root(x), root(y)
                    if rx != ry:
                        into[max(rx, ry)] = min(rx, ry)
    tops = np.array([root(i) for i in range(len(sets))], np.int64)
    some = (links > 0) | (tops != np.arange(len(sets)))
    return pd.DataFrame({"a": reps[some], "b": reps[tops[some]], "links": links[some]})



def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 75, heavy_least: int = 3, heavy_limit: int = 400_000, block_sets: int = 2048, block_shingles: int = 1 << 19, short_list: int = 64, most_bits: int = 1 << 27) -> DataFrame:
    """docs (doc_id, text) to a row per document: doc_id, n_shingles, n_links (documents whose
    Jaccard similarity with it is at least percent / 100), component_id (smallest doc_id that
    links reach, its own included), class_id and class_size (documents of an equal set).

    Null or empty texts, and texts without words, have 0 shingles and no links. A row without
    doc_id links with nothing and gets a null component. doc_id names a document: rows that
    repeat it repeat its text, and each gets its row. Other columns are ignored; an empty
    table gives no rows. Texts are read whole at any length."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    none = F.lit(-(2**63))
    signed, counts = survey(docs.withColumn("doc_id", F.coalesce("doc_id", none)), width, heavy_least)
    signed = signed.withColumn("doc_id", F.nullif("doc_id", none))
    key = ["s1", "s2", "n_shingles"]
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    classes = materialize(classes, "copies")  # written, as other aggregates below, so that joins on hot keys are of plain shuffles and can be split
    rows = materialize(
        signed.join(classes, key, "left").select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"), F.when(F.col("doc_id").isNotNull(), F.coalesce("copies", F.lit(1))).alias("copies")
        ),
        "classes",
    )
    docs = docs.where("doc_id is not null")
    heavy = spark.sparkContext.broadcast(heavy_shingles(counts, heavy_limit))  # bounded by heavy_limit
    prefixes = materialize(_prefixes(docs, heavy, width, percent), "prefixes")
    posted = prefixes.select("doc_id", F.explode("prefix").alias("h"))
    several = materialize(posted.groupBy("h").count().where("count > 1").select("h"), "several")
    heads = rows.where("n_shingles > 0").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.min("n_shingles").alias("n"))
    # Linked sets differ in size by no more than a factor of 100 / percent: an entry stands in the list of its own band of sizes
    # and in the next one's, and two entries that can link share at least one of these.
    band = F.floor(F.log("n") / float(np.log(100 / percent) * (1 + 1e-9)) - 1e-9).cast("int")
    entries = posted.join(several, "h").join(heads, "doc_id").select("h", "rep", "n", band.alias("own"), F.explode(F.array(band, band + 1)).alias("band")).distinct()
    lists = entries.groupBy("h", "band").agg(F.count("*").alias("length")).where("length > 1")

    def mark(some, sets):
        known, level = heavy.value[0].view(np.uint64), heavy.value[1]
        ends, marks = [], []
        for s in sets:
            rank = _ranks(s, known, level)
            order = np.argsort(rank, kind="stable")
            key = (np.minimum(rank[order], 127) << 56) + (s[order] >> np.uint64(8)).astype(np.int64)
            ends.append(int(key[_prefix(len(s), percent) - 1]) if len(s) else 0)
            marks.append(key[np.arange(_MARKS // 2) * len(s) // _MARKS] if len(s) else _NO)
        return pa.RecordBatch.from_pydict({"rep": some, "end": np.array(ends, np.int64), "marks": _lists(marks)})

    def marks_of(ids):
        return materialize(_some_sets(docs, ids, width, mark, "rep long, end long, marks array<long>", most_bits).join(ids, "rep").dropDuplicates(["rep"]), "marks")

    postings = materialize(entries.join(lists, ["h", "band"]), "postings")
    discard(prefixes, several)
    likely = _likely(postings, percent, short_list, marks_of)
    heads = materialize(likely.groupBy("h").agg(F.min("rep").alias("head")), "heads")
    # Lists of one smallest set are one list: it holds every pair that they hold, each set once however many of them it stands in.
    entries = materialize(likely.join(heads, "h").select(F.col("head").alias("h"), "rep", "head").distinct(), "entries")
    discard(postings, heads)
    members = materialize(
        entries.groupBy("rep").agg(F.min("head").alias("label")).join(rows.where("doc_id = rep").select("rep", "n_shingles", "copies").distinct(), "rep"), "members"
    )
    # A label's sets share a block, as do small labels by hash; a label too large for one is split by hash.
    labels = members.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n_shingles") / block_shingles)).alias("parts"))
    labels = materialize(labels, "labels")
    size = members.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).first()
    blocks = 1 + max(2 * size["n"] // block_sets, 2 * (size["total"] or 0) // block_shingles)
    split = F.xxhash64("label", F.pmod(F.xxhash64("rep"), F.col("parts")))
    members = members.join(labels, "label").select("rep", "n_shingles", "copies", F.when(F.col("parts") > 1, split).otherwise(F.pmod(F.xxhash64("label"), F.lit(blocks))).alias("chunk"))
    members = materialize(members, "blocks")

    placed = entries.select("h", "rep").join(members.select("rep", "chunk"), "rep")
    where = placed.select("h", "chunk").distinct()
    wide = where.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")  # lists over several blocks
    where = where.join(wide, "h")
    pairs = where.alias("x").join(where.select("h", F.col("chunk").alias("other")).alias("y"), "h").where("chunk <> other")
    far = placed.join(pairs, ["h", "chunk"]).select("rep", "chunk", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2")).distinct()
    tasks = far.unionByName(members.select("rep", "chunk", F.col("chunk").alias("c1"), F.col("chunk").alias("c2")))

    def gather(some, sets):
        return pa.RecordBatch.from_pydict({"rep": some, "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    sets = _some_sets(docs, members, width, gather, "rep long, shingles binary", most_bits).join(members.select("rep", "n_shingles", "copies"), "rep")
    found = sets.join(tasks, "rep").groupBy("c1", "c2").applyInPandas(lambda pdf: _evaluate(pdf.drop_duplicates("rep"), percent), "a long, b long, links long")
    found = materialize(found, "links")
    discard(entries, members, labels)
    joined = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    known = materialize(links.join(joined, "id", "full").withColumnRenamed("id", "rep"), "known")
    return rows.join(known, "rep", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, 0).otherwise(F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"), F.col("rep").alias("class_id"), F.col("copies").alias("class_size"),
    )
