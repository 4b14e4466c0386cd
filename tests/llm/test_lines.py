import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from trellis.llm.line_dedup import line_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=2, chars=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= chars:
                holders[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(h := holders.get(key(x), ())) < least or d == min(h)]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.h) for r in df.withColumn("h", F.sha2("text", 256)).collect())


def test_tables(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert got(line_dedup(df)) == brute(rows)
        assert got(line_dedup(df, min_docs=3, min_chars=4)) == brute(rows, 3, 4)
    assert line_dedup(empty).collect() == []


def test_all_columns_stay(odd):
    assert line_dedup(odd).columns == [*odd.columns, "n_lines", "n_dropped"]


def test_clashing_names(odd):
    more = odd.withColumn("n_lines", F.lit("mine")).withColumn("gone", F.lit(1)).withColumn("row", F.lit("r"))
    out = line_dedup(more)
    assert out.columns == [*more.columns, "n_dropped"] and {r.n_lines for r in out.collect()} == {"mine"}
    assert line_dedup(more, counts=False).columns == more.columns
