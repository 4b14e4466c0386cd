from collections import Counter, defaultdict

import corpus_pipeline
import test_lines
import test_ngram_join
from trellis.llm import mixing, packing, quality
from trellis.llm.common import table


def test_stages(spark, sf):
    """Each stage on its own input, against plain loops (the classifier and the draw against their own scores and copies)."""
    docs = table(spark, sf, "documents")
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, sf)
    want = {r.doc_id for r in quality.score_quality(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == want and 0 < len(want) < docs.count() and good.columns == columns

    lined = stage["line dedup"](spark, good, sf)
    assert [x[:1] + x[3:] for x in test_lines.brute([(r.doc_id, r.text) for r in good.collect()])] == sorted((str(r.doc_id), test_lines.hashlib.sha256(r.text.encode()).hexdigest()) for r in lined.collect())
    assert lined.columns == columns

    rows = [(r.doc_id, r.text) for r in lined.collect()]
    single = stage["n-gram Jaccard join"](spark, lined, sf)
    assert {str(r.doc_id) for r in single.collect()} == {d for d, _, _, c in test_ngram_join.brute(rows) if str(c) == d} and single.columns == columns

    mixed = stage["mixing sources to target weights"](spark, single, sf)
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in copies.items() if n}) and mixed.columns == columns

    packed = stage["best-fit packing"](spark, mixed, sf).collect()
    ids = packing.pieces(mixed, corpus_pipeline.TOKENIZER).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, packed)) == sorted(map(key, ids))
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_near_copies_keeps_one_of_each(spark, odd, sf):
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, odd, sf).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 4, 5, 6, 7, 9, 11, 12, 13] and kept.count(None) == 2


def test_empty_and_odd_run_through(spark, odd, empty, sf):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf)
        df.collect()
