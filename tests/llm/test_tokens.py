import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trellis.llm.packing import fit, pack, patterns, plan
from trellis.llm.rans import Coder, frequencies
from trellis.llm.token_files import read_tokens, write_tokens
from trellis.llm.tokens import encode_words

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = ["é é a ́b", "가 xᆨ", "İI ǅ ß Σας ΣΑΣ", "a\x1cb\x85c\xa0d e", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "it's I'LL 'S don't", "12³ ½ ٣", "", "  \n", "a" * 3000, "\x0b\x0c z", "한국어 조합", "a.̈b!?.,x.. Co-op;"]


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_words_apart_are_the_text(docs, ids):
    for text in [*ODD_TEXTS, *[r.text for r in docs.collect()]]:
        assert encode_words(PATH, text) == np.array(ids(text), "<u4").tobytes(), text[:80]


def check_packing(df, room, ids, out):
    want = []
    for r in df.collect():
        x = [*ids(r.text), 0]
        want += [(str(r.doc_id), k, a, len(x[a : a + room]), crc(x[a : a + room])) for k, a in enumerate(range(0, len(x), room))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(sequences), -(-sum(x[3] for x in want) // room)


def test_pack(docs, odd, empty, ids):
    n, bound = check_packing(docs, 2048, ids, pack(docs, PATH).collect())
    assert n <= bound * 1.03 + 1
    n, bound = check_packing(odd, 64, ids, pack(odd, PATH, room=64).collect())
    assert n <= bound * 1.05 + 1
    assert pack(empty, PATH).collect() == []


def test_plan():
    h = np.zeros(65, np.int64)
    h[[10, 54, 32, 64, 7, 57]] = [1000, 1000, 501, 9, 300, 300]
    runs, n = plan(h, 64)
    assert n == 1000 + 251 + 9 + 300
    placed = np.zeros(65, np.int64)
    for length, first, count, _, _ in runs:
        assert first == placed[length]
        placed[length] += count
    assert (placed == h).all()
    kinds = patterns(64, 16)
    x = fit(h.astype(float), kinds)
    assert (x >= 0).all() and abs(sum(x[i] for i in range(len(kinds)) if set(kinds[i]) == {10, 54, 0}) - 1000) < 5


@pytest.mark.parametrize("n,size", [(0, 5), (1, 5), (63, 9), (64, 9), (5000, 300), (200_000, 49_408), (70_001, 1)])
def test_rans(n, size):
    x = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, size - 1).astype(np.uint32)
    c = Coder(frequencies(np.bincount(x, minlength=size)))
    assert int(c.freq.sum()) == 1 << 18
    b = c.encode(x)
    assert (c.decode(b) == x).all()
    parts = [c.decode_part(b, k) for k in reversed(range(c.parts(b)))][::-1]
    assert n == 0 or (np.concatenate(parts) == x).all()
    if n > 4000 and size > 1:
        with pytest.raises(ValueError):
            c.decode(b[:-40] + bytes([b[-40] ^ 1]) + b[-39:])


def test_frequencies_rare_and_many():
    counts = np.ones(200_000, np.int64)
    counts[0] = 10**12
    f = frequencies(counts)
    assert f.sum() == 1 << 18 and f.min() == 1
    assert frequencies(np.zeros(4)).sum() == 1 << 18


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_files(request, spark, ids, which):
    df = request.getfixturevalue(which)
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, at = [], 0
    for r in rows:
        x = [*ids(r.text), 2]
        want.append((r.doc_id, at, len(x), crc(x)))
        at += len(x)
    out = read_tokens(spark, write_tokens(df, PATH, block=1000)).collect()
    assert sorted((tuple(r) for r in out), key=lambda r: r[1]) == want


def test_files_empty(spark, empty):
    assert read_tokens(spark, write_tokens(empty, PATH)).collect() == []
