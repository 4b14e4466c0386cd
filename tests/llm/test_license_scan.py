import re

from trellis.llm.license_scan import BASE, NOTICES, license_scan, parsed

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, k=4, cover=0.75, gap=2):
    """Counts by plain loops over words."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    places, labels, score = [], set(), 0.0
    for phrase, label in BASE.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
        score = max(score, float(bool(found)))
    base = ",".join(sorted(labels))
    for notice, label in NOTICES:
        words, keys = parsed(notice)
        at = {}
        for i in range(len(words) - k + 1):
            at.setdefault(tuple(words[i : i + k]), []).append(i)
        votes = {}
        for i in range(len(w) - k + 1):
            for j in at.get(tuple(w[i : i + k]), ()):
                for d in range(i - j - gap, i - j + gap + 1):
                    votes.setdefault(d, set()).update(range(j, j + k))
        for seen in votes.values():
            score = max(score, len(seen) / len(words))
            if len(seen) / len(words) >= cover and set(keys) <= seen:
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), round(score, 9)


def check(df):
    out = license_scan(df).collect()
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))) for r in out)
    assert got == sorted(str((r.doc_id, *brute(r.text))) for r in df.collect())
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    return {r.doc_id: r for r in out}


def test_tables(spark, docs, odd, empty):
    check(docs)
    found = check(odd)
    assert "cc-by-nc" in found[13].labels
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert license_scan(empty).collect() == []


def test_phrases_and_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        (1, "mit license mit license MIT LICENSE apache license"),
        (2, "gnu general public public license gnu general public license"),
        (3, "x " * 500 + mit.replace("free of charge", "without any charge") + " y" * 500),
        (4, "Permission is hereby granted. Nothing else of this kind."),
        (5, "K cc BY cc by; CC-BY é cc by"),
        (6, "license mit"),
    ]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found[3].labels == "mit" and found[3].base_labels == "" and found[4].labels == ""


def test_like_notices_are_told_apart(spark):
    line = "this work is licensed under the gnu general public license version"
    text = {label: " ".join(parsed(n)[0]) for n, label in NOTICES}
    bsd = [" ".join(parsed(n)[0]) for n, label in NOTICES if label == "bsd-3-clause"][0]
    gpl = [" ".join(parsed(n)[0]) for n, label in NOTICES if label == "gpl-2.0"][0]
    rows = [
        (1, f"{line} 2"), (2, f"{line} 2 version 2 version 2 version 2"), (3, f"{line} 3"), (4, f"{line} of any kind"),
        (5, bsd), (6, text["bsd-2-clause"]), (7, gpl), (8, gpl.replace("version 2", "version 3")), (9, f"{gpl} filler {gpl.split('useful')[1]}"),
        (10, text["isc"]), (11, "permission to use copy modify and distribute, without more"), (12, f"{line} 2 and {line} 3"),
    ]
    found = {i: set(r.labels.split(",")) for i, r in check(spark.createDataFrame(rows, "doc_id long, text string")).items()}
    assert found[1] == found[2] == {"gpl", "gpl-2.0"} and found[3] == {"gpl", "gpl-3.0"} and found[4] == {"gpl"}
    assert found[5] == {"bsd", "bsd-3-clause"} and found[6] == {"bsd", "bsd-2-clause"}
    assert found[7] == found[9] == {"gpl", "gpl-2.0"} and found[8] == {"gpl", "gpl-3.0"} and found[10] == {"isc"} and found[11] == {""}
    assert found[12] == {"gpl", "gpl-2.0", "gpl-3.0"}
