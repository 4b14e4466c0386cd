"""Finds license texts by diagonal voting, with DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_AS_IS = """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""
_GNU = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
the free software foundation either version {} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty
without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""
#: Public license notices in lower-case words, whole, as (text, label). Words in [] tell a notice from its like: without all of them it isn't found.
NOTICES = (
    ("""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software
without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom
the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection
with the software or the use or other dealings in the software""", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    (f"{_BSD.replace('the distribution', '')} the [distribution this] software{_AS_IS.removeprefix('this software')}", "bsd-2-clause"),
    (f"{_BSD} [neither the name of] the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS}", "bsd-3-clause"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("""licensed under the apache license [version 2 0] the license you may not use this file except in compliance with the license you may obtain a copy of the license at
http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""", "apache-2.0"),
    ("licensed under the apache license [version 2 0]", "apache-2.0"),
    (_GNU.format("[2]"), "gpl-2.0"),
    (_GNU.format("[3]"), "gpl-3.0"),
    ("this work is licensed under the gnu general public license [version 2]", "gpl-2.0"),
    ("this work is licensed under the gnu general public license [version 3]", "gpl-3.0"),
    ("licensed under cc [by nc] 4 0", "cc-by-nc"),
    ("licensed under cc [by sa] 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons [attribution 4 0] international license", "cc-by"),
    ("this work is licensed under a creative commons [attribution sharealike 4 0] international license", "cc-by-sa"),
    ("""this source code form is subject to the terms of the mozilla public license v [2 0] if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0""", "mpl-2.0"),
    (f"{_GRANT} the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "isc"),
    ("""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""", "unlicense"),
)


def parsed(notice: str) -> tuple[list[str], list[int]]:
    """A notice's words, and the places of those in []."""
    words = notice.replace("\n", " ").split()
    inside, keys = False, []
    for i, w in enumerate(words):
        inside = inside or w.startswith("[")
        if inside:
            keys.append(i)
        inside = inside and not w.endswith("]")
    return [w.strip("[]") for w in words], keys


def template_rows(notices, k: int) -> list[tuple]:
    """(gram, t, at, label, base, size, keys): a row per template and place of a k-word gram; base phrases have one gram, whole."""
    rows = [(phrase, t, 0, label, True, len(phrase.split()), []) for t, (phrase, label) in enumerate(BASE.items())]
    for t, (text, label) in enumerate(notices, len(BASE)):
        w, keys = parsed(text)
        if len(w) < k:
            raise ValueError(f"a notice has at least {k} words: {text}")
        rows += [(" ".join(w[i : i + k]), t, i, label, False, len(w), keys) for i in range(len(w) - k + 1)]
    return rows


def license_scan(docs: DataFrame, notices=NOTICES, k: int = 4, cover: float = 0.75, gap: int = 2) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and characters above ASCII, A-Z lower-cased. Every k-word
    gram of every whole text meets the templates' positions (a fixed table of about a thousand
    rows, broadcast) by 64-bit hashes, of which a false hit can move no verdict but one in a borderline span. Hits vote for diagonals
    (place in the text less place in the template). A base phrase stands where its words do, compared themselves. For notices, the votes of diagonals at most ``gap``
    away are added to a diagonal's own, so that a word put in or left out costs only the grams it breaks; what is further away, as a repeated tail, adds nothing.
    A span is verified if words of hit grams are at least ``cover`` of the template's, all words that tell it from its like among them; its label is added to the
    base labels. score is the largest share of a template's words that a diagonal covers, 0 without any.

    notices: (text, label) pairs; words in [] must all be there. Null and empty texts have 0 words and no labels (empty strings). Null doc_ids stay and
    repeated rows each get their row; other columns are ignored; an empty table gives no rows.
    Texts are read once; what is shuffled is one row per document and a few per hit."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(template_rows(notices, k), "gram string, t int, at int, label string, base boolean, size int, keys array<int>")
    w = F.split("gram", " ")
    h = F.when(F.col("base"), F.col("t").cast("long")).otherwise(F.xxhash64(*[F.get(w, i) for i in range(k)]))
    # A document's one mark of no place meets a row of its own. Base phrases go by number, as their words are compared.
    mark = spark.createDataFrame([(-1, 0, None, False, 1, [], -1)], "t int, at int, label string, base boolean, size int, keys array<int>, h long")
    templates = F.broadcast(rows.select("t", "at", "label", "base", "size", "keys", h.alias("h")).unionByName(mark))
    key = ["doc_id", "of", "copies"]
    words = docs.select("doc_id", F.xxhash64("text").alias("of"), F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORDS), F.lit(0)).alias("words"))
    stands = lambda phrase, w, i: reduce(lambda a, b: a & b, [w == phrase[0], *[F.get("words", i + j) == x for j, x in enumerate(phrase[1:], 1)]])
    base_of = lambda w, i: reduce(lambda c, p: c.when(stands(p[1].split(), w, i), F.lit(p[0]).cast("long")), enumerate(BASE), F)
    at = lambda i, h: F.struct(i.alias("place"), h.alias("h"))
    notice = F.transform("words", lambda w, i: at(i, F.xxhash64(w, *[F.get("words", i + j) for j in range(1, k)])))
    base = F.filter(F.transform("words", lambda w, i: at(i, F.when(w.isin(sorted({p.split()[0] for p in BASE})), base_of(w, i)))), lambda s: s["h"].isNotNull())
    grams = words.select("doc_id", "of", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(F.array(at(F.lit(0), F.lit(-1).cast("long"))), notice, base)).alias("g")).select("doc_id", "of", "n_words", "g.*")
    hits = grams.join(templates, "h").withColumn("diagonal", F.col("place") - F.col("at"))
    near = F.when(F.col("base") | (F.col("t") < 0), F.array("diagonal")).otherwise(F.sequence(F.col("diagonal") - gap, F.col("diagonal") + gap))
    # Rows of the same doc_id and text are one key; marks of their number bring them back at the end.
    spans = hits.select("doc_id", "of", "n_words", "t", "label", "base", "size", "keys", "at", F.explode(near).alias("diagonal")).groupBy("doc_id", "of", "t", "diagonal").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.max("n_words").alias("n_words"), F.count("*").alias("rows"), F.collect_set("at").alias("seen")
    )
    covered = F.array_distinct(F.flatten(F.transform("seen", lambda a: F.sequence(a, a + (k - 1)))))
    spans = spans.withColumn("covered", F.when(~F.col("base") & (F.col("t") >= 0), covered))
    share = F.size("covered") / F.col("size")
    good = F.coalesce((share >= cover) & (F.size(F.array_except("keys", "covered")) == 0), F.lit(False))
    base = F.col("base") & (F.col("t") >= 0)
    done = spans.groupBy("doc_id", "of").agg(
        F.max(F.when(F.col("t") < 0, F.col("rows"))).alias("copies"), F.max("n_words").alias("n_words"), F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | good, F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("t") < 0, 0.0).when(base, 1.0).otherwise(share)).alias("score"),
    )
    out = [c for c in done.columns if c not in key]
    return done.select("doc_id", *out, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")
