"""Operator 8: licence scan by diagonal voting.

Templates are licence notices. All rolling word 3-gram hashes of the documents join the templates' positions in Spark.
Hits are counted by diagonal, the document position less the template position. The votes of neighbouring diagonals, that
is of a notice with a few words put in or left out, are added up over at most `WIDTH` diagonals from each one on; where
they are enough, the span is verified by the longest common subsequence of its words and the template's. A span's share is
that length over the longer of the template and the words from its first to its last match, so scattered words do not make
a notice. Where verified spans overlap, the one with most words in common stays.

Results in special cases. Null and empty texts have no words, no places, empty labels and score 0. Rows that repeat a
doc_id are scanned each for itself, and a null doc_id stays null. An empty table gives no rows. Other columns are not
read. A notice repeated thousands of times in one document is that many candidates of that one document.
"""

from __future__ import annotations

from bisect import bisect
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm import shared
from lectern.llm.decontamination import words_of

GRAM, WIDTH, LEAST_SHARE = 3, 4, 0.8
#: The contract's phrases and labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public licence notices, as their licences word them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD License"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc0", "To the extent possible under law, the person has waived all copyright and related or neighboring rights to this work"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "is MIT licensed"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("bsl-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("bsl-1.0", "Boost Software License - Version 1.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


class Templates:
    """Word ids and gram hashes of phrases and templates. Its size is that of the constants above."""

    def __init__(self, templates, phrases):
        self.labels = [label for label, _ in templates]
        words = [words_of(t) for _, t in templates]
        base = [words_of(p) for p in phrases]
        names = sorted({w for ws in words + base for w in ws})
        self.id = {w: i + 1 for i, w in enumerate(names)}  # 0: a word of no template
        self.ids = [np.array([self.id[w] for w in ws], np.int64) for ws in words]
        self.phrases = [(label, np.array([self.id[w] for w in ws], np.int64)) for label, ws in zip(phrases.values(), base)]
        self.grams = [(t, k, int(h)) for t, ids in enumerate(self.ids) for k, h in enumerate(self.hashes(ids))]
        self.known = np.unique(np.array([h for *_, h in self.grams], np.int64))

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """Rolling hashes of the GRAM ids from each position on: exact numbers, since ids are small. 0: no hash."""
        n = len(ids) - GRAM + 1
        if n < 1:
            return np.zeros(0, np.int64)
        parts = [ids[i : i + n] for i in range(GRAM)]
        size = len(self.id) + 1
        h = np.zeros(n, np.int64)
        for p in parts:
            h = h * size + p
        return np.where(np.min(parts, 0) > 0, h, 0)


@cache
def standard() -> Templates:
    return Templates(TEMPLATES, PHRASES)


def common(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """Length of the longest common subsequence of a and b, and the shortest range [start, end) of b that holds one, the
    first of equals."""
    row = [(0, j + 1) for j in range(-1, len(b))]  # at j: the length, and the latest start of such a subsequence before j
    for x in a:
        new = [row[0]]
        for j, y in enumerate(b):
            best = max(row[j + 1], new[j])
            if x == y:
                n, start = row[j]
                best = max(best, (n + 1, start if n else j))
            new.append(best)
        row = new
    n = row[-1][0]
    ends = [(j - start, start, j) for j, (k, start) in enumerate(row) if k == n] if n else [(0, 0, 0)]
    _, start, end = min(ends)
    return n, start, end


def least_votes(size: int) -> int:
    """Grams that a notice of a template's size shares with it at least, at the least share."""
    return max(1, int(np.ceil(size * (1 - GRAM * (1 - LEAST_SHARE)) - GRAM + 1)))


def verified(want: list[int], ids: np.ndarray, diagonal: int) -> tuple[int, dict] | None:
    """The span of a candidate and how many words it has in common; None if its share is too small."""
    low, high = max(0, diagonal), min(len(ids), diagonal + WIDTH + len(want))
    same, start, end = common(want, ids[low:high].tolist())
    share = same / max(len(want), end - start)
    return (same, {"start": low + start, "end": low + end, "share": share}) if share >= LEAST_SHARE else None


def distinct_spans(found: list[tuple[int, dict]]) -> list[dict]:
    """Of spans that overlap, the one with the most words in common, then the largest share; in text order."""
    found.sort(key=lambda x: (-x[0], -x[1]["share"], x[1]["start"], x[1]["label"]))
    kept: list[tuple[int, int]] = []
    out = []
    for _, x in found:
        i = bisect(kept, (x["start"], x["end"]))
        if (i == 0 or kept[i - 1][1] <= x["start"]) and (i == len(kept) or kept[i][0] >= x["end"]):
            kept.insert(i, (x["start"], x["end"]))
            out.append(x)
    return sorted(out, key=lambda x: x["start"])


def scan_words(docs: DataFrame) -> DataFrame:
    """A row for each document: base places, and its word ids for the method, 0 for words of no template."""

    def run(batches):
        t, pid, n = standard(), TaskContext.get().partitionId(), 0
        get = t.id.get
        for b in batches:
            out = {k: [] for k in ("uid", "n_words", "n_base", "first_word", "last_word", "base", "ids")}
            for text in b.column("text").to_pylist():
                words = words_of(text)
                ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
                spots, base = [], []
                for label, phrase in t.phrases:
                    m = len(ids) - len(phrase) + 1
                    if m > 0:
                        at = np.flatnonzero(np.all([ids[i : i + m] == w for i, w in enumerate(phrase)], axis=0))
                        if len(at):
                            spots.append(at)
                            base.append(label)
                every = np.concatenate(spots) if spots else ()
                row = ((pid << 40) + n, len(words), len(every), int(min(every)) if len(every) else None, int(max(every)) if len(every) else None, sorted({*base}), ids.astype("<i2").tobytes())
                for k, v in zip(out, row):
                    out[k].append(v)
                n += 1
            yield out | {"doc_id": b.column("doc_id")}

    return shared.map_texts(docs.select("doc_id", "text"), run, "uid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, ids binary")


def rolling_grams(words: DataFrame) -> DataFrame:
    """(uid, pos, h): every rolling gram of the documents (uid, ids)."""

    def run(batches):
        t = standard()
        for b in batches:
            for uid, raw in zip(b.column("uid").to_pylist(), b.column("ids").to_pylist()):
                h = t.hashes(np.frombuffer(raw, "<i2").astype(np.int64))
                for at in range(0, len(h), 1 << 16):
                    some = h[at : at + (1 << 16)]
                    yield pa.record_batch([pa.array(np.full(len(some), uid)), pa.array(np.arange(at, at + len(some))), pa.array(some)], names=["uid", "pos", "h"])

    return words.select("uid", "ids").mapInArrow(run, "uid long, pos long, h long")


def scan(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with their base places, labels, verified spans and score."""
    spark, t = docs.sparkSession, standard()
    words = shared.stored(scan_words(docs), "words")
    places = F.broadcast(spark.createDataFrame([(i, k, h, least_votes(len(t.ids[i]))) for i, k, h in t.grams], "template int, at int, h long, least int"))
    hits = rolling_grams(words).join(places, "h")
    diagonals = hits.groupBy("uid", "template", "least", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"))
    near = W.partitionBy("uid", "template").orderBy("diagonal").rangeBetween(0, WIDTH)  # one document's hits on one template
    merged = (
        diagonals.withColumn("all", F.sum("votes").over(near))
        .where("all >= least")
        .groupBy("uid")
        .agg(F.collect_list(F.struct("template", "diagonal")).alias("bands"))  # one document's candidates
    )
    both = words.join(merged, "uid", "left")

    def verify(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])))])
        t = standard()
        for b in batches:
            labels, scores, spans = [], [], []
            for base, bands, raw in zip(b.column("base").to_pylist(), b.column("bands").to_pylist(), b.column("ids").to_pylist()):
                ids, found = np.frombuffer(raw or b"", "<i2"), []
                for c in bands or ():
                    if got := verified(t.ids[c["template"]].tolist(), ids, c["diagonal"]):
                        found.append((got[0], {"label": t.labels[c["template"]]} | got[1]))
                found = distinct_spans(found)
                labels.append(",".join(sorted({*base, *(x["label"] for x in found)})))
                scores.append(1.0 if base else max((x["share"] for x in found), default=0.0))
                spans.append(found)
            base = [",".join(x) for x in b.column("base").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("n_words"), b.column("n_base"), b.column("first_word"), b.column("last_word"), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, schema.field("spans").type)], schema=schema)

    return both.mapInArrow(verify, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,share:double>>")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents")).drop("spans")
