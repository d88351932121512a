import hashlib
import random
import re

import numpy as np
import pytest

from lectern.llm import decontamination, embeddings, licences

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def plain_contamination(docs, items, window=13):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            iw = words(it)
            m = min(window, len(iw))
            pats = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else set()
            for s in range(len(w) - m + 1 if m else 0):
                if tuple(w[s : s + m]) in pats:
                    hit.update(range(s, s + m))
                    if item is not None:
                        found.add(str(item))
        n = len(hit)
        out.append((str(doc), len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return sorted(out)


def got_contamination(docs, items, **kw):
    rows = decontamination.contamination(docs, items, **kw).collect()
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in rows)


@pytest.mark.parametrize("block_words", [10, 100, 2_000_000])
def test_contamination_against_brute_force(spark, block_words):
    rng = random.Random(block_words)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ä", "Éa"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 12, 13, 14, 30, 30])] + [(8, None), (9, "!!"), (None, text(2)), (10, text(20)), (11, None)]
    items += [(12, items[10][1]), (6, items[6][1])]
    docs = [(i, text(rng.randrange(60))) for i in range(30)] + [(40, None), (41, ""), (42, items[6][1] + " " + text(9)), (43, text(900) + " " + items[7][1]), (44, text(20_000)), (None, items[5][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert got_contamination(d, b, block_words=block_words) == plain_contamination(docs, items)
    kept = decontamination.drop_contaminated(d, b, block_words=block_words)
    clean = sorted(x[0] for x in plain_contamination(docs, items) if not x[5])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == clean and kept.columns == d.columns


def test_contamination_of_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontamination.contamination(odd_docs, none).collect())
    assert decontamination.contamination(no_docs, none).count() == 0
    assert decontamination.drop_contaminated(odd_docs, none).count() == odd_docs.count()


def test_licences(spark, odd_docs, no_docs):
    filler = "lorem ipsum dolor sit amet " * 30
    cases = {
        1: ("Released under the MIT License.", "", "mit"),
        2: (f"{filler}Licensed under the Apache License, Version 2.0. {filler}", "", "apache-2.0"),
        3: ("This work is licensed under the GNU General Public License, version 3.", "gpl", "gpl,gpl-3.0"),
        4: ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", "cc-by,reserved", "cc-by,cc-by-nc,reserved"),
        5: ("Permission is hereby granted, at no charge, to any person obtaining a copy of this software and associated documentation files", "", "mit"),
        6: ("the license is here, and the software too", "", ""),
        7: ("all rights were reserved", "", ""),
        8: (None, "", ""),
        9: ("cc by " * 3000, "cc-by", "cc-by"),
        10: ("licensed under the apache treaty, a license of version 2.0", "", ""),
        11: ("we were licensed under the old rules. the apache license of the tribe, version 2 0 of events", "", ""),
        12: ("// SPDX-License-Identifier: Apache-2.0", "", "apache-2.0"),
        13: ("This project is MIT licensed.", "", "mit"),
        14: (f"{filler}Distributed under the Boost Software License, Version 1.0.", "", "bsl-1.0"),
    }
    df = spark.createDataFrame([(k, v[0], 1) for k, v in cases.items()], "doc_id long, text string, uid int")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert {k: (r["base_labels"], r["labels"]) for k, r in got.items()} == {k: v[1:] for k, v in cases.items()}
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (2, 2, 7) and got[8]["first_word"] is None
    assert got[9]["n_base"] == 3000 and all(0 <= r["score"] <= 1 for r in got.values()) and got[6]["score"] == 0
    assert licences.scan(no_docs).count() == 0 and licences.scan(odd_docs).count() == odd_docs.count()


def test_licence_places_against_brute_force(spark, sf_dir, plain_documents):
    want = {}
    for doc, text, _ in plain_documents:
        w = words(text)
        at = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want[doc] = (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    rows = licences.op8_licence_scan(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows} == want


def plain_labels(text):
    """Labels and the largest share, by plain loops over grams, diagonals and all subsequences' spans."""
    t = licences.standard()
    ids = [t.id.get(w.encode(), 0) for w in words(text)]
    found = []
    for k, label in enumerate(t.labels):
        want = t.ids[k].tolist()
        votes = {}
        for i in range(len(ids) - 2):
            for j in range(len(want) - 2):
                if ids[i : i + 3] == want[j : j + 3]:
                    votes[i - j] = votes.get(i - j, 0) + 1
        for d in votes:
            if sum(n for e, n in votes.items() if 0 <= e - d <= licences.WIDTH) < licences.least_votes(len(want)):
                continue
            low, high = max(0, d), min(len(ids), d + licences.WIDTH + len(want))
            best = None
            for a in range(low, high):
                for z in range(a + 1, high + 1):
                    n = [[0] * (z - a + 1) for _ in range(len(want) + 1)]
                    for p, x in enumerate(want):
                        for q, y in enumerate(ids[a:z]):
                            n[p + 1][q + 1] = n[p][q] + 1 if x == y else max(n[p][q + 1], n[p + 1][q])
                    one = (-n[-1][-1], z - a, a)
                    best = one if best is None else min(best, one)
            share = -best[0] / max(len(want), best[1])
            if share >= licences.LEAST_SHARE:
                found.append((best[0], -share, best[2], label, best[2] + best[1]))
    kept = []
    for same, share, start, label, end in sorted(found):
        if all(end <= a or start >= z for a, z, *_ in kept):
            kept.append((start, end, label, -share))
    return sorted({x[2] for x in kept}), max((x[3] for x in kept), default=0.0)


def test_labels_against_brute_force(spark):
    """Notices whole, with words put in, left out and changed, one after another and cut short, among filler."""
    rng = random.Random(6)
    filler = ["lorem", "the", "license", "of", "software", "under", "ipsum"]
    rows = []
    for i in range(60):
        _, notice = rng.choice([x for x in licences.TEMPLATES if len(words(x[1])) < 13])
        w = notice.split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(filler)] if rng.random() < 0.6 else []
            w = w or ["x"]
        w = [rng.choice(filler) for _ in range(rng.randrange(6))] + w + [rng.choice(filler) for _ in range(rng.randrange(6))]
        if i % 7 == 0:
            w += rng.choice(licences.TEMPLATES[:4])[1].split()[:9]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licences.scan(df).collect():
        text = rows[r["doc_id"]][1]
        labels, share = plain_labels(text)
        base = [x for x in r["base_labels"].split(",") if x]
        assert r["labels"] == ",".join(sorted({*labels, *base})), text
        assert abs(r["score"] - (1.0 if base else share)) < 1e-9, text


def vector_rows(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for _ in range(6):
            c = rng.standard_normal(16)
            rows += [(c + rng.standard_normal(16) * rng.choice([0.01, 0.05, 0.12]), label) for _ in range(20)]
        rows += [(rng.standard_normal(16), label) for _ in range(60)]
        rows += [(rows[5][0], label)] * 7
    rows += [(rows[0][0], None), (np.zeros(16), 0), (rows[1][0][:8], 0), (np.full(16, np.nan), 0), (np.full(16, np.inf), 0)]
    out = [(i, [float(x) for x in v], None if label is None else int(label)) for i, (v, label) in enumerate(rows)]
    return [*out, (len(out), None, 0), (len(out) + 1, [], 1), (len(out) + 2, [1.0, None], 1), (None, out[0][1], 0)]


def plain_links(rows):
    ok = [(i, np.array(np.array(v, np.float32), float), label) for i, v, label in rows if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    n, parent = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, v, x) in enumerate(ok):
        for j, w, y in ok[:a]:
            if x == y and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((str(i), n[i], str(find(i)), find(i) == i) for i, *_ in rows)


def test_embeddings_against_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    found = embeddings.near_duplicates(df)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in found.collect())
    want = plain_links(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert sum(g == w for g, w in zip(got, want)) >= 0.98 * len(want)
    assert embeddings.audit(df, found) >= 0.9


def test_embeddings_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(none).count() == 0
    one = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in embeddings.near_duplicates(one).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_shards_stay_bounded(spark, monkeypatch):
    """A label beyond a shard's size is dealt over several and still links."""
    monkeypatch.setattr(embeddings, "SHARD_ROWS", 60)
    monkeypatch.setattr(embeddings, "CHUNK", 100)
    rows = [r for r in vector_rows(3) if r[2] == 0]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert embeddings.audit(df, embeddings.near_duplicates(df), every=1) >= 0.9


def test_many_blocks_cost_blocks_not_blocks_times_batches(spark):
    """Tables are built once: a batch is searched against ten blocks without building any again, in bounded memory."""
    import time

    import numpy as np

    rng = random.Random(1)
    words = [f"w{rng.randrange(30_000)}" for _ in range(200_000)]
    b = spark.createDataFrame([(i, " ".join(words[i * 100 : i * 100 + 100])) for i in range(2000)], "item_id long, text string")
    files = decontamination.write_blocks(b, 20_000)
    assert len(files) >= 10
    texts = [" ".join(f"u{rng.randrange(30_000)}" for _ in range(500)) for _ in range(100)] + [" ".join(words[150:190])]
    decontamination.search(texts, files)
    began = time.time()
    for _ in range(5):
        found = decontamination.search(texts, files)
    assert time.time() - began < 5
    assert found[-1] == (40, 40, ["1"]) and not any(k for _, k, _ in found[:-1])
    assert sum(sum(a.nbytes for a in decontamination.open_block(f).a.values()) for f in files) < 100 * len(words)
    assert np.all([len(decontamination.open_block(f).lengths) == 1 for f in files])


def many_vectors(n=8000, dim=32, seed=4):
    """One label: half in groups of near copies of two to forty, half alone."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n // 2:
        c = rng.standard_normal(dim)
        rows += [c + 0.1 * rng.standard_normal(dim) for _ in range(int(rng.integers(2, 41)))]
    rows += [rng.standard_normal(dim) for _ in range(n - len(rows))]
    return np.array(rows)[rng.permutation(len(rows))]


def test_recall_where_clusters_are_many_shards(spark, monkeypatch):
    """Eight centroids and shards of 100: a first cluster holds some twenty shards, as at millions of vectors a label."""
    monkeypatch.setattr(embeddings, "CENTROIDS", 8)
    monkeypatch.setattr(embeddings, "SHARD_ROWS", 100)
    monkeypatch.setattr(embeddings, "CHUNK", 3000)
    x = many_vectors()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= embeddings.LEAST_COSINE).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 1000 and (found <= want).all()
    assert found.sum() >= 0.95 * want.sum()


def test_sets_and_bitmaps_of_visited_nodes_agree(monkeypatch):
    x = many_vectors(600, 16).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = np.full((len(x), embeddings.DEGREE), -1, np.int64)
    for i, a in enumerate(embeddings.build_graph(x)):
        table[i, : len(a)] = a[: embeddings.DEGREE]
    start = np.zeros((len(x), 1), np.int64)
    a = embeddings.beam_search(x, table, start, x, in_range=0.98)
    monkeypatch.setattr(embeddings, "VISITED", 0)
    b = embeddings.beam_search(x, table, start, x, in_range=0.98)
    assert (a[0] == b[0]).all() and all((p == q).all() for p, q in zip(a[1], b[1]))


def test_doubles_are_not_rounded(spark):
    """A cosine that single precision lifts over the threshold, and components beyond its range."""
    c = 0.98 - 1e-9
    rows = [(1, [1.0, 0.0], 1), (2, [c, float(np.sqrt(1 - c * c))], 1), (3, [1e300, 0.0], 2), (4, [2e300, 1e290], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in embeddings.near_duplicates(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False)]


def test_recall_at_sf01(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert embeddings.audit(df, embeddings.near_duplicates(df)) >= 0.9
