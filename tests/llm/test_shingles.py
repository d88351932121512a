import random

import corpus_pipeline
import numpy as np

from lectern.llm import shared, shingles, simhash


def plain_sets(rows, k=5):
    w = [(t or "").encode().lower().split() for _, t in rows]
    return [{b" ".join(x[i : i + k]) for i in range(max(1, len(x) - k + 1))} if x else set() for x in w]


def plain_kept(rows, alike=0.8):
    """The smallest doc_id of each group, by all pairs."""
    sets, parent = plain_sets(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) * 5 >= 4 * both:
                parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 1 << 62), doc)
    return sorted(doc for i, (doc, _) in enumerate(rows) if low[find(i)] == doc)


def planted():
    """Copies of one to eight edits of several texts, chains of copies, a passage that all share, short and odd texts."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(60, 300))] + passage
        rows.append(base)
        for edits in range(1, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
        for _ in range(4):  # each from the one before
            base = list(base)
            for _ in range(3):
                base[rng.randrange(len(base))] = word()
            rows.append(base)
    rows += [[word() for _ in range(n)] + passage for n in range(0, 60, 2)] + [[word() for _ in range(n % 7)] for n in range(20)]
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_near_copies_against_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, keys int").repartition(3)
    kept = simhash.drop_near_copies(df, words=5, alike=(4, 5))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_kept(rows)


def test_keys_of_alike_sets():
    """Pairs of similarity 0.8 share a key nearly always, pairs of 0.3 seldom."""
    rng = np.random.default_rng(5)
    met = {0.8: 0, 0.3: 0}
    for alike in met:
        for _ in range(300):
            n = int(rng.integers(20, 400))
            both = round(2 * n * alike / (1 + alike))
            x = shingles.mixed(rng.integers(0, 1 << 62, 2 * n - both).astype("<u8"))
            a, b = np.sort(x[:n]), np.sort(x[n - both :])
            met[alike] += bool({*shingles.bands(a).tolist()} & {*shingles.bands(b).tolist()})
    assert met[0.8] >= 299 and met[0.3] <= 30


def test_a_large_group_of_near_copies(spark):
    """Some thousand documents, each near to a few others only by chains: candidates stay in proportion, one stays."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(1500):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert [r["doc_id"] for r in simhash.drop_near_copies(df, words=5, alike=(4, 5)).collect()] == [0]
    found = shared.stored(shingles.keyed(df, 5), "t")
    pairs = shingles.candidates(found.where("doc_id IS NOT NULL"), simhash.links)
    assert pairs.count() <= len(rows) * (shingles.BANDS + 64)


def test_pipeline_drops_planted_near_copies(spark, documents):
    """The stages that drop copies leave none of the near copies that brute force finds."""
    stages = dict(corpus_pipeline.STAGES)
    docs = documents
    for name in list(stages)[: list(stages).index("decontamination")]:
        docs = stages[name](spark, docs, None).cache()
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert plain_kept(left) == sorted(d for d, _ in left)


def test_near_copies_of_odd_tables(spark, odd_docs, no_docs):
    kept = simhash.drop_near_copies(odd_docs, words=5, alike=(4, 5))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd_docs.columns and ids.count(8) == 1 and None in ids and not {1, 2} & {*ids}
    assert simhash.drop_near_copies(no_docs, words=5, alike=(4, 5)).count() == 0


def test_near_copies_in_a_crowd_just_below_the_threshold(spark):
    """All share a passage and are alike in pairs only: the classes that a key is shared with are mostly unlike."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(91)]  # 87 of 100 shingles, a similarity of 87 / 113
    rows = [passage + [word() for _ in range(13)] for _ in range(240)]
    rows += [x[:-11] + [word() for _ in range(11)] for x in rows[:160]]  # 89 / 111 with its first
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in simhash.drop_near_copies(df, words=5, alike=(4, 5)).collect())
    assert kept == plain_kept(rows) == list(range(240))
    classes = shared.stored(shingles.keyed(df, 5), "t")
    none = spark.createDataFrame([], "node long, root long")
    assert shingles.missed(df, classes, none, 5, (4, 5)).count() < 10 * len(rows)


def test_prefixes_find_all_alike(spark):
    """Without any link of the keys, of sets of many sizes, no pair that is alike is missing."""
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classes = shared.stored(shingles.keyed(df, 5).dropDuplicates(["fp"]), "t")
    pairs = shingles.missed(df, classes, spark.createDataFrame([], "node long, root long"), 5, (4, 5))
    met = {frozenset((r["a"], r["b"])) for r in pairs.collect()}
    sets = {shingles.signature(s): s for s in (shingles.shingle_set(t, 5) for _, t in rows) if len(s)}
    alike = {frozenset((a, b)) for a in sets for b in sets if a < b and 9 * shingles.common(sets[a], sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert len(alike) > 100 and alike <= met
