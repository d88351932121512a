import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from oracle import connect, duck_rows, spark_rows

from lectern.llm import lines, registry, sharding, simhash
from lectern.llm.components import components


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, con, sf_dir, name):
    assert spark_rows(registry.QUERIES[name](spark, sf_dir)) == duck_rows(con, registry.ORACLES[name])


def plain_line_dedup(rows):
    keys = [[k.strip(" \t\n\r\x0b\x0c").translate({i: i + 32 for i in range(65, 91)}) for k in (t or "").split("\n")] for _, t in rows]
    held, last = defaultdict(set), {}
    for (doc, _), ks in zip(rows, keys):
        for k in set(ks):
            held[k].add(doc)
            last[k] = max(last.get(k, -(1 << 63)), -(1 << 63) if doc is None else doc)
    out = []
    for (doc, t), ks in zip(rows, keys):
        all_ = (t or "").split("\n")
        kept = [x for x, k in zip(all_, ks) if len(k) < 20 or len(held[k]) < 3 or last[k] == (-(1 << 63) if doc is None else doc)]
        out.append((str(doc), len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def line_rows():
    rng = random.Random(1)
    pool = [f"  Shared LINE number {i} äöü \t" for i in range(30)] + ["short", "", "é" * 19, "é" * 20]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(8)))) for i in range(60)]
    return [*rows, (None, pool[0]), (7, rows[7][1]), (61, None), (62, ""), (63, "\n".join(pool) * 50)]


def test_line_dedup_against_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "kept", 5) for i, t in rows], "doc_id long, text string, shard string, h1 int").repartition(3)
    got = lines.dedup_lines(df, mark=True).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == plain_line_dedup(rows)
    kept = lines.dedup_lines(df)
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in kept.collect()) == sorted(x[3] for x in plain_line_dedup(rows))
    assert kept.where("doc_id = 61 AND text IS NULL").count() == 1


def test_repeated_rows_are_one_document(spark, tmp_path):
    """A line in two rows of one document and one of another is in two documents: by brute force and by the SQL."""
    rows = [(1, "a line of twenty letters"), (1, "a line of twenty letters"), (2, "a line of twenty letters"), (3, "x"), (3, "x")]
    rows += [(i, "another line of some length\nz") for i in (4, 4, 5, 6, 6, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.dedup_lines(df, mark=True).drop("text")
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()) == plain_line_dedup(rows)
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = connect("/nowhere")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    by_doc = {r["doc_id"]: r["dropped"] for r in got.groupBy("doc_id").agg({"n_dropped": "sum"}).withColumnRenamed("sum(n_dropped)", "dropped").collect()}
    assert by_doc == dict(con.execute(f"SELECT doc_id, n_dropped FROM ({registry.ORACLES['op5_line_dedup']})").fetchall())


def test_line_dedup_of_odd_tables(spark, odd_docs, no_docs):
    assert lines.dedup_lines(odd_docs).count() == odd_docs.count()
    assert lines.dedup_lines(no_docs).count() == 0 and lines.dedup_lines(no_docs, mark=True).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50_000])
def test_perfect_hash(n):
    h = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    seeds = lines.build_perfect(h)
    assert sorted(lines.slot(h, seeds, len(h)).tolist()) == list(range(len(h)))


def test_shards_of_odd_tables(spark, odd_docs, no_docs):
    assert sharding.shard_by_bytes(no_docs).count() == 0
    rows = sharding.shard_by_bytes(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r["size"] for r in rows if r["doc_id"] in (0, 1)} == {16}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["shard"] for r in ordered] == sorted(r["shard"] for r in ordered)


def test_shards_are_even(spark, documents):
    rows = sharding.shard_by_bytes(documents).collect()
    total, longest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by = Counter()
    for r in rows:
        by[r["shard"]] += r["size"]
    assert all(abs(v - total / 40) <= longest for v in by.values())


def plain_simhash(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    votes = [0] * 64
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(sh))


def plain_components(rows):
    fps = [plain_simhash(t) for _, t in rows]
    n = len(rows)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and ((fps[i] ^ fps[j]).bit_count() <= 2 or rows[i][0] == rows[j][0]):
                parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), 1 << 62), rows[i][0])
    by_fp = {fps[i]: low[find(i)] for i in range(n) if rows[i][0] is not None}
    return sorted((str(doc), format(f, "016x"), str(by_fp.get(f) if doc is None else low[find(i)])) for i, ((doc, _), f) in enumerate(zip(rows, fps)))


def got_components(df):
    return sorted((str(r["doc_id"]), format(r["fp"] & (2**64 - 1), "016x"), str(r["component_id"])) for r in simhash.grouped(df).collect())


def test_simhash_of_odd_tables(spark, odd_docs, no_docs, odd_texts):
    assert simhash.grouped(no_docs).count() == 0
    rows = [(i if i != 3 else None, t) for i, t in enumerate(odd_texts)] + [(8, odd_texts[8])]
    assert got_components(odd_docs) == plain_components(rows)
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(8) == 1 and None in ids and not {1, 2} & {*ids} and simhash.drop_near_copies(no_docs).count() == 0


def test_simhash_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"z{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50))) for i in range(40)] + [(5, "another text with the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_components(df) == plain_components(rows)


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_links_are_exact_whatever_the_crowd(spark, crowd):
    rng = random.Random(crowd)
    mask = 2**64 - 1
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:8]:
        for _ in range(25):
            g = f
            for _ in range(rng.randrange(1, 4)):
                g ^= 1 << rng.randrange(64)
            fps.add(g & mask)
    fps = sorted(fps)
    signed = lambda f: f - 2**64 if f >> 63 else f
    fps.sort(key=signed)
    at = {signed(f): i for i, f in enumerate(fps)}
    classes = spark.createDataFrame([(f,) for f in at], "fp long")
    got = {at[r["node"]]: at[r["root"]] for r in components(simhash.links(classes, crowd)).collect()}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for i in range(len(fps)):
        assert got.get(i, i) == find(i)
