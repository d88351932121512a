"""Operator 5: line dedup through a sharded minimal perfect hash.

Every document gives the 128-bit hashes of its distinct long line keys. Spark counts the documents of each hash and
keeps the largest doc_id, with partial sums before the shuffle, so a line that all documents share costs a row for
each task. All distinct hashes are dealt to shards by their first half; each shard gets a minimal perfect hash that
indexes flat arrays: a 64-bit fingerprint (the hash's second half), the document count and the largest doc_id. The
shards are files in the shared folder. Documents probe the mapped arrays, a batch at a time and shard by shard, and the
count found there decides; lines are never joined.

Results in special cases. Null and empty texts are one empty line, which is too short to drop. Rows that repeat a
doc_id are one document when documents are counted, and so are all rows with a null doc_id; each row loses its own
lines, and all rows with the largest doc_id keep the line. A null doc_id is smaller than any other. An empty table
gives no rows. Other columns pass through `dedup_lines` untouched.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import shared

LEAST_CHARS, LEAST_DOCS = 20, 3
NULL_ID = -(1 << 63)
#: Hashes a shard holds on average; a shard's arrays then take some 3 MB. Shards kept open, where they are mapped and
#: where they are read.
PER_SHARD, OPEN_MAPPED, OPEN_READ = 1 << 17, 4096, 16
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def long_keys(text: str | None, least: int = LEAST_CHARS) -> list[bytes | None]:
    """For each line its key, None where the key has fewer than `least` code points."""
    out: list[bytes | None] = []
    for line in (text or "").encode().lower().split(b"\n"):  # bytes.lower changes A-Z only
        key = line.strip(b" \t\n\r\x0b\x0c")
        n = len(key)
        out.append(key if n >= least and (n >= 4 * least or key.isascii() or len(key.decode()) >= least) else None)
    return out


def halves(key: bytes) -> tuple[int, int]:
    """The key's 128-bit hash as two signed 64-bit halves."""
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def line_hashes(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, doc_id), a row for each distinct long key of each document."""

    def run(batches):
        for b in batches:
            h1, h2, ids = [], [], []
            for doc, text in zip(b.column("doc_id").fill_null(NULL_ID).to_pylist(), b.column("text").to_pylist()):
                keys = {*long_keys(text, least)}
                keys.discard(None)
                for key in keys:
                    a, z = halves(key)
                    h1.append(a)
                    h2.append(z)
                ids.extend([doc] * len(keys))
            yield {"h1": h1, "h2": h2, "doc_id": ids}

    return shared.map_texts(docs.select("doc_id", "text"), run, "h1 long, h2 long, doc_id long")


def mix(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    x = (h ^ (np.asarray(seed, np.uint64) * M1)) * M2
    x ^= x >> np.uint64(29)
    x *= M1
    return x ^ (x >> np.uint64(32))


def build_perfect(h: np.ndarray, per_bucket: int = 4) -> np.ndarray:
    """Seeds of a minimal perfect hash of distinct 64-bit values: hash and displace, the largest buckets first.
    All buckets of a size try the same seed together; the first of each set of rivals for a slot wins."""
    n = len(h)
    buckets = max(1, -(-n // per_bucket))
    of = (mix(h, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    seeds, taken = np.zeros(buckets, np.uint32), np.zeros(n, bool)
    for size in range(int(sizes.max(initial=0)), 0, -1):
        todo = np.flatnonzero(sizes == size)
        members = h[order[first[todo][:, None] + np.arange(size)]]
        seed = 0
        while len(todo):
            seed += 1
            slots = np.sort((mix(members, seed) % np.uint64(n)).astype(np.int64), 1)
            good = ~taken[slots].any(1) & ((np.diff(slots, axis=1) > 0).all(1) if size > 1 else True)
            rows = np.flatnonzero(good)
            if len(rows):
                flat, owner = slots[rows].ravel(), np.repeat(np.arange(len(rows)), size)
                winner = np.full(n, -1, np.int64) if len(rows) > 1 else None
                if winner is not None:
                    winner[flat[::-1]] = owner[::-1]  # the first bucket to name a slot holds it
                    rows = rows[(winner[slots[rows]] == np.arange(len(rows))[:, None]).all(1)]
                taken[slots[rows].ravel()] = True
                seeds[todo[rows]] = seed
                keep = np.ones(len(todo), bool)
                keep[rows] = False
                todo, members = todo[keep], members[keep]
            if len(todo) and size == 1 and seed > 64:  # the last slots are dealt out directly: seeds above 2**31
                seeds[todo] = np.flatnonzero(~taken)[: len(todo)].astype(np.uint32) | np.uint32(1 << 31)
                taken[:] = True
                break
    return seeds


def slot(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The index of each value; a value outside the set gets any index."""
    s = seeds[(mix(h, 0) % np.uint64(len(seeds))).astype(np.int64)]
    direct = s >= np.uint32(1 << 31)
    hashed = (mix(h, s.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    return np.where(direct, (s & np.uint32((1 << 31) - 1)).astype(np.int64) % n, hashed)


def write_shards(counted: DataFrame, path: str, shards: int) -> dict[int, str]:
    """A file for each shard under `path`: sizes and salt, then fingerprints, largest doc_ids, counts and seeds."""

    def build(table):
        h1 = np.asarray(table.column("h1")).astype(np.int64).view(np.uint64)
        h2 = np.asarray(table.column("h2")).astype(np.int64).view(np.uint64)
        salt = 1
        while len(np.unique(h := mix(h1, salt) ^ h2)) < len(h):  # 128 bits folded to 64: another salt parts equals
            salt += 1
        seeds = build_perfect(h)
        at = slot(h, seeds, len(h))
        marks, n_docs, last = np.empty(len(h), "<u8"), np.empty(len(h), "<u4"), np.empty(len(h), "<i8")
        marks[at] = h2
        n_docs[at] = np.minimum(np.asarray(table.column("n")), 0xFFFFFFFF)
        last[at] = np.asarray(table.column("last"))
        shard = table.column("shard")[0].as_py()
        fs, base = shared.open_fs(path)
        fs.create_dir(base, recursive=True)
        name = f"{shard}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{base}/{name}") as f:
            f.write(np.array([len(h), len(seeds), salt], "<u8").tobytes())
            f.write(marks.tobytes() + last.tobytes() + n_docs.tobytes() + seeds.astype("<u4").tobytes())
        return pa.table({"shard": pa.array([shard], pa.int32()), "name": [name]})

    named = counted.groupBy("shard").applyInArrow(build, "shard int, name string")
    return {r["shard"]: r["name"] for r in shared.stored(named, "shards").collect()}  # a row for each shard


def load_shard(path: str, name: str) -> tuple:
    fs, base = shared.open_fs(path)
    if fs.type_name == "local":
        raw = np.memmap(f"{base}/{name}", np.uint8, "r")
    else:
        with fs.open_input_file(f"{base}/{name}") as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n, m, salt = (int(x) for x in raw[:24].view("<u8"))
    cuts = np.cumsum([24, 8 * n, 8 * n, 4 * n, 4 * m])
    return salt, *(raw[a:z].view(k) for a, z, k in zip(cuts, cuts[1:], ("<u8", "<i8", "<u4", "<u4")))


def dedup_lines(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, mark: bool = False) -> DataFrame:
    """Drop repeated lines from documents (doc_id, text, any other columns).

    Returns the same columns with the shorter text, a null text staying null and n_chars, where it is there, counted
    anew; with `mark` instead doc_id, n_lines, n_dropped, text and kept_sha256."""
    spark = docs.sparkSession
    hashes = line_hashes(docs, least_chars)
    twice = shared.stored(docs.groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if not twice.isEmpty():  # the lines of repeated rows are made distinct; those of all others already are
        hashes = hashes.join(twice, "doc_id", "left_anti").unionByName(hashes.join(twice, "doc_id", "left_semi").distinct())
    counted = shared.stored(hashes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")), "lines")
    shards = max(1, -(-counted.count() // PER_SHARD))
    path = shared.scratch(spark, "perfect")
    names = write_shards(counted.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")), path, shards)
    held: dict[str, tuple] = {}

    def arrays(shard):
        name = names[shard]
        if name not in held:
            mapped = shared.open_fs(path)[0].type_name == "local"
            if len(held) >= (OPEN_MAPPED if mapped else OPEN_READ):
                held.pop(next(iter(held)))
            held[name] = load_shard(path, name)
        return held[name]

    def drops(ids: list[int], texts: list[str | None]) -> list[tuple[list[str], list[str]]]:
        """Of each text, all lines and those that stay."""
        where, h1, h2, owner = [], [], [], []
        for i, text in enumerate(texts):
            for k, key in enumerate(long_keys(text, least_chars)):
                if key is not None:
                    a, z = halves(key)
                    where.append((i, k))
                    h1.append(a)
                    h2.append(z)
                    owner.append(ids[i])
        gone: dict[int, set[int]] = {}
        if where and names:
            a, z, own = np.array(h1, np.int64), np.array(h2, np.int64).view(np.uint64), np.array(owner, np.int64)
            shard = a % shards
            hit = np.zeros(len(a), bool)
            for s in np.unique(shard):
                if int(s) in names:
                    salt, marks, last, n_docs, seeds = arrays(int(s))
                    at = np.flatnonzero(shard == s)
                    i = slot(mix(a[at].view(np.uint64), salt) ^ z[at], seeds, len(marks))
                    hit[at] = (marks[i] == z[at]) & (n_docs[i] >= least_docs) & (last[i] != own[at])
            for j in np.flatnonzero(hit):
                i, k = where[j]
                gone.setdefault(i, set()).add(k)
        out = []
        for i, text in enumerate(texts):
            lines = (text or "").split("\n")
            g = gone.get(i)
            out.append((lines, [x for k, x in enumerate(lines) if k not in g] if g else lines))
        return out

    def ids_of(b):
        return b.column(b.schema.get_field_index("doc_id")).fill_null(NULL_ID).to_pylist()

    if mark:

        def run(batches):
            for b in batches:
                found = drops(ids_of(b), b.column("text").to_pylist())
                texts = ["\n".join(kept) for _, kept in found]
                yield {
                    "doc_id": b.column("doc_id"),
                    "n_lines": [len(x) for x, _ in found],
                    "n_dropped": [len(x) - len(y) for x, y in found],
                    "text": texts,
                    "kept_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
                }

        return shared.map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_lines long, n_dropped long, text string, kept_sha256 string")

    def rewrite(batches):
        for b in shared.small_batches(batches):
            i = b.schema.get_field_index("text")
            texts = b.column(i).to_pylist()
            new = [t if t is None else "\n".join(kept) for t, (_, kept) in zip(texts, drops(ids_of(b), texts))]
            b = b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))
            if (c := b.schema.get_field_index("n_chars")) >= 0:
                was = b.column(c).to_pylist()
                b = b.set_column(c, b.schema.field(c), pa.array([w if w is None or t is None else len(t) for w, t in zip(was, new)], b.schema.field(c).type))
            yield b

    return docs.mapInArrow(rewrite, docs.schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(shared.table(spark, sf_dir, "documents"), mark=True).drop("text")


OP5_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.i, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                       unnest(range(len(string_split(coalesce(d.text, ''), chr(10))))) AS i) u
), held AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE h.key IS NOT NULL AND h.last <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i)
              FILTER (WHERE h.key IS NULL OR h.last = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN held h ON h.key = l.key
GROUP BY l.doc_id
"""
