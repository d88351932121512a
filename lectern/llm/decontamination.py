"""Operator 10: benchmark decontamination by Wu-Manber search over words.

The patterns are the benchmark's windows of 13 consecutive words; an item with fewer words is one window. Patterns of
one length form a set. For a set with windows of m words, the block shift table holds for each pair of adjacent words
how far it stands from the end of any window; a pair that is in none lets the search skip m - 1 words. Where the
shift is zero, the bucket of the last pair's windows is searched by a hash of all their words, and what is found there
is compared word by word with the window. So most words of a clean document are never looked at. Tables hold 64-bit word
hashes, and lanes of many documents move through the table together.

The benchmark is dealt to as many tasks as it has blocks of bounded size. Each builds the tables of its block and writes
them as flat arrays to the shared folder; nothing of the benchmark passes through the driver but file names. A task that
searches maps the tables of one block after another, in time that does not depend on how often it does so, and puts a
batch of documents through each: time grows with blocks times text, memory with neither.

Results in special cases. Null, empty and wordless documents have no words, no hits and are clean; their items_sha256
is that of the empty string. Items with no words, or null, have no window. Equal windows of several items count for
each item, rows that repeat an item count once. Items with a null id hit, but are not listed or counted. An empty
benchmark leaves every document clean, an empty documents table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import shared

WINDOW = 13
#: Words of benchmark text in a block. Its tables take some 60 bytes a word, of which a search touches what it needs.
BLOCK_WORDS = 1_000_000
#: End positions that a lane of the search goes through, word hashes kept, blocks kept open, bytes of text in a batch.
LANE, KEEP_WORDS, OPEN_BLOCKS, BATCH = 512, 200_000, 64, 4 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(shared.WORD_TABLE).split()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def hashes_of(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > KEEP_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), "<u8", len(words))


def pair_slots(before: np.ndarray, last: np.ndarray, bits: int) -> np.ndarray:
    """Slot of a pair of adjacent words in tables of 2 ** bits entries."""
    x = (before * _P) ^ (last * _Q)
    return ((x ^ (x >> np.uint64(31))) * _P >> np.uint64(64 - bits)).astype(np.int64)


def window_keys(h: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """40-bit hashes of the m words from each start."""
    x = np.zeros(len(starts), "<u8")
    for i in range(m):
        x = (x ^ (x >> np.uint64(29))) * _P + h[starts + i]
    return (x ^ (x >> np.uint64(32))) * _Q >> np.uint64(24)


def build_block(items: list[tuple], window: int) -> dict[str, np.ndarray]:
    """The tables of some items (id as text or None, words), for each length m of windows: `shift`, the smallest shift of
    each slot of pairs; `keys`, sorted, the slot of a window's last pair above the hash of its words; `at` and `item`,
    where the window begins among the `words` of the block, and whose it is."""
    words = [w for _, ws in items for w in ws]
    h = hashes_of(words)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype="<i8") if words else np.zeros(0, "<i8")
    names = ["" if i is None else i for i, _ in items]
    out = {
        "text": np.frombuffer(text or b" ", np.uint8),
        "begin": np.append(0, ends).astype("<i8"),
        "names": np.frombuffer("".join(names).encode() or b" ", np.uint8),
        "name_end": np.cumsum([len(n.encode()) for n in names], dtype="<i8"),
        "named": np.array([i is not None for i, _ in items], np.uint8),
    }
    first = np.cumsum([0, *(len(ws) for _, ws in items)])
    size = np.array([len(ws) for _, ws in items], np.int64)
    for m in np.unique(np.minimum(size, window)).tolist():
        mine = np.flatnonzero(np.minimum(size, window) == m)
        n = size[mine] - m + 1
        item = np.repeat(mine, n)
        at = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        bits = max(8, int(np.ceil(np.log2(4 * size[mine].sum() + 1))))
        shift = np.full(1 << bits, max(1, m - 1), np.uint8)
        if m > 1:
            inner = np.repeat(first[mine] - np.cumsum(size[mine] - 1) + size[mine] - 1, size[mine] - 1) + np.arange((size[mine] - 1).sum()) + 1
            place = inner - np.repeat(first[mine], size[mine] - 1)  # of the pair's second word in its item
            np.minimum.at(shift, pair_slots(h[inner - 1], h[inner], bits), np.maximum(0, m - 1 - place).astype(np.uint8))
            slots = pair_slots(h[at + m - 2], h[at + m - 1], bits)
        else:
            slots = pair_slots(h[at], h[at], bits)
            shift[slots] = 0
        keys = (slots.astype("<u8") << np.uint64(40)) | window_keys(h, at, m)
        order = np.lexsort((at, item, keys))
        out |= {f"shift{m}": shift, f"keys{m}": keys[order], f"at{m}": at[order].astype("<i8"), f"item{m}": item[order].astype("<i4")}
    return out


class Block:
    """The tables of one block, mapped."""

    def __init__(self, uri: str):
        self.a = shared.read_arrays(uri)
        self.lengths = sorted(int(k[5:]) for k in self.a if k.startswith("shift"))

    def name(self, item: int) -> str | None:
        if not self.a["named"][item]:
            return None
        z = int(self.a["name_end"][item])
        return self.a["names"][int(self.a["name_end"][item - 1]) if item else 0 : z].tobytes().decode()

    def window(self, at: int, m: int) -> bytes:
        return self.a["text"][int(self.a["begin"][at]) : int(self.a["begin"][at + m]) - 1].tobytes()

    def candidates(self, h: np.ndarray, first: np.ndarray, size: np.ndarray, m: int) -> np.ndarray:
        """Ends of words runs that may be windows. h: hashes of all documents' words; first, size: of each document."""
        shift = self.a[f"shift{m}"]
        bits = len(shift).bit_length() - 1
        long = size >= m
        lo, hi = first[long] + m - 1, first[long] + size[long]  # ends to look at
        lanes = -(-(hi - lo) // LANE)
        at = np.repeat(lo - LANE * (np.cumsum(lanes) - lanes), lanes) + LANE * np.arange(lanes.sum())
        stop = np.minimum(at + LANE, np.repeat(hi, lanes))
        back = 0 if m == 1 else 1
        found = []
        while len(at):
            step = shift[pair_slots(h[at - back], h[at], bits)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def occurrences(self, h: np.ndarray, words: list[bytes], first: np.ndarray, size: np.ndarray, m: int):
        """(start, m, items) of every occurrence."""
        ends = self.candidates(h, first, size, m)
        if not len(ends):
            return
        keys, bits = self.a[f"keys{m}"], len(self.a[f"shift{m}"]).bit_length() - 1
        starts = ends - m + 1
        want = (pair_slots(h[ends - (m > 1)], h[ends], bits).astype("<u8") << np.uint64(40)) | window_keys(h, starts, m)
        low, high = np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right")
        at, item = self.a[f"at{m}"], self.a[f"item{m}"]
        for k in np.flatnonzero(high > low).tolist():
            start = int(starts[k])
            text = b" ".join(words[start : start + m])
            found, last = [], -1
            for j in range(int(low[k]), int(high[k])):
                if int(item[j]) != last and self.window(int(at[j]), m) == text:
                    last = int(item[j])
                    found.append(last)
            if found:
                yield start, m, found


def write_blocks(benchmark: DataFrame, block_words: int, window: int = WINDOW) -> list[str]:
    """Files of tables, built by tasks, for rows (item_id, text). The driver sees a number and the names."""
    root = shared.scratch(benchmark.sparkSession, "benchmark")
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))  # of words with six bytes

    def build(batches):
        block, n = [], 0

        def flush():
            uri = f"{root}/{uuid.uuid4().hex}"
            shared.write_arrays(uri, build_block(block, window))
            block.clear()
            return pa.record_batch([pa.array([uri])], names=["uri"])

        for b in batches:
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                if words := words_of(t):
                    block.append((i, words))
                    n += len(words)
                if n >= block_words:
                    yield flush()
                    n = 0
        if block:
            yield flush()

    return sorted(r["uri"] for r in rows.repartition(blocks).mapInArrow(build, "uri string").collect())


_open: dict[str, Block] = {}


def open_block(uri: str) -> Block:
    if uri not in _open:
        if len(_open) >= OPEN_BLOCKS:
            _open.pop(next(iter(_open)))
        _open[uri] = Block(uri)
    return _open[uri]


def search(texts: list[str | None], files: list[str]) -> list[tuple[int, int, list]]:
    """For each text its number of words, of hit words, and the items that occur."""
    split = [words_of(t) for t in texts]
    size = np.array([len(w) for w in split], np.int64)
    first = np.cumsum(size) - size
    words = [w for ws in split for w in ws]
    h = hashes_of(words)
    edges = np.zeros(len(words) + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    for file in files:
        block = open_block(file)
        for m in block.lengths:
            for start, width, found in block.occurrences(h, words, first, size, m):
                edges[start] += 1
                edges[start + width] -= 1
                items[int(np.searchsorted(first + size, start, "right"))].update(block.name(i) for i in found)
    hit = np.append(0, np.cumsum(np.cumsum(edges[:-1]) > 0))
    n_hit = hit[first + size] - hit[first]
    return [(n, k, sorted(i for i in item if i is not None)) for n, k, item in zip(size.tolist(), n_hit.tolist(), items)]


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated for documents (doc_id, text)."""
    files = write_blocks(benchmark, block_words, window)

    def run(batches):
        for b in batches:
            found = search(b.column("text").to_pylist(), files)
            yield {
                "doc_id": b.column("doc_id"),
                "n_words": [n for n, _, _ in found],
                "n_hit": [h for _, h, _ in found],
                "n_items": [len(i) for _, _, i in found],
                "items": [i for _, _, i in found],
                "contaminated": [is_contaminated(n, h) for n, h, _ in found],
            }

    return shared.map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean", limit=BATCH)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, all columns as they were."""
    files = write_blocks(benchmark, block_words, window)

    def run(batches):
        for b in shared.small_batches(batches, limit=BATCH):
            found = search(b.column("text").to_pylist(), files)
            yield b.filter(pa.array([not is_contaminated(n, h) for n, h, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS pat
  FROM b, LATERAL (SELECT unnest(range(greatest(len(w) - 12, 1))) AS s) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT m FROM win),
spots AS (
  SELECT doc_id, m, s, array_to_string(w[s + 1 : s + m], ' ') AS pat
  FROM d, sizes, LATERAL (SELECT unnest(range(len(w) - m + 1)) AS s) WHERE len(w) >= m
), occ AS (SELECT doc_id, s, spots.m, item_id FROM spots JOIN win USING (m, pat)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
