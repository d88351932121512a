"""Near copies by word shingles, beyond the reach of operator 7's two bits: documents whose sets of word shingles have
a Jaccard similarity of a given fraction or more are linked.

Equal sets are one class. Candidates come from two sides. The first is operator 7's method: the 64-bit SimHash of the
set, deletion variants of its halves, an equality join. At a similarity of 0.8 some ten bits of a SimHash differ, more
than any cut into selective segments can bridge, so the second side are `BANDS` keys of `ROWS` minimum hashes each: two
sets of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, which is 0.99999 at 0.8. Each class of a key
is a candidate with one class of that key, chosen by a hash anew for each key: rows stay in proportion to the classes,
and a group of thousands of near copies never becomes its pairs. Every candidate is verified on the whole sets.

What these miss, by chance or since the chosen class of a key is unlike the others, an exact way finds. Shingles have
one order, rare ones first, and a set's prefix is its first shingles in that order: of sets of n and m >= n shingles
that are alike, the first shingle in common is among the first n - ceil(2sn / (1 + s)) + 1 of the smaller one and the
first m - ceil(sm) + 1 of the larger. Only sets that the verified links leave in different components are compared, so a
group of near copies does not become its pairs here either; sizes and places in the prefix rule out most of the rest.
The order may be any, for the result; counts of a bounded sample of the sets give one that keeps common passages out of
the prefixes.

The sets of candidates are written as flat files in the shared folder, which the verifying tasks map.

Null, empty and blank texts are one class, as for operator 7; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm import shared
from lectern.llm.components import components

BANDS, ROWS = 40, 6
#: Shingles put through the minimum hashes at a time, words whose hashes are kept, files kept open.
BLOCK, KEEP_WORDS, OPEN_FILES = 1024, 200_000, 256
#: Sets that are counted to order the shingles; the links do not depend on it.
COUNTED = 20_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_TURNS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    w = (text or "").encode().lower().split()  # ASCII case and white space only
    if not w:
        return np.zeros(0, "<u8")
    if len(_words) > KEEP_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, w), "<u8", len(w))
    size = min(words, len(w))
    n = len(w) - size + 1
    x = np.full(n, size, "<u8")
    for i in range(size):
        x = (x ^ (x >> np.uint64(32))) * _M1 + h[i : i + n]
    x = np.sort(mixed(x))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def signature(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set, 0 for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype("<i8")) if len(s) else 0


def majority(s: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set: the bits set in over half of its hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 14):
        votes += np.unpackbits(s[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(s), bitorder="little").view("<i8")[0])


def bands(s: np.ndarray) -> np.ndarray:
    """The keys of a set, none for the empty one."""
    if not len(s):
        return np.zeros(0, "<i8")
    low = np.full(len(_TURNS), np.iinfo(np.uint64).max)
    for at in range(0, len(s), BLOCK):
        np.minimum(low, (s[at : at + BLOCK, None] * _TURNS).min(0), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = mixed(key) + column
    return mixed(key).view("<i8")


def keyed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp, bits, keys for documents (doc_id, text): fp tells sets apart, bits is their SimHash."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            yield {"doc_id": b.column("doc_id"), "fp": [signature(s) for s in sets], "bits": [majority(s) for s in sets], "keys": [bands(s) for s in sets]}

    return shared.map_texts(docs.select("doc_id", "text"), run, "doc_id long, fp long, bits long, keys array<long>")


def written(docs: DataFrame, words: int) -> DataFrame:
    """fp, file, at, n: where the sets of documents (doc_id, text) stand in flat files of the shared folder."""
    root = shared.scratch(docs.sparkSession, "shingles")

    def run(batches):
        fs, base = shared.open_fs(root)
        fs.create_dir(base, recursive=True)
        name, end, out = uuid.uuid4().hex, 0, None
        for b in batches:
            out = out or fs.open_output_stream(f"{base}/{name}")
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            at = [end + 8 * k for k in np.cumsum([0, *map(len, sets)]).tolist()]
            end = at.pop()
            out.write(b"".join(s.tobytes() for s in sets))
            yield {"fp": [signature(s) for s in sets], "file": [f"{root}/{name}"] * len(sets), "at": at, "n": [len(s) for s in sets]}
        if out:
            out.close()

    return shared.stored(shared.map_texts(docs.select("text"), run, "fp long, file string, at long, n long"), "sets").dropDuplicates(["fp"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def candidates(classes: DataFrame, near_bits) -> DataFrame:
    """(a, b), a < b: pairs of classes fp, of classes (fp, bits, keys), that may be alike."""
    first = shared.stored(classes.groupBy("bits").agg(F.min("fp").alias("first"), F.count("*").alias("n")), "bits")
    same = classes.select("bits", "fp").join(first.where("n > 1").drop("n").hint("merge"), "bits").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = near_bits(first.select(F.col("bits").alias("fp")))
    left, right = first.select(F.col("bits").alias("a"), F.col("first").alias("fa")), first.select(F.col("bits").alias("b"), F.col("first").alias("fb"))
    near = near.join(left, "a").join(right, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    rows = classes.select("fp", F.explode("keys").alias("key"))
    # fp ^ key orders a key's classes by chance, and gives the class back
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("fp").bitwiseXOR(F.col("key"))).alias("low"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    counts = shared.stored(counts.where("n > 1"), "keys")
    more = counts.where("n > 2").select("key", F.col("low").bitwiseXOR(F.col("key")).alias("a"))
    star = rows.join(more.hint("merge"), "key").select("a", F.col("fp").alias("b"))  # at every size: growth stays plain
    pairs = same.unionByName(near).unionByName(counts.where("n = 2").select("a", "b")).unionByName(star)
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def counted(docs: DataFrame, classes: DataFrame, words: int) -> str | None:
    """The file of the shingles found twice or more in some COUNTED of the classes, sorted, and their counts."""
    some = classes.select("doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, classes.count()))) < COUNTED).distinct()
    path = f"{shared.scratch(docs.sparkSession, 'counted')}/shingles"

    def run(batches):
        for b in batches:
            yield {"shingle": np.concatenate([shingle_set(t, words) for t in b.column("text").to_pylist()]).view("<i8")}

    def write(batches):
        found = [(b.column("shingle").to_numpy().view("<u8"), b.column("n").to_numpy()) for b in batches]
        if found:
            shingle, n = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(shingle)
            shared.write_arrays(path, {"shingle": shingle[order], "n": n[order]})
            yield pa.record_batch([pa.array([len(n)], pa.int64())], names=["n"])

    texts = docs.join(F.broadcast(some), "doc_id", "left_semi").select("text")
    often = shared.map_texts(texts, run, "shingle long").repartition("shingle").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    return path if often.repartition(1).mapInArrow(write, "n long").collect() else None


def prefixes(docs: DataFrame, words: int, alike: tuple[int, int], order: str | None) -> DataFrame:
    """doc_id, fp, n, prefix for documents (doc_id, text): the set's size and its first shingles, rare ones first."""

    def run(batches):
        often = shared.read_arrays(order) if order else {"shingle": np.zeros(1, "<u8"), "n": np.zeros(1, "<i8")}

        def first(s: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(often["shingle"], s), len(often["shingle"]) - 1)
            n = np.where(often["shingle"][at] == s, often["n"][at], 0)
            return s[np.argsort(n, kind="stable")[: len(s) + 1 + -alike[0] * len(s) // alike[1]]].view("<i8")

        for b in batches:
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            yield {"doc_id": b.column("doc_id"), "fp": [signature(s) for s in sets], "n": [len(s) for s in sets], "prefix": [first(s) for s in sets]}

    return shared.map_texts(docs.select("doc_id", "text"), run, "doc_id long, fp long, n long, prefix array<long>")


def missed(docs: DataFrame, classes: DataFrame, roots: DataFrame, words: int, alike: tuple[int, int]) -> DataFrame:
    """(a, b): all pairs of classes in different components, by roots (node, root), that may be alike."""
    p, q = alike
    members = classes.select("doc_id", "fp").join(roots, classes["fp"] == roots["node"], "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))
    found = prefixes(docs, words, alike, counted(docs, classes, words)).join(members.hint("merge"), ["doc_id", "fp"])
    rows = shared.stored(found.drop("doc_id"), "prefixes").select("fp", "root", "n", F.posexplode("prefix").alias("at", "shingle"))
    # one exchange and small sorts: grouping before it would hold all of a task's shingles, nearly all of them different
    same = W.partitionBy("shingle")
    met = shared.stored(rows.withColumns({"low": F.min("root").over(same), "high": F.max("root").over(same)}).where("low <> high").drop("low", "high"), "met")
    small = met.where(f"at <= n - (2 * {p} * n + {p + q - 1}) div {p + q}").select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("fp", "root", "n", "at")])
    large = met.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("fp", "root", "n", "at")])
    may = f"(n_a < n_b OR n_a = n_b AND fp_a < fp_b) AND n_a * {q} >= n_b * {p} AND least(n_a - at_a, n_b - at_b) * {p + q} >= {p} * (n_a + n_b)"
    return small.join(large.hint("merge"), "shingle").where("root_a <> root_b").where(may).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def links(docs: DataFrame, found: DataFrame, words: int, alike: tuple[int, int], near_bits) -> DataFrame:
    """(a, b): links among the classes fp of keyed() that are alike, such that those connect which all links of alike
    classes connect. near_bits gives pairs of near fingerprints."""
    numbered = found.where("doc_id IS NOT NULL")
    reps = numbered.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    classes = shared.stored(found.join(reps, ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id", "fp"]), "shingled")
    roots = shared.stored(components(verified(docs, classes, shared.stored(candidates(classes, near_bits), "pairs"), words, alike)), "roots")
    linked = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    pairs = shared.stored(missed(docs, classes, roots, words, alike), "missed")
    return linked if pairs.isEmpty() else linked.unionByName(verified(docs, classes, pairs, words, alike))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, alike: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) of classes whose whole sets are alike."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = classes.join(ends, "fp", "left_semi").select("doc_id").distinct()
    places = shared.stored(written(docs.join(wanted, "doc_id", "left_semi"), words), "places")
    for end in "ab":
        one = places.select(F.col("fp").alias(end), F.struct("file", "at", "n").alias(f"set_{end}"))
        pairs = pairs.join(one.hint("merge"), end)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        opened: dict = {}

        def read(place: dict) -> np.ndarray:
            if place["file"] not in opened:
                if len(opened) >= OPEN_FILES:
                    opened.clear()
                fs, path = shared.open_fs(place["file"])
                opened[place["file"]] = np.memmap(path, "<u8", "r") if fs.type_name == "local" else fs.open_input_file(path)
            f, at, n = opened[place["file"]], place["at"], place["n"]
            return np.asarray(f[at // 8 : at // 8 + n]) if isinstance(f, np.memmap) else np.frombuffer(f.read_at(8 * n, at), "<u8")

        for b in batches:
            a, z = b.column("set_a").to_pylist(), b.column("set_b").to_pylist()
            good = []
            for x, y in zip(a, z):
                n = x["n"] + y["n"]
                ok = min(x["n"], y["n"]) * alike[1] >= max(x["n"], y["n"]) * alike[0]  # else the sizes alone tell
                both = common(read(x), read(y)) if ok and x["n"] and y["n"] else 0
                good.append(both > 0 and both * alike[1] >= alike[0] * (n - both))
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return shared.stored(pairs.repartition(tasks).mapInArrow(run, "a long, b long"), "alike")
