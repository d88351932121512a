"""Operator 7: SimHash near-dedup with deletion-variant signatures.

Equal fingerprints are one class, so copies cost one row from then on. Two fingerprints that differ in at most two
bits, cut into two halves, have a half that differs in at most one bit. Each fingerprint therefore gives, for both
halves and each of the 32 bits, the half with that bit deleted; linked classes meet in at least one such key. A key
with two classes is a candidate by its smallest and largest member; keys with up to `crowd` classes go through an
equality join; every candidate is verified by its differing bits.

Classes of more crowded keys take an exact way without pairs: each gives the 65 values within one bit of it. Two
fingerprints are at most two bits apart exactly if they share such a value, and no value has more than 65 classes.

Results in special cases. Null, empty and blank texts have fingerprint zero and link like any other. A row with a
null doc_id takes the component of its fingerprint, null if no numbered document has it, and links nothing itself.
Rows with equal doc_id and different texts join their classes. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import shared, shingles
from lectern.llm.components import components

WORDS, BITS_APART, CROWD = 3, 2, 64


def simhash(text: str | None, words: int = WORDS) -> int:
    """Signed 64-bit fingerprint of the word shingles; repeats count."""
    w = (text or "").encode().lower().split()  # ASCII case and white space only
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))), "<u8", max(1, len(w) - words + 1))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        votes += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    def run(batches):
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "fp": [simhash(t, words) for t in b.column("text").to_pylist()]}

    return shared.map_texts(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def links(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): fingerprints of classes (fp), all different, that are at most two bits apart. a < b is not promised."""
    near = f"bit_count(a ^ b) <= {BITS_APART}"
    half = "shiftrightunsigned(fp, 32 * (i div 32)) & 4294967295L"
    # each row becomes 64, so the few bytes of the classes are dealt to all tasks; a number keeps them apart
    spread = classes.select("fp").repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = spread.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(
        F.expr(f"shiftleft(cast(i as bigint), 32) | (({half}) & ~shiftleft(1L, i % 32))").alias("key"), "fp"
    )
    keys = variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    keys = shared.stored(keys.where("n > 1"), "keys")
    out = keys.where("n = 2").where(near).select("a", "b")
    if not keys.where("n > 2").isEmpty():
        # a sort-merge join at every size: the few keys are soon too many to broadcast, and growth is then as measured
        members = shared.stored(variants.join(keys.where("n > 2").select("key", "n").hint("merge"), "key"), "members")
        some = members.where(F.col("n") <= crowd)
        left, right = some.select("key", F.col("fp").alias("a")), some.select("key", F.col("fp").alias("b"))
        out = out.unionByName(left.join(right, "key").where(f"a < b AND {near}").select("a", "b"))
        crowded = members.where(F.col("n") > crowd).select("fp").distinct()
        around = crowded.select("fp", F.explode(F.expr("transform(sequence(0, 64), i -> CASE WHEN i = 64 THEN fp ELSE fp ^ shiftleft(1L, i) END)")).alias("value"))
        met = around.groupBy("value").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("bs")).where(F.size("bs") > 1)  # 65 at most
        out = out.unionByName(met.select("a", F.explode("bs").alias("b")).where("a <> b"))
    return out


def grouped(docs: DataFrame, words: int = WORDS, alike: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, fp, component_id for documents (doc_id, text). With alike, a fraction such as (4, 5), documents link by
    the Jaccard similarity of their sets of word shingles instead, fp tells the sets apart, and near fingerprints are
    candidates that the sets verify; see shingles.py for what else is."""
    found = shared.stored(shingles.keyed(docs, words) if alike else fingerprints(docs, words), "fingerprints")
    numbered = found.where(F.col("doc_id").isNotNull())
    classes = shared.stored(numbered.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    edges = shingles.links(docs, found, words, alike, links) if alike else links(classes)
    twice = numbered.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    if not twice.isEmpty():  # rows with equal doc_id and different texts
        edges = edges.unionByName(numbered.join(twice.select("doc_id", "a"), "doc_id").where("fp <> a").select("a", F.col("fp").alias("b")))
    roots = components(edges)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, words: int = WORDS, alike: tuple[int, int] | None = None) -> DataFrame:
    """Keep the document with the smallest doc_id of each group; all columns pass through.

    Rows with a null doc_id stay. Of repeated rows with one doc_id one stays, the first by text."""
    groups = shared.stored(grouped(docs, words, alike), "groups")
    gone = groups.where("doc_id IS NOT NULL AND component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    twice = groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice"))
    if twice.isEmpty():
        return kept
    once = kept.join(twice, kept["doc_id"] == twice["__twice"], "left_anti")
    again = kept.join(twice, kept["doc_id"] == twice["__twice"], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(docs.columns, key=lambda c: (c != "text", c))])
    return once.unionByName(again.groupBy("doc_id").agg(F.min(row).alias("__row")).select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
