"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins; it ends when a round changes nothing. Rounds are written to the shared
folder, so lineage stays short, and so are the minima: both sides of a join then come plainly from an exchange, which
lets Spark split the root of a large component. What a round wrote goes when the next has been written. Links stay in
Spark; the driver sees one count and one checksum for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node in links (a, b); root is the smallest node that can be reached."""
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    at = shared.scratch(spark, "links")
    edges = shared.stored(edges, "links", at)
    seen = _sum(edges)
    while seen[0]:
        before, at = at, shared.scratch(spark, "links")
        with shared.discarded(spark):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = shared.stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
            large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            large = shared.stored(large, "large")
            low = shared.stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
            small = large.join(low, "a")
            edges = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
            edges = shared.stored(edges, "links", at)
        shared.remove(spark, before)
        now = _sum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
