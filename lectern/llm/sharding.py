"""Operator 6: contiguous shards of near equal bytes, by DataFrame operations alone.

Documents are ordered by doc_id in range partitions. The partitions' byte totals, a row for each partition, give
prefix sums; a document's place in the whole corpus is its partition's base plus the running sum inside. The line of
all bytes is cut at equal targets, and a document goes to the shard that holds its middle byte. So shards are
contiguous and differ from the target by at most one document at each end. Equal texts stand where their doc_ids put
them: a group of copies may hold a third of all rows, and keeping it in one shard would break the balance.

Results in special cases. A null text has no bytes, size 16 and the crc32 of the empty string. A null doc_id sorts
first. Rows with equal doc_id are ordered by size and checksum; rows that agree in these are alike, so which of them
comes first does not matter. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm import shared

SHARDS, OVERHEAD = 40, 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for documents (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = shared.stored(sized.repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "sizes")
    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    everything = W.partitionBy()
    bases = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("part_bytes").over(everything).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    start = F.col("base_bytes") + F.col("upto") - F.col("size")
    placed = (
        dealt.withColumns({"upto": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)), "nth": F.row_number().over(inside)})
        .join(bases, "part")  # both sides are small in columns; the right has a row for each partition
        .withColumn("shard", F.expr(f"least({shards - 1}, ((2 * (base_bytes + upto - size) + size) * {shards}) div (2 * all_bytes))").cast("int"))
        .withColumn("row", F.col("base_rows") + F.col("nth") - 1)
        .withColumn("start", start)
        .select("doc_id", "size", "text_crc32", "shard", "row", "start")
    )
    placed = shared.stored(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "start"
    )


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(shared.table(spark, sf_dir, "documents"))


#: DuckDB has no crc32: its bytes are folded with the reflected polynomial 0xEDB88320, eight steps a byte.
OP6_SQL = """
WITH steps AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(256) t(i)
), lut AS (SELECT list(v ORDER BY i) AS v FROM steps),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c // 256, lut.v[(xor(c % 256, b) + 1)::INT])), 4294967295) AS text_crc32
  FROM documents, lut
), ordered AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total
  FROM sized
), cut AS (
  SELECT *, least(39, ((2 * start + size) * 40) // (2 * total)) AS shard FROM ordered
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, NULL::INT AS grown_shard, start::BIGINT AS start
FROM cut
"""
