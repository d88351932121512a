"""Journals of progress and caches: latest rows, debounce, retention, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.operators.folds import ordered_fold


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; the order should be total. A partial maximum runs before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, *[F.col("__r").getField(c).alias(c) for c in rest])


def unsynced(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("synced", F.lit(False)))


def to_flush(journal: DataFrame, key: str = "item_id") -> DataFrame:
    """The last unsynced entry of each item: the last appended of those with the latest time."""
    return latest(unsynced(journal), [key], ["ts", "seq"])


def after_flush(journal: DataFrame, flushed: DataFrame, at: Column, key: str = "item_id") -> DataFrame:
    """All unsynced entries of the flushed items are marked synced."""
    done = flushed.select(key).distinct().withColumn("__done", F.lit(True))
    hit = F.col("__done") & ~F.coalesce("synced", F.lit(False))
    return journal.join(done, key, "left").withColumns({"synced_at": F.when(hit, at).otherwise(F.col("synced_at")), "synced": F.coalesce("synced", F.lit(False)) | F.coalesce("__done", F.lit(False))}).drop("__done")


def debounced(rows: DataFrame, key: str, order: list[str], position: str, least: float = 5.0) -> DataFrame:
    """Drop a row whose position is less than `least` from that of the last row kept; NULL counts as 0. The state is
    the last kept row, not the row before."""

    def step(last, row):
        now = row[position] or 0.0
        return (last, []) if last is not None and abs(last - now) < least else (now, [row])

    keep = rows.select(*dict.fromkeys([key, *order, position]))
    return ordered_fold(keep, key, order, keep.schema, lambda: None, step)


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n rows of each key that come first by order."""
    over = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(over)).where(F.col("__n") <= n).drop("__n")


def without_oldest(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """If there are more than `most` rows, all but the first by order: a map that drops one entry when it overflows."""
    if rows.count() <= most:
        return rows
    first = rows.orderBy(*order).select(*order).limit(1).first()
    same = F.lit(True)
    for c in order:
        same &= F.col(c).eqNullSafe(F.lit(first[c]))
    return rows.where(~same)


def evicted(items: DataFrame, size: str, age: str, tie: list[str], most: int, extra: str | None = None, buckets: int = 1024) -> DataFrame:
    """The oldest items that go until the cache has at most `most` bytes: those before which less than the excess has
    been freed. `extra` bytes count in the total and are not freed.

    Ages, numbers or times, fall into equal buckets; sums of buckets give each its base, so no task sees all rows."""
    number = F.col(age).cast("timestamp").cast("double") if dict(items.dtypes)[age].startswith("timestamp") else F.col(age).cast("double")
    lo, hi = items.agg(F.min(number), F.max(number)).first()
    bucket = F.floor((F.col("__n") - F.lit(lo or 0.0)) / F.lit((hi or 0.0) - (lo or 0.0) + 1e-9) * buckets)
    dealt = items.withColumn("__n", number).withColumn("__b", F.coalesce(bucket, F.lit(-1)))
    own = F.coalesce(size, F.lit(0)) if isinstance(size, str) else size
    sums = dealt.groupBy("__b").agg(F.sum(own).alias("__sum"), F.sum(own + (F.coalesce(extra, F.lit(0)) if extra else F.lit(0))).alias("__all"))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
    base = sums.select("__b", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"), F.sum("__all").over(W.partitionBy()).alias("__total"))
    inside = W.partitionBy("__b").orderBy("__n", *tie).rowsBetween(W.unboundedPreceding, -1)
    freed = dealt.withColumn("__in", F.coalesce(F.sum(own).over(inside), F.lit(0)))
    return freed.join(F.broadcast(base), "__b").where(F.col("__base") + F.col("__in") < F.col("__total") - most).select(*items.columns)


def cache_bytes(items: DataFrame, listing: DataFrame, key: str = "id") -> DataFrame:
    """Bytes of each item's files by a listing (path, bytes); missing files count 0. items: id, files array, cover_bytes."""
    f = items.select(key, F.explode_outer("files").alias("path")).join(listing, "path", "left")
    got = f.groupBy(key).agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("audio_bytes"))
    return items.join(got, key).withColumn("total_bytes", F.col("audio_bytes") + F.coalesce("cover_bytes", F.lit(0)))


def complete_items(items: DataFrame, listing: DataFrame, key: str = "id") -> DataFrame:
    """Items with files, all of which are listed."""
    f = items.select(key, F.explode("files").alias("path")).join(listing.select("path", F.lit(1).alias("__has")), "path", "left")
    ok = f.groupBy(key).agg(F.min(F.coalesce("__has", F.lit(0))).alias("__all")).where("__all = 1").select(key)
    return items.join(ok, key, "left_semi")


def stale(files: DataFrame, modified: str, now: Column, age: str) -> DataFrame:
    """Files last modified longer ago than an interval such as '7 days'."""
    return files.where(F.col(modified) < now - F.expr(f"INTERVAL {age}"))
