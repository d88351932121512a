"""Filters, orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as an audio file.
AUDIO = ["mp3", "m4a", "m4b", "ogg", "opus", "flac", "wav", "aac", "wma"]
#: The ranks of voice qualities; an unknown one comes after all, a missing one is medium.
QUALITY_RANKS = {"high": 1, "medium": 2, "low": 3}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def audio_files(files: DataFrame, name: str = "name") -> DataFrame:
    """Audio files by lower-cased name."""
    return files.where(extension(F.col(name)).isin(AUDIO)).orderBy(F.lower(name), name)


def needs_transcoding(name: Column, playable: list[str]) -> Column:
    return extension(name).isin(AUDIO) & ~extension(name).isin(playable)


def audio_devices(devices: DataFrame) -> DataFrame:
    """Devices with an audio icon, or paired, or named: connected first, then paired, then by name."""
    ok = F.col("icon").startswith("audio-") | F.coalesce("paired", F.lit(False)) | (F.coalesce("name", F.lit("")) != "")
    return devices.where(F.coalesce(ok, F.lit(False))).orderBy(F.desc("connected"), F.desc("paired"), F.lower("name"), "mac")


def quality_rank(quality: Column) -> Column:
    """1 for the best; NULL counts as medium, unknown ones share the last rank."""
    known = F.coalesce(quality, F.lit("medium"))
    return F.coalesce(*[F.when(known == q, i) for q, i in QUALITY_RANKS.items()], F.lit(len(QUALITY_RANKS) + 1))


def by_quality(voices: DataFrame) -> DataFrame:
    """Voices by quality, best first, then by name."""
    return voices.orderBy(quality_rank(F.col("quality")), "name")


def usable_voices(voices: DataFrame) -> DataFrame:
    """Voices that are installed or bundled; a missing flag is false."""
    return voices.where(F.coalesce("installed", F.lit(False)) | F.coalesce("bundled", F.lit(False)))


def pages_wanted(rows: DataFrame, wanted: list[int] | None, page: str = "page") -> DataFrame:
    """Rows of the wanted pages; all without a choice."""
    return rows if not wanted else rows.where(F.col(page).isin(list(wanted)))


def to_transcode(files: DataFrame, cached: DataFrame, playable: list[str], name: str = "name") -> DataFrame:
    """Audio files that cannot be played as they are and have no transcoded copy in the cache's listing (same column)."""
    need = files.where(needs_transcoding(F.col(name), playable))
    return need.join(cached.select(name).distinct(), name, "left_anti")


def worth_resuming(rows: DataFrame, position: str, least_s: float = 10.0) -> DataFrame:
    """Rows whose saved position lies beyond the first seconds."""
    return rows.where(F.col(position) > least_s)


def byte_length_between(rows: DataFrame, text: str, low: int, high: int) -> DataFrame:
    return rows.where(F.octet_length(text).between(low, high))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """Page `number` from 0, with whether there is another."""
    more = (number + 1) * size < rows.count()
    return rows.orderBy(*order).offset(number * size).limit(size).withColumn("has_next", F.lit(more))


def move_to_front(rows: DataFrame, first: Column, order: list[str]) -> DataFrame:
    return rows.orderBy(F.when(first, 0).otherwise(1), *order)


def take_queued(rows: DataFrame, n: int, order: list[str], status: str = "status") -> DataFrame:
    return rows.where(F.col(status) == "queued").orderBy(*order).limit(n)


def sorted_map(c: Column) -> Column:
    """A map with its keys in order, for JSON."""
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def numeric_order(rows: DataFrame, c: str) -> DataFrame:
    """Rows by a string of digits as a number."""
    return rows.orderBy(F.col(c).cast("long"), c)


def ordered_union(first: DataFrame, rest: DataFrame, key: str, rest_order: list[str]) -> DataFrame:
    """Rows of the first table in their order (seq), then those rows of the rest whose key is not in it."""
    from pyspark.sql import Window as W

    left = first.withColumn("__part", F.lit(0))
    right = rest.join(first.select(key), key, "left_anti").withColumn("seq", F.row_number().over(W.orderBy(*rest_order))).withColumn("__part", F.lit(1))
    return left.unionByName(right, allowMissingColumns=True).orderBy("__part", "seq").drop("__part")
