"""Writers: alignment files, event logs, manifests, indexes, session updates."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number_text(x: Column) -> Column:
    """Three decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", "")


#: Fixed value: the name of the alignment file format.
ALIGNMENT_FORMAT = "audiobook-alignment-v1"


def alignment_json(sentences: DataFrame, granularity: str = "sentence") -> DataFrame:
    """(audio, body): one JSON document per audio file, keys in order, sentences by start."""
    s = F.struct("end_pos", F.round("end_time", 3).alias("end_time"), "start_pos", F.round("start_time", 3).alias("start_time"), "text")
    g = sentences.groupBy("audio").agg(F.array_sort(F.collect_list(F.struct("start_time", "start_pos", s.alias("s")))).alias("a"))
    body = F.to_json(F.struct(F.lit(ALIGNMENT_FORMAT).alias("format"), F.lit(granularity).alias("granularity"), F.transform("a", lambda x: x["s"]).alias("sentences"), F.col("audio").alias("source_audio")))
    return g.select("audio", body.alias("body"))


def append_events(events: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    events.write.mode("append").json(path)


def session_manifest(events: DataFrame, session: dict[str, str]) -> DataFrame:
    """One row: the session's facts and its counts."""
    counts = events.agg(F.count("*").alias("events"), F.count_if(F.col("type") == "screenshot").alias("frames"), F.count_if(F.col("type") == "audio").alias("audio_files"))
    return counts.select(*[F.lit(v).alias(k) for k, v in sorted(session.items())], "*")


def swap(df: DataFrame, path: str) -> str:
    """Write a whole table anew beside the old one, then point at it: readers see one state or the other. Returns the
    new version's path; `path` holds the versions and a pointer file."""
    spark = df.sparkSession
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{path}/current").first()["value"])


def without_keys(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The index without some keys."""
    return index.join(gone.select(key).distinct(), key, "left_anti")


def progress_updates(rows: DataFrame) -> list[tuple[str, str]]:
    """(endpoint, body) of one flush; rows are one per item and few: one goes to the single endpoint, more to the batch
    endpoint."""
    sessions = [r.asDict() for r in rows.collect()]
    if not sessions:
        return []
    if len(sessions) == 1:
        return [("/session/local", json.dumps(sessions[0], sort_keys=True))]
    return [("/session/local-all", json.dumps({"sessions": sessions}, sort_keys=True))]


def send_each_batch(send: Callable[[str, str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that posts each micro-batch's latest rows. A batch may come again; updates are idempotent."""

    def sink(batch: DataFrame, _: int) -> None:
        for endpoint, body in progress_updates(batch):
            send(endpoint, body)

    return sink


def report(stats: DataFrame, order: list[str]) -> DataFrame:
    """A report's rows; its layout is the reader's."""
    return stats.orderBy(*order)
