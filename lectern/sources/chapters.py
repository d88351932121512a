"""Chapters and durations: probe JSON, sidecar lists, cue sheets, ID3 and Ogg tags, MP4 atoms, and their cascade.

Each reader returns (path, index, title, start_time, end_time), index from 0, times in seconds."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.times import chapter_clock_s
from lectern.operators.timelines import fill_ends

ROWS = "path string, index int, title string, start_time double, end_time double"
PROBE = "struct<chapters:array<struct<id:bigint,time_base:string,start:bigint,end:bigint,tags:struct<title:string>>>,format:struct<duration:string>>"


def probe_json(files: DataFrame) -> DataFrame:
    """files: path, body. Time is an integer times num/den of time_base, 1/1000 by default."""
    p = files.select("path", F.from_json("body", PROBE).alias("p"))
    c = p.select("path", F.posexplode("p.chapters").alias("index", "c"))
    base = F.split(F.coalesce("c.time_base", F.lit("1/1000")), "/")
    unit = F.get(base, F.lit(0)).cast("double") / F.get(base, F.lit(1)).cast("double")
    title = F.coalesce("c.tags.title", F.concat(F.lit("Chapter "), F.coalesce("c.id", F.col("index")) + 1))
    return c.select("path", "index", title.alias("title"), (F.col("c.start") * unit).alias("start_time"), (F.col("c.end") * unit).alias("end_time"))


def probe_duration(files: DataFrame) -> DataFrame:
    """(path, duration_s), kept also where there are no chapters."""
    return files.select("path", F.from_json("body", PROBE)["format"]["duration"].try_cast("double").alias("duration_s"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("body", "\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    over = W.partitionBy("path").orderBy(order)
    r = rows.withColumn("index", F.row_number().over(over) - 1)
    return fill_ends(r, ["path"], ["index"]).select("path", "index", "title", "start_time", "end_time")


def sidecar(files: DataFrame) -> DataFrame:
    """Lines "start-end title" or "start title"; # comments. A missing end is the next start, the last 300 s on."""
    clock = r"[\d:.]+"
    l = _lines(files).where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").rlike(rf"^{clock}"))
    g = lambda i: F.regexp_extract("line", rf"^({clock})(?:\s*-\s*({clock}))?\s+(.+)$", i)
    rows = l.select("path", "line_no", chapter_clock_s(g(1)).alias("start_time"), F.when(g(2) != "", chapter_clock_s(g(2))).alias("end_time"), g(3).alias("title"))
    return _numbered(rows.where("start_time IS NOT NULL AND title <> ''"), "line_no")


def cue_sheet(files: DataFrame) -> DataFrame:
    """A TRACK with TITLE and INDEX 01 is a chapter; frames are 75ths of a second."""
    l = _lines(files).withColumn("track", F.sum(F.when(F.col("line").rlike(r"(?i)^TRACK\s"), 1).otherwise(0)).over(W.partitionBy("path").orderBy("line_no")))
    title = F.regexp_extract("line", r'(?i)^TITLE\s+"?([^"]*)"?', 1)
    at = lambda i: F.regexp_extract("line", r"(?i)^INDEX\s+01\s+(\d+):(\d+):(\d+)", i).try_cast("double")
    start = at(1) * 60 + at(2) + at(3) / 75
    rows = l.where("track > 0").groupBy("path", "track").agg(F.max_by(F.when(title != "", title), F.when(title != "", F.col("line_no"))).alias("title"), F.min(start).alias("start_time"))
    return _numbered(rows.where("title IS NOT NULL AND start_time IS NOT NULL").withColumn("end_time", F.lit(None).cast("double")), "track")


def ogg_comments(files: DataFrame) -> DataFrame:
    """CHAPTERnnn=time and CHAPTERnnnNAME=title in the first 128 KB; by number. files: path, content."""
    head = files.select("path", F.decode(F.substring("content", 1, 131072), "ISO-8859-1").alias("s"))
    times = head.select("path", F.explode(F.regexp_extract_all("s", F.lit(r"CHAPTER\d+=[\d:.]+"), F.lit(0))).alias("t"))
    names = head.select("path", F.explode(F.regexp_extract_all("s", F.lit(r"CHAPTER\d+NAME=[^\x00-\x1F]+"), F.lit(0))).alias("t"))
    number = F.regexp_extract("t", r"CHAPTER(\d+)", 1).cast("int")
    n = names.groupBy("path", number.alias("n")).agg(F.first(F.decode(F.encode(F.regexp_extract("t", "NAME=(.*)", 1), "ISO-8859-1"), "UTF-8")).alias("title"))
    t = times.groupBy("path", number.alias("n")).agg(F.min(chapter_clock_s(F.regexp_extract("t", "=(.*)", 1))).alias("start_time"))
    rows = t.join(n, ["path", "n"], "left").withColumn("title", F.coalesce("title", F.concat(F.lit("Chapter "), F.col("n")))).withColumn("end_time", F.lit(None).cast("double"))
    return _numbered(rows, "n")


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(b: bytes) -> str:
    kind, raw = b[:1], b[1:]
    code = {b"\x00": "latin-1", b"\x01": "utf-16", b"\x02": "utf-16-be"}.get(kind, "utf-8")
    return raw.decode(code, "replace").rstrip("\x00")


def id3_frames(data: bytes, at: int, end: int, version: int):
    """(id, body) of the frames between two offsets."""
    while at + 10 <= end and re.fullmatch(rb"[A-Z0-9]{4}", data[at : at + 4]):
        size = _synchsafe(data[at + 4 : at + 8]) if version >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        yield data[at : at + 4].decode(), data[at + 10 : at + 10 + size]
        at += 10 + size


def id3_chapters(data: bytes) -> tuple[list[tuple[str, float, float]], float | None]:
    """Chapters and duration of an ID3v2.3 or 2.4 tag; none if there is no tag."""
    if data[:3] != b"ID3" or len(data) < 10:
        return [], None
    version, end, out, duration = data[3], 10 + _synchsafe(data[6:10]), [], None
    for name, body in id3_frames(data, 10, min(end, len(data)), version):
        if name == "TLEN":
            digits = re.match(r"\d+", _text(body))
            duration = int(digits[0]) / 1000 if digits else None
        elif name == "CHAP" and b"\x00" in body:
            at = body.index(b"\x00") + 1
            if len(body) >= at + 16:
                start, stop = struct.unpack(">II", body[at : at + 8])
                title = next((_text(b) for k, b in id3_frames(body, at + 16, len(body), version) if k == "TIT2"), "")
                out.append((title or f"Chapter {len(out) + 1}", start / 1000, stop / 1000))
    return sorted(out, key=lambda x: x[1]), duration


def mp4_duration(data: bytes) -> float | None:
    """Seconds in the movie header, which must stand in the first 64 KB."""
    i = data.find(b"mvhd", 0, 65536)
    if i < 0 or len(data) < i + 36:
        return None
    wide = data[i + 4] == 1
    scale, length = struct.unpack(">IQ", data[i + 24 : i + 36]) if wide else struct.unpack(">II", data[i + 16 : i + 24])
    return length / scale if scale else None


def tagged_audio(files: DataFrame) -> DataFrame:
    """(path, duration_s, chapters) of ID3 and MP4 files, by Arrow batches. files: path, content."""

    def run(batches):
        kind = pa.list_(pa.struct([("title", pa.string()), ("start_time", pa.float64()), ("end_time", pa.float64())]))
        for b in batches:
            names, lengths, found = [], [], []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows, seconds = id3_chapters(data or b"")
                names.append(path)
                lengths.append(seconds if seconds is not None else mp4_duration(data or b""))
                found.append([{"title": t, "start_time": s, "end_time": e} for t, s, e in rows])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lengths, pa.float64()), pa.array(found, kind)], names=["path", "duration_s", "chapters"])

    return files.select("path", "content").mapInArrow(run, "path string, duration_s double, chapters array<struct<title:string,start_time:double,end_time:double>>")


def id3_rows(files: DataFrame) -> DataFrame:
    return tagged_audio(files).select("path", F.posexplode("chapters").alias("index", "c")).select("path", "index", "c.title", "c.start_time", "c.end_time")


def cascade(ranked: list[DataFrame]) -> DataFrame:
    """Of each path the rows of the first reader that has any."""
    every = [df.withColumn("__rank", F.lit(i)) for i, df in enumerate(ranked)]
    rows = every[0]
    for df in every[1:]:
        rows = rows.unionByName(df)
    best = rows.groupBy("path").agg(F.min("__rank").alias("__rank"))
    return rows.join(best, ["path", "__rank"]).drop("__rank")


def first_duration(ranked: list[DataFrame]) -> DataFrame:
    """Of each path the first duration that is not NULL, in the readers' order: a probe's is kept without chapters."""
    rows = None
    for i, df in enumerate(ranked):
        one = df.select("path", F.struct(F.lit(i).alias("rank"), "duration_s").alias("d"), "duration_s")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("path").agg(F.min(F.when(F.col("duration_s").isNotNull(), F.col("d")))["duration_s"].alias("duration_s"))


def banner_duration(logs: DataFrame) -> DataFrame:
    """Duration: h:m:s in a player's banner. logs: path, body."""
    return logs.select("path", chapter_clock_s(F.nullif(F.regexp_extract("body", r"Duration:\s*(\d+:\d+:\d+\.?\d*)", 1), F.lit(""))).alias("duration_s"))


def progress_position(logs: DataFrame) -> DataFrame:
    """The last out_time=h:m:s in the final 4096 characters; N/A is skipped."""
    tail = F.regexp_extract_all(F.right("body", F.lit(4096)), F.lit(r"out_time=(\d+:\d+:\d+\.?\d*)"), F.lit(1))
    return logs.select("path", chapter_clock_s(F.try_element_at(tail, F.lit(-1))).alias("position_s"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of text files, a row for each."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
