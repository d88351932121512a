"""Indexes, journals, listings, logs, message and voice catalogues."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.operators.ordering import audio_files

JOURNAL = "item_id string, local_file_path string, position double, duration double, is_finished boolean, local_timestamp bigint, synced boolean, synced_at bigint"
CACHE_INDEX = "id string, title string, author string, narrator string, library_id string, duration double, chapters array<struct<id:int,title:string,start:double,end:double>>, audio_files array<string>, cover_path string, downloaded_at bigint"
LIBRARY = "struct<results:array<struct<id:string,libraryId:string,media:struct<metadata:struct<title:string,authorName:string,narratorName:string>,duration:double>>>,total:bigint,page:bigint>"


def json_table(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """A JSON file of records; what cannot be read is an empty table, never an error."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=multiline)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def library_pages(pages: DataFrame) -> DataFrame:
    """(page, pos, id, title, author, narrator, duration) of server pages (body), by title as the server sorts them."""
    p = pages.select(F.from_json("body", LIBRARY).alias("p")).select(F.col("p.page").alias("page"), F.posexplode("p.results").alias("pos", "r"))
    return p.select("page", "pos", "r.id", F.col("r.media.metadata.title").alias("title"), F.col("r.media.metadata.authorName").alias("author"), F.col("r.media.metadata.narratorName").alias("narrator"), F.col("r.media.duration").alias("duration"))


#: Response shapes of the other scans of a server.
ITEM = "struct<id:string,libraryId:string,media:struct<metadata:struct<title:string,authorName:string>,duration:double,audioFiles:array<struct<index:int,ino:string,duration:double>>>>"
PROGRESS = "struct<id:string,libraryItemId:string,duration:double,progress:double,currentTime:double,isFinished:boolean,lastUpdate:bigint>"
SESSIONS = "struct<sessions:array<struct<id:string,libraryItemId:string,currentTime:double,timeListening:double>>,total:bigint>"


def item_files(items: DataFrame) -> DataFrame:
    """(id, title, duration, index, ino, file_duration) of expanded items (body), a row for each audio file."""
    i = items.select(F.from_json("body", ITEM).alias("i")).where("i.id IS NOT NULL")
    f = i.select("i.id", F.col("i.media.metadata.title").alias("title"), F.col("i.media.duration").alias("duration"), F.explode_outer("i.media.audioFiles").alias("f"))
    return f.select("id", "title", "duration", "f.index", "f.ino", F.col("f.duration").alias("file_duration"))


def user_progress(rows: DataFrame) -> DataFrame:
    """(item_id, position, duration, is_finished, ts) of progress responses (body); what is no progress gives no row."""
    p = rows.select(F.from_json("body", PROGRESS).alias("p")).where("p.libraryItemId IS NOT NULL")
    return p.select(F.col("p.libraryItemId").alias("item_id"), F.coalesce("p.currentTime", F.lit(0.0)).alias("position"), "p.duration", F.coalesce("p.isFinished", F.lit(False)).alias("is_finished"), F.col("p.lastUpdate").alias("ts"))


def open_sessions(rows: DataFrame) -> DataFrame:
    """(session_id, item_id, position, listened_s) of session lists (body)."""
    s = rows.select(F.explode(F.from_json("body", SESSIONS)["sessions"]).alias("s"))
    return s.select(F.col("s.id").alias("session_id"), F.col("s.libraryItemId").alias("item_id"), F.col("s.currentTime").alias("position"), F.col("s.timeListening").alias("listened_s"))


def audio_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, bytes, modified) of audio files below a folder, by lower-cased name; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return audio_files(f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")))


def bench_results(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(strategy, seq, synth_ms, duration_ms, text_len) of result files with a per_sentence list."""
    schema = "strategy string, per_sentence array<struct<synth_ms:double,duration_ms:double,text_len:bigint,mem_kb:bigint,batch_id:bigint>>"
    return json_table(spark, path, schema, multiline).select("strategy", F.posexplode("per_sentence").alias("seq", "r")).select("strategy", "seq", "r.*")


def voices(spark: SparkSession, cached: str, built_in: str) -> DataFrame:
    """The cached catalogue if it is valid and not empty, else the built-in one."""
    schema = "id string, name string, size_mb double, url string"
    mine = json_table(spark, cached, schema)
    return json_table(spark, built_in, schema) if mine.isEmpty() else mine


def silence_regions(logs: DataFrame) -> DataFrame:
    """(audio, start_s, end_s) of a detector's log lines (audio, line_no, line); the last may have no end."""
    start = F.regexp_extract("line", r"silence_start:\s*(-?[\d.]+)", 1).try_cast("double")
    end = F.regexp_extract("line", r"silence_end:\s*(-?[\d.]+)", 1).try_cast("double")
    l = logs.withColumns({"s": start, "e": end}).where("s IS NOT NULL OR e IS NOT NULL")
    l = l.withColumn("n", F.count("s").over(W.partitionBy("audio").orderBy("line_no")))
    g = l.groupBy("audio", "n").agg(F.min("s").alias("start_s"), F.min("e").alias("end_s"))
    return g.where("start_s IS NOT NULL").select("audio", "start_s", "end_s")


def phoneme_durations(texts: DataFrame) -> DataFrame:
    """(id, seq, phoneme, duration_ms): pairs of a name and a number in a tool's output (id, body)."""
    pairs = F.regexp_extract_all("body", F.lit(r"\S+\s+\d+"), F.lit(0))
    p = texts.select("id", F.posexplode(pairs).alias("seq", "pair"))
    return p.select("id", "seq", F.regexp_extract("pair", r"^(\S+)", 1).alias("phoneme"), F.regexp_extract("pair", r"(\d+)$", 1).cast("long").alias("duration_ms"))


def devices(lines: DataFrame) -> DataFrame:
    """Devices of object dumps (dump, line_no, line): an object path opens a device, the lines after set its fields. A
    table without the column `dump` is one dump."""
    if "dump" not in lines.columns:
        return devices(lines.withColumn("dump", F.lit(0))).drop("dump")
    path = F.regexp_extract("line", r'object path "([^"]*dev_[^"]*)"', 1)
    l = lines.withColumn("path", F.last(F.when(path != "", path), ignorenulls=True).over(W.partitionBy("dump").orderBy("line_no"))).where("path IS NOT NULL")
    field = F.lower(F.regexp_extract("line", r'string "(Name|Paired|Connected|Icon|Address)"', 1))
    l = l.withColumn("field", F.when(field != "", field))
    value = F.regexp_extract(F.lead("line").over(W.partitionBy("dump", "path").orderBy("line_no")), r'variant\s+(?:string "([^"]*)"|boolean (\w+))', 0)
    l = l.withColumn("value", F.regexp_replace(value, r'^variant\s+(string "|boolean )|"$', "")).where("field IS NOT NULL")
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    return l.groupBy("dump", "path").agg(pick("address").alias("mac"), pick("name").alias("name"), (pick("paired") == "true").alias("paired"), (pick("connected") == "true").alias("connected"), pick("icon").alias("icon"))


def log_tail(lines: DataFrame, n: int = 120) -> DataFrame:
    """The last n lines, in order. The feature is the limit."""
    return lines.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def ring(lines: DataFrame, most: int) -> DataFrame:
    """A log that keeps its last lines only."""
    return log_tail(lines, most)


def po_messages(files: DataFrame) -> DataFrame:
    """(path, entry, msgctxt, msgid, msgid_plural, msgstr array) of message catalogues (path, body)."""
    quoted = lambda k: F.array_join(F.regexp_extract_all(F.regexp_extract("e", rf'(?s)(?:^|\n){k}((?:\s*"(?:[^"\\]|\\.)*")+)', 1), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), "")
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\t"), F.lit("\t")), F.lit("\\\\"), F.lit("\\"))
    e = files.select("path", F.posexplode(F.split("body", r"\n[ \t]*\n")).alias("entry", "e")).where(F.col("e").rlike(r"(^|\n)msgid "))
    one = lambda k: F.nullif(plain(quoted(k)), F.lit(""))
    strs = F.filter(F.array(plain(quoted("msgstr")), *[plain(quoted(rf"msgstr\[{i}\]")) for i in range(4)]), lambda x: x != "")
    return e.select("path", "entry", one("msgctxt").alias("msgctxt"), plain(quoted("msgid")).alias("msgid"), one("msgid_plural").alias("msgid_plural"), strs.alias("msgstr"))


def plural_index(expression: str):
    """A catalogue's C plural expression as a function of n. Only numbers, n and C operators are accepted."""
    tokens = re.findall(r"\d+|n|\|\||&&|[=!<>]=|[<>%?:()!+*/-]", expression)
    if "".join(tokens) != re.sub(r"\s+", "", expression):
        raise ValueError(f"not a plural expression: {expression}")
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    levels = [["||"], ["&&"], ["==", "!="], ["<", ">", "<=", ">="], ["+", "-"], ["*", "/", "%"]]

    def choice():
        test = binary(0)
        if peek() != "?":
            return test
        take()
        yes = choice()
        if take() != ":":
            raise ValueError(expression)
        no = choice()
        return lambda n: yes(n) if test(n) else no(n)

    def binary(level: int):
        if level == len(levels):
            return unary()
        left = binary(level + 1)
        while peek() in levels[level]:
            left = joined(take(), left, binary(level + 1))
        return left

    def joined(op: str, a, b):
        return {
            "||": lambda n: int(bool(a(n) or b(n))), "&&": lambda n: int(bool(a(n) and b(n))), "==": lambda n: int(a(n) == b(n)), "!=": lambda n: int(a(n) != b(n)),
            "<": lambda n: int(a(n) < b(n)), ">": lambda n: int(a(n) > b(n)), "<=": lambda n: int(a(n) <= b(n)), ">=": lambda n: int(a(n) >= b(n)),
            "+": lambda n: a(n) + b(n), "-": lambda n: a(n) - b(n), "*": lambda n: a(n) * b(n), "/": lambda n: a(n) // b(n), "%": lambda n: a(n) % b(n),
        }[op]

    def unary():
        t = take() if peek() is not None else ""
        if t == "!":
            inner = unary()
            return lambda n: int(not inner(n))
        if t == "(":
            inner = choice()
            if peek() != ")":
                raise ValueError(expression)
            take()
            return inner
        if t == "n":
            return lambda n: n
        if t.isdigit():
            return lambda n, v=int(t): v
        raise ValueError(expression)

    out = choice()
    if peek() is not None:
        raise ValueError(expression)
    return out


def source_messages(files: DataFrame, call: str = r"_\(\s*") -> DataFrame:
    """(msgid, places, n) of string literals in calls like _("...") in source texts (path, body); places by file, line."""
    l = files.select("path", F.posexplode(F.split("body", "\n")).alias("i", "line"))
    m = l.select("path", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("line", F.lit(call + r'"((?:[^"\\]|\\.)*)"'), F.lit(1))).alias("msgid"))
    return m.where("msgid <> ''").groupBy("msgid").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("places"), F.count("*").alias("n"))


def translated(messages: DataFrame) -> DataFrame:
    """How many messages a catalogue has and how many are translated."""
    real = messages.where("msgid <> ''")
    return real.groupBy("path").agg(F.count("*").alias("total"), F.count_if(F.size("msgstr") > 0).alias("translated"))


