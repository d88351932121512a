"""Queries over sources and sinks. Each builds its files' bodies from rows of a table, in the shape of the source, and reads
them back through the source; the DuckDB SQL beside it takes the same rows from the table, without the detour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import paths
from lectern.operators import lookups, ordering, progress, statistics, timelines
from lectern.plans.text_queries import read, scratch, stored
from lectern.sources import audio, catalogues, chapters, markup, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def body(rows: DataFrame, key: Column, line: Column, order: list[str], *, head: str = "", tail: str = "", sep: str = "\n", name: str = "path") -> DataFrame:
    """(name, body): the lines of each key in order, joined: one file. A file is as long as its key's rows."""
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    return rows.groupBy(key.alias(name)).agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["__line"]), sep), F.lit(tail)).alias("body"))


def say(pattern: str, *cols) -> Column:
    """%s formats of columns."""
    return F.format_string(pattern, *[F.col(c) if isinstance(c, str) else c for c in cols])


def clock(seconds: Column) -> Column:
    return F.format_string("%d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), (seconds % 60).cast("long"))


# Books: a nation is a book, its suppliers are documents; a brand is a book, its parts are manifest items.


@query("SELECT n_name AS book, CASE WHEN n_nationkey % 3 < 2 THEN 'OPS/' || n_name || '.opf' END AS opf FROM nation WHERE n_nationkey % 3 < 2")
def book_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package path by full-path, by any href, or none."""
    n = read(spark, sf_dir, "nation")
    text = F.when(F.col("n_nationkey") % 3 == 0, say('<container><rootfile media-type="x" full-path="OPS/%s.opf"/></container>', "n_name")).when(F.col("n_nationkey") % 3 == 1, say('<container><link rel="x" href="OPS/%s.opf"/></container>', "n_name")).otherwise(F.lit("<container/>"))
    return markup.package_path(n.select(F.col("n_name").alias("book"), F.lit("META-INF/container.xml").alias("href"), text.alias("body")))


def package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, body): a package of each brand, whose items are its parts; every third has an overlay item."""
    p = read(spark, sf_dir, "part")
    has = F.col("p_partkey") % 3 == 0
    item = F.concat(
        say('<item id="p%d" href="Text/%d.xhtml" media-type="application/xhtml+xml"', "p_partkey", "p_partkey"), F.when(has, say(' media-overlay="o%d"', "p_partkey")).otherwise(F.lit("")), F.lit("/>"),
        F.when(has, say('<item media-type="application/smil+xml" href="Smil/%d.smil" id="o%d"/>', "p_partkey", "p_partkey")).otherwise(F.lit("")),
    )
    items = body(p, F.col("p_brand"), item, ["p_partkey"], head="<manifest>", tail="</manifest>", name="book")
    refs = body(p.withColumn("back", -F.col("p_partkey")), F.col("p_brand"), say('<itemref idref="p%d" linear="yes"/>', "p_partkey"), ["back"], head="<spine>", tail="</spine>", name="book")
    return items.join(refs.withColumnRenamed("body", "spine"), "book").select("book", F.concat(F.lit("<package>"), "body", "spine", F.lit("</package>")).alias("body"))


_OVER = "SELECT p_brand AS book, 'o' || p_partkey AS id, 'Smil/' || p_partkey || '.smil' AS href, 'application/smil+xml' AS media_type, NULL AS media_overlay FROM part WHERE p_partkey % 3 = 0"


@query(f"SELECT p_brand AS book, 'p' || p_partkey AS id, 'Text/' || p_partkey || '.xhtml' AS href, 'application/xhtml+xml' AS media_type, CASE WHEN p_partkey % 3 = 0 THEN 'o' || p_partkey END AS media_overlay FROM part UNION ALL {_OVER}")
def book_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2"""
    return markup.manifest(package(spark, sf_dir))


@query("SELECT p_brand AS book, 'Text/' || p_partkey || '.xhtml' AS doc_href, 'Smil/' || p_partkey || '.smil' AS overlay_href FROM part WHERE p_partkey % 3 = 0")
def book_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9"""
    return markup.overlays(markup.manifest(package(spark, sf_dir)))


@query("SELECT p_brand AS book, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC)::INT AS pos, p_partkey || '.xhtml' AS href FROM part")
def book_spines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6"""
    opf = package(spark, sf_dir)
    return markup.spine(opf, markup.manifest(opf))


@query("SELECT p_brand AS book, 'Smil/' || p_partkey || '.smil' AS overlay_href, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC)::INT AS seq FROM part WHERE p_partkey % 3 = 0")
def overlays_in_spine_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book by its own spine."""
    opf = package(spark, sf_dir)
    items = markup.manifest(opf)
    return lookups.spine_order(markup.overlays(items), markup.spine(opf, items)).select("book", "overlay_href", "seq")


def overlay_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, href, body): a supplier is a book, its line items are pars of one overlay for each line number."""
    l = read(spark, sf_dir, "lineitem").withColumn("ms", F.col("l_quantity").cast("long") * 100)
    par = F.concat(
        say('<par id="x%d"><text src="../Text/%d.xhtml#f%d"/>', "l_orderkey", "l_linenumber", "l_orderkey"),
        F.when(F.col("l_partkey") % 5 > 0, say('<audio src="../Audio/%s.mp3" clipBegin="%dms" clipEnd="%s"/>', "l_returnflag", "ms", clock(F.col("l_quantity").cast("long") + 100))).otherwise(F.lit("")),
        F.lit("</par>"),
    )
    rows = l.groupBy("l_suppkey", "l_linenumber").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", par.alias("par")))).alias("a"))
    return rows.select(F.col("l_suppkey").cast("string").alias("book"), say("OPS/Smil/%d.smil", "l_linenumber").alias("href"), F.concat(F.lit("<smil><body>"), F.array_join(F.transform("a", lambda x: x["par"]), "\n"), F.lit("</body></smil>")).alias("body"))


_PARS = """e AS (SELECT l_suppkey::VARCHAR AS book, 'OPS/Smil/' || l_linenumber || '.smil' AS smil, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity) - 1 AS n, l_linenumber, l_orderkey,
  'f' || l_orderkey AS fragment_id, 'OPS/Text/' || l_linenumber || '.xhtml' AS text_doc, 'OPS/Audio/' || l_returnflag || '.mp3' AS audio_src, (l_quantity::BIGINT * 100) / 1000.0 AS start_time, l_quantity::BIGINT + 100.0 AS end_time FROM lineitem WHERE l_partkey % 5 > 0)"""


@query(f"WITH {_PARS} SELECT book, smil, fragment_id, text_doc, audio_src, start_time, end_time FROM e")
def book_overlay_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, F8: pars without audio go."""
    return markup.overlay_entries(overlay_files(spark, sf_dir)).select("book", "smil", "fragment_id", "text_doc", "audio_src", "start_time", "end_time")


def overlay_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, href, body): documents whose spans are the pars' fragments, every second of them there."""
    l = read(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").select("l_suppkey", "l_linenumber", "l_orderkey").distinct()
    rows = l.groupBy("l_suppkey", "l_linenumber").agg(F.array_sort(F.collect_list(F.struct("l_orderkey"))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: F.format_string('<p><span class="s" id="f%d">Order  <i>%d</i> &amp; more <span id="g%d">inner</span></span></p>', x["l_orderkey"], x["l_orderkey"], x["l_orderkey"])), "\n")
    return rows.select(F.col("l_suppkey").cast("string").alias("book"), say("OPS/Text/%d.xhtml", "l_linenumber").alias("href"), text.alias("body"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey::VARCHAR AS book, 'OPS/Text/' || l_linenumber || '.xhtml' AS href, l_orderkey FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT book, href, 'f' || l_orderkey AS fragment_id, 'Order ' || l_orderkey || ' & more inner' AS text FROM s UNION ALL SELECT book, href, 'g' || l_orderkey, 'inner' FROM s""")
def book_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested spans."""
    return markup.sentence_spans(overlay_documents(spark, sf_dir))


@query(f"""WITH {_PARS} SELECT book, fragment_id, text_doc, audio_src, start_time, CASE WHEN l_orderkey % 2 = 0 THEN 'Order ' || l_orderkey || ' & more inner' ELSE '../Text/' || l_linenumber || '.xhtml#f' || l_orderkey END AS text,
dense_rank() OVER (PARTITION BY book ORDER BY l_linenumber) AS part FROM e""")
def book_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their texts, else the reference, in narrative order of the overlays."""
    from pyspark.sql import Window as W

    files = overlay_files(spark, sf_dir)
    entries = markup.overlay_entries(files)
    order = files.select("book", F.col("href").alias("overlay_href"), F.regexp_extract("href", r"(\d+)", 1).cast("int").alias("seq"))
    t = markup.timing(entries, markup.sentence_spans(overlay_documents(spark, sf_dir)), order)
    first = t.groupBy("book", "smil").agg(F.min("seq").alias("first"))
    ranked = first.withColumn("part", F.dense_rank().over(W.partitionBy("book").orderBy("first")).cast("long")).select("book", "smil", "part")
    return t.join(ranked, ["book", "smil"]).select("book", "fragment_id", "text_doc", "audio_src", "start_time", "text", "part")


@query("""SELECT 'r' || n_regionkey AS book, n_nationkey % 3 || '.xhtml' AS base, arg_min(n_name, n_nationkey) AS title FROM nation GROUP BY ALL""")
def book_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first title of a document."""
    n = read(spark, sf_dir, "nation")
    point = say('<navPoint id="n%d"><navLabel><text> %s </text></navLabel><content src="Text/%d.xhtml#a%d"/></navPoint>', "n_nationkey", "n_name", F.col("n_nationkey") % 3, "n_nationkey")
    return markup.chapter_titles(body(n, say("r%d", "n_regionkey"), point, ["n_nationkey"], name="book"))


@query("""SELECT l_suppkey::VARCHAR AS book, l_linenumber || '.xhtml' AS base, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 'Chapter ' || l_linenumber END, l_linenumber || '.xhtml') AS title, count(*) AS n FROM lineitem WHERE l_partkey % 5 > 0 GROUP BY ALL""")
def titled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries look their chapter title up by base name; without one the base name stands in."""
    e = markup.overlay_entries(overlay_files(spark, sf_dir)).withColumn("base", paths.basename(F.col("text_doc")))
    titles = spark.range(1, 8).where("id % 2 = 0").select(say("%d.xhtml", "id").alias("base"), say("Chapter %d", "id").alias("title"), F.col("id").alias("seq"))
    got = lookups.lookup(e, titles, F.col("base"), F.col("base"), {"title": F.col("title")}, [F.col("seq")], {"title": F.col("base")})
    return got.groupBy("book", "base", "title").agg(F.count("*").alias("n"))


# Chapter sources: an order is a file, its line items are chapters.

_CH = "c AS (SELECT l_orderkey::VARCHAR AS path, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1)::INT AS i, l_partkey, l_quantity::BIGINT AS q FROM lineitem), t AS (SELECT *, i * 1000 + q AS s FROM c)"


def chapter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    l = read(spark, sf_dir, "lineitem")
    i = (F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")) - 1).cast("long")
    rows = l.select(F.col("l_orderkey").cast("string").alias("file"), i.alias("i"), "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return rows.withColumn("s", F.col("i") * 1000 + F.col("q"))


@query(f'WITH {_CH} SELECT path, i AS "index", CASE WHEN l_partkey % 4 = 0 THEN \'Chapter \' || (i + 1) ELSE \'Part \' || l_partkey END AS title, s::DOUBLE AS start_time, s + 500.5 AS end_time FROM t')
def probe_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7"""
    c = chapter_rows(spark, sf_dir)
    title = F.when(F.col("l_partkey") % 4 > 0, say(', "tags": {"title": "Part %d"}', "l_partkey")).otherwise(F.lit(""))
    one = F.concat(say('{"id": %d, "time_base": "1/1000", "start": %d, "end": %d', "i", F.col("s") * 1000, F.col("s") * 1000 + 500500), title, F.lit("}"))
    return chapters.probe_json(body(c, F.col("file"), one, ["i"], head='{"chapters": [', tail='], "format": {"duration": "12.5"}}', sep=", "))


def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chapter_rows(spark, sf_dir)
    line = F.concat(clock(F.col("s")), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(" - "), clock(F.col("s") + 400))).otherwise(F.lit("")), say(" Part %d", "l_partkey"))
    return body(c, F.col("file"), line, ["i"], head="# chapters\n\n")


_SIDE = f"""{_CH}, side AS (SELECT path, i AS "index", 'Part ' || l_partkey AS title, s::DOUBLE AS start_time, coalesce(CASE WHEN l_partkey % 2 = 0 THEN s + 400 END, lead(s) OVER (PARTITION BY path ORDER BY i), s + 300)::DOUBLE AS end_time FROM t)"""
_CUE = """cue AS (SELECT path, i AS "index", 'Part ' || l_partkey AS title, s + 15 / 75.0 AS start_time, coalesce(lead(s + 15 / 75.0) OVER (PARTITION BY path ORDER BY i), s + 15 / 75.0 + 300) AS end_time FROM t)"""


@query(f"WITH {_SIDE} SELECT * FROM side")
def sidecar_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8"""
    return chapters.sidecar(sidecar_files(spark, sf_dir))


def cue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chapter_rows(spark, sf_dir)
    entry = say('  TRACK %02d AUDIO\n    TITLE "Part %d"\n    INDEX 00 00:00:00\n    INDEX 01 %d:%02d:15', F.col("i") + 1, "l_partkey", F.floor(F.col("s") / 60), F.col("s") % 60)
    return body(c, F.col("file"), entry, ["i"], head='TITLE "Album"\nFILE "x.wav" WAVE\n')


@query(f"WITH {_CH}, {_CUE} SELECT * FROM cue")
def cue_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9"""
    return chapters.cue_sheet(cue_files(spark, sf_dir))


@query(f"WITH {_SIDE}, {_CUE} SELECT * FROM side WHERE path::BIGINT % 2 = 0 UNION ALL SELECT * FROM cue WHERE path::BIGINT % 2 = 1 AND path::BIGINT % 3 = 0")
def chapter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file the chapters of the first reader that has any: its list, else its cue sheet."""
    side = chapters.sidecar(sidecar_files(spark, sf_dir).where(F.col("path").cast("long") % 2 == 0))
    return chapters.cascade([side, chapters.cue_sheet(cue_files(spark, sf_dir).where(F.col("path").cast("long") % 3 == 0))])


def be(n: Column, width: int) -> Column:
    """Big-endian bytes of a number, as hex."""
    return F.lpad(F.hex(n.cast("long")), 2 * width, "0")


def le(n: Column, width: int) -> Column:
    """Little-endian bytes of a number, as hex."""
    h = be(n, width)
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))])


def utf8(c: Column) -> Column:
    return F.hex(F.encode(c, "UTF-8"))


@query(f'WITH {_CH} SELECT path, i AS "index", \'Part \' || l_partkey AS title, s::DOUBLE AS start_time, s + 1.5 AS end_time FROM t')
def id3_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter frames of a version 3 tag, written last first and read in order of time."""
    c = chapter_rows(spark, sf_dir)
    title = F.concat(F.lit("03"), utf8(say("Part %d", "l_partkey")))
    title = F.concat(F.lit("54495432"), be(F.length(title) / 2, 4), F.lit("0000"), title)
    frame = F.concat(F.lit("6300"), be(F.col("s") * 1000, 4), be(F.col("s") * 1000 + 1500, 4), F.lit("FF" * 8), title)
    frame = F.concat(F.lit("43484150"), be(F.length(frame) / 2, 4), F.lit("0000"), frame)
    files = body(c.withColumn("back", -F.col("i")), F.col("file"), frame, ["back"], sep="")
    n = (F.length("body") / 2).cast("long")
    size = F.concat(*[be(F.floor(n / (1 << (7 * k))) % 128, 1) for k in (3, 2, 1, 0)])
    return chapters.id3_rows(files.select("path", F.unhex(F.concat(F.lit("494433030000"), size, "body")).alias("content")))


@query(f"""WITH {_CH} SELECT path, i AS "index", CASE WHEN l_partkey % 3 > 0 THEN 'Part ' || l_partkey ELSE 'Chapter ' || (i + 1) END AS title, s::DOUBLE AS start_time, coalesce(lead(s) OVER (PARTITION BY path ORDER BY i), s + 300)::DOUBLE AS end_time FROM t""")
def ogg_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of times and, for most, names."""
    c = chapter_rows(spark, sf_dir)
    one = F.concat(say("CHAPTER%03d=%s\u0001", F.col("i") + 1, clock(F.col("s"))), F.when(F.col("l_partkey") % 3 > 0, say("CHAPTER%03dNAME=Part %d\u0001", F.col("i") + 1, "l_partkey")).otherwise(F.lit("")))
    files = body(c, F.col("file"), one, ["i"], head="OggS\u0001vorbis\u0001", sep="")
    return chapters.ogg_comments(files.select("path", F.encode("body", "UTF-8").alias("content")))


def movie(scale: Column, length: Column) -> Column:
    """The bytes of a file with a movie header of version 0."""
    return F.unhex(F.concat(F.lit("0000001C66747970" + "00" * 20 + "0000006C" + "6D766864" + "00" * 12), be(scale, 4), be(length, 4), F.lit("00" * 32)))


@query("SELECT o_orderkey::VARCHAR AS path, (o_orderkey * 7 + 1) / 600.0 AS duration_s FROM orders")
def movie_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12"""
    o = read(spark, sf_dir, "orders")
    files = o.select(F.col("o_orderkey").cast("string").alias("path"), movie(F.lit(600), F.col("o_orderkey") * 7 + 1).alias("content"))
    return chapters.tagged_audio(files).select("path", "duration_s")


@query("""SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 3 = 0 THEN 12.5 WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 5000) + 0.25 END AS duration_s FROM orders""")
def first_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe's duration, kept without chapters, else that of a player's banner, else none."""
    o = read(spark, sf_dir, "orders").withColumn("path", F.col("o_orderkey").cast("string"))
    k = F.col("o_orderkey")
    probe = chapters.probe_duration(o.select("path", F.when(k % 3 == 0, F.lit('{"format": {"duration": "12.5"}}')).otherwise(F.lit("{}")).alias("body")))
    banner = F.when(k % 3 == 1, F.concat(F.lit("Input #0\n  Duration: "), F.format_string("%02d:%02d:%02d", F.floor(k % 5000 / 3600), F.floor(k % 5000 % 3600 / 60), k % 5000 % 60), F.lit(".25, start: 0.0"))).otherwise(F.lit("no such file"))
    return chapters.first_duration([probe, chapters.banner_duration(o.select("path", banner.alias("body")))])


@query("SELECT user_id::VARCHAR AS path, max(event_id % 5000)::DOUBLE AS position_s FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) GROUP BY 1")
def progress_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last time in the tail of a player's log; the last line is N/A."""
    e = read(spark, sf_dir, "events")
    p = F.col("event_id") % 5000
    line = F.concat(F.lit("out_time="), F.format_string("%02d:%02d:%02d", F.floor(p / 3600), F.floor(p % 3600 / 60), p % 60), F.lit(".000000\nprogress=continue"))
    return chapters.progress_position(body(e, F.col("user_id").cast("string"), line, ["event_id"], tail="\nout_time=N/A\nprogress=end"))


# Catalogues, listings and logs.


@query("SELECT user_id::VARCHAR AS item_id, event_id::DOUBLE / 8 AS position, event_id % 2 = 0 AS synced FROM events")
def journal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON journal, written and read by its schema."""
    path = scratch(spark, "journal")
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("item_id"), (F.col("event_id") / 8).alias("position"), (F.col("event_id") % 2 == 0).alias("synced"))
    e.write.json(path)
    return catalogues.json_table(spark, path, catalogues.JOURNAL, multiline=False).select("item_id", "position", "synced")


@query("""SELECT page, row_number() OVER (PARTITION BY page ORDER BY c_name, c_custkey)::INT - 1 AS pos, c_custkey::VARCHAR AS id, c_name AS title, c_mktsegment AS author, c_acctbal AS duration
FROM (SELECT *, (row_number() OVER (ORDER BY c_name, c_custkey) - 1) // 50 AS page FROM customer)""")
def library_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a library's items by title."""
    from pyspark.sql import Window as W

    c, order = read(spark, sf_dir, "customer"), [F.col("c_name").asc_nulls_last(), F.col("c_custkey").asc_nulls_last()]
    bounds = c.select("c_name", "c_custkey", "c_mktsegment", "c_acctbal").repartitionByRange(*order).withColumn("pid", F.spark_partition_id())
    # written once: the bounds of ranges are sampled anew, and differ, each time that a plan deals rows to them
    n = stored(bounds.withColumn("i", F.row_number().over(W.partitionBy("pid").orderBy(*order))), "library")
    sizes = n.groupBy("pid").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = n.join(sizes.select("pid", "base"), "pid").withColumn("at", F.col("base") + F.col("i") - 1)
    item = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.struct(F.struct(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("authorName")).alias("metadata"), F.col("c_acctbal").alias("duration")).alias("media")))
    pages = body(n.withColumn("page", F.floor(F.col("at") / 50)), F.col("page"), item, ["at"], sep=",", name="page")
    whole = pages.select(F.concat(F.lit('{"results":['), "body", F.lit('],"total":9,"page":'), F.col("page").cast("string"), F.lit("}")).alias("body"))
    return catalogues.library_pages(whole).select("page", "pos", "id", "title", "author", "duration")


@query("SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS title, o_totalprice AS duration, l_linenumber AS \"index\", l_partkey::VARCHAR AS ino, l_quantity AS file_duration FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def item_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded items and their audio files; an item without files is one row."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("index"), F.col("l_partkey").cast("string").alias("ino"), F.col("l_quantity").alias("duration"))).alias("audioFiles"))
    o = read(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    media = F.struct(F.struct(F.col("o_orderpriority").alias("title")).alias("metadata"), F.col("o_totalprice").alias("duration"), "audioFiles")
    return catalogues.item_files(o.select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), media.alias("media"))).alias("body")))


@query("SELECT o_orderkey::VARCHAR AS item_id, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END AS position, 7.5 AS duration, o_orderstatus = 'F' AS is_finished, epoch(o_orderdate)::BIGINT AS ts FROM orders")
def progress_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress responses; a missing position is 0, a response that is none gives no row."""
    o = read(spark, sf_dir, "orders")
    one = F.struct(F.col("o_orderkey").cast("string").alias("libraryItemId"), F.lit(7.5).alias("duration"), F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("currentTime"), F.when(F.col("o_orderstatus") == "F", True).alias("isFinished"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("lastUpdate"))
    rows = o.select(F.to_json(one).alias("body")).unionByName(spark.range(1).select(F.lit("Not Found").alias("body")))
    return catalogues.user_progress(rows)


@query("SELECT event_id::VARCHAR AS session_id, user_id::VARCHAR AS item_id, value AS position, (event_id % 100)::DOUBLE AS listened_s FROM events")
def session_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of listening sessions."""
    e = read(spark, sf_dir, "events")
    one = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("libraryItemId"), F.col("value").alias("currentTime"), (F.col("event_id") % 100).cast("double").alias("timeListening")))
    return catalogues.open_sessions(body(e, F.col("user_id"), one, ["event_id"], head='{"sessions":[', tail='],"total":1}', sep=","))


def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, pcm, content, length): 16-bit mono files of the parts' names, four times over."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_partkey"), F.encode(F.repeat("p_name", 4), "UTF-8").alias("pcm"))
    rate, n = 8000 + F.col("p_partkey") % 4 * 8000, F.octet_length("pcm")
    head = F.concat(F.lit("52494646"), le(n + 36, 4), F.lit("57415645666D7420"), le(F.lit(16), 4), le(F.lit(1), 2), le(F.lit(1), 2), le(rate, 4), le(rate * 2, 4), le(F.lit(2), 2), le(F.lit(16), 2), F.lit("64617461"), le(n, 4))
    return p.withColumn("content", F.concat(F.unhex(head), F.col("pcm"))).withColumn("length", F.octet_length("content").cast("long"))


@query("""SELECT p_partkey::VARCHAR AS path, 1 AS channels, 8000 + p_partkey % 4 * 8000 AS rate, 16 AS bits, strlen(p_name) * 4 AS data_size, strlen(p_name) * 4 * 1000 // ((8000 + p_partkey % 4 * 8000) * 2) AS duration_ms FROM part""")
def wav_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a header by their place."""
    return audio.wav_headers(wav_files(spark, sf_dir)).select("path", "channels", "rate", "bits", "data_size", "duration_ms")


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS path, repeat(p_name, 4) AS t FROM part)
SELECT path, 0::BIGINT AS seq, md5(substr(t, 1, 6)) AS md5 FROM p UNION ALL SELECT path, 1, md5(substr(t, 7)) FROM p""")
def wav_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: files cut in two at a byte offset of their samples; the cuts are files again."""
    f = wav_files(spark, sf_dir)
    at = f.select("path", F.inline(F.array(F.struct(F.lit(0).alias("seq"), F.lit(0).alias("start_byte"), F.lit(6).alias("end_byte")), F.struct(F.lit(1).alias("seq"), F.lit(6).alias("start_byte"), F.octet_length("pcm").alias("end_byte")))))
    return audio.cut(f, at).select("path", "seq", F.md5(F.substring("content", 45, 1 << 20)).alias("md5"))


@query("""WITH r AS (SELECT l_orderkey::VARCHAR AS audio, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, l_quantity::BIGINT AS q, l_partkey FROM lineitem), c AS (SELECT *, max(i) OVER (PARTITION BY audio) AS m FROM r)
SELECT audio, i * 100.0 AS start_s, CASE WHEN i < m THEN i * 100 + q / 4.0 END AS end_s FROM c""")
def silence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's log; the last silence has no end."""
    from pyspark.sql import Window as W

    c = chapter_rows(spark, sf_dir).withColumn("n", F.col("i") + 1).withColumn("m", F.max("i").over(W.partitionBy("file")) + 1)
    start, end = say("[d @ 1] silence_start: %d", F.col("n") * 100), F.concat(F.lit("[d @ 1] silence_end: "), (F.col("n") * 100 + F.col("q") / 4).cast("string"), F.lit(" | silence_duration: 1"))
    lines = F.when(F.col("n") < F.col("m"), F.array(F.lit("size=N/A"), start, end)).otherwise(F.array(start, F.lit("done")))
    rows = c.select(F.col("file").alias("audio"), "n", F.posexplode(lines).alias("k", "line")).withColumn("line_no", F.col("n") * 10 + F.col("k"))
    return catalogues.silence_regions(rows)


@query("SELECT l_suppkey AS id, l_returnflag || l_linestatus || l_linenumber AS phoneme, l_quantity::BIGINT AS duration_ms, count(*) AS n FROM lineitem GROUP BY ALL")
def phoneme_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and numbers of a tool's output."""
    l = read(spark, sf_dir, "lineitem").withColumn("name", F.concat("l_returnflag", "l_linestatus", "l_linenumber")).withColumn("ms", F.col("l_quantity").cast("long"))
    texts = body(l, F.col("l_suppkey"), say("%s\t%d", "name", "ms"), ["l_orderkey", "l_linenumber", "l_partkey"], name="id")
    return catalogues.phoneme_durations(texts).groupBy("id", "phoneme", "duration_ms").agg(F.count("*").alias("n"))


@query("SELECT event_type AS strategy, count(*) AS n, sum(100 + event_id * 37 % 900)::DOUBLE AS synth_ms, sum(10 + event_id % 90)::BIGINT AS text_len FROM events GROUP BY 1")
def bench_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files with a list of sentences, written and read."""
    from lectern.plans.event_queries import samples

    path = scratch(spark, "bench")
    s = samples(spark, sf_dir).withColumn("part", F.col("seq") % 16)
    s.groupBy("strategy", "part").agg(F.collect_list(F.struct("synth_ms", "duration_ms", "text_len")).alias("per_sentence")).drop("part").write.json(path)
    rows = catalogues.bench_results(spark, path, multiline=False)
    return rows.groupBy("strategy").agg(F.count("*").alias("n"), F.sum("synth_ms").alias("synth_ms"), F.sum("text_len").alias("text_len"))


@query("SELECT p_brand AS id, min(p_name) AS name, max(p_size)::DOUBLE AS size_mb, NULL AS url FROM part GROUP BY 1")
def voice_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached catalogue is empty, so the built-in one counts."""
    cached, built_in = scratch(spark, "cached"), scratch(spark, "built-in")
    spark.range(1).select(F.lit("[]").alias("value")).write.text(cached)
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.min("p_name").alias("name"), F.max("p_size").cast("double").alias("size_mb"))
    rows.coalesce(1).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(built_in)  # a row for each brand
    return catalogues.voices(spark, cached, built_in)


@query("SELECT 'n' || s_nationkey AS dump, 'm' || s_suppkey AS mac, s_name AS name, s_suppkey % 2 = 0 AS paired, s_suppkey % 3 = 0 AS connected, CASE WHEN s_suppkey % 4 = 0 THEN 'audio-card' END AS icon FROM supplier")
def device_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dump for each nation, a device for each of its suppliers."""
    s = read(spark, sf_dir, "supplier")
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    text = lambda k, v: [F.lit(f'string "{k}"'), F.concat(F.lit('variant string "'), v, F.lit('"'))]
    boolean = lambda k, v: [F.lit(f'string "{k}"'), F.concat(F.lit("variant boolean "), flag(v))]
    lines = F.array(say('object path "/org/hci0/dev_%d"', "s_suppkey"), *text("Address", say("m%d", "s_suppkey")), *text("Name", F.col("s_name")), *boolean("Paired", F.col("s_suppkey") % 2 == 0), *boolean("Connected", F.col("s_suppkey") % 3 == 0))
    icon = F.when(F.col("s_suppkey") % 4 == 0, F.array(*text("Icon", F.lit("audio-card")))).otherwise(F.array().cast("array<string>"))
    rows = s.select(say("n%d", "s_nationkey").alias("dump"), "s_suppkey", F.posexplode(F.concat(lines, icon)).alias("k", "line")).withColumn("line_no", F.col("s_suppkey") * 100 + F.col("k"))
    return catalogues.devices(rows.select("dump", "line_no", "line")).drop("path")


def message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, body): a brand is a catalogue, its parts are messages; every fourth is not translated."""
    p = read(spark, sf_dir, "part")
    entry = F.concat(
        F.when(F.col("p_partkey") % 5 == 0, F.lit('msgctxt "menu"\n')).otherwise(F.lit("")),
        say('msgid "Part %d of \\"%s\\""\n', "p_partkey", "p_type"),
        F.when(F.col("p_partkey") % 4 > 0, say('msgstr "%s"\n"\\t%%1 more"', "p_name")).otherwise(F.lit('msgstr ""')),
    )
    return body(p, F.col("p_brand"), entry, ["p_partkey"], head='msgid ""\nmsgstr "Language: x\\n"\n\n', sep="\n\n")


@query("""SELECT p_brand AS path, CASE WHEN p_partkey % 5 = 0 THEN 'menu' END AS msgctxt, 'Part ' || p_partkey || ' of "' || p_type || '"' AS msgid, CASE WHEN p_partkey % 4 > 0 THEN p_name || chr(9) || '%1 more' END AS translated FROM part
UNION ALL SELECT DISTINCT p_brand, NULL, '', 'Language: x' || chr(10) FROM part""")
def message_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S23"""
    return catalogues.po_messages(message_files(spark, sf_dir)).select("path", "msgctxt", "msgid", F.try_element_at("msgstr", F.lit(1)).alias("translated"))


@query("SELECT p_type AS msgid, count(*) AS n, min(p_brand) AS first_path FROM part GROUP BY 1")
def message_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals in calls, with their places."""
    p = read(spark, sf_dir, "part")
    found = catalogues.source_messages(body(p, F.col("p_brand"), say('local x%d = _("%s") .. other("no")', "p_partkey", "p_type"), ["p_partkey"]))
    return found.select("msgid", "n", F.element_at("places", 1)["path"].alias("first_path"))


@query("SELECT event_id AS line_no, event_type AS line FROM events ORDER BY event_id DESC LIMIT 120")
def log_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 120 lines of a ring; the feature is the limit."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("event_type").alias("line"))
    return catalogues.log_tail(catalogues.ring(e, 5000))


# Sinks.


@query("SELECT l_suppkey::VARCHAR AS audio, l_orderkey * 10 AS start_pos, l_quantity + 0.125 AS end_time, 'line ' || l_orderkey AS text FROM lineitem")
def alignment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: an alignment document for each audio file, read back from its JSON."""
    l = read(spark, sf_dir, "lineitem")
    s = l.select(F.col("l_suppkey").cast("string").alias("audio"), (F.col("l_orderkey") * 10).alias("start_pos"), (F.col("l_orderkey") * 10 + 5).alias("end_pos"), F.col("l_quantity").alias("start_time"), (F.col("l_quantity") + 0.125).alias("end_time"), say("line %d", "l_orderkey").alias("text"))
    kind = "struct<format:string,granularity:string,sentences:array<struct<end_pos:bigint,end_time:double,start_pos:bigint,start_time:double,text:string>>,source_audio:string>"
    j = sinks.alignment_json(s).select(F.from_json("body", kind).alias("j")).where(F.col("j.format") == sinks.ALIGNMENT_FORMAT)
    return j.select(F.col("j.source_audio").alias("audio"), F.explode("j.sentences").alias("s")).select("audio", "s.start_pos", "s.end_time", "s.text")


@query("SELECT event_type AS type, event_id / 4.0 AS t, props AS payload FROM events")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended twice as JSON lines and read as a stream of files."""
    from lectern.streaming.progress import event_files

    path, out = scratch(spark, "events"), scratch(spark, "events-out")
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("type"), (F.col("event_id") / 4).alias("t"), F.col("props").alias("payload"), "event_id")
    for part in range(2):
        sinks.append_events(rows.where(F.col("event_id") % 2 == part).drop("event_id"), path)
    s = event_files(spark, path).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    s.awaitTermination()
    return spark.read.schema("type string, t double, payload string").parquet(out)


@query("SELECT count(*) AS events, count(*) FILTER (WHERE event_type = 'click') AS frames, count(*) FILTER (WHERE event_type = 'view') AS audio_files, 'd1' AS device FROM events")
def session_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3"""
    e = read(spark, sf_dir, "events").withColumn("type", F.when(F.col("event_type") == "click", "screenshot").when(F.col("event_type") == "view", "audio").otherwise("other"))
    return sinks.session_manifest(e, {"device": "d1"})


@query("SELECT n_nationkey AS id, n_name AS title FROM nation WHERE n_regionkey <> 1")
def swapped_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K9: an index written as a version, keys removed, swapped for a newer version and read through its pointer."""
    path = scratch(spark, "index")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), "n_regionkey")
    sinks.swap(n, path)
    old = sinks.current(spark, path)
    sinks.swap(sinks.without_keys(old, old.where("n_regionkey = 1").select("id"), "id").select("id", "title"), path)
    return sinks.current(spark, path)


@query("SELECT event_type AS strategy, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5"""
    e = read(spark, sf_dir, "events")
    return sinks.report(e.groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")), ["strategy"])


@query("SELECT '/session/local-all' AS endpoint, count(DISTINCT event_type) AS sessions FROM events")
def flush_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: one flush is one row an item; here the items are the event types, so that it is small whatever the table."""
    import json

    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("item_id"), "event_id")
    sent: list[tuple[str, int]] = []
    sink = sinks.send_each_batch(lambda endpoint, text: sent.append((endpoint, len(json.loads(text)["sessions"]))))
    sink(progress.latest(e, ["item_id"], ["event_id"]), 0)
    return spark.createDataFrame(sent, "endpoint string, sessions long")


# Listings.

_NAMES = "f AS (SELECT p_partkey, p_name || '_' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.MP3' WHEN 1 THEN '.opus' WHEN 2 THEN '.txt' WHEN 3 THEN '.m4b' ELSE '' END AS name FROM part)"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    ending = F.when(k == 0, ".MP3").when(k == 1, ".opus").when(k == 2, ".txt").when(k == 3, ".m4b").otherwise("")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"), ending).alias("name"))


@query(f"WITH {_NAMES} SELECT name, row_number() OVER (ORDER BY lower(name), name) AS at FROM f WHERE p_partkey % 5 IN (0, 1, 3)")
def audio_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, O3: audio files in order; the place in the order is the row's place in the result."""
    return ranked(ordering.audio_files(listing(spark, sf_dir)), F.lower("name"), F.col("name")).select("name", "at")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """A listing's rows with their place, for the comparison: by the order that the operator has given them."""
    from pyspark.sql import Window as W

    return rows.withColumn("at", F.row_number().over(W.orderBy(*order)).cast("long"))


@query(f"WITH {_NAMES} SELECT name FROM f WHERE p_partkey % 5 IN (1, 3) AND p_partkey % 7 > 0")
def transcode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what cannot be played and is not in the cache's listing."""
    f = listing(spark, sf_dir)
    return ordering.to_transcode(f, f.where("p_partkey % 7 = 0"), ["mp3", "wav"]).select("name")


@query("""SELECT s_suppkey AS id, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END, lower(s_name), s_suppkey::VARCHAR) AS at FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 2 = 0 OR s_suppkey % 7 > 0""")
def audio_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, O4"""
    k = F.col("s_suppkey")
    d = read(spark, sf_dir, "supplier").select(k.alias("id"), k.cast("string").alias("mac"), F.when(k % 7 > 0, F.col("s_name")).alias("name"), F.when(k % 5 == 0, "audio-card").otherwise("phone").alias("icon"), (k % 2 == 0).alias("paired"), (k % 3 == 0).alias("connected"), F.col("s_name").alias("full"))
    return ranked(ordering.audio_devices(d), F.desc("connected"), F.desc("paired"), F.lower("full"), F.col("mac")).select("id", "at")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 5 IN (1, 2) THEN 2 WHEN p_size % 5 = 3 THEN 3 ELSE 4 END AS quality_rank FROM part WHERE p_partkey % 3 <> 1""")
def voice_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed or bundled voices with their rank; a missing quality is medium, an unknown one last."""
    k = F.col("p_size") % 5
    q = F.when(k == 0, "high").when(k == 1, "medium").when(k == 3, "low").when(k == 4, "x_low")
    v = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), q.alias("quality"), F.when(F.col("p_partkey") % 3 == 0, True).alias("installed"), (F.col("p_partkey") % 3 == 2).alias("bundled"))
    return ordering.by_quality(ordering.usable_voices(v)).select("id", ordering.quality_rank(F.col("quality")).alias("quality_rank"))


@query("SELECT coalesce(CASE WHEN n_regionkey > 0 THEN 'l' || n_regionkey END, 'other') AS language, list(n_name ORDER BY n_name) AS ids FROM nation GROUP BY 1")
def voice_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15"""
    n = read(spark, sf_dir, "nation")
    return statistics.voices_by_language(n.select(F.when(F.col("n_regionkey") > 0, say("l%d", "n_regionkey")).alias("language"), F.col("n_name").alias("id")))


@query("""WITH g AS (SELECT l_suppkey::VARCHAR AS key, l_linenumber AS ord, min(l_quantity) AS start_time, sum(l_quantity) AS dur FROM lineitem GROUP BY 1, 2), p AS (SELECT l_suppkey::VARCHAR AS key, l_linenumber AS cur_ord, l_extendedprice / 100 AS t, l_orderkey FROM lineitem),
j AS (SELECT p.*, sum(CASE WHEN ord < cur_ord THEN dur WHEN ord = cur_ord THEN greatest(0, least(t - start_time, dur)) ELSE 0 END) AS pos, sum(dur) AS total FROM p JOIN g USING (key) GROUP BY ALL)
SELECT l_orderkey, key, cur_ord, t, greatest(0, least(pos, total)) AS position, total FROM j""")
def chapter_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a supplier's chapter, points at its line items."""
    l = read(spark, sf_dir, "lineitem").withColumn("key", F.col("l_suppkey").cast("string"))
    seg = l.groupBy("key", F.col("l_linenumber").alias("ord")).agg(F.min("l_quantity").alias("start_time"), F.sum("l_quantity").alias("dur"))
    pts = l.select("l_orderkey", "key", F.col("l_linenumber").alias("cur_ord"), (F.col("l_extendedprice") / 100).alias("t")).distinct()
    return timelines.chapter_progress(seg, pts, ["key"])
