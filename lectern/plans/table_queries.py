"""Queries over lookups, texts, statistics, timelines, orders and streams. DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import paths, text, times
from lectern.operators import lookups, matching, ordering, progress, statistics, timelines
from lectern.operators.strategies import Strategies
from lectern.plans.book_queries import say
from lectern.plans.event_queries import SQL_SAMPLES, samples
from lectern.plans.text_queries import TRIM, read, scratch, sentence_rows, sql_normal, sql_sentences
from lectern.streaming import progress as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# Texts and keys.


@query("""SELECT conv_id, turn, '{"text":' || to_json(coalesce(text, ''))::VARCHAR || ',"speaker":' || to_json(role)::VARCHAR || ',"n":' || turn || '}' AS line FROM conversations""")
def speech_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13"""
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.speech_json(F.coalesce("text", F.lit("")), speaker=F.col("role"), n=F.col("turn")).alias("line"))


@query("SELECT user_id, event_id, event_id || ':' || epoch(date_trunc('second', ts))::BIGINT AS fingerprint FROM events")
def cache_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T24"""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", "event_id", paths.fingerprint(F.col("event_id"), F.col("ts").cast("timestamp")).alias("fingerprint"))


@query("""WITH RECURSIVE c AS (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda x: unicode(x)::BIGINT) AS b FROM part),
h AS (SELECT p_partkey, b, 0 AS i, 0::BIGINT AS v FROM c UNION ALL SELECT p_partkey, b, i + 1, (v * 31 + b[i + 1]) % 4294967296 FROM h WHERE i < len(b))
SELECT p_partkey, printf('%08x', v) AS hash FROM h WHERE i = len(b)""")
def plain_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash that stands in where md5 is not wanted."""
    return read(spark, sf_dir, "part").select("p_partkey", paths.digest(F.col("p_name"), strong=False).alias("hash"))


@query("SELECT c_custkey, '/home/<user>/books/' || c_custkey || '.epub and /home/<user>' AS path, '/a/' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/b' END AS folder FROM customer")
def scrubbed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T28, T29"""
    c = read(spark, sf_dir, "customer")
    folder = F.concat(F.lit("//a///"), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "/").otherwise("//b/"))
    return c.select("c_custkey", paths.scrub_home(F.concat(F.lit("/home/"), F.col("c_name"), say("/books/%d.epub and /home/x", "c_custkey"))).alias("path"), paths.normal_folder(folder).alias("folder"))


@query("SELECT p_partkey, p_partkey % 3 <> 2 AS same, 'new ' || replace(replace(replace(p_name, 'a', 'e'), 'e', 'o'), 'old ', 'new ') AS replaced FROM part")
def message_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders in any order; replacements one after another."""
    p = read(spark, sf_dir, "part")
    other = F.when(F.col("p_partkey") % 3 == 0, "%2 of %1").when(F.col("p_partkey") % 3 == 1, "%1 and %2").otherwise("%1 and %1")
    pairs = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in (("a", "e"), ("e", "o"), ("old ", "new "))])
    return p.select("p_partkey", text.same_placeholders(F.lit("%1, %2"), other).alias("same"), F.concat(F.lit("new "), text.replace_in_order(F.col("p_name"), pairs)).alias("replaced"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 8 AS v FROM lineitem),
n AS (SELECT *, len(list_filter(range(1, 65), lambda i: v > pow(2, i))) AS o, len(list_filter(range(1, 65), lambda i: v < pow(0.5, i))) AS u FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(v - 1) < 0.01 THEN 0 ELSE o + u + 1 END AS n, CASE WHEN abs(v - 1) >= 0.01 THEN v / pow(2, o) / pow(0.5, u) END AS rest FROM n""")
def speed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T38"""
    f = times.speed_factors(F.col("l_quantity") / 8)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.size(f).alias("n"), F.try_element_at(f, F.lit(-1)).alias("rest"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ja-JP' WHEN 1 THEN 'ko-KR' WHEN 2 THEN CASE WHEN event_id % 4 < 2 THEN 'zh-CN' ELSE 'zh-TW' END WHEN 3 THEN 'fr-CA' WHEN 4 THEN 'en-US' ELSE 'xx' END AS speak FROM events""")
def script_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kana, hangul and Han by script, the override, the book's tag, the default."""
    k = F.col("event_id") % 6
    chunk = F.when(k == 0, "これはa").when(k == 1, "한국어").when(k == 2, "中文").otherwise("words")
    tag = F.when(k == 2, F.when(F.col("event_id") % 4 < 2, "zh").otherwise("zh_TW")).when(k == 3, "de").when(k == 4, F.lit(None)).when(k == 5, "XX")
    over = F.when(k == 3, "fr-CA")
    return read(spark, sf_dir, "events").select("event_id", text.chunk_language(F.concat("event_type", chunk), tag, over).alias("speak"))


_SPECIAL = "MAP {" + ", ".join(f"'{bytes([b]).decode('cp1252')}': '{b:02X}'" for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) + "}"


@query(f"""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 128 OR unicode(c) BETWEEN 160 AND 255 THEN printf('%02X', unicode(c)) ELSE coalesce({_SPECIAL}[c], '3F') END), '')) AS md5 FROM documents WHERE text <> ''""")
def windows_1252(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes, as hex digits."""
    return read(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.md5(F.hex(text.cp1252(F.col("text")))).alias("md5"))


@query(rf"""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.?!"])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents)
SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS md5 FROM p GROUP BY doc_id""")
def quoted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14"""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", statistics.quoted_sentences(F.col("text")).alias("s")).where("size(s) > 0")
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("md5"))


def _collapsed(c: str, times_: int = 8) -> str:
    for _ in range(times_):
        c = rf"regexp_replace({c}, '[^/]+/\.\./', '')"
    return rf"regexp_replace({c}, '^(\./)+', '')"


@query(f"""WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages), u AS (SELECT page_id, unnest(l) AS href, unnest(range(len(l))) AS seq FROM h)
SELECT page_id, seq::INT AS seq, href, {_collapsed("'a/b/../' || href")} AS path FROM u""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, resolved below a folder."""
    p = read(spark, sf_dir, "pages")
    h = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("seq", "href"))
    return h.withColumn("path", paths.collapse_path(F.concat(F.lit("a/b/../"), "href")))


_HOW = [("exact", "sel", "true"), *[(f"prefix{k}", f"substr(sel, 1, {k})", f"length(sel) > {k}") for k in (40, 20, 10)], *[(f"suffix{k}", f"right(sel, {k})", f"length(sel) > {k}") for k in (40, 20, 10)]]
_HOW += [*[(f"words{k}", f"array_to_string(w[1:{k}], ' ')", "len(w) >= 3") for k in (3, 2)], *[(f"tail{k}", f"array_to_string(w[-{k}:], ' ')", "len(w) >= 3") for k in (3, 2)]]
_POS = " ".join(f"WHEN {ok} AND strpos(page, {part}) > 0 THEN strpos(page, {part})" for _, part, ok in _HOW)
_NAME = " ".join(f"WHEN {ok} AND strpos(page, {part}) > 0 THEN '{how}'" for how, part, ok in _HOW)


@query(rf"""WITH {sql_normal('text', 'documents', 'doc_id')}, {sql_sentences('doc_id')},
j AS (SELECT s.doc_id, idx, s.text AS sel, string_split({TRIM.format(r"regexp_replace(s.text, '\s+', ' ', 'g')")}, ' ') AS w, d.text AS page FROM s JOIN documents d USING (doc_id))
SELECT doc_id, idx, (CASE {_POS} END)::INT AS pos, CASE {_NAME} END AS how FROM j""")
def cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sentence of the normalized text stands in the text as it was, and which try found it."""
    docs = read(spark, sf_dir, "documents")
    s = sentence_rows(docs).join(docs.select("doc_id", F.col("text").alias("page")), "doc_id")
    return s.withColumn("hit", matching.cascade(F.col("page"), F.col("text"))).select("doc_id", "idx", "hit.pos", "hit.how")


# Lookups.


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, index, start_pos, end_pos: pieces of 64 characters of each conversation turn."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("doc", say("%d-%d", "conv_id", "turn"))
    s = c.select("doc", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 64))).alias("index"))
    return s.select("doc", F.col("index").cast("long"), (F.col("index") * 64).cast("long").alias("start_pos"), (F.col("index") * 64 + 64).cast("long").alias("end_pos"))


@query("""WITH c AS (SELECT conv_id || '-' || turn AS doc, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL), x AS (SELECT doc, unnest(w) AS word, unnest(range(len(w))) AS i FROM c),
p AS (SELECT doc, i, word, sum(length(word) + 1) OVER (PARTITION BY doc ORDER BY i) - 1 AS e FROM x), q AS (SELECT doc, i, word, e - length(word) AS s, e FROM p WHERE word <> '')
SELECT doc, i::INT AS word_index, CASE WHEN e <= (s // 64) * 64 + 64 THEN (s // 64)::BIGINT END AS sentence_index FROM q""")
def words_to_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with the span that holds all of it."""
    from pyspark.sql import Window as W

    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("doc", say("%d-%d", "conv_id", "turn"))
    w = c.select("doc", F.posexplode(F.split("text", " ")).alias("word_index", "word"))
    upto = W.partitionBy("doc").orderBy("word_index").rowsBetween(W.unboundedPreceding, 0)
    w = w.withColumn("end_pos", F.sum(F.length("word") + 1).over(upto) - 1).withColumn("start_pos", F.col("end_pos") - F.length("word")).where("word <> ''")
    return lookups.words_in_sentences(w, spans(spark, sf_dir).withColumnRenamed("index", "sentence_index"), "doc").select("doc", "word_index", "sentence_index")


@query("""SELECT conv_id || '-' || turn AS doc, p::BIGINT AS pos, CASE WHEN p <= (length(text) // 64) * 64 + 64 THEN greatest(0, CASE WHEN p % 64 = 0 THEN p // 64 - 1 ELSE p // 64 END)::BIGINT END AS "index"
FROM conversations, (SELECT unnest([0, 1, 63, 64, 65, 128, 500, 100000]) AS p) WHERE text IS NOT NULL""")
def spans_at_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first span that holds a position, ends included."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    pts = c.select(say("%d-%d", "conv_id", "turn").alias("doc"), F.explode(F.array(*[F.lit(p).cast("long") for p in (0, 1, 63, 64, 65, 128, 500, 100000)])).alias("pos"))
    return lookups.at_position(pts, spans(spark, sf_dir), "doc", "pos").select("doc", "pos", "index")


_CHAPTERS = "c AS (SELECT l_suppkey AS doc, l_linenumber AS i, (l_linenumber * 700 + l_suppkey)::DOUBLE AS start_time, CASE WHEN l_linenumber % 3 > 0 THEN 'C' || l_linenumber END AS title FROM lineitem GROUP BY ALL), p AS (SELECT l_suppkey AS doc, l_orderkey, l_linenumber, l_extendedprice / 10 AS t FROM lineitem)"


def chapters_and_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = read(spark, sf_dir, "lineitem")
    c = l.select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("index")).distinct()
    c = c.withColumn("start_time", (F.col("index") * 700 + F.col("doc")).cast("double")).withColumn("title", F.when(F.col("index") % 3 > 0, say("C%d", "index")))
    return c, l.select(F.col("l_suppkey").alias("doc"), "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10).alias("t"))


@query(f"""WITH {_CHAPTERS}, f AS (SELECT doc, arg_min(i, start_time) AS fi FROM c GROUP BY doc), m AS (SELECT p.doc, l_orderkey, l_linenumber, t, max(i) FILTER (WHERE start_time <= t) AS i FROM p JOIN c USING (doc) GROUP BY ALL)
SELECT m.doc, l_orderkey, l_linenumber, t, coalesce(m.i, fi) AS "index", c.title FROM m JOIN f USING (doc) JOIN c ON c.doc = m.doc AND c.i = coalesce(m.i, fi)""")
def chapters_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last chapter that has started, the first before all of them."""
    c, p = chapters_and_points(spark, sf_dir)
    return lookups.chapter_at(p.distinct(), c, "doc", "t", width=2000.0)


@query(f"""WITH {_CHAPTERS}, k AS (SELECT doc, i, start_time, last_value(title IGNORE NULLS) OVER (PARTITION BY doc ORDER BY start_time, i) AS title FROM c), m AS (SELECT p.doc, l_orderkey, l_linenumber, t, max(i) FILTER (WHERE start_time <= t) AS i FROM p JOIN c USING (doc) GROUP BY ALL)
SELECT m.doc, l_orderkey, l_linenumber, t, m.i AS "index", k.title FROM m LEFT JOIN k ON k.doc = m.doc AND k.i = m.i""")
def chapter_titles_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, strict: none before the first; a chapter without a title keeps the title before it."""
    c, p = chapters_and_points(spark, sf_dir)
    return lookups.chapter_at(p.distinct(), c, "doc", "t", strict=True, width=2000.0)


@query("""WITH ch AS (SELECT s_suppkey AS doc, i AS idx, 'a' || (i // 4 + 1) AS audio_path, (i % 4) * 100.0 AS start_time FROM supplier, range(1, 21) r(i)), f AS (SELECT s_suppkey AS doc, 'a' || i AS path, i AS pos FROM supplier, range(1, 6) r(i)),
p AS (SELECT l_suppkey AS doc, 'a' || (l_linenumber % 7 + 1) AS path, l_quantity * 8 AS t, l_orderkey, l_linenumber FROM lineitem), o AS (SELECT p.*, coalesce(pos, 1) AS ord FROM p LEFT JOIN f USING (doc, path)), co AS (SELECT ch.*, coalesce(pos, 0) AS ord FROM ch LEFT JOIN f ON f.doc = ch.doc AND f.path = audio_path)
SELECT o.doc, o.path, o.t, l_orderkey, l_linenumber, coalesce(max(idx) FILTER (WHERE co.ord < o.ord OR (audio_path = path AND start_time <= t + 1)), 1) AS "index" FROM o JOIN co USING (doc) GROUP BY ALL""")
def overlay_chapters_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters over several files."""
    s, l = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "lineitem")
    doc = F.col("s_suppkey").alias("doc")
    ch = s.select(doc, F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i")).select("doc", F.col("i").cast("long").alias("index"), say("a%d", F.floor(F.col("i") / 4) + 1).alias("audio_path"), ((F.col("i") % 4) * 100.0).alias("start_time"))
    files = s.select(doc, F.explode(F.sequence(F.lit(1), F.lit(5))).alias("pos")).withColumn("path", say("a%d", "pos"))
    p = l.select(F.col("l_suppkey").alias("doc"), say("a%d", F.col("l_linenumber") % 7 + 1).alias("path"), (F.col("l_quantity") * 8).alias("t"), "l_orderkey", "l_linenumber").distinct()
    return lookups.overlay_chapter_at(p, ch, files, "doc")


@query("""WITH e AS (SELECT l_suppkey AS book, l_linenumber * 3 AS sp, min(l_orderkey) AS seq FROM lineitem GROUP BY ALL), p AS (SELECT s_suppkey AS book, i AS pos FROM supplier, range(0, 25) r(i)), m AS (SELECT book, pos, min(sp) AS sp FROM p LEFT JOIN e USING (book) WHERE sp >= pos GROUP BY ALL)
SELECT p.book, p.pos::INT AS pos, m.sp AS spine_pos, e.seq FROM p LEFT JOIN m USING (book, pos) LEFT JOIN e ON e.book = p.book AND e.sp = m.sp""")
def resume_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each spine position the first entry at or after it."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), (F.col("l_linenumber") * 3).alias("spine_pos"), F.col("l_orderkey").alias("seq"))
    p = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("book"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("pos"))
    return lookups.resume_entry(p, e)


@query("""WITH n AS (SELECT p_brand AS book, p_name AS t, len(string_split(p_name, ' ')) AS k, min(p_partkey) AS o FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL)
SELECT p_brand AS book, p_partkey AS "index", o AS old_index, CASE WHEN p_partkey % 5 > 0 THEN o * 2.0 END AS start_time, CASE WHEN p_partkey % 5 > 0 THEN o * 2.0 + 1 END AS end_time FROM part LEFT JOIN n ON p_brand = book AND t = p_name""")
def remapped_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences take the times of the first old one with the same words; equal forms with other word counts none."""
    p = read(spark, sf_dir, "part")
    # a lone hyphen between no-break spaces is a word for the split at white space only where it is set off by spaces
    old = p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("index"), F.concat(F.lit(" "), "p_name").alias("text"), (F.col("p_partkey") * 2.0).alias("start_time"), (F.col("p_partkey") * 2.0 + 1).alias("end_time"))
    new = p.select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("index"), F.replace("p_name", F.lit(" "), F.lit("  ")).alias("text"))
    got = matching.remap(old, new).drop("text")
    keep = F.col("index") % 5 > 0
    return got.withColumn("start_time", F.when(keep, F.col("start_time"))).withColumn("end_time", F.when(keep, F.col("end_time")))


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation) WHERE pos = 3 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_7'")
def rows_by_ordinal_and_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J26, J27"""
    n = read(spark, sf_dir, "nation").withColumn("at", F.col("n_nationkey") + 1)
    by_key = lookups.keep_known(n, spark.createDataFrame([("NATION_7",)], "n_name string"), "n_name")
    return lookups.row_at(n, "at", 3).select("n_nationkey", "n_name").unionByName(lookups.row_at(n, "at", 900).select("n_nationkey", "n_name")).unionByName(by_key.select("n_nationkey", "n_name"))


# Filters.


@query("SELECT conv_id, turn FROM conversations WHERE turn IN (0, 2)")
def wanted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4"""
    return ordering.pages_wanted(read(spark, sf_dir, "conversations"), [0, 2], "turn").select("conv_id", "turn")


@query("SELECT event_id, value FROM events WHERE value > 10")
def resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the threshold itself."""
    return ordering.worth_resuming(read(spark, sf_dir, "events").select("event_id", "value"), "value")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-08' - INTERVAL 7 DAY")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10"""
    return progress.stale(read(spark, sf_dir, "orders"), "o_orderdate", F.lit("1998-01-08").cast("timestamp_ntz"), "7 days").select("o_orderkey")


# Statistics.


@query("""WITH c AS (SELECT l_suppkey, 'f' || l_linenumber % 3 AS audio_path, 'd' || l_linenumber AS text_doc, l_linenumber AS seq, l_linenumber * 50.0 AS start_time FROM lineitem GROUP BY ALL),
e AS (SELECT l_suppkey, 'f' || l_linenumber % 3 AS audio_path, 'd' || l_linenumber AS text_doc, arg_max(l_linenumber * 50 + l_quantity, l_orderkey * 100 + l_partkey % 100) AS last_end FROM lineitem GROUP BY ALL),
j AS (SELECT c.*, coalesce(lead(start_time) OVER (PARTITION BY l_suppkey, audio_path ORDER BY seq), last_end, start_time + 1) AS end_time FROM c LEFT JOIN e USING (l_suppkey, audio_path, text_doc))
SELECT l_suppkey, text_doc AS chapter_key, sum(greatest(0.1, end_time - start_time)) AS duration, count(*) AS segments FROM j GROUP BY ALL""")
def chapter_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: chapters over segments of three files."""
    l = read(spark, sf_dir, "lineitem")
    where = ["l_suppkey", say("f%d", F.col("l_linenumber") % 3).alias("audio_path"), say("d%d", "l_linenumber").alias("text_doc")]
    c = l.select(*where, F.lit(None).cast("string").alias("title"), F.col("l_linenumber").alias("seq"), (F.col("l_linenumber") * 50.0).alias("start_time")).distinct()
    e = l.select(*where, (F.col("l_orderkey") * 100 + F.col("l_partkey") % 100).alias("seq"), (F.col("l_linenumber") * 50.0).alias("start_time"), (F.col("l_linenumber") * 50 + F.col("l_quantity")).alias("end_time"))
    return statistics.chapter_lengths(statistics.chapter_segments(c, e, ["l_suppkey"]), ["l_suppkey"])


_LONG = "r AS (SELECT l_returnflag AS strategy, l_orderkey AS sentence, l_linenumber * 1000000 + l_partkey AS seq, (l_quantity * 10)::BIGINT AS synth_ms, l_partkey AS duration_ms, l_suppkey + 1 AS text_len FROM lineitem)"


def long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("strategy"), F.col("l_orderkey").alias("sentence"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"), (F.col("l_quantity") * 10).cast("long").alias("synth_ms"), F.col("l_partkey").alias("duration_ms"), (F.col("l_suppkey") + 1).alias("text_len"))


@query(f"""WITH {_LONG}, s AS (SELECT strategy, sentence, arg_min(synth_ms, (seq, synth_ms)) AS f, sum(synth_ms) AS s, sum(duration_ms) AS a, sum(text_len) AS c FROM r GROUP BY ALL)
SELECT strategy, count(*) AS sentences, avg(f) AS avg_first_ms, sum(s)::BIGINT AS synth_ms, sum(a)::BIGINT AS audio_ms, sum(c)::BIGINT AS chars, sum(a) / sum(s) AS realtime_factor, sum(c) * 1000 / sum(s) AS chars_per_s FROM s GROUP BY strategy""")
def long_sentence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8"""
    return statistics.long_totals(long_rows(spark, sf_dir), ["strategy"], ["seq", "synth_ms"])


@query(f"WITH {_LONG} SELECT sentence, sum(synth_ms) FILTER (WHERE strategy = 'A')::BIGINT AS A, sum(synth_ms) FILTER (WHERE strategy = 'N')::BIGINT AS N, sum(synth_ms) FILTER (WHERE strategy = 'R')::BIGINT AS R FROM r GROUP BY sentence")
def sentences_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each sentence, a column for each strategy."""
    return statistics.by_strategy(long_rows(spark, sf_dir), ["A", "N", "R"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM events UNION ALL SELECT 'none', 0")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key, in all, and of nothing."""
    e = read(spark, sf_dir, "events")
    whole = lambda name, rows: statistics.table_count(rows).select(F.lit(name).alias("event_type"), "n")
    return statistics.table_count(e, ["event_type"]).unionByName(whole(None, e)).unionByName(whole("none", e.where("false")))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS l, strlen(p_name) AS n, p_size::DOUBLE AS s FROM part), x AS (SELECT p_partkey, n, s, unnest(l) AS word, unnest(range(len(l))) AS i FROM w),
y AS (SELECT *, strlen(word) / n * 2.5 AS share FROM x), z AS (SELECT *, sum(share) OVER (PARTITION BY p_partkey ORDER BY i) AS upto FROM y)
SELECT p_partkey, i::INT AS i, word, s + upto - share AS word_start_s, s + upto AS word_end_s FROM z""")
def shared_word_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17"""
    p = read(spark, sf_dir, "part")
    w = p.select("p_partkey", F.octet_length("p_name").alias("text_len"), F.col("p_size").cast("double").alias("start_s"), (F.col("p_size") + 2.5).alias("end_s"), F.posexplode(F.split("p_name", " ")).alias("i", "word"))
    return statistics.words_in_time(w, ["p_partkey"], ["i"]).select("p_partkey", "i", "word", "word_start_s", "word_end_s")


@query("SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18"""
    return statistics.counters(read(spark, sf_dir, "events"), ["user_id"], ["click", "error"], "event_type")


@query("""WITH c AS (SELECT l_returnflag AS model, l_orderkey AS chunk, max(l_partkey) AS s, max(l_quantity) AS a, max(l_suppkey) AS c FROM lineitem GROUP BY ALL)
SELECT model, sum(a) AS audio_ms, sum(s)::BIGINT AS synth_ms, sum(c)::BIGINT AS chars, sum(a) / sum(s) AS realtime_factor, sum(c) * 1000 / sum(s) AS chars_per_s FROM c GROUP BY model""")
def model_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19"""
    l = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("synth_ms"), F.col("l_quantity").alias("duration_ms"), F.col("l_suppkey").alias("text_len"))
    return statistics.chunk_profiles(l, "model")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'error') >= 30 OR (count(*) FILTER (WHERE event_type = 'view') = 0 AND max(event_id) - min(event_id) >= 120) AS gave_up FROM events GROUP BY 1""")
def abandoned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7"""
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("f"), F.count_if(F.col("event_type") == "view").alias("s"), (F.max("event_id") - F.min("event_id")).alias("w"))
    return g.select("user_id", statistics.abandoned(fallbacks=F.col("f"), samples=F.col("s"), waited_s=F.col("w")).alias("gave_up"))


# Timelines.


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id / 100.0 AS t, event_type AS hash, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT user_id, rn, t AS saved, hash AS mark, NULL::DOUBLE AS hold, t, hash, true AS kept, NULL::DOUBLE AS held_s FROM o WHERE rn = 1 UNION ALL
SELECT o.user_id, o.rn, CASE WHEN s THEN saved ELSE o.t END, o.hash, CASE WHEN s THEN coalesce(hold, o.t) END, o.t, o.hash, NOT s, CASE WHEN NOT s AND hold IS NOT NULL AND o.t > hold THEN o.t - hold END
FROM (SELECT f.*, o.t AS ot, o.hash AS oh, o.hash = f.mark AND o.t - f.saved < 5 AS s FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1) f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, t, hash, held_s FROM f WHERE kept""")
def saved_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7"""
    return timelines.frame_holds(read(spark, sf_dir, "events").select("user_id", (F.col("event_id") / 100).alias("t"), F.col("event_type").alias("hash")), "user_id")


@query("""WITH q AS (SELECT l_suppkey AS s, l_linenumber AS i, bool_and(l_partkey % 9 > 0) AS ready FROM lineitem GROUP BY ALL), g AS (SELECT s, min(CASE WHEN NOT ready THEN i END) AS stop, max(i) AS last FROM q WHERE i > 2 GROUP BY s)
SELECT s, least(4, coalesce(stop - 1, last) - 2) AS ready_ahead FROM g""")
def ready_in_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8"""
    q = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("i")).agg(F.min(F.col("l_partkey") % 9 > 0).alias("ready"))
    return timelines.ready_ahead(q, ["s"], "i", "ready", F.lit(2), 4)


@query(f"""WITH RECURSIVE {SQL_SAMPLES}, o AS (SELECT strategy, seq, duration_ms AS d, row_number() OVER (PARTITION BY strategy ORDER BY seq) AS rn FROM m),
f AS (SELECT strategy, seq, rn, d::DOUBLE AS used FROM o WHERE rn = 1 UNION ALL SELECT o.strategy, o.seq, o.rn, used + o.d + 300 FROM f JOIN o ON o.strategy = f.strategy AND o.rn = f.rn + 1 WHERE used + o.d <= 30000)
SELECT strategy, seq, 1::BIGINT AS "group" FROM f""")
def capped_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is played as one, up to 30 s, with a pause after the check."""
    return timelines.fold_groups(samples(spark, sf_dir), "strategy", ["seq"], "duration_ms", 30000, pause=F.lit(300), restart=False)


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS audio, l_linenumber * 10 + l_suppkey % 2 * 0.5 - 10 AS s, CASE WHEN l_linenumber < 7 THEN l_linenumber * 10.0 - 5 END AS e FROM lineitem), b AS (SELECT audio, 0.0 AS p FROM r UNION SELECT audio, s FROM r WHERE s > 0 UNION SELECT audio, e FROM r WHERE e IS NOT NULL),
d AS (SELECT s_suppkey AS audio, 40.0 + s_suppkey % 40 AS p FROM supplier), m AS (SELECT d.audio, coalesce(max(b.p), 0) AS top, any_value(d.p) AS dur FROM d LEFT JOIN b ON b.audio = d.audio GROUP BY d.audio),
a AS (SELECT audio, p FROM b UNION SELECT audio, dur FROM m WHERE dur > top UNION SELECT audio, 0 FROM d)
SELECT audio, count(*) AS n, sum(p) AS total, max(p) AS last FROM a GROUP BY audio""")
def boundaries_of_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13"""
    l = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("audio"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 2 * 0.5 - 10).alias("start_s"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") * 10.0 - 5).alias("end_s")).distinct()
    d = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("audio"), (40.0 + F.col("s_suppkey") % 40).alias("duration_s"))
    b = timelines.silence_boundaries(l, d)
    return b.select("audio", F.explode("boundaries").alias("p")).groupBy("audio").agg(F.count("*").alias("n"), F.sum("p").alias("total"), F.max("p").alias("last"))


@query(f"""WITH {SQL_SAMPLES}, a AS (SELECT strategy, seq, duration_ms AS d, sum(synth_ms) OVER (PARTITION BY strategy ORDER BY seq) AS f, sum(duration_ms) OVER (PARTITION BY strategy ORDER BY seq) AS upto FROM m),
b AS (SELECT *, upto + max(f - (upto - d)) OVER (PARTITION BY strategy ORDER BY seq) AS played FROM a), c AS (SELECT *, greatest(0, f - lag(played) OVER (PARTITION BY strategy ORDER BY seq)) AS gap FROM b)
SELECT strategy, count(*) AS sentences, max(upto)::DOUBLE AS audio_ms, min(f)::DOUBLE AS cold_start_ms, max(f)::DOUBLE AS wall_ms, coalesce(sum(gap), 0)::DOUBLE AS gap_ms, count(*) FILTER (WHERE gap > 0) AS gaps, coalesce(max(gap), 0)::DOUBLE AS max_gap_ms FROM c GROUP BY strategy""")
def playback_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthesizer; more of them in playback_simulation."""
    return timelines.simulate_playback(samples(spark, sf_dir))


# Orders.


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS at FROM orders")
def numeric_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of digits in the order of their numbers, and the place that gives them."""
    from pyspark.sql import Window as W

    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("k"))
    return ordering.numeric_order(o, "k").select("o_orderkey", F.row_number().over(W.orderBy(F.col("k").cast("long"), "o_orderkey")).cast("long").alias("at"))


@query("SELECT c_custkey FROM customer WHERE c_custkey > (SELECT min(c_custkey) FROM customer)")
def without_the_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10"""
    return progress.without_oldest(read(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 20)


@query("SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey = 5 THEN 0 ELSE 1 END, s_name, s_suppkey) AS at FROM supplier")
def moved_to_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row after the move."""
    s = ordering.move_to_front(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == 5, ["s_name", "s_suppkey"])
    return spark.createDataFrame([(r["s_suppkey"], i + 1) for i, r in enumerate(s.select("s_suppkey").toLocalIterator())], "s_suppkey long, at long")


@query("SELECT event_id FROM events WHERE event_type = 'view' ORDER BY event_id LIMIT 40")
def next_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit."""
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "queued").otherwise("ready").alias("status"))
    return ordering.take_queued(e, 40, ["event_id"]).select("event_id")


@query("SELECT event_id AS seq, event_type FROM events")
def shuffled_and_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled with a seed; seq restores the order."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type")
    return timelines.shuffled(e, 7).orderBy("seq").select("seq", "event_type")


@query("""SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS body FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def sorted_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps as JSON with their keys in order."""
    g = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return g.select("user_id", F.to_json(ordering.sorted_map(F.col("m"))).alias("body"))


# Streams, over files that the query writes.


def stream(rows: DataFrame, tag: str, files: int = 4) -> DataFrame:
    """A stream of the rows' files, in their order."""
    path = scratch(rows.sparkSession, tag)
    rows.repartition(files).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def drained(rows: DataFrame, tag: str, schema: str) -> DataFrame:
    """All rows a stream has given once its files are read."""
    spark, out = rows.sparkSession, scratch(rows.sparkSession, tag)
    held = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", held)
    return spark.read.schema(schema).parquet(out)


@query("""WITH s AS (SELECT l_suppkey::VARCHAR AS book, l_linenumber AS i, min(l_linenumber * 700.0 + l_suppkey) AS start_time FROM lineitem GROUP BY ALL), p AS (SELECT l_suppkey::VARCHAR AS book, l_extendedprice / 10 AS t, l_orderkey FROM lineitem)
SELECT p.book, t, l_orderkey, coalesce(max(i) FILTER (WHERE start_time <= t), min(i)) AS "index" FROM p JOIN s USING (book) GROUP BY ALL""")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of positions against the spans of their books."""
    l = read(spark, sf_dir, "lineitem").withColumn("book", F.col("l_suppkey").cast("string"))
    s = l.select("book", F.col("l_linenumber").alias("index"), (F.col("l_linenumber") * 700.0 + F.col("l_suppkey")).alias("start_time")).distinct()
    p = stream(l.select("book", (F.col("l_extendedprice") / 10).alias("t"), "l_orderkey").distinct(), "positions")
    out = scratch(spark, "highlights")
    streams.highlight(p, s, f"{out}-state", lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).awaitTermination()
    return spark.read.parquet(out).select("book", "t", "l_orderkey", "index")


@query("SELECT user_id::VARCHAR AS item_id, max(event_id) AS seq, arg_max(value, event_id) AS position FROM events GROUP BY 1")
def latest_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch merges into the newest version of a table; a batch that comes again changes nothing."""
    from lectern.sources.sinks import current

    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("item_id"), F.col("event_id").alias("seq"), F.col("value").alias("position"))
    path = scratch(spark, "latest")
    for part in range(2):  # a second run over more rows, with some of the first again
        rows = e.where("seq % 3 < 2") if part == 0 else e.where("seq % 3 > 0")
        streams.latest_table(stream(rows, "journal"), path, f"{path}-state{part}", ["item_id"], ["seq"]).awaitTermination()
    return current(spark, path)


@query("""WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS text, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'enqueue' WHEN 1 THEN 'launch' WHEN 2 THEN 'done' WHEN 3 THEN 'fail' ELSE 'consume' END AS ev, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT text, 0::BIGINT AS rn, NULL::BIGINT AS seq, 'none' AS st, false AS made FROM o GROUP BY text UNION ALL
SELECT o.text, o.rn, o.seq, CASE WHEN st IN ('none', 'gone') AND ev = 'enqueue' THEN 'queued' WHEN st = 'queued' AND ev = 'launch' THEN 'pending' WHEN st = 'pending' AND ev = 'done' THEN 'ready' WHEN st = 'pending' AND ev = 'fail' THEN 'failed' WHEN st IN ('ready', 'failed') AND ev = 'consume' THEN 'gone' ELSE st END,
 (st IN ('none', 'gone') AND ev = 'enqueue') OR (st = 'queued' AND ev = 'launch') OR (st = 'pending' AND ev IN ('done', 'fail')) OR (st IN ('ready', 'failed') AND ev = 'consume') FROM f JOIN o ON o.text = f.text AND o.rn = f.rn + 1)
SELECT text, seq, st AS status FROM f WHERE made""")
def queue_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of texts as events drive them."""
    k = F.col("event_id") % 5
    ev = F.when(k == 0, "enqueue").when(k == 1, "launch").when(k == 2, "done").when(k == 3, "fail").otherwise("consume")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("text"), F.col("event_id").alias("seq"), ev.alias("event"))
    return drained(streams.queue_states(stream(rows, "queue", 1)), "states", "text string, seq long, status string")


@query("SELECT DISTINCT user_id::VARCHAR AS session FROM events WHERE value >= 51 AND event_id % 2 = 0")
def finished_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: sessions that are idle a second past their end, once each."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("value").alias("t"), F.lit(50.0).alias("last_end"), (F.col("event_id") % 2 == 0).alias("idle"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    rows = streams.finished(stream(e, "finished"))
    return drained(rows.select("session"), "done", "session string")


# Registry of strategies.


@query("SELECT strategy, count(*) AS n, sum(ms)::BIGINT AS ms FROM (SELECT 'fast' AS strategy, l_linenumber * 10 AS ms FROM lineitem UNION ALL SELECT 'slow', l_linenumber * 30 + 5 FROM lineitem) GROUP BY 1 UNION ALL SELECT 'calls', 3, 2")
def strategy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered strategies over one table; the progress calls are a row of their own."""
    calls: list[tuple[int, int, str]] = []
    known = Strategies()
    known.add("fast", lambda rows: rows.select((F.col("l_linenumber") * 10).alias("ms")))
    known.add("slow", lambda rows: rows.select((F.col("l_linenumber") * 30 + 5).alias("ms")))
    runs = known.run(read(spark, sf_dir, "lineitem"), progress=lambda *x: calls.append(x))
    seen = spark.createDataFrame([("calls", len(calls), calls[-1][1])], "strategy string, n long, ms long")
    return runs.groupBy("strategy").agg(F.count("*").alias("n"), F.sum("ms").alias("ms")).unionByName(seen)
