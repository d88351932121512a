"""Queries over text tables. Each has the Spark plan and, where SQL can say it, DuckDB SQL of the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions import paths, text, times
from lectern.operators import lookups, matching, statistics, timelines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Only a local session may lack that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return f"{root.rstrip('/')}/lectern-{tag}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """Write rows that a plan reads several times, and reread them."""
    path = scratch(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# DuckDB forms of the column functions, for the oracles.
P = r"!-/:-@\[-`{-~"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def sql_normal(c: str, table: str, key: str) -> str:
    """CTEs ending in n(key, t): normalized text."""
    return rf"""
n0 AS (SELECT {key}, regexp_replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F]', '', 'g'), '\n[ \t]*\n+', chr(1), 'g') AS t FROM {table}),
n1 AS (SELECT {key}, {TRIM.format(rf"regexp_replace(replace(replace(regexp_replace(t, '([^\s{P}])-\n([^\s{P}])', '\1\2', 'g'), chr(10), ' '), chr(1), chr(10)), '[ \t]+', ' ', 'g')")} AS t FROM n0),
n2 AS (SELECT {key}, t, list_filter(string_split(t, chr(10)), lambda x: x <> '') AS l FROM n1),
n AS (SELECT {key}, CASE WHEN len(l) > 5 AND len(list_filter(l, lambda x: strlen(x) <= 2)) > 0.5 * len(l) THEN replace(t, chr(10), ' ') ELSE t END AS t FROM n2)"""


def sql_sentences(key: str) -> str:
    """CTE s(key, idx, text, end_type) of n."""
    return rf"""
sl AS (SELECT {key}, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS ln FROM n),
sp AS (SELECT {key}, ln, list_filter(list_transform(string_split(regexp_replace(line, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS p FROM sl),
sx AS (SELECT {key}, ln, len(p) AS n, unnest(p) AS text, unnest(range(len(p))) AS i FROM sp),
s AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY ln, i) AS idx, text, CASE WHEN i = n - 1 THEN 'paragraph' ELSE 'sentence' END AS end_type FROM sx)"""


def sql_words(c: str, table: str, key: str) -> str:
    """CTE w(key, idx, text, clean_text)."""
    clean = rf"regexp_replace(x, '^[{P}]+|[{P}]+$', '', 'g')"
    return rf"""
wt AS (SELECT {key}, list_filter(string_split_regex({TRIM.format(c)}, '\s+'), lambda x: {clean} <> '') AS p FROM {table}),
wx AS (SELECT {key}, unnest(p) AS x, unnest(range(len(p))) + 1 AS idx FROM wt),
w AS (SELECT {key}, idx, x AS text, {clean} AS clean_text FROM wx)"""


def sql_syllables(c: str) -> str:
    low = LOWER.format(c)
    n = f"len(regexp_extract_all({low}, '[aeiouy]+'))"
    return f"greatest(1, {n} - CASE WHEN {low} LIKE '%e' AND {n} > 1 THEN 1 ELSE 0 END)"


def sentence_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, text, end_type)."""
    s = text.sentences(text.normalize(F.col("text")))
    return docs.select(key, F.posexplode(s).alias("i", "s")).select(key, (F.col("i") + 1).cast("long").alias("idx"), "s.text", "s.end_type")


def word_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, text, clean_text)."""
    return docs.select(key, F.posexplode(text.words(F.col("text"))).alias("i", "w")).select(key, (F.col("i") + 1).cast("long").alias("idx"), "w.text", "w.clean_text")


def timed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, start_time, end_time) in ms."""
    w = word_rows(docs).withColumn("d", times.word_ms(text.syllables(F.col("clean_text"))))
    return timelines.running_times(w, ["doc_id"], ["idx"], "d").select("doc_id", "idx", "start_time", "end_time")


SQL_TIMED = rf"""{sql_words('text', 'documents', 'doc_id')},
wd AS (SELECT doc_id, idx, floor({sql_syllables('clean_text')} * 200)::BIGINT AS d FROM w),
tw AS (SELECT doc_id, idx, coalesce(sum(d + 50) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_time, d FROM wd),
timed AS (SELECT doc_id, idx, start_time, start_time + d AS end_time FROM tw)"""
SQL_POINTS = """pe AS (SELECT d.doc_id, coalesce(max(end_time), 0) AS e FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN timed ON timed.doc_id = d.doc_id GROUP BY d.doc_id),
pt AS (SELECT doc_id, unnest(range(11)) * ((e + 6000) // 10) - 1000 AS t FROM pe)"""


def timed_and_points(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The timed words, written once, as index; and eleven times of each document, from a second before its words to some
    seconds past their end."""
    timed = stored(timed_words(docs), "timed").withColumnRenamed("idx", "index")
    ends = timed.groupBy("doc_id").agg(F.max("end_time").alias("e"))
    at = docs.select("doc_id").distinct().join(ends, "doc_id", "left").withColumn("step", F.expr("(coalesce(e, 0) + 6000) div 10"))
    return timed, stored(at.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"), "step").select("doc_id", (F.col("k") * F.col("step") - 1000).alias("t")), "points")


@query(rf"""WITH {sql_normal('text', 'documents', 'doc_id')}, {sql_sentences('doc_id')},
c AS (SELECT doc_id, count(*) AS sentences FROM s GROUP BY doc_id), {sql_words('t', 'n', 'doc_id')},
k AS (SELECT doc_id, count(*) AS words, sum({sql_syllables('clean_text')})::BIGINT AS syllables FROM w GROUP BY doc_id)
SELECT k.doc_id, sentences, words, syllables, (syllables * 200 + (words - 1) * 50)::BIGINT AS estimated_ms FROM k JOIN c USING (doc_id)""")
def reading_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, words, syllables and estimated time of each document. Words are exploded so that the syllable
    patterns run in generated code; a document's words meet in its own task, so the shuffle carries a row for each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("t"))
    # both are computed below the explode: beside it, the sentences would be cut anew for every word
    d = docs.select("doc_id", F.size(text.sentences(F.col("t"))).cast("long").alias("sentences"), text.clean_words(F.col("t")).alias("w"))
    w = d.select("doc_id", "sentences", F.explode("w").alias("w"))
    r = w.groupBy("doc_id", "sentences").agg(F.count("*").alias("words"), F.sum(text.syllables(F.col("w")).cast("long")).alias("syllables"))
    return r.withColumn("estimated_ms", F.col("syllables") * 200 + (F.col("words") - 1) * 50)


@query(f"WITH {sql_normal('text', 'documents', 'doc_id')}, {sql_sentences('doc_id')} SELECT * FROM s")
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(read(spark, sf_dir, "documents"))


@query(f"WITH c AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations), {sql_normal('text', 'c', 'turn_id')}, {sql_sentences('turn_id')} SELECT * FROM s")
def turn_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return sentence_rows(c, "turn_id")


SQL_OFFSETS = f"""{sql_normal('text', 'documents', 'doc_id')}, {sql_sentences('doc_id')},
sp2 AS (SELECT s.doc_id, any_value(n.t) AS t, list(s.text ORDER BY idx) AS parts FROM s JOIN n USING (doc_id) GROUP BY s.doc_id),
so AS (SELECT doc_id, parts, list_reduce(list_prepend({{'t': '', 'at': 1::BIGINT, 'o': []::STRUCT(s BIGINT, e BIGINT)[]}}, list_transform(parts, lambda x: {{'t': x, 'at': 1::BIGINT, 'o': []::STRUCT(s BIGINT, e BIGINT)[]}})),
  lambda a, x: CASE WHEN strpos(substr(t, a.at), x.t) > 0 THEN {{'t': '', 'at': a.at + strpos(substr(t, a.at), x.t) - 1 + length(x.t), 'o': list_append(a.o, {{'s': a.at + strpos(substr(t, a.at), x.t) - 1, 'e': a.at + strpos(substr(t, a.at), x.t) - 2 + length(x.t)}})}}
  ELSE {{'t': '', 'at': a.at, 'o': list_append(a.o, {{'s': 0::BIGINT, 'e': 0::BIGINT}})}} END).o AS o FROM sp2),
off AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS idx, unnest(parts) AS text, unnest(o).s AS start_pos, unnest(o).e AS end_pos FROM so)"""


@query(f"WITH {SQL_OFFSETS} SELECT doc_id, idx, text, start_pos, end_pos FROM off")
def sentence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their character positions in the normalized text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("t"))
    s = docs.withColumn("parts", F.transform(text.sentences(F.col("t")), lambda x: x["text"]))
    both = s.select("doc_id", F.posexplode(F.arrays_zip("parts", text.locate_all(F.col("t"), F.col("parts")).alias("pos"))).alias("i", "z"))
    return both.select("doc_id", (F.col("i") + 1).cast("long").alias("idx"), F.col("z.parts").alias("text"), F.col("z.pos.start_pos").cast("long").alias("start_pos"), F.col("z.pos.end_pos").cast("long").alias("end_pos"))


@query(f"WITH {sql_words('text', 'documents', 'doc_id')} SELECT * FROM w")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_rows(read(spark, sf_dir, "documents"))


@query(f"WITH {sql_words('text', 'documents', 'doc_id')} SELECT clean_text, count(*) AS n, ({sql_syllables('clean_text')})::BIGINT AS syllables FROM w GROUP BY clean_text")
def word_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables once for each distinct word, after counting."""
    n = word_rows(read(spark, sf_dir, "documents")).groupBy("clean_text").agg(F.count("*").alias("n"))
    return n.withColumn("syllables", text.syllables(F.col("clean_text")).cast("long"))


@query(rf"""SELECT doc_id, {TRIM.format(r"regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '\s+', ' ', 'g'), '[\x{2018}-\x{201B}]', chr(39), 'g'), '[\x{201C}-\x{201F}\x{AB}\x{BB}]', '" + '"' + r"', 'g'), '[\x{2013}\x{2014}]', '-', 'g'), '\x{2026}', '...', 'g'), chr(160), ' '), '[\x{AD}\x{200B}\x{2029}\x{FEFF}]', '', 'g'), '''''+', chr(39), 'g')")} AS form FROM documents""")
def match_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.match_form(F.col("text")).alias("form"))


@query(f"WITH {SQL_TIMED} SELECT * FROM timed")
def estimated_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_words(read(spark, sf_dir, "documents"))


@query(rf"""WITH {sql_words('text', 'documents', 'doc_id')},
d AS (SELECT doc_id, idx, (strlen(regexp_replace(text, '[{P}]', '', 'g')) * 80 + CASE WHEN regexp_matches(text, '[,;:]$') THEN 150 WHEN regexp_matches(text, '[.?!]$') THEN 200 ELSE 0 END)::BIGINT AS d FROM w),
r AS (SELECT doc_id, idx, d, coalesce(sum(d + 30) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_time FROM d)
SELECT doc_id, idx, start_time, start_time + d AS end_time FROM r""")
def neural_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_rows(read(spark, sf_dir, "documents"))
    d = w.withColumn("d", times.neural_word_ms(F.col("text"), F.lit(1)))
    return timelines.running_times(d, ["doc_id"], ["idx"], "d", gap=30).select("doc_id", "idx", "start_time", "end_time")


SQL_CLAUSES = r"""
c AS (SELECT doc_id, idx, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([;:]) ', '\1' || chr(1), 'g'), ' - ', ' -' || chr(1), 'g'), ', (""" + "|".join(text.CONJUNCTIONS) + r""")(\s|$)', ',' || chr(1) || '\1\2', 'g'), chr(1)), lambda x: """ + TRIM.format("x") + r"""), lambda x: x <> '') AS p FROM s)"""


@query(f"WITH {sql_normal('text', 'documents', 'doc_id')}, {sql_sentences('doc_id')}, {SQL_CLAUSES} SELECT doc_id, idx, unnest(p) AS clause, unnest(range(len(p)))::BIGINT AS part FROM c")
def clause_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentence_rows(read(spark, sf_dir, "documents"))
    return s.select("doc_id", "idx", F.posexplode(text.clauses(F.col("text"))).alias("part", "clause")).withColumn("part", F.col("part").cast("long"))


@query(rf"""WITH {sql_normal('text', 'documents', 'doc_id')}, {sql_sentences('doc_id')}, {SQL_CLAUSES},
m AS (SELECT doc_id, idx, list_reduce(list_prepend([]::VARCHAR[], list_transform(p, lambda x: [x])), lambda a, x: CASE WHEN strlen(x[1]) < 80 AND len(a) > 0 THEN list_append(a[1:len(a) - 1], a[len(a)] || ' ' || x[1]) ELSE list_append(a, x[1]) END) AS p FROM c)
SELECT doc_id, idx, CASE WHEN len(p) > 1 AND strlen(p[1]) < 80 THEN list_prepend(p[1] || ' ' || p[2], p[3:]) ELSE p END AS chunks FROM m""")
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentence_rows(read(spark, sf_dir, "documents"))
    return s.select("doc_id", "idx", text.merge_short(text.clauses(F.col("text"))).alias("chunks"))


SQL_LONG = rf"""{sql_normal('text', 'documents', 'doc_id')}, {sql_sentences('doc_id')}, {SQL_CLAUSES},
mm AS (SELECT doc_id, idx, list_reduce(list_prepend([]::VARCHAR[], list_transform(p, lambda x: [x])), lambda a, x: CASE WHEN strlen(x[1]) < 80 AND len(a) > 0 THEN list_append(a[1:len(a) - 1], a[len(a)] || ' ' || x[1]) ELSE list_append(a, x[1]) END) AS p FROM c),
mf AS (SELECT s.doc_id, s.idx, end_type, CASE WHEN strlen(text) <= 300 THEN [text] WHEN len(p) > 1 AND strlen(p[1]) < 80 THEN list_prepend(p[1] || ' ' || p[2], p[3:]) ELSE p END AS chunks FROM s JOIN mm USING (doc_id, idx)),
mx AS (SELECT doc_id, idx, end_type, unnest(chunks) AS x, unnest(range(len(chunks))) AS k, len(chunks) AS nk FROM mf),
mw AS (SELECT *, string_split(x, ' ') AS w FROM mx),
mr AS (SELECT doc_id, idx, end_type, k, CASE WHEN strlen(x) <= 300 THEN [x] ELSE list_reduce(list_transform(range(1, len(w) + 1), lambda i: {{'o': [w[i]], 'z': strlen(w[i]), 'f': strlen(array_to_string(w[i:], ' ')) <= 300}}),
  lambda a, y: CASE WHEN a.f OR a.z + 1 + y.z <= 299 THEN {{'o': list_append(a.o[1:len(a.o) - 1], a.o[len(a.o)] || ' ' || y.o[1]), 'z': a.z + 1 + y.z, 'f': a.f}} ELSE {{'o': list_append(a.o, y.o[1]), 'z': y.z, 'f': y.f}} END).o END AS o FROM mw),
mj AS (SELECT doc_id, idx, end_type, k, CASE WHEN len(o) > 1 AND strlen(o[len(o)]) < 80 THEN list_append(o[1:len(o) - 2], o[len(o) - 1] || ' ' || o[len(o)]) ELSE o END AS o FROM mr),
ma AS (SELECT doc_id, idx, any_value(end_type) AS end_type, flatten(list(o ORDER BY k)) AS o FROM mj GROUP BY doc_id, idx),
lc AS (SELECT doc_id, idx, unnest(range(1, len(o) + 1))::INT AS part, unnest(o) AS chunk, end_type AS e, len(o) AS no FROM ma)"""


@query(f"WITH {SQL_LONG} SELECT doc_id, idx, part, chunk, CASE WHEN part = no THEN e ELSE 'sentence' END AS end_type FROM lc")
def long_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences over 300 bytes as chunks; the last chunk inherits how the sentence ends."""
    s = sentence_rows(read(spark, sf_dir, "documents"))
    c = s.withColumn("chunks", text.split_long(F.col("text"))).withColumn("n", F.size("chunks"))
    e = c.select("doc_id", "idx", "n", "end_type", F.posexplode("chunks").alias("part", "chunk"))
    return e.select("doc_id", "idx", (F.col("part") + 1).alias("part"), "chunk", F.when(F.col("part") == F.col("n") - 1, F.col("end_type")).otherwise("sentence").alias("end_type"))


@query(f"WITH {SQL_LONG} SELECT doc_id, idx, part AS chunk_index, chunk, CASE WHEN part = no THEN e ELSE 'sentence' END AS end_type FROM lc")
def long_sentence_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same split by a lateral join with the table function."""
    spark.udtf.register("lectern_long_split", text.LongSplit)
    sentence_rows(read(spark, sf_dir, "documents")).createOrReplaceTempView("lectern_sentences")
    return spark.sql("SELECT s.doc_id, s.idx, c.chunk_index, c.chunk, c.end_type FROM lectern_sentences s, LATERAL lectern_long_split(s.text, s.end_type, 300) c")


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
r AS (SELECT doc_id, list_reduce(list_transform(w, lambda x: {'o': [x], 'z': strlen(x)}), lambda a, x: CASE WHEN a.z + 1 + x.z <= 200 THEN {'o': list_append(a.o[1:len(a.o) - 1], a.o[len(a.o)] || ' ' || x.o[1]), 'z': a.z + 1 + x.z} ELSE {'o': list_append(a.o, x.o[1]), 'z': x.z} END).o AS o FROM w WHERE len(w) > 0)
SELECT doc_id, unnest(range(len(o)))::INT AS part, unnest(o) AS line FROM r""")
def wrapped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(text.wrapped(F.col("text"), F.lit(200))).alias("part", "line"))


@query(r"""SELECT page_id, regexp_replace(html, '>\s+<', '><', 'g') AS html, md5(url) AS url_md5, regexp_extract(url, '([^/]+)$', 1) AS base FROM pages""")
def compact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", text.compact_markup(F.col("html")).alias("html"), paths.digest(F.col("url")).alias("url_md5"), paths.basename(F.col("url")).alias("base"))


@query(r"""WITH b AS (SELECT page_id, list_transform(regexp_extract_all(hex(url), '..'), lambda h: ('0x' || h)::BIGINT) AS v FROM pages)
SELECT page_id, 'pos_' || lower(lpad(hex(list_reduce(list_prepend(5381::BIGINT, v), lambda a, x: (a * 33 + x) % 4294967296)), 8, '0')) AS key FROM b""")
def position_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", paths.position_key(F.col("url")).alias("key"))


@query(r"""SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f KB', n_chars / 1024) END AS size_text,
(n_chars // 60) || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') AS minutes,
CASE WHEN n_chars >= 3600 THEN (n_chars // 3600) || ':' || lpad((n_chars % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') ELSE (n_chars // 60) || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') END AS clock,
CASE WHEN n_chars >= 3600 THEN (n_chars // 3600) || 'h ' || lpad((n_chars % 3600 // 60)::VARCHAR, 2, '0') || 'm' ELSE (n_chars // 60) || 'm' END AS hours FROM documents""")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return read(spark, sf_dir, "documents").select("doc_id", times.size_text(n).alias("size_text"), times.minutes_text(n).alias("minutes"), times.clock_text(n).alias("clock"), times.hours_text(n).alias("hours"))


@query(r"""WITH v(s, seconds, chapter) AS (VALUES ('0:00:05.234', 5.234, 5.234), ('1:02', 62.0, 62.0), ('25.180s', 25.18, 25.18), ('300ms', 0.3, 300.0), ('2.5min', 150.0, 2.5), ('1.5h', 5400.0, 1.5), ('7.5', 7.5, 7.5), ('abc', 0.0, NULL), (NULL, 0.0, NULL))
SELECT s, seconds::DOUBLE AS seconds, chapter::DOUBLE AS chapter FROM v""")
def clock_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.sql("SELECT * FROM VALUES ('0:00:05.234'), ('1:02'), ('25.180s'), ('300ms'), ('2.5min'), ('1.5h'), ('7.5'), ('abc'), (NULL) AS v(s)")
    return v.select("s", F.round(times.markup_clock_s(F.col("s")), 9).alias("seconds"), times.chapter_clock_s(F.col("s")).alias("chapter"))


@query(r"""SELECT * FROM (VALUES ('MO/../Audio/x.mp3', 'Audio/x.mp3', false), ('a/b/../../c', 'c', false), ('../x', '../x', false), ('../../x', 'x', false), ('./a', 'a', false), ('a/b/c', 'a/b/c', true)) v(p, path, valid)""")
def path_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.sql("SELECT * FROM VALUES ('MO/../Audio/x.mp3'), ('a/b/../../c'), ('../x'), ('../../x'), ('./a'), ('a/b/c') AS v(p)")
    return v.select("p", paths.collapse_path(F.col("p")).alias("path"), paths.valid_member(F.col("p")).alias("valid"))


@query("SELECT * FROM (VALUES ('0.1.17', '0.1.17.0', 0), ('0.1.9', '0.1.10', -1), ('1.2', '1.1.9', 1), ('2', '2.0.0.1', -1)) v(a, b, r)")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.sql("SELECT * FROM VALUES ('0.1.17', '0.1.17.0'), ('0.1.9', '0.1.10'), ('1.2', '1.1.9'), ('2', '2.0.0.1') AS v(a, b)")
    return v.select("a", "b", times.compare_versions(F.col("a"), F.col("b")).alias("r"))


@query(rf"""WITH {sql_normal('text', 'documents', 'doc_id')}, {sql_sentences('doc_id')},
z AS (SELECT doc_id, strlen(text) AS n FROM s)
SELECT doc_id, count(*) AS sentences, sum(n)::BIGINT AS chars, min(n)::BIGINT AS min_len, max(n)::BIGINT AS max_len, round(avg(n), 6) AS avg_len, quantile_disc(n, 0.5)::BIGINT AS median_len FROM z GROUP BY doc_id""")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = statistics.document_statistics(sentence_rows(read(spark, sf_dir, "documents")), "doc_id")
    return d.select("doc_id", "sentences", "chars", F.col("min_len").cast("long"), F.col("max_len").cast("long"), F.round("avg_len", 6).alias("avg_len"), F.col("median_len").cast("long"))


@query(f"""WITH {SQL_TIMED}, {SQL_POINTS} SELECT pt.doc_id, t, min(timed.idx) AS index FROM pt LEFT JOIN timed ON timed.doc_id = pt.doc_id AND t >= start_time AND t < end_time GROUP BY pt.doc_id, t""")
def word_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed, points = timed_and_points(read(spark, sf_dir, "documents"))
    return lookups.at_time(points, timed, "doc_id", "t", width=5000).select("doc_id", "t", "index")


@query(f"""WITH {SQL_TIMED}, {SQL_POINTS}, f AS (SELECT doc_id, min_by(idx, start_time) AS i0 FROM timed GROUP BY doc_id),
a AS (SELECT pt.doc_id, t, timed.idx FROM pt ASOF LEFT JOIN timed ON pt.doc_id = timed.doc_id AND t >= start_time)
SELECT a.doc_id, t, coalesce(idx, i0) AS index FROM a LEFT JOIN f ON f.doc_id = a.doc_id""")
def sentence_asof_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed, points = timed_and_points(read(spark, sf_dir, "documents"))
    return lookups.active_sentence(points, timed, "doc_id", "t", width=20000)


@query(f"""WITH {SQL_TIMED}, {SQL_POINTS},
d AS (SELECT pt.doc_id, t, idx, CASE WHEN t >= start_time AND t < end_time THEN -1 ELSE least(abs(t - start_time), abs(t - end_time)) END AS dist FROM pt LEFT JOIN timed ON timed.doc_id = pt.doc_id)
SELECT doc_id, t, arg_min(idx, (dist, idx)) AS index FROM d GROUP BY doc_id, t""")
def nearest_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed, points = timed_and_points(read(spark, sf_dir, "documents"))
    return lookups.nearest_word(points, timed, "doc_id", "t", width=20000)


@query(f"""WITH {sql_normal('text', 'documents', 'doc_id')}, {sql_sentences('doc_id')}, {sql_words('t', 'n', 'doc_id')},
j AS (SELECT w.doc_id, w.idx, w.text, s.text AS sentence FROM w LEFT JOIN s USING (doc_id, idx)) SELECT * FROM j""")
def ordinal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th word with the i-th sentence, NULL past the last sentence."""
    docs = read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("text"))
    s = sentence_rows(docs).select("doc_id", F.col("idx").alias("k"), F.col("text").alias("sentence"))
    return lookups.by_ordinal(word_rows(docs).drop("clean_text"), s, ["doc_id"], ["idx"], ["k"], ["sentence"])


@query(f"""WITH {SQL_OFFSETS}, wq AS (SELECT doc_id, string_split(replace(t, chr(10), ' '), ' ') AS w FROM n), wx2 AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM wq),
wp AS (SELECT doc_id, i, word, (sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS end_pos FROM wx2),
wz AS (SELECT doc_id, i, word, end_pos - length(word) + 1 AS start_pos, end_pos FROM wp WHERE word <> '')
SELECT wz.doc_id, i::INT AS word_index, word, wz.end_pos, wz.start_pos, min(idx) AS sentence_index FROM wz LEFT JOIN off ON off.doc_id = wz.doc_id AND off.start_pos <= wz.start_pos AND wz.end_pos <= off.end_pos GROUP BY ALL""")
def words_to_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a document with the sentence whose positions hold it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("text"))
    parts = F.transform(text.sentences(F.col("text")), lambda x: x["text"])
    return lookups.text_words_in_sentences(docs.withColumn("spans", text.locate_all(F.col("text"), parts)))


@query(rf"""WITH {sql_normal('text', 'documents', 'doc_id')}, {sql_sentences('doc_id')},
q AS (SELECT doc_id, idx AS sel_id, substr({TRIM.format(r"regexp_replace(text, '\s+', ' ', 'g')")}, 3, 60) AS sel FROM s WHERE idx % 5 = 2),
qs AS (SELECT doc_id, sel_id, {TRIM.format('sel')} AS sel FROM q),
e AS (SELECT doc_id, idx AS seq, {TRIM.format(r"regexp_replace(text, '\s+', ' ', 'g')")} AS entry FROM s),
x AS (SELECT qs.doc_id, sel_id, seq, CASE WHEN entry = sel THEN 10000 WHEN contains(entry, sel) THEN 5000 + least(strlen(sel), 200) WHEN contains(sel, entry) THEN 4000 + least(strlen(entry), 200)
  WHEN contains(entry, substr(sel, 1, 80)) THEN 2000 + least(strlen(substr(sel, 1, 80)), 80) WHEN contains(substr(sel, 1, 80), substr(entry, 1, 40)) THEN 1000 ELSE 0 END AS score
  FROM qs JOIN e USING (doc_id) WHERE sel <> '' AND entry <> '')
SELECT doc_id, sel_id, arg_max(seq, (score, -seq)) AS seq, max(score)::BIGINT AS score FROM x GROUP BY doc_id, sel_id""")
def scored_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth sentence, without its ends, matched with the sentences of its document."""
    s = sentence_rows(read(spark, sf_dir, "documents"))
    sel = s.where("idx % 5 = 2").select("doc_id", F.col("idx").alias("sel_id"), F.substring(text.collapse_space(F.col("text")), 3, 60).alias("text"), F.lit(None).cast("string").alias("fragment_id"))
    entries = s.select("doc_id", F.col("idx").alias("seq"), "text", F.lit(None).cast("string").alias("fragment_id"))
    return matching.best_match(sel, entries, "doc_id").withColumn("score", F.col("score").cast("long"))


@query()
def scored_match_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole sentence matched with the sentences of its document; scored_match does so for a part of them."""
    s = sentence_rows(read(spark, sf_dir, "documents")).withColumn("fragment_id", F.lit(None).cast("string"))
    sel = s.select("doc_id", F.col("idx").alias("sel_id"), "text", "fragment_id")
    entries = s.select("doc_id", F.col("idx").alias("seq"), "text", "fragment_id")
    return matching.whole_match(sel, entries, "doc_id").withColumn("score", F.col("score").cast("long"))


@query(r"""SELECT doc_id, regexp_replace(translate(text, chr(10) || chr(13), '  '), '\x{2026}|\.\.+', ', ', 'g') AS speech, regexp_replace(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', ''), '>', ''), '([,;:])\s', '\1 <break time="150ms"/> ', 'g'), '([\x{2013}\x{2014}])', '\1<break time="150ms"/>', 'g') AS ssml FROM documents""")
def speech_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", text.speech_text(c).alias("speech"), text.clause_breaks(c).alias("ssml"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en-US' WHEN 'zh' THEN 'zh-CN' WHEN 'ja' THEN 'ja-JP' WHEN 'ko' THEN 'ko-KR' ELSE lang END AS speak FROM documents")
def chunk_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.chunk_language(F.col("text"), F.col("lang")).alias("speak"))
