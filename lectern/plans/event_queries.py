"""Queries over events, orders and turns: journals, timelines, statistics. DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import lookups, ordering, progress, statistics, timelines
from lectern.plans.text_queries import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# Events read as a journal: users are items, values are positions.
SQL_JOURNAL = "j AS (SELECT user_id AS item_id, event_id AS seq, epoch(date_trunc('minute', ts))::BIGINT AS ts, value AS position, event_type IN (SELECT min(event_type) FROM events) AS synced FROM events)"


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    first = e.agg(F.min("event_type")).first()[0]
    ts = F.unix_timestamp(F.date_trunc("minute", F.col("ts").cast("timestamp")))
    return e.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), ts.alias("ts"), F.col("value").alias("position"), (F.col("event_type") == F.lit(first)).alias("synced"))


# Events read as synthesis samples of a strategy.
SQL_SAMPLES = "m AS (SELECT event_type AS strategy, event_id AS seq, (100 + event_id * 37 % 900)::BIGINT AS synth_ms, (200 + event_id * 53 % 1500)::BIGINT AS duration_ms, (10 + event_id % 90)::BIGINT AS text_len, (2 + event_id % 17)::BIGINT AS words, (event_id % 1000)::BIGINT AS mem_kb FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), i.alias("seq"), (100 + i * 37 % 900).alias("synth_ms"), (200 + i * 53 % 1500).alias("duration_ms"), (10 + i % 90).alias("text_len"), (2 + i % 17).alias("words"), (i % 1000).alias("mem_kb"))


@query(f"WITH {SQL_JOURNAL} SELECT item_id, arg_max(seq, (ts, seq)) AS seq, arg_max(position, (ts, seq)) AS position FROM j WHERE NOT synced GROUP BY item_id")
def latest_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.to_flush(journal(spark, sf_dir)).select("item_id", "seq", "position")


@query(f"WITH {SQL_JOURNAL} SELECT synced OR item_id IN (SELECT item_id FROM j WHERE NOT synced) AS synced, count(*) AS n FROM j GROUP BY 1")
def flushed_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = journal(spark, sf_dir).withColumn("synced_at", F.lit(None).cast("long"))
    return progress.after_flush(j, progress.to_flush(j), F.lit(1).cast("long")).groupBy("synced").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {SQL_JOURNAL}, o AS (SELECT item_id, seq, coalesce(position, 0) AS p, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS rn FROM j),
f AS (SELECT item_id, rn, seq, p AS last, true AS kept FROM o WHERE rn = 1 UNION ALL
  SELECT o.item_id, o.rn, o.seq, CASE WHEN abs(f.last - o.p) >= 5 THEN o.p ELSE f.last END, abs(f.last - o.p) >= 5 FROM f JOIN o ON o.item_id = f.item_id AND o.rn = f.rn + 1)
SELECT item_id, seq, last AS position FROM f WHERE kept""")
def debounced_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.debounced(journal(spark, sf_dir), "item_id", ["seq"], "position")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def journal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: the last ten of each user."""
    return progress.newest(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def orphan_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.keep_known(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.keep_known(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id", keep=False)


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def labelled_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.flagged(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id", "labelled")


@query("""WITH l AS (SELECT c_custkey AS k, count(o_orderkey) AS p, max(o_orderkey) AS t FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0 GROUP BY 1),
r AS (SELECT c_custkey AS k, count(o_orderkey) AS p, max(o_orderkey) AS t FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(l.k, r.k) AS item_id, CASE WHEN r.p IS NOT NULL AND (l.p IS NULL OR coalesce(r.t, 0) > coalesce(l.t, 0)) THEN r.p ELSE l.p END AS position,
CASE WHEN r.p IS NOT NULL AND (l.p IS NULL OR coalesce(r.t, 0) > coalesce(l.t, 0)) THEN 'remote' ELSE 'local' END AS winner FROM l FULL JOIN r ON l.k = r.k""")
def newer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two devices' progress: customers' even and odd orders."""
    o = read(spark, sf_dir, "orders")
    side = lambda odd: o.where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("item_id")).agg(F.count("*").alias("position"), F.max("o_orderkey").alias("ts"))
    return lookups.merge_progress(side(0), side(1))


@query("""WITH x AS (SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN vec_id * 2 END AS l, CASE WHEN vec_id % 5 > 0 THEN vec_id * 3 END AS r, vec_id % 2 = 0 AS s FROM embeddings)
SELECT vec_id, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN CASE WHEN s THEN r ELSE l END ELSE coalesce(l, r) END AS best, CASE WHEN r > 30 AND (l IS NULL OR abs(r - l) > 60) THEN r ELSE l END AS resume FROM x""")
def position_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    x = read(spark, sf_dir, "embeddings").select("vec_id", F.when(v % 3 > 0, v * 2).alias("l"), F.when(v % 5 > 0, v * 3).alias("r"), (v % 2 == 0).alias("s"))
    return x.select("vec_id", lookups.best_position(F.col("l"), F.col("r"), F.col("s")).alias("best"), lookups.start_position(F.col("l"), F.col("r")).alias("resume"))


@query("""WITH o AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS before, sum(n_chars) OVER () AS total FROM documents)
SELECT doc_id, n_chars FROM o WHERE before < total - total // 2""")
def evict_to_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest documents that go for the rest to be half of all characters."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    half = docs.agg(F.sum("n_chars")).first()[0] // 2
    return progress.evicted(docs, "n_chars", "doc_id", ["doc_id"], half)


@query("""SELECT o_orderkey, count(*) AS files, sum(CASE WHEN l_linenumber % 3 > 0 THEN l_partkey ELSE 0 END)::BIGINT AS audio_bytes, min(CASE WHEN l_linenumber % 3 > 0 THEN 1 ELSE 0 END) = 1 AS complete FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def cache_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, their lines as files; every third line number is missing from the listing."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    name = F.concat_ws("/", "id", "l_linenumber", "l_partkey", "l_suppkey")
    items = li.groupBy("id").agg(F.flatten(F.collect_list(F.array_repeat(name, F.col("n").cast("int")))).alias("files"), F.lit(0).alias("cover_bytes"))
    listing = li.where("l_linenumber % 3 > 0").select(name.alias("path"), F.col("l_partkey").alias("bytes"))
    whole = progress.complete_items(items, listing).select("id", F.lit(True).alias("complete"))
    return progress.cache_bytes(items, listing).join(whole, "id", "left").select(F.col("id").alias("o_orderkey"), F.size("files").cast("long").alias("files"), "audio_bytes", F.coalesce("complete", F.lit(False)).alias("complete"))


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return r.agg(statistics.nearest_rank("l_quantity", 50).alias("p50"), statistics.nearest_rank("l_quantity", 95).alias("p95"))


SQL_STATS = f"""WITH {SQL_SAMPLES}, g AS (SELECT *, greatest(0, synth_ms - lag(duration_ms) OVER (PARTITION BY strategy ORDER BY seq)) AS gap, lag(duration_ms) OVER (PARTITION BY strategy ORDER BY seq) AS before FROM m),
h AS (SELECT *, CASE WHEN before IS NOT NULL THEN gap END AS gap_ms FROM g),
st AS (SELECT strategy, count(*) AS sentences_total, sum(synth_ms)::BIGINT AS total_synthesis_ms, sum(duration_ms)::BIGINT AS total_audio_duration_ms, arg_min(synth_ms, seq) AS cold_start_ms, avg(synth_ms) AS avg_synth_ms,
quantile_disc(synth_ms, 0.5) AS median_synth_ms, quantile_disc(synth_ms, 0.95) AS p95_synth_ms, coalesce(avg(gap_ms), 0) AS avg_gap_ms, coalesce(max(gap_ms), 0) AS max_gap_ms, coalesce(quantile_disc(gap_ms, 0.95), 0) AS p95_gap_ms,
sum(text_len)::BIGINT AS total_chars, sum(words)::BIGINT AS total_words, max(mem_kb) AS peak_memory_kb, sum(duration_ms) / sum(synth_ms) AS realtime_factor, sum(text_len) * 1000 / sum(synth_ms) AS throughput_chars_per_sec, sum(words) * 1000 / sum(synth_ms) AS throughput_words_per_sec FROM h GROUP BY strategy)"""


@query(f"{SQL_STATS} SELECT * REPLACE (round(avg_synth_ms, 6) AS avg_synth_ms, round(avg_gap_ms, 6) AS avg_gap_ms, round(realtime_factor, 6) AS realtime_factor, round(throughput_chars_per_sec, 6) AS throughput_chars_per_sec, round(throughput_words_per_sec, 6) AS throughput_words_per_sec) FROM st")
def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.run_statistics(samples(spark, sf_dir), ["strategy"], ["seq"])
    return s.withColumns({c: F.round(c, 6) for c in ("avg_synth_ms", "avg_gap_ms", "realtime_factor", "throughput_chars_per_sec", "throughput_words_per_sec")})


@query(f"""{SQL_STATS} SELECT 'realtime_factor' AS measure, arg_min(strategy, (-realtime_factor, strategy)) AS best, round(max(realtime_factor), 6) AS value FROM st
UNION ALL SELECT 'max_gap_ms', arg_min(strategy, (max_gap_ms, strategy)), min(max_gap_ms) FROM st UNION ALL SELECT 'cold_start_ms', arg_min(strategy, (cold_start_ms, strategy)), min(cold_start_ms) FROM st
UNION ALL SELECT 'throughput_chars_per_sec', arg_min(strategy, (-throughput_chars_per_sec, strategy)), round(max(throughput_chars_per_sec), 6) FROM st""")
def arg_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.run_statistics(samples(spark, sf_dir), ["strategy"], ["seq"])
    return statistics.best_runs(s, "strategy").withColumn("value", F.round("value", 6))


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER w AS rn, avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round(CASE WHEN rn >= 3 THEN a END, 6) AS rtf FROM r""")
def rolling_rtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return timelines.rolling_mean(e, ["user_id"], ["event_id"], "value", "rtf").select("user_id", "event_id", F.round("rtf", 6).alias("rtf"))


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 7 >= 4 AS bad FROM events),
f AS (SELECT *, min(CASE WHEN bad THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS first FROM o),
s AS (SELECT *, max(CASE WHEN bad AND n >= first + 3 THEN 1 END) OVER (PARTITION BY user_id ORDER BY n) AS second FROM f)
SELECT user_id, event_id, CASE WHEN second = 1 THEN 2 WHEN first IS NOT NULL THEN 1 ELSE 0 END AS stage FROM s""")
def degrade_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7 / 3.0).alias("rtf"))
    return statistics.degrade_stage(e, ["user_id"], ["event_id"], "rtf").select("user_id", "event_id", "stage")


@query(f"""WITH {SQL_SAMPLES}, b AS (SELECT *, (row_number() OVER (PARTITION BY strategy ORDER BY seq) - 1) // 3 + 1 AS batch_id FROM m)
SELECT strategy, seq, batch_id, floor(sum(duration_ms) OVER w * (text_len / greatest(1, sum(text_len) OVER w)))::BIGINT AS batch_duration_ms, floor(sum(synth_ms) OVER w / count(*) OVER w)::BIGINT AS batch_synth_ms FROM b WINDOW w AS (PARTITION BY strategy, batch_id)""")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines.fixed_batches(samples(spark, sf_dir), ["strategy"], ["seq"], 3).select("strategy", "seq", "batch_id", "batch_duration_ms", "batch_synth_ms")


@query(f"""WITH RECURSIVE {SQL_SAMPLES}, o AS (SELECT strategy, seq, text_len, row_number() OVER (PARTITION BY strategy ORDER BY seq) AS rn FROM m),
f AS (SELECT strategy, seq, rn, text_len AS used, 1::BIGINT AS n FROM o WHERE rn = 1 UNION ALL
  SELECT o.strategy, o.seq, o.rn, CASE WHEN used + text_len <= 500 THEN used + text_len ELSE text_len END, CASE WHEN used + text_len <= 500 THEN n ELSE n + 1 END FROM f JOIN o ON o.strategy = f.strategy AND o.rn = f.rn + 1)
SELECT strategy, seq, n AS "group" FROM f""")
def adaptive_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines.fold_groups(samples(spark, sf_dir), "strategy", ["seq"], "text_len", 500)


@query(f"""WITH {SQL_SAMPLES}, t AS (SELECT strategy, seq, words, 1000003::BIGINT AS total, sum(words) OVER (PARTITION BY strategy ORDER BY seq) AS upto, sum(words) OVER (PARTITION BY strategy) AS whole, row_number() OVER (PARTITION BY strategy ORDER BY seq DESC) AS back FROM m)
SELECT strategy, seq, (floor(floor(total * (upto - words) / whole) / 2) * 2)::BIGINT AS start_byte, CASE WHEN back = 1 THEN total ELSE (floor(floor(total * upto / whole) / 2) * 2)::BIGINT END AS end_byte FROM t""")
def cut_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("total", F.lit(1000003))
    return timelines.cut_offsets(s, ["strategy"], ["seq"], "words", "total").select("strategy", "seq", "start_byte", "end_byte")


@query(f"""WITH {SQL_SAMPLES}, g AS (SELECT *, lag(duration_ms) OVER (PARTITION BY strategy ORDER BY seq) AS b FROM m)
SELECT strategy, arg_min(synth_ms, seq) AS first_ms, sum(duration_ms)::BIGINT AS audio_ms, sum(CASE WHEN b IS NOT NULL THEN greatest(0, synth_ms - b) ELSE 0 END)::BIGINT AS gap_ms, (arg_min(synth_ms, seq) + sum(duration_ms) + sum(CASE WHEN b IS NOT NULL THEN greatest(0, synth_ms - b) ELSE 0 END))::BIGINT AS wall_ms FROM g GROUP BY strategy""")
def effective_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines.effective_gaps(samples(spark, sf_dir), ["strategy"], ["seq"])


@query()
def playback_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines.simulate_playback(samples(spark, sf_dir), servers=2, depth=2)


@query("""WITH b AS (SELECT *, last_value(role IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM conversations)
SELECT conv_id, turn, role FROM b WHERE role IS NOT NULL AND (was IS NULL OR role <> was)""")
def role_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines.change_points(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "role")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS start_time, coalesce(lead(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey), l_extendedprice + 300) AS end_time FROM lineitem""")
def chapter_fill_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("start_time"), F.lit(None).cast("double").alias("end_time"))
    return timelines.fill_ends(li, ["l_orderkey"], ["start_time", "l_linenumber", "l_partkey"])


@query("""WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)), p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = (SELECT max(event_type) FROM events))
SELECT p.event_id, (SELECT arg_max(c.event_id, (c.ts, c.event_id)) FROM c WHERE c.user_id = p.user_id AND c.ts <= p.ts) AS latest FROM p""")
def event_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event of the last type, the user's latest event of the first type."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    lo, hi = e.agg(F.min("event_type"), F.max("event_type")).first()
    e = e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    right = e.where(F.col("event_type") == lo).select("user_id", F.col("event_id").alias("latest"), "t")
    return lookups.asof(e.where(F.col("event_type") == hi).select("user_id", "event_id", "t"), right, ["user_id"], "t", "t", ["latest"], ["latest"], width=86_400e6).select("event_id", "latest")


@query("SELECT event_type, count(*) FILTER (WHERE user_id % 4 = 0) AS queued, count(*) FILTER (WHERE user_id % 4 = 1) AS pending, count(*) FILTER (WHERE user_id % 4 = 2) AS ready, count(*) FILTER (WHERE user_id % 4 = 9) AS failed FROM events GROUP BY event_type")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 4
    e = read(spark, sf_dir, "events").withColumn("status", F.when(u == 0, "queued").when(u == 1, "pending").when(u == 2, "ready"))
    return statistics.status_counts(e, "status", keys=["event_type"])


@query("SELECT event_type AS engine, count(*) FILTER (WHERE event_id % 9 > 0) AS ok, count(*) FILTER (WHERE event_id % 9 = 0) AS failed, round(sum(event_id % 13) FILTER (WHERE event_id % 9 > 0) / nullif(sum(event_id % 17) FILTER (WHERE event_id % 9 > 0), 0), 6) AS rt FROM events GROUP BY 1")
def engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), (i % 13).alias("synth_ms"), (i % 17).alias("wav_ms"), (i * 32).alias("wav_bytes"), F.when(i % 9 == 0, "x").alias("error"))
    return statistics.engine_summary(e).select("engine", "ok", "failed", F.round("rt", 6).alias("rt"))


@query("""WITH m AS (SELECT user_id, event_id, avg((event_id % 100) / greatest(1, event_id % 4)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 1000 AS a FROM events) SELECT user_id, event_id, round(a, 9) AS avg_synth_s FROM m""")
def mean_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (i % 100).alias("synth_ms"), (i % 4).alias("n"))
    return statistics.mean_sentence_synthesis(e, ["user_id"], ["event_id"]).select("user_id", "event_id", F.round("avg_synth_s", 9).alias("avg_synth_s"))


@query("""WITH c AS (SELECT l_orderkey AS book, l_suppkey % 3 AS file, l_linenumber AS seq, l_partkey, l_quantity AS start_time, CASE WHEN l_linenumber % 2 = 0 THEN 'a' END AS text_doc, 't' || (l_linenumber % 3) AS title FROM lineitem)
SELECT book, coalesce(text_doc, title) AS chapter_key, min(seq) AS seq FROM c GROUP BY 1, 2""")
def first_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    c = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), n.alias("seq"), F.when(n % 2 == 0, "a").alias("text_doc"), F.concat(F.lit("t"), (n % 3).cast("string")).alias("title"))
    return statistics.first_seen_chapters(c, ["book"]).select("book", "chapter_key", "seq")


@query("""SELECT user_id, event_id, coalesce(lag(event_id) OVER w, event_id) AS previous_event_id, lead(event_id) OVER w AS next_event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return lookups.neighbours(e, ["user_id"], ["ts", "event_id"], "event_id").drop("ts")


@query("""WITH g AS (SELECT user_id, event_id, event_id % 3 AS gen, event_id % 50 AS idx FROM events), s AS (SELECT *, max((gen, idx)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g)
SELECT user_id, event_id FROM s WHERE seen IS NULL OR (gen, idx) > seen""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (i % 3).alias("gen"), (i % 50).alias("idx"))
    return timelines.higher_than_seen(e, ["user_id"], ["event_id"], "idx", "gen").select("user_id", "event_id")


@query("SELECT c_custkey, c_name, (2 + 1) * 50 < (SELECT count(*) FROM customer) AS has_next FROM customer ORDER BY lower(c_name), c_custkey LIMIT 50 OFFSET 100")
def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the page."""
    return ordering.page(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), [F.lower("c_name"), F.col("c_custkey")], 2)


@query("SELECT doc_id, strlen(text) AS bytes FROM documents WHERE strlen(text) BETWEEN 300 AND 2000")
def length_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.byte_length_between(read(spark, sf_dir, "documents"), "text", 300, 2000).select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT user_id, count(*) AS events, least(100.0, count(*) / 60 * 100) AS percent FROM events GROUP BY user_id")
def reading_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    return n.withColumn("percent", statistics.reading_percent(F.col("events"), F.lit(60)))


@query("SELECT source, min(doc_id) AS first_seq, count(*) AS n, row_number() OVER (ORDER BY min(doc_id), source) AS file_order FROM documents GROUP BY source")
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.by_file(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id").withColumn("file_order", F.col("file_order").cast("long"))
