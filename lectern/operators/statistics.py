"""Aggregates over chapters, benchmark runs, queues and documents. Percentiles are nearest-rank, 0 over nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.operators.timelines import gaps

STATUSES = ["queued", "pending", "ready", "failed"]
BEST = {"realtime_factor": max, "max_gap_ms": min, "cold_start_ms": min, "throughput_chars_per_sec": max}


def nearest_rank(c: str, p: float) -> Column:
    return F.coalesce(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {c})"), F.lit(0))


def ratio(a: Column, b: Column, none: Column | None = None) -> Column:
    """a / b; 0, or the given value, where b is 0 or NULL."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0) if none is None else none)


def by_file(rows: DataFrame, file: str = "audio_path", seq: str = "seq") -> DataFrame:
    """Files in the order of their first row, with how many rows each has."""
    g = rows.groupBy(file).agg(F.min(seq).alias("first_seq"), F.count("*").alias("n"))
    return g.withColumn("file_order", F.row_number().over(W.orderBy("first_seq", file)))  # a row for each file


def first_seen_chapters(chapters: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The first row of each document, or title where there is no document."""
    key = F.coalesce("text_doc", "title")
    rest = [c for c in chapters.columns if c not in keys]
    g = chapters.where(key.isNotNull()).groupBy(*keys, key.alias("chapter_key")).agg(F.min_by(F.struct(*rest), seq).alias("__r"))
    return g.select(*keys, "chapter_key", *[F.col("__r").getField(c).alias(c) for c in rest])


def chapter_segments(chapters: DataFrame, entries: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Each chapter row with its end and length: the next start in its file, else the end (or start) of the file's last
    entry of that document, else a second on; 0.1 s at least."""
    nxt = F.lead("start_time").over(W.partitionBy(*keys, "audio_path").orderBy(seq))
    last = entries.groupBy(*keys, "audio_path", "text_doc").agg(F.max_by(F.coalesce("end_time", "start_time"), "seq").alias("last_end"))
    j = chapters.withColumn("__next", nxt).join(last, [*keys, "audio_path", "text_doc"], "left")
    end = F.coalesce("__next", "last_end", F.col("start_time") + 1)
    return j.withColumn("end_time", end).withColumn("dur", F.greatest(F.lit(0.1), F.col("end_time") - F.col("start_time"))).drop("__next", "last_end")


def chapter_lengths(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.groupBy(*keys, F.coalesce("text_doc", "title").alias("chapter_key")).agg(F.sum("dur").alias("duration"), F.count("*").alias("segments"))


def run_statistics(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Totals, means, percentiles, gaps and throughput of synthesis rows (synth_ms, duration_ms, text_len, words,
    mem_kb). realtime_factor is audio over synthesis, more is better."""
    g = gaps(rows, keys, order).groupBy(*keys).agg(
        F.count("*").alias("sentences_total"),
        F.sum("synth_ms").alias("total_synthesis_ms"),
        F.sum("duration_ms").alias("total_audio_duration_ms"),
        F.min_by("synth_ms", F.struct(*order)).alias("cold_start_ms"),
        F.avg("synth_ms").alias("avg_synth_ms"),
        nearest_rank("synth_ms", 50).alias("median_synth_ms"),
        nearest_rank("synth_ms", 95).alias("p95_synth_ms"),
        F.coalesce(F.avg("gap_ms"), F.lit(0.0)).alias("avg_gap_ms"),
        F.coalesce(F.max("gap_ms"), F.lit(0)).alias("max_gap_ms"),
        nearest_rank("gap_ms", 95).alias("p95_gap_ms"),
        F.sum("text_len").alias("total_chars"),
        F.sum("words").alias("total_words"),
        F.max(F.coalesce("mem_kb", F.lit(0))).alias("peak_memory_kb"),
    )
    synth = F.col("total_synthesis_ms")
    return g.withColumns({
        "realtime_factor": ratio(F.col("total_audio_duration_ms"), synth),
        "throughput_chars_per_sec": ratio(F.col("total_chars") * 1000, synth),
        "throughput_words_per_sec": ratio(F.col("total_words") * 1000, synth),
    })


def best_runs(stats: DataFrame, name: str) -> DataFrame:
    """The best run by each measure; the first by name of equals."""
    picks = []
    for measure, how in BEST.items():
        order = F.col(measure) if how is min else -F.col(measure)
        picks.append(F.struct(F.lit(measure).alias("measure"), F.min_by(name, F.struct(order, name)).alias("best"), (F.min if how is min else F.max)(measure).cast("double").alias("value")))
    return stats.agg(F.array(*picks).alias("__p")).select(F.inline("__p"))


def long_totals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of long sentences cut into chunks (keys, sentence, order, synth_ms, duration_ms, text_len): the mean time to a
    sentence's first chunk, sums, characters a second of synthesis and the real-time factor."""
    one = rows.groupBy(*keys, "sentence").agg(F.min_by("synth_ms", F.struct(*order)).alias("first_ms"), F.sum("synth_ms").alias("s"), F.sum("duration_ms").alias("a"), F.sum("text_len").alias("c"))
    g = one.groupBy(*keys).agg(F.count("*").alias("sentences"), F.avg("first_ms").alias("avg_first_ms"), F.sum("s").alias("synth_ms"), F.sum("a").alias("audio_ms"), F.sum("c").alias("chars"))
    return g.withColumn("realtime_factor", ratio(F.col("audio_ms"), F.col("synth_ms"))).withColumn("chars_per_s", ratio(F.col("chars") * 1000, F.col("synth_ms")))


def by_strategy(rows: DataFrame, names: list[str], sentence: str = "sentence", strategy: str = "strategy", value: str = "synth_ms") -> DataFrame:
    """A row for each sentence and a column for each named strategy: the sum of a value, NULL where it did not run."""
    return rows.groupBy(sentence).pivot(strategy, names).agg(F.sum(value))


def table_count(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """How many rows there are, in all or for each key; 0 over nothing."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")) if keys else rows.agg(F.count("*").alias("n"))


def engine_summary(rows: DataFrame, key: str = "engine") -> DataFrame:
    """Totals of device runs (synth_ms, wav_ms, wav_bytes, error); rt is synthesis over audio, NULL where either is 0."""
    ok = F.col("error").isNull()
    g = rows.groupBy(key).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.col("synth_ms"))).alias("synth_ms"), F.sum(F.when(ok, F.col("wav_ms"))).alias("wav_ms"), F.max(F.when(ok, F.col("synth_ms"))).alias("max_synth_ms"), F.sum(F.when(ok, F.col("wav_bytes"))).alias("wav_bytes"))
    return g.withColumn("rt", F.nullif(F.col("synth_ms"), F.lit(0)) / F.nullif(F.col("wav_ms"), F.lit(0)))


def status_counts(rows: DataFrame, status: str, names: list[str] = STATUSES, keys: list[str] = ()) -> DataFrame:
    """How many rows have each status, zeros kept."""
    aggs = [F.count_if(F.col(status) == s).alias(s) for s in names]
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def document_statistics(sentences: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Counts and lengths in bytes of each document's sentences."""
    n = sentences.withColumn("__n", F.octet_length(text))
    return n.groupBy(key).agg(F.count("*").alias("sentences"), F.sum("__n").alias("chars"), F.min("__n").alias("min_len"), F.max("__n").alias("max_len"), F.avg("__n").alias("avg_len"), nearest_rank("__n", 50).alias("median_len"))


def quoted_sentences(text: Column) -> Column:
    """A plainer split for statistics: a double quote ends a sentence as well."""
    parts = F.split(F.regexp_replace(text, r'([.?!"])\s+', "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def voices_by_language(voices: DataFrame) -> DataFrame:
    """Languages and their voices, both sorted; voices without one are `other`. A voice list is small and bounded."""
    return voices.groupBy(F.coalesce("language", F.lit("other")).alias("language")).agg(F.array_sort(F.collect_set("id")).alias("ids")).orderBy("language")


def mean_sentence_synthesis(samples: DataFrame, keys: list[str], order: list[str], last: int = 6) -> DataFrame:
    """Mean seconds of synthesis a sentence over the last samples, each a batch of n."""
    over = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - last, 0)
    return samples.withColumn("avg_synth_s", F.avg(F.col("synth_ms") / F.greatest(F.lit(1), F.col("n"))).over(over) / 1000)


def words_in_time(words: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Word times inside a sentence (start_s, end_s, text_len): its seconds are shared by bytes of words over bytes of
    the sentence. Spaces and punctuation count in the whole, so the words do not fill the sentence."""
    share = F.octet_length("word") / F.col("text_len") * (F.col("end_s") - F.col("start_s"))
    over = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = words.withColumn("__share", share).withColumn("__upto", F.sum("__share").over(over))
    return rows.withColumn("word_start_s", F.col("start_s") + F.col("__upto") - F.col("__share")).withColumn("word_end_s", F.col("start_s") + F.col("__upto")).drop("__share", "__upto")


def chunk_profiles(rows: DataFrame, key: str) -> DataFrame:
    """Audio over synthesis for each target size or model; a chunk's synthesis counts once."""
    chunks = rows.groupBy(key, "chunk").agg(F.max("synth_ms").alias("s"), F.max("duration_ms").alias("a"), F.max("text_len").alias("c"))
    return chunks.groupBy(key).agg(F.sum("a").alias("audio_ms"), F.sum("s").alias("synth_ms"), F.sum("c").alias("chars")).withColumn("realtime_factor", ratio(F.col("audio_ms"), F.col("synth_ms"))).withColumn("chars_per_s", ratio(F.col("chars") * 1000, F.col("synth_ms")))


def reading_percent(index: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(100.0), index / total * 100))


def counters(events: DataFrame, keys: list[str], kinds: list[str], kind: str = "type") -> DataFrame:
    """All events, and those of each kind."""
    return events.groupBy(*keys).agg(F.count("*").alias("events"), *[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def degrade_stage(samples: DataFrame, keys: list[str], order: list[str], rtf: str, threshold: float = 1.2, window: int = 3) -> DataFrame:
    """The ladder of mitigations over rolling speeds: stage 1 from the first sample at the threshold or above, stage 2
    from the first such sample that comes `window` or more samples after it."""
    over = W.partitionBy(*keys).orderBy(*order)
    rows = samples.withColumn("__n", F.row_number().over(over)).withColumn("__bad", F.col(rtf) >= threshold)
    first = F.min(F.when(F.col("__bad"), F.col("__n"))).over(over.rowsBetween(W.unboundedPreceding, 0))
    second = F.max(F.when(F.col("__bad") & (F.col("__n") >= F.col("__first") + window), 1)).over(over.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__first", first)
    return rows.withColumn("stage", F.when(second == 1, 2).when(F.col("__first").isNotNull(), 1).otherwise(0)).drop("__n", "__bad", "__first")


def abandoned(*, fallbacks: Column, samples: Column, waited_s: Column, most: int = 30, patience_s: int = 120) -> Column:
    """A session gives up after `most` fallbacks, or with no sample after `patience_s` seconds."""
    return (fallbacks >= most) | ((samples == 0) & (waited_s >= patience_s))
