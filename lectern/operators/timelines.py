"""Timelines: running times, filled ends, gaps, boundaries, batches and cuts."""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from lectern.functions.times import WORD_GAP_MS
from lectern.operators.folds import ordered_fold

UNKNOWN_CHAPTER_S = 300


def running_times(words: DataFrame, keys: list[str], order: list[str], duration: str, gap: int = WORD_GAP_MS) -> DataFrame:
    """start_time is the sum of all durations before and a gap after each; end_time = start_time + duration."""
    over = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(duration) + gap).over(over), F.lit(0)).cast("long")
    return words.withColumn("start_time", start).withColumn("end_time", F.col("start_time") + F.col(duration))


def fill_ends(rows: DataFrame, keys: list[str], order: list[str], start: str = "start_time", end: str = "end_time", last: float = UNKNOWN_CHAPTER_S) -> DataFrame:
    """A missing end is the next row's start, the last row's its start and `last` seconds."""
    nxt = F.lead(start).over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(end, F.coalesce(F.col(end), nxt, F.col(start) + last))


def rolling_mean(samples: DataFrame, keys: list[str], order: list[str], value: str, out: str, n: int = 3, valid: Column | None = None, least: int | None = None) -> DataFrame:
    """Mean of the last n valid samples, NULL until there are `least` (n by default) of them."""
    rows = samples if valid is None else samples.where(valid)
    over = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(out, F.when(F.row_number().over(over) >= (n if least is None else least), F.avg(value).over(over.rowsBetween(1 - n, 0))))


def gaps(rows: DataFrame, keys: list[str], order: list[str], synth: str = "synth_ms", audio: str = "duration_ms") -> DataFrame:
    """gap_ms: how much longer a row's synthesis took than the row before plays; NULL for the first."""
    before = F.lag(audio).over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("gap_ms", F.when(before.isNotNull(), F.greatest(F.lit(0), F.col(synth) - before)))


def effective_gaps(rows: DataFrame, keys: list[str], order: list[str], synth: str = "synth_ms", audio: str = "duration_ms") -> DataFrame:
    """Per key: the first synthesis, all audio, all gaps, and the wall time they add up to."""
    g = gaps(rows, keys, order, synth, audio)
    out = g.groupBy(*keys).agg(F.min_by(synth, F.struct(*order)).alias("first_ms"), F.sum(audio).alias("audio_ms"), F.coalesce(F.sum("gap_ms"), F.lit(0)).alias("gap_ms"))
    return out.withColumn("wall_ms", F.col("first_ms") + F.col("audio_ms") + F.col("gap_ms"))


def change_points(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is not NULL and differs from the last value before it that is not NULL."""
    before = F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("__was", before).where(F.col(value).isNotNull() & (F.col("__was").isNull() | (F.col(value) != F.col("__was")))).drop("__was")


def frame_holds(frames: DataFrame, key: str, longest_s: float = 5.0) -> DataFrame:
    """Frames (key, t, hash) that are saved: a new hash, or the same one `longest_s` or more after the last saved.
    hold_s: from the first repeat that was skipped to the next saved frame; NULL without one."""

    def step(state, row):
        saved, mark, hold = state
        t, mark_now = float(row["t"]), row["hash"]
        if saved is not None and mark_now == mark and t - saved < longest_s:
            return (saved, mark, t if hold is None else hold), []
        held = t - hold if hold is not None and t > hold else None
        return (t, mark_now, None), [{key: row[key], "t": t, "hash": mark_now, "held_s": held}]

    kind = T.StructType([frames.schema[key], T.StructField("t", T.DoubleType()), T.StructField("hash", T.StringType()), T.StructField("held_s", T.DoubleType())])
    return ordered_fold(frames.select(key, "t", "hash"), key, ["t", "hash"], kind, lambda: (None, None, None), step)


def ready_ahead(queue: DataFrame, keys: list[str], index: str, ready: str, target: Column, most: int) -> DataFrame:
    """How many rows after the target are ready without a break, `most` at most."""
    later = queue.where(F.col(index) > target)
    g = later.groupBy(*keys).agg(F.min(F.when(~F.coalesce(ready, F.lit(False)), F.col(index))).alias("__stop"), F.max(index).alias("__last"), F.first(target).alias("__t"))
    return g.select(*keys, F.least(F.lit(most), F.coalesce(F.col("__stop") - 1, F.col("__last")) - F.col("__t")).alias("ready_ahead"))


def cut_offsets(rows: DataFrame, keys: list[str], order: list[str], weight: str, total: str, block: int = 2) -> DataFrame:
    """start_byte and end_byte of each row's share of `total` bytes: proportional to weights so far, aligned down to
    blocks, the last ends at the total."""
    over = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    upto, whole = F.sum(weight).over(over), F.sum(weight).over(W.partitionBy(*keys))
    cut = lambda x: (F.floor(F.floor(F.col(total) * x / whole) / block) * block).cast("long")
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == F.count("*").over(W.partitionBy(*keys))
    return rows.withColumn("start_byte", cut(upto - F.col(weight))).withColumn("end_byte", F.when(last, F.col(total).cast("long")).otherwise(cut(upto)))


def fold_groups(rows: DataFrame, key: str, order: list[str], size: str, limit: float, *, pause: Column | None = None, restart: bool = True) -> DataFrame:
    """Greedy groups in order: a row joins the open group if the group's size and its own stay within the limit; the
    first row of a group always fits. pause: size that joining adds before the row itself, after the check.

    Without restart only the first group is kept. Returns key, order columns and `group` from 1."""
    given = rows.select(key, *order, F.col(size).cast("double").alias("__s"), (pause if pause is not None else F.lit(0.0)).cast("double").alias("__p"))

    def step(state, row):
        used, n = state
        if n and (used == 0 or used + row["__s"] <= limit):
            used += row["__s"] + (row["__p"] if used > 0 else 0)
        else:
            used, n = row["__s"], n + 1
        return (used, n), [{c: row[c] for c in (key, *order)} | {"group": n}] if restart or n == 1 else []

    kind = T.StructType([*[given.schema[c] for c in (key, *order)], T.StructField("group", T.LongType())])
    return ordered_fold(given, key, order, kind, lambda: (0.0, 0), step)


def fixed_batches(rows: DataFrame, keys: list[str], order: list[str], n: int, synth: str = "synth_ms", audio: str = "duration_ms", chars: str = "text_len") -> DataFrame:
    """Batches of n rows: audio is shared by characters, synthesis equally, both rounded down."""
    b = rows.withColumn("batch_id", (F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1) / n) + 1).cast("long"))
    over = W.partitionBy(*keys, "batch_id")
    share = F.col(chars) / F.greatest(F.lit(1), F.sum(chars).over(over))
    return b.withColumns({"batch_duration_ms": F.floor(F.sum(audio).over(over) * share).cast("long"), "batch_synth_ms": F.floor(F.sum(synth).over(over) / F.count("*").over(over)).cast("long")})


def silence_boundaries(silences: DataFrame, durations: DataFrame, key: str = "audio") -> DataFrame:
    """0, all silence starts over 0, all silence ends, and the duration if it is greater: sorted, without repeats."""
    arr = silences.groupBy(key).agg(F.collect_list(F.when(F.col("start_s") > 0, F.col("start_s"))).alias("s"), F.collect_list("end_s").alias("e"))
    j = durations.join(arr, key, "left").withColumn("p", F.concat(F.array(F.lit(0.0)), F.coalesce("s", F.array().cast("array<double>")), F.coalesce("e", F.array().cast("array<double>"))))
    full = F.when(F.col("duration_s") > F.array_max("p"), F.concat("p", F.array(F.col("duration_s")))).otherwise(F.col("p"))
    return j.select(key, F.array_sort(F.array_distinct(full)).alias("boundaries"))


def segment_sentences(rows: DataFrame) -> DataFrame:
    """Sentences (audio, index, text_len) to the segments between boundaries (audio, boundaries), greedily: the next
    segment opens where a sentence would pass 1.5 times the target weight. The target is the mean weight of a segment
    times the segment's seconds; the units differ, and the rule is kept as documented."""
    got = rows.groupBy("audio", "boundaries").agg(F.array_sort(F.collect_list(F.struct("index", "text_len"))).alias("a"))
    segments = F.size("boundaries") - 1
    mean = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x["text_len"]) / segments
    got = got.where(segments > 0).withColumn("mean", mean)
    b = F.col("boundaries")
    target = lambda i: F.col("mean") * (F.element_at(b, (i + 1).cast("int")) - F.element_at(b, i.cast("int")))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(b) - 1
        over = acc["used"] + x["text_len"] > target(acc["seg"]) * 1.5
        later = F.filter(F.sequence(F.lit(1), n), lambda i: (i > acc["seg"]) & ((i == n) | (x["text_len"] <= target(i) * 1.5)))
        move = over & (acc["seg"] < n)
        seg = F.when(move, F.array_min(later)).otherwise(acc["seg"]).cast("int")
        row = F.struct(x["index"].alias("index"), F.element_at(b, seg).alias("start_time"), F.element_at(b, (seg + 1).cast("int")).alias("end_time"))
        return F.struct(seg.alias("seg"), (F.when(move, 0.0).otherwise(acc["used"]) + x["text_len"]).alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    zero = F.expr("named_struct('seg', 1, 'used', 0D, 'out', transform(filter(a, x -> false), x -> struct(x.index AS index, 0D AS start_time, 0D AS end_time)))")
    return got.select("audio", F.inline(F.aggregate("a", zero, step, lambda acc: acc["out"])))


def simulate_playback(rows: DataFrame, servers: int = 1, depth: int = 1) -> DataFrame:
    """What a listener waits for when sentences are synthesised ahead of playback, per strategy.

    rows: strategy, seq, synth_ms, duration_ms. servers * depth sentences may be in work; the next one, in order, begins
    when one of them is done. A sentence can be heard once it and all before it are done, and plays when the one before
    has played; a gap is how long the silence before it lasts. cold_start_ms is the silence before the first; wall_ms is
    when the last one can be heard. A fold carries the ends of the work in hand and a few sums, whatever a key's rows."""
    slots = max(1, servers * depth)
    names = ["sentences", "audio_ms", "cold_start_ms", "wall_ms", "gap_ms", "gaps", "max_gap_ms"]

    def step(state, row):
        busy, heard, silent_at, totals = state
        begin = heappop(busy) if len(busy) >= slots else 0.0
        done = begin + (row["synth_ms"] or 0.0)
        heappush(busy, done)
        heard = max(heard, done)
        n, audio, cold, _, waited, breaks, longest = totals
        gap = heard - silent_at if n and heard > silent_at else 0.0
        totals = (n + 1, audio + (row["duration_ms"] or 0.0), heard if n == 0 else cold, heard, waited + gap, breaks + (gap > 0), max(longest, gap))
        silent_at = max(heard, silent_at) + (row["duration_ms"] or 0.0)
        out = [dict(zip(names, totals)) | {"strategy": row["strategy"]}] if row["__last"] else []
        return (busy, heard, silent_at, totals), out

    given = rows.select("strategy", "seq", F.col("synth_ms").cast("double"), F.col("duration_ms").cast("double"))
    last = F.lead("seq").over(W.partitionBy("strategy").orderBy("seq")).isNull()
    kind = T.StructType([given.schema["strategy"], *[T.StructField(n, T.LongType() if n in ("sentences", "gaps") else T.DoubleType()) for n in names]])
    return ordered_fold(given.withColumn("__last", last), "strategy", ["seq"], kind, lambda: ([], 0.0, 0.0, (0, 0.0, 0.0, 0.0, 0.0, 0, 0.0)), step)


def chapter_progress(segments: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """Position inside a chapter of several segments (key, ord, start_time, dur) for points (key, cur_ord, t): segments
    before in full, the current one clamped to its length. Segments carry their running sums, so a point meets its own
    segment and its key's total, never all segments of the key."""
    over = W.partitionBy(*key).orderBy("ord")
    sums = segments.groupBy(*key, "ord").agg(F.sum("dur").alias("dur"), F.min("start_time").alias("start_time"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("dur").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    from lectern.operators.lookups import asof

    own = asof(points, sums.withColumn("__ord", F.col("ord")), key, "cur_ord", "ord", ["__ord", "__before", "dur", "start_time"])
    total = sums.groupBy(*key).agg(F.sum("dur").alias("total"))
    inside = F.when(F.col("__ord") == F.col("cur_ord"), F.greatest(F.lit(0.0), F.least(F.col("t") - F.col("start_time"), F.col("dur")))).otherwise(F.col("dur"))
    pos = F.coalesce(F.col("__before") + inside, F.lit(0.0))
    return own.join(total, key).select(*points.columns, F.greatest(F.lit(0.0), F.least(pos, F.col("total"))).alias("position"), "total")


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with a reproducible random order; `seq` restores the old one."""
    return rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "seq")).orderBy("shuffle_key", "seq")


def higher_than_seen(rows: DataFrame, keys: list[str], order: list[str], index: str, generation: str) -> DataFrame:
    """Drop late rows: of an older generation than was seen, or an index not above the highest of its generation."""
    over = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    seen = rows.withColumn("__g", F.max(F.struct(generation, index)).over(over))
    return seen.where(F.col("__g").isNull() | (F.struct(generation, index) > F.col("__g"))).drop("__g")

