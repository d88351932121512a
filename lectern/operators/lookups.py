"""Interval, as-of, ordinal and key lookups.

Lookups in time are equi joins on a key and a bucket of the time axis, so no key is compared with all its intervals,
and windows run within (key, bucket): a key with most of the rows is spread over its buckets."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def _buckets(start: Column, end: Column, width: float) -> Column:
    lo, hi = F.floor(start / width).cast("long"), F.floor(end / width).cast("long")
    return F.explode(F.sequence(lo, F.greatest(lo, hi)))


def within(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, order: list[str], *, width: float, closed: bool = False, how: str = "left", point_end: str | None = None) -> DataFrame:
    """Each point with the first span, by `order`, that holds it: [start, end), or [start, end] if closed.

    With point_end the point is an interval, and a span must hold all of it. Points that repeat are kept; span columns
    that clash with point columns are the caller's to rename."""
    hold = F.col(start) <= F.col(point)
    if point_end:
        hold &= F.col(point_end) <= F.col(end)
    else:
        hold &= (F.col(point) <= F.col(end)) if closed else (F.col(point) < F.col(end))
    cols = [c for c in spans.columns if c not in keys]
    # equal points have equal hits, so they are numbered by their values and counted: nothing is evaluated twice by row
    same = [c for c in dict.fromkeys([*keys, point, *([point_end] if point_end else [])])]
    pts = points.select(*same).distinct().withColumn("__b", F.floor(F.col(point) / width).cast("long"))
    sp = spans.select(*keys, *[F.col(c).alias(f"__s_{c}") if c in same else F.col(c) for c in cols]).withColumn("__b", _buckets(F.col(f"__s_{start}" if start in same else start), F.col(f"__s_{end}" if end in same else end), width))
    hit = pts.join(sp, [*keys, "__b"]).where(hold)
    first = hit.groupBy(*same).agg(F.min_by(F.struct(*[F.col(f"__s_{c}").alias(c) if c in same else F.col(c) for c in cols]), F.struct(*order)).alias("__s"))
    named = first.select(*[F.col(c).alias(f"__p_{c}") for c in same], "__s")
    on = [points[c].eqNullSafe(named[f"__p_{c}"]) for c in same]
    out = points.join(named, on, how)
    return out.select(*[points[c] for c in points.columns], *[F.col("__s").getField(c).alias(c) for c in cols])


def asof(left: DataFrame, right: DataFrame, keys: list[str], t_left: str, t_right: str, take: list[str], tie: list[str] = (), *, width: float | None = None, forward: bool = False) -> DataFrame:
    """Each left row with the latest right row at or before it (the earliest at or after it, if forward), NULL if none.

    Of right rows at one time the last by `tie` counts. With a width, windows run within buckets of the time axis and
    each bucket is handed the latest row of those before it."""
    sign = -1 if forward else 1
    at_l, at_r = F.col(t_left) * sign if forward else F.col(t_left), F.col(t_right) * sign if forward else F.col(t_right)
    ls = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], at_l.alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).alias("__tie"), F.lit(None).alias("__r"))
    tie_col = F.struct(*[F.col(c) for c in tie]) if tie else F.lit(0)
    rs = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], at_r.alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__l"), tie_col.alias("__tie"), F.struct(*take).alias("__r"))
    both = ls.unionByName(rs)
    ks = [f"__k{i}" for i in range(len(keys))]
    if width is None:
        over = W.partitionBy(*ks).orderBy("__t", "__side", "__tie").rowsBetween(W.unboundedPreceding, 0)
        found = both.withColumn("__f", F.last("__r", ignorenulls=True).over(over))
    else:
        both = both.withColumn("__b", F.floor(F.col("__t").cast("double") / width).cast("long"))
        ends = both.groupBy(*ks, "__b").agg(F.max_by("__r", F.when(F.col("__side") == 0, F.struct("__t", "__tie"))).alias("__e"))
        before = W.partitionBy(*ks).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
        carried = ends.withColumn("__c", F.last("__e", ignorenulls=True).over(before)).drop("__e")
        over = W.partitionBy(*ks, "__b").orderBy("__t", "__side", "__tie").rowsBetween(W.unboundedPreceding, 0)
        inside = both.withColumn("__f", F.last("__r", ignorenulls=True).over(over))
        on = [inside[k].eqNullSafe(carried[k]) for k in [*ks, "__b"]]
        found = inside.join(carried, on, "left").select("__side", "__l", F.coalesce("__f", "__c").alias("__f"))
    return found.where("__side = 1").select("__l.*", *[F.col("__f").getField(c).alias(c) for c in take])


def words_in_sentences(words: DataFrame, sentences: DataFrame, doc: str = "doc_id", width: int = 4096) -> DataFrame:
    """Each word with the index of the first sentence that holds it, NULL if none does."""
    s = sentences.select(doc, F.col("sentence_index"), F.col("start_pos").alias("__s"), F.col("end_pos").alias("__e"))
    return within(words, s, [doc], "start_pos", "__s", "__e", ["sentence_index"], width=width, point_end="end_pos").drop("__s", "__e")


def text_words_in_sentences(docs: DataFrame, doc: str = "doc_id", words: int = 1 << 17) -> DataFrame:
    """The words of each text and the index, from 1, of the span that holds each, NULL if none does.

    docs: doc, text, spans (array<struct<start_pos, end_pos>> in order, none overlapping, 0 where a sentence is not
    found). Words part at spaces and line ends. A row needs nothing but its own text, so no word is exchanged: the words
    of a corpus are many times its bytes. A row without an id has no sentences, rows that repeat count each for itself.
    `words` bounds what a task holds besides one text."""
    kinds = [(doc, docs.schema[doc].dataType), ("word_index", T.IntegerType()), ("word", T.StringType()), ("end_pos", T.LongType()), ("start_pos", T.LongType()), ("sentence_index", T.IntegerType())]

    def of_text(t: str, spans: list[dict]) -> tuple:
        tokens = t.replace("\n", " ").split(" ")
        n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        end = np.cumsum(n + 1) - 1
        i = np.flatnonzero(n)
        end, start = end[i], (end - n + 1)[i]
        place = np.array([(s["start_pos"], s["end_pos"], k) for k, s in enumerate(spans, 1) if s["start_pos"]], np.int64).reshape(-1, 3)
        at = np.searchsorted(place[:, 0], start, "right") - 1
        held = at >= 0
        held[held] = end[held] <= place[at[held], 1]
        index = np.zeros(len(i), np.int32)
        index[held] = place[at[held], 2]
        return [x for x in tokens if x], i.astype(np.int32), end, start, index

    def run(batches):
        def flush():
            word, i, end, start, index = zip(*found)
            index = np.concatenate(index)
            ids = pa.array(keys, key_type).take(pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in i])))
            columns = [ids, pa.array(np.concatenate(i)), pa.array(chain.from_iterable(word), pa.string()), pa.array(np.concatenate(end)), pa.array(np.concatenate(start)), pa.array(index, mask=index == 0)]
            return pa.record_batch(columns, names=[k for k, _ in kinds])

        for b in batches:
            key_type, keys, found, n = b.column(doc).type, [], [], 0
            for at in range(b.num_rows):
                key, t, spans = (b.column(c)[at].as_py() for c in (doc, "text", "spans"))
                if t is None:
                    continue
                keys.append(key)
                found.append(of_text(t, spans if key is not None and spans else []))
                n += len(found[-1][0])
                if n >= words:
                    yield flush()
                    keys, found, n = [], [], 0
            if found:
                yield flush()

    return docs.select(doc, "text", "spans").mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


def at_position(points: DataFrame, spans: DataFrame, doc: str, pos: str, width: int = 4096) -> DataFrame:
    """The first span (index, start_pos, end_pos) that holds a position, ends included."""
    return within(points, spans, [doc], pos, "start_pos", "end_pos", ["index"], width=width, closed=True)


def at_time(points: DataFrame, spans: DataFrame, doc: str, t: str, width: float = 60_000.0) -> DataFrame:
    """The first span (index, start_time, end_time) that holds a time, its end excluded."""
    return within(points, spans, [doc], t, "start_time", "end_time", ["index"], width=width)


def active_sentence(points: DataFrame, spans: DataFrame, doc: str, t: str, width: float | None = None) -> DataFrame:
    """The sentence at a time: the last that has started; the first before all of them. After the end of the last, and
    in gaps, it is the last started."""
    got = asof(points, spans, [doc], t, "start_time", ["index"], ["index"], width=width).withColumnRenamed("index", "__i")
    first = spans.groupBy(doc).agg(F.min_by("index", F.struct("start_time", "index")).alias("__first"))
    return got.join(first, doc, "left").select(*points.columns, F.coalesce("__i", "__first").alias("index"))


def nearest_word(points: DataFrame, spans: DataFrame, doc: str, t: str, width: float = 60.0) -> DataFrame:
    """The word at a time, else the one whose start or end is nearest; the first of equals.

    The nearest word is the last to end at or before the time, or the first to start at or after it: two as-of
    lookups and the hit itself, never all words of a document."""
    ids = points.withColumn("__p", F.monotonically_increasing_id())
    hit = within(ids, spans.select(doc, F.col("index").alias("__h"), F.col("start_time").alias("__hs"), F.col("end_time").alias("__he")), [doc], t, "__hs", "__he", ["__h"], width=width).drop("__hs", "__he")
    low = spans.select(doc, "end_time", "index")
    ended = asof(hit, low.withColumn("__order", -F.col("index")), [doc], t, "end_time", ["end_time", "index"], ["__order"], width=width).withColumnsRenamed({"end_time": "__e", "index": "__ei"})
    next_ = asof(ended, spans.withColumn("__order", -F.col("index")), [doc], t, "start_time", ["start_time", "index"], ["__order"], width=width, forward=True).withColumnsRenamed({"start_time": "__s", "index": "__si"})
    de, ds = F.abs(F.col(t) - F.col("__e")), F.abs(F.col(t) - F.col("__s"))
    far = F.lit(float("inf"))
    pair_e, pair_s = F.struct(F.coalesce(de, far).alias("d"), F.col("__ei").alias("i")), F.struct(F.coalesce(ds, far).alias("d"), F.col("__si").alias("i"))
    near = F.when(pair_e["i"].isNull(), pair_s["i"]).when(pair_s["i"].isNull(), pair_e["i"]).otherwise(F.least(pair_e, pair_s)["i"])
    return next_.select(*points.columns, F.coalesce("__h", near).alias("index"))


def chapter_at(points: DataFrame, chapters: DataFrame, doc: str, t: str, *, strict: bool = False, width: float | None = None) -> DataFrame:
    """The last chapter that starts at or before a time. Before the first it is the first, or NULL if strict, and a
    chapter without a title then keeps the title before it."""
    rows = chapters
    if strict:
        over = W.partitionBy(doc).orderBy("start_time", "index").rowsBetween(W.unboundedPreceding, 0)
        rows = chapters.withColumn("title", F.last("title", ignorenulls=True).over(over))
    got = asof(points, rows, [doc], t, "start_time", ["index", "title"], ["index"], width=width)
    if strict:
        return got
    first = chapters.groupBy(doc).agg(F.min_by(F.struct("index", "title"), F.struct("start_time", "index")).alias("__f"))
    return got.join(first, doc, "left").select(*points.columns, F.coalesce("index", "__f.index").alias("index"), F.when(F.col("index").isNull(), F.col("__f.title")).otherwise(F.col("title")).alias("title"))


def overlay_chapter_at(points: DataFrame, chapters: DataFrame, files: DataFrame, doc: str) -> DataFrame:
    """The last chapter, by index, of an earlier file or of the same file with start_time <= t + 1; 1 if none.

    points: doc, path, t; chapters: doc, index, audio_path, start_time; files: doc, path, pos. A file outside the
    list has order 0. Earlier files reduce to a running maximum over file order; the same file is an as-of lookup."""
    f = files.groupBy(doc, "path").agg(F.max("pos").alias("pos"))
    c = chapters.join(f.withColumnRenamed("path", "audio_path"), [doc, "audio_path"], "left").withColumn("ord", F.coalesce("pos", F.lit(0))).drop("pos")
    p = points.join(f, [doc, "path"], "left").withColumn("ord", F.coalesce("pos", F.lit(1)).cast("long")).drop("pos").withColumn("until", F.col("t") + 1)
    per_file = c.groupBy(doc, "ord").agg(F.max("index").alias("m"))
    running = per_file.withColumn("m", F.max("m").over(W.partitionBy(doc).orderBy("ord").rowsBetween(W.unboundedPreceding, 0))).withColumn("after", F.col("ord").cast("long") + 1)
    earlier = asof(p, running, [doc], "ord", "after", ["m"])
    top = W.partitionBy(doc, "audio_path").orderBy("start_time", "index").rowsBetween(W.unboundedPreceding, 0)
    same = c.withColumn("best", F.max("index").over(top)).select(doc, F.col("audio_path").alias("path"), "start_time", "index", "best")
    both = asof(earlier, same, [doc, "path"], "until", "start_time", ["best"], ["index"])
    return both.select(*points.columns, F.coalesce(F.greatest("m", "best"), F.lit(1)).alias("index"))


def by_ordinal(left: DataFrame, right: DataFrame, keys: list[str], order_left: list[str], order_right: list[str], take: list[str]) -> DataFrame:
    """The i-th left row with the i-th right row of its key; left rows without a partner get NULL, right ones go."""
    n = lambda order: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    r = right.withColumn("__n", n(order_right)).select(*keys, "__n", *take)
    return left.withColumn("__n", n(order_left)).join(r, [*keys, "__n"], "left").drop("__n")


def row_at(rows: DataFrame, ordinal: str, wanted: int) -> DataFrame:
    """The row with a 1-based ordinal; none if it is absent."""
    return rows.where(F.col(ordinal) == wanted)


def lookup(left: DataFrame, right: DataFrame, left_on: Column, right_on: Column, take: dict[str, Column], order: list[Column], fallback: dict[str, Column] | None = None) -> DataFrame:
    """Left rows with columns of the first right row, by order, whose key is equal; else the fallback, else NULL."""
    struct = F.struct(*[v.alias(k) for k, v in take.items()])
    r = right.groupBy(right_on.alias("__k")).agg(F.min_by(struct, F.struct(*order)).alias("__r"))
    j = left.withColumn("__key", left_on).join(r, F.col("__key") == F.col("__k"), "left")
    fall = fallback or {}
    return j.select(*left.columns, *[F.coalesce(F.col("__r").getField(k), fall[k]).alias(k) if k in fall else F.col("__r").getField(k).alias(k) for k in take])


def flagged(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """Left rows and whether the right side has their key."""
    has = right.select(key).distinct().withColumn(flag, F.lit(True))
    return left.join(has, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def keep_known(rows: DataFrame, known: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is known, or those whose key is not."""
    return rows.join(known.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def spine_order(overlays: DataFrame, spine: DataFrame) -> DataFrame:
    """Overlays (book, overlay_href, doc_href) of each book in its spine's order of their documents' base names; the rest
    after, by href. seq counts from 1 in each book. Tables without a column `book` are one book's."""
    from lectern.functions.paths import basename

    by = [c for c in ("book",) if c in overlays.columns and c in spine.columns]
    s = spine.groupBy(*by, basename(F.col("href")).alias("__base")).agg(F.min("pos").alias("spine_pos"))
    j = overlays.withColumn("__base", basename(F.col("doc_href"))).join(s, [*by, "__base"], "left").drop("__base")
    over = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("spine_pos").asc_nulls_last(), "overlay_href")
    return j.withColumn("seq", F.row_number().over(over))


def resume_entry(points: DataFrame, entries: DataFrame) -> DataFrame:
    """For a spine position the first entry at or after it (entries: spine_pos, seq, ...)."""
    first = entries.groupBy("book", "spine_pos").agg(F.min("seq").alias("seq"))
    return asof(points, first, ["book"], "pos", "spine_pos", ["spine_pos", "seq"], forward=True)


def merge_progress(local: DataFrame, remote: DataFrame, key: str = "item_id") -> DataFrame:
    """Full join of two progress tables (position, ts); a newer remote wins, equal or older changes nothing.
    A missing time is 0, a missing side loses."""
    l, r = local.select(key, F.col("position").alias("lp"), F.col("ts").alias("lt")), remote.select(key, F.col("position").alias("rp"), F.col("ts").alias("rt"))
    lt, rt = F.coalesce("lt", F.lit(0)), F.coalesce("rt", F.lit(0))
    side = F.when(F.col("rp").isNotNull() & (F.col("lp").isNull() | (rt > lt)), "remote").otherwise("local")
    j = l.join(r, key, "full").withColumn("winner", side)
    return j.select(key, F.when(F.col("winner") == "remote", F.col("rp")).otherwise(F.col("lp")).alias("position"), "winner")


def best_position(local: Column, remote: Column, synced: Column) -> Column:
    """Where both are known a synced local entry gives way to the remote one; else whichever is known."""
    return F.when(local.isNotNull() & remote.isNotNull(), F.when(synced, remote).otherwise(local)).otherwise(F.coalesce(local, remote))


def start_position(local: Column, remote: Column) -> Column:
    """The remote position counts beyond 30 s if there is no local one or they are over 60 s apart."""
    return F.when((remote > 30) & (local.isNull() | (F.abs(remote - local) > 60)), remote).otherwise(local)


def neighbours(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The value before and after each row, clamped: before the first is the first itself, after the last is NULL."""
    over = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({f"previous_{value}": F.coalesce(F.lag(value).over(over), F.col(value)), f"next_{value}": F.lead(value).over(over)})


def skip_target(points: DataFrame, chapters: DataFrame, doc: str, t: str) -> DataFrame:
    """The start of the first chapter more than a second after a time; a time past the last moves on by 5 s."""
    later = points.withColumn("__after", F.col(t) + 1 + 1e-9)
    got = asof(later, chapters.select(doc, F.col("start_time").alias("__target")), [doc], "__after", "__target", ["__target"], forward=True)
    return got.select(*points.columns, F.coalesce(F.col("__target"), F.col(t) + 5).alias("target"))
