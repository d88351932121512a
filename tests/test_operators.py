"""Lookups, progress, timelines and statistics on small hand-worked tables."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import lookups, matching, ordering, progress, statistics, timelines
from lectern.operators.folds import ordered_fold


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame([("d", 1, 0.0, 2.0), ("d", 2, 2.5, 4.0), ("d", 3, 4.0, 6.0)], "doc string, index int, start_time double, end_time double")


@pytest.mark.parametrize("width", [None, 1.0, 100.0])
def test_active_sentence(spark, spans, width):
    want = {-1.0: 1, 1.0: 1, 2.2: 1, 2.5: 2, 4.0: 3, 6.0: 3, 9.0: 3}
    p = spark.createDataFrame([("d", t) for t in want], "doc string, t double")
    assert dict(rows(lookups.active_sentence(p, spans, "doc", "t", width), "t", "index")) == want


@pytest.mark.parametrize("width", [0.5, 60.0])
def test_nearest_word(spark, width):
    w = spark.createDataFrame([("d", 1, 0.0, 1.0), ("d", 2, 2.0, 3.0)], "doc string, index int, start_time double, end_time double")
    p = spark.createDataFrame([("d", 0.5), ("d", 1.4), ("d", 1.5), ("d", 1.6), ("d", 9.0), ("e", 1.0)], "doc string, t double")
    got = lookups.nearest_word(p, w, "doc", "t", width)
    assert {(r["doc"], r["t"]): r["index"] for r in got.collect()} == {("d", 0.5): 1, ("d", 1.4): 1, ("d", 1.5): 1, ("d", 1.6): 2, ("d", 9.0): 2, ("e", 1.0): None}


def test_chapter_at(spark):
    c = spark.createDataFrame([("d", 1, 10.0, "a"), ("d", 2, 20.0, None)], "doc string, index int, start_time double, title string")
    p = spark.createDataFrame([("d", 5.0), ("d", 15.0), ("d", 25.0)], "doc string, t double")
    assert rows(lookups.chapter_at(p, c, "doc", "t"), "t", "index", "title") == [(15.0, 1, "a"), (25.0, 2, None), (5.0, 1, "a")]
    assert rows(lookups.chapter_at(p, c, "doc", "t", strict=True), "t", "index", "title") == [(15.0, 1, "a"), (25.0, 2, "a"), (5.0, None, None)]


def test_overlay_chapter(spark):
    files = spark.createDataFrame([("d", "f1", 1), ("d", "f2", 2)], "doc string, path string, pos int")
    c = spark.createDataFrame([("d", 1, "f1", 0.0), ("d", 2, "f1", 50.0), ("d", 3, "f2", 0.0), ("d", 4, "f2", 30.0)], "doc string, index int, audio_path string, start_time double")
    p = spark.createDataFrame([("d", "f1", 0.0), ("d", "f1", 49.5), ("d", "f2", 10.0), ("d", "f2", 40.0), ("d", "zz", 99.0)], "doc string, path string, t double")
    got = {(r["path"], r["t"]): r["index"] for r in lookups.overlay_chapter_at(p, c, files, "doc").collect()}
    assert got == {("f1", 0.0): 1, ("f1", 49.5): 2, ("f2", 10.0): 3, ("f2", 40.0): 4, ("zz", 99.0): 1}


def test_words_in_sentences_keep_repeats(spark):
    s = spark.createDataFrame([(1, 1, 1, 10), (1, 2, 12, 20)], "doc_id int, sentence_index int, start_pos int, end_pos int")
    w = spark.createDataFrame([(1, "a", 1, 3), (1, "a", 1, 3), (1, "b", 9, 12), (2, "c", 1, 2)], "doc_id int, w string, start_pos int, end_pos int")
    assert rows(lookups.words_in_sentences(w, s), "w", "sentence_index") == [("a", 1), ("a", 1), ("b", None), ("c", None)]


def test_resume_and_skip(spark):
    e = spark.createDataFrame([("b", 2, 7), ("b", 2, 5), ("b", 4, 9)], "book string, spine_pos int, seq int")
    p = spark.createDataFrame([("b", 1), ("b", 3), ("b", 5)], "book string, pos int")
    assert rows(lookups.resume_entry(p, e), "pos", "spine_pos", "seq") == [(1, 2, 5), (3, 4, 9), (5, None, None)]
    c = spark.createDataFrame([("d", 0.0), ("d", 10.0)], "doc string, start_time double")
    t = spark.createDataFrame([("d", 0.0), ("d", 9.0), ("d", 20.0)], "doc string, t double")
    assert rows(lookups.skip_target(t, c, "doc", "t"), "t", "target") == [(0.0, 10.0), (20.0, 25.0), (9.0, 14.0)]


def test_lookup_first_and_fallback(spark):
    left = spark.createDataFrame([("a",), ("z",)], "k string")
    right = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one")], "k string, seq int, v string")
    got = lookups.lookup(left, right, F.col("k"), F.col("k"), {"v": F.col("v")}, [F.col("seq")], {"v": F.col("k")})
    assert rows(got, "k", "v") == [("a", "one"), ("z", "z")]


def test_spine_order(spark):
    o = spark.createDataFrame([("z.smil", "x/c2.xhtml"), ("a.smil", "none.xhtml"), ("b.smil", "x/c1.xhtml")], "overlay_href string, doc_href string")
    s = spark.createDataFrame([("c1.xhtml", 1), ("c2.xhtml", 2)], "href string, pos int")
    assert [r["overlay_href"] for r in lookups.spine_order(o, s).orderBy("seq").collect()] == ["b.smil", "z.smil", "a.smil"]


def test_debounce(spark):
    j = spark.createDataFrame([("k", i, float(p)) for i, p in enumerate([0, 3, 4, 6, 8, 10, 12])] + [("n", 9, None)], "item string, seq int, position double")
    got = progress.debounced(j, "item", ["seq"], "position")
    assert [r["position"] for r in got.where("item = 'k'").orderBy("seq").collect()] == [0.0, 6.0, 12.0]
    assert got.where("item = 'n'").count() == 1


def test_latest_unsynced_and_flush(spark):
    j = spark.createDataFrame([("a", 1, 10.0, 1, False, None), ("a", 2, 20.0, 2, False, None), ("a", 3, 21.0, 2, False, None), ("b", 4, 5.0, 1, True, 1)], "item_id string, seq int, position double, ts int, synced boolean, synced_at int")
    f = progress.to_flush(j)
    assert rows(f, "item_id", "position") == [("a", 21.0)]
    assert rows(progress.after_flush(j, f, F.lit(9)), "seq", "synced", "synced_at") == [(1, True, 9), (2, True, 9), (3, True, 9), (4, True, 1)]


def test_eviction(spark):
    items = spark.createDataFrame([("a", 10, 1), ("b", 10, 2), ("c", 10, 3)], "id string, bytes int, at int")
    assert rows(progress.evicted(items, "bytes", "at", ["id"], 15), "id") == [("a",), ("b",)]
    assert progress.evicted(items, "bytes", "at", ["id"], 30).count() == 0


def test_oldest_goes(spark):
    m = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, at int")
    assert progress.without_oldest(m, ["at"], 2).count() == 2 and progress.without_oldest(m, ["at"], 3).count() == 3


def test_running_times(spark):
    w = spark.createDataFrame([(1, 1, 400), (1, 2, 200)], "doc int, i int, d int")
    assert rows(timelines.running_times(w, ["doc"], ["i"], "d"), "start_time", "end_time") == [(0, 400), (450, 650)]


def test_rolling(spark):
    s = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 3, 6])], "k int, i int, v double")
    assert [r["m"] for r in timelines.rolling_mean(s, ["k"], ["i"], "v", "m").orderBy("i").collect()] == [None, None, 2.0, 11 / 3]


def test_frame_holds(spark):
    f = spark.createDataFrame([("s", float(t), h) for t, h in [(0, "a"), (1, "a"), (3, "b"), (4, "b"), (9, "b")]], "s string, t double, hash string")
    got = timelines.frame_holds(f, "s").orderBy("t").collect()
    assert [(r["t"], r["hash"], r["held_s"]) for r in got] == [(0.0, "a", None), (3.0, "b", 2.0), (9.0, "b", 5.0)]


def test_groups(spark):
    r = spark.createDataFrame([("k", i, n) for i, n in enumerate([300, 250, 100, 600, 10])], "k string, i int, n int")
    assert [x["group"] for x in timelines.fold_groups(r, "k", ["i"], "n", 500).orderBy("i").collect()] == [1, 2, 2, 3, 4]
    capped = timelines.fold_groups(r, "k", ["i"], "n", 600, pause=F.lit(100), restart=False)
    assert [x["i"] for x in capped.orderBy("i").collect()] == [0, 1]


def test_segments(spark):
    sil = spark.createDataFrame([("a", 2.0, 3.0), ("a", 8.0, None)], "audio string, start_s double, end_s double")
    d = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "audio string, duration_s double")
    b = timelines.silence_boundaries(sil, d)
    assert dict(rows(b, "audio", "boundaries")) == {"a": [0.0, 2.0, 3.0, 8.0, 10.0], "b": [0.0, 5.0]}
    s = spark.createDataFrame([("b", i, 10) for i in range(3)], "audio string, index int, text_len int")
    assert rows(timelines.segment_sentences(s.join(b, "audio")), "index", "start_time", "end_time") == [(0, 0.0, 5.0), (1, 0.0, 5.0), (2, 0.0, 5.0)]


def test_simulation(spark):
    r = spark.createDataFrame([("x", 0, 1000, 500), ("x", 1, 1000, 500)], "strategy string, seq int, synth_ms int, duration_ms int")
    got = timelines.simulate_playback(r).first()
    assert (got["cold_start_ms"], got["wall_ms"]) == (1000.0, 2000.0)


def test_ready_ahead(spark):
    q = spark.createDataFrame([("s", i, i != 4) for i in range(8)], "s string, i int, ready boolean")
    assert rows(timelines.ready_ahead(q, ["s"], "i", "ready", F.lit(1), 5), "ready_ahead") == [(2,)]


def test_chapter_progress(spark):
    seg = spark.createDataFrame([("c", 1, 0.0, 100.0), ("c", 2, 5.0, 50.0)], "key string, ord int, start_time double, dur double")
    p = spark.createDataFrame([("c", 2, 15.0), ("c", 1, 500.0)], "key string, cur_ord int, t double")
    assert rows(timelines.chapter_progress(seg, p, ["key"]), "t", "position", "total") == [(15.0, 110.0, 150.0), (500.0, 100.0, 150.0)]


def test_segments_of_chapters(spark):
    c = spark.createDataFrame([("b", 1, "f1", "d1", "t", 0.0), ("b", 2, "f1", "d2", "t", 30.0), ("b", 3, "f2", "d2", "t", 0.0)], "book string, seq int, audio_path string, text_doc string, title string, start_time double")
    e = spark.createDataFrame([("b", "f1", "d2", 1, 30.0, 60.0), ("b", "f2", "d2", 2, 0.0, None)], "book string, audio_path string, text_doc string, seq int, start_time double, end_time double")
    s = statistics.chapter_segments(c, e, ["book"])
    assert dict(rows(statistics.chapter_lengths(s, ["book"]), "chapter_key", "duration")) == {"d1": 30.0, "d2": 30.1}


def test_percentile_and_summary(spark):
    d = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40)], "v double")
    assert tuple(d.agg(statistics.nearest_rank("v", 50), statistics.nearest_rank("v", 95)).first()) == (20.0, 40.0)
    assert d.where("v > 99").agg(statistics.nearest_rank("v", 50)).first()[0] == 0.0


def test_degrade(spark):
    s = spark.createDataFrame([("k", i, v) for i, v in enumerate([1.0, 1.3, 1.0, 1.3, 1.3])], "k string, i int, rtf double")
    assert [r["stage"] for r in statistics.degrade_stage(s, ["k"], ["i"], "rtf").orderBy("i").collect()] == [0, 1, 1, 1, 2]


def test_best_match(spark):
    e = spark.createDataFrame([("b", 1, "Hello there", "f1"), ("b", 2, "there", "f2"), ("b", 3, "Hello there friend", None)], "book string, seq int, text string, fragment_id string")
    s = spark.createDataFrame([("b", 1, "Hello there", None), ("b", 2, "friend", None), ("b", 3, "zzz", None), ("b", 4, "", "f2")], "book string, sel_id int, text string, fragment_id string")
    assert rows(matching.best_match(s, e), "sel_id", "seq", "score") == [(1, 1, 10000), (2, 3, 5006), (3, 1, 0), (4, 2, None)]


def test_cascade(spark):
    page = "The quick brown fox jumps over the lazy dog"
    sents = ["brown fox", "quick brown fox jumped high over there, not knowing", "x y over the lazy dog", "no way at all"]
    df = spark.createDataFrame([(page, s) for s in sents], "p string, s string")
    got = [r["h"] and (r["h"]["pos"], r["h"]["how"]) for r in df.select(matching.cascade(F.col("p"), F.col("s")).alias("h")).collect()]
    assert got == [(11, "exact"), (5, "prefix20"), (34, "suffix10"), None]


def test_remap(spark):
    old = spark.createDataFrame([("b", 1, "One  two.", 0.0, 1.0)], "book string, index int, text string, start_time double, end_time double")
    new = spark.createDataFrame([("b", 5, "One two."), ("b", 6, "Three.")], "book string, index int, text string")
    assert rows(matching.remap(old, new), "index", "old_index", "start_time") == [(5, 1, 0.0), (6, None, None)]


def test_ordering(spark):
    f = spark.createDataFrame([("B.MP3",), ("a.ogg",), ("c.txt",)], "name string")
    assert [r[0] for r in ordering.audio_files(f).collect()] == ["a.ogg", "B.MP3"]
    d = spark.createDataFrame([("m1", "phone", False, False, "Z"), ("m2", "audio-card", True, True, None), ("m3", None, False, False, None)], "mac string, icon string, paired boolean, connected boolean, name string")
    assert [r["mac"] for r in ordering.audio_devices(d).collect()] == ["m2", "m1"]
    first = spark.createDataFrame([("x", 1)], "k string, seq int")
    rest = spark.createDataFrame([("x",), ("a",)], "k string")
    assert [r["k"] for r in ordering.ordered_union(first, rest, "k", ["k"]).collect()] == ["x", "a"]


def test_fold_state_crosses_batches(spark):
    n = 25_000
    df = spark.range(n).select(F.lit("k").alias("k"), "id")
    got = ordered_fold(df, "k", ["id"], df.schema, lambda: 0, lambda s, r: (s + 1, [r] if s % 1000 == 0 else []))
    assert sorted(r["id"] for r in got.collect()) == list(range(0, n, 1000))


def test_positions_and_ordinals(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "d int, i int")
    b = spark.createDataFrame([(1, 7, "x")], "d int, j int, v string")
    assert rows(lookups.by_ordinal(a, b, ["d"], ["i"], ["j"], ["v"]), "d", "i", "v") == [(1, 1, "x"), (1, 2, None), (2, 1, None)]
    assert lookups.row_at(a, "i", 2).count() == 1
    sp = spark.createDataFrame([(1, 1, 1, 4), (1, 2, 4, 9)], "d int, index int, start_pos int, end_pos int")
    p = spark.createDataFrame([(1, 4), (1, 9), (1, 10)], "d int, pos int")
    assert rows(lookups.at_position(p, sp, "d", "pos", width=3), "pos", "index") == [(10, None), (4, 1), (9, 2)]


def test_rules(spark):
    v = spark.createDataFrame([(10.0, 100.0, True), (10.0, 100.0, False), (None, 20.0, True), (None, 40.0, True), (50.0, 100.0, True)], "l double, r double, s boolean")
    got = [tuple(r) for r in v.select(lookups.best_position(F.col("l"), F.col("r"), F.col("s")), lookups.start_position(F.col("l"), F.col("r"))).collect()]
    assert got == [(100.0, 100.0), (10.0, 100.0), (20.0, None), (40.0, 40.0), (100.0, 50.0)]
