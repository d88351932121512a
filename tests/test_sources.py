"""Readers and writers on files made here."""

import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions.paths import fingerprint
from lectern.operators import lookups
from lectern.sources import audio, catalogues, chapters, markup, sinks

OPF = """<package><manifest><item id="c1" href="text/c1.xhtml" media-type="application/xhtml+xml" media-overlay="o1"/>
<item id="o1" href="smil/c1.smil" media-type="application/smil+xml"/><item id="c1" href="text/one.xhtml" media-overlay="o1" media-type="x"/>
<item id="x" media-type="none"/><item id="open" href="o"></item></manifest><spine><itemref idref="c1"/></spine></package>"""
SMIL = """<smil><body><par id="p1"><text src="../text/one.xhtml#s1"/><audio src="../audio/a.mp3" clipBegin="0:00:01.5" clipEnd="2s"/></par>
<par><text src="../text/one.xhtml#gone"/><audio src="../audio/a.mp3"/></par><par><text src="x"/></par></body></smil>"""
PAGE = '<html><body><span id="s1">Hello <span id="in">big</span>\n &amp; wide&nbsp;world</span><span id="s1">again</span><span id="e"> </span></body></html>'
NCX = '<ncx><navPoint id="n"><navLabel><text>First</text></navLabel><content src="text/one.xhtml#a"/></navPoint><navPoint><navLabel><text>Second</text></navLabel><content src="text/one.xhtml"/></navPoint></ncx>'


@pytest.fixture(scope="module")
def members(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    with zipfile.ZipFile(d / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="OEBPS/book.opf"/></container>')
        for name, body in (("OEBPS/book.opf", OPF), ("OEBPS/smil/c1.smil", SMIL), ("OEBPS/text/one.xhtml", PAGE), ("OEBPS/toc.ncx", NCX)):
            z.writestr(name, body)
        z.writestr("cover.jpg", b"\xff")
    (d / "broken.epub").write_bytes(b"PK nothing")
    return markup.archive_members(spark, str(d)).cache()


def test_book(spark, members):
    assert [r["opf"] for r in markup.package_path(members).collect()] == ["OEBPS/book.opf"]
    opf = members.where(F.col("href").endswith(".opf"))
    items = markup.manifest(opf)
    assert {r["id"]: r["href"] for r in items.collect()} == {"c1": "text/one.xhtml", "o1": "smil/c1.smil"}
    over = markup.overlays(items)
    assert [(r["doc_href"], r["overlay_href"]) for r in over.collect()] == [("text/one.xhtml", "smil/c1.smil")]
    sp = markup.spine(opf, items)
    assert [(r["pos"], r["href"]) for r in sp.collect()] == [(1, "one.xhtml")]
    entries = markup.overlay_entries(members.where(F.col("href").endswith(".smil")))
    got = [(r["text_doc"], r["fragment_id"], r["audio_src"], r["start_time"], r["end_time"]) for r in entries.orderBy("seq").collect()]
    assert got == [("OEBPS/text/one.xhtml", "s1", "OEBPS/audio/a.mp3", 1.5, 2.0), ("OEBPS/text/one.xhtml", "gone", "OEBPS/audio/a.mp3", 0.0, 0.0)]
    spans = markup.sentence_spans(members.where(F.col("href").endswith(".xhtml")))
    assert {r["fragment_id"]: r["text"] for r in spans.collect()} == {"in": "big", "s1": "Hello big & wide world"}
    order = lookups.spine_order(over.select("overlay_href", "doc_href", "book"), sp).withColumn("overlay_href", F.concat(F.lit("OEBPS/"), "overlay_href"))
    t = markup.timing(entries, spans, order).orderBy("seq").collect()
    assert [r["text"] for r in t] == ["Hello big & wide world", "../text/one.xhtml#gone"]
    titles = markup.chapter_titles(members.where(F.col("href").endswith(".ncx")))
    assert [(r["base"], r["title"]) for r in titles.collect()] == [("one.xhtml", "First")]


def texts(spark, **files):
    return spark.createDataFrame(list(files.items()), "path string, body string")


def shown(df):
    return [(r["title"], r["start_time"], r["end_time"]) for r in df.orderBy("path", "index").collect()]


def test_chapter_lists(spark):
    assert shown(chapters.sidecar(texts(spark, a="0:00 One\n# note\n5:00 Two\nrubbish"))) == [("One", 0.0, 300.0), ("Two", 300.0, 600.0)]
    assert shown(chapters.sidecar(texts(spark, a="0:10-0:20 One"))) == [("One", 10.0, 20.0)]
    cue = 'TITLE "Album"\nTRACK 01 AUDIO\n TITLE "A"\n INDEX 00 00:00:00\n INDEX 01 00:01:00\nTRACK 02 AUDIO\n TITLE "B"\n INDEX 01 01:00:37\nTRACK 03 AUDIO\n TITLE "none"'
    assert [(t, round(s, 4), round(e, 4)) for t, s, e in shown(chapters.cue_sheet(texts(spark, a=cue)))] == [("A", 1.0, 60.4933), ("B", 60.4933, 360.4933)]
    probe = json.dumps({"chapters": [{"id": 0, "time_base": "1/1000", "start": 0, "end": 1500, "tags": {"title": "x ] y"}}, {"id": 1, "start": 1500, "end": 2000}], "format": {"duration": "2.5"}})
    files = texts(spark, a=probe, b='{"format": {"duration": "9"}}', c="not json")
    assert shown(chapters.probe_json(files)) == [("x ] y", 0.0, 1.5), ("Chapter 2", 1.5, 2.0)]
    both = chapters.cascade([chapters.probe_json(files), chapters.sidecar(texts(spark, a="0:00 no", b="0:00 yes"))])
    assert sorted(r["path"] for r in both.collect()) == ["a", "a", "b"]
    d = chapters.first_duration([chapters.probe_duration(files), chapters.banner_duration(texts(spark, c="Duration: 00:00:03.5, start"))])
    assert {r["path"]: r["duration_s"] for r in d.collect()} == {"a": 2.5, "b": 9.0, "c": 3.5}
    log = texts(spark, a="out_time=00:00:01.0\nout_time=N/A\nout_time=00:01:02.5\nout_time=N/A", b="")
    assert {r["path"]: r["position_s"] for r in chapters.progress_position(log).collect()} == {"a": 62.5, "b": None}


def frame(name, body):
    return name.encode() + struct.pack(">I", len(body)) + b"\0\0" + body


def test_tags(spark):
    chap = lambda n, s, e, t: frame("CHAP", n + b"\0" + struct.pack(">IIII", s, e, 0, 0) + frame("TIT2", b"\x03" + t.encode()))
    body = frame("TLEN", b"\x0060000") + chap(b"c2", 5000, 9000, "Two") + chap(b"c1", 0, 5000, "Ünö")
    n = len(body)
    id3 = b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body
    mp4 = b"\0\0\0\x6cmoov\0\0\0\x6cmvhd" + b"\0" * 4 + struct.pack(">IIII", 0, 0, 1000, 2500) + b"\0" * 80
    ogg = b"OggS\x00CHAPTER002=00:01:00.5\x00CHAPTER002NAME=Zwei \xc3\xa4\x00CHAPTER001=00:00:00\x00"
    files = spark.createDataFrame([("a.mp3", bytearray(id3)), ("b.m4b", bytearray(mp4)), ("c.ogg", bytearray(ogg)), ("d", bytearray(b"")), ("e", None)], "path string, content binary")
    assert shown(chapters.id3_rows(files)) == [("Ünö", 0.0, 5.0), ("Two", 5.0, 9.0)]
    assert {r["path"]: r["duration_s"] for r in chapters.tagged_audio(files).collect()} == {"a.mp3": 60.0, "b.m4b": 2.5, "c.ogg": None, "d": None, "e": None}
    assert shown(chapters.ogg_comments(files)) == [("Chapter 1", 0.0, 60.5), ("Zwei ä", 60.5, 360.5)]


def test_wav(spark, tmp_path):
    data = audio.wav_bytes(struct.pack("<8000h", *([1000] * 8000)), 8000)
    (tmp_path / "a.wav").write_bytes(data)
    (tmp_path / "b.wav").write_bytes(b"short")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content", "length", "modificationTime")
    got = {r["path"][-5:]: (r["rate"], r["channels"], r["bits"], r["duration_ms"]) for r in audio.wav_headers(files).collect()}
    assert got["a.wav"] == (8000, 1, 16, 1000) and got["b.wav"][3] == 0
    path = files.where("length > 9").first()["path"]
    cuts = spark.createDataFrame([(path, 1, 0, 4000), (path, 2, 4000, 16000)], "path string, seq int, start_byte int, end_byte int")
    parts = [bytes(r["content"]) for r in audio.cut(files, cuts).orderBy("seq").collect()]
    assert audio.merge(parts) == data and len(audio.append_silence(data, 500)) == len(data) + 8000
    assert struct.unpack("<h", audio.fade(data, 100)[44:46]) == (0,) and len(audio.resample(data, 4000)) == 44 + 8000
    assert {r["name"] for r in catalogues.audio_listing(spark, str(tmp_path)).collect()} == {"a.wav", "b.wav"}
    assert all(":" in r[0] for r in files.select(fingerprint(F.col("length"), F.col("modificationTime"))).collect())


def test_catalogues(spark, tmp_path):
    (tmp_path / "j.json").write_text(json.dumps([{"item_id": "a", "position": 1.0, "synced": False}]))
    (tmp_path / "bad.json").write_text("{ not")
    assert catalogues.json_table(spark, str(tmp_path / "j.json"), catalogues.JOURNAL).count() == 1
    assert catalogues.json_table(spark, str(tmp_path / "bad.json"), catalogues.JOURNAL).count() == 0
    assert catalogues.json_table(spark, str(tmp_path / "none.json"), catalogues.JOURNAL).count() == 0
    (tmp_path / "v.json").write_text(json.dumps([{"id": "v", "name": "V", "size_mb": 1.0, "url": "u"}]))
    assert catalogues.voices(spark, str(tmp_path / "bad.json"), str(tmp_path / "v.json")).first()["id"] == "v"
    (tmp_path / "r.json").write_text(json.dumps({"strategy": "s", "per_sentence": [{"synth_ms": 1, "duration_ms": 2, "text_len": 3}]}))
    assert catalogues.bench_results(spark, str(tmp_path / "r.json")).first()["duration_ms"] == 2.0
    page = json.dumps({"page": 0, "total": 1, "results": [{"id": "i", "media": {"metadata": {"title": "T", "authorName": "A"}, "duration": 3.5}}]})
    r = catalogues.library_pages(spark.createDataFrame([(page,)], "body string")).first()
    assert (r["id"], r["title"], r["author"], r["duration"]) == ("i", "T", "A", 3.5)


def test_logs(spark):
    lines = ["x silence_start: -0.01", "silence_end: 1.5 | silence_duration: 1.5", "noise", "silence_start: 9.25"]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(lines)], "audio string, line_no int, line string")
    assert sorted((r["start_s"], r["end_s"]) for r in catalogues.silence_regions(df).collect()) == [(-0.01, 1.5), (9.25, None)]
    p = catalogues.phoneme_durations(spark.createDataFrame([(1, "h 50\n@ 70")], "id int, body string"))
    assert [(r["phoneme"], r["duration_ms"]) for r in p.orderBy("seq").collect()] == [("h", 50), ("@", 70)]
    assert [r["line_no"] for r in catalogues.log_tail(df, 2).collect()] == [2, 3]
    dump = ['object path "/org/dev_AA"', 'string "Name"', ' variant string "Buds"', 'string "Connected"', " variant boolean true", 'object path "/org/dev_BB"', 'string "Icon"', ' variant string "phone"']
    d = catalogues.devices(spark.createDataFrame(list(enumerate(dump)), "line_no int, line string"))
    assert [(r["name"], r["connected"], r["icon"]) for r in d.orderBy("path").collect()] == [("Buds", True, None), (None, None, "phone")]


def test_messages(spark):
    po = 'msgid ""\nmsgstr "Plural-Forms: x\\n"\n\nmsgctxt "menu"\nmsgid "One \\"a\\""\nmsgstr "Un"\n" deux"\n\nmsgid "n"\nmsgid_plural "ns"\nmsgstr[0] "a"\nmsgstr[1] "b"\n\nmsgid "todo"\nmsgstr ""'
    m = catalogues.po_messages(spark.createDataFrame([("fr", po)], "path string, body string"))
    rows = {r["msgid"]: r for r in m.collect()}
    assert rows['One "a"']["msgstr"] == ["Un deux"] and rows['One "a"']["msgctxt"] == "menu" and rows["n"]["msgstr"] == ["a", "b"]
    assert tuple(catalogues.translated(m).first())[1:] == (3, 2)
    f = catalogues.plural_index("(n%10==1 && n%100!=11 ? 0 : n%10>=2 && n%10<=4 && (n%100<10 || n%100>=20) ? 1 : 2)")
    assert [f(n) for n in (1, 2, 5, 11, 21, 22, 112)] == [0, 1, 2, 2, 0, 1, 2]
    with pytest.raises(ValueError):
        catalogues.plural_index("__import__('os')")
    s = catalogues.source_messages(spark.createDataFrame([("m.src", '_("Go") x _("Stop")\n_("Go")')], "path string, body string"))
    assert {r["msgid"]: [p["line"] for p in r["places"]] for r in s.collect()} == {"Go": [1, 2], "Stop": [1]}


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("a.mp3", "t", 1.5, 2.0, 0, 4)], "audio string, text string, start_time double, end_time double, start_pos int, end_pos int")
    body = json.loads(sinks.alignment_json(s).first()["body"])
    assert body["granularity"] == "sentence" and body["sentences"][0]["start_time"] == 1.5 and list(body) == sorted(body)
    assert [r[0] for r in spark.createDataFrame([(1.5,), (2.0,), (0.1239,)], "x double").select(sinks.number_text(F.col("x"))).collect()] == ["1.5", "2", "0.124"]
    e = spark.createDataFrame([("screenshot", 1.0), ("tap", 2.0)], "type string, t double")
    for _ in range(2):
        sinks.append_events(e, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert sinks.session_manifest(e, {"model": "m"}).first().asDict() == {"model": "m", "events": 2, "frames": 1, "audio_files": 0}
    sinks.swap(e, str(tmp_path / "t"))
    sinks.swap(e.limit(1), str(tmp_path / "t"))
    assert sinks.current(spark, str(tmp_path / "t")).count() == 1
    assert sinks.without_keys(e, e.limit(1), "type").count() == 1
    assert sinks.progress_updates(e.limit(0)) == [] and sinks.progress_updates(e.limit(1))[0][0].endswith("local")
    assert len(json.loads(sinks.progress_updates(e)[0][1])["sessions"]) == 2


