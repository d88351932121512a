"""Hand-worked values of the column functions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import paths, text, times


def values(spark, rows, *columns, schema):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("A\r\nB", "A B"),
        ("para one.\n\n para two.", "para one.\n para two."),
        ("re-\nduce", "reduce"),
        ("x\x00y\x07z", "xyz"),
        ("  lead\ttab  ", "lead tab"),
        ("A-\n-B", "A- -B"),
        ("one\n \t\n\n\ntwo", "one\ntwo"),
        ("one\n \n \ntwo", "one\n two"),
        ("a\n\nb\n\nc\n\nd\n\ne\n\nf", "a b c d e f"),
        ("a\n\nb\n\nc\n\nd\n\ne", "a\nb\nc\nd\ne"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize(spark, raw, want):
    assert values(spark, [(raw,)], text.normalize(F.col("s")), schema="s string") == [(want,)]


def test_sentences(spark):
    got = values(spark, [('He said "Go!" now. Then... left? yes; no: end',)], text.sentences(F.col("s")), schema="s string")[0][0]
    assert [(x["text"], x["end_type"]) for x in got] == [('He said "Go!" now.', "sentence"), ("Then...", "sentence"), ("left?", "sentence"), ("yes; no: end", "paragraph")]


def test_positions(spark):
    s = "One. Two two.\nOne. End"
    df = spark.createDataFrame([(s,)], "s string").withColumn("parts", F.transform(text.sentences(F.col("s")), lambda x: x["text"]))
    r = df.select("parts", text.locate_all(F.col("s"), F.col("parts")).alias("pos")).first()
    assert [s[p["start_pos"] - 1 : p["end_pos"]] for p in r["pos"]] == r["parts"] == ["One.", "Two two.", "One.", "End"]


def test_clauses_and_merge(spark):
    got = values(spark, [("a; b: c - d, and e, then f, which",)], text.clauses(F.col("s")), schema="s string")
    assert got == [(["a;", "b:", "c -", "d,", "and e, then f,", "which"],)]
    assert values(spark, [(["aaa", "b" * 100],)], text.merge_short(F.col("c")), schema="c array<string>") == [(["aaa " + "b" * 100],)]
    assert values(spark, [(["b" * 100, "aa", "c" * 90, "d"],)], text.merge_short(F.col("c")), schema="c array<string>") == [(["b" * 100 + " aa", "c" * 90 + " d"],)]


def test_cap_words():
    assert text.cap_words("x" * 310) == ["x" * 310]
    assert text.cap_words("x" * 400) == ["x" * 300, "x" * 100]
    words = " ".join(["word"] * 100)
    parts = text.cap_words(words)
    assert " ".join(parts) == words and all(len(p) <= 379 for p in parts)
    assert "".join(text.cap_words("é" * 400)) == "é" * 400


def test_column_and_plain_split_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = docs.select(F.explode(F.transform(text.sentences(text.normalize(F.col("text"))), lambda x: x["text"])).alias("s"))
    for r in s.where("octet_length(s) > 200").select("s", text.split_long(F.col("s"), 150).alias("c")).collect():
        assert r["c"] == text.plain_split_long(r["s"], 150)


@pytest.mark.parametrize("raw, want", [("“A”—b…", '"A"-b...'), ("June'''s", "June's"), ("a­b", "ab"), ("a  b", "a  b")])
def test_match_form(spark, raw, want):
    assert values(spark, [(raw,)], text.match_form(F.col("s")), schema="s string") == [(want,)]


def test_syllables(spark):
    words = {"the": 1, "table": 1, "rhythm": 1, "queue": 1, "idea": 2, "Apple": 1, "area": 2, "é": 1, "": 1}
    got = values(spark, [(w,) for w in words], "s", text.syllables(F.col("s")), schema="s string")
    assert dict(got) == words


def test_words(spark):
    got = values(spark, [('"Hi," -- he said.',)], text.words(F.col("s")), schema="s string")[0][0]
    assert [(w["text"], w["clean_text"]) for w in got] == [('"Hi,"', "Hi"), ("he", "he"), ("said.", "said")]


def test_clocks(spark):
    want = {"0:00:05.234": 5.234, "1:02": 62, "25.180s": 25.18, "300ms": 0.3, "2.5min": 150, "1.5h": 5400, "7.5": 7.5, "abc": 0, None: 0}
    got = values(spark, [(k,) for k in want], "s", times.markup_clock_s(F.col("s")), schema="s string")
    assert {k: round(v, 9) for k, v in got} == want
    assert values(spark, [("abc",), ("x 1:02:03.5",)], times.chapter_clock_s(F.col("s")), schema="s string") == [(None,), (3723.5,)]


def test_paths(spark):
    want = {"MO/../Audio/x.mp3": "Audio/x.mp3", "a/b/../../c": "c", "../x": "../x", "../../x": "x", "./a": "a", "a/b/c": "a/b/c"}
    assert dict(values(spark, [(k,) for k in want], "s", paths.collapse_path(F.col("s")), schema="s string")) == want
    assert values(spark, [("a",), ("book.epub",)], paths.times_hash(F.col("s")), schema="s string") == [("0002b606",), ("57dd22ea",)]
    assert values(spark, [("a//b/",), ("",), ("/",)], paths.normal_folder(F.col("s")), schema="s string") == [("a/b",), (".",), ("/",)]


def test_sizes_and_versions(spark):
    assert values(spark, [(1023,), (1536,)], times.size_text(F.col("n")), schema="n long") == [("1023 B",), ("1.5 KB",)]
    got = values(spark, [("0.1.17", "0.1.17.0"), ("0.1.9", "0.1.10")], times.compare_versions(F.col("a"), F.col("b")), schema="a string, b string")
    assert got == [(0,), (-1,)]


def test_durations(spark):
    w = spark.createDataFrame([("Hi,", 1), ("you.", 2)], "w string, i int")
    got = w.select(times.neural_word_ms(F.col("w"), F.lit(1))).collect()
    assert [r[0] for r in got] == [310, 440]
    assert [round(x, 3) for x in times.factors(5.0)] == [2.0, 2.0, 1.25] and times.factors(1.0) == []


def test_languages(spark):
    got = values(spark, [("abc", "en"), ("かな", "en"), ("漢字", "zh_TW"), ("漢字", "ja"), ("한글", None), ("x", None)], text.chunk_language(F.col("s"), F.col("t")), schema="s string, t string")
    assert got == [("en-US",), ("ja-JP",), ("zh-TW",), ("ja-JP",), ("ko-KR",), ("en-US",)]


def test_messages(spark):
    got = values(spark, [("%1 of %2",)], text.placeholders(F.col("s")), text.restore_placeholders(text.protect_placeholders(F.col("s"))), schema="s string")
    assert got == [(["%1", "%2"], "%1 of %2")]
    pairs = F.array(F.struct(F.lit("a").alias("old"), F.lit("b").alias("new")), F.struct(F.lit("bb").alias("old"), F.lit("c").alias("new")))
    assert values(spark, [("ab",)], text.replace_in_order(F.col("s"), pairs), schema="s string") == [("c",)]


def test_binary(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04"),)], "b binary")
    assert tuple(df.select(paths.uint_le(F.col("b"), 0, 4), paths.uint_be(F.col("b"), 1, 2), paths.synchsafe(F.col("b"), 0)).first()) == (0x04030201, 0x0203, (1 << 21) + (2 << 14) + (3 << 7) + 4)
    assert bytes(spark.createDataFrame([("é€☃",)], "s string").select(text.cp1252(F.col("s"))).first()[0]) == "é€☃".encode("cp1252", "replace")
