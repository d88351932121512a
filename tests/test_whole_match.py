import __spark_entry__

from lectern.operators import matching

LONG = "a sentence of more than eighty characters, so that its first part alone is not the whole of it, one"


def plain_score(entry, sel):
    needle = sel[:80]
    if entry == sel:
        return 10000
    if sel in entry:
        return 5000 + min(len(sel), 200)
    if entry in sel:
        return 4000 + min(len(entry), 200)
    if needle in entry:
        return 2000 + min(len(needle), 80)
    return 1000 if entry[:40] in needle else 0


def test_whole_match_against_brute_force(spark):
    """Equal, containing, contained, by the needle, by the prefix and not at all; texts in match form already."""
    texts = ["one two three", "two", "one two three", LONG, f"{LONG[:-3]}two", f"{LONG[:42]} but then another end", "", "zzz"]
    other = ["one two", "two", f"{LONG[:-3]}three", f"so {LONG} and more", "one two three four", "nothing alike", LONG, "", LONG[:60]]
    e = [("b", i, t, None) for i, t in enumerate(texts)] + [("c", 1, "two", None), ("d", 1, texts[5], None)]
    s = [("b", i, t, None) for i, t in enumerate(other)] + [("c", 7, "two", None), ("d", 8, LONG, None)]
    entries = spark.createDataFrame(e, "book string, seq int, text string, fragment_id string")
    sels = spark.createDataFrame(s, "book string, sel_id int, text string, fragment_id string")
    want = []
    for book, i, sel, _ in s:
        found = [(plain_score(t, sel), -k) for b, k, t, _ in e if b == book and t]
        if sel:
            want.append((book, i, -max(found)[1], max(found)[0]))
    got = sorted(tuple(r) for r in matching.whole_match(sels, entries).select("book", "sel_id", "seq", "score").collect())
    assert got == sorted(want)
    assert {2000, 1000, 0} <= {w[3] // 1000 * 1000 for w in want}


def test_every_sentence_is_a_selection(spark, tmp_path):
    docs = [(1, "One is here. Two is here! One is here. Three is there? A fifth one. A sixth one. A seventh."), (2, "Alone.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["sel_id"], r["seq"], r["score"]) for r in __spark_entry__.queries()["scored_match_whole"](spark, str(tmp_path)).collect())
    assert got == [(1, i, 1 if i == 3 else i, 10000) for i in range(1, 8)] + [(2, 1, 1, 10000)]
