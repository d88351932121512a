"""Fuzzy matches of passages: scored top-1, cascades, and matches by normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import collapse_space, match_form, words

PREFIX, NEEDLE, BONUS = 40, 80, 200
#: The score of a known fragment, and more places than a book has entries; places are not negative.
KNOWN, PLACES = 1_000_000, 1 << 40


def match_score(entry: Column, selection: Column) -> Column:
    """How well an entry's text matches a selection, both in match form: equal, containing, contained, by the
    selection's first 80 characters, by the entry's first 40; 0 for none."""
    needle = F.substring(selection, 1, NEEDLE)
    bonus = lambda c, n: F.least(F.octet_length(c), F.lit(n))
    return (
        F.when(entry == selection, 10000)
        .when(F.contains(entry, selection), 5000 + bonus(selection, BONUS))
        .when(F.contains(selection, entry), 4000 + bonus(entry, BONUS))
        .when(F.contains(entry, needle), 2000 + bonus(needle, NEEDLE))
        .when(F.contains(needle, F.substring(entry, 1, PREFIX)), 1000)
        .otherwise(0)
    )


def best_match(selections: DataFrame, entries: DataFrame, book: str = "book") -> DataFrame:
    """The best entry (seq, text, fragment_id) of its book for each selection (sel_id, text, fragment_id).

    A known fragment id decides; else the highest score, the first entry of equals, also if the score is 0.
    The scoring joins within a book, and keeps one row for each selection after a partial maximum."""
    s = selections.select(book, "sel_id", match_form(F.col("text")).alias("sel"), F.col("fragment_id").alias("frag"))
    e = entries.select(book, "seq", match_form(F.col("text")).alias("entry"), F.col("fragment_id").alias("entry_frag"))
    j = s.where("sel <> '' OR frag IS NOT NULL").join(e, book)
    by_id = F.coalesce(F.col("frag") == F.col("entry_frag"), F.lit(False))
    usable = by_id | (F.coalesce("entry", F.lit("")) != "") & (F.col("sel") != "")
    score = F.when(by_id, KNOWN).otherwise(match_score(F.col("entry"), F.col("sel"))).cast("long")
    # score and place in one number, the earlier place the greater: the maximum is then a hash aggregate, not a sort
    best = j.where(usable).groupBy(book, "sel_id").agg(F.max(score * PLACES - F.col("seq")).alias("b"))
    top = F.expr(f"-((-b) div {PLACES}L)") + F.when(F.expr(f"b > 0 AND b % {PLACES}L > 0"), 1).otherwise(0)
    found = best.withColumn("top", top)
    return found.select(book, "sel_id", (F.col("top") * PLACES - F.col("b")).alias("seq"), F.when(F.col("top") != KNOWN, F.col("top").cast("int")).alias("score"))


def whole_match(selections: DataFrame, entries: DataFrame, book: str = "book") -> DataFrame:
    """best_match, for selections of which most equal an entry of their book: these are found by an equality join, since
    no score is higher, and only the others are scored. Selections with a fragment id are scored."""
    form = entries.select(book, match_form(F.col("text")).alias("__form"), "seq").where("__form <> ''")
    first = form.groupBy(book, "__form").agg(F.min("seq").alias("__seq"), F.lit(True).alias("__equal"))
    formed = selections.withColumn("__form", F.when(F.col("fragment_id").isNull(), match_form(F.col("text"))))
    tried = formed.join(first, [book, "__form"], "left")
    equal = tried.where("__equal").groupBy(book, "sel_id").agg(F.min("__seq").alias("seq")).withColumn("score", F.lit(10000))
    return equal.unionByName(best_match(tried.where("__equal IS NULL").select(*selections.columns), entries, book))


def cascade(page: Column, sentence: Column) -> Column:
    """struct<pos, how>: where a sentence stands on a page, 1-based: whole; by its first 40, 20 or 10 characters; by its
    last; by its first 3 or 2 words; by its last. NULL if nowhere."""
    n = F.length(sentence)
    w = F.split(collapse_space(sentence), " ")
    tries = [("exact", F.position(sentence, page), F.lit(True))]
    tries += [(f"prefix{k}", F.position(F.substring(sentence, 1, k), page), n > k) for k in (40, 20, 10)]
    tries += [(f"suffix{k}", F.position(F.right(sentence, F.lit(k)), page), n > k) for k in (40, 20, 10)]
    tries += [(f"words{k}", F.position(F.array_join(F.slice(w, 1, k), " "), page), F.size(w) >= 3) for k in (3, 2)]
    tries += [(f"tail{k}", F.position(F.array_join(F.slice(w, -k, k), " "), page), F.size(w) >= 3) for k in (3, 2)]
    return F.coalesce(*[F.when(ok & (p > 0), F.struct(p.alias("pos"), F.lit(how).alias("how"))) for how, p, ok in tries])


def remap(old: DataFrame, new: DataFrame, book: str = "book") -> DataFrame:
    """New sentences (book, index, text) with the times of the first old one of equal collapsed text; they are taken
    over only if the word counts agree."""
    form = lambda df: df.withColumn("__form", collapse_space(F.col("text"))).withColumn("__words", F.size(words(F.col("text"))))
    o = form(old).groupBy(book, "__form").agg(F.min_by(F.struct("index", "__words", "start_time", "end_time"), "index").alias("o"))
    j = form(new).join(o, [book, "__form"], "left")
    same = F.col("o.__words") == F.col("__words")
    return j.select(*new.columns, F.col("o.index").alias("old_index"), F.when(same, F.col("o.start_time")).alias("start_time"), F.when(same, F.col("o.end_time")).alias("end_time"))
