"""Text as columns: normal forms, sentences, clauses, chunks, words.

Lengths that a rule compares are UTF-8 byte lengths; positions are 1-based character positions. A hard cut never
splits a character. Patterns are ASCII, as Java's are by default."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "\u0001"
PUNCT = r"!-/:-@\[-`{-~"
#: Byte lengths of chunking: the longest chunk, the longest when splitting hard, the shortest.
LONGEST, LONGEST_HARD, SHORTEST = 300, 150, 80
#: Words before which a comma ends a clause.
CONJUNCTIONS = ["and", "but", "or", "nor", "for", "yet", "so", "which", "who", "that", "where", "when", "while", "although", "because", "since", "unless", "if", "after", "before"]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside higher-order functions nothing else shares it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return trimmed(F.regexp_replace(c, r"\s+", " "))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalize(c: Column) -> Column:
    """Paragraphs as lines: blank lines part them, other line ends become spaces, wrapped words are joined.

    Text whose lines are mostly one or two bytes long (more than five lines, over half of them) is one paragraph."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[\\x00-\\x08\\x0B-\\x1F]", "")
    c = F.regexp_replace(c, "\n[ \t]*\n+", MARK)
    c = F.regexp_replace(c, rf"([^\s{PUNCT}])-\n([^\s{PUNCT}])", "$1$2")
    c = trimmed(F.regexp_replace(F.translate(F.replace(c, F.lit("\n"), F.lit(" ")), MARK, "\n"), "[ \t]+", " "))

    def guard(t: Column) -> Column:
        many = lambda lines: (F.size(lines) > 5) & (F.size(F.filter(lines, lambda x: F.octet_length(x) <= 2)) > 0.5 * F.size(lines))
        return F.when(let(F.filter(F.split(t, "\n"), lambda x: x != ""), many), F.translate(t, "\n", " ")).otherwise(t)

    return let(c, guard)


def sentences(normal: Column) -> Column:
    """array<struct<text, end_type>> of normalized text; the last sentence of a line ends its paragraph."""

    def of_line(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.regexp_replace(line, r"([.?!])\s+", f"$1{MARK}"), MARK), trimmed), lambda x: x != "")
        last = lambda p, i: F.when(i == F.size(p) - 1, "paragraph").otherwise("sentence")
        return let(parts, lambda p: F.transform(p, lambda x, i: F.struct(x.alias("text"), last(p, i).alias("end_type"))))

    return F.flatten(F.transform(F.split(normal, "\n"), of_line))


def locate_all(text: Column, parts: Column) -> Column:
    """array<struct<start_pos, end_pos>>: where each part stands, searched from the end of the part before; 0, 0 if it
    is not found, and the search then goes on from the same place."""
    zero = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start_pos:int,end_pos:int>>)").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        p = F.position(part, text, acc["at"])
        end = p + F.length(part) - 1
        pair = F.when(p > 0, F.struct(p.alias("start_pos"), end.alias("end_pos"))).otherwise(F.struct(F.lit(0).alias("start_pos"), F.lit(0).alias("end_pos")))
        return F.struct(F.when(p > 0, end + 1).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], F.array(pair)).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def clauses(c: Column) -> Column:
    """Cut after "; ", ": " and " - ", and after a comma before a conjunction; trimmed, none empty."""
    cut = rf"(;|:|,(?= (?:{'|'.join(CONJUNCTIONS)})(?:\s|$))| -) "
    return F.filter(F.transform(F.split(F.regexp_replace(c, cut, f"$1{MARK}"), MARK), trimmed), lambda x: x != "")


def merge_short(chunks: Column, least: int = SHORTEST) -> Column:
    """Chunks under `least` bytes join the chunk before them; a short first one then joins the next."""
    empty = F.expr("cast(array() as array<string>)")

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc)
        joined = F.concat(F.slice(acc, 1, n - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), x)))
        return F.when((F.octet_length(x) < least) & (n > 0), joined).otherwise(F.concat(acc, F.array(x)))

    def forward(m: Column) -> Column:
        n = F.size(m)
        first = F.concat(F.array(F.concat(F.get(m, F.lit(0)), F.lit(" "), F.get(m, F.lit(1)))), F.slice(m, 3, F.greatest(n - 2, F.lit(0))))
        return F.when((n > 1) & (F.octet_length(F.get(m, F.lit(0))) < least), first).otherwise(m)

    return let(F.aggregate(chunks, empty, step), forward)


def cap_words(text: str, longest: int = LONGEST, least: int = SHORTEST) -> list[str]:
    """Cut at the last space at or before `longest` bytes; a word without one is cut hard and keeps all its
    characters. A short last part joins the chunk before, without a space where the cut was hard."""
    rest, out, hard = text.encode(), [], False
    while len(rest) > longest:
        at = rest.rfind(b" ", 0, longest)
        hard = at <= 0
        if hard:
            at = longest
            while at > 1 and rest[at] & 0xC0 == 0x80:
                at -= 1
            out.append(rest[:at])
            rest = rest[at:]
        else:
            out.append(rest[:at])
            rest = rest[at + 1 :]
    if rest:
        if len(rest) < least and out:
            out[-1] += (b"" if hard else b" ") + rest
        else:
            out.append(rest)
    return [x.decode() for x in out]


def wrap_words(text: str, longest: int) -> list[str]:
    """Greedy wrap: white space collapses, a word longer than `longest` bytes stays whole, nothing is merged back."""
    out: list[str] = []
    size = 0
    for word in text.split():
        n = len(word.encode())
        if out and size + 1 + n <= longest:
            out[-1] += f" {word}"
            size += 1 + n
        else:
            out.append(word)
            size = n
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def cap_chunks(chunks: pd.Series, longest: pd.Series) -> pd.Series:
    """Each chunk over `longest` bytes is cut at words; the others stay."""
    return pd.Series([None if c is None else [p for x in c for p in (cap_words(x, int(n)) if len(x.encode()) > n else [x])] for c, n in zip(chunks, longest)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrapped(text: pd.Series, longest: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else wrap_words(t, int(n)) for t, n in zip(text, longest)])


def split_long(c: Column, longest: int = LONGEST) -> Column:
    """A sentence of more than `longest` bytes as clauses, short ones merged, long ones cut at words."""
    return F.when(F.octet_length(c) > longest, cap_chunks(merge_short(clauses(c)), F.lit(longest))).otherwise(F.array(c))


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrap_chunks(chunks: pd.Series, longest: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else [p for x in c for p in (wrap_words(x, int(n)) if len(x.encode()) > n else [x])] for c, n in zip(chunks, longest)])


def hybrid_wrap(c: Column, longest: int = LONGEST) -> Column:
    """Clauses first; each clause over `longest` bytes is wrapped greedily."""
    return wrap_chunks(clauses(c), F.lit(longest))


@F.udtf(returnType=T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("end_type", T.StringType())]))
class LongSplit:
    """The same split as a table function of (sentence, end_type, longest): all chunks but the last end a sentence."""

    def eval(self, text: str, end_type: str, longest: int) -> Iterator[tuple[int, str, str]]:
        if text is None:
            return
        chunks = plain_split_long(text, longest)
        for i, x in enumerate(chunks):
            yield i + 1, x, end_type if i == len(chunks) - 1 else "sentence"


def plain_split_long(text: str, longest: int = LONGEST, least: int = SHORTEST) -> list[str]:
    """split_long for one string."""
    import re

    if len(text.encode()) <= longest:
        return [text]
    cut = rf"(;|:|,(?= (?:{'|'.join(CONJUNCTIONS)})(?:\s|$))| -) "
    merged: list[str] = []
    for x in re.sub(cut, rf"\1{MARK}", text, flags=re.ASCII).split(MARK):
        x = x.strip(" \t\n\r\x0b\x0c")
        if x and len(x.encode()) < least and merged:
            merged[-1] += f" {x}"
        elif x:
            merged.append(x)
    if len(merged) > 1 and len(merged[0].encode()) < least:
        merged[:2] = [f"{merged[0]} {merged[1]}"]
    return [p for x in merged for p in (cap_words(x, longest, least) if len(x.encode()) > longest else [x])]


def strip_punct(c: Column) -> Column:
    """ASCII punctuation off both ends."""
    return F.regexp_replace(c, rf"^[{PUNCT}]+|[{PUNCT}]+$", "")


def words(c: Column) -> Column:
    """array<struct<text, clean_text>>; tokens of punctuation alone are not words."""
    tokens = F.transform(F.split(trimmed(c), r"\s+"), lambda x: F.struct(x.alias("text"), strip_punct(x).alias("clean_text")))
    return F.filter(tokens, lambda x: x["clean_text"] != "")


def clean_words(c: Column) -> Column:
    """The clean texts alone."""
    return F.transform(words(c), lambda x: x["clean_text"])


def match_form(c: Column) -> Column:
    """The form in which passages are compared. Order counts: a no-break space becomes a space after runs of white
    space have been collapsed, so two of them stay two spaces."""
    c = F.regexp_replace(F.regexp_replace(c, "[\r\n]+", " "), r"\s+", " ")
    c = F.regexp_replace(c, "[\u2018-\u201b]", "'")
    c = F.regexp_replace(c, "[\u201c-\u201f\u00ab\u00bb]", '"')
    c = F.regexp_replace(c, "[\u2013\u2014]", "-")
    c = F.translate(F.regexp_replace(c, "\u2026", "..."), "\u00a0", " ")
    c = F.regexp_replace(c, "[\u00ad\u200b\u2029\ufeff]", "")
    return trimmed(F.regexp_replace(c, "''+", "'"))


def syllables(c: Column) -> Column:
    """Runs of vowels, less a final silent e where there are more, one at least."""
    low = ascii_lower(c)
    runs = F.size(F.regexp_extract_all(low, F.lit("[aeiouy]+"), F.lit(0)))
    return F.greatest(F.lit(1), runs - F.when(c.rlike("[eE]$") & (runs > 1), 1).otherwise(0))


def speech_text(c: Column) -> Column:
    """One line for a synthesizer: line ends become spaces, ellipses and runs of dots a comma."""
    c = F.translate(c, "\n\r", " ")
    return F.regexp_replace(c, "\u2026|\\.\\.+", ", ")


def speech_json(text: Column, **fields: Column) -> Column:
    """One JSON line for a synthesizer."""
    return F.to_json(F.struct(text.alias("text"), *[v.alias(k) for k, v in fields.items()]))


def clause_breaks(c: Column, pause: str = "150ms") -> Column:
    """SSML: ampersands escaped, angle brackets dropped, a pause after commas, semicolons, colons and dashes."""
    c = F.translate(F.replace(c, F.lit("&"), F.lit("&amp;")), "<>", "")
    return F.regexp_replace(F.regexp_replace(c, r"([,;:])\s", f'$1 <break time="{pause}"/> '), "([\u2013\u2014])", f'$1<break time="{pause}"/>')


@F.pandas_udf(T.BinaryType())
def cp1252(text: pd.Series) -> pd.Series:
    """Windows-1252 bytes; what it lacks becomes a question mark."""
    return text.map(lambda t: None if t is None else t.encode("cp1252", "replace"))


def compact_markup(c: Column) -> Column:
    """No white space between tags."""
    return F.regexp_replace(c, r">\s+<", "><")


def placeholders(c: Column) -> Column:
    """The %1, %2, ... of a message."""
    return F.regexp_extract_all(c, F.lit(r"%\d+"), F.lit(0))


def same_placeholders(a: Column, b: Column) -> Column:
    return F.array_sort(placeholders(a)) == F.array_sort(placeholders(b))


def protect_placeholders(c: Column) -> Column:
    """%1 becomes a token that translation leaves alone."""
    return F.regexp_replace(c, r"%(\d+)", "__PH$1__")


def restore_placeholders(c: Column) -> Column:
    return F.regexp_replace(c, r"__\s*PH\s*(\d+)\s*__", "%$1")


def replace_in_order(c: Column, pairs: Column) -> Column:
    """Apply literal replacements array<struct<old, new>> one after another."""
    return F.aggregate(pairs, c, lambda acc, p: F.replace(acc, p["old"], p["new"]))


def book_language(tag: Column) -> Column:
    """A language tag in lower case with hyphens; the bare tags zh, ja, ko and en get a region."""
    t = F.lower(F.replace(tag, F.lit("_"), F.lit("-")))
    return F.when(t == "zh", "zh-CN").when(t == "ja", "ja-JP").when(t == "ko", "ko-KR").when(t == "en", "en-US").otherwise(t)


def chunk_language(c: Column, tag: Column, override: Column | None = None) -> Column:
    """The language to speak a chunk in: the override, else by script, else the book's, else en-US."""
    book = book_language(tag)
    han = F.when(book == "ja-JP", "ja-JP").when(book.rlike("^zh-(tw|hant|hk|mo)"), "zh-TW").otherwise("zh-CN")
    script = F.when(c.rlike("[\u3040-\u30ff]"), "ja-JP").when(c.rlike("[\ua000-\ud7ff]"), "ko-KR").when(c.rlike("[\u4000-\u9fff]"), han)
    return F.coalesce(override if override is not None else F.lit(None).cast(T.StringType()), script, book, F.lit("en-US"))
