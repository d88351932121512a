"""Clocks, durations, sizes and versions as columns.

Markup clocks turn what they cannot read into 0; chapter clocks turn it into NULL. Names end in the unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_GAP_MS = 50


def _d(c: Column) -> Column:
    return F.expr("try_cast(NULL AS DOUBLE)") if c is None else c.try_cast("double")


def markup_clock_s(c: Column) -> Column:
    """h:m:s, m:s, s, or a number with s, ms, min or h; NULL and anything else is 0."""
    t = F.trim(c)
    p = F.split(t, ":")
    number = r"\d+(\.\d*)?|\.\d+"
    part = lambda i: _d(F.get(p, F.lit(i)))
    unit = lambda u: _d(F.regexp_replace(t, f"{u}$", ""))
    v = (
        F.when(t.rlike(rf"^\d+:\d+:({number})$"), part(0) * 3600 + part(1) * 60 + part(2))
        .when(t.rlike(rf"^\d+:({number})$"), part(0) * 60 + part(1))
        .when(t.rlike(rf"^({number})ms$"), unit("ms") / 1000)
        .when(t.rlike(rf"^({number})s$"), unit("s"))
        .when(t.rlike(rf"^({number})min$"), unit("min") * 60)
        .when(t.rlike(rf"^({number})h$"), unit("h") * 3600)
        .when(t.rlike(rf"^({number})$"), _d(t))
    )
    return F.coalesce(v, F.lit(0.0))


def chapter_clock_s(c: Column) -> Column:
    """The first h:m:s, m:s or s in a string, NULL if there is none."""
    hms, ms, s = r"(\d+):(\d+):(\d+\.?\d*)", r"(\d+):(\d+\.?\d*)", r"(\d+\.?\d*)"
    g = lambda r, i: _d(F.regexp_extract(c, r, i))
    return F.when(c.rlike(hms), g(hms, 1) * 3600 + g(hms, 2) * 60 + g(hms, 3)).when(c.rlike(ms), g(ms, 1) * 60 + g(ms, 2)).when(c.rlike(s), g(s, 1))


def size_text(n: Column) -> Column:
    """Bytes as B, KB, MB or GB of 1024, one decimal from KB on."""
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.format_string("%.1f KB", F.bround(n / 1024, 1)))
        .when(n < 1024**3, F.format_string("%.1f MB", F.bround(n / 1024**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(n / 1024**3, 1)))
    )


def minutes_text(seconds: Column) -> Column:
    """m:ss, minutes without end; NULL is 0:00."""
    s = F.floor(F.coalesce(seconds, F.lit(0))).cast("long")
    return F.format_string("%d:%02d", F.expr("1L") * F.floor(s / 60), s % 60)


def clock_text(seconds: Column) -> Column:
    """m:ss, from an hour on h:mm:ss; NULL is 0:00."""
    s = F.floor(F.coalesce(seconds, F.lit(0))).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def hours_text(seconds: Column) -> Column:
    """Hh MMm, under an hour Mm; NULL is 0m."""
    s = F.floor(F.coalesce(seconds, F.lit(0))).cast("long")
    return F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).otherwise(F.format_string("%dm", F.floor(s / 60)))


def version_parts(c: Column) -> Column:
    """The numbers of a version."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; missing numbers are zeros, however many there are."""
    x, y = version_parts(a), version_parts(b)
    sides = F.zip_with(x, y, lambda p, q: F.signum(F.coalesce(p, F.lit(0)) - F.coalesce(q, F.lit(0))).cast("int"))
    return F.coalesce(F.get(F.filter(sides, lambda d: d != 0), F.lit(0)), F.lit(0))


def word_ms(syllables: Column, rate: float | Column = 1.0) -> Column:
    """Estimated speaking time of a word, 200 ms a syllable at rate 1."""
    return F.floor(syllables * 200 / (rate if isinstance(rate, Column) else F.lit(float(rate)))).cast("long")


def neural_word_ms(word: Column, syllables: Column, rate: float = 1.0, neural: bool = True) -> Column:
    """Estimated time of a token for a neural voice: 80 ms a byte of its letters, more before a pause; else by syllables."""
    if not neural:
        return word_ms(syllables, rate)
    clean = F.regexp_replace(word, r"[!-/:-@\[-`{-~]", "")
    pause = F.when(word.rlike(r"[,;:]$"), 150).when(word.rlike(r"[.?!]$"), 200).otherwise(0)
    return F.floor((F.octet_length(clean) * 80 + pause) / F.lit(float(rate))).cast("long")


def factors(speed: float, low: float = 0.5, high: float = 2.0) -> list[float]:
    """A playback speed as factors that each lie within the range one filter allows; none for a speed near 1."""
    out = []
    if abs(speed - 1) < 0.01:
        return out
    while speed > high:
        out.append(high)
        speed /= high
    while speed < low:
        out.append(low)
        speed /= low
    return [*out, speed]


def speed_factors(speed: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """The same as factors, for a column of speeds: as often the limit as the speed lies beyond its powers, then the rest."""
    steps = F.sequence(F.lit(1), F.lit(64))
    over = F.size(F.filter(steps, lambda i: speed > F.pow(F.lit(high), i)))
    under = F.size(F.filter(steps, lambda i: speed < F.pow(F.lit(low), i)))
    rest = speed / F.pow(F.lit(high), over) / F.pow(F.lit(low), under)
    whole = F.concat(F.array_repeat(F.lit(high), over), F.array_repeat(F.lit(low), under), F.array(rest))
    return F.when(F.abs(speed - 1) < 0.01, F.array().cast("array<double>")).otherwise(whole)
