"""Paths, hashes, cache keys and byte codecs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_path(c: Column) -> Column:
    """Remove the first "segment/../" until there is none (".." is a segment as well), then leading "./"."""
    def step(acc: Column, part: Column) -> Column:
        return F.when((part == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    last = F.element_at(F.split(c, "/"), -1)
    folders = F.slice(F.split(c, "/"), 1, F.size(F.split(c, "/")) - 1)
    kept = F.aggregate(folders, F.expr("cast(array() as array<string>)"), step)
    joined = F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "/"), F.lit("/"), last)).otherwise(last)
    return F.regexp_replace(joined, r"^(\./)+", "")


def valid_member(c: Column) -> Column:
    """A relative path inside an archive: not absolute, no control character, no "." or ".." segment."""
    return ~c.startswith("/") & ~c.rlike(r"[\x00-\x1f\x7f]") & ~F.exists(F.split(c, "/"), lambda x: x.isin(".", ".."))


def normal_folder(c: Column) -> Column:
    """No repeated or trailing slashes; empty is "."."""
    t = F.regexp_replace(F.regexp_replace(c, "/+", "/"), "(?<=.)/$", "")
    return F.when(t == "", ".").otherwise(t)


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]+)$", 1)


def scrub_home(c: Column) -> Column:
    """The user's name in a home folder is hidden."""
    return F.regexp_replace(c, r"/home/[^/]+", "/home/<user>")


def byte_values(c: Column) -> Column:
    """UTF-8 bytes of a string, or the bytes of a binary, as array<int>."""
    hexed = F.hex(c)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(hexed) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.coalesce(F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.lit(-1)))


def times_hash(c: Column, factor: int = 33, seed: int = 5381) -> Column:
    """h * factor + byte modulo 2**32 over the UTF-8 bytes, as 8 hex digits."""
    known = F.filter(byte_values(c), lambda b: b >= 0)
    h = F.aggregate(known, F.lit(seed).cast("long"), lambda acc, b: F.pmod(acc * factor + b, F.lit(2**32)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def position_key(path: Column) -> Column:
    """Key of a saved position."""
    return F.concat(F.lit("pos_"), times_hash(path))


def digest(c: Column, strong: bool = True) -> Column:
    """md5, or the multiplicative hash where md5 is not wanted."""
    return F.md5(c) if strong else times_hash(c, 31, 0)


def fingerprint(size: Column, modified: Column) -> Column:
    """size:mtime in whole seconds, a cache's invalidation key."""
    return F.concat_ws(":", size.cast("string"), F.unix_seconds(modified).cast("string"))


def uint_le(data: Column, at: int, n: int) -> Column:
    """Little-endian unsigned number of n bytes at 0-based offset `at` of a binary."""
    part = F.substring(data, at + 1, n)
    return F.aggregate(F.reverse(F.filter(byte_values(part), lambda b: b >= 0)), F.lit(0).cast("long"), lambda acc, b: acc * 256 + b)


def uint_be(data: Column, at: int, n: int) -> Column:
    part = F.substring(data, at + 1, n)
    return F.aggregate(F.filter(byte_values(part), lambda b: b >= 0), F.lit(0).cast("long"), lambda acc, b: acc * 256 + b)


def synchsafe(data: Column, at: int) -> Column:
    """28-bit number in four bytes of seven bits."""
    part = F.substring(data, at + 1, 4)
    return F.aggregate(F.filter(byte_values(part), lambda b: b >= 0), F.lit(0).cast("long"), lambda acc, b: acc * 128 + b % 128)
