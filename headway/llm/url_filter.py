"""URL rules answered by Bloom filter cascades.

A rule is a host and a path prefix (``example.net/en/``) with a verdict.  It fits its host and every subdomain if the
URL's path starts with the rule's; the longest rule that fits wins (the longer host among equally long ones).

The candidates of a URL are its host's endings times the beginnings of its path, of the shapes (labels, characters) that
occur among the rules.  All candidates over the corpus are the key universe.  Per verdict, a cascade of Bloom filters
gives exact membership in that universe: level 0 encodes the listed keys; level 1 those keys of the universe that pass
level 0 though they aren't listed; level 2 the listed keys that pass level 1; and so on until a level has no false
positives.  A key belongs to the class of the first level that rejects it, so rows are judged by hashing alone: no join,
no shuffle, and no rule leaves the filters.  Building reads the URLs once per level and tests before it makes keys
distinct (few pass).

A filter is a binary literal of the plan with a bit per position (the driver's copy has a byte).  Keys are dealt by hash to
parts, rules and universe alike, and no driver's copy of any level holds more than ``MAX_BYTES``, whatever the length of the
list and the size of the corpus: where one would, all is dealt to twice as many parts.  Each part has its own cascades and its own
pass over the table, which carries the best rule found so far.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no rule; the default verdict is
``allow``; a key listed under both verdicts blocks; null rules and other verdicts are ignored; no rules allow all; URLs of
any length are judged whole; repeated rows are judged alike; an empty table gives an empty result; columns of the input
with the name of an added one are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, scope

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BITS_PER_KEY, HASHES, MAX_BYTES, MAX_LEVELS, MAX_PARTS = 16, 6, 1 << 25, 64, 1 << 16


class FilterTooLarge(Exception):
    """A level would hold more than its bound."""


@dataclass(frozen=True)
class Level:
    """A Bloom filter: a byte (0 or 1) for each position, and its number in the cascade, which seeds the hashes."""

    number: int
    bits: bytes
    hashes: int

    def holds(self, key: Column) -> Column:
        packed = np.packbits(np.frombuffer(self.bits, np.uint8), bitorder="little").tobytes()
        yes, bits = F.lit(True), F.lit(bytearray(packed))
        for at in _positions(key, self.number, len(self.bits), self.hashes):
            eight = F.ascii(F.decode(F.substring(bits, F.shiftright(at, 3) + 1, F.lit(1)), "ISO-8859-1"))
            yes = yes & (F.getbit(eight, F.pmod(at, F.lit(8))) == 1)
        return yes


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)).cast("int") for i in range(hashes)]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path."""
    url = F.coalesce(url, F.lit(""))
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of (key, size, host's size) for each shape (labels of the host, characters of the path) that fits."""
    known = F.from_json(F.lit(json.dumps([{"n": n, "m": m} for n, m in shapes])), "array<struct<n:int,m:int>>")
    fitting = F.filter(known, lambda s: (host != "") & (F.size(F.split(host, r"\.")) >= s["n"]) & (F.length(path) >= s["m"]))

    def one(s: Column) -> Column:
        ending = F.call_function("substring_index", host, F.lit("."), -s["n"])
        return F.struct(F.concat(ending, F.substring(path, F.lit(1), s["m"])).alias("key"), (F.length(ending) + s["m"]).alias("size"), F.length(ending).alias("host_size"))

    return F.transform(fitting, one)


def bloom(keys: DataFrame, number: int, bits_per_key: int, hashes: int, most: int | None = None) -> Level | None:
    """The filter of the distinct ``key`` column, of at most so many positions; None if there are no keys."""
    if not (n := keys.count()):
        return None
    bits = 64 * -(-n * bits_per_key // 64)
    bits = min(bits, most) if most else bits
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("v"))
    filled = bytearray(bits)
    for w, v in words.toLocalIterator():
        filled[64 * w : 64 * w + 64] = bytes(v >> i & 1 for i in range(64))
    return Level(number, bytes(filled), hashes)


def _bounded(keys: DataFrame, number: int, bits_per_key: int, hashes: int, max_bytes: int) -> Level | None:
    """``bloom``, if it holds at most so many bytes; checked before it is made."""
    if (n := keys.count()) and 64 * -(-n * bits_per_key // 64) > max(max_bytes, 64):
        raise FilterTooLarge
    return bloom(keys, number, bits_per_key, hashes) if n else None


def build(listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY, hashes: int = HASHES, max_bytes: int = MAX_BYTES) -> list[Level]:
    """The cascade that is exact for the keys of ``universe``; both have a column ``key``.  Empty if nothing is listed.  Raises ``FilterTooLarge``."""
    inside = listed.filter("key is not null").distinct()
    if not (level := _bounded(inside, 0, bits_per_key, hashes, max_bytes)):
        return []
    levels = [level]
    outside = cut(universe.filter(level.holds(F.col("key"))).distinct().join(inside, "key", "left_anti"))
    here, there = outside, inside
    while level := _bounded(here, len(levels), bits_per_key, hashes, max_bytes):
        levels.append(level)
        if len(levels) > MAX_LEVELS:
            raise ValueError("the cascade doesn't end: more bits a key are needed")
        here, there = cut(there.filter(level.holds(F.col("key")))), here
    return levels


def listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: true if the first level that rejects it has an odd number."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        answer = F.when(level.holds(key), answer).otherwise(F.lit(level.number % 2 == 1))
    return answer


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("verdict")) for k, v in rules])))


def _in_part(part_of: Callable[[Column], Column], part: int) -> Callable[[Column], Column]:
    return lambda k: part_of(k["key"]) == part


def _judged(block: list[Level], allow: list[Level]) -> Callable[[Column], Column]:
    return lambda k: F.struct(k["size"].alias("size"), k["host_size"].alias("host_size"), k["key"].alias("key"), listed(k["key"], block).alias("block"), listed(k["key"], allow).alias("allow"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", bits_per_key: int = BITS_PER_KEY, hashes: int = HASHES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``.  ``rules``: ``key`` (host and path prefix), ``verdict`` (allow or block)."""
    host, path = split_url(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    rules = rules.filter("key is not null and verdict in ('allow', 'block')").groupBy("key").agg(F.max("verdict").alias("verdict"))
    rule_host = F.regexp_extract("key", r"^[^/]*", 0)
    # As many as there are labels and lengths of paths, however many rules.
    found = rules.select(F.size(F.split(rule_host, r"\.")).alias("n"), (F.length("key") - F.length(rule_host)).alias("m")).distinct().collect()
    shapes = sorted((r.n, r.m) for r in found)
    if not shapes:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    parts = max(1, -(-rules.count() * bits_per_key // max_bytes))
    while True:
        try:
            with scope():
                return _by_parts(rows, rules, shapes, parts, bits_per_key, hashes, max_bytes)
        except FilterTooLarge:
            parts *= 2
            if parts > MAX_PARTS:
                raise


def _by_parts(rows: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]], parts: int, bits_per_key: int, hashes: int, max_bytes: int) -> DataFrame:
    part_of = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))
    best = F.lit(None)
    for part in range(parts):
        mine = rules.filter(part_of(F.col("key")) == part) if parts > 1 else rules
        keys = candidates(F.col("host"), F.col("path"), shapes)
        keys = F.filter(keys, _in_part(part_of, part)) if parts > 1 else keys
        universe = rows.select(F.explode(keys).alias("k")).select("k.key")
        block, allow = (build(mine.filter(F.col("verdict") == v).select("key"), universe, bits_per_key, hashes, max_bytes) for v in ("block", "allow"))
        hit = F.array_max(F.filter(F.transform(keys, _judged(block, allow)), lambda k: k["block"] | k["allow"]))
        rows = rows.withColumn("__best", F.greatest(best, hit) if part else hit)
        rows = cut(rows, keep=True) if part + 1 < parts else rows
        best = F.col("__best")
    return rows.withColumns({"rule": best["key"], "verdict": F.when(best["block"], "block").otherwise("allow")}).drop("__best")
