"""URL filters: host and path rules, and a Bloom filter cascade for the rest.

The cascade holds a list of keys so that every key of a known universe is told exactly.
Level 1 is a Bloom filter of the listed keys; level 2 one of the universe's other keys that
pass level 1; level 3 one of the listed keys that pass level 2, and so on, until nothing
passes by mistake. A key is listed if the number of levels that it passes before it is
turned away is odd. No key is stored, and no join is needed to ask: the levels' bits enter
the plan as scalar subqueries. A level is cut into segments of at most `segment_bits` by a hash
of the key, so that no task gathers more than one segment and no value of the plan is larger,
however long the list is. All segments together take about 1.5 bytes for a listed key, and each
executor holds them. Every level hashes anew, so what passes one by mistake is a sixteenth of
what came, and the levels end by themselves.

Everything here is DataFrame functions. Defined results: a null url, and one without
``://``, has empty host and path, fits no rule and is not listed; very long urls are read whole.
Null keys are ignored; repeated keys count once; an empty list turns every key away; an empty
table gives an empty one. Of equally long rules that fit the first one counts. Repeated rows are
judged each by itself. A column named like an added one, in whatever case, gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.scratch import Scratch

#: Fixed values of the rule set.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """hashes: positions for each key, so that 2**-hashes of other keys pass a level. segment_bits: most bits of one segment of a level."""

    hashes: int = 4
    segment_bits: int = 1 << 26


@dataclass(frozen=True)
class Level:
    """segments: the bits of each segment as one row with an array of words. size: bits of a segment."""

    segments: list[DataFrame]
    size: int


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; the first of equally long ones. Null where none fits."""
    rule = action = None
    for does, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        action = F.when(fits, does) if action is None else action.when(fits, does)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, action


def _positions(key: Column, level: int, size: int, hashes: int) -> list[Column]:
    # the level comes first, so that two keys whose hashes agree in one level do not in the next
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(size)) for i in range(hashes)]


def _segment(key: Column, level: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(-1), key), F.lit(n)).cast("int") if n > 1 else F.lit(0)


def _level(keys: DataFrame, count: int, number: int, settings: Settings, scratch: Scratch) -> Level:
    bits = count * settings.hashes / math.log(2)
    n = max(1, math.ceil(bits / settings.segment_bits))
    words = max(1, math.ceil(bits / n / 64))
    size = words * 64
    spots = keys.select(_segment(F.col("key"), number, n).alias("segment"), F.explode(F.array(*_positions(F.col("key"), number, size, settings.hashes))).alias("at"))
    ones = spots.select("segment", F.floor(F.col("at") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bits"))
    # a zero word at every place, so that the arrays are dense
    zeros = keys.sparkSession.range(n * words).select(F.floor(F.col("id") / words).cast("int").alias("segment"), (F.col("id") % words).alias("word"), F.lit(0).cast("long").alias("bits"))
    full = ones.unionByName(zeros).groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
    rows = full.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    kept = scratch.keep(rows.select("segment", F.transform("words", lambda w: w["bits"]).alias("bits")), "level")
    return Level([kept.where(F.col("segment") == k).select("bits") for k in range(n)], size)


def _passes(key: Column, number: int, level: Level, hashes: int) -> Column:
    own, bits = _segment(key, number, len(level.segments)), None
    for k, segment in enumerate(level.segments[:-1]):
        bits = F.when(own == k, segment.scalar()) if bits is None else bits.when(own == k, segment.scalar())
    last = level.segments[-1].scalar()
    bits = last if bits is None else bits.otherwise(last)
    found = None
    for at in _positions(key, number, level.size, hashes):
        word = F.element_at(bits, (F.floor(at / 64) + 1).cast("int"))
        one = F.call_function("getbit", word, (at % 64).cast("int")) == 1
        found = one if found is None else found & one
    return found


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]
    hashes: int

    def holds(self, key: Column) -> Column:
        """True for listed keys of the universe, false for its other keys and for null."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            verdict = F.when(_passes(key, number, self.levels[number - 1], self.hashes), verdict).otherwise(F.lit(number % 2 == 0))
        return F.coalesce(key.isNotNull() & verdict, F.lit(False))


def build(listed: DataFrame, universe: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> Cascade:
    """The cascade that tells the listed keys within the universe; both have the column key."""
    named = [f.select(F.col("key").cast("string").alias("key"), F.lit(k).alias("is_listed")) for f, k in ((universe, False), (listed, True))]
    marks = named[0].unionByName(named[1]).where("key IS NOT NULL").groupBy("key").agg(F.bool_or(~F.col("is_listed")).alias("known"), F.bool_or("is_listed").alias("is_listed"))
    marked = scratch.keep(marks.where("known").select("key", "is_listed"), "keys")
    inside, outside = marked.where("is_listed").select("key"), marked.where("NOT is_listed").select("key")
    levels: list[Level] = []
    count = inside.count()
    while count:
        number = len(levels) + 1
        level = _level(inside, count, number, settings, scratch)
        levels.append(level)
        wrong = scratch.keep(outside.where(_passes(F.col("key"), number, level, settings.hashes)), "wrong")
        inside, outside, count = wrong, inside, wrong.count()
    return Cascade(levels, settings.hashes)


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] = RULES, settings: Settings = Settings(), url: str = "url") -> DataFrame:
    """pages with host, path, rule, listed and verdict.

    The verdict is the longest fitting rule's; where none fits, block if the host or its
    domain is listed, else allow.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    out = pages.drop("host", "path", "rule", "listed", "verdict").withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    hosts = out.select("host").distinct()
    universe = hosts.select(F.explode(F.array(F.col("host"), domain_of(F.col("host")))).alias("key"))
    cascade = build(listed, universe, scratch, settings)
    out = out.withColumn("listed", cascade.holds(F.col("host")) | cascade.holds(domain_of(F.col("host"))))
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow")))
