"""URL filtering: host and path rules, then a Bloom filter cascade over the corpus's whole key universe.

The keys are the hosts of the table and all their parent domains. Level 0 of the cascade encodes the listed keys,
level 1 the unlisted keys that pass level 0, level 2 the listed keys that pass level 1, and so on until no key is left.
For keys of that universe, which are all keys that can be asked for, membership is exact. Testing a url needs no join: the
levels are literals in its expression. Level 0's false positive rate is listed / unlisted keys, so that about as many unlisted keys
pass it as are listed: its bits, and those of all further levels, follow the list and the logarithm of the universe.
Where the levels would have more than ``MAX_WORDS`` words (some millions of listed keys), the keys are dealt by hash into parts with a cascade
each, and the urls' hosts pass these one after the other; no plan holds more than one, and there is still no join.

Contract of ``judge``:
* host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or
  the end; a null url or one without ``://`` has both empty, fits no rule and is allowed;
* of the rules that fit (host or subdomain, and path prefix), the longest decides; ties go to the first given;
* else the url is blocked if its host or a parent domain is listed;
* repeated rows are judged alike, an empty table gives an empty result, an empty list blocks nothing,
  and extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbalest.llm.common import lower_ascii, stage

#: Rules as (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Listed domains, each under these suffixes.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_SUFFIXES = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{name}.{suffix}" for name in LISTED_NAMES for suffix in LISTED_SUFFIXES)

#: False positive rate of all levels but the first, and of the first at least.
RATE = 1 / 32
#: Bound of all levels of a cascade together: 2**21 words of 64 bits, 16 MB. Keys that need more are dealt into parts with a cascade each.
MAX_WORDS = 1 << 21


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column, depth: int) -> Column:
    """The host's last 1 to ``depth`` labels, or the whole host where it has no more: each is found from the right."""
    return F.array(*(F.call_function("substring_index", host, F.lit("."), F.lit(-k)) for k in range(1, depth + 1)))


def depth_of(listed: DataFrame) -> int:
    """Labels of the longest listed key; no domain with more can be listed."""
    return listed.agg(F.max(F.length("key") - F.length(F.replace("key", F.lit("."), F.lit(""))) + 1)).first()[0] or 1


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The fitting rule as text and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, site, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last that fits wins
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(start)
        name, verdict = F.when(fits, site + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def words_for(n: int, rate: float) -> int:
    """64-bit words, a power of two of them, of a filter for ``n`` keys at a false positive rate."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, n * math.log2(1 / rate) / math.log(2) / 64))))


class Level:
    """One Bloom filter."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int):
        self.bits, self.seed = 64 * words_for(n, rate), seed
        self.hashes = max(1, round(math.log2(1 / rate)))
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(self.bit(F.col("at"))).alias("bits"))
        got = {r.word: r.bits for r in words.collect()}  # bits / 64 rows at most
        self.words = [got.get(i, 0) for i in range(self.bits // 64)]
        self.literal = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded once, when planned

    def places(self, key: Column) -> list[Column]:
        """Of all hashes, from two."""
        a, b = (F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * self.seed + i)), 2) for i in (0, 1))
        mask = F.lit(self.bits - 1).cast("bigint")
        return [(a.bitwiseAND(mask) + F.lit(i) * b.bitwiseAND(mask).bitwiseOR(F.lit(1).cast("bigint"))).bitwiseAND(mask) for i in range(self.hashes)]

    @staticmethod
    def bit(at: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))

    def passes(self, key: Column) -> Column:
        found = lambda at: F.element_at(self.literal, (F.shiftright(at, 6) + 1).cast("int")).bitwiseAND(self.bit(at)) != 0
        return F.forall(F.array(*self.places(key)), found)  # so that the plan holds the literal once


class Cascade:
    """Exact membership in the listed keys for every key of ``universe`` (column ``key``, distinct; flag ``listed``)."""

    def __init__(self, universe: DataFrame, n_listed: int, n_unlisted: int):
        self.levels: list[Level] = []
        inside, outside, n = universe.where("listed"), universe.where("not listed"), n_listed
        rate = min(RATE, n_listed / max(1, n_unlisted))
        while n:
            level = Level(inside, n, rate if not self.levels else RATE, len(self.levels))
            self.levels.append(level)
            inside, outside = outside.where(level.passes(F.col("key"))), inside
            n = inside.count()

    def contains(self, key: Column) -> Column:
        """Decided by the first level that the key fails: even levels hold listed keys, odd ones unlisted."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def universe_of(pages: DataFrame, listed: DataFrame, depth: int) -> DataFrame:
    """All distinct keys of the pages' urls, flagged if listed. Hosts are made distinct before they are split."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    keys = hosts.select(F.explode(domains(F.col("host"), depth)).alias("key")).distinct()
    flags = listed.select(lower_ascii(F.col("key")).alias("key"), F.lit(True).alias("_in")).where("key is not null").distinct()
    return keys.join(flags, "key", "left").select("key", F.coalesce("_in", F.lit(False)).alias("listed"))


def judge(pages: DataFrame, listed: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, max_words: int = MAX_WORDS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``listed`` has the blocked domains in column ``key``."""
    spark = pages.sparkSession
    if listed is None:
        listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    depth = depth_of(listed)
    universe = stage(universe_of(pages, listed, depth))
    sizes = universe.agg(F.count_if("listed").alias("inside"), F.count_if(~F.col("listed")).alias("outside")).first()
    first = words_for(sizes.inside, min(RATE, sizes.inside / max(1, sizes.outside))) if sizes.inside else 0
    needed = first + 4 * words_for(sizes.inside, RATE)  # the further levels shrink by RATE every other time
    url = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if needed <= max_words:
        cascade = Cascade(universe, sizes.inside, sizes.outside)
        found = F.exists(domains(F.col("host"), depth), cascade.contains)
    else:  # a cascade for each part of the keys, one after the other over the urls' hosts
        parts, found = -(-needed // max_words), F.col("_found")
        part = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))
        counts = {r.part: r for r in universe.groupBy(part(F.col("key")).alias("part")).agg(F.count_if("listed").alias("inside"), F.count_if(~F.col("listed")).alias("outside")).collect()}
        url = url.withColumn("_found", F.lit(False))
        for n in sorted(n for n, r in counts.items() if r.inside):
            cascade = Cascade(universe.where(part(F.col("key")) == n), counts[n].inside, counts[n].outside)
            hit = lambda key: (part(key) == n) & cascade.contains(key)  # noqa: B023, E731  used at once
            url = stage(url.withColumn("_found", F.col("_found") | F.exists(domains(F.col("host"), depth), hit)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    hit = F.when(verdict.isNull() & found, F.lit("block")).otherwise(F.lit("allow"))
    return url.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, hit).alias("verdict"))
