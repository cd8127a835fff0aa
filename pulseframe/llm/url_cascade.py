"""URL rules looked up in a cascade of Bloom filters, exact over the corpus's own keys.

A rule is (host, path, verdict): it fits its host and all subdomains where the url's path starts with
the rule's path; the longest fitting rule (host plus path, then host) decides, and a url that no rule
fits is not listed and so allowed.

Every url yields the few keys at which a rule could fit it. The first filter holds the listed keys;
the second those keys of the corpus that the first lets through wrongly; the third the listed keys
that the second catches wrongly, and so on until nothing is wrong. The key universe is known in full,
so walking the cascade is exact for every url of the corpus, and the pages are neither shuffled nor
joined. A second cascade, over the listed keys alone, tells blocked from allowed ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseframe.llm.base import keeps_names
from pulseframe.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 5
#: Bits of one filter (1 MiB). A rule list that needs more is looked up by a join instead.
MAX_BITS = 1 << 23


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


class Filter:
    """One Bloom filter: its bits as an array of words, tested by a plain expression."""

    def __init__(self, keys: DataFrame, count: int, level: int):
        self.level = level
        self.bits = max(64, 2 ** math.ceil(math.log2(max(1, count) * 12)))
        if self.bits > MAX_BITS:
            raise OverflowError
        at = keys.select(F.explode(F.array(*positions(F.col("key"), level, self.bits))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
        held = np.zeros(self.bits // 64, np.int64)
        for word, bits in words.collect():  # at most MAX_BITS / 64 rows
            held[word] = bits
        self.words = F.lit(held)

    def has(self, key: Column) -> Column:
        found = F.lit(True)
        for at in positions(key, self.level, self.bits):
            word = F.get(self.words, F.shiftright(at, 6).cast("int"))
            found = found & (F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
        return found


def cascade(listed: DataFrame, universe: DataFrame) -> list[Filter]:
    """Filters of alternating meaning; ``listed`` and ``universe`` have a column ``key`` without repeats."""
    inside = settle(listed)
    level, filters, held, other = 0, [], inside, None
    while (count := held.count()) > 0:
        filters.append(Filter(held, count, level))
        if other is None:  # only the few keys that pass are compared with the list
            other = settle(universe.filter(filters[0].has(F.col("key"))).join(inside, "key", "left_anti"))
            held, other = other, inside
        else:
            held, other = settle(other.filter(filters[-1].has(F.col("key")))), held
        level += 1
    return filters


def listed(filters: list[Filter], key: Column) -> Column:
    found = F.lit(False)
    for level in reversed(filters):
        found = level.has(key) & ~found
    return found


def candidate_keys(shapes: list[tuple[int, int]], host: str, path: str) -> Column:
    """Every (size, host size, key) at which some rule could fit: as many host labels and path characters as a rule has."""
    if not shapes:
        return F.array().cast("array<struct<size:int,host_size:int,key:string>>")
    known = F.lit(np.array(sorted((labels << 32) + chars for labels, chars in shapes), np.int64))
    labels, chars = lambda s: F.shiftright(s, 32).cast("int"), lambda s: s.bitwiseAND((1 << 32) - 1).cast("int")
    host_labels = F.size(F.split(host, r"\."))
    fitting = F.filter(known, lambda s: (labels(s) <= host_labels) & (chars(s) <= F.length(path)))

    def key(s: Column) -> Column:
        part = F.when(labels(s) == host_labels, F.col(host)).otherwise(F.call_function("substring_index", F.col(host), F.lit("."), -labels(s)))
        whole = F.concat(part, F.call_function("substr", F.col(path), F.lit(1), chars(s)))
        return F.struct(F.length(whole).alias("size"), F.length(part).alias("host_size"), whole.alias("key"))

    return F.transform(fitting, key)


@keeps_names("_keys")
def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the longest fitting, else null) and verdict (allow or block).

    ``rules`` has host, path and verdict; null host or path counts as empty, hosts are lower-cased, of
    equal rules with different verdicts block wins. Null or malformed urls have empty parts and are
    allowed unless a rule fits them. Repeated rows are judged alike; further columns stay, and a column
    of the input that is named like a new one is replaced. No rules: everything is allowed.
    """
    rules = settle(
        rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("block"))
        .groupBy(F.concat("host", "path").alias("key"), "host", "path").agg(F.max("block").alias("block"))
    )
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct()
    shapes = [tuple(s) for s in shapes.collect()]  # at most 127 labels by the longest path, whatever the number of rules
    host, path = url_parts(F.col(url))
    placed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    keyed = placed.withColumn("_keys", candidate_keys(shapes, "host", "path"))
    keys = rules.groupBy("key").agg(F.max("block").alias("block"))
    universe = keyed.select(F.explode("_keys.key").alias("key")).distinct()
    try:
        known, blocked = cascade(keys.select("key"), universe), cascade(keys.filter("block").select("key"), keys.select("key"))
    except OverflowError:
        return judge_by_join(keyed, keys)
    best = F.array_max(F.filter("_keys", lambda k: listed(known, k["key"])))["key"]
    ruled = keyed.withColumn("rule", best).drop("_keys")
    return ruled.withColumn("verdict", F.when(F.col("rule").isNotNull() & listed(blocked, F.col("rule")), "block").otherwise("allow"))


def judge_by_join(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The same verdicts for a rule list beyond MAX_BITS: the distinct key lists are joined with the rules, and so are the pages."""
    lists = keyed.groupBy("_keys").agg(F.count(F.lit(1)))
    hits = lists.select("_keys", F.explode("_keys").alias("k")).join(keys.withColumnRenamed("key", "rule"), F.col("k.key") == F.col("rule"))
    best = hits.groupBy("_keys").agg(F.max(F.struct("k.size", "k.host_size", "rule", "block")).alias("best")).select("_keys", "best.rule", "best.block")
    joined = keyed.join(best, "_keys", "left")
    return joined.withColumn("verdict", F.when(F.col("block"), "block").otherwise("allow")).drop("_keys", "block")
