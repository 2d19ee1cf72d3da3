"""URL verdicts by rules, looked up in Bloom filter cascades.

A cascade alternates filters of the listed keys and of the keys that passed wrongly, over all keys that the corpus can
ask for, until nothing passes wrongly: membership is then exact for this corpus and needs no join. All of it is
DataFrame functions; filters are long-array literals.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.session import cut_lineage

#: Fixed rules of the registered query: (rule, verdict).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
BITS_PER_KEY, PROBES, LEAST_BITS = 10, 5, 1024


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    fold = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    url = F.coalesce(url, F.lit(""))
    return fold(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


@dataclass
class Level:
    words: np.ndarray
    seed: int

    def passes(self, key: Column) -> Column:
        bits = 64 * len(self.words)
        array = F.lit(self.words)
        out = F.lit(True)
        for p in positions(key, bits, self.seed):
            out = out & (F.getbit(F.element_at(array, (F.shiftright(p, 6) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
        return out


def positions(key: Column, bits: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def level_of(keys: DataFrame, n: int, seed: int) -> Level:
    """A Bloom filter of the column `key`; its words are built by partial bit_or on the executors."""
    bits = 64 * -(-max(LEAST_BITS, BITS_PER_KEY * n) // 64)
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, seed))).alias("p"))
    words = np.zeros(bits // 64, np.int64)
    for r in at.groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits")).collect():
        words[r["word"]] = r["bits"]
    return Level(words, seed)


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, key: Column) -> Column:
        """The first level that a key doesn't pass decides: an even one says not listed, an odd one says listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return F.when(key.isNull(), F.lit(False)).otherwise(out)


def cascade(listed: DataFrame, universe: DataFrame, max_keys: int = 5_000_000) -> Cascade:
    """`listed`, `universe`: distinct `key`s. The filters hold about 10 bits a listed key, so `max_keys` bounds what is
    sent to the executors (6 MB); a longer list raises an error: cut it by a hash of the key and look up each part."""
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    n, levels = inside.count(), []
    if n > max_keys:
        raise ValueError(f"{n} keys are more than max_keys={max_keys}")
    while n:
        levels.append(level_of(inside, n, len(levels)))
        # Those of the other side that pass are the next level's keys, and the sides change.
        inside, outside = cut_lineage(outside.filter(levels[-1].passes(F.col("key")))), inside
        n = inside.count()
    return Cascade(levels)


def shapes(rules: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """(labels of the host, characters of the path) that some rule has: all that a key of a url can look like."""
    return sorted({(h.count(".") + 1, len(p) + 1) for h, _, p in (r.partition("/") for r, _ in rules)})


def candidate(host: Column, path: Column, labels: int, length: int) -> Column:
    """The url's key of a shape: host suffix at a label's start, and the first characters of the path."""
    fits = (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= length) & path.startswith("/")
    return F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", otherwise: str = "allow", max_keys: int = 5_000_000) -> DataFrame:
    """One row per page: key, host, path, rule, verdict.

    A rule `host/path` fits its host and all subdomains if the path begins with the rule's; the longest wins, then the
    verdict is the rule's, else `otherwise`. Null urls and urls without `://` have empty host and path and fit no rule.
    Repeated rows are judged one by one; an empty table or no rules give `otherwise` for every row.
    """
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"))
    if not rules:
        return parts.select(F.col("k").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    keys = [candidate(F.col("host"), F.col("path"), *s) for s in shapes(rules)]
    universe = cut_lineage(parts.select(F.explode(F.array_compact(F.array(*keys))).alias("key")).distinct())
    found = []
    for verdict in sorted({v for _, v in rules}):
        listed = spark.createDataFrame([(r,) for r in sorted({r for r, v in rules if v == verdict})], "key string")
        c = cascade(listed, universe, max_keys)
        found += [F.when(c.listed(k), F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit(verdict).alias("verdict"))) for k in keys]
    best = parts.withColumn("best", F.array_max(F.array_compact(F.array(*found))))
    return best.select(F.col("k").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
