"""URL filters: host rules, and exact membership of a key list by a cascade of Bloom filters.

Level 0 encodes the listed keys; level 1 those other keys of the corpus that level 0 takes by mistake; level 2 the listed keys
that level 1 takes by mistake; and so on until a level has nothing to encode. For every key of the universe the cascade was
built over, the first level that refuses the key settles it, without a join and without error. Keys outside that universe get
a Bloom filter's answer, so build it over all keys of the table that is judged.

Filters are collected and sent to the tasks, so their size is checked: beyond `most_bytes` the keys are split by hash into
shards, each with a cascade of its own, and each shard's rows are judged against its cascade only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import mixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        """The host itself and all below it, where the path starts with the rule's."""
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def by_rules(rules: list[Rule], host: Column, path: Column, pick) -> Column:
    """What `pick` says of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        chosen = F.when(rule.fits(host, path), F.lit(pick(rule))).otherwise(chosen)
    return chosen


@dataclass(frozen=True)
class Cascade:
    """levels: (bits, number of bits); the salt of a level is its place."""

    levels: list[tuple[np.ndarray, int]]
    hashes: int

    def has(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether keys with these two hashes are listed."""
        listed = np.zeros(len(first), bool)
        open_ = np.ones(len(first), bool)
        for level, (bits, size) in enumerate(self.levels):
            taken = open_.copy()
            for p in _places(first, second, level, self.hashes, size):
                taken &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            listed[open_ & ~taken] = level % 2 == 1
            open_ = taken
        listed[open_] = len(self.levels) % 2 == 1
        return listed


def _places(first: np.ndarray, second: np.ndarray, level: int, hashes: int, size: int):
    """Places of keys on a level. All bits of both hashes count, anew on each level: keys that meet on one level part on another."""
    for k in range(hashes):
        salt = np.uint64((level * hashes + k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        yield mixed(mixed(first.view(np.uint64) + salt) ^ second.view(np.uint64)) % np.uint64(size)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def _probe(cascade: Cascade):
    @F.pandas_udf("boolean")
    def probe(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(cascade.has(first.to_numpy(np.int64), second.to_numpy(np.int64)))

    return probe


def _filter(keys: DataFrame, level: int, hashes: int, size: int) -> np.ndarray:
    """Bits of the keys' places, put together by the tasks and collected as bytes of the filter."""

    def run(batches):
        bits = np.zeros(-(-size // 8), np.uint8)
        for batch in batches:
            for p in _places(batch["a"].to_numpy(np.int64), batch["b"].to_numpy(np.int64), level, hashes, size):
                np.bitwise_or.at(bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(bits)
        yield pd.DataFrame({"at": at.astype(np.int64), "bits": bits[at].astype(np.int32)})

    bits = np.zeros(-(-size // 8), np.uint8)
    rows = keys.mapInPandas(run, "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.uint8)
    return bits


def build(keys: DataFrame, bits_per_key: int = 10, hashes: int = 5, most_levels: int = 60) -> Cascade:
    """`keys`: distinct rows (a, b, listed) of the whole universe, stored or cheap. Null keys must be left out."""
    levels: list[tuple[np.ndarray, int]] = []
    sides = {True: keys.filter("listed"), False: keys.filter("not listed")}
    encode = True
    while n := sides[encode].count():
        if len(levels) == most_levels:
            raise ValueError("keys with equal hashes are both listed and not listed")
        size = max(64, n * bits_per_key)
        bits = _filter(sides[encode], len(levels), hashes, size)
        levels.append((bits, size))
        alone = Cascade([*[(np.full(1, 255, np.uint8), 8)] * (len(levels) - 1), (bits, size)], hashes)  # earlier levels take all: only the last one speaks
        sides[not encode] = sides[not encode].filter(_probe(alone)("a", "b") == F.lit(len(levels) % 2 == 1))
        encode = not encode
    return Cascade(levels, hashes)


def listed_column(rows: DataFrame, key: Column, keys: DataFrame, name: str, bits_per_key: int = 10, hashes: int = 5, most_bytes: int = 64 << 20) -> DataFrame:
    """`rows` with a boolean column `name`: whether the key is listed.

    `keys` has (key, listed): every distinct key of `rows`, stored or cheap. A null key is not listed. An existing column of
    that name is replaced; an empty table or list gives false everywhere.
    """
    a, b = _hashes(F.col("key"))
    hashed = keys.dropna(subset=["key"]).select(a.alias("a"), b.alias("b"), "listed")
    need = hashed.filter("listed").count() * bits_per_key // 8 * 2  # later levels are smaller together
    shards = max(1, -(-need // most_bytes))
    first, second = _hashes(key)
    shard = F.pmod(second, F.lit(shards))
    out = []
    for k in range(shards):
        cascade = build(hashed.filter(F.pmod("b", F.lit(shards)) == k), bits_per_key, hashes)
        some = rows.filter(shard == k) if shards > 1 else rows
        out.append(some.withColumn(name, _probe(cascade)(first, second) & key.isNotNull()))
    return reduce(DataFrame.unionByName, out)


def judge(pages: DataFrame, rules: list[Rule], listed: Column, written, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, listed, verdict.

    The longest rule that fits decides; where none does, hosts are blocked that `listed` (a condition on the column `host` of
    the corpus's distinct hosts) marks, by the cascade. `written` stores the distinct hosts. A null url, or one without `://`,
    has an empty host and path, and fits no rule. Repeated rows and null ids stay as they are; other columns are ignored; an
    empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    keys = written(rows.select("host").distinct().select(F.col("host").alias("key"), F.coalesce(listed, F.lit(False)).alias("listed")), "hosts")
    rows = listed_column(rows, F.col("host"), keys, "listed")
    rule = by_rules(rules, F.col("host"), F.col("path"), lambda r: r.name)
    verdict = by_rules(rules, F.col("host"), F.col("path"), lambda r: r.verdict)
    return rows.select(id_col, "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
