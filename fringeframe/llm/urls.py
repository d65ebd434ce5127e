"""URL filter by a Bloom filter cascade.

Level 1 encodes the listed keys, level 2 the corpus keys that level 1 passes falsely, level 3 the listed keys that level 2
passes falsely, and so on over the complete key universe of the corpus, until a level has no false positives left. The
first level that rejects a key decides: membership is exact for every key of the corpus, and no row is joined to the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.operators.settle import settled

# Beyond so many listed keys of one action, or different path lengths, rules are matched by equi-joins instead of a broadcast filter.
MAX_KEYS = 2_000_000
MAX_LENGTHS = 64
MAX_LEVELS = 64
SALTS = 16
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _slots(h: np.ndarray, level: int, m: int, k: int) -> np.ndarray:
    """(keys, k) bit positions; h is (keys, 2) of two independent 64-bit hashes."""
    a = (h[:, 0] ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) * _MIX
    b = (h[:, 1] + np.uint64(level)) * _MIX | np.uint64(1)
    a, b = a ^ (a >> np.uint64(31)), b ^ (b >> np.uint64(30)) | np.uint64(1)
    steps = np.arange(k, dtype=np.uint64)
    mixed = (a[:, None] + steps * b[:, None]) * _MIX
    return (mixed ^ (mixed >> np.uint64(29))) % np.uint64(m)


class Cascade:
    """Levels of (bits, m, k); `built` wants the complete universe of keys it will be asked."""

    def __init__(self, levels: list[tuple[np.ndarray, int, int]] | None = None) -> None:
        self.levels = levels or []

    def _passes(self, h: np.ndarray, level: int) -> np.ndarray:
        bits, m, k = self.levels[level]
        at = _slots(h, level, m, k)
        return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def add(self, h: np.ndarray, rate: float) -> None:
        k = max(1, round(-np.log2(rate)))
        m = max(64, int(np.ceil(len(h) * k * 1.4427)))
        bits = np.zeros(m // 8 + 1, np.uint8)
        at = _slots(h, len(self.levels), m, k).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        self.levels.append((bits, m, k))

    def contains(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), len(self.levels) % 2 == 1)
        left = np.arange(len(h))
        for level in range(len(self.levels)):
            ok = self._passes(h[left], level)
            out[left[~ok]] = level % 2 == 1
            left = left[ok]
        return out if self.levels else np.zeros(len(h), bool)

    @property
    def n_bytes(self) -> int:
        return sum(len(bits) for bits, _, _ in self.levels)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b")]


def _pairs(df: DataFrame) -> np.ndarray:
    rows = df.toPandas()
    return np.column_stack([rows["a"].to_numpy(np.int64).view(np.uint64), rows["b"].to_numpy(np.int64).view(np.uint64)])


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """Cascade of the column `key` of `listed`, exact for every `key` of `universe`; None if two keys agree in all hashes.

    What reaches the driver is bounded by the list: its hashes and the false positives of level 1, whose rate is set to
    listed / universe keys, so that about as many pass falsely as are listed.
    """
    member = _pairs(listed.select(*_hashes(F.col("key"))).distinct())
    out = Cascade()
    if not len(member):
        return out
    keys = universe.agg(F.approx_count_distinct("key")).first()[0]
    out.add(member, min(0.5, len(member) / max(keys, 1)))
    # Plain arrays: executors may have no copy of this package.
    first = universe.sparkSession.sparkContext.broadcast(out.levels)

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = np.column_stack([batch["a"].to_numpy(np.int64).view(np.uint64), batch["b"].to_numpy(np.int64).view(np.uint64)])
            yield batch[Cascade(first.value)._passes(h, 0)]

    kept = universe.select(*_hashes(F.col("key"))).mapInPandas(passed, "a bigint, b bigint").distinct()
    false = _pairs(kept.join(listed.select(*_hashes(F.col("key"))), ["a", "b"], "left_anti"))
    own, other = member, false
    while len(other):
        if len(out.levels) == MAX_LEVELS:
            return None
        out.add(other, 0.5)
        own, other = other, own[out._passes(own, len(out.levels) - 1)]
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://`, A-Z of the host lower-cased; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _suffixes() -> Column:
    """The host and every domain above it."""
    labels = F.split("host", r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _candidate(suffix: Column, prefix: Column) -> Column:
    """A rule that would fit; candidates sort by length, longest first, then by the longer host."""
    return F.struct(
        (-(F.length(suffix) + F.length(prefix))).alias("rank"),
        (-F.length(suffix)).alias("host_rank"),
        F.concat(suffix, prefix).alias("rule"),
        F.concat(suffix, F.lit("\n"), prefix).alias("key"),
    )


def _prefixes(lengths: Column) -> Column:
    return F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))


def _candidates(lengths: list[int]) -> Column:
    """Every (host suffix + path prefix) of a listed prefix length in order."""
    prefixes = _prefixes(F.array(*[F.lit(n) for n in lengths]))
    return F.array_sort(F.flatten(F.transform(_suffixes(), lambda s: F.transform(prefixes, lambda p: _candidate(s, p)))))


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", max_keys: int = MAX_KEYS, max_lengths: int = MAX_LENGTHS
) -> DataFrame:
    """`pages` with host, path, rule and verdict added; columns of these names are replaced.

    `rules` has host, path, action (allow or block); rows with a null in them are ignored. A rule fits its host and all
    subdomains if the path starts with its path; the longest (host and path together) wins, then the longer host, and of
    two equal rules block. Without a rule: rule null, verdict `otherwise`. A null url, or one without `://`, has host and
    path empty and fits only rules with both empty. Up to `max_keys` rules of an action and `max_lengths` different path
    lengths the cascade decides; beyond, candidates meet the rules in equi-joins, with the same result.
    """
    spark = pages.sparkSession
    rules = rules.dropna(subset=["host", "path", "action"])
    listed = rules.select("host", "path", F.concat("host", F.lit("\n"), "path").alias("key"), "action").distinct()
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().limit(max_lengths + 1).collect()]
    host, path = split_url(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, host.alias("host"), path.alias("path"))
    if not lengths:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    sizes = dict(listed.groupBy("action").count().collect())
    if len(lengths) > max_lengths or max(sizes.values()) > max_keys:
        return _joined(split, listed, kept, otherwise)
    asked = split.withColumn("_c", _candidates(lengths))
    universe = asked.select(F.explode("_c.key").alias("key"))
    filters = {a: build_cascade(listed.filter(F.col("action") == a), universe) for a in ("block", "allow")}
    if None in filters.values():
        return _joined(split, listed, kept, otherwise)
    shared = spark.sparkContext.broadcast({a: f.levels for a, f in filters.items()})

    @F.pandas_udf("int")
    def first_listed(a: pd.Series, b: pd.Series) -> pd.Series:
        """1-based place of the first listed candidate, negative for block, 0 for none."""
        sizes = a.map(len).to_numpy()
        total = int(sizes.sum())
        out = np.zeros(len(a), np.int32)
        if total:
            h = np.column_stack([np.concatenate(x.to_list()).astype(np.int64).view(np.uint64) for x in (a, b)])
            block, allow = (Cascade(shared.value[action]).contains(h) for action in ("block", "allow"))
            starts = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(a)), sizes)
            hit = np.flatnonzero(block | allow)
            rows, first = np.unique(row[hit], return_index=True)
            at = hit[first]
            out[rows] = (at - starts[rows] + 1) * np.where(block[at], -1, 1)
        return pd.Series(out)

    hashes = [F.transform("_c", lambda c: F.xxhash64(c["key"])), F.transform("_c", lambda c: F.xxhash64(c["key"], F.lit(1)))]
    found = asked.withColumn("_at", first_listed(*hashes))
    rule = F.when(F.col("_at") != 0, F.col("_c")[F.abs("_at") - 1]["rule"])
    verdict = F.when(F.col("_at") > 0, "allow").when(F.col("_at") < 0, "block").otherwise(otherwise)
    return found.select(*kept, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _joined(split: DataFrame, listed: DataFrame, kept: list[str], otherwise: str) -> DataFrame:
    """The way for lists too large to broadcast: the path lengths that a host lists give its pages' candidates, which meet the rules.

    Pages are spread by a salt and the lists repeated under each, as a host may hold a third of the pages.
    """
    row = settled(split.withColumn("_row", F.monotonically_increasing_id()))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    lengths = listed.groupBy(F.col("host").alias("_suffix")).agg(F.collect_set(F.length("path")).alias("_lengths")).select("*", salts)
    each = row.select("_row", "path", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int").alias("_salt"), F.explode(_suffixes()).alias("_suffix"))
    each = each.join(lengths, ["_suffix", "_salt"])
    each = each.select("_row", "_salt", F.explode(F.transform(_prefixes(F.col("_lengths")), lambda p: _candidate(F.col("_suffix"), p))).alias("c"))
    each = each.select("_row", "_salt", "c", F.col("c.key").alias("key"))
    found = each.join(listed.select("key", "action", salts), ["key", "_salt"])
    order = F.struct("c.rank", "c.host_rank", (F.col("action") != "block").alias("o"), "c.rule", "action")
    best = found.groupBy("_row").agg(F.min(order).alias("best"))
    return row.join(best, "_row", "left").select(
        *kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(otherwise)).alias("verdict")
    )
