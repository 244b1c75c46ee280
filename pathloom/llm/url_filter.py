"""URL filter: listed keys in Bloom filter cascades over the corpus's own keys.

A rule is a host and a path prefix. The keys of a url are its host and parent
domains, each with every path prefix that has the length of some rule's. The key
universe is the set of all keys of all urls. A cascade encodes the listed keys
in level 1, the universe's false positives of level 1 in level 2, the listed
keys that level 2 passes in level 3, and so on until nothing passes wrongly. A
key's membership is then read off the first level that rejects it: exact for the
whole universe, with no join. Level 1's false-positive rate is chosen as
sqrt(1/2) * listed / universe, so every level is about as small as the list.

Everything is built-in DataFrame functions. The filters are literals in the
plan; the list may have MAX_LISTED keys, which is checked.

Defined results: a null url or one without ``://`` has empty host and path and
meets no rule; host is lower-cased in A-Z only; of rules that fit, the longest
``host + path`` wins, then the longer host; a key listed with both verdicts blocks; without a fitting rule the url is
in no list and gets ``default``; repeated rows give repeated results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LISTED = 100_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def url_keys(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """Keys of a url: parent domains of at most ``labels`` labels times path prefixes of the ``lengths``."""
    parts = F.split(host, r"\.")
    first = F.greatest(F.size(parts) - labels + 1, F.lit(1))
    domains = F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths))])
    keys = F.flatten(F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.transform(domains, lambda d: F.concat(d, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


class BloomLevel:
    """One Bloom filter as words of 64 bits."""

    def __init__(self, spark: SparkSession, keys: Sequence[str], rate: float, number: int):
        self.number = number
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(64, math.ceil(len(keys) * -math.log(rate) / math.log(2) ** 2))
        words = [0] * (-(-self.bits // 64))
        own = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("key")) if keys else spark.range(0).select(F.lit("").alias("key"))
        for row in own.select(F.explode(F.array(*self.positions(F.col("key")))).alias("at")).collect():
            words[row["at"] // 64] |= 1 << (row["at"] % 64)
        self.words = F.array(*[F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words])

    def positions(self, key: Column) -> list[Column]:
        a = F.pmod(F.xxhash64(key, F.lit(2 * self.number)), F.lit(self.bits))
        b = F.pmod(F.xxhash64(key, F.lit(2 * self.number + 1)), F.lit(self.bits))
        return [F.pmod(a + b * i + i * i, F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        out = F.lit(True)
        for at in self.positions(key):
            word = F.element_at(self.words, (F.floor(at / 64) + 1).cast("int"))
            out = out & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out


class BloomCascade:
    """Exact membership of ``listed`` for every key of ``universe`` (a distinct column ``key``)."""

    def __init__(self, universe: DataFrame, n_universe: int, listed: Sequence[str], max_levels: int = 64):
        spark = universe.sparkSession
        listed = sorted(set(listed))
        if len(listed) > MAX_LISTED:
            raise ValueError(f"more than {MAX_LISTED} listed keys")
        self.levels: list[BloomLevel] = []
        self.sizes: list[int] = []
        inside, outside = listed, None
        while inside and len(self.levels) < max_levels:
            rate = min(0.5, math.sqrt(0.5) * len(listed) / max(1, n_universe)) if not self.levels else 0.5
            level = BloomLevel(spark, inside, rate, len(self.levels))
            self.levels.append(level)
            self.sizes.append(len(inside))
            if outside is None:  # the only pass over the universe: about as many keys come back as are listed
                wrong = [r["key"] for r in universe.where(level.passes(F.col("key"))).collect()]
                outside = sorted(set(wrong) - set(listed))
                inside, outside = outside, listed
            else:
                frame = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in outside])).alias("key"))
                wrong = sorted(r["key"] for r in frame.where(level.passes(F.col("key"))).collect())
                inside, outside = wrong, inside
        if inside:
            raise ValueError("the cascade did not end")

    def holds(self, key: Column) -> Column:
        """True for listed keys of the universe, false for its other keys."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[n].passes(key), out).otherwise(F.lit(n % 2 == 1))
        return out


def _ranked(verdict: str):
    """A key with what decides between keys first."""
    return lambda k: F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("h"), k.alias("rule"), F.lit(verdict).alias("verdict"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every row judged: (page_id, url, host, path, rule, verdict). ``rules``: (host, path, allow or block)."""
    rules = [(host.translate(str.maketrans(_UPPER, _LOWER)), path, verdict) for host, path, verdict in rules]
    labels = max((host.count(".") + 1 for host, _, _ in rules), default=1)
    lengths = [len(path) for _, path, _ in rules] or [1]
    url = F.col(url_col).cast("string")
    parsed = (
        pages.select(F.col(id_col).alias("page_id"), url.alias("url"))
        .withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
        .withColumn("keys", url_keys(F.col("host"), F.col("path"), labels, lengths))
    )
    universe = parsed.select(F.explode("keys").alias("key")).distinct()
    size = universe.count()
    lists = {v: BloomCascade(universe, size, [h + p for h, p, x in rules if x == v]) for v in ("allow", "block")}
    met = {v: F.filter(F.col("keys"), lists[v].holds) for v in lists}
    longest = F.array_max(F.concat(*[F.transform(met[v], _ranked(v)) for v in lists]))
    return parsed.withColumn("best", longest).select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )
