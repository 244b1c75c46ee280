"""Deterministic samplers. "Random" order is the order of an md5 over a seed and the row's keys, so reruns, retries and other engines agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def hash_fraction(seed: str, keys: Sequence[str], digits: int = 8) -> Column:
    """Uniform in [0, 1)."""
    return F.conv(F.substring(hash_order(seed, keys), 1, digits), 16, 10).cast("double") / F.lit(float(16**digits))


def _ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def random_n(df: DataFrame, group: Sequence[str], n: int, keys: Sequence[str], seed: str = "random") -> DataFrame:
    """At most n rows per group, the first by hash of ``keys`` (which identify a row)."""
    return _ranked(df, group, [hash_order(seed, keys), *map(F.col, keys)], n)


def top_n(df: DataFrame, group: Sequence[str], n: int, features: Sequence[str], keys: Sequence[str], seed: str = "top") -> DataFrame:
    """At most n rows per group by falling features; ties by hash."""
    return _ranked(df, group, [*(F.desc_nulls_last(f) for f in features), hash_order(seed, keys), *map(F.col, keys)], n)


def threshold_n(df: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """Groups of at most n rows whole; larger ones go. Sizes are counted before rows move; null keys are a group."""
    small = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n).select(*[F.col(g).alias(f"_{g}") for g in group])
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    return df.join(small, on, "left_anti")


def sample_by(kind: str, df: DataFrame, group: Sequence[str], n: int, keys: Sequence[str], features: Sequence[str] = (), seed: str = "sample") -> DataFrame:
    if kind == "random":
        return random_n(df, group, n, keys, seed)
    if kind == "threshold":
        return threshold_n(df, group, n)
    if kind == "top":
        return top_n(df, group, n, features, keys, seed)
    raise ValueError(f"unknown sample type {kind}")


def hash_buckets(df: DataFrame, buckets: int, keys: Sequence[str], seed: str, name: str = "bucket") -> DataFrame:
    return df.withColumn(name, F.floor(hash_fraction(seed, keys) * buckets).cast("int"))


def quota_sample(df: DataFrame, by: str, quotas: Mapping[str, int], keys: Sequence[str], seed: str = "quota", splits: int = 64) -> DataFrame:
    """Of each class at most its quota of rows. Classes are few and may be large, so each is cut into ``splits`` by hash: whole
    splits are taken by their sizes, and only the split in which the quota ends is ranked."""
    spark = df.sparkSession
    tagged = hash_buckets(df.where(F.col(by).isin(*quotas)), splits, keys, seed, "_split")
    sizes: dict[str, dict[int, int]] = {}
    for r in tagged.groupBy(by, "_split").agg(F.count(F.lit(1)).alias("n")).collect():  # classes x splits rows
        sizes.setdefault(r[by], {})[r["_split"]] = r["n"]
    rows = []
    for c, own in sizes.items():
        left = quotas[c]
        for s in sorted(own):
            rows.append((c, s, max(0, min(own[s], left)), own[s]))
            left -= own[s]
    plan = F.broadcast(spark.createDataFrame(rows or [("", -1, 0, 0)], "_class string, _s int, _take long, _size long"))
    met = tagged.join(plan, (F.col(by) == F.col("_class")) & (F.col("_split") == F.col("_s")))
    whole = met.where("_take = _size")
    w = Window.partitionBy("_class", "_s").orderBy(hash_order(seed, keys), *map(F.col, keys))
    part = met.where("_take > 0 AND _take < _size").withColumn("_rank", F.row_number().over(w)).where("_rank <= _take").drop("_rank")
    return whole.unionByName(part).select(*df.columns)


def bucket_sample(df: DataFrame, total: int, keys: Sequence[str], buckets: int = 400, seed: str = "bucket") -> DataFrame:
    """About ``total`` rows: of each hash bucket at most total // buckets, of the last also the remainder."""
    quota = F.lit(total // buckets) + F.when(F.col("_bucket") == buckets - 1, total % buckets).otherwise(0)
    tagged = hash_buckets(df, buckets, keys, seed, "_bucket").withColumn("_h", hash_order(f"{seed}-rank", keys)).withColumn("_part", F.substring("_h", 1, 2))
    before = Window.partitionBy("_bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged.groupBy("_bucket", "_part").agg(F.count(F.lit(1)).alias("_n"))  # buckets x 256 rows at most
    left = (quota - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_left")
    met = tagged.join(F.broadcast(sizes.select("_bucket", "_part", "_n", left).where("_left > 0")), ["_bucket", "_part"])
    w = Window.partitionBy("_bucket", "_part").orderBy("_h", *map(F.col, keys))  # only where the quota ends are rows sorted
    part = met.where("_n > _left").withColumn("_rank", F.row_number().over(w)).where("_rank <= _left").drop("_rank")
    return met.where("_n <= _left").unionByName(part).select(*df.columns)


def fraction_sample(df: DataFrame, fraction: float, keys: Sequence[str], seed: str = "fraction") -> DataFrame:
    return df.where(hash_fraction(seed, keys) < fraction)


def capped_sample(df: DataFrame, most: int, keys: Sequence[str], seed: str = "cap") -> DataFrame:
    """All rows, or about ``most`` by fraction where there are more."""
    n = df.count()
    return df if n <= most else fraction_sample(df, most / n, keys, seed)


def random_split(df: DataFrame, parts: Sequence[tuple[str, float]], keys: Sequence[str], seed: str = "split", name: str = "sample_type") -> DataFrame:
    """Rows tagged by the share that their hash falls in; the last part takes the rest."""
    u, col, upper = hash_fraction(seed, keys), F.lit(parts[-1][0]), 1.0 - parts[-1][1]
    edges = []
    at = 0.0
    for label, share in parts[:-1]:
        at += share
        edges.append((label, at))
    for label, edge in reversed(edges):
        col = F.when(u < edge, label).otherwise(col)
    return df.withColumn(name, col)


def batch_ids(df: DataFrame, batches: int, keys: Sequence[str], seed: str = "batch", offset: int = 0, name: str = "batch_id") -> DataFrame:
    return hash_buckets(df, batches, keys, seed, name).withColumn(name, F.col(name) + offset)


def running_totals(df: DataFrame, order: str, values: Sequence[str], buckets: int = 256) -> DataFrame:
    """Adds ``<value>_before``: the sum of each value over rows with a smaller ``order`` (numeric, no nulls, distinct).

    In two levels: sums by quantile bucket first, then within each bucket; no
    window covers the whole table.
    """
    found = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000).alias("q")).first()["q"] or []
    edges = sorted(set(found))
    bucket = F.lit(0) if not edges else F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(order)))
    tagged = df.withColumn("_bucket", bucket)
    sums = tagged.groupBy("_bucket").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``buckets`` rows
    offsets = sums.select("_bucket", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}_offset") for v in values])
    inner = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.join(F.broadcast(offsets), "_bucket")
    return out.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inner), F.lit(0)) + F.col(f"_{v}_offset") for v in values}).drop("_bucket", *[f"_{v}_offset" for v in values])


def dense_ids(df: DataFrame, keys: Sequence[str], name: str = "index", seed: str = "dense", hex_digits: int = 3) -> DataFrame:
    """Numbers 0 to n - 1 in the order of the keys' hash: rows are numbered within hash ranges, and ranges by their sizes."""
    tagged = df.withColumn("_hash", hash_order(seed, keys)).withColumn("_range", F.substring("_hash", 1, hex_digits))
    sizes = tagged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over at most 16 ** hex_digits rows
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_range").orderBy("_hash", *map(F.col, keys))
    numbered = tagged.withColumn("_row", F.row_number().over(inner)).join(F.broadcast(offsets), "_range")
    return numbered.withColumn(name, (F.col("_row") - 1 + F.col("_offset")).cast("long")).drop("_hash", "_range", "_row", "_offset")
