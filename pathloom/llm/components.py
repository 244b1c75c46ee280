"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) joined back to the
edges; the edge table never grows beyond its first size, and a node of any
degree is one key of a join that Spark may split. Steps are cut by written
tables. The number of steps grows with the logarithm of the longest chain.

An edge table of at most SMALL rows, whatever the input's size, is solved on the
driver in one step, with the same result: the steps would cost more than it does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import scratch

#: Edges that go to the driver at most (1 MB).
SMALL = 1 << 16


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of the edges, and of each the smallest id reachable."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while (label[a] != label[b]).any():
        p, q = label[a], label[b]  # roots, of which the larger one is hung below the smaller one
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    return ids, ids[label]


def components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(id, component) for every id of the edges (u, v): component is the smallest id reachable."""
    spark = edges.sparkSession
    now, path = scratch.write(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "edges")
    seen = _signature(now)
    if seen[0] <= small:
        found = now.toArrow()
        scratch.remove(spark, path)
        ids, least = least_reachable(found.column("u").to_numpy(), found.column("v").to_numpy())
        return spark.createDataFrame(pa.table({"id": ids.astype(np.int64), "component": least.astype(np.int64)}))
    for _ in range(max_rounds):
        if not seen[0]:
            break
        after, new_path = scratch.write(_small_star(_large_star(now)), "edges")
        new = _signature(after)
        scratch.remove(spark, path)
        now, path, done, seen = after, new_path, new == seen, new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
