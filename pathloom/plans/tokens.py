"""Windowed features of nodes and edges at graph times."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.timeutil import WindowGroup, time_map
from pathloom.operators.features import assemble
from pathloom.naming import feature_col, presence_col
from pathloom.sources.tables import clean_source
from pathloom.spec import GraphSpec, TableSpec

_MASK_BITS = 60
#: Periods that a filter may name.
_NAMED_PERIODS = 1000


def _aggregate(func: str, feature: str | None, inside: Column, times: Sequence[str]) -> Column:
    if feature is None:
        return F.count(F.when(inside, 1))
    value = F.when(inside, F.col(feature))
    if func == "first":  # of the earliest period
        return F.min_by(value, F.when(inside, F.concat_ws("|", *times)))
    return {"count": F.count, "mean": F.mean, "sum": F.sum, "max": F.max, "min": F.min}[func](value)


def time_aggregate(spark: SparkSession, source: DataFrame, keys: Sequence[str], features: Sequence[str], source_times: Sequence[str], source_formats: Sequence[str], groups: Sequence[WindowGroup], graph_times: Sequence[str], graph_formats: Sequence[str], targets: Sequence[Sequence[str]]) -> DataFrame:
    """Per key and graph time, every window's aggregates; missing cells are 0.

    Each source period carries, per graph time, a bit mask of the windows that it
    lies in. A source row is repeated per graph time, not per window, and all
    windows are conditional aggregates of one grouping. The map from periods to
    graph times has as many rows as there are such periods.
    """
    windows = [w for g in groups for w in g.windows]
    masks: dict[tuple, list[int]] = {}
    words = max(1, -(-len(windows) // _MASK_BITS))
    for src, tgt, k in time_map(targets, graph_formats, source_formats, windows):
        masks.setdefault((src, tgt), [0] * words)[k // _MASK_BITS] |= 1 << (k % _MASK_BITS)
    kinds = ", ".join([*(f"_s{i} string" for i in range(len(source_times))), *(f"{t} string" for t in graph_times), *(f"_m{i} long" for i in range(words))])
    periods = spark.createDataFrame([(*s, *t, *m) for (s, t), m in masks.items()], kinds)
    on = reduce(lambda a, b: a & b, (source[c] == periods[f"_s{i}"] for i, c in enumerate(source_times)))
    expanded = source.join(F.broadcast(periods), on)
    inside = lambda k: F.col(f"_m{k // _MASK_BITS}").bitwiseAND(F.lit(1 << (k % _MASK_BITS)).cast("long")) != 0
    aggs, k = [], 0
    for g in groups:
        for w in g.windows:
            aggs += [_aggregate(f, x, inside(k), source_times).alias(f"{w.name}_{name}") for f, x, name in g.aggregates(features)]
            k += 1
    by = [*keys, *graph_times]
    if not aggs:
        return expanded.select(*by).distinct()
    names = [c for g in groups for c in g.columns(features)]
    return expanded.groupBy(*by).agg(*aggs).select(*by, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])


def _in_windows(df: DataFrame, table: TableSpec, graph: GraphSpec, targets: Sequence[Sequence[str]]) -> DataFrame:
    """Without rows of periods that lie in no window, which the map of periods would drop after they moved. A filter that may keep more, and none where periods are many."""
    windows = [w for g in table.groups for w in g.windows]
    periods = {src for src, _, _ in time_map(targets, graph.time_formats, table.time_formats, windows)}
    for i, c in enumerate(table.time_cols):
        values = sorted({p[i] for p in periods})
        if len(values) <= _NAMED_PERIODS:
            df = df.where(F.col(c).cast("string").isin(values))
    return df


def table_features(spark: SparkSession, graph: GraphSpec, table: TableSpec, targets: Sequence[Sequence[str]]) -> DataFrame:
    """A table's window columns per key and graph time. A static table holds at every graph time."""
    keys = [c for k in table.keys for c in k]
    loaded = table.load(spark)
    if table.time_cols:
        loaded = _in_windows(loaded, table, graph, targets)
    # rows of a pair and period repeat seldom, so those of an edge move once, by its ends, for cleaning and windows alike
    source = clean_source(loaded, keys, table.features, table.time_cols, by_keys=len(table.keys) > 1)
    if not table.time_cols:
        times = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(graph.time_cols, t, strict=True)]) for t in targets])
        return source.withColumn("_t", F.explode(times)).select(*keys, *[F.col(f"_t.{c}").alias(c) for c in graph.time_cols], *[F.col(c).cast("double").alias(c) for c in table.marked_features])
    return time_aggregate(spark, source, keys, table.marked_features, table.time_cols, table.time_formats, table.groups, graph.time_cols, graph.time_formats, targets)


def fingerprint(graph: GraphSpec, what: str, name: str) -> str:
    """Changes with whatever a saved token table's columns depend on."""
    kind = graph.nodes[name] if what == "node" else graph.edges[name]
    told = [graph.time_cols, graph.time_formats, [(t.name, t.keys, t.features, t.time_cols, t.time_formats, t.window_columns) for t in kind.tables], kind.slots]
    return hashlib.md5(repr(told).encode()).hexdigest()


def token_table(spark: SparkSession, graph: GraphSpec, what: str, name: str, targets: Sequence[Sequence[str]]) -> DataFrame:
    """Identifiers, graph time and a struct of features of a node or edge type: all its tables' window columns and presence marks.

    Tables are put one under the other and grouped once; a cell that a table has
    not is 0.
    """
    if what not in ("node", "edge"):
        raise ValueError("what is node or edge")
    kind = graph.nodes[name] if what == "node" else graph.edges[name]
    ids = graph.node_cols(name) if what == "node" else [c for i in range(len(kind.endpoints)) for c in graph.edge_cols(name, i)]
    parts = []
    for t in kind.tables:
        own = table_features(spark, graph, t, targets)
        keys = [c for k in t.keys for c in k]
        cols = [F.col(c).alias(f"{t.name}__{c}") for c in t.window_columns]
        parts.append(own.select(*[F.col(k).alias(i) for k, i in zip(keys, ids, strict=True)], *graph.time_cols, *cols, F.lit(1.0).alias(presence_col(t.name))))
    by = [*ids, *graph.time_cols]
    if len(parts) == 1:
        merged = parts[0]
    else:
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        merged = stacked.groupBy(*by).agg(*[F.max(F.col(f"`{s}`")).alias(s) for s in kind.slots])  # a table has one row per key at most
    return merged.select(*by, assemble(kind.slots, feature_col(name)))
