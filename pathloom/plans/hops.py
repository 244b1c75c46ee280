"""One hop: an edge type with limits and samples in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.sampling import sample_by
from pathloom.naming import feature_col
from pathloom.plans.tokens import fingerprint, token_table
from pathloom.sources.tables import compute_missing
from pathloom.spec import GraphSpec, HopSpec, Sample


class Tokens:
    """Token tables of a graph at given graph times, each planned once.

    With a ``folder``, tables are saved there by graph time: times that are complete under
    the same specification are read, only the others are computed.
    """

    def __init__(self, spark: SparkSession, graph: GraphSpec, targets: Sequence[Sequence[str]], overrides: dict[tuple[str, str], DataFrame] | None = None, folder: str | None = None):
        self.spark, self.graph, self.targets, self.folder = spark, graph, [tuple(t) for t in targets], folder
        self._made: dict[tuple[str, str], DataFrame] = dict(overrides or {})

    def __call__(self, what: str, name: str) -> DataFrame:
        if (what, name) not in self._made:
            compute = lambda times: token_table(self.spark, self.graph, what, name, times)
            self._made[what, name] = compute_missing(self.spark, f"{self.folder}/{what}={name}", self.graph.time_cols, self.targets, compute, fingerprint(self.graph, what, name)) if self.folder else compute(self.targets)
        return self._made[what, name]


def _sampled(df: DataFrame, graph: GraphSpec, hop: HopSpec, samples: Sequence[Sample], label: str) -> DataFrame:
    ends = range(len(graph.edges[hop.edge].endpoints))
    keys = [c for i in ends for c in graph.edge_cols(hop.edge, i)] + list(graph.time_cols)
    for n, s in enumerate(samples):
        group = [c for i in s.group for c in graph.edge_cols(hop.edge, i)] + list(graph.time_cols)
        if s.kind == "top":
            df = df.withColumns({f"_top{i}": F.col(f"{feature_col(hop.edge)}.`{b}`") for i, b in enumerate(s.by)})
        df = sample_by(s.kind, df, group, s.n, keys, [f"_top{i}" for i in range(len(s.by))], f"{hop.label}-{label}-{n}")
        if s.kind == "top":
            df = df.drop(*[f"_top{i}" for i in range(len(s.by))])
    return df


def hop_table(tokens: Tokens, hop: HopSpec) -> DataFrame:
    """Endpoint columns, graph time and the edge's features: edge_limit, edge_samples, node_limits, hop_limit, hop_samples, in this order."""
    graph = tokens.graph
    edge = graph.edges[hop.edge]
    features = feature_col(hop.edge)
    df = tokens("edge", hop.edge)
    if hop.edge_limit:
        df = df.select("*", F.col(f"{features}.*")).where(hop.edge_limit).select(df.columns)
    df = _sampled(df, graph, hop, hop.edge_samples, "edge")
    for limit in hop.node_limits:
        kind = edge.endpoints[limit.endpoint]
        nodes = tokens("node", kind).select(*graph.node_cols(kind), *graph.time_cols, F.col(f"{feature_col(kind)}.*")).where(limit.where)
        met = nodes.select(*[F.col(a).alias(b) for a, b in zip(graph.node_cols(kind), graph.edge_cols(hop.edge, limit.endpoint), strict=True)], *graph.time_cols)
        df = df.join(met, [*graph.edge_cols(hop.edge, limit.endpoint), *graph.time_cols], "left_semi")
    if hop.hop_limit:
        cols = df.columns
        wide = df.withColumn("edge", F.col(features))
        for alias, i in (("src", hop.join), ("dst", hop.add)):
            kind = edge.endpoints[i]
            nodes = tokens("node", kind).select(*[F.col(a).alias(b) for a, b in zip(graph.node_cols(kind), graph.edge_cols(hop.edge, i), strict=True)], *graph.time_cols, F.col(feature_col(kind)).alias(alias))
            wide = wide.join(nodes, [*graph.edge_cols(hop.edge, i), *graph.time_cols], "left")
        df = wide.where(hop.hop_limit).select(cols)
    return _sampled(df, graph, hop, hop.hop_samples, "hop")
