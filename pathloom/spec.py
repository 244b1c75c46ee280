"""Graphs, hops and paths as immutable, validated specifications."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from pathloom import naming
from pathloom.functions.timeutil import WindowGroup, window_groups


@dataclass(frozen=True)
class TableSpec:
    """A source table of a node or edge type.

    ``keys``: per endpoint (one for nodes) the identifier columns. ``source``: a
    function of the session, or a path. Without ``time_cols`` the table is static:
    its rows hold at every graph time.
    """

    name: str
    keys: tuple[tuple[str, ...], ...]
    source: str | Callable[[SparkSession], DataFrame]
    features: tuple[str, ...] = ()
    time_cols: tuple[str, ...] = ()
    time_formats: tuple[str, ...] = ()
    groups: tuple[WindowGroup, ...] = ()
    format: str = "parquet"

    def __post_init__(self):
        if len(self.time_cols) != len(self.time_formats):
            raise ValueError(f"{self.name}: each time column has a format")
        cols = [c for k in self.keys for c in k] + list(self.features) + list(self.time_cols)
        if len(set(cols)) != len(cols):
            raise ValueError(f"{self.name}: a column is named twice")

    @property
    def marked_features(self) -> tuple[str, ...]:
        """Features, each followed by its presence mark."""
        return tuple(x for f in self.features for x in (f, naming.presence_col(f)))

    @property
    def window_columns(self) -> list[str]:
        if not self.time_cols:
            return list(self.marked_features)
        return [c for g in self.groups for c in g.columns(self.marked_features)]

    @property
    def slots(self) -> list[str]:
        """Columns of the token features: the windows', then the table's mark."""
        return [*(f"{self.name}__{c}" for c in self.window_columns), naming.presence_col(self.name)]

    def load(self, spark: SparkSession) -> DataFrame:
        if callable(self.source):
            return self.source(spark)
        return spark.read.format(self.format).load(self.source)


@dataclass(frozen=True)
class NodeType:
    name: str
    key_types: tuple[str, ...]
    tables: tuple[TableSpec, ...] = ()

    @property
    def slots(self) -> list[str]:
        return [s for t in self.tables for s in t.slots]


@dataclass(frozen=True)
class EdgeType:
    name: str
    endpoints: tuple[str, ...]
    tables: tuple[TableSpec, ...] = ()

    @property
    def slots(self) -> list[str]:
        return [s for t in self.tables for s in t.slots]


@dataclass(frozen=True)
class GraphSpec:
    time_cols: tuple[str, ...]
    time_formats: tuple[str, ...]
    nodes: dict[str, NodeType]
    edges: dict[str, EdgeType]

    def __post_init__(self):
        for e in self.edges.values():
            for n in e.endpoints:
                if n not in self.nodes:
                    raise ValueError(f"{e.name}: no node type {n}")
            for t in e.tables:
                if len(t.keys) != len(e.endpoints):
                    raise ValueError(f"{t.name}: an endpoint has no columns")
                for cols, n in zip(t.keys, e.endpoints, strict=True):
                    if len(cols) != len(self.nodes[n].key_types):
                        raise ValueError(f"{t.name}: {n} has {len(self.nodes[n].key_types)} identifier columns")
        for n in self.nodes.values():
            for t in n.tables:
                if len(t.keys) != 1 or len(t.keys[0]) != len(n.key_types):
                    raise ValueError(f"{t.name}: {n.name} has {len(n.key_types)} identifier columns")

    def width(self, node: str) -> int:
        return len(self.nodes[node].key_types)

    def edge_cols(self, edge: str, endpoint: int) -> list[str]:
        kind = self.edges[edge].endpoints[endpoint]
        return [naming.edge_node_col(endpoint, kind, c) for c in range(self.width(kind))]

    def node_cols(self, node: str) -> list[str]:
        return [naming.node_col(node, c) for c in range(self.width(node))]

    @classmethod
    def from_config(cls, config: dict, schemas: Callable[[str], dict], root: str | None = None) -> GraphSpec:
        """From a nested config of node_schemas and edge_schemas; ``schemas`` gives a source's sidecar by its path."""
        default = config.get("table_default_config", {})
        known = schemas

        def table(name: str, c: dict, keys: Sequence[Sequence[str]], types: Sequence[Sequence[str]]) -> TableSpec:
            path = (root or c.get("src_table_root_path") or default.get("src_table_root_path", "")) + c.get("src_table_rel_path", f"/{name}")
            side = known(path)
            for cols, kinds in zip(keys, types, strict=True):
                for col, kind in zip(cols, kinds, strict=True):
                    if side["node_col_to_types"].get(col) != kind:
                        raise ValueError(f"{name}: {col} is not a {kind}")
            groups = window_groups(c.get("time_aggs_configs") or default.get("time_aggs_configs", ()))
            return TableSpec(name, tuple(map(tuple, keys)), path, tuple(side.get("feat_cols", ())), tuple(side.get("time_cols", ())), tuple(side.get("time_cols_formats", ())), groups, c.get("src_table_format") or default.get("src_table_format", "parquet"))

        kinds = {n: tuple(c["node_col_types"]) for n, c in config["node_schemas"].items()}
        nodes = {n: NodeType(n, kinds[n], tuple(table(t, x, [x["node_cols"]], [kinds[n]]) for t, x in c.get("node_tables", {}).items())) for n, c in config["node_schemas"].items()}
        edges = {
            e: EdgeType(e, tuple(c["linked_node_types"]), tuple(table(t, x, x["linked_node_types_cols"], [kinds[n] for n in c["linked_node_types"]]) for t, x in c["edge_tables"].items()))
            for e, c in config["edge_schemas"].items()
        }
        return cls(tuple(config["graph_time_cols_alias"]), tuple(config["graph_time_cols_formats"]), nodes, edges)


SAMPLE_KINDS = ("random", "threshold", "top")


@dataclass(frozen=True)
class Sample:
    """At most ``n`` rows per group. ``group``: endpoints of a hop, or positions of a path; ``by``: features for ``top``."""

    kind: str
    group: tuple[int, ...]
    n: int
    by: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in SAMPLE_KINDS:
            raise ValueError(f"unknown sample type {self.kind}")
        if self.n < 1:
            raise ValueError("a sample keeps a row at least")


@dataclass(frozen=True)
class NodeLimit:
    """Keep edges whose endpoint's node meets ``where`` over its feature slots."""

    endpoint: int
    where: str


@dataclass(frozen=True)
class HopSpec:
    """One edge type, walked from endpoint ``join`` to endpoint ``add``.

    Limits and samples apply in the order of the fields. ``edge_limit`` is a
    predicate over the edge's slots, ``hop_limit`` over columns ``src``, ``dst``
    (structs of the nodes' slots) and ``edge``.
    """

    edge: str
    join: int = 0
    add: int = 1
    edge_limit: str | None = None
    edge_samples: tuple[Sample, ...] = ()
    node_limits: tuple[NodeLimit, ...] = ()
    hop_limit: str | None = None
    hop_samples: tuple[Sample, ...] = ()
    how: str = "inner"

    def reversed(self, n: int | None = None) -> HopSpec:
        """The other way; with ``n``, sampled to ``n`` per node that it starts from."""
        samples = (Sample("random", (self.add,), n),) if n else ()
        return replace(self, join=self.add, add=self.join, edge_samples=samples, hop_samples=())

    @property
    def label(self) -> str:
        return f"{'forward' if self.join == 0 else 'backward'}_{self.edge}"


@dataclass(frozen=True)
class PathStep:
    """A hop from position ``at`` to position ``to``, with limits and samples on the path so far.

    ``path_limit`` is a predicate over structs ``node_<position>`` and ``edge_<number>``.
    """

    hop: HopSpec
    at: int
    to: int
    path_limit: str | None = None
    path_samples: tuple[Sample, ...] = ()


@dataclass(frozen=True)
class PathSpec:
    name: str
    steps: tuple[PathStep, ...]

    def __post_init__(self):
        seen = {self.steps[0].at} if self.steps else set()
        for s in self.steps:
            if s.at not in seen:
                raise ValueError(f"{self.name}: position {s.at} is not reached before it is joined")
            if s.to in seen:
                raise ValueError(f"{self.name}: position {s.to} is added twice")
            seen.add(s.to)

    def validate(self, graph: GraphSpec) -> PathSpec:
        types = {}
        for s in self.steps:
            ends = graph.edges[s.hop.edge].endpoints
            if types.setdefault(s.at, ends[s.hop.join]) != ends[s.hop.join]:
                raise ValueError(f"{self.name}: position {s.at} is {types[s.at]}, not {ends[s.hop.join]}")
            types[s.to] = ends[s.hop.add]
        return self

    def types(self, graph: GraphSpec) -> dict[int, str]:
        out = {}
        for s in self.steps:
            ends = graph.edges[s.hop.edge].endpoints
            out[s.at], out[s.to] = ends[s.hop.join], ends[s.hop.add]
        return out

    @property
    def fingerprint(self) -> str:
        """Of the content, not the name."""
        return hashlib.sha256(json.dumps([asdict(s) for s in self.steps], sort_keys=True).encode()).hexdigest()[:16]


def linear_path(name: str, hops: Sequence[HopSpec], samples: Sequence[Sequence[Sample]] = ()) -> PathSpec:
    """Hops one after another from position 0."""
    return PathSpec(name, tuple(PathStep(h, i, i + 1, None, tuple(samples[i]) if i < len(samples) else ()) for i, h in enumerate(hops)))


@dataclass(frozen=True)
class BiPathSpec:
    """A path of k hops as a forward half from the head and a backward half from the tail, which meet in the middle."""

    name: str
    forward: PathSpec
    backward: PathSpec | None
    hops: tuple[HopSpec, ...] = field(default=())

    @property
    def length(self) -> int:
        return len(self.hops)
