"""Paths as chains of hop joins; enumeration, reversal and search from both ends."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.naming import feature_col, path_feature_col, path_node_col
from pathloom.operators.aggregate import slot
from pathloom.operators.metrics import match_metrics, metric_rates
from pathloom.operators.sampling import sample_by
from pathloom.sources.shared import written
from pathloom.plans.hops import Tokens, hop_table
from pathloom.spec import BiPathSpec, GraphSpec, HopSpec, PathSpec, PathStep, Sample, linear_path


def position_cols(graph: GraphSpec, types: dict[int, str], position: int) -> list[str]:
    return [path_node_col(position, types[position], c) for c in range(graph.width(types[position]))]


def path_cols(graph: GraphSpec, path: PathSpec) -> list[str]:
    types = path.types(graph)
    return [c for p in types for c in position_cols(graph, types, p)]


def _hop_as_path(tokens: Tokens, path: PathSpec, number: int, edge_features: bool) -> DataFrame:
    graph, step, types = tokens.graph, path.steps[number], path.types(tokens.graph)
    df = hop_table(tokens, step.hop)
    names = {}
    for end, pos in ((step.hop.join, step.at), (step.hop.add, step.to)):
        names |= dict(zip(graph.edge_cols(step.hop.edge, end), position_cols(graph, types, pos), strict=True))
    extra = [F.col(feature_col(step.hop.edge)).alias(path_feature_col("edge", step.hop.edge, number))] if edge_features else []
    return df.select(*[F.col(a).alias(b) for a, b in names.items()], *graph.time_cols, *extra)


#: Nodes that one packed list holds at most, and how many rows a list may be on average before a task's share of them grows.
PACKED, UNPACKED = 1000, 16


def packed_lists(hop: DataFrame, on: Sequence[str], to: Sequence[str]) -> DataFrame:
    """``hop`` as rows of lists: columns ``on``, and per column of ``to`` the nodes as one text. A node of many neighbours has several lists."""
    number = F.row_number().over(Window.partitionBy(*on).orderBy(*to))
    lists = hop.withColumn("_list", F.floor((number - 1) / PACKED)).groupBy(*on, "_list").agg(F.collect_list(F.struct(*[F.url_encode(c).alias(c) for c in to])).alias("_to"))
    return lists.select(*on, *[F.array_join(F.col("_to")[c], ",").alias(c) for c in to])  # encoded, so no node holds a comma


def _join_packed(before: DataFrame, hop: DataFrame, on: Sequence[str], to: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``before`` joined with ``hop`` (columns ``on`` and ``to``), dealt by ``by``, columns of ``before``.

    What moves is a row per row of ``before`` with its new nodes as one text; they become rows
    where they have arrived, so a later group by ``by`` and more moves nothing.
    """
    packed = packed_lists(hop, on, to)
    parts = UNPACKED * int(before.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    moved = before.join(packed, list(on)).repartition(parts, *by)
    rows = moved.withColumn("_to", F.explode(F.arrays_zip(*[F.split(c, ",").alias(c) for c in to])))
    return rows.select(*[c for c in moved.columns if c not in to], *[F.url_decode(F.col("_to")[c]).alias(c) for c in to])


class PathPlanner:
    """Plans of paths over one set of tokens. Paths that begin alike share their prefix's plan; ``write`` writes each prefix once, for several paths that use it.

    ``targets`` are nodes at ``target_position`` of every path; a path is cut to them as soon as it has that position.
    """

    def __init__(self, tokens: Tokens, targets: DataFrame | None = None, target_position: int = 0, write: bool = False):
        self.tokens, self.targets, self.target_position, self.write = tokens, targets, target_position, write
        self._made: dict[tuple[PathStep, ...], DataFrame] = {}

    def prefix(self, path: PathSpec) -> DataFrame:
        """Instances: node columns of all positions and the graph time. Nodes may repeat on a path."""
        graph = self.tokens.graph
        if path.steps in self._made:
            return self._made[path.steps]
        number = len(path.steps) - 1
        step, types = path.steps[-1], path.types(graph)
        hop = _hop_as_path(self.tokens, path, number, False)
        new = {step.at, step.to} if number == 0 else {step.to}
        if self.targets is not None and self.target_position in new:  # cut before the join
            at = position_cols(graph, types, self.target_position)
            named = self.targets.select(*[F.col(c).alias(a) for c, a in zip(self.targets.columns, [*at, *graph.time_cols], strict=True)])
            hop = hop.join(named, [*at, *graph.time_cols], "left_semi")
        if number == 0:
            df = hop
        else:
            before = self.prefix(replace(path, steps=path.steps[:-1]))
            on = [*position_cols(graph, types, step.at), *graph.time_cols]
            old = [c for p in step.path_samples[0].group if p != step.to for c in position_cols(graph, types, p)] if step.path_samples else []
            if old and step.hop.how == "inner" and not step.path_limit:  # instances move to their sample's group
                df = _join_packed(before, hop, on, position_cols(graph, types, step.to), [*old, *graph.time_cols])
            else:
                df = before.join(hop, on, step.hop.how)
        if step.path_limit:
            cols = df.columns
            df = attach_features(self.tokens, replace(path, steps=path.steps[: number + 1]), df, short=True).where(step.path_limit).select(cols)
        for k, s in enumerate(step.path_samples):
            if s.kind == "top":
                raise ValueError("a path is sampled at random or by threshold")
            group = [c for p in s.group for c in position_cols(graph, types, p)] + list(graph.time_cols)
            keys = [*path_cols(graph, replace(path, steps=path.steps[: number + 1])), *graph.time_cols]
            df = sample_by(s.kind, df, group, s.n, keys, (), f"{'/'.join(x.hop.label for x in path.steps)}-{number}-{k}")
        if self.write:
            df = written(df, "prefix")
        self._made[path.steps] = df
        return df


def attach_features(tokens: Tokens, path: PathSpec, instances: DataFrame, short: bool = False, positions: Sequence[int] | None = None, edges: Sequence[int] | None = None) -> DataFrame:
    """Instances with feature structs of nodes and edges, joined after the path is complete; missing ones have zero slots.

    ``short`` names them node_<position> and edge_<number> and leaves missing ones null.
    """
    graph, types = tokens.graph, path.types(tokens.graph)
    df = instances

    def fill(name: str, slots: Sequence[str]) -> Column:
        return F.coalesce(F.col(name), F.struct(*[F.lit(0.0).alias(s) for s in slots])) if slots else F.col(name)

    for p in positions if positions is not None else sorted(types):
        kind = types[p]
        if not graph.nodes[kind].tables:
            continue
        name = f"node_{p}" if short else path_feature_col("node", kind, p)
        cols = position_cols(graph, types, p)
        nodes = tokens("node", kind).select(*[F.col(a).alias(b) for a, b in zip(graph.node_cols(kind), cols, strict=True)], *graph.time_cols, F.col(feature_col(kind)).alias(name))
        df = df.join(nodes, [*cols, *graph.time_cols], "left")
        df = df if short else df.withColumn(name, fill(name, graph.nodes[kind].slots))
    for n in edges if edges is not None else range(len(path.steps)):
        step = path.steps[n]
        name = f"edge_{n}" if short else path_feature_col("edge", step.hop.edge, n)
        names = {}
        for end, pos in ((step.hop.join, step.at), (step.hop.add, step.to)):
            names |= dict(zip(graph.edge_cols(step.hop.edge, end), position_cols(graph, types, pos), strict=True))
        own = tokens("edge", step.hop.edge).select(*[F.col(a).alias(b) for a, b in names.items()], *graph.time_cols, F.col(feature_col(step.hop.edge)).alias(name))
        df = df.join(own, [*names.values(), *graph.time_cols], "left")
        df = df if short else df.withColumn(name, fill(name, graph.edges[step.hop.edge].slots))
    return df


def aggregate_paths(instances: DataFrame, by: Sequence[str], features: Sequence[str], slots: dict[str, Sequence[str]], funcs: Sequence[str]) -> DataFrame:
    """Statistics of path features per node(s): columns <func>_<feature>, structs over the feature's slots."""
    aggs = [F.struct(*[slot(f, F.col(f"{x}.`{s}`")).cast("double").alias(s) for s in slots[x]]).alias(f"{f}_{x}") for f in funcs for x in features]
    return instances.groupBy(*by).agg(*aggs)


def one_hops(graph: GraphSpec, n: int | None = 20) -> list[HopSpec]:
    """Every binary edge type in both directions, sampled to ``n`` per node that it starts from."""
    out = []
    for e in graph.edges.values():
        if len(e.endpoints) == 2:
            for join in (0, 1):
                out.append(HopSpec(e.name, join, 1 - join, edge_samples=(Sample("random", (join,), n),) if n else ()))
    return out


def path_types(graph: GraphSpec, hops: Sequence[HopSpec], head: str, tail: str, max_hop: int, n: int | None = None) -> dict[int, list[PathSpec]]:
    """Per length, all chains of hops from head type to tail type. With ``n``, each hop after the first samples instances by head and new node, then by new node."""
    level: list[tuple[HopSpec, ...]] = [()]
    out: dict[int, list[PathSpec]] = {}
    for k in range(1, max_hop + 1):
        level = [(*p, h) for p in level for h in hops if graph.edges[h.edge].endpoints[h.join] == (graph.edges[p[-1].edge].endpoints[p[-1].add] if p else head)]
        out[k] = [chain(p, n) for p in level if graph.edges[p[-1].edge].endpoints[p[-1].add] == tail]
    return out


def chain(hops: Sequence[HopSpec], n: int | None = None) -> PathSpec:
    samples = [()] + [(Sample("random", (0, i + 2), n), Sample("random", (i + 2,), n)) if n else () for i in range(len(hops) - 1)]
    return linear_path("__".join(h.label for h in hops), hops, samples)


def reverse_hops(hops: Sequence[HopSpec], n: int | None = None) -> tuple[HopSpec, ...]:
    """From the other end, each hop the other way."""
    return tuple(h.reversed(n) for h in reversed(hops))


def bipath(hops: Sequence[HopSpec], n: int | None = None) -> BiPathSpec:
    """k hops as ceil(k / 2) from the head and floor(k / 2) reversed from the tail."""
    half = -(-len(hops) // 2)
    back = reverse_hops(hops[half:], n)
    return BiPathSpec(chain(hops, n).name, chain(hops[:half], n), chain(back, n) if back else None, tuple(hops))


def bipath_types(graph: GraphSpec, hops: Sequence[HopSpec], head: str, tail: str, max_hop: int, n: int | None = None) -> dict[int, list[BiPathSpec]]:
    return {k: [bipath([s.hop for s in p.steps], n) for p in ps] for k, ps in path_types(graph, hops, head, tail, max_hop).items()}


def bipath_instances(spec: BiPathSpec, graph: GraphSpec, forward: PathPlanner, backward: PathPlanner) -> DataFrame:
    """Instances of the whole path: both halves, joined on the middle node and graph time. The backward half's position i is position k - i."""
    a = forward.prefix(spec.forward)
    if spec.backward is None:
        return a
    k = spec.length
    types = spec.backward.types(graph)
    names = {old: path_node_col(k - p, types[p], c) for p in types for c, old in enumerate(position_cols(graph, types, p))}
    b = backward.prefix(spec.backward).withColumnsRenamed(names)
    middle = len(spec.forward.steps)
    on = [path_node_col(middle, spec.forward.types(graph)[middle], c) for c in range(graph.width(spec.forward.types(graph)[middle]))]
    return a.join(b, [*on, *graph.time_cols])


def pair_cols(spec: BiPathSpec | PathSpec, graph: GraphSpec) -> tuple[list[str], list[str]]:
    """Columns of the head and the tail."""
    hops = spec.hops if isinstance(spec, BiPathSpec) else [s.hop for s in spec.steps]
    head, tail = graph.edges[hops[0].edge].endpoints[hops[0].join], graph.edges[hops[-1].edge].endpoints[hops[-1].add]
    return [path_node_col(0, head, c) for c in range(graph.width(head))], [path_node_col(len(hops), tail, c) for c in range(graph.width(tail))]


def find_paths(tokens: Tokens, pairs: DataFrame, hops: Sequence[HopSpec], head: str, tail: str, max_hop: int, n: int | None = 20, both_ends: bool = True, min_matched: int = 0) -> DataFrame:
    """Match metrics of every path type, best first. ``pairs``: head columns, tail columns, graph time of the known links.

    Head-side walks start from the pairs' heads, tail-side walks from their tails;
    walks that begin alike are computed once and written.
    """
    graph = tokens.graph
    h, t = graph.width(head), graph.width(tail)
    cols, times = pairs.columns, list(graph.time_cols)
    pairs = written(pairs, "pairs")
    heads = written(pairs.select(*cols[:h], *times).distinct(), "heads")
    tails = written(pairs.select(*cols[h : h + t], *times).distinct(), "tails")
    tokens = tokens if both_ends else ends_written(tokens, hops)
    forward, backward = PathPlanner(tokens, heads, write=both_ends), PathPlanner(tokens, tails, write=both_ends)
    rows = []
    masked = None
    for specs in bipath_types(graph, hops, head, tail, max_hop, n).values():
        for s in specs:
            a, b = pair_cols(s, graph)
            named = pairs.select(*[F.col(c).alias(x) for c, x in zip(cols, [*a, *b, *times], strict=True)])
            if not both_ends and _plain(chain(s.hops, n)):
                masked = masked or masked_heads(heads, cols[:h])
                rows.append(chain_metrics(forward, chain(s.hops, n), named, masked.withColumnsRenamed(dict(zip(cols[:h], a, strict=True)))))
                continue
            instances = bipath_instances(s, graph, forward, backward) if both_ends else forward.prefix(chain(s.hops, n))
            rows.append(match_metrics(instances, named, [*a, *b, *times], s.name))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return rank_paths(out, min_matched)


#: Heads that one mask holds.
MASKED = 60


def masked_heads(heads: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The distinct ``heads`` with a block of MASKED heads at most and a bit in it; heads of like length and name share a block, as they often share neighbours."""
    numbered = heads.repartitionByRange(F.length(cols[0]), *cols).sortWithinPartitions(F.length(cols[0]), *cols).withColumn("_number", F.monotonically_increasing_id())
    return written(numbered.select(*heads.columns, F.floor(F.col("_number") / MASKED).alias("_block"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_number") % MASKED).cast("int")).alias("_mask")), "masks")


def chain_metrics(planner: PathPlanner, path: PathSpec, pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """``match_metrics`` of a chain of inner hops without limits and samples, from its heads. ``pairs``: head, tail and time; ``heads``: as from ``masked_heads``; both with the path's names.

    No instance of the whole path moves. The heads that reach a node before the last hop are
    bits of masks, which move to their block with that node's neighbours as one text; there the
    masks of a tail are combined, and their bits are the distinct pairs. Instances are sums of
    counts per head and node, those of known pairs by a join of these with the pairs.
    """
    graph, last, types = planner.tokens.graph, len(path.steps) - 1, path.types(planner.tokens.graph)
    times, step = list(graph.time_cols), path.steps[-1]
    a, b = pair_cols(path, graph)
    at = [*position_cols(graph, types, step.at), *times]
    before = planner.prefix(replace(path, steps=path.steps[:-1]))
    held = dict(zip(a, [f"_head{i}" for i in range(len(a))], strict=True))  # a head's type may stand at other positions
    counts = written(before.groupBy(*[F.col(x).alias(y) for x, y in held.items()], *at).agg(F.count(F.lit(1)).alias("_n")), "counts")
    hop = _hop_as_path(planner.tokens, path, last, False)
    masks = counts.join(heads.withColumnsRenamed(held), [*held.values(), *times]).groupBy("_block", *at).agg(F.bit_or("_mask").alias("_mask"), F.sum("_n").alias("_n"))
    parts = UNPACKED * int(before.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    moved = masks.join(packed_lists(hop, at, b), at).repartition(parts, "_block", *times)
    rows = moved.withColumn("_to", F.explode(F.arrays_zip(*[F.split(c, ",").alias(c) for c in b])))
    tails = rows.groupBy("_block", *[F.col("_to")[c].alias(c) for c in b], *times).agg(F.bit_or("_mask").alias("_mask"), F.sum("_n").alias("_n"))
    total = tails.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("path_count"), F.coalesce(F.sum(F.bit_count("_mask")), F.lit(0)).cast("long").alias("distinct_edge_count"))
    known = pairs.withColumnsRenamed(held).distinct().join(hop, [*b, *times]).join(counts, [*held.values(), *at]).groupBy(*held.values(), *b, *times).agg(F.sum("_n").alias("_n"))
    matched = known.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("matched_path_count"), F.count(F.lit(1)).alias("matched_distinct_edge_count"))
    return metric_rates(total.crossJoin(matched), path.name)


def chain_counts(tokens: Tokens, path: PathSpec, heads: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Instances per pair of a chain of inner hops without limits and samples of instances: the head's and the tail's columns, graph time, ``instances``.

    ``heads``: the columns of the path's first node and the graph time; ``tails``: those of its last node, all where it is left out.
    No instance moves. Walks go hop by hop from blocks of MASKED heads at most: a node that a
    block reaches is one row with a count for each of the heads, which moves to its block with
    the node's neighbours as one text and becomes rows there. So a count of a pair is in one
    task, and a row moves for MASKED heads.
    """
    if not _plain(path):
        raise ValueError("counts are of chains of inner hops without limits and samples of instances")
    graph, types = tokens.graph, path.types(tokens.graph)
    times, (a, b) = list(graph.time_cols), pair_cols(path, graph)
    tokens = ends_written(tokens, [s.hop for s in path.steps])
    own = [f"_head{i}" for i in range(len(a))]
    blocks = masked_heads(heads.toDF(*own, *times).distinct(), own)
    counts = [f"_n{i}" for i in range(MASKED)]
    parts = UNPACKED * int(tokens.spark.conf.get("spark.sql.shuffle.partitions", "200"))
    reached = blocks.select(*[F.col(x).alias(y) for x, y in zip(own, a, strict=True)], *times, "_block", "_mask")
    for number, step in enumerate(path.steps):
        hop, to = _hop_as_path(tokens, path, number, False), position_cols(graph, types, step.to)
        on = [*position_cols(graph, types, step.at), *times]
        if tails is not None and number == len(path.steps) - 1:  # cut before the join
            hop = hop.join(tails.toDF(*to, *times), [*to, *times], "left_semi")
        if number == 0:  # heads are few: their edges are found first
            sums = [F.count(F.when(F.col("_mask") == (1 << i), 1)).alias(n) for i, n in enumerate(counts)]
            reached = hop.join(reached, on).groupBy("_block", *to, *times).agg(*sums)
        else:
            moved = reached.join(packed_lists(hop, on, to), on).select("_block", *to, *times, *counts).repartition(parts, "_block")
            rows = moved.withColumn("_to", F.explode(F.arrays_zip(*[F.split(c, ",").alias(c) for c in to]))).select("_block", *[F.col("_to")[c].alias(c) for c in to], *times, *counts)
            reached = rows.groupBy("_block", *to, *times).agg(*[F.sum(n).alias(n) for n in counts])
            reached = reached.withColumns({c: F.url_decode(c) for c in to})
        if number < len(path.steps) - 1:
            reached = written(reached, "reached")
    names = blocks.groupBy("_block").agg(F.collect_list(F.struct("_mask", *own)).alias("_heads"))
    each = reached.join(names, "_block").select(F.explode("_heads").alias("_head"), *b, *times, F.array(*counts).alias("_n"))
    n = F.get("_n", F.bit_count(F.col("_head._mask") - 1))
    return each.select(*[F.col("_head")[x].alias(y) for x, y in zip(own, a, strict=True)], *b, *times, n.alias("instances")).where("instances > 0")


def ends_written(tokens: Tokens, hops: Sequence[HopSpec]) -> Tokens:
    """The tokens with their edge tables written once, without features; those of hops with limits or samples are left as they are."""
    graph = tokens.graph
    whole = {x.edge for x in hops if x.edge_limit or x.edge_samples or x.node_limits or x.hop_limit or x.hop_samples}
    ends = lambda e: [c for i in range(len(graph.edges[e].endpoints)) for c in graph.edge_cols(e, i)]
    own = {("edge", e): written(tokens("edge", e).select(*ends(e), *graph.time_cols), "edge") for e in sorted({x.edge for x in hops} - whole)}
    return Tokens(tokens.spark, graph, tokens.targets, {**tokens._made, **own}, tokens.folder)


def _plain(path: PathSpec) -> bool:
    """A chain of inner hops without limits and samples of instances."""
    return len(path.steps) > 1 and all(s.at == i and s.to == i + 1 and s.hop.how == "inner" and not s.path_limit and not s.path_samples for i, s in enumerate(path.steps))


def rank_paths(metrics: DataFrame, min_matched: int = 0, top: int | None = None) -> DataFrame:
    """Path types by falling number of matched pairs, ties by name."""
    out = metrics.where(F.col("matched_distinct_edge_count") >= min_matched).orderBy(F.desc("matched_distinct_edge_count"), "path")
    return out.limit(top) if top else out


def onward_pairs(planner: PathPlanner, paths: Sequence[PathSpec]) -> tuple[DataFrame, DataFrame]:
    """Pairs of chains that share their first hop, in two tables that are written: (head, node after the first hop, time) and the distinct (that node, node at the end, time), which do not grow with the heads."""
    graph, times = planner.tokens.graph, list(planner.tokens.graph.time_cols)
    if any(p.steps[0] != paths[0].steps[0] or not _plain(p) for p in paths):
        raise ValueError("chains of inner hops without limits and samples of instances share their first hop")
    head, middle = (position_cols(graph, paths[0].types(graph), k) for k in (0, 1))
    first = written(planner.prefix(replace(paths[0], steps=paths[0].steps[:1])).select(*head, *middle, *times), "first")
    ends = [f"_end{i}" for i in range(len(pair_cols(paths[0], graph)[1]))]
    parts = [written(k_hop_neighbours(PathPlanner(planner.tokens), linear_path(p.name, [s.hop for s in p.steps[1:]])).toDF(*middle, *ends, *times), "onward") for p in paths]
    return first, reduce(lambda a, b: a.unionByName(b), parts)


def k_hop_neighbours(planner: PathPlanner, path: PathSpec) -> DataFrame:
    """Distinct (head, node at the path's end, graph time)."""
    a, b = pair_cols(path, planner.tokens.graph)
    return planner.prefix(path).select(*a, *b, *planner.tokens.graph.time_cols).distinct()
