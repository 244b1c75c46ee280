"""Pure functions and specifications."""

from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pathloom import naming
from pathloom.functions import timeutil as T
from pathloom.functions.columns import estimated_row_bytes, sanitized
from pathloom.operators.features import parse_vector
from pathloom.plans import paths
from pathloom.plans.dataset import dataset_config
from pathloom.session import ResilientRunner
from pathloom.spec import EdgeType, GraphSpec, HopSpec, NodeType, PathSpec, PathStep, Sample, TableSpec, linear_path
from pathloom.streaming.incremental import touched_times

YEAR = {"time_cols": ("year",), "time_formats": ("%Y",)}


def windows(*funcs: str, years: int = 10):
    return T.window_groups([{"start_times_range": [0, -years, -1], "time_interval_len": 1, "time_unit": "year", "agg_funcs": list(funcs)}, {"start_times_range": [-49, 0, 49], "time_interval_len": 50, "time_unit": "year", "agg_funcs": list(funcs)}])


def publications() -> GraphSpec:
    """Papers, authors, organisations, venues, keywords."""
    kinds = {"Paper": "p", "Author": "a", "Org": "o", "Venue": "v", "Keyword": "k"}
    nodes = {n: NodeType(n, (f"{n}_Node",)) for n in kinds}
    author = (
        TableSpec("wrote", (("a",),), "x", groups=windows("count_*"), **YEAR),
        TableSpec("past_org", (("a",),), "x", ("papers",), groups=windows("count_*", "mean", "max"), **YEAR),
    )
    nodes["Author"] = NodeType("Author", ("Author_Node",), author)
    ends = [("Paper", "Paper"), ("Paper", "Author"), ("Paper", "Org"), ("Paper", "Venue"), ("Paper", "Keyword"), ("Author", "Org")]
    return GraphSpec(("graph_year",), ("%Y",), nodes, {naming.edge_type_name(*e): EdgeType(naming.edge_type_name(*e), e) for e in ends})


def test_windows():
    (group,) = windows("count_*")
    assert [w.name for w in group.windows][:2] == ["agg_0_to_1_year", "agg_-1_to_0_year"] and len(group.windows) == 11
    assert group.windows[-1].name == "agg_-49_to_1_year"
    assert T.window_groups([{"start_times_range": [-49, 0, 49], "time_interval_len": 50, "time_unit": "year"}])[0].funcs == ("first",)
    for bad in ({"time_unit": "week"}, {"agg_funcs": ["median"]}):
        with pytest.raises(ValueError):
            T.window_groups([{"start_times_range": [0, 1], "time_interval_len": 1, "time_unit": "year", "agg_funcs": ["sum"]} | bad])


def test_token_width_and_order():
    author = publications().nodes["Author"]
    assert len(author.slots) == 68 and len(author.tables[0].slots) == 12 and len(author.tables[1].slots) == 56
    assert author.tables[1].slots[:5] == [f"past_org__agg_0_to_1_year_{x}" for x in ("count_all", "mean_papers", "mean_null_mark_of_papers", "max_papers", "max_null_mark_of_papers")]
    assert author.slots[11] == "null_mark_of_wrote" and author.slots[-1] == "null_mark_of_past_org"


def test_calendar():
    assert T.shift(datetime(2024, 1, 15), -1, "month") == datetime(2023, 12, 15)
    assert T.shift(datetime(2024, 2, 29), -1, "year") == datetime(2023, 2, 28)
    assert T.shift(datetime(2024, 3, 1), -1, "day") == datetime(2024, 2, 29)
    assert T.reformat(("2020", "03"), ("%Y", "%m"), ("%m/%Y",)) == ("03/2020",)
    assert T.spark_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    with pytest.raises(ValueError):
        T.spark_pattern("%Q")
    with pytest.raises(ValueError):
        T.shift(datetime(2024, 1, 1), 1, "week")


def test_coarse_source_reaches_every_graph_time():
    got = T.time_map([("2020", "01"), ("2020", "02")], ["%Y", "%m"], ["%Y"], [T.TimeWindow(0, 1, "month")])
    assert got == [(("2020",), ("2020", "01"), 0), (("2020",), ("2020", "02"), 0)]


@given(st.integers(-40, 40), st.integers(1, 20), st.sampled_from(T.UNITS))
def test_time_map_is_the_window(start, length, unit):
    got = T.time_map([("2000-05-17",)], ["%Y-%m-%d"], ["%Y-%m-%d"], [T.TimeWindow(start, length, unit)])
    assert len(got) == length


def test_path_types():
    graph = publications()
    found = paths.path_types(graph, paths.one_hops(graph), "Author", "Paper", 4)
    assert {k: len(v) for k, v in found.items()} == {1: 1, 2: 3, 3: 11, 4: 37}


def test_reversal():
    graph = publications()
    for ps in paths.path_types(graph, paths.one_hops(graph, None), "Author", "Paper", 4).values():
        for p in ps:
            hops = [s.hop for s in p.steps]
            assert list(paths.reverse_hops(paths.reverse_hops(hops))) == hops
            spec = paths.bipath(hops)
            assert len(spec.forward.steps) == -(-len(hops) // 2) and (spec.backward is None) == (len(hops) == 1)


def test_spec_validation():
    graph = publications()
    pa = naming.edge_type_name("Paper", "Author")
    with pytest.raises(ValueError):
        Sample("best", (0,), 1)
    with pytest.raises(ValueError):
        PathSpec("x", (PathStep(HopSpec(pa), 0, 1), PathStep(HopSpec(pa), 5, 6)))
    with pytest.raises(ValueError):
        PathSpec("x", (PathStep(HopSpec(pa), 0, 1), PathStep(HopSpec(pa), 1, 0)))
    with pytest.raises(ValueError):
        linear_path("x", [HopSpec(pa), HopSpec(pa)]).validate(graph)
    a, b = linear_path("one", [HopSpec(pa)]), linear_path("two", [HopSpec(pa)])
    assert a.fingerprint == b.fingerprint != linear_path("one", [HopSpec(pa, 1, 0)]).fingerprint
    with pytest.raises(ValueError):
        TableSpec("t", (("a",), ("a",)), "x")
    with pytest.raises(ValueError):
        GraphSpec(("y",), ("%Y",), {"A": NodeType("A", ("A",))}, {"e": EdgeType("e", ("A", "B"))})


def test_graph_from_config():
    side = {"/r/t": {"node_col_to_types": {"a": "A_Node", "b": "B_Node"}, "feat_cols": ["f"], "time_cols": ["year"], "time_cols_formats": ["%Y"]}}
    window = [{"start_times_range": [0, 1], "time_interval_len": 1, "time_unit": "year", "agg_funcs": ["sum"]}]
    config = {
        "graph_time_cols_alias": ["graph_year"], "graph_time_cols_formats": ["%Y"], "table_default_config": {"src_table_root_path": "/r", "time_aggs_configs": window},
        "node_schemas": {"A": {"node_col_types": ["A_Node"], "node_tables": {"ta": {"src_table_rel_path": "/t", "node_cols": ["a"]}}}, "B": {"node_col_types": ["B_Node"]}},
        "edge_schemas": {"A___linked_with___B": {"linked_node_types": ["A", "B"], "edge_tables": {"te": {"src_table_rel_path": "/t", "linked_node_types_cols": [["a"], ["b"]]}}}},
    }
    graph = GraphSpec.from_config(config, side.__getitem__)
    assert graph.nodes["A"].slots == ["ta__agg_0_to_1_year_sum_f", "ta__agg_0_to_1_year_sum_null_mark_of_f", "null_mark_of_ta"]
    config["node_schemas"]["A"]["node_tables"]["ta"]["node_cols"] = ["b"]
    with pytest.raises(ValueError):
        GraphSpec.from_config(config, side.__getitem__)


def test_dataset_config():
    graph = publications()
    hops = [HopSpec(naming.edge_type_name("Paper", "Author"), 1, 0), HopSpec(naming.edge_type_name("Paper", "Paper"))]
    config = dataset_config(graph, [paths.bipath(hops)], 20)
    (seq,) = config["paths"].values()
    assert [x[0] for x in seq] == ["edge", "node", "edge"] and config["max_nodes"] == 1 and config["max_length"] == 3 and config["feature_lengths"]["Author"] == 68


def test_vectors_and_names():
    assert parse_vector("(4,[0,2],[1.0,3.5])") == (4, [0, 2], [1.0, 3.5])
    assert parse_vector("[1, 2]") == (2, [0, 1], [1.0, 2.0])
    for bad in ("4", "(2,[5],[1])", "__import__('os')"):
        with pytest.raises(ValueError):
            parse_vector(bad)
    assert sanitized("a b-中c") == "a_b_中c"


def test_row_bytes(spark):
    from pyspark.sql.types import StructType

    assert estimated_row_bytes(StructType.fromDDL("a int, b bigint, c string, d array<double>, e date"), {"c": 10}) == 4 + 8 + 40 + 300 + 100


def test_runner_restarts():
    calls = []

    class Session:
        def stop(self):
            calls.append("stop")

    def work(spark, x):
        calls.append("run")
        if calls.count("run") < 3:
            raise ConnectionError
        return x

    assert ResilientRunner(Session, 5).run(work, 7) == 7 and calls == ["run", "stop", "run", "stop", "run"]
    calls.clear()
    with pytest.raises(ConnectionError):
        ResilientRunner(Session, 1).run(work, 7)
    waited = []
    runner = ResilientRunner(Session, active_hours=(22, 6), sleep=waited.append)
    assert runner.wait_until_active(datetime(2024, 1, 1, 23)) == 0 and runner.wait_until_active(datetime(2024, 1, 1, 20)) == 7200 and waited == [7200]


def test_touched_times():
    groups = [T.WindowGroup(("sum",), (T.TimeWindow(-2, 3, "year"),))]
    assert touched_times([("1998",)], ["%Y"], ["%Y"], groups, [(str(y),) for y in range(1996, 2003)]) == [("1998",), ("1999",), ("2000",)]
