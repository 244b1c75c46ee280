"""Operators on small tables."""

from __future__ import annotations

import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.commerce import BUYS, SHIPS, commerce_graph
from pathloom.functions import columns as C
from pathloom.functions.timeutil import TimeWindow, WindowGroup
from pathloom.naming import feature_col
from pathloom.operators import aggregate as A
from pathloom.operators import features as V
from pathloom.operators import metrics as M
from pathloom.operators import sampling as W
from pathloom.plans import collect, dataset, pairs, paths, tokens
from pathloom.plans.hops import Tokens
from pathloom.sources import publications, tables
from pathloom.spec import EdgeType, GraphSpec, HopSpec, NodeType, PathSpec, PathStep, Sample, TableSpec, linear_path
from pathloom.streaming import incremental


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def test_clean_source(spark):
    rows = [("a", "1", 5.0), ("a", "1", 3.0), ("a", "2", None), ("", "1", 1.0), ("NaN", "1", 1.0), ("___", "1", 1.0), (None, "1", 1.0)]
    got = tables.clean_source(spark.createDataFrame(rows, "k string, t string, f double"), ["k"], ["f"], ["t"]).collect()
    assert sorted(map(tuple, got)) == [("a", "1", 3.0, 1), ("a", "2", 0.0, 0)]


def test_columns(spark):
    df = spark.createDataFrame([("x", "1.5", 1), (None, "q", None)], "a string, `b c` string, n int")
    assert C.sanitize_columns(df).columns == ["a", "b_c", "n"] and C.numeric_columns(df) == ["n"]
    assert [tuple(r) for r in C.ensure_numeric(df, ["b c", "n"]).select("b c", "n").collect()] == [(1.5, 1.0), (-1.0, -1.0)]
    assert C.rename(df, {"a": "z"}).columns[0] == "z"
    assert df.where(C.in_partitions(["a", "n"], [("x", 1), ("y", 2)])).count() == 1 and df.where(C.in_partitions(["a"], [])).count() == 0
    assert C.estimated_partitions(df, 10) == 1


def test_aggregates(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", 3.0)], "g string, p string, v double")
    got = {r["g"]: r.asDict() for r in A.aggregate(df, ["g"], [("*", "count", "n"), ("v", "sum", "s")], "p").collect()}
    assert got["a"] == {"g": "a", "x_n": 1, "x_s": 1.0, "y_n": 1, "y_s": None} and got["b"]["y_n"] == 0
    for bad in [("*", "sum", "s")], [("v", "median", "m")]:
        with pytest.raises(ValueError):
            A.aggregate(df, ["g"], bad)
    with pytest.raises(ValueError):
        A.vector_aggregate(df, ["g"], ["v"], ["mean"], "p")
    with pytest.raises(ValueError):
        A.vector_aggregate(df, ["g"], ["v"], ["mode"])
    one = A.vector_aggregate(df.where("g = 'b'"), ["g"], ["v"], ["variance", "std", "normL2"]).first()
    assert tuple(one)[1:] == (0.0, 0.0, 3.0)
    rows = A.collect_rows(df, ["g"], ["p", "v"], "r").where("g = 'a'").first()["r"]
    assert [tuple(r) for r in rows] == [("x", 1.0), ("y", None)]
    assert A.collect_rows(df, ["g"], ["v"], "r", "p", ["x"]).columns == ["g", "x_r"]
    values = ["x"]
    assert A.pivot_counts(df, ["g"], "p", values).columns == ["g", "p_x", "p_Extra"] and values == ["x"]
    with pytest.raises(Exception, match="empty"):
        A.table_quality(df.limit(0), ["g"], ["v"]).collect()
    assert A.table_quality(df, ["g"], ["v", "p"]).first()["duplicate_keys"] == 1


def test_histogram_has_all_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "v double")
    assert sum(r["rows"] for r in A.quantile_histogram(df, "v", 7).collect()) == 101
    same = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert [(r["bin"], r["rows"]) for r in A.quantile_histogram(same, "v", 4).collect()] == [(0, 5)]
    assert A.quantile_histogram(same.limit(0), "v", 4).count() == 0


def test_histogram_bounds_are_exact_at_any_accuracy(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    got = sorted(map(tuple, A.quantile_histogram(df, "v", 10, 10).collect()))
    assert got == [(i, max(0.0, i * 2000.0 - 1), (i + 1) * 2000.0 - 1, 2000 - (i == 0) + (i == 9)) for i in range(10)]


def test_samplers(spark):
    df = spark.createDataFrame([(g, i) for g in range(5) for i in range(g * 3 + 1)], "g int, i int").withColumn("k", F.col("g") * 100 + F.col("i"))
    for kind in ("random", "threshold", "top"):
        got = W.sample_by(kind, df, ["g"], 4, ["k"], ["i"])
        per = {r["g"]: r["count"] for r in got.groupBy("g").count().collect()}
        assert per == ({0: 1, 1: 4} if kind == "threshold" else {g: min(4, g * 3 + 1) for g in range(5)})
    assert {r["i"] for r in W.top_n(df.where("g = 4"), ["g"], 2, ["i"], ["k"]).collect()} == {12, 11}
    with pytest.raises(ValueError):
        W.sample_by("best", df, ["g"], 1, ["k"])
    n = df.count()
    assert sorted(r["id"] for r in W.dense_ids(df, ["k"], "id").collect()) == list(range(n))
    assert W.dense_ids(df.limit(0), ["k"]).count() == 0
    got = {r["g"]: r["count"] for r in W.quota_sample(df, "g", {3: 4, 4: 100, 0: 0}, ["k"], splits=3).groupBy("g").count().collect()}
    assert got == {3: 4, 4: 13}
    assert W.capped_sample(df, 10_000, ["k"]).count() == n and W.random_split(df, [("a", 1.0)], ["k"]).where("sample_type = 'a'").count() == n


def test_running_totals(spark):
    rng = random.Random(5)
    rows = [(rng.random(), rng.randint(0, 9)) for _ in range(500)]
    got = {r["o"]: r["v_before"] for r in W.running_totals(spark.createDataFrame(rows, "o double, v long"), "o", ["v"], 16).collect()}
    total = 0
    for o, v in sorted(rows):
        assert got[o] == total
        total += v


def test_scaling(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, None, 5.0)], "i int, a double, b double")
    got = {r["i"]: r for r in V.scale(df, ["a", "b"], ["raw", "norm", "std"], ["i"]).collect()}
    assert got[3]["features_raw"] == [0.0, 5.0] and got[2]["features_norm"] == [1.0, 0.5] and got[1]["features_std"] == [1.0, 0.0]
    with pytest.raises(ValueError):
        V.scale(df, ["a"], ["log"])
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, [1.0, 2.0])], "k int, v array<double>")
    assert {r["k"]: r["v"] for r in V.left_join_vectors(left, right, ["k"], {"v": 2}).collect()} == {1: [1.0, 2.0], 2: [0.0, 0.0]}


def test_binary_metrics(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    s = np.round(np.clip(rng.random(400) * 0.7 + y * 0.3, 0.01, 0.99), 2)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, label int")
    got = M.binary_metrics(df).first()
    p, q = s[y == 1], s[y == 0]
    assert np.isclose(got["roc_auc"], np.mean((p[:, None] > q) + 0.5 * (p[:, None] == q)))
    assert np.isclose(got["log_loss"], -np.mean(np.where(y == 1, np.log(s), np.log(1 - s))))
    cuts = np.unique(s)[::-1]
    recall, precision = np.array([(p >= c).sum() / len(p) for c in cuts]), np.array([(p >= c).sum() / (s >= c).sum() for c in cuts])
    area = np.sum(np.diff(np.concatenate([[0], recall])) * (precision + np.concatenate([[precision[0]], precision[:-1]])) / 2)
    assert np.isclose(got["pr_auc"], area)
    with pytest.raises(ValueError):
        M.binary_metrics(df.withColumn("label", F.lit(2)))
    same = M.top_k_precision(df.withColumn("score", F.lit(0.5)), [10]).first()["precision"]
    assert np.isclose(same, y.mean())
    only = M.binary_metrics(df.where("label = 1")).first()
    assert only["roc_auc"] is None and np.isclose(only["pr_auc"], 1)


def graph_of(spark, edges, backs) -> GraphSpec:
    schema = "a string, b string, c string, year string"
    source = lambda rows: lambda s: s.createDataFrame(rows, schema)
    group = (WindowGroup(("count_*",), (TimeWindow(-2, 3, "year"),)),)
    time = {"time_cols": ("year",), "time_formats": ("%Y",), "groups": group}
    nodes = {"A": NodeType("A", ("x", "y"), (TableSpec("an", (("a", "b"),), source(edges), **time),)), "C": NodeType("C", ("z",))}
    e = EdgeType("AC", ("A", "C"), (TableSpec("ac", (("a", "b"), ("c",)), source(edges), **time),))
    f = EdgeType("CA", ("C", "A"), (TableSpec("ca", (("c",), ("a", "b")), source(backs), **time),))
    return GraphSpec(("graph_year",), ("%Y",), nodes, {"AC": e, "CA": f})


@pytest.fixture(scope="module")
def small_graph(spark):
    rng = random.Random(9)
    row = lambda: (f"a{rng.randint(0, 5)}", f"b{rng.randint(0, 1)}", f"c{rng.randint(0, 5)}", str(rng.randint(1997, 2000)))
    return graph_of(spark, [row() for _ in range(40)], [row() for _ in range(40)])


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_both_ends_find_what_one_end_finds(spark, small_graph, k):
    """Composite identifiers; without samples the two ways agree."""
    tk = Tokens(spark, small_graph, [("1999",), ("2000",)])
    for p in paths.path_types(small_graph, paths.one_hops(small_graph, None), "A", "C", k)[k]:
        hops = [s.hop for s in p.steps]
        one = paths.PathPlanner(tk).prefix(linear_path("x", hops))
        two = paths.bipath_instances(paths.bipath(hops), small_graph, paths.PathPlanner(tk), paths.PathPlanner(tk))
        assert sorted(map(str, one.select(*sorted(one.columns)).collect())) == sorted(map(str, two.select(*sorted(one.columns)).collect()))


def test_unreached_path_has_zero_metrics(spark, small_graph):
    none = spark.createDataFrame([], "a string, b string, c string, graph_year string")
    rows = paths.find_paths(Tokens(spark, small_graph, [("1999",)]), none, paths.one_hops(small_graph), "A", "C", 2).collect()
    assert rows and all(tuple(r)[1:] == (0, 0, 0.0, 0, 0, 0.0) for r in rows)


def test_search_from_heads_moves_no_pairs(spark, small_graph, monkeypatch):
    """Composite identifiers, several graph times and blocks of heads; no shuffle by head and tail beyond one hop, and the metrics are those of the instances."""
    monkeypatch.setattr(paths, "MASKED", 2, raising=False)
    monkeypatch.setattr(paths, "PACKED", 2)
    tk = Tokens(spark, small_graph, [("1999",), ("2000",)])
    hops = paths.one_hops(small_graph, None)
    links = [(f"a{i}", f"b{i % 2}", f"c{j}", y) for i in range(6) for j in range(3) for y in ("1999", "2000") if (i + j) % 2]
    known = spark.createDataFrame(links, "a string, b string, c string, graph_year string")
    found = paths.find_paths(tk, known, hops, "A", "C", 4, n=None, both_ends=False)
    for line in _plan(found).splitlines():
        assert "Exchange hashpartitioning" not in line or not ("Node_0_" in line and any(f"Node_{k}_C_" in line for k in range(2, 5)))
    got = {r["path"]: tuple(r)[1:] for r in found.collect()}
    heads = known.select("a", "b", "graph_year").distinct()
    want = {}
    for ps in paths.path_types(small_graph, hops, "A", "C", 4).values():
        for p in ps:
            a, b = paths.pair_cols(p, small_graph)
            named = known.toDF(*a, *b, "graph_year")
            instances = paths.PathPlanner(tk, heads).prefix(p)
            want[p.name] = tuple(paths.match_metrics(instances, named, [*a, *b, "graph_year"], p.name).first())[1:]
    assert got == want and any(w[3] > w[4] > 0 for w in want.values())


def test_counts_of_chains_move_no_instances(spark, small_graph, monkeypatch):
    """Composite identifiers, several graph times, repeated heads and blocks of them; counts by pair are those of the instances, and nothing is dealt by head and tail."""
    monkeypatch.setattr(paths, "MASKED", 2)
    monkeypatch.setattr(paths, "PACKED", 2)
    tk = Tokens(spark, small_graph, [("1999",), ("2000",)])
    heads = spark.createDataFrame([(f"a{i}", f"b{i % 2}", y) for i in [*range(5), 0] for y in ("1999", "2000")], "a string, b string, graph_year string")
    tails = spark.createDataFrame([(f"c{i}", y) for i in range(2) for y in ("1999", "2000")], "c string, graph_year string")
    found = 0
    for p in [p for k in (2, 3, 4) for p in paths.path_types(small_graph, paths.one_hops(small_graph, None), "A", "C", 4)[k]][:4]:
        a, b = paths.pair_cols(p, small_graph)
        for t in (tails, None):
            got = paths.chain_counts(tk, p, heads, t)
            assert not any("Exchange hashpartitioning" in x and "_head" in x and b[0] in x for x in _plan(got).splitlines())
            whole = paths.PathPlanner(tk, heads).prefix(p)
            whole = whole if t is None else whole.join(t.toDF(*b, "graph_year"), [*b, "graph_year"], "left_semi")
            want = whole.groupBy(*a, *b, "graph_year").agg(F.count(F.lit(1)).alias("instances"))
            assert got.columns == want.columns
            rows = sorted(map(str, got.collect()))
            assert rows == sorted(map(str, want.collect()))
            found += len(rows)
    assert found
    with pytest.raises(ValueError):
        paths.chain_counts(tk, linear_path("one", paths.one_hops(small_graph, None)[:1]), heads)


def test_pairs_of_four_hops_are_counted_in_blocks(spark, monkeypatch):
    """No join of instances, and no partial counts by pair, which grow with the number of tasks."""
    from pathloom.queries import QUERIES

    plan = _plan(QUERIES["path_4hop_bidir"](spark, "/root/testdata/sf0.001"))
    assert "Node_3_Part_Col_0" in plan and "Node_2_Customer_Col_0" not in plan and "partial_count" not in plan


def test_written_table_leaves_no_shuffle(spark):
    """The shuffle files of a written table are gone when it has been written; the session's setting stays."""
    from pathloom.sources import shared

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: {n for n in env.blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in n}
    before, setting = files(), spark.conf.get(shared.CLEANUP, None)
    out = shared.written(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "few")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(shared.CLEANUP, None) == setting
    assert sorted(r["k"] for r in out.collect()) == [*range(7)]


def test_static_and_missing_slots(spark, small_graph):
    df = tokens.token_table(spark, small_graph, "node", "A", [("1999",)])
    assert df.columns == ["node_A_col_0", "node_A_col_1", "graph_year", "A_feat_col"]
    with pytest.raises(ValueError):
        tokens.token_table(spark, small_graph, "path", "A", [("1999",)])


def test_label_pairs_gives_one_row_per_negative(spark):
    cand = spark.createDataFrame([("h1", "t1"), ("h1", "t2"), ("h2", "t1"), ("h2", "t2"), ("h3", "t3")], "h string, t string").withColumn("y", F.lit("1"))
    labels = spark.createDataFrame([("h1", "t1", "1", "train"), ("h2", "t2", "1", "test")], "h string, t string, y string, sample_type string")
    got = pairs.label_pairs(cand, labels, ["h"], ["t"], ["y"], [spark.createDataFrame([("h2", "t1")], "h string, t string")]).collect()
    assert sorted((r["h"], r["t"], r["label"]) for r in got if r["label"] is not None) == [("h1", "t1", 1), ("h1", "t2", 0), ("h2", "t2", 1)]
    assert sorted((r["h"], r["t"]) for r in got if r["label"] is None) == [("h1", "t2"), ("h3", "t3")]
    batch = pairs.training_batch(spark.createDataFrame([(i, "train", int(i < 2)) for i in range(100)], "i int, sample_type string, label int"), ["i"], 24)
    assert {r["label"]: r["count"] for r in batch.groupBy("label").count().collect()} == {1: 2, 0: 48}


def test_pairs_labelled_by_head_are_those_of_all_candidates(spark, monkeypatch):
    """Nodes with commas, repeated rows, heads and tails without labels, lists of several parts, two times; the same rows as by all candidates."""
    monkeypatch.setattr(paths, "PACKED", 2)
    first = [(f"h,{i}", f"m{(i + j) % 4}", y) for i in range(9) for j in range(2) for y in ("1", "2")]
    onward = [(f"m{i}", f"t,{(3 * i + j) % 11}", y) for i in range(4) for j in range(6) for y in ("1", "2")] * 2
    labels = [("h,0", "t,1", "1", "train"), ("h,1", "t,4", "1", "test"), ("h,1", "t,5", "1", "train"), ("h,2", "t,9", "2", "valid"), ("h,8", "t,0", "2", "test"), ("x", "t,7", "1", "valid")]
    a = spark.createDataFrame(first, "h string, m string, y string")
    b = spark.createDataFrame(onward, "m string, t string, y string")
    known = spark.createDataFrame([("h,0", "t,2"), ("h,1", "t,4"), ("h,3", "t,0"), ("h,3", "t,0")], "h string, t string")
    own = spark.createDataFrame([("h,0", "1", 5), ("h,2", "2", 7)], "h string, y string, n int")
    named = spark.createDataFrame(labels, "h string, t string, y string, sample_type string")
    got = pairs.label_pairs_by_head(a, b, named, ["h"], ["m"], ["t"], ["y"], [known], own)
    candidates = a.join(b, ["m", "y"]).select("h", "t", "y").distinct()
    want = pairs.label_pairs(candidates, named, ["h"], ["t"], ["y"], [known], infer=False).join(own, ["h", "y"], "left")
    cols = ["h", "t", "y", "sample_type", "label", "n"]
    rows = sorted(map(str, got.select(*cols).collect()))
    assert rows == sorted(map(str, want.select(*cols).collect())) and any("label=1" in r for r in rows) and any("n=5" in r for r in rows)


def test_scorer_reads_written_pairs(spark):
    """Each step of the fit reads the plan it is given, so what it is given joins nothing."""
    from pathloom.queries import QUERIES

    plan = _plan(QUERIES["lr_scorer"](spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in plan and "Join" not in plan and "Scan parquet" in plan


def test_collections_stay_aligned(spark):
    inst = spark.createDataFrame([("h", str(i), None if i % 2 else i) for i in range(30)], "h string, t string, f int")
    c = collect.Collection("p", inst, ("h",), ("h",), ("t", "f"))
    row = collect.collect_pairs(spark.createDataFrame([("h",), ("z",)], "h string"), [c], 20).where("h = 'h'").first()
    assert row["p_collect_count"] == 20 and all((f is None) == (int(t) % 2 == 1) for t, f in zip(row["p_clt_t"], row["p_clt_f"], strict=True))
    filled = collect.fill_counts(collect.collect_pairs(spark.createDataFrame([("z",)], "h string"), [c]), ["p"]).first()
    assert filled["p_collect_count"] == 0
    config = dataset.token_index(spark.createDataFrame([("h", 2), ("z", 0)], "h string, p_collect_count int"), ["h"], ["p"], ["h"]).collect()
    assert sorted((r["slot"], r["path_index"]) for r in config) == [(2, 2), (3, 3)] or sorted(r["slot"] for r in config) == [2, 3]


def test_save_and_probe(spark, folder):
    path = f"{folder}/t"
    df = spark.createDataFrame([("01", "a"), ("02", "b")], "month string, v string")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    tables.save_table(df, path, ["month"], [("03",)], "f1")
    assert tables.missing_partitions(spark, path, [("01",), ("03",), ("04",)], "f1") == [("04",)]
    assert tables.missing_partitions(spark, path, [("01",)], "f2") == [("01",)]
    tables.save_table(spark.createDataFrame([("02", "c")], "month string, v string"), path, ["month"], (), "f1")
    assert sorted(tuple(r) for r in tables.read_table(spark, path).select("month", "v").collect()) == [("01", "a"), ("02", "c")]
    calls = []

    def compute(values):
        calls.append(values)
        return spark.createDataFrame([(v[0], "n") for v in values], "month string, v string")

    assert tables.compute_missing(spark, path, ["month"], [("01",), ("05",)], compute, "f1").count() == 2 and calls == [[("05",)]]
    tables.save_table(df.limit(0), f"{folder}/empty", ["month"], [("09",)])
    assert tables.missing_partitions(spark, f"{folder}/empty", [("09",)]) == []
    assert tables.to_pandas(spark, path, ["v"]).shape == (3, 1)
    files = tables.Files(spark)
    files.write_json(f"{folder}/x/j.json", {"k": "é"})
    assert files.read_json(f"{folder}/x/j.json") == {"k": "é"} and files.list(f"{folder}/x") == ["j.json"] and files.delete(f"{folder}/x") and not files.exists(f"{folder}/x")
    assert "USING parquet" in tables.create_table(spark, f"t_{uuid.uuid4().hex[:8]}", df.select("v", "month"), ["month"], comments={"v": "value"})


def test_publications(spark, folder):
    records = [
        {"id": "p1", "title": "T", "doc_type": "Journal", "year": "2001", "venue": {"raw": " V "}, "references": ["p0", "", None, "p0"], "keywords": [" k ", ""], "authors": [{"id": "a1", "name": "N", "org": "O"}, {"id": "", "name": "M", "org": "O"}]},
        {"id": "p2", "year": "0", "references": ["p1"]},
        {"id": "p3", "year": "2001", "authors": [{"id": "a1", "name": "N", "org": "O"}]},
    ]
    spark.createDataFrame([(__import__("json").dumps(r),) for r in records], "value string").write.text(f"{folder}/raw")
    got = publications.publication_tables(publications.read_records(spark, f"{folder}/raw"))
    count = {k: v.count() for k, v in got.items()}
    assert count == {"paper": 2, "author": 1, "paper_cite_paper": 1, "author_write_paper": 2, "author_to_org": 1, "paper_to_org": 2, "paper_to_venue": 1, "paper_to_keyword": 1}
    assert got["author_to_org"].first()["author_paper_count"] == 2 and got["paper_to_venue"].first()["venue"] == "V"
    assert {r["paper_id"]: (r["Conference_mark"], r["Journal_mark"]) for r in got["paper"].collect()}["p1"] == (0, 1)


def test_stream_recomputes_touched_times(spark, folder):
    groups = [WindowGroup(("count_*",), (TimeWindow(-1, 2, "year"),))]
    known = [(str(y),) for y in range(1998, 2002)]
    schema = "k string, year string"

    def compute(archive, times):
        source = tables.clean_source(archive.select("k", "year"), ["k"], [], ["year"])
        return tokens.time_aggregate(spark, source, ["k"], [], ["year"], ["%Y"], groups, ["graph_year"], ["%Y"], times)

    for n, rows in enumerate([[("a", "1998"), ("a", "1999")], [("b", "2000"), ("a", "2000")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        incremental.maintain(stream, f"{folder}/archive", f"{folder}/out", ["year"], ["%Y"], ["graph_year"], ["%Y"], groups, known, compute, f"{folder}/checkpoint").awaitTermination()
    got = {(r["k"], str(r["graph_year"])): r["agg_-1_to_1_year_count_all"] for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {("a", "1998"): 1.0, ("a", "1999"): 2.0, ("a", "2000"): 2.0, ("a", "2001"): 1.0, ("b", "2000"): 1.0, ("b", "2001"): 1.0}


def test_daily_counts_stream(spark, folder):
    df = spark.createDataFrame([("u", "2024-01-01 10:00:00", 1.0), ("u", "2024-01-01 12:00:00", 2.0), ("u", "2024-01-09 00:00:00", 4.0)], "user string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{folder}/ev")
    out = incremental.daily_counts(spark.readStream.schema(df.schema).parquet(f"{folder}/ev"), "ts", ["user"])
    name = f"m{uuid.uuid4().hex[:6]}"
    q = out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n"], r["value"]) for r in spark.table(name).collect()) == [(1, 4.0), (2, 3.0)]


def test_shards_and_batches(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    parts = [{r["k"] for r in dataset.shard(df, ["k"], i, 3).collect()} for i in range(3)]
    assert set.union(*parts) == set(range(100)) and sum(map(len, parts)) == 100
    got = list(dataset.batches(df, ["k"], 30, 1, fill_last=True))
    assert [len(b) for b in got] == [30, 30, 30, 30] and {r["k"] for b in got for r in b} == set(range(100))
    assert [len(b) for b in dataset.batches(df, ["k"], 30, 2)] == [30, 30, 30, 10] and list(dataset.batches(df, ["k"], 30, 2))[0] != got[0]
    with pytest.raises(ValueError):
        dataset.shard(df, ["k"], 3, 3)


def test_counts_of_a_collection_move_no_instances(spark):
    df = spark.createDataFrame([("a", str(i)) for i in range(5)] + [("b", "1"), ("b", "1"), (None, "2")], "h string, t string")
    c = collect.Collection("p", df, ("h",), ("head",), ("t",))
    want = collect.collect(c, 3).select("head", "p_collect_count")
    got = collect.collect_counts(c, 3)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _two_edges(spark, buys):
    graph = commerce_graph("unused")
    ships = spark.createDataFrame([("p,1", f"s {i}%2C", "1999", (1.0,)) for i in range(7)] + [("p2", "s,1", "1999", (1.0,))], "a string, b string, graph_year string, f struct<x: double>")
    named = lambda df, edge: df.toDF(*graph.edge_cols(edge, 0), *graph.edge_cols(edge, 1), "graph_year", feature_col(edge))
    return Tokens(spark, graph, [("1999",)], {("edge", BUYS): named(buys, BUYS), ("edge", SHIPS): named(ships, SHIPS)})


def test_sampled_instances_move_as_lists(spark, monkeypatch):
    """Also of nodes with more neighbours than a list holds, and of names with commas; instances are not shuffled."""
    monkeypatch.setattr(paths, "PACKED", 3)
    buys = spark.createDataFrame([(c, p, "1999", (1.0,)) for c in ("c1", "c2", "") for p in ("p,1", "p2", "p3")], "a string, b string, graph_year string, f struct<x: double>")
    steps = lambda n: (PathStep(HopSpec(BUYS), 0, 1), PathStep(HopSpec(SHIPS), 1, 2, None, (Sample("random", (0, 2), n),) if n else ()))
    of = lambda n: paths.PathPlanner(_two_edges(spark, buys)).prefix(PathSpec("cps", steps(n)))
    plain, all_ = of(0), of(100)
    assert sorted(all_.select(plain.columns).collect()) == sorted(plain.collect()) and plain.count() == 24
    assert of(1).count() == 24
    plan = _plan(all_)
    assert plan.index("Generate") < plan.index("Exchange")


def test_edge_rows_move_once(spark):
    """One shuffle for cleaning and windows of an edge table, without rows outside of the windows."""
    rows = spark.createDataFrame([("a", "b", "1999", 3.0), ("a", "b", "1999", 2.0), ("a", "b", "1998", 5.0), ("a", "b", "1980", 7.0), ("a", "c", "2001", 1.0)], "u string, v string, year string, q double")
    spec = TableSpec("t", (("u",), ("v",)), lambda _: rows, ("q",), time_cols=("year",), time_formats=("%Y",), groups=(WindowGroup(("count_*", "sum"), (TimeWindow(-1, 2, "year"),)),))
    edge = EdgeType(BUYS, ("Customer", "Part"), (spec,))
    nodes = {n: NodeType(n, (f"{n}_Node",), ()) for n in ("Customer", "Part")}
    df = tokens.token_table(spark, GraphSpec(("graph_year",), ("%Y",), nodes, {BUYS: edge}), "edge", BUYS, [("1999",)])
    plan = _plan(df)
    assert plan.count("Exchange hashpartitioning") == 1 and "year#" in plan[plan.rindex("IN (") - 40 :]
    assert [(*r[:3], r[3][0], r[3][1]) for r in df.collect()] == [("a", "b", "1999", 2.0, 7.0)]


def test_label_pairs_moves_candidates_once(spark, monkeypatch):
    """The joins with known pairs and with labels share one shuffle of the candidates; a label holds at its own time only."""
    plans = {}
    monkeypatch.setattr(pairs, "written", lambda df, label: plans.setdefault(label, _plan(df)) and df)
    cand = spark.createDataFrame([("a", "b", "1999"), ("a", "b", "1998"), ("a", "c", "1999"), ("d", "b", "1999"), ("d", "e", "1999")], "h string, t string, y string")
    labels = spark.createDataFrame([("a", "b", "1999", "train")], "h string, t string, y string, sample_type string")
    known = spark.createDataFrame([("d", "e")], "h string, t string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pairs.label_pairs(cand, labels, ["h"], ["t"], ["y"], [known], infer=False)
        got = sorted(map(tuple, out.collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [("a", "b", "1999", "train", 1), ("a", "c", "1999", "train", 0), ("d", "b", "1999", "train", 0)]
    assert plans["candidates"].count("Exchange hashpartitioning(h") + plans["candidates"].count("Exchange hashpartitioning(_h") == 4
