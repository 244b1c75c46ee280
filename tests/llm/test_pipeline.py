"""The corpus pipeline's stages against brute-force versions."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from pathloom.llm import scratch
from tests.llm.test_operators import UPPER, labelled, shingles, shuffled, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string"


@pytest.fixture(scope="module")
def tables(spark):
    path = scratch.new_path(spark, "pipeline-test")
    rng = random.Random(3)
    rows, labels = labelled(300)
    texts = [t for _, t in rows]
    texts += [texts[0], texts[1].upper() if texts[1].isascii() else texts[1], None, None, ""]
    near = words(100, 4)
    texts += [near, near + " more", near + " other words"]
    item = words(30, 5)
    texts += [f"{words(20, 6)} {item} {words(20, 7)}"]
    data = [(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), "r", "k") for i, t in enumerate(texts)] + [(None, words(20, 8), "en", "a", 1, "r", "k")]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, words(30, 50))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, data, {i: q for i, q, _ in labels}


def test_stages(spark, tables):
    path, data, good = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.materialise(stage(spark, docs, path), name)
        if name != "mix":
            assert docs.columns == columns
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    text = {r[0]: r[1] for r in data}
    wrong = [i for i in good if (i in kept["quality"]) != good[i]]
    assert len(wrong) <= 0.05 * len(good)
    best = {}
    for i in sorted(x for x in kept["quality"] if x is not None):
        best[(text[i] or "").translate(UPPER)] = i
    assert kept["exact"] - {None} == set(best.values())
    for a in kept["near"] - {None}:
        for b in kept["near"] - {None}:
            p, q = shingles(text[a]), shingles(text[b])
            assert a == b or not p or 100 * len(p & q) < 80 * len(p | q)
    gone = kept["exact"] - kept["near"]
    for a in gone:
        assert any(100 * len(shingles(text[a]) & shingles(text[b])) >= 80 * len(shingles(text[a]) | shingles(text[b])) for b in kept["exact"] - {None, a})
    leak = max(i for i in text if i is not None)
    assert kept["near"] - kept["decontaminate"] == ({leak} & kept["near"])
    assert kept["mix"] <= kept["decontaminate"] and None in kept["decontaminate"]


def test_one_row_of_each_group_stays(spark):
    a, b, c, near = words(40, 60), words(40, 61), words(40, 62), words(100, 63)
    rows = [(None, a), (None, a), (1, a), (2, b), (2, b), (None, c), (None, c.upper() if c.isascii() else c), (3, a), (3, words(40, 64)), (None, None), (4, "")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, row string").repartition(3)
    got = corpus_pipeline.drop_exact_copies(spark, docs, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(False, 3, a), (False, 2, b), (True, 0, c), (False, 3, rows[8][1]), (False, 4, "")])
    rows = [(None, near), (None, near + " more"), (7, near + " other"), (7, near + " other words"), (6, near + " end"), (None, b), (None, b + " x"), (8, c), (8, c), (8, a), (None, "")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, row string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert docs.columns == list(got[0].asDict())
    left = sorted((r["doc_id"] or 0, r["text"]) for r in got)
    assert [x for x in left if x[0]] == sorted([(6, near + " end"), (8, a), (8, c)])
    assert len(left) == 5 and (0, "") in left and len({t for i, t in left if not i} & {b, b + " x"}) == 1


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).count() > 100


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables[0])
        assert docs.count() == 0


def test_rows_that_stay_do_not_move(spark):
    """Of the rows of a deduplication stage only those that may go are shuffled; one of each group stays, whatever its identifier."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(300)), "k") for i in range(400)]
    rows += [(1000, rows[0][1], "k"), (None, rows[1][1], "k"), (2, rows[2][1], "k"), (None, "a", "k"), (None, "a", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string").repartition(4).persist()
    docs.count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        out = corpus_pipeline.drop_exact_copies(spark, docs, "")
        got = sorted(((r["doc_id"], r["k1"]) for r in out.collect()), key=str)
        assert shuffled(spark) - before < sum(len(r[1]) for r in rows) / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert out.columns == docs.columns
    assert got == sorted([(i, "k") for i in [*range(1, 400), 1000, None]], key=str)
