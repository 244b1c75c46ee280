"""Corpus pipeline: from documents to a deduplicated, clean, weighted mix.

Stages, each over all rows that the one before kept:

1. ``quality``: rows that the byte-level network rejects (score below 0.5) go.
2. ``exact``: of equal texts the row with the largest doc_id stays.
3. ``near``: of each group of near duplicates (five words, 0.8) the row with the smallest doc_id stays.
4. ``decontaminate``: rows that overlap with a benchmark item go.
5. ``mix``: sources are mixed to target weights; the rows that the mix takes, with their number of copies.

All but the last return the columns of their input. The stages ``exact`` and ``near``
number the rows and keep exactly one of each group: a row with a null doc_id only
where no other has one, and any one of rows with equal doc_id. Texts without words
are no near duplicates. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, exact_dedup, mixing, near_dedup, quality, scratch, training

MIX_WEIGHTS = [5, 2, 1]
NEAR_PERCENT = 80
#: Column of the row numbers inside of a stage.
NUMBER = "_row_number"
#: Size of the filter of the rows that a stage drops.
FILTER_BYTES = 16 << 20
#: SQL can express neither the network nor its decisions; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def _with_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row), so that no other column's name can clash."""
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def _numbered(docs: DataFrame, label: str) -> DataFrame:
    """The rows with a number each; from files, so that a row has the same number whenever it is read."""
    return scratch.materialise(docs.withColumn(NUMBER, F.monotonically_increasing_id()), label)


def _one_of_each(docs: DataFrame, groups: DataFrame, largest: bool) -> DataFrame:
    """Of each group (number, group) of numbered rows, the one with the largest or smallest doc_id."""
    ids = docs.select(F.col(NUMBER).alias("number"), F.col("doc_id").cast("long").alias("id"))
    known = scratch.materialise(groups.join(ids, "number"), "groups")
    order = F.struct("id", -F.col("number")) if largest else F.struct(F.col("id").isNull(), "id", "number")
    pick = F.max_by if largest else F.min_by
    chosen = known.groupBy("group").agg(pick("number", order).alias("number")).select("number")
    gone = scratch.materialise(known.join(chosen, "number", "left_anti").select("number"), "gone")
    # most rows stay: those that the filter of the others does not hold do not move
    rows = docs.select(F.xxhash64(NUMBER).alias("k1"), F.col(NUMBER).alias("number"), F.struct(*[docs[c] for c in docs.columns if c != NUMBER]).alias("row"))
    keys = gone.select(F.xxhash64("number").alias("k1"))
    kept = decontaminate.may_be_in(rows, keys, FILTER_BYTES, inside=False).select("row")
    asked = decontaminate.may_be_in(rows, keys, FILTER_BYTES).join(gone, "number", "left_anti").select("row")
    return kept.unionByName(asked).select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels, training.fold(F.col("doc_id"), 3) != 1)
    return quality.score_quality(_with_row(docs), model, keep=("row",)).where("score >= 0.5").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs, "exact-rows")
    groups = exact_dedup.exact_dedup(rows, id_col=NUMBER)
    return _one_of_each(rows, groups.select(F.col("doc_id").alias("number"), F.col("keep_id").alias("group")), largest=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs, "near-rows")
    groups = near_dedup.near_dedup(rows, percent=NEAR_PERCENT, id_col=NUMBER)
    return _one_of_each(rows, groups.select(F.col("doc_id").alias("number"), F.col("component_id").alias("group")), largest=False)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(_with_row(docs), benchmark, keep=("row",)).where("NOT contaminated").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, MIX_WEIGHTS).where("copies > 0")


STAGES = [
    ("quality", drop_low_quality),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.materialise(stage(spark, docs, sf_dir), name)
    return docs
