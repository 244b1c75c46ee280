"""Nested publication records as node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "id string, title string, lang string, doc_type string, year string, venue struct<raw: string>, references array<string>, keywords array<string>, "
    "authors array<struct<id: string, name: string, org: string>>"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records from JSON lines with a declared schema."""
    return spark.read.schema(RECORD).json(path)


def _given(*cols: str):
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull() & (F.col(c) != "")
    return out


def publication_tables(records: DataFrame, doc_types: Sequence[str] = ("Conference", "Journal")) -> dict[str, DataFrame]:
    """paper, author, and edge tables by year; rows without identifier or with year 0 go; text is trimmed."""
    base = records.where(_given("id", "year") & (F.col("year") != "0"))
    trim = lambda c: F.trim(c)
    marks = [F.when(F.col("doc_type") == t, 1).otherwise(0).alias(f"{t}_mark") for t in doc_types]
    paper = base.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title"), *marks, "year").dropDuplicates(["paper_id", "year"])
    people = base.select(F.col("id").alias("paper_id"), "year", F.explode("authors").alias("a")).select("paper_id", "year", trim("a.id").alias("author_id"), trim("a.name").alias("author_name"), trim("a.org").alias("org"))
    return {
        "paper": paper,
        "author": people.where(_given("author_id")).groupBy("author_id").agg(F.min("author_name").alias("author_name")),
        "paper_cite_paper": base.select(F.col("id").alias("paper_id"), F.explode("references").alias("cite_paper_id"), "year").where(_given("cite_paper_id")).distinct(),
        "author_write_paper": people.where(_given("author_id")).select("author_id", "paper_id", "year").distinct(),
        "author_to_org": people.where(_given("author_id", "org")).select("author_id", "paper_id", "org", "year").distinct().groupBy("author_id", "org", "year").agg(F.count(F.lit(1)).alias("author_paper_count")),
        "paper_to_org": people.where(_given("org")).groupBy("paper_id", "org", "year").agg(F.count(F.lit(1)).alias("org_in_paper_count")),
        "paper_to_venue": base.select(F.col("id").alias("paper_id"), trim("venue.raw").alias("venue"), "year").where(_given("venue")),
        "paper_to_keyword": base.select(F.col("id").alias("paper_id"), F.explode("keywords").alias("k"), "year").select("paper_id", trim("k").alias("keyword"), "year").where(_given("keyword")).distinct(),
    }
