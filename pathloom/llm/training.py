"""Bounded samples of labelled rows, and the held-out rule."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the identifier as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds).cast("long")).cast("int")


def hash_sample(rows: DataFrame, key: str, want: int, seed: int) -> DataFrame:
    """About ``want`` rows (all, if there are fewer), by a hash of their key below a threshold: no sorting, and the same rows on every run.

    Never more than twice as many: the sum of that many independent choices does
    not come near it, and a limit makes it certain.
    """
    n = rows.count()
    if n <= want:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 31)) < int(want / n * (1 << 31))).limit(2 * want)


def in_hash_order(ids: list[int]) -> list[int]:
    return sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).digest(), i))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, use: Column, max_rows: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of about ``max_rows`` labelled rows by a hash of the identifier, of which those in hash order whose texts sum up to ``max_bytes``.

    Texts of more than an eighth of ``max_bytes`` are not learned from. Of one identifier's texts the
    shortest is taken; of its labels the greatest. ``use`` is a condition on the identifier column of
    labels. Sizes are read first, so neither the texts that a task writes nor those that a driver
    collects exceed ``max_bytes``; identifiers and sizes, at most twice ``max_rows``, go to the driver.
    """
    spark = docs.sparkSession
    own = labels.where(use & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    picked = hash_sample(own, "doc_id", max_rows, 97)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumns({"n": F.octet_length("text"), "h": F.xxhash64("text")}).where(F.col("n") <= max_bytes // 8)
    found = texts.select("doc_id", "n", "h").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("n", "h")).alias("t"), F.max("label").alias("label")).collect()
    by_id = {r["doc_id"]: r for r in found}
    chosen, held = [], 0
    for i in in_hash_order(list(by_id)):
        r = by_id[i]
        held += r["t"]["n"]
        if held > max_bytes:
            break
        chosen.append((i, r["t"]["h"], r["label"]))
    wanted = spark.createDataFrame(chosen, "doc_id long, h long, label int")
    return texts.join(F.broadcast(wanted), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "label")
