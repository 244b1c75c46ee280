"""Reading, cleaning, saving and probing tables; files through Hadoop's file systems."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.columns import aliased, estimated_row_bytes, in_partitions, presence_marks, valid_ids
from pathloom.naming import presence_col


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", partitions: tuple[Sequence[str], Sequence[Sequence[str]]] | None = None, select: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """A table, or exact partitions ((columns), (values...)) of it, with an aliased projection. The filter is static, so only those directories are listed."""
    df = spark.read.format(fmt).load(path)
    if partitions:
        df = df.where(in_partitions(*partitions))
    return df.select(aliased(select)) if select else df


def clean_source(df: DataFrame, keys: Sequence[str], features: Sequence[str] = (), times: Sequence[str] = (), by_keys: bool = False) -> DataFrame:
    """Valid identifiers; one row per keys and times; presence marks; nulls as 0.

    Of several rows the one with the least features (nulls first) stays: a
    minimum, combined before rows move. With ``by_keys`` rows move by their keys
    alone, uncombined; later groups by the keys, or by more, move nothing.
    """
    own = df.where(valid_ids(keys)).select(*[F.col(k).cast("string").alias(k) for k in keys], *[F.col(t).cast("string").alias(t) for t in times], *[F.col(f).cast("double").alias(f) for f in features])
    own = own.repartition(*keys) if by_keys else own
    group = [*keys, *times]
    if not features:
        return own.distinct()
    one = own.groupBy(*group).agg(F.min(F.struct(*features)).alias("_f")).select(*group, *[F.col(f"_f.{f}").alias(f) for f in features])
    marked = presence_marks(one, features).fillna(0, list(features))
    return marked.select(*group, *[c for f in features for c in (F.col(f), F.col(presence_col(f)))])


class Files:
    """Small files in any file system that Spark's Hadoop knows."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make_dir(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def write_text(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_json(self, path: str, value) -> None:
        self.write_text(path, json.dumps(value, ensure_ascii=False, indent=1))

    def read_json(self, path: str):
        return json.loads(self.read_text(path))


MANIFEST = "_manifest.json"


def save_table(df: DataFrame, path: str, partition_cols: Sequence[str] = (), declared: Sequence[Sequence[str]] = (), fingerprint: str = "", fmt: str = "parquet", rows_per_file: int | None = None) -> None:
    """Write a table; only the partitions in it are replaced. The manifest names the partitions that are complete (also declared ones without rows) and the spec's fingerprint.

    Files are evened out by a rebalance hint, so their sizes follow the advisory partition size.
    """
    spark, files = df.sparkSession, Files(df.sparkSession)
    even = df.hint("rebalance", *partition_cols) if partition_cols else df.hint("rebalance")
    if rows_per_file is None:
        rows_per_file = max(1, (1 << 30) // max(1, estimated_row_bytes(df.schema)))
    writer = even.write.format(fmt).mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_cols) if partition_cols else writer).save(path)
    done = {tuple(d) for d in declared}
    if partition_cols:
        done |= {tuple(str(v) for v in r) for r in df.select(*partition_cols).distinct().collect()}
    else:
        done.add(())
    old = read_manifest(spark, path)
    if old and old["fingerprint"] == fingerprint:
        done |= set(map(tuple, old["partitions"]))
    files.write_json(f"{path}/{MANIFEST}", {"fingerprint": fingerprint, "partition_cols": list(partition_cols), "partitions": sorted(map(list, done))})


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    files = Files(spark)
    return files.read_json(f"{path}/{MANIFEST}") if files.exists(f"{path}/{MANIFEST}") else None


def missing_partitions(spark: SparkSession, path: str, values: Sequence[Sequence[str]], fingerprint: str = "") -> list[tuple[str, ...]]:
    """Of the wanted partitions those that are not complete under this fingerprint."""
    m = read_manifest(spark, path)
    done = set(map(tuple, m["partitions"])) if m and m["fingerprint"] == fingerprint else set()
    return [tuple(v) for v in values if tuple(v) not in done]


def compute_missing(spark: SparkSession, path: str, time_cols: Sequence[str], wanted: Sequence[Sequence[str]], compute, fingerprint: str = "") -> DataFrame:
    """The wanted partitions of a materialised table; ``compute(values)`` gives the missing ones, which are saved."""
    left = missing_partitions(spark, path, wanted, fingerprint)
    if left:
        save_table(compute(left), path, time_cols, left, fingerprint)
    return read_table(spark, path, partitions=(time_cols, wanted))


def file_counts(df: DataFrame, partition_cols: Sequence[str], file_bytes: int = 1 << 30, sizes: Mapping[str, int] | None = None) -> DataFrame:
    """Per partition: rows, estimated bytes from non-null counts and type sizes, files of at most ``file_bytes``, and the files before it."""
    from pyspark.sql.types import StructType

    own = [f for f in df.schema if f.name not in partition_cols]
    estimate = sum((F.count(f.name) * estimated_row_bytes(StructType([f]), sizes) for f in own), F.lit(0))
    per = df.groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("rows"), estimate.cast("long").alias("bytes"))
    sized = per.withColumn("files", F.greatest(F.lit(1), F.ceil(F.col("bytes") / file_bytes)).cast("long"))
    return sized.withColumn("files_before", (F.sum("files").over(Window.orderBy(*partition_cols)) - F.col("files")).cast("long"))  # a row per partition


def create_table(spark: SparkSession, name: str, df: DataFrame, partition_cols: Sequence[str] = (), types: Mapping[str, str] | None = None, comments: Mapping[str, str] | None = None, using: str = "parquet") -> str:
    """Create an empty table like ``df`` if there is none; returns the DDL."""
    types, comments = types or {}, comments or {}
    cols = [f"`{c}` {types.get(c, kind)}" + (f" COMMENT '{comments[c]}'" if c in comments else "") for c, kind in df.dtypes]
    ddl = f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(cols)}) USING {using}" + (f" PARTITIONED BY ({', '.join(partition_cols)})" if partition_cols else "")
    spark.sql(ddl)
    return ddl


def to_pandas(spark: SparkSession, path: str, cols: Sequence[str], max_rows: int = 10_000_000):
    """Columns of a table of bounded size on the driver."""
    df = spark.read.parquet(path).select(*cols)
    if (n := df.count()) > max_rows:
        raise ValueError(f"{n} rows; at most {max_rows} go to the driver")
    return df.toPandas()
