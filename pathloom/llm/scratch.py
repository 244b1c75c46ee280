"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a table and reading it again: the files outlive any
executor. The folder is the session's ``spark.checkpoint.dir``; only on a local
master, where that is unset (tests), does this module set one of its own, which
goes when the process ends. A cluster without the setting is an error, as its
executors would write to disks of their own.

Tables that no returned plan reads are removed by ``remove``. The others hold
rows of a lazy result; they stay until ``cleanup`` is called for the session.
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        local = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/scratch/{label}-{uuid.uuid4().hex}"


def write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df``, return it as read from the files, and their path."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    return write(df, label)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no returned plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate tables; results that are not written yet can no longer be read."""
    remove(spark, f"{shared_dir(spark)}/scratch")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
