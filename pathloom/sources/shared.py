"""Intermediate tables of plans, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Mapping
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of this process only where that is unset on a local master."""
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


#: Whether Spark deletes a query's shuffle files when it ends. Nothing reads those of a table that has been written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Whether rows that are dealt by some of a join's keys move again, by all of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def written(df: DataFrame, label: str, settings: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """The table, written once and read from its files: what several branches of a plan read is computed once, and outlives any executor. Its shuffles go as soon as it is written. ``settings`` hold while it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plans/{label}-{uuid.uuid4().hex}"
    own = {CLEANUP: "true", **settings}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
