"""Keeping windowed features up to date from a stream: each micro-batch recomputes the graph times that it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathloom.functions.timeutil import WindowGroup, parse, render, shift
from pathloom.sources.tables import save_table


def touched_times(periods: Sequence[Sequence[str]], source_formats: Sequence[str], graph_formats: Sequence[str], groups: Sequence[WindowGroup], known: Sequence[Sequence[str]]) -> list[tuple[str, ...]]:
    """Of the known graph times those with a window that holds one of the periods."""
    wanted, changed = {tuple(k) for k in known}, {tuple(p) for p in periods}
    out = []
    for t in sorted(wanted):
        when: datetime = parse(t, graph_formats)
        near = (render(shift(when, i, w.unit), source_formats) for g in groups for w in g.windows for i in range(w.start, w.start + w.length))
        if any(n in changed for n in near):
            out.append(t)
    return out


def maintain(stream: DataFrame, archive: str, result: str, time_cols: Sequence[str], source_formats: Sequence[str], graph_times: Sequence[str], graph_formats: Sequence[str], groups: Sequence[WindowGroup], known: Sequence[Sequence[str]], compute: Callable[[DataFrame, list[tuple[str, ...]]], DataFrame], checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to ``archive`` (once per batch: a batch has its own directory) and rewrite the touched graph times of ``result``."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{archive}/batch={number}")
        periods = [tuple(r) for r in rows.select(*time_cols).distinct().collect()]
        times = touched_times(periods, source_formats, graph_formats, groups, known)
        if times:
            save_table(compute(spark.read.schema(rows.schema).parquet(archive), times), result, graph_times, times)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, time: str, by: Sequence[str], watermark: str = "1 day") -> DataFrame:
    """Rows and value sums per tumbling day; late rows beyond the watermark are left out by Spark."""
    return events.withWatermark(time, watermark).groupBy(F.window(time, "1 day"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
