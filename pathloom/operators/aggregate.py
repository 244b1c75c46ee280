"""Grouped aggregates, pivots, collected rows and table profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.sampling import running_totals

SCALAR = ("count", "mean", "sum", "max", "min", "first")
VECTOR = ("mean", "sum", "variance", "std", "count", "numNonzeros", "max", "min", "normL2", "normL1")


def scalar(func: str, col: str, when: Column | None = None) -> Column:
    """An aggregate of a column, over the rows that meet ``when``. ``first`` is the least value, so that it does not depend on order."""
    if func not in SCALAR:
        raise ValueError(f"unknown aggregate {func}")
    if col == "*":
        if func != "count":
            raise ValueError("* can only be counted")
        return F.count(F.lit(1) if when is None else F.when(when, 1))
    value = F.col(col) if when is None else F.when(when, F.col(col))
    return {"count": F.count, "mean": F.mean, "sum": F.sum, "max": F.max, "min": F.min, "first": F.min}[func](value)


def aggregate(df: DataFrame, group: Sequence[str], aggs: Sequence[tuple[str, str, str]], pivot: str | None = None, values: Sequence | None = None) -> DataFrame:
    """``aggs``: (column, function, alias). With ``pivot``, one column <value>_<alias> per pivot value, by conditional aggregates; missing cells of counts are 0, others null."""
    if pivot is None:
        return df.groupBy(*group).agg(*[scalar(f, c).alias(a) for c, f, a in aggs])
    if values is None:
        values = [r[0] for r in df.select(pivot).where(F.col(pivot).isNotNull()).distinct().orderBy(pivot).limit(10_001).collect()]
        if len(values) > 10_000:
            raise ValueError(f"{pivot} has more than 10000 values")
    return df.groupBy(*[g for g in group if g != pivot]).agg(*[scalar(f, c, F.col(pivot) == F.lit(v)).alias(f"{v}_{a}") for v in values for c, f, a in aggs])


def slot(func: str, value: Column) -> Column:
    """A vector statistic of one slot."""
    if func not in VECTOR:
        raise ValueError(f"unknown vector aggregate {func}")
    return {
        "mean": lambda: F.avg(value), "sum": lambda: F.sum(value), "variance": lambda: F.coalesce(F.var_samp(value), F.when(F.count(value) > 0, 0.0)), "std": lambda: F.coalesce(F.stddev_samp(value), F.when(F.count(value) > 0, 0.0)),
        "count": lambda: F.count(value), "numNonzeros": lambda: F.count(F.when(value != 0, 1)), "max": lambda: F.max(value), "min": lambda: F.min(value),
        "normL2": lambda: F.sqrt(F.sum(value * value)), "normL1": lambda: F.sum(F.abs(value)),
    }[func]()


def vector_aggregate(df: DataFrame, group: Sequence[str], slots: Sequence[str], funcs: Sequence[str], pivot: str | None = None, values: Sequence = ()) -> DataFrame:
    """Statistics of each slot: columns <func>_<slot>, or <value>_<func>_<slot>. One sample's variance is 0."""
    if pivot is not None and not values:
        raise ValueError("a vector pivot needs its values")
    cells = [(f"{v}_", F.col(pivot) == F.lit(v)) for v in values] if pivot is not None else [("", F.lit(True))]
    own = [slot(f, F.when(c, F.col(s).cast("double"))).alias(f"{p}{f}_{s}") for p, c in cells for f in funcs for s in slots]
    return df.groupBy(*group).agg(*own)


def collect_rows(df: DataFrame, group: Sequence[str], cols: Sequence[str], name: str, pivot: str | None = None, values: Sequence = ()) -> DataFrame:
    """Rows of a group as a sorted array of structs, so that values stay aligned and nulls are kept. Cap groups first where they can be large."""
    row = F.struct(*cols)
    if pivot is None:
        return df.groupBy(*group).agg(F.sort_array(F.collect_list(row)).alias(name))
    return df.groupBy(*group).agg(*[F.sort_array(F.collect_list(F.when(F.col(pivot) == F.lit(v), row))).alias(f"{v}_{name}") for v in values])


def pivot_counts(df: DataFrame, id_cols: Sequence[str], col: str, values: Sequence[str]) -> DataFrame:
    """Counts <col>_<value> per id; other values, and null, count as Extra."""
    known = F.col(col).isin(*values)
    extra = F.count(F.when(known.isNull() | ~known, 1)).alias(f"{col}_Extra")
    return df.groupBy(*id_cols).agg(*[F.count(F.when(F.col(col) == v, 1)).alias(f"{col}_{v}") for v in values], extra)


def uniform_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: least, greatest, and whether they are equal."""
    both = df.agg(*[F.min(c).cast("string").alias(f"lo_{i}") for i, c in enumerate(cols)], *[F.max(c).cast("string").alias(f"hi_{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{i}").alias("least"), F.col(f"hi_{i}").alias("greatest")) for i, c in enumerate(cols)])
    return both.select(F.explode(rows).alias("r")).select("r.*", F.col("r.least").eqNullSafe(F.col("r.greatest")).alias("uniform"))


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent values, with the number of distinct values."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
    distinct = counts.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return counts.orderBy(F.desc("rows"), F.asc_nulls_first(col)).limit(n).withColumn("distinct_values", F.lit(distinct).cast("long"))


def quantiles(df: DataFrame, col: str, bins: int) -> list:
    """The values of rank ceil(i / bins * rows) for i from 0 to ``bins``, exactly; null values do not count, and without others the list is empty.

    Rows are counted per value, and ranks are running totals of the counts.
    """
    per = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    rows = per.agg(F.sum("n").alias("n")).first()["n"]
    if not rows:
        return []
    ranks = [max(1, -(-i * rows // bins)) for i in range(bins + 1)]  # integers, so that no rank is rounded
    met = F.exists(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (F.col("n_before") < r) & (r <= F.col("n_before") + F.col("n")))
    found = sorted((r["n_before"], r[col]) for r in running_totals(per, col, ["n"]).where(met).select("n_before", col).collect())
    return [[v for before, v in found if before < rank][-1] for rank in ranks]


def quantile_histogram(df: DataFrame, col: str, bins: int, accuracy: int = 10_000) -> DataFrame:
    """Rows per quantile bin (bin, lower, upper, rows); bins are half-open but for the last, which has the maximum. Bounds are exact quantiles, whatever the ``accuracy`` that callers still give."""
    edges = quantiles(df, col, bins)
    if not edges:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, rows long")
    edges = sorted({float(e) for e in edges})
    if len(edges) == 1:
        edges *= 2
    inner = F.array(*map(F.lit, edges[1:-1])) if len(edges) > 2 else F.array().cast("array<double>")
    number = F.size(F.filter(inner, lambda e: e <= F.col(col)))
    at = lambda k: F.element_at(F.array(*map(F.lit, edges)), F.col("bin") + k)
    return df.where(F.col(col).isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("rows")).select("bin", at(1).alias("lower"), at(2).alias("upper"), "rows")


def table_quality(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows, keys that occur more than once, and features with one value only. An empty table raises."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.min(f).alias(f"_lo_{f}") for f in features], *[F.max(f).alias(f"_hi_{f}") for f in features])
    constant = lambda f: F.min(f"_lo_{f}").eqNullSafe(F.max(f"_hi_{f}"))
    out = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"), F.count(F.when(F.col("_n") > 1, 1)).alias("duplicate_keys"),
        F.array_join(F.filter(F.array(*[F.when(constant(f), F.lit(f)) for f in features], F.lit(None).cast("string")), lambda x: x.isNotNull()), ",").alias("constant_features"),
    )
    return out.withColumn("rows", F.when(F.col("rows") == 0, F.raise_error(F.lit("the table is empty")).cast("long")).otherwise(F.col("rows")))


def validate_tables(tables: Sequence[tuple[str, DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """(table, period, rows, duplicate_keys) per table and partition; ``tables``: (name, frame, keys, partition columns). Keys are counted once, then partitions."""
    parts = []
    for name, df, keys, times in tables:
        period = F.concat_ws("|", *[F.col(t).cast("string") for t in times]) if times else F.lit("")
        per_key = df.withColumn("_period", period).groupBy("_period", *[k for k in keys if k not in times]).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(per_key.groupBy(F.lit(name).alias("table"), F.col("_period").alias("period")).agg(F.sum("_n").alias("rows"), F.count(F.when(F.col("_n") > 1, 1)).alias("duplicate_keys")))
    return reduce(DataFrame.unionByName, parts)


def group_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows"))
