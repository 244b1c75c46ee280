"""Projections, filters and column utilities."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.naming import presence_col

#: Identifiers that count as missing.
INVALID_IDS = ("", "NaN", "___")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Estimated bytes of a value.
TYPE_BYTES = {"int": 4, "bigint": 8, "double": 8, "float": 4, "string": 50, "boolean": 1, "vector": 300, "array": 300}
DEFAULT_BYTES = 100


def aliased(pairs: Sequence[tuple[str, str]]) -> list[Column]:
    return [F.col(c).alias(a) for c, a in pairs]


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def sanitized(name: str) -> str:
    """Characters other than letters, digits, _ and CJK ideographs become _."""
    return re.sub(r"[^一-龥A-Za-z0-9_]", "_", name)


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(sanitized(c) for c in df.columns))


def valid_ids(cols: Sequence[str], invalid: Sequence[str] = INVALID_IDS) -> Column:
    """Every column is present and no placeholder."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.col(c).cast("string").isin(*invalid) for c in cols), F.lit(True))


def in_partitions(cols: Sequence[str], values: Sequence[Sequence[str]]) -> Column:
    """The columns are one of the tuples; static, so partitions are pruned."""
    if len(cols) == 1:
        return F.col(cols[0]).isin(*(v[0] for v in values))
    each = [reduce(lambda a, b: a & b, (F.col(c) == v for c, v in zip(cols, row, strict=True))) for row in values]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def presence_marks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({presence_col(c): F.when(F.col(c).isNull(), 0).otherwise(1) for c in cols})


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, list(cols) if cols is not None else None)


def one_hot(col: str, values: Sequence[str], prefix: str = "") -> list[Column]:
    return [F.when(F.col(col) == v, 1).otherwise(0).alias(f"{prefix}{v}") for v in values]


def ensure_numeric(df: DataFrame, cols: Sequence[str], missing: float = -1.0) -> DataFrame:
    """Columns as numbers; what is none, or null, becomes ``missing``."""
    kinds = {f.name: f.dataType for f in df.schema}
    own = {c: F.coalesce(F.col(c) if isinstance(kinds[c], NUMERIC) else F.col(c).try_cast("float"), F.lit(missing)) for c in cols}
    return df.withColumns(own)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def estimated_row_bytes(schema: T.StructType, sizes: Mapping[str, int] | None = None) -> int:
    sizes = sizes or {}
    of = lambda f: sizes[f.name] * 4 if f.name in sizes else TYPE_BYTES.get(re.split(r"[<(]", f.dataType.simpleString())[0], DEFAULT_BYTES)
    return sum(of(f) for f in schema)


def estimated_partitions(df: DataFrame, rows: int, target_bytes: int = 128 << 20) -> int:
    return max(1, -(-rows * estimated_row_bytes(df.schema) // target_bytes))
