"""Feature vectors as named columns or arrays; scaling."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALES = ("raw", "norm", "std")


def assemble(slots: Sequence[str], name: str = "features") -> Column:
    """A struct of doubles: slots stay addressable, and filters on them reach the scan."""
    return F.struct(*[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in slots]).alias(name)


def as_array(struct: str, slots: Sequence[str]) -> Column:
    return F.array(*[F.col(f"{struct}.`{s}`") for s in slots]) if slots else F.array().cast("array<double>")


def scale(df: DataFrame, cols: Sequence[str], kinds: Sequence[str] = ("raw",), keep: Sequence[str] = ()) -> DataFrame:
    """``features_raw``, ``features_norm`` (to [0, 1]; a constant becomes 0.5) and ``features_std`` (by the sample deviation, not centred; a constant becomes 0), each an array; null is 0."""
    for k in kinds:
        if k not in SCALES:
            raise ValueError(f"unknown scale {k}")
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    stats = df.agg(*[f(value[c]).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_samp))]).first() if set(kinds) - {"raw"} else {}

    def scaled(kind: str, i: int, c: str) -> Column:
        if kind == "raw":
            return value[c]
        lo, hi, sd = (stats[f"{n}_{i}"] for n in ("lo", "hi", "sd"))
        if kind == "norm":
            return F.lit(0.5) if lo is None or hi == lo else (value[c] - lo) / (hi - lo)
        return F.lit(0.0) if not sd else value[c] / sd

    return df.select(*keep, *[F.array(*[scaled(k, i, c) for i, c in enumerate(cols)]).alias(f"features_{k}") for k in kinds])


def parse_vector(text: str) -> tuple[int, list[int], list[float]]:
    """(size, indices, values) of a sparse ``(n,[i..],[v..])`` or dense ``[v..]`` vector; anything else raises."""
    text = text.strip()
    if re.fullmatch(r"\(\d+,\s*\[[^\]]*\],\s*\[[^\]]*\]\)", text):
        n, index, values = ast.literal_eval(text)
        if len(index) != len(values) or any(not 0 <= i < n for i in index):
            raise ValueError(f"not a vector: {text}")
        return n, list(index), [float(v) for v in values]
    if re.fullmatch(r"\[[^\]]*\]", text):
        dense = [float(v) for v in ast.literal_eval(text)]
        return len(dense), list(range(len(dense))), dense
    raise ValueError(f"not a vector: {text}")


def merge_vectors(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def fill_null_vector(col: Column, length: int) -> Column:
    return F.coalesce(col, F.array_repeat(F.lit(0.0), length))


def left_join_vectors(left: DataFrame, right: DataFrame, keys: Sequence[str], lengths: dict[str, int]) -> DataFrame:
    """Left join in which vectors without a partner are zero."""
    joined = left.join(right, list(keys), "left")
    return joined.withColumns({c: fill_null_vector(F.col(c), n) for c, n in lengths.items()})
