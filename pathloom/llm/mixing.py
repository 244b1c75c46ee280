"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 60-bit hash. Words are summed by source and leading
hash bits; the running sum over the buckets finds the bucket in which a source's
budget ends, and only that bucket is summed again by its next bits. After the
last level one hash threshold per source decides: a filter, without sorting.
Budgets nest: a larger budget takes the same documents and more.

Defined results: null text has no words; a null source is one source, last in
order; documents without words are taken zero words; a source without words has
target 0; the hash is of the identifier alone, so rows of one identifier are taken
or left together; a row without identifier has the hash of its text, so equal texts
without identifier go together (null as the empty text) and others apart; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
HEX_DIGITS = 15
#: Sources whose totals the driver reads; more than that is refused.
MAX_SOURCES = 100_000


def hash60(doc_id: Column, text: Column, salt: str) -> Column:
    of = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text|"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), of)), 1, HEX_DIGITS), 16, 10).cast("long")


def targets(sizes: dict[str | None, int], weights: list[float], share: float, limit: float) -> dict[str | None, float]:
    """Target of each source: ``share`` of all words by weight, none above ``limit`` times its size; what is above is shared again by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    top = {s: Fraction(limit) * sizes[s] for s in order}
    free, out, rest = list(order), {}, Fraction(share) * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] > top[s] * total]
        if not over:
            out |= {s: rest * weight[s] / total for s in free}
            break
        out |= {s: top[s] for s in over}
        rest -= sum(top[s] for s in over)
        free = [s for s in free if s not in out]
    return {s: float(out[s]) for s in order}


def thresholds(sized: DataFrame, budget: dict[str | None, float], level_bits: int = 12) -> dict[str | None, int]:
    """Per source the largest hash (exclusive) whose documents come nearest to its budget; refines only boundary buckets."""
    bits = 4 * HEX_DIGITS
    spark = sized.sparkSession
    state = {s: (0, 0.0) for s in budget}  # prefix of the boundary bucket, words taken below it
    done: dict[str | None, int] = {s: 0 for s, b in budget.items() if b <= 0}
    shift = bits
    while len(done) < len(budget):
        shift -= level_bits
        last = shift <= 0
        shift = max(0, shift)
        open_ = [(s, state[s][0]) for s in budget if s not in done]
        width = bits if shift == bits - level_bits else shift + level_bits
        frame = spark.createDataFrame(open_, T.StructType([T.StructField("source", T.StringType()), T.StructField("prefix", T.LongType())]))
        rows = (
            sized.join(F.broadcast(frame), sized["source"].eqNullSafe(frame["source"]) & (F.shiftright(sized["hash"], width) == frame["prefix"]))
            .groupBy(frame["source"].alias("source"), F.shiftright(sized["hash"], shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
            .collect()
        )
        by: dict[str | None, list[tuple[int, int, int]]] = {s: [] for s, _ in open_}
        for r in rows:
            by[r["source"]].append((r["bucket"], r["words"], r["docs"]))
        for s, found in by.items():
            below, cut = state[s][1], None
            for bucket, words, n in sorted(found):
                if below + words > budget[s]:
                    cut = (bucket, words, n)
                    break
                below += words
            if cut is None:
                done[s] = (state[s][0] + 1) << width if width < bits else 1 << bits
            elif cut[2] == 1 or last:  # one document (or one hash): take it if that comes nearer
                done[s] = (cut[0] + (below + cut[1] / 2 <= budget[s])) << shift
            else:
                state[s] = (cut[0], below)
    return done


def mix_sources(
    docs: DataFrame, weights: list[float], share: float = 1.5, limit: float = 2.0, salt: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", level_bits: int = 12
) -> DataFrame:
    """Every row with what the mix takes of it: (doc_id, source, size, source_size, target, copies, taken).

    ``copies`` whole copies of a document are taken: the whole part of
    target / source size for all of a source, one more for those whose hash is
    below the source's threshold.
    """
    spark = docs.sparkSession
    sized = scratch.materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            hash60(F.col(id_col).cast("long"), F.col(text_col), salt).alias("hash"),
        ),
        "sizes",
    )
    totals = {r["source"]: r["words"] for r in sized.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    target = targets(totals, weights, share, limit)
    whole = {s: int(target[s] // n) if (n := totals[s]) else 0 for s in totals}
    level_bits = max(1, min(level_bits, 18 - len(totals).bit_length()))  # the driver reads 2**18 sums a level at most
    cut = thresholds(sized, {s: target[s] - whole[s] * totals[s] for s in totals}, level_bits)
    kind = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("whole", T.IntegerType()), ("cut", T.LongType()))])
    plan = spark.createDataFrame([(s, totals[s], target[s], whole[s], cut[s]) for s in totals], kind)
    copies = F.col("whole") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)
    return (
        sized.alias("d")
        .join(F.broadcast(plan).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("doc_id", "d.source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
    )
