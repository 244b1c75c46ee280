"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over a few successive words ignore some positions, so a substituted
word there does not change the hash. The masks' hashes (seeds) of the benchmark
items are joined with those of all documents; around each hit, item and document
are laid along the hit's diagonal and the overlap is verified: some ``window``
words in a row (the whole item, if it is shorter) with a share of ``min_share``
equal.

Both sides of the join are shuffled by seed. Before that a Bloom filter of the
benchmark's seeds, of at most ``max_filter_bytes``, leaves out the documents'
seeds that no item has; a benchmark of any size takes one pass over the seeds,
and a filter that is too small for it only lets more of them through. A run of
one seed at successive places is one row, and two runs meet in a range of
diagonals, so repeated words on both sides do not multiply. Only texts with a
hit go on, each different text once, to the task that verifies them; only rows
whose text overlaps are joined with the result, the others stay where they are.

Words are runs of letters, digits and bytes from 128, lower-cased (A-Z and À-Þ),
so punctuation and case do not matter. In scripts without spaces (Han, kana,
Thai, Lao, Burmese, Khmer) every letter is a word, and ideographic and full-width punctuation is
left out; hangul has spaces.

The masks find any two substitutions in 13 words. Where the overlap to verify is
shorter, or ``min_share`` admits more, the seeds are plain runs of words instead: with k
substitutions admitted, one of k + 1 equal parts of the overlap is whole. Items
of fewer than ``exact_below`` words are searched for verbatim, each by the hash
of the whole item.

Defined results: null and empty texts and items overlap with nothing; items of
fewer than ``min_item`` words are not searched for (1: all are); equal items are
reported each, in the order of their identifiers, one without an identifier with
a null; rows with equal texts get equal results; an empty table gives an empty
result, an empty benchmark clean documents; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernel, scratch
from pathloom.llm.toxicity import fold_case

#: 1: the word counts, 0: it is ignored. Any two substitutions in 13 words leave one of them whole somewhere.
MASKS = ("111111", "11101011", "110110101", "1101001011", "10110010011")
_GAP = np.ones(256, bool)
_GAP[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False
#: Bits of the filters per key, and places that a key sets.
FILTER_SHARE, FILTER_PLACES = 24, 3
#: Words of a plain run at most, as ``seed_hashes`` has values for.
MAX_RUN = 40


#: Code points from, to before: letters of scripts without spaces; punctuation among them.
_UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3008), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x40000))
_MARKS = ((0x3000, 0x3005), (0x3008, 0x3021), (0x3030, 0x3031), (0xFF01, 0xFF10), (0xFF1A, 0xFF21), (0xFF3B, 0xFF41), (0xFF5B, 0xFF66))


def _within(points: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    out = np.zeros(len(points), bool)
    for a, b in ranges:
        out |= (points >= a) & (points < b)
    return out


def _unspaced(low: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Where a word starts inside of a run, as a letter of an unspaced script starts or ends there; their punctuation becomes ``gap``."""
    cuts = []
    for first, last, size in ((0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
        at = np.flatnonzero((low >= first) & (low < last))
        at = at[at + size <= len(low)]
        points = (low[at] & (0x0F if size == 3 else 0x07)).astype(np.int64)
        for j in range(1, size):
            points = points << 6 | (low[at + j] & 0x3F)
        marks = at[_within(points, _MARKS)]
        for j in range(size):
            gap[marks + j] = True
        letters = at[_within(points, _UNSPACED)]
        cuts += [letters, letters + size]
    return np.unique(np.concatenate(cuts))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = fold_case(data)
    gap = _GAP[low]
    cuts = _unspaced(low, gap) if len(low) and low.max() >= 0xE0 else np.zeros(0, np.int64)
    starts, ends, rows = kernel.word_bounds(gap, offsets)
    if len(cuts) and len(starts):
        run = np.searchsorted(starts, cuts, side="right") - 1
        cuts = cuts[(run >= 0) & (cuts > starts[run]) & (cuts < ends[run])]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        rows = np.searchsorted(starts, offsets)
    return kernel.range_hash(kernel.BYTE_VALUE[low], starts, ends), rows


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash under the mask at every start; start i covers tokens[i : i + len(mask)]."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(int(mask, 2)))
    for j, bit in enumerate(mask):
        if bit == "1":
            h += tokens[j : j + n] * kernel.SHINGLE_VALUE[16 + j]
    return kernel.mix(h)


def least_equal(size: int, min_share: float) -> int:
    """The fewest equal words of ``size`` that are a share of ``min_share``, as ``verify`` compares."""
    return next((n for n in range(size + 1) if n >= min_share * size), size + 1)


def plan_seeds(n: int, window: int, min_share: float) -> tuple[tuple[str, ...], np.ndarray | None]:
    """Masks and starts (None: all) of the seeds of an item of ``n`` words, so that every overlap that verifies has a whole one."""
    size = min(window, n)
    missing = size - least_equal(size, min_share)
    if missing < 3 * (size // 13):  # 13 words of the overlap have two substitutions at most
        return MASKS, None
    run = min(size // (missing + 1), MAX_RUN)
    if run < 1:
        raise ValueError("a share that small admits overlaps without an equal word")
    return ("1" * run,), None if n > size else np.arange(missing + 1) * run


def item_share(n: int, min_share: float, exact_below: int) -> float:
    """Share of equal words that an overlap with an item of ``n`` words needs."""
    return 1.0 if n < exact_below else min_share


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return first, np.diff(np.append(first, len(values)))


def verify(tokens: np.ndarray, own: np.ndarray, diagonal: int, window: int, min_share: float) -> tuple[int, int, float]:
    """Start, end and share of equal words of the best window of the overlap along a diagonal (word i of the text on word i - diagonal of the item), or share 0."""
    lo, hi = max(0, diagonal), min(len(tokens), diagonal + len(own))
    size = min(window, len(own))
    if hi - lo < size:
        return lo, hi, 0.0
    same = tokens[lo:hi] == own[lo - diagonal : hi - diagonal]
    total = np.concatenate([[0], np.cumsum(same)])
    counts = total[size:] - total[:-size]
    good = np.flatnonzero(counts >= min_share * size)
    if not len(good):
        return lo, hi, 0.0
    return lo + int(good[0]), lo + int(good[-1]) + size, float(counts.max() / size)


def best_overlap(tokens: np.ndarray, own: np.ndarray, diagonals: list[tuple[int, int]], window: int, min_share: float) -> tuple[int, int, float]:
    """The best overlap over ranges of diagonals, the first of equals."""
    best, done = (0, 0, 0.0), None
    for first, last in sorted(diagonals):
        for d in range(first if done is None else max(first, done + 1), last + 1):
            got = verify(tokens, own, d, window, min_share)
            if got[2] > best[2]:
                best = got
                if best[2] == 1.0:
                    return best
        done = last if done is None else max(done, last)
    return best


def item_seeds(benchmark: DataFrame, window: int, min_share: float, min_item: int, exact_below: int) -> DataFrame:
    """(item, item_id, mask, seed, first, times, tokens): runs of an item's seeds; its words once, in a row without a seed."""
    schema = "item long, item_id long, mask string, seed long, first int, times int, tokens binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, ident, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                tokens = words(data, np.array([0, len(data)]))[0]
                if len(tokens) < max(1, min_item):
                    continue
                rows.append((item, ident, None, None, None, None, tokens.tobytes()))
                masks, starts = plan_seeds(len(tokens), window, item_share(len(tokens), min_share, exact_below))
                for mask in masks:
                    h = seed_hashes(tokens, mask)
                    if starts is None:
                        first, times = runs(h)
                    else:
                        first, times = starts, np.ones(len(starts), np.int64)
                    rows += [(item, None, mask, s, a, n, None) for s, a, n in zip(kernel.signed(h[first]).tolist(), first.tolist(), times.tolist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return benchmark.mapInArrow(cut, schema)


class KeyFilter:
    """Bloom filter of a column of 64-bit hashes: its words are combined by Spark, so the driver holds it alone."""

    def __init__(self, keys: DataFrame, column: str, max_bytes: int):
        n = keys.count()
        bits = max(16, min(int(max_bytes * 8).bit_length() - 1, int(n * FILTER_SHARE).bit_length()))
        self.shift = 64 - bits
        self.skips = [self.shift * k // (FILTER_PLACES - 1) for k in range(FILTER_PLACES)]  # places are bits of the hash, from its head to its end
        places = [F.shiftrightunsigned(F.shiftleft(F.col(column), k), self.shift) for k in self.skips]
        place = keys.select(F.explode(F.array(*places)).alias("p"))
        words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()
        self.words = np.zeros(1 << max(0, bits - 6), np.uint64)
        self.words[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for k in self.skips:
            p = (h << np.uint64(k)) >> np.uint64(self.shift)
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
        return out


_KEY = ["k1", "k2"]


def _text_key(text: Column) -> list[Column]:
    """128-bit hash of a text: equal texts have equal results."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def document_seeds(docs: DataFrame, masks: list[str], seeds: KeyFilter) -> DataFrame:
    """(k1, k2, mask, seed, first, times): runs of the seeds of (k1, k2, text) that the filter lets through. ``mask`` is its number."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)
    names = "k1 k2 mask seed first times".split()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, _, data, offsets in kernel.text_chunks(batch.column(2)):
                tokens, rows = words(data, offsets)
                for number, mask in enumerate(masks):
                    h = seed_hashes(tokens, mask)
                    at = np.flatnonzero(known.may_hold(h))
                    row = np.searchsorted(rows, at, side="right") - 1
                    whole = at + len(mask) <= rows[row + 1]  # a seed lies in one text
                    at, row = at[whole], row[whole]
                    if not len(at):
                        continue
                    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (h[at[1:]] != h[at[:-1]])]))
                    times = np.diff(np.append(new, len(at)))
                    at, row = at[new], row[new]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[i + row]), pa.array(k2[i + row]), pa.array(np.full(len(at), number, np.int16)), pa.array(kernel.signed(h[at])), pa.array((at - rows[row]).astype(np.int32)), pa.array(times.astype(np.int32))], names
                    )

    return docs.select(*_KEY, "text").mapInArrow(cut, "k1 long, k2 long, mask short, seed long, first int, times int")


_SPANS = "array<struct<item_id: long, first_word: int, end_word: int, share: double>>"


def overlaps(texts: DataFrame, hits: DataFrame, window: int, min_share: float, exact_below: int) -> DataFrame:
    """(k1, k2, overlaps) of different texts (k1, k2, text) with hits (k1, k2, item_id, item, tokens, ranges); one text's words are held at a time."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens, found = None, np.zeros(0, np.uint64), []

        def result() -> Iterator[pa.RecordBatch]:
            if found:
                rows = [{"item_id": i, "first_word": a, "end_word": b, "share": s} for _, i, a, b, s in sorted(found, key=lambda x: (x[1] is None, x[1] or 0, x[0]))]
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([rows], kind)], [*_KEY, "overlaps"])

        for batch in batches:
            text, own = batch.column(4), batch.column(5)
            for r, (k1, k2, item, ident, ranges) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 6)), strict=True)):
                if (k1, k2) != last:
                    yield from result()
                    last, tokens, found = (k1, k2), np.zeros(0, np.uint64), []
                if item is None:  # the text itself comes first
                    data = np.frombuffer(text[r].as_py().encode(), np.uint8)
                    tokens = words(data, np.array([0, len(data)]))[0]
                    continue
                other = np.frombuffer(own[r].as_buffer(), np.uint64)
                a, b, share = best_overlap(tokens, other, [(x["a"], x["b"]) for x in ranges], window, item_share(len(other), min_share, exact_below))
                if share:
                    found.append((item, ident, a, b, share))
        yield from result()

    none = lambda k: F.lit(None).cast(k)
    kinds = "array<struct<a: int, b: int>>"
    left = texts.select(*_KEY, none("long").alias("item"), none("long").alias("item_id"), "text", none("binary").alias("tokens"), none(kinds).alias("ranges"))
    right = hits.select(*_KEY, "item", "item_id", none("string").alias("text"), "tokens", F.col("ranges").cast(kinds).alias("ranges"))
    return left.unionByName(right).repartition(*_KEY).sortWithinPartitions(*_KEY, F.col("item").asc_nulls_first()).mapInArrow(check, f"k1 long, k2 long, overlaps {_SPANS}")


def find_overlaps(own: DataFrame, benchmark: DataFrame, window: int, min_share: float, min_item: int, exact_below: int, max_filter_bytes: int) -> DataFrame | None:
    """(k1, k2, overlaps) of the texts of ``own`` (k1, k2, text) that have any; None where no item has words."""
    spark = own.sparkSession
    numbered = scratch.materialise(benchmark.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", "text"), "benchmark")
    cut = scratch.materialise(item_seeds(numbered, window, min_share, min_item, exact_below), "item-seeds")
    seeds, items = cut.where("seed IS NOT NULL"), cut.where("seed IS NULL").select("item", "item_id", "tokens")
    masks = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())  # as many as MASKS, and runs of 1 to MAX_RUN words
    if not masks:
        return None
    number = F.array_position(F.array(*[F.lit(m) for m in masks]), F.col("mask")) - 1
    theirs = seeds.select(number.cast("short").alias("mask"), "seed", "item", F.col("first").alias("item_first"), F.col("times").alias("item_times"))
    ours, ours_path = scratch.write(document_seeds(own, masks, KeyFilter(seeds, "seed", max_filter_bytes)), "document-seeds")
    # a run of n places on a run of m places: diagonals from the first on the last to the last on the first
    a, b = F.col("first") - F.col("item_first") - F.col("item_times") + 1, F.col("first") + F.col("times") - 1 - F.col("item_first")
    met = ours.join(theirs, ["mask", "seed"]).select(*_KEY, "item", a.cast("int").alias("a"), b.cast("int").alias("b"))
    hits = scratch.materialise(met.groupBy(*_KEY, "item").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "hits")
    scratch.remove(spark, ours_path)
    texts = may_be_in(own, hits, max_filter_bytes).groupBy(*_KEY).agg(F.first("text").alias("text")).join(hits.select(*_KEY).distinct(), _KEY, "left_semi")
    return scratch.materialise(overlaps(texts, hits.join(items, "item"), window, min_share, exact_below), "overlaps")


def may_be_in(rows: DataFrame, keys: DataFrame, max_filter_bytes: int, inside: bool = True) -> DataFrame:
    """Rows whose key the filter of ``keys`` lets through (or does not); only their hash goes to Python."""
    shared = rows.sparkSession.sparkContext.broadcast(KeyFilter(keys.select("k1").distinct(), "k1", max_filter_bytes))

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.may_hold(h.to_numpy(np.int64).view(np.uint64)) == inside)

    return rows.where(held("k1"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: float = 0.8, min_item: int = 1, exact_below: int = 6, max_filter_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Every row with its overlaps: (doc_id, *keep, overlaps, n_items, contaminated).

    ``overlaps`` has per benchmark item the best one: the words of the document
    from ``first_word`` to before ``end_word``, and the share of equal words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    found = find_overlaps(docs.select(*_text_key(text), text.alias("text")), items, window, min_share, min_item, exact_below, max_filter_bytes)
    # an own struct for what is kept, so that no name of it can clash
    own = docs.select(*_text_key(text), F.struct(F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep]).alias("own"))
    if found is None:
        done = own.select("own", F.array().cast(_SPANS).alias("overlaps"))
    else:
        clean = may_be_in(own, found, 16 << 20, inside=False).select("own", F.array().cast(_SPANS).alias("overlaps"))
        dirty = may_be_in(own, found, 16 << 20).join(found, _KEY, "left").select("own", F.coalesce("overlaps", F.array().cast(_SPANS)).alias("overlaps"))
        done = clean.unionByName(dirty)
    return done.select("own.doc_id", *[F.col("own")[c].alias(c) for c in keep], "overlaps", F.size("overlaps").alias("n_items"), (F.size("overlaps") > 0).alias("contaminated"))
