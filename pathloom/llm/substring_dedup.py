"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

A string of ``length`` bytes is repeated where it also starts earlier: in a row
with a smaller identifier, or in the same text. All bytes of such strings are
removed. A row is known by its identifier and, where identifiers repeat, by the
hash of its text, which also orders rows of one identifier.

Equal strings are brought together by their content. The string's anchor is its
GRAM-byte substring of least hash (the last of equals), so equal strings have
equal anchors at equal places. Successive starts with one anchor form a segment;
anchors that occur once in the corpus are dropped at once. Equal segments are
combined before anything is moved: all but the first are repeats throughout. Of
anchors with several different segments, each segment's first occurrence goes to
the anchor's task with its bytes. There a suffix array of the segments gives the
Burrows-Wheeler transform, and breadth-first backward extension derives the
suffixes' common prefixes by increasing value; it stops at ``length``, where the
intervals left are exactly the classes of equal strings.

An anchor with more than SEGMENTS different segments is dealt over several tasks
by a salt; there each class's first string is compared between the tasks by its
digest. Segments are compared by two 64-bit hashes.

Defined results: null text counts as empty; texts shorter than ``length`` stay
whole; rows with a null identifier stay whole and repeat nothing; rows with equal
identifiers and different texts come in the order of their texts' hashes; rows
with equal identifiers and texts are one place, so neither is earlier and both
are cut alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernel, scratch

GRAM = 24
SEGMENTS = 4096
#: Bytes of segments in one transform, besides the last anchor's; and of texts that are cut into segments at once: what fits a core's cache.
BLOCK_BYTES = CUT_BYTES = 1 << 18
SEPARATOR = 0xFF  # in no UTF-8 text
_U32 = np.uint64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h += words[k : k + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, number of starts, anchor hash, segment hash) of every segment."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    starts = len(data) - length + 1
    if starts <= 0:
        return none
    grams = gram_hashes(data)
    order = (grams & ~_U32) | (_U32 - np.arange(len(grams), dtype=np.uint64))
    anchor = (_U32 - (sliding_min(order, length - GRAM + 1) & _U32)).astype(np.int64)
    edge = np.zeros(len(data) + 2, np.int32)
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    valid = np.cumsum(edge)[:starts] == 0
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(first)
    if not len(lo):
        return none
    last = valid.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    count = np.flatnonzero(last) - lo + 1
    row = np.searchsorted(offsets, lo, side="right") - 1
    at = anchor[lo]
    whole = kernel.mix(kernel.range_hash(kernel.BYTE_VALUE[data], lo, lo + count + length - 1) + (at - lo).astype(np.uint64))
    return row, lo - offsets[row], count, grams[at], whole


def _sorted(key: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys below n * n in their order, and their ``at`` (below n)."""
    bits = int(n).bit_length()
    if 3 * bits > 64:
        order = np.argsort(key)
        return key[order], at[order]
    packed = (key << np.uint64(bits)) | at.astype(np.uint64)  # sorting values is several times as fast as sorting places
    packed.sort()
    return packed >> np.uint64(bits), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a circular text in the order of the strings of ``depth`` bytes or more from there.

    Prefix doubling; a place whose string differs from all others has its final rank and is not sorted again.
    """
    n = len(text)
    used = np.zeros(256, bool)
    used[text] = True
    width = max(1, int(used.sum() - 1).bit_length())
    have = max(1, min(8, 2 * (int(n).bit_length() - 1) // width))
    code = (np.cumsum(used) - 1)[text].astype(np.uint64)
    around = np.concatenate([code, np.resize(code, have)])
    key = np.zeros(n, np.uint64)
    for k in range(have):
        key = (key << np.uint64(width)) | around[k : k + n]
    at = slots = np.arange(n)
    sa, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    while True:
        key, at = _sorted(key, at, n)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        sa[slots] = at
        rank[at] = np.repeat(slots[first], np.diff(np.append(first, len(at))))
        tied = ~(new & np.append(new[1:], True))
        slots, at = slots[tied], at[tied]
        if have >= depth or not len(at):
            return sa
        key = (rank[at] * n + rank[(at + have) % n]).astype(np.uint64)
        have *= 2


def prefix_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and a mark where a suffix shares less than ``length`` bytes with the one before.

    Intervals of the strings of 0, 1, 2, ... bytes are extended backward by every
    byte that precedes them; a right bound that is new at length k separates
    suffixes with k - 1 common bytes.
    """
    n = len(text)
    sa = suffix_order(text, length + 1)
    bwt = text[sa - 1]
    by_byte = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int32)
    step[by_byte] = np.arange(n)
    same = bwt[by_byte][1:] == bwt[by_byte][:-1]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by_byte[1:][same]] = by_byte[:-1][same]
    after[by_byte[:-1][same]] = by_byte[1:][same]
    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    lo, hi = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(length):
        if not len(lo):
            break
        size = hi - lo
        alone = size == 1
        i1 = step[lo[alone]]
        lo, hi, size = lo[~alone], hi[~alone], size[~alone]
        end = np.cumsum(size, dtype=np.int32)
        at = np.arange(size.sum(), dtype=np.int32) + np.repeat(lo - (end - size), size)
        first, last = np.flatnonzero(before[at] < np.repeat(lo, size)), np.flatnonzero(after[at] >= np.repeat(hi, size))
        # by interval, then by byte
        i2 = (np.sort(np.searchsorted(end, first, side="right") * n + step[at[first]]) % n).astype(np.int32)
        j2 = (np.sort(np.searchsorted(end, last, side="right") * n + step[at[last]]) % n).astype(np.int32)
        lo, hi = np.concatenate([i1, i2]), np.concatenate([i1, j2]) + 1
        fresh = ~bound[hi]
        lo, hi = lo[fresh], hi[fresh]
        bound[hi] = True
    return sa, bound[:n]


def block_repeats(chunks: list[bytes], counts: np.ndarray, docs: np.ndarray, hashes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments in one block: places (segment, start) that repeat an earlier one, as two arrays; and a mark of classes' firsts as flat places."""
    text = np.frombuffer(b"\xff".join(chunks) + b"\xff", np.uint8)
    sizes = np.array([len(c) for c in chunks])
    begin = np.cumsum(sizes + 1) - sizes - 1
    sa, bound = prefix_classes(text, length)
    by_place = np.lexsort((starts, hashes, docs))
    rank = np.empty(len(chunks), np.int64)  # equal for segments of equal rows, of which neither is earlier
    rank[by_place] = np.cumsum(np.concatenate([[False], (np.diff(np.stack([docs, hashes, starts])[:, by_place], axis=1) != 0).any(axis=0)]))
    width = int(counts.max()) + 1
    nothing = np.iinfo(np.int64).max
    order = np.full(len(text), nothing)
    owner = np.repeat(np.arange(len(chunks)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = begin[owner] + inner
    order[place] = rank[owner] * width + inner
    least = np.minimum.reduceat(order[sa], np.flatnonzero(bound))[np.cumsum(bound) - 1]
    of = np.empty(len(text), np.int64)
    of[sa] = least
    later = order[place] > of[place]
    return owner, inner, later


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(schema: str, *cols) -> pa.RecordBatch:
    pairs = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, _ARROW[k]) for c, (_, k) in zip(cols, pairs, strict=True)], [n for n, _ in pairs])


_SEGMENT = "doc_id long, text_hash long, start int, count int, anchor long, segment long"
_SOURCE = "anchor long, salt int, salts int, doc_id long, text_hash long, start int, count int, piece binary"
_FOUND = "doc_id long, text_hash long, start int, count int, d1 long, d2 long"
_ROW = ["doc_id", "text_hash"]


def find_segments(own: DataFrame, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j, data, offsets in kernel.text_chunks(batch.column(2), CUT_BYTES):
                row, start, count, anchor, whole = segments(data, offsets, length)
                yield _batch(_SEGMENT, ids[i:j][row], hashes[i:j][row], start.astype(np.int32), count.astype(np.int32), kernel.signed(anchor), kernel.signed(whole))

    return own.where(F.octet_length("text") >= length).mapInArrow(cut, _SEGMENT)


def repeated_ranges(own: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, start, count): ranges of starts of strings that are repeats. ``own``: (doc_id, text_hash, text)."""
    found = find_segments(own.where("doc_id IS NOT NULL"), length)
    # from files, so that the join's sides are plain shuffles, whose large partitions Spark can split
    often = scratch.materialise(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    shared = scratch.materialise(found.join(often, "anchor", "left_semi"), "segments")
    place = F.struct(*_ROW, "start")
    distinct = scratch.materialise(
        shared.groupBy("anchor", "segment").agg(F.min(place).alias("at"), F.min("count").alias("count"), F.count(F.lit(1)).alias("n")).select("anchor", "segment", "at", "count", "n"), "distinct-segments"
    )
    many = distinct.where("n > 1").select("anchor", "segment", "at")
    copies = shared.join(many, ["anchor", "segment"]).where(~(place == F.col("at"))).select(*_ROW, "start", "count")
    mixed = scratch.materialise(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed-anchors")
    salts = F.ceil(F.col("kinds") / SEGMENTS).cast("int")
    sources = (
        distinct.join(mixed, "anchor")
        .select("anchor", F.pmod(F.col("segment"), salts.cast("long")).cast("int").alias("salt"), salts.alias("salts"), "at.doc_id", "at.text_hash", "at.start", "count")
        .groupBy(*_ROW)
        .agg(F.collect_list(F.struct("anchor", "salt", "salts", "start", "count")).alias("parts"))
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            parts = batch.column(3)
            for r, text in enumerate(batch.column(2).cast(pa.binary())):
                data, f = text.as_buffer(), parts[r].values
                anchor, salt, salts, start, count = (f.field(k) for k in range(5))
                cut = [bytes(memoryview(data)[s : s + c + length - 1]) for s, c in zip(start.to_pylist(), count.to_pylist(), strict=True)]
                yield _batch(_SOURCE, anchor, salt, salts, np.full(len(cut), ids[r]), np.full(len(cut), hashes[r]), start, count, pa.array(cut, pa.binary()))

    def solve(rows: list[list]) -> pa.RecordBatch:
        _, salts, docs, hashes, starts, counts, chunks = rows
        docs, hashes, starts, counts, salts = (np.array(x, np.int64) for x in (docs, hashes, starts, counts, salts))
        owner, inner, later = block_repeats(chunks, counts, docs, hashes, starts, length)
        edge = np.flatnonzero(later & np.concatenate([[True], ~later[:-1] | (owner[1:] != owner[:-1])]))
        stop = np.flatnonzero(later & np.concatenate([~later[1:] | (owner[1:] != owner[:-1]), [True]]))
        out = [docs[owner[edge]], hashes[owner[edge]], starts[owner[edge]] + inner[edge], stop - edge + 1, np.zeros(len(edge), np.int64), np.zeros(len(edge), np.int64)]
        kept = np.flatnonzero(~later & (salts[owner] > 1))
        if len(kept):  # firsts of a salted anchor: to be compared with those of its other tasks
            digest = [np.frombuffer(hashlib.blake2b(chunks[o][i : i + length], digest_size=16).digest(), np.int64) for o, i in zip(owner[kept].tolist(), inner[kept].tolist(), strict=True)]
            d = np.array(digest)
            out = [np.concatenate(x) for x in zip(out, (docs[owner[kept]], hashes[owner[kept]], starts[owner[kept]] + inner[kept], np.zeros(len(kept), np.int64), d[:, 0], d[:, 1]), strict=True)]
        return _batch(_FOUND, out[0], out[1], out[2].astype(np.int32), out[3].astype(np.int32), out[4], out[5])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(7)]
        size, last = 0, None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for anchor, salt, salts, doc, text_hash, start, count, piece in zip(*cols, strict=True):
                if (anchor, salt) != last and size > BLOCK_BYTES:
                    yield solve(held)
                    held, size = [[] for _ in range(7)], 0
                last = (anchor, salt)
                for x, v in zip(held, (anchor, salts, doc, text_hash, start, count, piece), strict=True):
                    x.append(v)
                size += len(piece)
        if size:
            yield solve(held)

    cut = own.join(sources.hint("shuffle_hash"), _ROW).select(*_ROW, "text", "parts").mapInArrow(pieces, _SOURCE)
    solved = scratch.materialise(cut.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(transform, _FOUND), "repeats")
    firsts = solved.where("count = 0")
    least = firsts.groupBy("d1", "d2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2", "at")
    across = firsts.join(least, ["d1", "d2"]).where(~(place == F.col("at"))).select(*_ROW, "start", F.lit(1).alias("count"))
    return copies.unionByName(solved.where("count > 0").select(*_ROW, "start", "count")).unionByName(across)


def substring_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row without its repeats: (doc_id, text, n_bytes, spans, n_removed, n_spans, kept_sha256, kept).

    ``spans``: removed byte ranges (start, end); ``kept``: the remaining bytes.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    width = scratch.partitions(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = own.where("doc_id IS NOT NULL").select("doc_id")
    unique = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    own = own.select("doc_id", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("text_hash"), "text")
    dealt = own.repartition(width, *_ROW)
    ranges = repeated_ranges(own, length).groupBy(*_ROW).agg(F.collect_list(F.struct("start", "count")).alias("ranges"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, removed, kept, digests, sizes = [], [], [], [], []
            ranges = batch.column(2)
            for r, text in enumerate(batch.column(1).cast(pa.binary())):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                sizes.append(len(data))
                found, left = [], data
                if ranges[r].is_valid:
                    f = ranges[r].values
                    start, count = f.field(0).to_numpy(), f.field(1).to_numpy()
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + count + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    cut = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    found = [{"start": a, "end": b} for a, b in cut.reshape(-1, 2).tolist()]
                    left = data[~gone]
                spans.append(found)
                removed.append(len(data) - len(left))
                raw = left.tobytes()
                kept.append(raw)
                digests.append(hashlib.sha256(raw).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "n_removed", "kept_sha256", "kept"]
            )

    out = "doc_id long, n_bytes long, spans array<struct<start: int, end: int>>, n_removed long, kept_sha256 string, kept binary"
    return dealt.join(ranges.hint("shuffle_hash"), _ROW, "left").select("doc_id", "text", "ranges").mapInArrow(apply, out).withColumn("n_spans", F.size("spans").cast("long"))
