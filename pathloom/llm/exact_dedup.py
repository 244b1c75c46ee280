"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition sorts its digests and packs them into a run: blocks of
records in rising order, equal digests combined into one record with their count
and the identifier to retain. Runs are merged in rounds of a ``fan_in``-nomial
tree: ``fan_in`` neighbouring runs meet, and a streaming multiway merge combines
their equal records again and writes the run of the next round. Blocks arrive by
their first digest, so whatever is below the newest block's first digest is
final; a task holds one open block per run, however long the runs are. A group
of copies of any size is at most one record per run. Runs are cut into as many
digest ranges as keep a round parallel when few runs are left.

A record's key is the digest, a second, independent hash and the length of the
text; every merge compares all of it, so texts that disagree in any stay apart.

Defined results: null text counts as empty; empty texts are equal to each
other; a null identifier is retained only when its group has no other; repeated
rows are rows of their own (they count); an empty table gives an empty result;
other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernel, scratch

#: sha-256, second hash and length.
KEY_BYTES = 48
RECORD = np.dtype([("key", f"S{KEY_BYTES}"), ("keep", np.int64), ("known", np.int8), ("size", np.int64)])
#: Records per block of a run; a merge gathers four times as many before it sorts.
BLOCK = 8192
_RUN = "range int, run int, first binary, block binary"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key) of every normalised text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            for _, _, data, offsets in kernel.text_chunks(batch.column(1)):
                low = kernel.LOWER[data]
                view = memoryview(low)
                tails = np.stack([kernel.range_hash(kernel.BYTE_VALUE[low], offsets[:-1], offsets[1:]), (offsets[1:] - offsets[:-1]).astype(np.uint64)], axis=1).astype(">u8")
                keys += [hashlib.sha256(view[a:b]).digest() + t.tobytes() for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), tails, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(digest, "doc_id long, key binary")


def combine(records: np.ndarray, keep: str) -> np.ndarray:
    """Records in rising order, equal keys as one; a merge, as the sort is one of runs that are in order already."""
    records = records[np.argsort(records["key"], kind="stable")]
    words = np.frombuffer(records["key"].tobytes(), np.uint64).reshape(len(records), -1)
    first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
    if len(first) == len(records):
        return records
    out = records[first]
    out["keep"] = (np.minimum if keep == "smallest" else np.maximum).reduceat(records["keep"], first)
    out["known"] = np.maximum.reduceat(records["known"], first)
    out["size"] = np.add.reduceat(records["size"], first)
    return out


def _blocks(records: np.ndarray, ranges: int, run: int, block: int) -> pa.RecordBatch:
    """Blocks of records in order, cut where a digest range ends."""
    lead = np.frombuffer(records["key"].tobytes(), np.uint8).reshape(len(records), KEY_BYTES)[:, :2].astype(np.int64)
    of = (lead[:, 0] << 8 | lead[:, 1]) * ranges >> 16
    cuts = np.unique(np.concatenate([np.arange(0, len(records), block), np.flatnonzero(of[1:] != of[:-1]) + 1, [len(records)]])).astype(np.int64)
    blocks = [records[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(of[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(blocks), run, np.int32)), pa.array([b["key"][0].ljust(KEY_BYTES, b"\0") for b in blocks], pa.binary()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["range", "run", "first", "block"]
    )


def sorted_runs(table: DataFrame, keep: str, ranges: int, block: int = BLOCK) -> DataFrame:
    """A run per partition of (doc_id, key): sorted by Spark, packed as it streams."""
    worst = np.iinfo(np.int64).max if keep == "smallest" else np.iinfo(np.int64).min

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = TaskContext.get().partitionId(), np.zeros(0, RECORD)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, RECORD)
            ids = batch.column(0)
            new["key"] = np.frombuffer(b"".join(batch.column(1).to_pylist()), f"S{KEY_BYTES}")
            new["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
            new["keep"] = ids.fill_null(worst).to_numpy()
            new["size"] = 1
            held = combine(np.concatenate([held, new]), keep)
            if len(held) > block:  # the last record may go on in the next batch
                yield _blocks(held[:-1], ranges, run, block)
                held = held[-1:]
        if len(held):
            yield _blocks(held, ranges, run, block)

    return table.select("doc_id", "key").sortWithinPartitions("key").mapInArrow(packed, _RUN)


def merge_round(runs: DataFrame, keep: str, fan_in: int, ranges: int, width: int, block: int = BLOCK) -> DataFrame:
    """One run of each ``fan_in`` neighbours, labelled with the ranges of the next round."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending, waiting, last = np.zeros(0, RECORD), [], 0, None

        def settle(below: bytes | None) -> Iterator[pa.RecordBatch]:
            """Merge what is there and write what is below the key."""
            nonlocal held, pending, waiting
            if pending:
                held, pending, waiting = combine(np.concatenate([held, *pending]), keep), [], 0
            cut = len(held) if below is None else int(np.searchsorted(held["key"], np.array([below], f"S{KEY_BYTES}"))[0])
            if cut:
                yield _blocks(held[:cut], ranges, last[1], block)
                held = held[cut:]

        for batch in batches:
            raw = batch.column(3)
            for r, (own, run, first) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if (own, run) != last:
                    yield from settle(None)
                    last = (own, run)
                elif waiting > 4 * block:
                    yield from settle(first)
                pending.append(np.frombuffer(raw[r].as_buffer(), RECORD))
                waiting += len(pending[-1])
        yield from settle(None)

    neighbours = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
    return neighbours.repartition(width, "range", "run").sortWithinPartitions("range", "run", "first").mapInArrow(merged, _RUN)


def _unpacked(runs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(3):
                r = np.frombuffer(raw.as_buffer(), RECORD)
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY_BYTES), len(r), [None, pa.py_buffer(r["key"].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(r["keep"].copy(), mask=r["known"] == 0), pa.array(r["size"].copy())], ["key", "keep_id", "group_size"])

    return runs.mapInArrow(rows, "key binary, keep_id long, group_size long")


def merge_runs(table: DataFrame, keep: str = "smallest", fan_in: int = 8, block: int = BLOCK) -> DataFrame:
    """One row per key of (doc_id, key): (key, keep_id, group_size), by rounds of ``fan_in``-way merges."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    if fan_in < 2:
        raise ValueError("fan_in is 2 at least")
    width = scratch.partitions(table.sparkSession)
    left = max(1, table.rdd.getNumPartitions())
    after = lambda n: -(-n // fan_in)
    ranges = lambda n: min(1 << 16, -(-width // after(n)))
    runs = sorted_runs(table, keep, ranges(left), block)
    while left > 1:
        left = after(left)
        runs = merge_round(runs, keep, fan_in, ranges(left), width, block)
    return _unpacked(runs)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """Every row with its group: (doc_id, keep_id, group_size, kept, text_sha256).

    Of rows with one identifier and text, all are kept or none.
    """
    table = scratch.materialise(digests(docs, id_col, text_col), "digests")
    return table.join(merge_runs(table, keep, fan_in), "key").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256")
    )
