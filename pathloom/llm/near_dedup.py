"""Near-duplicate detection by b-bit MinHash.

A document is its set of distinct five-word shingles. Equal sets are first
joined into one representative, so copies cost one row each. Of each set's
PERMUTATIONS minima the low BITS are kept and packed; band keys of ROWS full
minima each generate candidates. Within a bucket the packed signatures are
compared by bit counts, corrected for chance collisions of BITS-bit values, and
a maximum spanning forest of the estimate is emitted: less than one pair per
bucket member, whatever the bucket's size.

The forests join sets into clusters, and every pair whose estimate may hide a
link lies within one. Each set goes once to its cluster's task, where products of
membership matrices give all exact intersections, so no link is lost to the
forests and no pair is written but a spanning forest of the links. A cluster
of more than BLOCK sets (or BLOCK_SHINGLES shingles) is dealt over several tasks
by a salt; a set outside the cluster's largest component visits those of its
other tasks that hold a candidate of its, so the texts that are sent grow with
the candidates.

A bucket of more than BLOCK sets loses no pair: all its members are put into one
cluster, whatever their estimates. Its forests are made of blocks of BLOCK sets
and only offer links between the cluster's tasks; a set outside the cluster's
largest component is compared with all members of all its buckets, which are
dealt over blocks of VISIT_BLOCKS * BLOCK sets that each get every such set.

A set pair at the threshold shares no bucket with a probability of about
(1 - 0.85**ROWS)**BANDS = 4e-7, and less above it, whatever the buckets' sizes.

Defined results: null and empty texts (or texts without words) have no shingles
and are linked with nothing; texts of fewer than five words are one shingle;
rows with a null identifier are returned with a null component and kept; a
document is its identifier: rows of one identifier with texts that have words
share a component, whatever they are linked with, and are kept or not together;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernel, scratch
from pathloom.llm.components import components
from pathloom.llm.decontaminate import may_be_in

PERMUTATIONS, BITS = 128, 4
BANDS, ROWS = 20, 4
BLOCK = 1024
#: Signatures that a visit is compared with at once, in blocks.
VISIT_BLOCKS = 16
BLOCK_SHINGLES = 1 << 20
#: Shingles per product of membership matrices.
COLUMNS = 1024
#: Estimates this far below the threshold are still candidates (4.7 standard deviations at 0.85).
MARGIN = 0.15
WORDS_PER_SHINGLE = 5
#: Size of the filters by which rows that meet nothing stay where they are.
FILTER_BYTES = 16 << 20
_XOR = kernel._table(101, PERMUTATIONS).astype(np.uint32)
_MUL = (kernel._table(103, PERMUTATIONS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ONES = np.uint64(0x1111111111111111)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS_PER_SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, rows = kernel.word_hashes(data, offsets)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        yield np.unique(kernel.shingle_hashes(words[a:b], size))


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set, as signed integers."""
    both = [int(shingles.sum(dtype=np.uint64)), int(kernel.mix(shingles + np.uint64(77)).sum(dtype=np.uint64))] if len(shingles) else [0, 0]
    return both[0] - (1 << 64) * (both[0] >> 63), both[1] - (1 << 64) * (both[1] >> 63)


def minima(shingles: np.ndarray) -> np.ndarray:
    h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 2048):
        np.minimum(out, ((h[i : i + 2048][None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=out)
    return out


def pack(mins: np.ndarray) -> bytes:
    """The minima's low BITS after a bijection that spreads them, packed into words."""
    low = ((mins * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def band_keys(mins: np.ndarray) -> np.ndarray:
    m = mins[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return kernel.mix((m * kernel.SHINGLE_VALUE[40 : 40 + ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (words of 64 bits), corrected for chance collisions."""
    x = many ^ one
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & _ONES).sum(axis=-1)
    chance = 2.0**-BITS
    return ((1 - differ / PERMUTATIONS) - chance) / (1 - chance)


def _batch(names: list[str], *arrays: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays), names)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, key1, key2, sig, bands): set size, set digest, packed signature, band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key1, key2, sig, bands = [], [], [], [], []
            for _, _, data, offsets in kernel.text_chunks(batch.column(1)):
                for s in shingle_sets(data, offsets):
                    n.append(len(s))
                    a, b = set_digest(s)
                    key1.append(a)
                    key2.append(b)
                    m = minima(s) if len(s) else None
                    sig.append(pack(m) if m is not None else b"")
                    bands.append(kernel.signed(band_keys(m)) if m is not None else np.zeros(0, np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            yield _batch(["doc_id", "n", "key1", "key2", "sig", "bands"], batch.column(0), pa.array(n, pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(sign, "doc_id long, n long, key1 long, key2 long, sig binary, bands array<long>")


class _Groups:
    """Rows of a partition sorted by (key, salt), regrouped from record batches."""

    def __init__(self, batches: Iterator[pa.RecordBatch], columns: int):
        self.batches, self.columns = batches, columns

    def __iter__(self) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Columns (the last is the signatures' matrix) of a run of whole groups, and the groups' bounds."""
        held: list[np.ndarray] | None = None
        for batch in self.batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(self.columns)]
            sig = np.frombuffer(b"".join(batch.column(self.columns).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            cols.append(sig)
            held = cols if held is None else [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            if len(new):
                yield [c[: new[-1]] for c in held], np.concatenate([[0], new])
                held = [c[new[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield held, np.array([0, *(np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1), len(held[0])])


def spanning_forest(sig: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over estimates of at least ``least`` (Prim, one row of estimates at a time)."""
    n = len(sig)
    best, parent, free = np.full(n, -1.0), np.full(n, -1), np.ones(n, bool)
    out, at = [], 0
    for _ in range(n):
        free[at] = False
        est = estimate(sig[at], sig)
        better = free & (est > best)
        best[better], parent[better] = est[better], at
        if not free.any():
            break
        at = int(np.argmax(np.where(free, best, -2.0)))
        if best[at] >= least:
            out.append((int(parent[at]), at))
    return out


def forest_pairs(blocks: DataFrame, least: float) -> DataFrame:
    """Candidate pairs (a, b), a < b, from rows (key, salt, id, sig)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, ids, sig), bounds in _Groups(batches, 3):
            size = bounds[1:] - bounds[:-1]
            pairs = bounds[:-1][size == 2]
            ok = pairs[estimate(sig[pairs], sig[pairs + 1]) >= least] if len(pairs) else pairs
            a, b = [ids[ok]], [ids[ok + 1]]
            for k in np.flatnonzero(size > 2).tolist():
                i, j = bounds[k], bounds[k + 1]
                edges = spanning_forest(sig[i:j], least)
                if edges:
                    e = np.array(edges) + i
                    a.append(ids[e[:, 0]])
                    b.append(ids[e[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield _batch(["a", "b"], pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)))

    return blocks.select("key", "salt", "id", "sig").repartition("key", "salt").sortWithinPartitions("key", "salt", "id").mapInArrow(emit, "a long, b long").where("a <> b").distinct()


def exact_links(sets: list[np.ndarray], rows: int, percent: int) -> np.ndarray:
    """Of sorted distinct sets: which of the first ``rows`` are linked with which of all, as a matrix.

    Shingles that only one set has add to no intersection; for the others, products of
    membership matrices count the intersections exactly.
    """
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1 if len(flat) else np.zeros(0, bool)
    column = np.cumsum(shared) - 1
    use = shared[number]
    owner, at = owner[use], column[number[use]]
    common = np.zeros((rows, len(sets)), np.float32)
    m = np.zeros((len(sets), COLUMNS), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(at, [first, first + COLUMNS])
        m[:] = 0
        m[owner[i:j], at[i:j] - first] = 1
        for r in range(0, rows, 256):
            common[r : r + 256] += m[r : min(rows, r + 256)] @ m.T
    linked = np.empty(common.shape, bool)
    for r in range(0, rows, 256):  # counts are below 2**24, so they are exact
        part = common[r : r + 256].astype(np.float64)
        end = r + len(part)
        linked[r:end] = (100 * part >= percent * (size[r:end, None] + size[None, :] - part)) & (part > 0)
    linked[np.arange(rows), np.arange(rows)] = False
    return linked


def forest_of(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    free, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not free[root]:
            continue
        free[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            new = np.flatnonzero(linked[at] & free)
            free[new] = False
            out += [(at, x) for x in new.tolist()]
            stack += new.tolist()
    return out


_SET = ["n", "key1", "key2"]
_SETS = "cluster long, salt int, guest boolean, id long, shingles binary"


def cluster_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each (cluster, salt) of rows as in _SETS: a spanning forest of those between hosts; for guests, one link to each host's component that it has any with."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: list[tuple[int, np.ndarray]] = []
        guests: list[tuple[int, np.ndarray]] = []
        out: list[tuple[int, int]] = []
        last, met = None, False

        def flush_hosts() -> None:
            if len(hosts) == 2:
                p, q = hosts[0][1], hosts[1][1]
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                if common and 100 * common >= percent * (len(p) + len(q) - common):
                    out.append((hosts[0][0], hosts[1][0]))
            elif len(hosts) > 2:
                out.extend((hosts[i][0], hosts[j][0]) for i, j in forest_of(exact_links([s for _, s in hosts], len(hosts), percent)))

        def flush_guests() -> None:
            if guests and hosts:
                linked = exact_links([s for _, s in guests] + [s for _, s in hosts], len(guests), percent)[:, len(guests) :]
                for g, h in zip(*np.nonzero(linked), strict=True):
                    out.append((guests[g][0], hosts[h][0]))
            guests.clear()

        for batch in batches:
            raw = batch.column(4)
            for r, (cluster, salt, guest, ident) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
                if (cluster, salt) != last:
                    if not met:
                        flush_hosts()
                    flush_guests()
                    hosts.clear()
                    last, met = (cluster, salt), False
                if guest:
                    met = True
                    guests.append((ident, np.frombuffer(raw[r].as_buffer(), np.uint64).copy()))
                    if len(guests) >= 256:
                        flush_guests()
                elif not hosts or hosts[-1][0] != ident:
                    hosts.append((ident, np.frombuffer(raw[r].as_buffer(), np.uint64).copy()))
            if out:
                a, b = np.array(out, np.int64).T
                yield _batch(["a", "b"], pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)))
                out.clear()
        if not met:
            flush_hosts()
        flush_guests()
        if out:
            a, b = np.array(out, np.int64).T
            yield _batch(["a", "b"], pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)))

    return sets.select("cluster", "salt", "guest", "id", "shingles").repartition("cluster", "salt").sortWithinPartitions("cluster", "salt", "guest", "id").mapInArrow(find, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on the full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
            keep = pa.array(ok, pa.bool_())
            yield _batch(["a", "b"], batch.column(0).filter(keep), batch.column(1).filter(keep))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _buckets(table: DataFrame) -> DataFrame:
    """(key, id, members, least) of all sets in buckets with two sets or more; ``least`` is the smallest member."""
    rows = table.select("id", F.explode("bands").alias("key"))
    # from files, so that Spark can split a large bucket's partition of a join
    sizes = scratch.materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("least")).where("members > 1"), "bucket-sizes")
    # most sets are alone in most of their buckets, and do not move again
    met = may_be_in(rows.withColumn("k1", F.col("key")), sizes.withColumn("k1", F.col("key")), FILTER_BYTES).select("key", "id")
    return scratch.materialise(met.join(sizes, "key").select("key", "id", "members", "least"), "buckets")


def _blocks(table: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows (key, salt, id, sig) of all buckets with two sets or more, in blocks of about BLOCK sets at most; what they keep apart is joined by ``_whole``."""
    salts = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = buckets.select("key", "id", F.pmod(F.xxhash64("id", "key"), salts).cast("int").alias("salt"))
    return dealt.join(table.select("id", "sig"), "id")


def _whole(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) that join all members of each bucket of several blocks."""
    return buckets.where(F.col("members") > BLOCK).where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()


def _visits(table: DataFrame, placed: DataFrame, least: float) -> DataFrame:
    """(id, cluster, salt): the other tasks of its cluster that a guest of ``placed`` (id, cluster, home, guest) has a candidate in, of all members of its buckets."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:  # of each block the members, then the guests that ask
            if not batch.num_rows:
                continue
            key, salt, asks, ids, cluster, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            sig = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            new = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (asks[1:] != asks[:-1])) + 1
            out: list[tuple[int, int, int]] = []
            for i, j in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                if (key[i], salt[i]) != last:
                    last, parts = (key[i], salt[i]), []
                if not asks[i]:
                    parts.append((cluster[i:j], home[i:j], sig[i:j]))
                    continue
                parts = [tuple(map(np.concatenate, zip(*parts, strict=True)))] if len(parts) > 1 else parts
                if not parts:
                    continue
                own, at, other = parts[0]
                for g in range(i, j):
                    near = (own == cluster[g]) & (at != home[g])
                    if near.any():
                        near &= estimate(sig[g], other) >= least
                        out += [(int(ids[g]), int(cluster[g]), t) for t in np.unique(at[near]).tolist()]
            a, b, c = np.array(out, np.int64).reshape(-1, 3).T
            yield _batch(["id", "cluster", "salt"], pa.array(a), pa.array(b), pa.array(c.astype(np.int32)))

    met = table.select("id", "bands").join(placed, "id").select("id", "cluster", "home", "guest", F.explode("bands").alias("key"))
    asked = met.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("guest").alias("any")).where("members > 1 AND any")
    salts = F.ceil(F.col("members") / (VISIT_BLOCKS * BLOCK)).cast("int")
    met = scratch.materialise(met.join(asked.select("key", salts.alias("salts")), "key"), "visit-buckets")
    here = met.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.col("salts")).cast("int")).withColumn("asks", F.lit(0))
    there = met.where("guest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("asks", F.lit(1))
    sent = here.unionByName(there).join(table.select("id", "sig"), "id").select("key", "salt", "asks", "id", "cluster", "home", "sig")
    return sent.repartition("key", "salt").sortWithinPartitions("key", "salt", "asks").mapInArrow(find, "id long, cluster long, salt int").distinct()


def _cluster_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, unique: bool) -> DataFrame:
    """Full sets of the members (id, doc_id, n, key1, key2, cluster, salt), as hosts of their (cluster, salt), from a row that has them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = list(zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True))
            for i, j, data, offsets in kernel.text_chunks(batch.column(6)):
                found = list(shingle_sets(data, offsets))
                own = np.array([(len(s), *set_digest(s)) == w for s, w in zip(found, want[i:j], strict=True)], bool)
                at = pa.array(np.flatnonzero(own) + i)
                cluster, salt, ids = (batch.column(k).take(at) for k in range(3))
                yield _batch(["cluster", "salt", "guest", "id", "shingles"], cluster, salt, pa.array(np.zeros(len(at), bool)), ids, pa.array([s.tobytes() for s, ok in zip(found, own.tolist(), strict=True) if ok], pa.binary()))

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    number = F.xxhash64("doc_id").alias("k1")
    # texts of no cluster stay where they are
    met = may_be_in(own.select("*", number), members.select(number), FILTER_BYTES).drop("k1").join(members, "doc_id")
    if not unique:  # of one identifier's rows, one of each text
        met = met.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "id", "h"])
    return met.select("cluster", "salt", "id", "n", "key1", "key2", "text").mapInArrow(cut, _SETS)


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its component: (doc_id, n_shingles, component_id, kept)."""
    spark = docs.sparkSession
    least = percent / 100 - MARGIN
    signed = scratch.materialise(signatures(docs, id_col, text_col), "signatures")
    keyed = signed.where("n > 0 AND doc_id IS NOT NULL")
    repeated = keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    unique = repeated.isEmpty()
    # a set is known by its number, and has one document for it
    one = [F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")]  # equal sets have equal signatures
    signed_reps, table_path = scratch.write(keyed.groupBy(*_SET).agg(*one).withColumn("rep", F.monotonically_increasing_id()), "representatives")
    reps = scratch.materialise(signed_reps.select(*_SET, "doc_id", "rep"), "representative-numbers")
    table = signed_reps.select(F.col("rep").alias("id"), "sig", "bands")
    buckets = _buckets(table)
    pairs = scratch.materialise(forest_pairs(_blocks(table, buckets), least), "pairs")

    clusters = components(_edges(pairs.unionByName(_whole(buckets)))).withColumnRenamed("component", "cluster")
    sized = clusters.join(reps.withColumnRenamed("rep", "id"), "id")
    salts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("salts")
    members = scratch.materialise(
        sized.join(sized.groupBy("cluster").agg(salts), "cluster").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")), "members"
    )
    sets, sets_path = scratch.write(_cluster_sets(docs, members.select("id", "doc_id", *_SET, "cluster", "salt"), id_col, text_col, unique), "sets")
    links = scratch.materialise(cluster_links(sets, percent), "links")
    dealt = members.where("salts > 1")
    if not dealt.isEmpty():
        salt_of = lambda c: dealt.select(F.col("id").alias(c), F.col("salt").alias(f"salt_{c}"))
        between = pairs.join(salt_of("a"), "a").join(salt_of("b"), "b").where("salt_a <> salt_b").select("a", "b")
        links = scratch.materialise(links.unionByName(confirm(between, sets, percent)), "links")
        comps = scratch.materialise(components(_edges(links)), "components")
        tagged = dealt.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
        sizes = tagged.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
        placed = tagged.join(largest, "cluster").select("id", "cluster", F.col("salt").alias("home"), (F.col("component") != F.col("largest")).alias("guest"))
        sent = scratch.materialise(_visits(table, scratch.materialise(placed, "placed"), least), "visits")
        guest_sets = sent.join(sets.select("id", "shingles"), "id").select("cluster", "salt", F.lit(True).alias("guest"), "id", "shingles")
        host_sets = sets.join(sent.select("cluster", "salt").distinct(), ["cluster", "salt"], "left_semi")
        links = scratch.materialise(links.unionByName(cluster_links(host_sets.unionByName(guest_sets), percent)), "links")
    scratch.remove(spark, sets_path, table_path)
    edges = _edges(links)
    if not unique:  # sets of one document are in one component
        of_doc = keyed.join(repeated, "doc_id").join(reps.drop("doc_id"), _SET).select("doc_id", "rep").distinct()
        edges = edges.unionByName(of_doc.join(of_doc.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").select(F.col("rep").alias("u"), F.col("least").alias("v")))
    comps = scratch.materialise(components(edges), "components")
    placed = reps.join(comps, reps["rep"] == comps["id"], "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    members = placed.drop("doc_id").join(smallest, "component").select(*_SET, "component_id")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return signed.join(members, _SET, "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
