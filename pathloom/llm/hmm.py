"""Language-model scoring with a hidden Markov model.

A text is its words and one end. The most frequent TOP words and the end are
symbols of their own; other words share SUFFIX symbols by their last bytes, and
within such a symbol a word has its smoothed relative frequency. STATES latent
states emit symbols. Baum-Welch: in every round each partition runs the scaled
forward-backward recursion over all its training texts and sums expected counts;
the sums are added over partitions in a tree, in a fixed order, and the
parameters follow from them. Rounds go on until a round raises the log-likelihood
by less than ``settle`` a token, ``rounds`` at most. The first parameters follow
from the counts of the symbols, so that the model depends on the training texts
alone and not on how they are partitioned (but for the rounding of sums).

Both recursions run over whole sequences of any length. A long one is cut into
pieces whose state-to-state factors are computed side by side; multiplied in
order, they give the forward values before and the backward values after each
piece, and the pieces follow from these.

Word counts cover all training texts. The counts of the most frequent words,
at most DICTIONARY, go to every executor; the counts of all others are joined to the documents that
have them.

Defined results: null text counts as empty; an empty text is its end alone;
rows with a null identifier are scored, their fold is that of the empty string;
repeated rows are learned from and scored once each; without training texts the
model is uniform; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernel, scratch

STATES = 8
TOP, SUFFIX = 4096, 1024
SYMBOLS = TOP + SUFFIX + 1
END = SYMBOLS - 1
DICTIONARY = 1 << 18
#: Symbols of a piece; a sequence of more than LONG is cut; symbols that are worked on at once; steps between scalings.
PIECE, LONG, AT_ONCE, SCALE = 1024, 4096, 120_000, 16
SUMS = STATES + STATES**2 + SYMBOLS * STATES
_LOG10 = np.log(10.0)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix symbol (0 to SUFFIX - 1) of every word; and each row's range of words."""
    starts, ends, rows = kernel.word_bounds(kernel.SPACE[data], offsets)
    symbols = kernel.BYTE_VALUE[kernel.LOWER[data]]
    suffix = kernel.range_hash(symbols, np.maximum(starts, ends - 3), ends) >> np.uint64(54)
    return kernel.range_hash(symbols, starts, ends), suffix.astype(np.int16), rows


@dataclass
class Vocabulary:
    """Counts: of the dictionary's words, of the suffix symbols, and in all."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    symbols: np.ndarray  # of the dictionary's words: own symbol, or -1
    texts: int
    tokens: int
    distinct: int
    suffix_tokens: np.ndarray
    suffix_distinct: np.ndarray

    def symbol_counts(self) -> np.ndarray:
        """How often each symbol stands in the training texts."""
        own = np.flatnonzero(self.symbols >= 0)
        out = np.zeros(SYMBOLS)
        out[self.symbols[own]] = self.counts[own]
        out[END - SUFFIX : END], out[END] = self.suffix_tokens, self.texts
        return out

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the dictionary, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


def count_words(texts: DataFrame) -> DataFrame:
    """(word, suffix, n) over all texts; each task combines its counts before they move."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merge() -> tuple[np.ndarray, ...]:
            h, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, s, n = h[order], s[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], s[first], np.add.reduceat(n, first)

        def batch_of(h, s, n):
            return pa.RecordBatch.from_arrays([pa.array(kernel.signed(h)), pa.array(s), pa.array(n)], ["word", "suffix", "n"])

        size = 0
        for batch in batches:
            for _, _, data, offsets in kernel.text_chunks(batch.column(0)):
                h, s, _ = tokens_of(data, offsets)
                if not len(h):
                    continue
                held.append((h, s, np.ones(len(h), np.int64)))
                held = [merge()] if len(held) > 4 else held
                size = sum(len(x[0]) for x in held)
                if size > 2_000_000:
                    h, s, n = merge()
                    held = []
                    for i in range(0, len(h), 100_000):
                        yield batch_of(h[i : i + 100_000], s[i : i + 100_000], n[i : i + 100_000])
        if held:
            h, s, n = merge()
            for i in range(0, len(h), 100_000):
                yield batch_of(h[i : i + 100_000], s[i : i + 100_000], n[i : i + 100_000])

    rows = texts.select("text").mapInArrow(count, "word long, suffix short, n long")
    return rows.groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the least count of a dictionary word: from a histogram of the counts' logarithms
    level = F.floor(F.log2("n") * 64).cast("int")
    room, least = DICTIONARY, 1 << 30
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r["level"]):
        if r["v"] > room:
            break
        room, least = room - r["v"], r["level"]
    best = counts.where(level >= least).select("word", "suffix", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    h = best["word"].to_numpy(np.int64).view(np.uint64)
    n = best["n"].to_numpy(np.int64)
    symbol = np.where(np.arange(len(h)) < TOP, np.arange(len(h)), -1)
    of_suffix = {r["suffix"]: (r["n"], r["v"]) for r in counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tokens, distinct = (np.array([of_suffix.get(s, (0, 0))[i] for s in range(SUFFIX)], float) for i in (0, 1))
    own = best["suffix"].to_numpy(np.int64)[:TOP]
    tokens -= np.bincount(own, weights=n[:TOP], minlength=SUFFIX)[:SUFFIX]
    distinct -= np.bincount(own, minlength=SUFFIX)[:SUFFIX]
    order = np.argsort(h)
    return Vocabulary(h[order], n[order], symbol[order], texts, int(total["n"]) + texts, int(total["v"]) + (texts > 0), tokens, distinct)


@dataclass
class Model:
    start: np.ndarray  # log-free probabilities
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @classmethod
    def first(cls, symbol_counts: np.ndarray, seed: int = 19) -> Model:
        rng = np.random.default_rng(seed)
        share = (symbol_counts + 0.5) / (symbol_counts + 0.5).sum()
        emit = share[:, None] * np.exp(rng.normal(0, 0.7, (SYMBOLS, STATES)))
        move = np.full((STATES, STATES), 0.3 / (STATES - 1)) + np.eye(STATES) * (0.7 - 0.3 / (STATES - 1))
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    @classmethod
    def of(cls, sums: np.ndarray, symbol_share: np.ndarray) -> Model:
        """From expected counts of starts, moves and emissions, smoothed."""
        start, move, emit = sums[:STATES] + 0.5, sums[STATES : STATES + STATES**2].reshape(STATES, STATES) + 0.5, sums[STATES + STATES**2 : SUMS].reshape(SYMBOLS, STATES)
        emit = emit + 20 * symbol_share[:, None]
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _steps(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences in falling order of length: how many are active at each step, and the steps' offsets."""
    active = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0]), side="right")
    return active, np.concatenate([[0], np.cumsum(active)])


def _by_step(flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Values of the sequences, step by step."""
    rank = np.repeat(np.arange(len(lens)), lens)
    inner = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    out = np.empty(len(rank), flat.dtype)
    out[offsets[inner] + rank] = flat[begin[rank] + inner]
    return out


def _piece_counts(model: Model, flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Sums of starts, moves and emissions over flat[begin : begin + lens], and the log-likelihood.

    ``before``: forward values of the symbol before (zeros: the sequence starts here); ``after``: backward values of the last symbol.
    Values are scaled every SCALE steps, by way of the emissions there; expected counts are normalised by place, so the scale does not matter to them.
    """
    order = np.argsort(-lens, kind="stable")
    begin, lens, before, after = begin[order], lens[order], before[order], after[order]
    fresh = ~before.any(axis=1)
    active, offsets = _steps(lens)
    steps, bounds, ones = active.tolist(), offsets.tolist(), np.ones(STATES)
    sym = _by_step(flat, begin, lens, offsets)
    emitted = np.take(model.emit, sym, axis=0)
    alpha, beta = np.empty_like(emitted), np.empty_like(emitted)
    total = np.zeros(len(lens))
    a = np.where(fresh[:, None], model.start, before @ model.move) * emitted[: steps[0]]
    for t, n in enumerate(steps):
        if t:
            a = (a[:n] @ model.move) * emitted[bounds[t] : bounds[t + 1]]
        if t % SCALE == SCALE - 1:
            scale = a @ ones
            a /= scale[:, None]
            total[:n] += np.log(scale)
            emitted[bounds[t] : bounds[t + 1]] /= scale[:, None]
        alpha[bounds[t] : bounds[t + 1]] = a
    last = offsets[lens - 1] + np.arange(len(lens))
    total += np.log(alpha[last] @ ones)
    back = model.move.T.copy()
    b = after[:0]
    for t in range(len(steps) - 1, -1, -1):
        n, more = steps[t], len(b)
        own = beta[bounds[t] : bounds[t + 1]]
        if more:
            own[:more] = (emitted[bounds[t + 1] : bounds[t + 2]] * b) @ back
        own[more:] = after[more:n]
        if t % SCALE == 0:
            own /= (own @ ones)[:, None]
        b = own
    n = steps[0]
    beta /= np.einsum("ij,ij->i", alpha, beta)[:, None]
    gamma = alpha * beta
    ahead = np.multiply(emitted, beta, out=emitted)  # what a move leads to, by the sum over all moves to that place
    earlier = np.arange(n, len(sym)) - np.repeat(active[:-1], active[1:])  # the place before, of all but the first
    move = np.take(alpha, earlier, axis=0).T @ ahead[n:] + before.T @ ahead[:n]
    emit = np.stack([np.bincount(sym, weights=gamma[:, k], minlength=SYMBOLS) for k in range(STATES)], axis=1)
    return np.concatenate([gamma[:n][fresh].sum(axis=0), (move * model.move).ravel(), emit.ravel(), [total.sum()]])


def _transfers(model: Model, flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces: weights from the state before a piece (where it ``starts`` a sequence: at its first symbol) to the state at its end, and logs of their scale."""
    order = np.argsort(-lens, kind="stable")
    begin, lens, first = begin[order], lens[order], starts[order]
    here = np.tile(np.eye(STATES), (len(lens), 1, 1))
    logs = np.zeros((len(lens), STATES))
    active = _steps(lens)[0].tolist()
    for t, n in enumerate(active):
        x = (here[:n].reshape(-1, STATES) @ model.move).reshape(n, STATES, STATES)
        if not t:
            x[first] = here[:n][first]
        x *= model.emit[flat[begin[:n] + t]][:, None, :]
        if t % SCALE == SCALE - 1 or t + 1 == len(active) or active[t + 1] < n:
            s = x.sum(axis=2)
            x /= s[:, :, None]
            logs[:n] += np.log(s)
        here[:n] = x
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return here[back], logs[back]


def _chain(a: np.ndarray, factor: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, float]:
    """Values after a piece, scaled, and the log of the scale."""
    top = logs.max()
    a = (a * np.exp(logs - top)) @ factor
    s = a.sum()
    return a / s, top + np.log(s)


def expected_counts(model: Model, flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, long: int = LONG, piece: int = PIECE, at_once: int = AT_ONCE) -> np.ndarray:
    """Sums of starts, moves and emissions over the whole sequences flat[begin : begin + lens], and their log-likelihood."""
    size = np.where(lens > long, piece, np.maximum(1, lens))
    count = -(-lens // size)
    begin, lens = pieces_of(begin, lens, size)
    first = np.cumsum(count) - count
    before, after = np.zeros((len(lens), STATES)), np.ones((len(lens), STATES))
    cut = np.flatnonzero(np.repeat(count, count) > 1)
    if len(cut):
        starts = np.zeros(len(lens), bool)
        starts[first] = True
        factor, logs = _transfers(model, flat, begin[cut], lens[cut], starts[cut])
        at = np.full(len(lens), -1)
        at[cut] = np.arange(len(cut))
        for f, n in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            a, k = model.start, at[f]
            for p in range(n - 1):
                a, _ = _chain(a, factor[k + p], logs[k + p])
                before[f + p + 1] = a
            for p in range(n - 1, 0, -1):
                b = np.exp(logs[k + p] - logs[k + p].max()) * (factor[k + p] @ after[f + p])
                after[f + p - 1] = b / b.sum()
    order = np.argsort(-lens, kind="stable")  # alike lengths together: fewer steps that few sequences take
    begin, lens, before, after = begin[order], lens[order], before[order], after[order]
    out, i, ends = np.zeros(SUMS + 1), 0, np.cumsum(lens)
    while i < len(lens):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_once, side="right")))
        out += _piece_counts(model, flat, begin[i:j], lens[i:j], before[i:j], after[i:j])
        i = j
    return out


def pieces_of(begin: np.ndarray, lens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the pieces of sequences, each cut by its ``size``."""
    n = -(-lens // size)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    b = np.repeat(begin, n) + inner * np.repeat(size, n)
    return b, np.minimum(np.repeat(size, n), np.repeat(begin + lens, n) - b)


def log_likelihood(model: Model, flat: np.ndarray, begin: np.ndarray, lens: np.ndarray, long: int = LONG, piece: int = PIECE) -> np.ndarray:
    """Natural log of the exact probability of each sequence; long ones by the factors of their pieces."""
    out, ones = np.zeros(len(lens)), np.ones(STATES)
    short = np.flatnonzero(lens <= long)
    if len(short):
        order = short[np.argsort(-lens[short], kind="stable")]
        active, offsets = _steps(lens[order])
        emitted = model.emit[_by_step(flat, begin[order], lens[order], offsets)]
        a, total = np.tile(model.start, (len(order), 1)), np.zeros(len(order))
        for t, n in enumerate(active.tolist()):
            if n < len(a):  # the others have ended
                total[n : len(a)] += np.log(a[n:] @ ones)
            a = (a[:n] @ model.move if t else a) * emitted[offsets[t] : offsets[t + 1]]
            if t % SCALE == SCALE - 1:
                s = a @ ones
                a /= s[:, None]
                total[:n] += np.log(s)
        total[: len(a)] += np.log(a @ ones)
        out[order] = total
    far = np.flatnonzero(lens > long)
    if len(far):
        count = -(-lens[far] // piece)
        b, n = pieces_of(begin[far], lens[far], np.full(len(far), piece))
        starts = np.zeros(len(n), bool)
        starts[np.cumsum(count) - count] = True
        factor, logs = _transfers(model, flat, b, n, starts)
        k = 0
        for r, pieces in zip(far.tolist(), count.tolist(), strict=True):
            a = model.start
            for _ in range(pieces):
                a, scale = _chain(a, factor[k], logs[k])
                out[r] += scale
                k += 1
    return out


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per row: its symbols, what the dictionary tells, and its words beyond it: (uid, doc_id, held_out, n_tokens, known, base, inner, symbols, rare)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, symbols binary, rare array<struct<word: bigint, times: int>>"

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        uid = TaskContext.get().partitionId() << 36
        size = v.tokens + 0.5 * (v.distinct + 1)
        log_end = np.log10((v.texts + 0.5) / size)
        log_count = np.log10(v.counts + 0.5)
        log_suffix = np.log10(v.suffix_tokens + 0.5 * (v.suffix_distinct + 1))
        for batch in batches:
            for i, j, data, offsets in kernel.text_chunks(batch.column(2)):
                h, suffix, rows = tokens_of(data, offsets)
                m = j - i
                row = np.repeat(np.arange(m), rows[1:] - rows[:-1])
                at, there = v.look_up(h)
                own = np.where(there, v.symbols[at] if len(v.symbols) else -1, -1)
                sym = np.where(own >= 0, own, TOP + suffix).astype(np.int16)
                counted = there
                lg = np.where(counted, log_count[at] if len(log_count) else 0.0, 0.0)
                base = np.bincount(row, weights=lg, minlength=m) - (rows[1:] - rows[:-1]) * np.log10(size) + log_end
                inside = (own < 0).astype(float)
                inner = np.bincount(row, weights=inside * (lg - log_suffix[suffix]), minlength=m)
                known = np.bincount(row, weights=counted, minlength=m).astype(np.int64) + (v.texts > 0)
                far = np.flatnonzero(~counted)
                far = far[np.lexsort((h[far], row[far]))]
                fresh = np.concatenate([[True], (h[far][1:] != h[far][:-1]) | (row[far][1:] != row[far][:-1])]) if len(far) else np.zeros(0, bool)
                head = np.flatnonzero(fresh)
                times = np.diff(np.append(head, len(far)))
                ends = np.searchsorted(row[far][head], np.arange(m + 1))
                words = pa.StructArray.from_arrays([pa.array(kernel.signed(h[far][head])), pa.array(times.astype(np.int32))], ["word", "times"])
                rare = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words)
                cut = [np.append(sym[a:b], np.int16(END)).astype(np.int16).tobytes() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + m)), batch.column(0).slice(i, m), batch.column(1).slice(i, m), pa.array(rows[1:] - rows[:-1] + 1), pa.array(known), pa.array(base), pa.array(inner), pa.array(cut, pa.binary()), rare],
                    "uid doc_id held_out n_tokens known base inner symbols rare".split(),
                )
                uid += m

    return docs.mapInArrow(rows_of, schema)


def _sequences(batch: pa.RecordBatch, column: int, limit: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, symbols, begins, lengths) of at most about ``limit`` symbols."""
    raw = [x.as_buffer() for x in batch.column(column)]
    lens = np.array([x.size // 2 for x in raw], np.int64)
    i = 0
    while i < len(raw):
        j = max(i + 1, i + int(np.searchsorted(np.cumsum(lens[i:]), limit, side="right")))
        flat = np.concatenate([np.frombuffer(x, np.int16) for x in raw[i:j]])
        yield i, j, flat, np.cumsum(lens[i:j]) - lens[i:j], lens[i:j]
        i = j


def _add_up(rows: DataFrame, slots: int) -> np.ndarray:
    """Sum of the vectors in (slot, sums), added in rounds and in the order of their slots, so that no task or driver holds many.

    The last round's vectors, 32 at most, come in one job: one for each partition, empty ones too, would take longer than the round.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(raw.as_buffer())
                total[slot] = total[slot] + v if slot in total else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slot", "sums"])

    while slots > 1:
        dealt = rows.withColumn("own", F.col("slot") % slots).repartition(slots, "own").sortWithinPartitions("own", "slot")
        rows = dealt.select(F.col("own").alias("slot"), "sums").mapInArrow(add, "slot int, sums binary")
        slots = slots // 32 if slots > 32 else 1
    out = np.zeros(SUMS + 1)
    for _, raw in sorted((r["slot"], r["sums"]) for r in rows.collect()):
        out = out + np.frombuffer(raw)
    return out


def baum_welch_round(encoded: DataFrame, model: Model, slots: int) -> np.ndarray:
    """The sums of all partitions, and the log-likelihood under ``model``."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = shared.value, np.zeros(SUMS + 1)
        for batch in batches:
            for _, _, flat, begin, lens in _sequences(batch, 0):
                total += expected_counts(m, flat, begin, lens)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])

    out = _add_up(encoded.select("symbols").mapInArrow(count, "slot int, sums binary"), slots)
    shared.unpersist()
    return out


def train(encoded: DataFrame, vocab: Vocabulary, rounds: int, settle: float) -> Model:
    """Baum-Welch over all sequences of ``encoded``."""
    seen = vocab.symbol_counts()
    model = Model.first(seen)
    if not vocab.texts:
        return model
    share = (seen + 0.1) / (seen + 0.1).sum()
    slots = 1024 if scratch.partitions(encoded.sparkSession) > 1024 else 32
    before = -np.inf
    for _ in range(rounds):
        sums = baum_welch_round(encoded, model, slots)
        model = Model.of(sums, share)
        if sums[-1] - before < settle * vocab.tokens:
            break
        before = sums[-1]
    return model


def score_texts(docs: DataFrame, held_out: Column, rounds: int = 10, settle: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row scored: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). ``held_out``: rows not learned from."""
    spark = docs.sparkSession
    kernel.one_thread(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    learned = own.where("NOT held_out")
    counts = scratch.materialise(count_words(learned), "words")
    vocab = vocabulary(counts, learned.count())
    table = scratch.materialise(encode(own, vocab), "encoded")
    model = train(table.where("NOT held_out"), vocab, rounds, settle)
    final = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = final.value
        for batch in batches:
            for i, j, flat, begin, lens in _sequences(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(log_likelihood(m, flat, begin, lens) / _LOG10)], ["uid", "hmm"])

    rare = (
        table.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.times")
        .join(counts.select("word", "n"), "word", "left")
        .groupBy("uid")
        .agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log_counts"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"))
    )
    hmm = table.select("uid", "symbols").mapInArrow(score, "uid long, hmm double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return (
        table.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "inner")
        .join(rare, "uid", "left")
        .join(hmm, "uid")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + zero("log_counts")).alias("base_score"), (F.col("hmm") + F.col("inner") + zero("log_counts")).alias("score"),
        )
    )
