"""Toxicity: a weighted finite-state grammar over clauses.

Words become classes: insults (learned word forms and stems with log-odds as
weights), threats, targets, negations and verbs of reported speech (fixed lists
below), others; a clause is its words and a break. Five weighted transducers
read them one after another: ``insults`` marks what is scored, ``threats`` waits
for a target before or after the threat, ``targets`` aims what follows a target,
``negations`` lowers what stands within NEGATION_REACH words of a negation,
``reports`` lowers what is reported. ``compose`` makes one automaton of them, with
products of arc weights; it scores the clauses that match, a step over all
clauses of a batch at a time. The arcs' weights are fitted to the sample, near
PRIOR where it says little. A text's features are sums and maxima of its
clauses' scores, combined into one probability by logistic regression.

Insults are learned by how many toxic and other texts of a bounded sample of
labelled rows have a form: ``max_rows`` and ``max_bytes``. Scoring reads whole
texts; clauses without an insult or threat score nothing and are left out.

Defined results: null text counts as empty; an empty text has no clause and gets
the score of a text without matches; equal texts have equal scores; null
identifiers are passed through; null labels are not learned from; without labels
of both kinds every score is the smoothed share of label 1; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernel, scratch, training

#: Classes of words, as numbers and as symbols on the first tape; the last is the end of a clause.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
SYMBOLS = "o i h t n q |".split()
THREATS = "kill murder hurt destroy beat stab shoot töten umbringen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself youre he she they him her them du dich dir ihr euch sie tu te toi vous ils elles usted ustedes tú ti ellos".split()
_AUXILIARIES = "is are was were do does did has have had wo would could should must need might ai ca".split()
NEGATIONS = "not no never neither nor without nicht kein keine nie niemals pas jamais aucun sans nunca jamás sin ningún".split() + [a + n for a in _AUXILIARIES for n in ("n't", "n’t", "nt")]
REPORTS = "said says wrote quoted called reported claims sagte schrieb zitierte dit écrit cité dijo escribió citó".split()
#: Weights of the arcs before they are fitted: an aimed threat, a threat without target, an aimed insult, a negated and a reported match.
PRIOR = {"threat": 0.5, "idle": 0.1, "aimed": 1.1, "negated": 0.6, "reported": 0.7}
#: Lengths in bytes of the word beginnings that are learned as stems.
STEMS = (4, 5, 6)
NEGATION_REACH = 3
FEATURES = 7


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol read) -> (symbol written, weight, next state); "" is nothing written, or an arc that reads nothing."""

    start: object
    arcs: dict

    def symbols(self) -> list[str]:
        return sorted({i for _, i in self.arcs})

    def run(self, tape: list[str]) -> list[tuple[str, float]]:
        """What is written with its weight, symbol by symbol."""
        state, out = self.start, []
        for symbol in tape:
            written, weight, state = self.arcs[state, symbol]
            out.append((written, weight))
        return out


def compose(a: Transducer, b: Transducer) -> Transducer:
    """``b`` reads what ``a`` writes: pairs of states that can be reached, with products of weights. Where ``a`` writes nothing, ``b`` stays; where ``b`` reads nothing, ``a`` stays."""
    by_state: dict = {}
    for (state, symbol), arc in a.arcs.items():
        by_state.setdefault(state, []).append((symbol, arc))
    start = (a.start, b.start)
    arcs: dict = {}
    todo, seen = [start], {start}
    while todo:
        p, q = here = todo.pop()
        for symbol, (written, weight, after) in by_state.get(p, []):
            if not written:
                arcs[here, symbol] = ("", weight, (after, q))
            elif (q, written) in b.arcs:
                out, more, then = b.arcs[q, written]
                arcs[here, symbol] = (out, weight * more, (after, then))
        if (q, "") in b.arcs:
            out, more, then = b.arcs[q, ""]
            arcs[here, ""] = (out, more, (p, then))
        for _, _, state in [arc for (at, _), arc in arcs.items() if at == here]:
            if state not in seen:
                seen.add(state)
                todo.append(state)
    return Transducer(start, arcs)


def insults() -> Transducer:
    """Marks insults; everything else passes."""
    return Transducer(0, {(0, c): ("I" if c == "i" else c, 1.0, 0) for c in SYMBOLS})


def threats(w: Mapping[str, float]) -> Transducer:
    """A threat counts with a target of its clause (T), before it or after it; else the break tells of it (D)."""
    arcs = {}
    for state in ("none", "target", "threat"):
        arcs |= {(state, c): (c, 1.0, state) for c in ("o", "I", "n", "q")}
        arcs[state, "|"] = ("|", 1.0, "none")
    arcs["none", "t"] = arcs["target", "t"] = ("t", 1.0, "target")
    arcs["target", "h"] = ("T", w["threat"], "target")
    arcs["none", "h"] = arcs["threat", "h"] = ("", 1.0, "threat")
    arcs["threat", "t"] = ("T", w["threat"], "target")
    arcs["threat", "|"] = ("D", w["idle"], "none")
    return Transducer("none", arcs)


def targets(w: Mapping[str, float]) -> Transducer:
    """An insult after a target, or after a threat with one, is aimed (J)."""
    arcs = {}
    for state in ("none", "seen"):
        arcs |= {(state, c): (c, 1.0, state) for c in ("o", "n", "q")}
        arcs |= {(state, c): (c, 1.0, "none") for c in ("|", "D")}
        arcs[state, "t"] = ("", 1.0, "seen")
        arcs[state, "T"] = ("T", 1.0, "seen")
    arcs["none", "I"] = ("I", 1.0, "none")
    arcs["seen", "I"] = ("J", w["aimed"], "seen")
    return Transducer("none", arcs)


def negations(w: Mapping[str, float], reach: int = NEGATION_REACH) -> Transducer:
    """What stands at most ``reach`` words after a negation is lowered (-); the state is how many words it still reaches."""
    arcs = {}
    for left in range(reach + 1):
        after = max(0, left - 1)
        arcs |= {(left, c): (c, 1.0, after) for c in ("o", "q")}
        arcs |= {(left, c): (c + "-", w["negated"], after) if left else (c, 1.0, after) for c in ("I", "J", "T")}
        arcs[left, "n"] = ("", 1.0, reach)
        arcs |= {(left, c): (c, 1.0, 0) for c in ("|", "D")}
    return Transducer(0, arcs)


def reports(w: Mapping[str, float]) -> Transducer:
    """What follows a verb of reporting is lowered (r); only matches are written."""
    arcs = {}
    for told in (False, True):
        arcs[told, "o"] = ("", 1.0, told)
        arcs[told, "q"] = ("", 1.0, True)
        arcs[told, "|"] = ("", 1.0, False)
        for c in ("I", "J", "T", "I-", "J-", "T-", "D"):
            arcs[told, c] = (c + "r" if told else c, w["reported"] if told else 1.0, False if c == "D" else told)
    return Transducer(False, arcs)


def grammar(w: Mapping[str, float]) -> Transducer:
    return reduce(compose, [insults(), threats(w), targets(w), negations(w), reports(w)])


#: What the grammar writes.
MATCHES = [c + n + r for c in ("I", "J", "T") for n in ("", "-") for r in ("", "r")] + ["D", "Dr"]
_FACTORS = {"threat": "T", "idle": "D", "aimed": "J", "negated": "-", "reported": "r"}


class Automaton:
    """The grammar as tables over (state, class)."""

    def __init__(self, weights: Mapping[str, float]):
        g = grammar(weights)
        if any(not symbol for _, symbol in g.arcs):
            raise ValueError("an arc reads nothing")
        states = {s: k for k, s in enumerate([g.start, *sorted({a for a, _ in g.arcs} - {g.start}, key=str)])}
        shape = (len(states), len(SYMBOLS))
        self.next, self.match, self.weight = np.zeros(shape, np.int64), np.full(shape, len(MATCHES)), np.ones(shape)
        for (state, symbol), (written, weight, after) in g.arcs.items():
            at = states[state], SYMBOLS.index(symbol)
            self.next[at], self.weight[at] = states[after], weight
            if written:
                self.match[at] = MATCHES.index(written)

    def run(self, classes: np.ndarray, lexical: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Over clauses (their classes one after another, breaks included): the weights of what each writes, by match, and the score."""
        order = np.argsort(-lens, kind="stable")
        begin = (np.cumsum(lens) - lens)[order]
        found, score = np.zeros((len(lens), len(MATCHES) + 1)), np.zeros(len(lens))
        state = np.zeros(len(lens), np.int64)
        active = len(lens) - np.searchsorted(lens[order][::-1], np.arange(lens.max() if len(lens) else 0), side="right")
        for t, n in enumerate(active.tolist()):
            at, who = begin[:n] + t, order[:n]
            c = classes[at]
            match = self.match[state[:n], c]
            hit = np.flatnonzero(match < len(MATCHES))
            if len(hit):
                lex = lexical[at[hit]]
                found[who[hit], match[hit]] += lex
                score[who[hit]] += lex * self.weight[state[hit], c[hit]]
            state[:n] = self.next[state[:n], c]
        return found[:, :-1], score


_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;:,|()\"\n\r"]] = True
_WORD_GAP = np.ones(256, bool)
_WORD_GAP[ord("a") : ord("z") + 1] = False
_WORD_GAP[128:] = False


def fold_case(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the two-byte capitals À-Þ lower-cased."""
    low = kernel.LOWER[data]
    if len(low) > 1:
        high = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][high] += 32
    return low


def _gaps(low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where no word is: all but letters; apostrophes too, but for the one of n't at a word's end."""
    gap = _WORD_GAP[low]
    curly = np.flatnonzero(low[:-2] == 0xE2) if len(low) > 2 else np.zeros(0, np.int64)
    curly = curly[(low[curly + 1] == 0x80) & ((low[curly + 2] == 0x98) | (low[curly + 2] == 0x99))]
    for j in range(3):
        gap[curly + j] = True
    row = lambda at: np.searchsorted(offsets, at, side="right")
    for at, size in ((np.flatnonzero(low == ord("'")), 1), (curly, 3)):
        at = at[(at > 0) & (at + size < len(low))]
        at = at[(low[at - 1] == ord("n")) & (low[at + size] == ord("t")) & (row(at - 1) == row(at + size))]
        after = at + size + 1
        inner = after < len(low)
        ends = ~inner | (row(np.minimum(after, len(low) - 1)) != row(at)) | gap[np.minimum(after, len(low) - 1)]
        for j in range(size):
            gap[at[ends] + j] = False
    return gap


def token_hashes(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Starts, rows, hash of each word of letters, and of its stems (0 where the word is shorter)."""
    starts, ends, rows = kernel.word_bounds(_gaps(low, offsets), offsets)
    symbols = kernel.BYTE_VALUE[low]
    whole = kernel.range_hash(symbols, starts, ends)
    stems = {}
    for k in STEMS:
        h = np.full(len(starts), np.uint64(k))
        for j in range(k):
            h += symbols[np.minimum(starts + j, max(0, len(low) - 1))] * kernel.SHINGLE_VALUE[8 + j] if len(low) else np.uint64(0)
        h = kernel.mix(h)
        h[ends - starts < k] = 0
        stems[k] = h
    return starts, rows, whole, stems


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return token_hashes(fold_case(data), np.array([0, len(data)]))[2]


@dataclass
class Lexicon:
    """Sorted hashes with class and weight; the grammar's weights; and the regression, or the share of label 1 where nothing could be learned."""

    hashes: np.ndarray
    classes: np.ndarray
    weights: np.ndarray
    arcs: Mapping[str, float]
    logistic: np.ndarray | None = None
    prior: float | None = None

    @classmethod
    def of(cls, insults: dict[int, float]) -> Lexicon:
        table: dict[int, tuple[int, float]] = {}
        for kind, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)):
            table |= {h: (kind, 1.0) for h in _hash_words(words).tolist()}
        table |= {h: (INSULT, w) for h, w in insults.items()}
        keys = sorted(table)
        return cls(np.array(keys, np.uint64), np.array([table[k][0] for k in keys], np.int8), np.array([table[k][1] for k in keys]), PRIOR)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return np.where(hit, self.classes[at], OTHER), np.where(hit, self.weights[at], 1.0)


def classify(lexicon: Lexicon, whole: np.ndarray, stems: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Class and weight of each word; of an insult's form and stems, the greatest weight. Only insults have other weights than 1."""
    classes, weights = lexicon.look_up(whole)
    weights = np.where(classes == INSULT, weights, 0.0)
    for h in stems.values():
        c, w = lexicon.look_up(h)
        better = (c == INSULT) & (w > weights)
        classes, weights = np.where(better, INSULT, classes), np.where(better, w, weights)
    return classes, np.where(classes == INSULT, weights, 1.0)


def text_features(lexicon: Lexicon, automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: log of the clause scores' sum, largest clause score, matched clauses, insults, lowered ones, threats, share of words that are insults; and the weights by match."""
    texts = len(offsets) - 1
    out, matches = np.zeros((texts, FEATURES)), np.zeros((texts, len(MATCHES)))
    low = fold_case(data)
    starts, rows, whole, stems = token_hashes(low, offsets)
    if not len(starts):
        return out, matches
    classes, weights = classify(lexicon, whole, stems)
    row = np.searchsorted(rows, np.arange(len(starts)), side="right") - 1
    clause = np.cumsum(_BREAK[low])[starts]
    fresh = np.concatenate([[True], (clause[1:] != clause[:-1]) | (row[1:] != row[:-1])])
    number = np.cumsum(fresh) - 1
    scored = np.isin(classes, (INSULT, THREAT))
    wanted = np.zeros(number[-1] + 1, bool)
    wanted[number[scored]] = True
    # other words beyond the reach of a negation change nothing
    index = np.arange(len(starts))
    mark = np.maximum.accumulate(np.where(fresh | (classes != OTHER), index, 0))
    use = np.flatnonzero(wanted[number] & (index - mark <= NEGATION_REACH))
    if not len(use):
        return out, matches
    of = number[use]
    edge = np.flatnonzero(np.append(of[1:] != of[:-1], True))  # the last word of each clause
    lens = np.diff(np.concatenate([[-1], edge])) + 1
    tape, lexical = np.insert(classes[use], edge + 1, END), np.insert(weights[use], edge + 1, 1.0)
    found, score = automaton.run(tape, lexical, lens)
    at = row[use[edge]]
    counts = found > 0
    np.add.at(matches, at, found)
    np.add.at(out[:, 0], at, score)
    np.maximum.at(out[:, 1], at, score)
    np.add.at(out[:, 2], at, counts.any(axis=1))
    np.add.at(out[:, 3], row, classes == INSULT)
    np.add.at(out[:, 4], at, counts[:, _LOWERED].any(axis=1))
    np.add.at(out[:, 5], at, counts[:, _THREATS].any(axis=1))
    out[:, 6] = out[:, 3] / np.maximum(1, rows[1:] - rows[:-1])
    out[:, [0, 2, 3, 4, 5]] = np.log1p(out[:, [0, 2, 3, 4, 5]])
    return out, matches


_LOWERED = [k for k, m in enumerate(MATCHES) if "-" in m or "r" in m]
_THREATS = [k for k, m in enumerate(MATCHES) if m[0] == "T"]


def learn_insults(sample: DataFrame, min_texts: int = 5, min_log_odds: float = 3.0, max_forms: int = 20_000) -> dict[int, float]:
    """Forms and stems with their weights, from (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in kernel.text_chunks(batch.column(0)):
                _, rows, whole, stems = token_hashes(fold_case(data), offsets)
                row = np.searchsorted(rows, np.arange(len(whole)), side="right") - 1
                forms = np.concatenate([whole, *stems.values()])
                pairs = np.unique(np.stack([forms, np.tile(row, 1 + len(stems)).astype(np.uint64)]), axis=1) if len(forms) else np.zeros((2, 0), np.uint64)
                pairs = pairs[:, pairs[0] != 0]
                form, at = np.unique(pairs[0], return_inverse=True)
                toxic = np.bincount(at, weights=label[i:j][pairs[1].astype(np.int64)], minlength=len(form))
                total = np.bincount(at, minlength=len(form))
                yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(form)), pa.array(toxic.astype(np.int64)), pa.array(total.astype(np.int64))], ["form", "toxic", "total"])

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    counts = sample.select("text", "label").mapInArrow(count, "form long, toxic long, total long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
    odds = F.log(((F.col("toxic") + 0.5) / (pos + 1)) / ((F.col("total") - F.col("toxic") + 0.5) / (neg + 1)))
    rows = counts.where(F.col("toxic") >= min_texts).withColumn("odds", odds).where(F.col("odds") >= min_log_odds).orderBy(F.desc("odds"), "form").limit(max_forms).collect()
    return {r["form"] & ((1 << 64) - 1): float(r["odds"]) for r in rows}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method; the first weight is the constant's."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty @ w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, grad)
    return w


def fit_arcs(matches: np.ndarray, y: np.ndarray, ridge: float = 2.0, rounds: int = 300, rate: float = 0.03) -> dict[str, float]:
    """Weights of the arcs, whose products are the matches' weights: logistic regression on the log of a text's score, by Adam, held near PRIOR."""
    names = list(PRIOR)
    has = np.array([[_FACTORS[n] in m for n in names] for m in MATCHES], float)
    first = np.log([PRIOR[n] for n in names])
    theta = np.concatenate([first, [-3.0, 1.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w = np.exp(has @ theta[:-2])
        score = matches @ w
        x = np.log1p(score)
        err = 1 / (1 + np.exp(-np.clip(theta[-2] + theta[-1] * x, -30, 30))) - y
        inner = ((err * theta[-1] / (1 + score)) @ (matches * w)) @ has
        grad = np.concatenate([inner + ridge * (theta[:-2] - first), [err.sum(), err @ x]]) / len(y)
        m += 0.1 * (grad - m)
        v += 0.001 * (grad**2 - v)
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return dict(zip(names, np.exp(theta[:-2]).tolist(), strict=True))


def _features_of(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, matches and labels of the sample's rows, in the order of their identifiers."""
    automaton = Automaton(lexicon.arcs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in kernel.text_chunks(batch.column(1)):
                f, m = text_features(lexicon, automaton, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.hstack([f, m]).tolist(), pa.list_(pa.float64())), batch.column(2).slice(i, j - i)], ["doc_id", "f", "label"])

    rows = sorted(sample.select("doc_id", "text", "label").mapInArrow(features, "doc_id long, f array<double>, label int").collect(), key=lambda r: r["doc_id"])
    x = np.array([r["f"] for r in rows])
    return x[:, :FEATURES], x[:, FEATURES:], np.array([r["label"] for r in rows], float)


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Column, max_rows: int = 8000, max_bytes: int = 32 << 20, label_col: str = "toxic") -> Lexicon:
    sample = scratch.materialise(training.labelled_sample(docs, labels, label_col, use, max_rows, max_bytes), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return replace(Lexicon.of({}), prior=float((sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)))
    lexicon = Lexicon.of(learn_insults(sample))
    _, matches, y = _features_of(sample, lexicon)
    lexicon = replace(lexicon, arcs=fit_arcs(matches, y))
    features, _, y = _features_of(sample, lexicon)
    return replace(lexicon, logistic=fit_logistic(features, y))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its score and figures: (doc_id, score, clauses, insults, strongest)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = own.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("clauses"), F.lit(0).alias("insults"), F.lit(0.0).alias("strongest")).schema
    automaton = Automaton(lexicon.arcs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [text_features(lexicon, automaton, data, offsets)[0] for _, _, data, offsets in kernel.text_chunks(batch.column(1))]
            f = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
            if lexicon.logistic is None:
                p = np.full(len(f), lexicon.prior)
            else:
                p = 1 / (1 + np.exp(-np.clip(lexicon.logistic[0] + f @ lexicon.logistic[1:], -30, 30)))
            counts = np.round(np.expm1(f[:, 2:4])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(counts[:, 0].copy()), pa.array(counts[:, 1].copy()), pa.array(f[:, 1].copy())], [x.name for x in out])

    return own.mapInArrow(score, out)
