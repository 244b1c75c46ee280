"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole of it.
A byte's input is its learned embedding. Learned filters run over each chunk's
input and are max-pooled; a learned layer of UNITS values follows per chunk, and
the mean and the maximum of the chunks' values are combined into one probability. Training (Adam, on the driver) uses a bounded
sample of labelled rows: about ``max_rows`` by hash, of which those in hash order
whose texts sum up to ``max_bytes``; the bound is kept before rows are collected.
Scoring reads all bytes of all texts.

Defined results: null text counts as empty; an empty text is one chunk of zero
bytes and gets a score; equal texts have equal scores; a null identifier is
passed through; labels that are null are not learned from; without labels of
both kinds the score is the smoothed share of label 1; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernel, training

CHUNK, STEP = 128, 96
WIDTH, HOP = 8, 2
EMBED, FILTERS, UNITS = 8, 24, 16
_POSITIONS = (CHUNK - WIDTH) // HOP + 1


def chunk_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of chunks of each text, and each chunk's start in its text."""
    n = np.maximum(1, -(-(sizes - CHUNK) // STEP) + 1)
    first = np.repeat(np.cumsum(n) - n, n)
    return n, (np.arange(n.sum()) - first) * STEP


def chunk_matrix(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of chunks from ``begin``, zero from ``end`` on."""
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


class ByteConvNet:
    def __init__(self, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "dense": rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, UNITS)).astype(np.float32),
            "lift": np.zeros(UNITS, np.float32),
            "out": rng.normal(0, 0.1, 2 * UNITS).astype(np.float32),
            "offset": np.zeros(1, np.float32),
        }

    def pooled(self, chunks: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max-pooled, rectified filter values of each chunk (and the pooled positions)."""
        filters = self.p["filters"].reshape(WIDTH, EMBED, FILTERS)
        conv = np.zeros((len(chunks), _POSITIONS, FILTERS), np.float32)
        for j in range(WIDTH):  # a filter's value for a byte at j is looked up
            conv += np.take(self.p["embed"] @ filters[j], chunks[:, j : j + HOP * _POSITIONS - HOP + 1 : HOP], axis=0)
        top = np.maximum(conv.max(axis=1) + self.p["bias"], 0)
        return top, conv.argmax(axis=1) if where else None

    def combine(self, top: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of each chunk, features of texts of ``n`` chunks each, and their logits."""
        first = np.cumsum(n) - n
        units = np.maximum(top @ self.p["dense"] + self.p["lift"], 0)
        feats = np.hstack([np.add.reduceat(units, first, axis=0) / n[:, None], np.maximum.reduceat(units, first, axis=0)])
        return units, feats, feats @ self.p["out"] + self.p["offset"][0]

    def scores(self, data: np.ndarray, offsets: np.ndarray, block: int = 256) -> np.ndarray:
        sizes = offsets[1:] - offsets[:-1]
        n, starts = chunk_starts(sizes)
        begin, end = starts + np.repeat(offsets[:-1], n), np.repeat(offsets[1:], n)
        top = np.concatenate([self.pooled(chunk_matrix(data, begin[i : i + block], end[i : i + block]))[0] for i in range(0, len(begin), block)])
        return 1 / (1 + np.exp(-np.clip(self.combine(top, n)[2].astype(np.float64), -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, min_steps: int = 200, batch: int = 64, rate: float = 0.004, seed: int = 17) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        self.p["offset"][0] = np.log(share / (1 - share))
        for _ in range(max(epochs, -(-min_steps * batch // len(texts)))):  # a small sample is gone over more often
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                data = np.frombuffer(b"".join(texts[j] for j in own), np.uint8)
                offsets = np.concatenate([[0], np.cumsum([len(texts[j]) for j in own])])
                n, starts = chunk_starts(offsets[1:] - offsets[:-1])
                chunks = chunk_matrix(data, starts + np.repeat(offsets[:-1], n), np.repeat(offsets[1:], n))
                parts = [self.pooled(chunks[a : a + 256], True) for a in range(0, len(chunks), 256)]
                top, where = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                units, feats, logit = self.combine(top, n)
                err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[own]).astype(np.float32) / len(own)
                g_feats = err[:, None] * self.p["out"]
                row = np.repeat(np.arange(len(own)), n)
                is_max = units == feats[row, UNITS:]
                g_units = (g_feats[row, :UNITS] / n[row, None] + g_feats[row, UNITS:] * is_max) * (units > 0)
                g_top = (g_units @ self.p["dense"].T) * (top > 0)
                c, f = np.nonzero(g_top)
                g = g_top[c, f]
                spot = where[c, f][:, None] * HOP + np.arange(WIDTH)
                taps = chunks[c[:, None], spot]
                seen = self.p["embed"][taps]
                grads = {"out": feats.T @ err, "offset": err.sum(keepdims=True), "bias": g_top.sum(axis=0), "dense": top.T @ g_units, "lift": g_units.sum(axis=0)}
                flat = seen.reshape(len(c), -1)
                grads["filters"] = np.stack([g[f == k] @ flat[f == k] for k in range(FILTERS)], axis=1)
                back = (g[:, None] * self.p["filters"].T[f]).reshape(-1, EMBED)
                grads["embed"] = np.stack([np.bincount(taps.ravel(), weights=back[:, k], minlength=256) for k in range(EMBED)], axis=1).astype(np.float32)
                step += 1
                for k, v in self.p.items():
                    m, q = state[k]
                    m += 0.1 * (grads[k] - m)
                    q += 0.001 * (grads[k] ** 2 - q)
                    v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, use: Column, max_rows: int = 3000, max_bytes: int = 6 << 20, label_col: str = "quality") -> ByteConvNet | float:
    """The network, or a constant score where labels are of one kind or missing."""
    by_id = {r["doc_id"]: (r["text"].encode(), r["label"]) for r in training.labelled_sample(docs, labels, label_col, use, max_rows, max_bytes).collect()}
    rows = [by_id[i] for i in training.in_hash_order(list(by_id))]
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    return ByteConvNet().fit([r[0] for r in rows], y)


def score_quality(docs: DataFrame, model: ByteConvNet | float, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its score: (doc_id, score), and the columns in ``keep`` unchanged."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c) for c in keep])
    out = own.select("doc_id", F.lit(0.0).alias("score"), *keep).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                got = [np.full(batch.num_rows, model)]
            else:
                got = [model.scores(data, offsets) for _, _, data, offsets in kernel.text_chunks(batch.column(1))]
            arrays = [batch.column(0), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in out])

    return own.mapInArrow(score, out)
