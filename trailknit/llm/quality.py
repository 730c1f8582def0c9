"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is described by how its words and bytes look (lengths,
repetition, letter cases, symbols, what words begin and end with; no vocabulary), and encoded by a layer. Gated
attention gives every passage a weight within its document, learnt from document labels alone; the weighted mean
of the encoded passages gives the document's score. Weights and encoder are trained together by gradient descent.

The model is fitted on `max_train` labelled documents and MAX_BYTES of their texts at most (documented bounds; documents come
in the order of a hash of doc_id, which is no input of a score); all documents are scored over all their passages.

Edge cases: null and empty texts are one passage without words; null labels are ignored, of several labels of a document
the highest counts; a row without doc_id is scored and is not held out; without labelled documents of both classes every
score is the share of good ones (0.5 without any labels); repeated rows get equal answers; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailknit.llm import common, toxicity
from trailknit.llm.common import U64

PASSAGE = 50
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY = 200, 0.03, 1e-4
MAX_TRAIN, MAX_BYTES = 4000, 64 << 20
CLASSES = 13


def _classes() -> np.ndarray:
    kind = np.full(256, 8, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 11, 10, 9, 12
    for k, some in enumerate((b" \t\r\x0b\x0c\n", b".", b",", b"!", b"?", b";:", b"|", b"#$%&*")):
        kind[list(some)] = k
    return kind


KIND = _classes()
FEATURES = 3 * CLASSES + 9


def passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each text)."""
    start, end, first = common.words(raw, off)
    n = np.diff(first)
    count = np.maximum(1, -(-n // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(count)])
    p = int(begin[-1])
    out = np.zeros((p, FEATURES))
    if not len(start):
        return out, begin
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(start)) - first[text]
    own = begin[text] + place // PASSAGE
    h = common.span_hash(raw, start, end)
    size = (end - start).astype(float)
    words = np.bincount(own, minlength=p).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(own, size, p) / some
    same = lambda k: np.bincount(own[k:], (h[k:] == h[:-k]) & (own[k:] == own[:-k]), p) / some if len(h) > k else np.zeros(p)
    head = np.flatnonzero(np.diff(own, prepend=-1))
    bits = np.zeros(p, U64)
    bits[own[head]] = np.bitwise_or.reduceat(U64(1) << (h & U64(63)), head)
    stop = np.append(start[1:], len(raw))
    last = first[1:][n > 0] - 1
    stop[last] = off[1:][n > 0]
    span = (stop - start).astype(np.int64)
    total = int(span.sum())
    at = np.arange(total) - np.repeat(np.cumsum(span) - span, span) + np.repeat(start, span)
    bytes_ = np.bincount(np.repeat(own, span) * CLASSES + KIND[raw[at]], minlength=p * CLASSES).reshape(p, CLASSES)
    newlines = np.bincount(np.repeat(own, span), raw[at] == 10, p)
    out[:, :CLASSES] = bytes_ / np.maximum(1, bytes_.sum(1))[:, None]
    out[:, CLASSES : 2 * CLASSES] = np.bincount(own * CLASSES + KIND[raw[end - 1]], minlength=p * CLASSES).reshape(p, CLASSES) / some[:, None]
    out[:, 2 * CLASSES : 3 * CLASSES] = np.bincount(own * CLASSES + KIND[raw[start]], minlength=p * CLASSES).reshape(p, CLASSES) / some[:, None]
    more = (mean / 10, np.sqrt(np.maximum(0, np.bincount(own, size * size, p) / some - mean * mean)) / 5, same(1), same(2), same(3), np.bitwise_count(bits) / np.minimum(some, 64), newlines / some, np.bincount(own, size >= 12, p) / some, np.log1p(words) / 4)
    out[:, 3 * CLASSES :] = np.stack(more, 1)
    return out, begin


# ---------------------------------------------------------------- model


def _forward(w: dict, x: np.ndarray, begin: np.ndarray) -> tuple:
    bag = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    h = np.tanh(x @ w["w"] + w["b"])
    t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    e = (t * g) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, begin[:-1])[bag])
    alpha = e / np.add.reduceat(e, begin[:-1])[bag]
    z = np.add.reduceat(alpha[:, None] * h, begin[:-1], axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return bag, h, t, g, alpha, z, p


def _gradient(w: dict, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict:
    bag, h, t, g, alpha, z, p = _forward(w, x, begin)
    d = (p - y) / len(y)
    dz = d[:, None] * w["c"]
    s = (dz[bag] * h).sum(1)
    de = alpha * (s - np.add.reduceat(alpha * s, begin[:-1])[bag])
    dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
    dh = (alpha[:, None] * dz[bag] + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
    return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ d, "d": d.sum(keepdims=True)}


def train(x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict:
    """Adam over all bags at once, from fixed starting weights."""
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / spread
    rng = np.random.default_rng(5)
    shape = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    w = {k: rng.normal(0, 0.3 / np.sqrt(s[0]), s) for k, s in shape.items()}
    m, v = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}
    for step in range(1, STEPS + 1):
        for k, grad in _gradient(w, x, begin, y).items():
            grad = grad + DECAY * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w | {"mean": mean, "spread": spread}


def predict(w: dict, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.full(len(begin) - 1, w["constant"]) if "constant" in w else _forward(w, (x - w["mean"]) / w["spread"], begin)[-1]


# ---------------------------------------------------------------- over tables


def training_fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 != 2


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in common.chunks(batch):
            x, begin = passages(*common.text_bytes(batch.column("text").slice(lo, hi - lo)))
            x = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(lo, hi - lo), pa.array([x[a:z].tobytes() for a, z in zip(begin[:-1], begin[1:], strict=True)], pa.binary())], ["quality", "bag"])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    rows = toxicity.train_rows(docs, labels, "quality", training_fold(), max_train, "quality-train", MAX_BYTES)
    # sorted, so that sums come out alike whatever task ends first
    found = sorted(rows.mapInArrow(_bags, "quality int, bag binary").collect(), key=lambda r: (r["quality"], bytes(r["bag"])))
    y = np.array([r["quality"] for r in found], float)
    if len(set(y.tolist())) < 2:
        return {"constant": min(0.98, max(0.02, float(y.mean()))) if len(y) else 0.5}
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in found]
    return train(np.concatenate(bags).astype(float), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def _scored(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.chunks(batch):
                x, begin = passages(*common.text_bytes(batch.column("text").slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(predict(model, x, begin), pa.float64()), pa.array(np.diff(begin))], ["doc_id", "score", "n_passages"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, n_passages) of each row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(model), "doc_id long, score double, n_passages long")
