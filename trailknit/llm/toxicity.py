"""Toxicity by maximum-scoring segments of token log-odds.

Each word has a log-odds of toxic against clean documents under Dirichlet priors: the prior of a word comes from the words
that share its first letters (as many letters as enough words share), the prior of these from all words, and a score
is the lower confidence bound less a fixed offset, so ordinary text drifts down. A word counts once for each pair of
neighbours, and as toxic only if no clean document has it so; copied passages thus count once. Two thirds of the sample,
by a hash of the text, fit the words; the rest fits the calibration. A linear-time scan finds every maximal segment of positive score (all of them,
not only the best). Extreme-value statistics turn a segment's score S in a text of n words into x = L * S - ln(K * n),
the negative log of the number of such segments expected by chance; L and K are estimated on clean labelled documents.
A document's evidence is the sum over its significant segments, or the best x; a logistic curve makes it a probability.

The model is fitted on `max_train` labelled documents and MAX_BYTES of their texts at most (documented bounds, which also bound
what the driver collects; documents come in the order of a hash of doc_id, which is no input of a score). The word
table it sends to the executors has only words and prefixes with evidence of toxicity in that sample. All documents are scored over their whole text.

Edge cases: null and empty texts score low (no segments); null labels are ignored, of several labels of a document the
highest counts; a row without doc_id is scored and is not held out; without labelled documents of both classes in both
parts of the sample every score is the share of toxic ones, from 0.02 to 0.49, so that nothing is rejected without evidence (0.02 without any labels); repeated rows get equal answers; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailknit.llm import common

WORD = re.compile(r"[^\W\d_]+")
STEMS, ENOUGH = (8, 7, 6, 5, 4), 4
OFFSET, CAP = 1.5, 8.0
CONFIDENCE = 2.0
PRIOR = 1.0
MAX_TRAIN, MAX_BYTES = 16_000, 96 << 20
FLOOR, CEILING = -20.0, 60.0
MEMO = 200_000


@dataclass
class Model:
    """words and prefixes: scores above -OFFSET. slope, height: of the logistic curve. scale, rate: L and K."""

    words: dict = field(default_factory=dict)
    prefixes: dict = field(default_factory=dict)
    scale: float = 1.0
    rate: float = 0.1
    slope: float = 0.0
    height: float = 0.0

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.height))))


class Scores(dict):
    """Scores of words met so far; bounded."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        s = self.model.words.get(word)
        if s is None:
            s = next((v for k in STEMS if len(word) > k and (v := self.model.prefixes.get(word[:k])) is not None), -OFFSET)
        if len(self) > MEMO:
            self.clear()
        self[word] = s
        return s


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, in time linear in the number of scores.

    Each candidate keeps the running total before and after it; a new positive item is merged leftwards with the nearest
    candidate whose total before is lower, if that one's total after is also lower than its own.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float]] = []
    under: list[int] = []  # for each candidate, the nearest earlier one with a lower total before it
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, before, after = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j = under[j]
            if j < 0 or kept[j][3] >= after:
                kept.append((start, end, before, after))
                under.append(j)
                break
            start, before = kept[j][0], kept[j][2]
            del kept[j:], under[j:]
    return [(a, z, float(y - x)) for a, z, x, y in kept]


def evidence(model: Model, segments: list[float], n: int) -> float:
    chance = math.log(max(model.rate * max(n, 1), 1e-9))
    x = [model.scale * s - chance for s in segments]
    strong = sum(v for v in x if v > 0)
    return min(CEILING, strong) if strong > 0 else max([FLOOR, *x])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (word, neighbours, toxic) for each word and pair of neighbours in a text."""
    for batch in batches:
        for a, z in common.chunks(batch):
            rows = []
            for text, toxic in zip(batch.column("text").slice(a, z - a), batch.column("toxic").slice(a, z - a).to_pylist(), strict=True):
                w = ["", *WORD.findall((text.as_py() or "").lower()), ""]
                rows += [(*x, toxic) for x in {(w[i], f"{w[i - 1]} {w[i + 1]}") for i in range(1, len(w) - 1)}]
            word, near, toxic = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(toxic, pa.int32())], ["word", "near", "toxic"])


def _observed(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = WORD.findall((text.as_py() or "").lower())
                s = np.fromiter(map(scores.__getitem__, found), float, len(found))
                rows.append((len(found), s[s > -OFFSET].tolist(), [x for *_, x in maximal_segments(s)]))
            n, raised, segments = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n, pa.int64()), pa.array(raised, pa.list_(pa.float64())), pa.array(segments, pa.list_(pa.float64()))], ["toxic", "n", "raised", "segments"])

    return run


def _root(steps: Counter, most: float = 3.0) -> float:
    """The positive L with the mean of exp(L * score) equal to 1; at most `most`."""
    total = sum(steps.values())
    mean = lambda x: sum(c * math.exp(x * s) for s, c in steps.items()) / total
    low, high = 0.05, most
    if not total or mean(high) < 1:
        return most
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and height by Newton steps, with a weak normal prior."""
    w = np.array([0.1, 0.0])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 0.05 * w
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2), grad)
        w = np.clip(w, [0.0, -60], [20, 60])
    return float(w[0]), float(w[1])


def train_rows(docs: DataFrame, labels: DataFrame, column: str, fold: F.Column, max_train: int, name: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(text, label) of the first documents that are labelled and in the training fold, in the order of a 64-bit hash of doc_id.

    At most max_train documents and max_bytes of text: a document that would exceed the bytes is passed over. The bounds hold
    at any number of labels, and every number of labels gives a full sample.
    """
    spark = docs.sparkSession
    label = F.col(column).cast("int")
    known = labels.where(F.col("doc_id").isNotNull() & label.isin(0, 1) & fold).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias(column))
    there = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    # max_train rows at most, so small enough for a broadcast
    picked = common.cut(there.withColumn("hash", F.xxhash64("doc_id", F.lit(17))).orderBy("hash", "doc_id").limit(max_train), f"{name}-picked")
    rows = common.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id"), name)
    sizes = rows.groupBy("hash", "doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).collect()
    left, chosen = max_bytes, []
    for r in sorted(sizes):
        if r["size"] <= left:
            left -= r["size"]
            chosen.append((r["doc_id"],))
    if len(chosen) < len(sizes):
        rows = rows.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long")), "doc_id", "left_semi")
    return rows.select("text", column)


def lexicon(rows: list[tuple[str, int, int]], t0: int, t1: int) -> Model:
    """Scores of the words (word, clean places, toxic places) and of the letters that they begin with."""
    base = t1 / (t0 + t1)
    odds = math.log(t1 / t0)

    def bound(y0: float, y1: float, share: float) -> float:
        m0, m1 = y0 + PRIOR * (1 - share), y1 + PRIOR * share
        return min(CAP, math.log(m1 / m0) - odds - CONFIDENCE * math.sqrt(1 / (m0 + 0.5) + 1 / (m1 + 0.5)))

    stems: dict[str, list[int]] = {}
    for word, y0, y1 in rows:
        for k in STEMS:
            if len(word) > k:
                x = stems.setdefault(word[:k], [0, 0])
                x[0] += y0
                x[1] += y1
    model = Model()
    model.prefixes = {p: max(bound(*y, base), 0.0) - OFFSET for p, y in stems.items() if sum(y) >= ENOUGH}
    for word, y0, y1 in rows:
        near = next((stems[word[:k]] for k in STEMS if len(word) > k and sum(stems[word[:k]]) >= ENOUGH), None)
        share = (near[1] + PRIOR * base) / (sum(near) + PRIOR) if near else base
        if y0 + y1 >= ENOUGH or y0:
            model.words[word] = max(bound(y0, y1, share), 0.0) - OFFSET
    return model


def training_fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    train = train_rows(docs, labels, "toxic", training_fold(), max_train, "toxicity-train")
    learn, hold = train.where("pmod(xxhash64(text), 3) > 0"), train.where("pmod(xxhash64(text), 3) = 0")
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    p = min(0.49, max(0.02, sizes.get(1, 0) / sum(sizes.values()))) if sizes else 0.02
    blank = Model(height=math.log(p / (1 - p)))
    if len(sizes) < 2:
        return blank
    places = learn.mapInArrow(_occurrences, "word string, near string, toxic int").groupBy("word", F.xxhash64("near").alias("near")).agg(F.min("toxic").alias("toxic"))
    counts = common.cut(places.groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("y0"), F.sum("toxic").alias("y1")), "toxicity-words")
    t0, t1 = counts.agg(F.sum("y0"), F.sum("y1")).first()
    t0, t1 = max(1, t0 or 0), max(1, t1 or 0)
    shortest = STEMS[-1]
    counts = counts.withColumn("stem", F.when(F.length("word") > shortest, F.substring("word", 1, shortest)))
    stems = counts.where("stem is not null").groupBy("stem").agg(F.sum("y0").alias("p0"), F.sum("y1").alias("p1"))
    suspect = common.cut(stems.where(F.col("p1") * t0 > F.col("p0") * t1 * math.e).where(f"p1 >= {ENOUGH}"), "toxicity-stems")
    alone = counts.where(F.col("y1") * t0 > F.col("y0") * t1 * math.e).where(f"y1 >= {ENOUGH}").join(suspect, "stem", "left_anti")
    family = counts.join(suspect.select("stem"), "stem", "left_semi")
    model = lexicon([(r["word"], r["y0"], r["y1"]) for r in family.union(alone.select(*family.columns)).select("word", "y0", "y1").collect()], t0, t1)
    seen = hold.mapInArrow(_observed(model), "toxic int, n long, raised array<double>, segments array<double>").collect()
    if len({r["toxic"] for r in seen}) < 2:
        return blank
    clean = [r for r in seen if not r["toxic"]]
    steps = Counter(round(s, 2) for r in clean for s in r["raised"])
    words = sum(r["n"] for r in clean)
    steps[-OFFSET] += max(1, words - sum(steps.values()))
    model.scale = _root(steps)
    model.rate = (1 + sum(len(r["segments"]) for r in clean)) / (1 + words)
    x = np.array([evidence(model, r["segments"], r["n"]) for r in seen])
    model.slope, model.height = _logistic(x, np.array([r["toxic"] for r in seen], float))
    return model


def _scored(model: Model):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            p, passages = [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                found = WORD.findall(text.lower())
                s = np.fromiter(map(scores.__getitem__, found), float, len(found))
                segments = maximal_segments(s) if len(s) and s.max() > 0 else []
                p.append(model.probability(evidence(model, [v for *_, v in segments], len(found))))
                chance = math.log(max(model.rate * max(len(found), 1), 1e-9))
                strong = [(a, z, v) for a, z, v in segments if model.scale * v > chance]
                at = [m.span() for m in WORD.finditer(text.lower())] if strong else []
                passages.append([{"start": at[a][0], "end": at[z - 1][1], "score": v} for a, z, v in strong])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) of each row; passages are the significant segments, in code points of the lower-cased text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(model), "doc_id long, score double, passages array<struct<start:bigint,end:bigint,score:double>>")


def _clean(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = _scored(model)
        for batch in batches:
            scored = next(inner(iter([batch.select(["doc_id", "text"])])))
            yield batch.filter(pa.array(scored.column("score").to_numpy() < threshold))

    return run


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    return docs.mapInArrow(_clean(model, threshold), docs.schema)
