"""Substring dedup over sliding spans of sentences.

A sentence ends after [.!?] before white space, or at a line's end. Every run of RUN consecutive sentences is a span, however
few its words. So that passages of fewer, longer sentences are caught too, the shortest run of whole sentences with at least
MIN_WORDS words that begins with a sentence is a span, and the shortest that ends with it; every sentence of a repeated
passage of RUN sentences or MIN_WORDS words lies in a span within the passage, so it is caught from its first
whole sentence to its last one. A text with fewer words and sentences is one span as a whole. A span's words are hashed
in order (two 64-bit hashes), so it depends on nothing around it. The first of equal spans stays, by (doc_id, text hash,
position), and sentences that a later one covers are removed. Spans are judged on the input.

Hashing is vectorised over Arrow batches; counting spans combines in the map tasks, only repeated spans are joined back, and
cutting texts needs one row per document with its merged intervals.

Edge cases: null and empty texts have no span; texts with fewer words and sentences are compared as a whole only; rows with equal
doc_id and text count as one document; rows without doc_id come last in the order; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailknit.llm import common
from trailknit.llm.common import BASE, SPACE, U64, mix

RUN, MIN_WORDS = 5, 20
UNTURN = U64(pow(int(BASE), -1, 1 << 64))
PART = 1 << 16
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


def sentences(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start byte, end byte with the white space after, first word, words' starts, words' ends, first sentence of each text)."""
    start, end, first = common.words(raw, off)
    n = len(start)
    if not n:
        return start, end, start, start, end, np.zeros(len(off), np.int64)
    last = STOP[raw[end - 1]]
    newline = np.concatenate([[0], np.cumsum(raw == 10)])
    next_start = np.append(start[1:], len(raw))
    closes = last | (newline[next_start] > newline[end])
    closes[first[1:][np.diff(first) > 0] - 1] = True
    begin = np.concatenate([[0], np.flatnonzero(closes[:-1]) + 1])
    at = start[begin].copy()
    first_sentence = np.searchsorted(begin, first)
    whole = first_sentence[:-1][np.diff(first_sentence) > 0]
    at[whole] = off[:-1][np.diff(first_sentence) > 0]
    stop = np.append(at[1:], len(raw))
    stop[first_sentence[1:][np.diff(first_sentence) > 0] - 1] = off[1:][np.diff(first_sentence) > 0]
    return at, stop, begin, start, end, first_sentence


def spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start byte, end byte, hash, other hash) of all runs of RUN sentences, the shortest passages of MIN_WORDS words from and up to each sentence, and short texts."""
    at, stop, begin, start, stop_word, first_sentence = sentences(raw, off)
    m = len(at)
    if not m:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first_sentence))
    word_end = np.append(begin[1:], len(start))
    each = np.arange(m)
    last = np.searchsorted(word_end, begin + MIN_WORDS)
    ahead = last < first_sentence[1:][text]
    head = np.searchsorted(begin, word_end - MIN_WORDS, side="right") - 1
    # a passage that is the shortest both ways is one span
    behind = (head >= first_sentence[:-1][text]) & (last[np.maximum(head, 0)] != each)
    several = each + RUN - 1 < first_sentence[1:][text]
    # a run that is such a passage too is one span
    several &= ~(ahead & (last == each + RUN - 1))
    end = np.minimum(each + RUN - 1, m - 1)
    several &= ~(behind[end] & (head[end] == each))
    some = np.flatnonzero(np.diff(first_sentence))
    one, end_one = first_sentence[some], first_sentence[some + 1] - 1
    short = (word_end[end_one] - begin[one] < MIN_WORDS) & (end_one - one < RUN - 1)
    lo = np.concatenate([each[ahead], head[behind], each[several], one[short]])
    hi = np.concatenate([last[ahead], each[behind], end[several], end_one[short]])
    a, z = begin[lo], word_end[hi]
    h = common.span_hash(raw, start, stop_word)
    turn = common.powers(len(h))[: len(h)]
    back = np.full(len(h) + 1, UNTURN, U64)
    back[0] = 1
    back = np.cumprod(back, dtype=U64)

    def hashed(word: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, U64), np.cumsum(word * turn, dtype=U64)])
        return mix((total[z] - total[a]) * back[a])

    return text[lo], at[lo], stop[hi], hashed(h), hashed(mix(h ^ U64(0x5851F42D4C957F2D)))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z in common.chunks(batch):
            raw, off = common.text_bytes(batch.column("text").slice(a, z - a))
            text, start, stop, h1, h2 = spans(raw, off)
            take = pa.array(text + a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(start - off[text]), pa.array(stop - off[text]), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["doc_id", "text_key", "start", "stop", "h1", "h2"])


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def islands(start: np.ndarray, stop: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, start, stop) of the unions of touching intervals within groups; rows are sorted by group (which rises) and start."""
    if not len(start):
        return np.empty(0, np.int64), start, stop
    step = int(stop.max()) + 2
    reach = np.maximum.accumulate(stop + group * step)
    first = np.flatnonzero(np.concatenate([[True], (start + group * step)[1:] > reach[:-1]]))
    last = np.append(first[1:] - 1, len(start) - 1)
    return first, start[first], reach[last] - group[last] * step


MERGED = "doc_id long, text_key long, part long, start long, stop long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unions of a document's spans within each part of it, from rows sorted by document, part and start; one union is held back."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        keys = [pc.fill_null(table.column(0), -(1 << 63)).to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy(), pc.is_null(table.column(0)).to_numpy()]
        change = np.zeros(table.num_rows, np.int64)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        first, start, stop = islands(table.column(3).to_numpy(), table.column(4).to_numpy(), np.cumsum(change))
        out = table.take(pa.array(first)).set_column(3, "start", pa.array(start)).set_column(4, "stop", pa.array(stop))
        held = out.slice(out.num_rows - 1)
        yield from out.slice(0, out.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in common.chunks(batch):
            part = batch.slice(lo, hi - lo)
            gone = part.column("gone")
            offsets = gone.offsets.to_numpy()
            ends = [gone.values.field(i).to_numpy() for i in range(2)]
            none = gone.is_null().to_numpy(zero_copy_only=False)
            texts, removed, counts, sizes = [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                raw = (text or "").encode()
                a, z = (np.empty(0, np.int64) if none[i] else e[offsets[i] : offsets[i + 1]] for e in ends)
                order = np.argsort(a, kind="stable")
                _, start, stop = islands(a[order], z[order], np.zeros(len(a), np.int64))
                at, kept = 0, []
                for s, e in zip(start.tolist(), stop.tolist(), strict=True):
                    kept.append(raw[at:s])
                    at = e
                texts.append(b"".join([*kept, raw[at:]]).decode() if len(start) else text)
                sizes.append(len(raw))
                removed.append(int((stop - start).sum()))
                counts.append(len(start))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "text", "n_bytes", "n_removed", "n_spans"])


def dedup_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_bytes, n_removed, n_spans): the text without repeated spans, its bytes before, bytes removed, runs removed."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key().alias("text_key"), "text")
    found = texts.mapInArrow(_spans, "doc_id long, text_key long, start long, stop long, h1 long, h2 long")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("tk"), F.col("start").alias("at"))
    # a table of its own: a join of two plain shuffles is one whose hot partitions Spark can split
    shared = common.cut(found.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "span-shared")
    repeated = common.cut(found.join(shared, ["h1", "h2"]), "span-repeats")
    first = common.cut(repeated.groupBy("h1", "h2").agg(F.min(order).alias("first")), "span-first")
    later = repeated.join(first, ["h1", "h2"]).where(order > F.col("first"))
    # spans overlap much: they are united in parts of PART bytes, so that neither a task nor a row holds more than that has
    placed = later.select("doc_id", "text_key", F.floor(F.col("start") / PART).cast("long").alias("part"), "start", "stop")
    united = placed.repartition("doc_id", "text_key", "part").sortWithinPartitions("doc_id", "text_key", "part", "start").mapInArrow(_merge, MERGED)
    gone = united.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__tk")).agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    out = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__tk")), "left").select("doc_id", "text", "gone")
    return out.mapInArrow(_cut, "doc_id long, text string, n_bytes long, n_removed long, n_spans long")
