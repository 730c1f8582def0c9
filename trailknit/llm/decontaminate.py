"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item leaks into a document where a window of as many words as the item has (of the whole document, if that is
shorter) has a weighted similarity of THRESHOLD or more to it: the sum of the smaller counts of all five-word shingles over
the sum of the larger ones. Words are lower-cased (A-Z) runs of other than ASCII white space.

1. For a similarity of THRESHOLD, the shingles that a window and an item have in common are at least THRESHOLD / (1 + THRESHOLD)
   of both their shingles. A window is only worth a fingerprint where so many of its shingles occur anywhere in some item of
   its size, in whatever order (a sliding count over the places of such shingles). This sieve loses nothing, which a test
   holds against fingerprints of all windows, and leaves most text after one look-up a word.
2. Each window left gets a 256-bit SimHash of its weighted shingles. Of 32 blocks of 8 bits, two fingerprints within
   RADIUS (63) bits have one that differs in one bit at most, so an index of the items' blocks, asked for a window's 32 blocks
   and all values one bit off, returns every item of that size within the radius. A pair of similarity 0.8 lies 39 bits
   apart on average, with a standard deviation of 6, so the radius loses about one such window in 10^5.
3. The pairs within the radius are verified by the exact weighted similarity.

All items together are one pass over the documents as long as their texts have ITEM_BYTES at most; a larger benchmark is
broadcast in blocks of about so many bytes, one pass each, and the passes are cut by a table after every PASSES ones.
Documents are never shuffled.

Edge cases: null and empty texts match nothing, nor do empty items; items of fewer than five words are compared as one
shingle of their length; rows of documents stay in any case in find_leaks (extra columns too) and repeated rows get equal
answers; an empty benchmark leaves all documents clean; items without item_id are ignored.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailknit.llm import common
from trailknit.llm.common import LOWER, U64, mix

WORDS = 5
THRESHOLD = 0.8
LANES, BLOCKS, RADIUS = 4, 32, 63
ERRORS = RADIUS // BLOCKS
ITEM_BYTES, PASSES = 16 << 20, 4
LANE = common.stream(11, LANES)
SIEVE_BITS = 20
MASKS = np.array(sorted({sum(1 << i for i in c) for n in range(ERRORS + 1) for c in itertools.combinations(range(8), n)}), np.int64)
_indexes: dict[str, Index] = {}


def simhash(shingles: np.ndarray) -> np.ndarray:
    """LANES words of the SimHash of each row of shingle hashes (repeats count as often as they occur)."""
    out = np.zeros((len(shingles), LANES), U64)
    for lane in range(LANES):
        bits = np.unpackbits(mix(shingles ^ LANE[lane]).view(np.uint8).reshape(*shingles.shape, 8), axis=2, bitorder="little")
        major = 2 * bits.sum(1, dtype=np.int32) > shingles.shape[1]
        out[:, lane] = np.packbits(major, axis=1, bitorder="little").view(U64)[:, 0]
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


class Index:
    """The items of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.sizes, self.sets = [], [], []
        for item_id, text in items:
            raw, off = common.text_bytes(pa.array([text], pa.string()))
            raw = LOWER[raw]
            start, end, first = common.words(raw, off)
            if item_id is not None and len(start):
                self.ids.append(item_id)
                self.sizes.append(len(start))
                self.sets.append(common.shingles(common.span_hash(raw, start, end), first, min(WORDS, len(start)))[0])
        self.ids, self.sizes = np.array(self.ids, np.int64), np.array(self.sizes, np.int64)
        self.by_width = {}
        for k in sorted({min(WORDS, s) for s in self.sizes.tolist()}):
            which = [i for i, s in enumerate(self.sizes) if min(WORDS, s) == k]
            h = np.concatenate([self.sets[i] for i in which])
            item = np.repeat(which, [len(self.sets[i]) for i in which])
            at = np.concatenate([np.arange(len(self.sets[i])) for i in which])
            order = np.argsort(h, kind="stable")
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[(h >> U64(64 - SIEVE_BITS)).astype(np.int64)] = True
            self.by_width[k] = (h[order], item[order], at[order], sieve)
        self.prints = np.concatenate([simhash(s[None]) for s in self.sets]) if self.sets else np.zeros((0, LANES), U64)
        self.size_rank = {s: r for r, s in enumerate(sorted(set(self.sizes.tolist())))}
        rank = np.array([self.size_rank[s] for s in self.sizes.tolist()], np.int64)
        flat = self._keys(self.prints, rank[:, None]).reshape(-1)
        order = np.argsort(flat, kind="stable")
        self.keys, self.items = flat[order], (order // BLOCKS).astype(np.int32)

    @staticmethod
    def _keys(prints: np.ndarray, rank: np.ndarray | int) -> np.ndarray:
        """A number for each block of each fingerprint: size, block, value."""
        return (rank << 13) | (np.arange(BLOCKS)[None] << 8) | prints.view(np.uint8).astype(np.int64)

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of the size within the radius of the windows' fingerprints."""
        key = (self._keys(prints, self.size_rank[size])[:, :, None] ^ MASKS).reshape(-1)
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        n = hi - lo
        window = np.repeat(np.arange(len(key)) // (BLOCKS * len(MASKS)), n)
        item = self.items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        pairs = np.unique(window * len(self.ids) + item)
        window, item = np.divmod(pairs, max(1, len(self.ids)))
        close = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1) <= RADIUS
        return window[close], item[close]


def _windows(index: Index, h: np.ndarray, first: np.ndarray, k: int) -> dict[int, dict[int, set[int]]]:
    """By size and text: the starts (in words) of the windows that are worth a fingerprint."""
    out: dict[int, dict[int, set[int]]] = {}
    table, items, places, sieve = index.by_width[k]
    n = np.diff(first)
    count = np.maximum(n - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    hashes, _ = common.shingles(h, first, k)
    short = (n > 0) & (n < k)
    if short.any():  # the shingle of a text that is too short for one has no place in the count
        own = np.where(n >= k, count, (n > 0).astype(np.int64))
        hashes = hashes[~np.repeat(short, own)]
    hit = np.flatnonzero(sieve[(hashes >> U64(64 - SIEVE_BITS)).astype(np.int64)])
    lo, hi = np.searchsorted(table, hashes[hit]), np.searchsorted(table, hashes[hit], side="right")
    hit, lo, m = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    text = np.searchsorted(begin, hit, side="right") - 1
    at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
    item, text, place = items[at], np.repeat(text, m), np.repeat(hit - begin[text], m)
    # each place of a text once an item, also where the item repeats the shingle
    order = np.lexsort((place, item, text))
    item, text, place = item[order], text[order], place[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    item, text, place = item[new], text[new], place[new]
    size = index.sizes[item]
    own = np.minimum(size, n[text]) - k + 1
    need = np.ceil(THRESHOLD * (own + size - k + 1) / (1 + THRESHOLD) - 1e-9).astype(np.int64)
    # windows that hold a hit and the need - 1 hits after it
    other = np.minimum(np.arange(len(item)) + need - 1, len(item) - 1)
    enough = (np.arange(len(item)) + need <= len(item)) & (item[other] == item) & (text[other] == text)
    lo = np.maximum(place[other] - own + 1, 0)
    hi = np.minimum(place, np.maximum(n[text] - size, 0))
    enough &= lo <= hi
    for t, width, a, z in np.stack([text[enough], size[enough], lo[enough], hi[enough]], 1).tolist():
        out.setdefault(width, {}).setdefault(t, set()).update(range(a, z + 1))
    return out


def _all_windows(index: Index, h: np.ndarray, first: np.ndarray, k: int) -> dict[int, dict[int, set[int]]]:
    """What _windows() would return without its sieve; for tests."""
    n = np.diff(first).tolist()
    return {size: {t: set(range(max(0, m - size) + 1)) for t, m in enumerate(n) if m} for size in index.size_rank if min(WORDS, size) == k}


def leaks(index: Index, column: pa.Array, windows=_windows) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, item_id, first word, words, similarity) of each window that leaks."""
    raw, off = common.text_bytes(column)
    raw = LOWER[raw]
    start, end, first = common.words(raw, off)
    h = common.span_hash(raw, start, end)
    for k in index.by_width:
        for size, texts in windows(index, h, first, k).items():
            by_length: dict[int, list[tuple[int, int]]] = {}
            for t, starts in texts.items():
                length = min(size, int(first[t + 1] - first[t]))
                by_length.setdefault(length, []).extend((t, s) for s in sorted(starts))
            for length, places in by_length.items():
                if length < k:
                    continue
                for a in range(0, len(places), 512):
                    part = np.array(places[a : a + 512])
                    begin = first[part[:, 0]] + part[:, 1]
                    words = h[begin[:, None] + np.arange(length)[None]]
                    rows = common.shingles(words.reshape(-1), np.arange(len(part) + 1) * length, k)[0].reshape(len(part), -1)
                    for w, i in zip(*index.near(simhash(rows), size), strict=True):
                        value = similarity(rows[w], index.sets[i])
                        if value >= THRESHOLD:
                            yield int(part[w, 0]), int(index.ids[i]), int(part[w, 1]), length, value


def _index(name: str, items: Broadcast) -> Index:
    """One index a worker, kept for the worker's next task."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(items.value)
    return _indexes[name]


def _found(index: Index, batch: pa.RecordBatch) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {}
    for lo, hi in common.chunks(batch):
        for t, item, _, _, value in leaks(index, batch.column("text").slice(lo, hi - lo)):
            best = out.setdefault(lo + t, {})
            best[item] = max(best.get(item, 0.0), value)
    return out


def _mark(name: str, items: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, items)
        for batch in batches:
            found = _found(index, batch)
            ids, best = batch.column("item_ids").to_pylist(), batch.column("similarity").to_pylist()
            for row, matches in found.items():
                ids[row] = sorted({*ids[row], *matches})
                best[row] = max(best[row], *matches.values())
            columns = [{"item_ids": pa.array(ids, pa.list_(pa.int64())), "similarity": pa.array(best, pa.float64())}.get(c, batch.column(j)) for j, c in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def _drop(name: str, items: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, items)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[list(_found(index, batch))] = False
            yield batch.filter(pa.array(keep))

    return run


def item_blocks(benchmark: DataFrame, size: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about `size` bytes of text, by a hash of item_id."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // size))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if part:
            yield sorted((r["item_id"], r["text"]) for r in part)


def _passes(docs: DataFrame, benchmark: DataFrame, step, size: int) -> DataFrame:
    """docs after a pass of the step for each block of the benchmark."""
    out, schema = docs, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    for i, items in enumerate(item_blocks(benchmark, size)):
        if i and i % PASSES == 0:
            out = common.cut(out, "leaks")
        out = out.mapInArrow(step(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)), schema)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = ITEM_BYTES) -> DataFrame:
    """docs with item_ids (sorted, of the items that leak into it) and similarity (the highest, 0 without)."""
    start = docs.drop("item_ids", "similarity").withColumn("item_ids", F.array().cast("array<bigint>")).withColumn("similarity", F.lit(0.0))
    return _passes(start, benchmark, _mark, size)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, size: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs into which no item leaks."""
    return _passes(docs, benchmark, _drop, size)
