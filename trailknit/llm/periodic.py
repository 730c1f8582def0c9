"""Periodic runs of words: block matching with Aho-Corasick automata over integer sequences, then exact extension.

A run is a stretch of words with smallest period q and a length of max(LEAST, POWERS * q) or more that no neighbouring
word extends keeping period q. Words of a text are numbered by their exact bytes. For a scale B (a power of two) and
periods from B to 2 * B - 1, every such run holds a block of B words, at a position divisible by B, that stands again q
words later, both within the run: its first 2 * B - 1 words hold an aligned block, and 4 * q words hold the copy too.
So at each scale the aligned blocks are the keys of an automaton, which is searched across the text; of the
occurrences only those at a distance of B to 2 * B - 1 words count (exactly one aligned block lies that far ahead of each),
and each seeds an extension in both directions, word by word. Stretches of equal ends keep their smallest period.

Two things only save work. Within a run all words but its last q have the same word again at most q ahead, so that a scale's
blocks and search zones are confined to stretches of at least 3 * B words whose next equal word is less than 2 * B ahead. And a
seed within a known run of a period that divides its distance can only give that run again.

Memory: the words of one text, and an automaton over blocks of at most max(BATCH, B) words, as a block is looked for within the
3 * B words from its start only.

Edge cases: null and empty texts have no words and no runs; repeated rows get equal answers; rows without doc_id are treated
alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailknit.llm import common
from trailknit.llm.common import U64

LEAST, POWERS = 6, 4
BATCH, PARTS = 1 << 18, 4
SPACES = r"[\x20\x09-\x0D]+"


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal ones alike."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def next_gaps(x: np.ndarray) -> np.ndarray:
    """How far ahead the next equal element is; len(x) + 1 where there is none."""
    order = np.argsort(x, kind="stable")
    gap = np.full(len(x), len(x) + 1)
    same = x[order[1:]] == x[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements from the first on are equal."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        same = a[at : at + step] == b[at : min(at + step, n)] if at + step <= n else a[at:n] == b[at:n]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + len(same), step * 2
    return n


def extend(x: np.ndarray, s: int, d: int) -> tuple[int, int]:
    """(start, end) of the longest stretch of period d around a place s where x[s] == x[s + d]."""
    ahead = _agree(x[s:], x[s + d :])
    back = _agree(x[s::-1], x[s + d :: -1])
    return s - back + 1, s + ahead + d


def _zones(near: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.concatenate([[-1], np.flatnonzero(~near), [len(near)]])
    long = np.flatnonzero(np.diff(edges) - 1 >= least)
    return [(int(edges[i]) + 1, int(edges[i + 1])) for i in long]


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the windows of `size` elements at all places: equal windows have equal numbers."""
    if size == 1:
        return x
    power = common.powers(len(x) + 1)[: len(x)]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(common.mix(x.astype(U64)) * power, dtype=U64)])
        # the windows at i, times BASE ** (len(x) - i), so that all have the same factor
        aligned = (total[size:] - total[:-size]) * common.powers(len(x) + 1)[len(x) - np.arange(len(x) - size + 1)]
    return np.unique(aligned, return_inverse=True)[1]


def _seeds(x: np.ndarray, zone: tuple[int, int], block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(s, d) in arrays: the block at s, a multiple of its size, stands again at s + d, with d from one to less than two block sizes.

    A key is the block as a sequence of at most PARTS numbers, each of an equal share of its words; the text is searched at
    every offset of such shares. Shares are numbered by hash, so a seed may be false (its extension is then too short).
    """
    first, last = -(-zone[0] // block), zone[1] // block  # aligned blocks within the zone
    share = max(1, block // PARTS)
    parts = block // share
    many = max(1, BATCH // block)
    for lo in range(first, last, many):
        n = min(last, lo + many) - lo
        name = _windows(x[lo * block : (lo + n + 2) * block], share)
        keys = name[np.arange(n)[:, None] * block + np.arange(parts) * share]
        number: dict[tuple[int, ...], int] = {}
        content = np.array([number.setdefault(tuple(k), len(number)) for k in keys.tolist()])
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, i in number.items():
            automaton.add_word(k, i)
        automaton.make_automaton()
        rows = -(-len(name) // share)
        by_offset = np.full((rows + 1) * share, name.max() + 1)  # the last row keeps the offsets apart
        by_offset[: len(name)] = name
        end, found = np.array(list(automaton.iter(tuple(by_offset.reshape(-1, share).T.ravel().tolist()))), np.int64).reshape(-1, 2).T
        at = (end % (rows + 1) - parts + 1) * share + end // (rows + 1)
        b = at // block - 1  # the aligned block that begins one to less than two block sizes before
        ok = (b >= 0) & (b < n)
        ok[ok] = content[b[ok]] == found[ok]
        at, b = at[ok], b[ok]
        order = np.argsort(at, kind="stable")
        yield (lo + b[order]) * block, (at - b * block)[order]


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start and then period."""
    n = len(x)
    if n < LEAST:
        return []
    gap = next_gaps(x)
    found: dict[tuple[int, int], int] = {}
    until, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the known run that covers a place and ends last
    block = 1
    while POWERS * block <= n:
        tried: dict[int, tuple[int, int]] = {}
        for zone in _zones(gap < 2 * block, max((POWERS - 1) * block, LEAST - block)):
            for at, ahead in _seeds(x, zone, block):
                new = (at + ahead + block > until[at]) | (ahead % period[at] != 0)
                for s, d in zip(at[new].tolist(), ahead[new].tolist(), strict=True):
                    lo, hi = tried.get(d, (0, 0))
                    if lo <= s and s + d + block <= hi or s + d + block <= until[s] and d % period[s] == 0:
                        continue
                    if x[s] != x[s + d]:
                        continue
                    lo, hi = tried[d] = extend(x, s, d)
                    if hi - lo >= max(LEAST, POWERS * d):
                        found[lo, hi] = min(d, found.get((lo, hi), d))
                        last = until[lo:hi] < hi
                        until[lo:hi][last], period[lo:hi][last] = hi, d
        block *= 2
    return sorted((lo, hi - lo, d) for (lo, hi), d in found.items())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep))


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUNS), ("collapsed", pa.string())])


def _periodic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z in common.chunks(batch):
            rows = []
            for text in batch.column("text").slice(a, z - a).cast(pa.binary()).to_pylist():
                words = (text or b"").split()  # bytes split at the six ASCII white spaces
                runs = runs_of(numbered(words))
                rows.append((len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], collapse(words, runs).decode()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), *columns], schema=SCHEMA)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: runs (start, length, period) by start, period; the text without repeats."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_periodic, "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text of the query: where h = crc32(doc_id) ends in 0, the words from a on repeat the first p of them.

    g = h div 10, a = g mod n, p = 1 + (n - a) div (3 + g mod 8), for n words; other texts stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, SPACES, -1), lambda w: w != "")
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    rest = (n - a).cast("long")
    p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    times = F.ceil(rest / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), rest.cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)
