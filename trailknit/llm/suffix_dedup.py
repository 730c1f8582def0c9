"""Suffix-array dedup: bytes of every LENGTH-byte string that also starts earlier are removed.

The corpus' suffixes are dealt into buckets, and a bucket's suffixes are sorted a block of bounded bytes at a time. Suffixes
of which no partner can exist are never sorted:

1. Buckets. The least hash of the 32-byte strings in a window of LENGTH bytes is the window's anchor; it depends on the
   window alone, so equal windows have equal anchors at equal places: (anchor, place) is a window's bucket. Consecutive windows
   with one anchor are a run, about 35 windows long.
2. In a chunk. Where an anchor repeats within a chunk of texts, the chunk's suffixes in its buckets are sorted; of
   equal windows only the first by (doc_id, start) goes on. A passage that a third of all documents share, or padding, thus
   leaves one window a chunk and is no hot key afterwards.
3. Between chunks. What is left of each run is an anchor, a doc_id and a place, dealt by anchor; rows whose anchor
   no other row has are dropped as they stream by, sorted. The others fetch their bytes and are dealt by
   anchor again, and the buckets are sorted: by their first COVER_PERIOD bytes, then by ranks of a difference-cover
   sample. For any two suffixes there is a shift below the period that puts both into the sample, whose ranks are computed
   before (by doubling, as the sample is closed under whole periods), so long ties cost one look-up and no memory.
   Neighbours in the suffix array that share LENGTH bytes are equal windows; all but the first are removed. An anchor that more
   than MANY runs have (a stock phrase in many contexts) is no bucket of its own: its windows are dealt by the least hashes of the
   32-byte strings well before and well after it, too, which equal windows share and most others don't. A bucket that is
   still larger than a block is taken in pieces, with the first windows so far carried on.
4. Each document's removed windows are merged and cut out.

Shuffle files go as soon as a step's table is written. Edge cases: null and empty texts and texts below LENGTH bytes stay as
they are; rows without doc_id are compared with nothing; rows that share a doc_id count as one document (neither
is earlier at the same start, and each gets the removals of both, within its length); a text beyond PIECE bytes is taken in
overlapping pieces; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailknit.llm import common
from trailknit.llm.common import BASE, BYTE, U64, mix
from trailknit.llm.span_dedup import merged

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
PIECE = 8 << 20
BLOCK_BYTES = 3 << 20
COVER_PERIOD = 32
#: Anchors with more runs are split, by strings that begin at least ASIDE bytes from theirs.
MANY, ASIDE = 2000, 16
#: A run in a number, from the lowest bit on: the anchor's place, how many windows, the first window, whether many runs have its anchor.
PLACE, COUNT, FIRST, SPLIT = 0, 7, 14, 62
NO_GRAM = np.iinfo(np.uint64).max
GRAM_TURN = common.stream(3, GRAM) | U64(1)
_inverse = np.ones(1, U64)


# ---------------------------------------------------------------- difference cover


def cover(period: int) -> list[int]:
    """A small difference cover modulo the period: every residue is a difference of two members. Greedy."""
    members, missing = [0], set(range(1, period))
    while missing:
        gain = lambda x: len({d for m in members for d in ((x - m) % period, (m - x) % period)} & missing)
        x = max((x for x in range(period) if x not in members), key=lambda x: (gain(x), -x))
        missing -= {d for m in members for d in ((x - m) % period, (m - x) % period)}
        members.append(x)
    return sorted(members)


COVER = np.zeros(COVER_PERIOD, bool)
COVER[cover(COVER_PERIOD)] = True
#: For residues a and b, the least shift that puts both into the cover.
SHIFT = np.array([[next(d for d in range(COVER_PERIOD) if COVER[(a + d) % COVER_PERIOD] and COVER[(b + d) % COVER_PERIOD]) for b in range(COVER_PERIOD)] for a in range(COVER_PERIOD)])


def _names(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows of keys, first column first."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _key(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [words[at + 8 * i].astype(U64) for i in range(COVER_PERIOD // 8)]


def suffix_array(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray | None = None, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the starts' indices in the order of buckets and then suffixes up to 4 periods, whether each is equal to the one before).

    Suffixes are equal if they have one bucket and the same first bytes, LENGTH or as many as stated (LENGTH at least).
    """
    length = np.full(len(starts), LENGTH) if length is None else length
    bucket = np.zeros(len(starts), np.int64) if bucket is None else bucket
    reach = LENGTH + COVER_PERIOD
    pad = np.concatenate([text, np.zeros(6 * COVER_PERIOD + LENGTH, np.uint8)])
    words = np.ndarray((len(pad) - 8,), ">u8", pad, strides=(1,))
    # the cover's places that any of the suffixes needs
    edge = np.bincount(starts, minlength=len(text) + reach + 1) - np.bincount(starts + reach, minlength=len(text) + reach + 1)
    sample = np.flatnonzero(np.cumsum(edge) > 0)
    sample = sample[COVER[sample % COVER_PERIOD]]
    slot = np.full(len(pad) + 2 * COVER_PERIOD, -1, np.int32)
    slot[sample] = np.arange(len(sample))
    rank = _names(_key(words, sample))
    for step in (1, 2):  # by doubling: 64, then 128 bytes
        after = slot[np.minimum(sample + step * COVER_PERIOD, len(slot) - 1)]
        rank = _names([rank, np.where(after >= 0, rank[after] + 1, 0)])
    group = _names([bucket, *_key(words, starts)])
    order = np.argsort(group, kind="stable")
    at, group = starts[order], group[order]
    group = np.searchsorted(group, group)  # the place of the group's first
    open_ = np.arange(len(at))
    while len(open_):  # three-way partitions of all ties at once, each around its middle
        g = group[open_]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(head, len(g)))
        many = np.repeat(size > 1, size)
        open_, g = open_[many], g[many]
        if not len(open_):
            break
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(head, len(g)))
        mine = at[open_]
        pivot = np.repeat(mine[head + size // 2], size)
        shift = SHIFT[mine % COVER_PERIOD, pivot % COVER_PERIOD]
        side = np.sign(rank[slot[mine + shift]] - rank[slot[pivot + shift]])
        where = np.lexsort((side, g))
        at[open_], order[open_] = mine[where], order[open_][where]
        side = side[where]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (side[1:] != side[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
        group[open_] = open_[first]
        open_ = open_[side != 0]
    same = np.zeros(len(at), bool)
    if len(at) > 1:
        same[1:] = bucket[order[1:]] == bucket[order[:-1]]
        for i in range(0, int(length.max()) - 8 + 8, 8):
            near = np.flatnonzero(same[1:]) + 1
            own = length[order[near]]
            step = np.minimum(i, own - 8)
            same[near] = (words[at[near] + step] == words[at[near - 1] + step]) & (own == length[order[near - 1]])
    return order, same


def later(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For the string at each of the starts: whether an equal one of its bucket stands earlier, by (doc, at)."""
    order, same = suffix_array(text, starts, bucket, length)
    out = np.zeros(len(starts), bool)
    pair = same.copy()
    pair[:-1] |= same[1:]
    order, group = order[pair], np.cumsum(~same)[pair]
    if not len(order):
        return out
    order = order[np.lexsort((at[order], doc[order], group))]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first = order[np.repeat(head, np.diff(np.append(head, len(group))))]
    out[order] = (doc[order] != doc[first]) | (at[order] != at[first])
    return out


def later_windows(text: np.ndarray, starts: np.ndarray, n: np.ndarray, place: np.ndarray, name: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(run, window in it, whether an equal window stands earlier) of the windows of runs, by (doc, at); name numbers their anchors.

    Coarse to fine: the suffixes at which runs start are sorted first, and a run that is equal to an earlier one byte for
    byte is later as a whole; then the suffixes of all windows of the runs that are left are, where several have an anchor.
    """
    whole = later(text, starts, (name * 128 + place) * 128 + n, n + LENGTH - 1, doc, at)
    left = np.flatnonzero(~whole)
    left = left[np.bincount(name[left], minlength=int(name.max(initial=0)) + 1)[name[left]] > 1]
    which, inside = _ranges(np.zeros(len(left), np.int64), n[left])
    run = left[which]
    fine = later(text, starts[run] + inside, name[run] * 128 + place[run] - inside, np.full(len(run), LENGTH), doc[run], at[run] + inside)
    r, w = _ranges(np.zeros(len(n), np.int64), n)
    out = whole[r]
    out[(np.cumsum(n) - n)[run] + inside] = fine
    return r, w, out


def spans_of(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the bytes that windows at ascending places of a row cover."""
    if not len(row):
        return row, at, at
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + LENGTH)])
    head = np.flatnonzero(new)
    return row[head], at[head], at[np.append(head[1:], len(row)) - 1] + LENGTH


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of the numbers first, first + 1, ... of each range."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


# ---------------------------------------------------------------- runs of windows


def _rolling(raw: np.ndarray) -> np.ndarray:
    """Prefix sums S, for which (S[b] - S[a]) / BASE ** a depends on the bytes from a to b alone."""
    global _inverse
    power = common.powers(len(raw) + 1)
    if len(_inverse) < len(raw) + 1:
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        full = np.full(max(len(raw) + 1, common.CHUNK_BYTES * 2), inverse, U64)
        full[0] = 1
        _inverse = np.cumprod(full, dtype=U64)
    return np.concatenate([np.zeros(1, U64), np.cumsum(BYTE[raw] * power[: len(raw)], dtype=U64)])


def runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, place of the anchor from the first window on, anchor hash)."""
    none = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none, none.astype(U64)
    s = _rolling(raw)
    m = len(raw) - GRAM + 1
    gram = mix((s[GRAM:] - s[:m]) * _inverse[:m])
    low = (gram & ~U64(0xFFFFFF)) | np.arange(m, dtype=U64)
    width = 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(raw) - LENGTH + 1], low[WINDOW - width :][: len(raw) - LENGTH + 1])
    anchor = (low & U64(0xFFFFFF)).astype(np.int64)
    valid = np.zeros(len(raw) + 1, np.int64)
    size = np.diff(off)
    long_ = size >= LENGTH
    np.add.at(valid, off[:-1][long_], 1)
    np.add.at(valid, off[1:][long_] - LENGTH + 1, -1)
    ok = np.cumsum(valid)[: len(anchor)] > 0
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~ok[:-1]]) & ok
    new[off[:-1][long_]] = True
    lo = np.flatnonzero(new)
    end = np.flatnonzero(ok & np.concatenate([new[1:] | ~ok[1:], [True]])) + 1
    q = anchor[lo]
    text = np.searchsorted(off, lo, side="right") - 1
    return text, lo - off[text], end - lo, q - lo, gram[q]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each text, byte in the row at which it begins, bytes, offsets); texts beyond PIECE bytes come in overlapping pieces."""
    for lo, hi in common.chunks(batch):
        raw, off = common.text_bytes(batch.column("text").slice(lo, hi - lo))
        if len(raw) <= PIECE:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), raw, off
            continue
        for i in range(hi - lo):
            for a in range(int(off[i]), max(int(off[i]) + 1, int(off[i + 1]) - LENGTH + 1), PIECE):
                part = raw[a : min(int(off[i + 1]), a + PIECE + LENGTH - 1)]
                yield np.array([lo + i]), np.array([a - off[i]]), part, np.array([0, len(part)])


def _packed(lo: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (lo << FIRST) | (n << COUNT) | (place << PLACE)


def unpacked(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, place of the anchor); a row of no windows is a removed span."""
    return (run >> FIRST) & ((1 << SPLIT - FIRST) - 1), (run >> COUNT) & 127, run & 127


def in_chunk(raw: np.ndarray, off: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, doc_id, run) of the first windows in the chunk, and (stop, doc_id, run) of the spans that the others cover.

    doc, begin: the doc_id of each text, and the byte of it at which the text begins.
    """
    text, lo, n, place, gram = runs(raw, off)
    anchor = gram.view(np.int64)
    order = np.argsort(anchor, kind="stable")
    twin = np.zeros(len(anchor), bool)
    equal = anchor[order[1:]] == anchor[order[:-1]]
    twin[order[1:][equal]] = twin[order[:-1][equal]] = True
    some = np.flatnonzero(twin)
    _, name = np.unique(anchor[some], return_inverse=True)
    which, inside, gone = later_windows(raw, off[text[some]] + lo[some], n[some], place[some], name, doc[text[some]], (begin[text] + lo)[some])
    run = some[which]
    r, a, z = spans_of(text[run[gone]], (begin[text] + lo)[run[gone]] + inside[gone])
    # the windows that stay are runs again, split where some went
    stay, where = run[~gone], inside[~gone]
    owner = doc[r]
    new = np.concatenate([[True], (stay[1:] != stay[:-1]) | (where[1:] != where[:-1] + 1)]) if len(stay) else np.empty(0, bool)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(stay)))
    r = np.concatenate([np.flatnonzero(~twin), stay[head]])
    skip = np.concatenate([np.zeros(len(r) - len(head), np.int64), where[head]])
    size = np.concatenate([n[~twin], size])
    packed = _packed(begin[text[r]] + lo[r] + skip, size, place[r] - skip)
    zero = np.zeros(len(a), np.int64)
    return np.concatenate([anchor[r], z]), np.concatenate([doc[text[r]], owner]), np.concatenate([packed, _packed(a, zero, zero)])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for rows, begin, raw, off in _pieces(batch):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in in_chunk(raw, off, ids[rows], begin)], ["anchor", "doc_id", "run"])


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor: those with an anchor of several rows, marked where there are more than MANY, and all spans."""
    names = ["anchor", "doc_id", "run"]
    held = [np.empty(0, np.int64)] * 3  # the last anchor's rows, MANY at most
    known = None  # the last anchor, if it has more

    def told(anchor: np.ndarray, doc: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
        head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.empty(0, np.int64)
        size = np.diff(np.append(head, len(anchor)))
        size = np.repeat(np.where(anchor[head] == known, MANY + 1, size) if known is not None else size, size)
        span = (run >> COUNT) & 127 == 0
        keep = span | (size > 1)
        run = np.where(~span & (size > MANY), run | (1 << SPLIT), run)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (anchor, doc, run)], names)

    for batch in batches:
        rows = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, names, strict=True)]
        if not len(rows[0]):
            continue
        last = rows[0][-1]
        at = int(np.searchsorted(rows[0], last))
        if last == known or len(rows[0]) - at > MANY:
            at = len(rows[0])
        held = [c[at:] for c in rows]
        yield told(*[c[:at] for c in rows])
        known = last if at == len(rows[0]) else None
    yield told(*held)


def narrowed(raw: np.ndarray, begin: np.ndarray, n: np.ndarray, place: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """(run, first window, windows, bucket) of the parts of runs whose windows agree in the least string before and after the anchor.

    A window's strings are those that begin ASIDE bytes or more from the anchor's beginning, so a bucket depends on the window alone.
    """
    width = 2 * WINDOW - 1
    at = np.arange(width)
    data = np.concatenate([raw, np.zeros(width + GRAM, np.uint8)])
    data = BYTE[data[begin[:, None] + np.arange(width + GRAM - 1)]]
    gram = np.zeros((len(begin), width), U64)
    for k in range(GRAM):
        gram += data[:, k : k + width] * GRAM_TURN[k]
    gram = mix(gram)
    before = np.where(at <= place[:, None] - ASIDE, gram, NO_GRAM)
    before = np.minimum.accumulate(before[:, ::-1], axis=1)[:, ::-1]
    after = np.minimum.accumulate(np.where(at >= place[:, None] + ASIDE, gram, NO_GRAM), axis=1)
    run, window = _ranges(np.zeros(len(n), np.int64), n)
    bucket = mix(mix(anchor[run].view(U64) ^ before[run, window]) + after[run, window + WINDOW - 1]).view(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (bucket[1:] != bucket[:-1])])) if len(run) else run
    return run[head], window[head], np.diff(np.append(head, len(run))), bucket[head]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs listed for each text: (bucket, doc_id, lo, place, bytes)."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for lo, hi in common.chunks(batch):
            raw, off = common.text_bytes(batch.column("text").slice(lo, hi - lo))
            lists = batch.column("runs").slice(lo, hi - lo)
            flat = lists.flatten()
            anchor, run = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "run"))
            text = np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy()))
            first, n, place = unpacked(run)
            ok = (n > 0) & (first + n - 1 + LENGTH <= np.diff(off)[text])
            many = run[ok] >> SPLIT > 0
            anchor, text, first, n, place = anchor[ok], text[ok], first[ok], n[ok], place[ok]
            if many.any():
                rest = [c[~many] for c in (anchor, text, first, n, place)]
                anchor, text, first, n, place = (c[many] for c in (anchor, text, first, n, place))
                for a in range(0, len(text), 2000):
                    r, skip, size, bucket = narrowed(raw, (off[text] + first)[a : a + 2000], n[a : a + 2000], place[a : a + 2000], anchor[a : a + 2000])
                    r += a
                    rest = [np.concatenate(x) for x in zip(rest, (bucket, text[r], first[r] + skip, size, place[r] - skip), strict=True)]
                anchor, text, first, n, place = rest
            for a in range(0, len(text), 50_000):
                part = slice(a, a + 50_000)
                _, byte = _ranges((off[text] + first)[part], n[part] + LENGTH - 1)
                ends = np.concatenate([[0], np.cumsum(n[part] + LENGTH - 1)]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[byte]))])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[part]), pa.array(ids[lo:hi][text[part]]), pa.array(first[part]), pa.array(place[part].astype(np.int16)), data], ["bucket", "doc_id", "lo", "place", "bytes"])


def _sorted_block(rows: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
    """(spans that later windows cover, the rows that have a first window); the rows are sorted by bucket."""
    bucket, doc, lo, place = (rows.column(c).to_numpy() for c in ("bucket", "doc_id", "lo", "place"))
    data = rows.column("bytes").combine_chunks()
    text, off = common.text_bytes(data.chunk(0) if isinstance(data, pa.ChunkedArray) else data)
    n = np.diff(off) - LENGTH + 1
    name = np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]]))
    row, inside, gone = later_windows(text, off[:-1], n, place.astype(np.int64), name, doc, lo)
    r, a, z = spans_of(row[gone], lo[row[gone]] + inside[gone])
    out = pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(a), pa.array(z)], ["doc_id", "start", "stop"])
    return out, rows.filter(pa.array(np.bincount(row[gone], minlength=len(n)) < n))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (doc_id, start, stop) of bytes that later windows cover, from rows sorted by bucket, doc_id and lo."""
    held: list[pa.RecordBatch] = []
    size, limit = 0, BLOCK_BYTES

    def parted() -> tuple[pa.Table, pa.Table]:
        """(whole buckets that have partners, the last bucket)."""
        rows = pa.Table.from_batches(held).combine_chunks()
        bucket = rows.column("bucket").to_numpy()
        head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        many = np.repeat(np.diff(np.append(head, len(bucket))) > 1, np.diff(np.append(head, len(bucket))))
        return rows.slice(0, head[-1]).filter(pa.array(many[: head[-1]])), rows.slice(head[-1])

    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            held.append(part)
            size += part.num_rows * (LENGTH + WINDOW // 2)
            if size < limit:
                continue
            whole, last = parted()
            if whole.num_rows:
                yield _sorted_block(whole)[0]
            if last.nbytes >= limit // 2:
                out, last = _sorted_block(last)
                yield out
            # a bucket whose windows differ stays as large; it grows to double before the next sort then
            held = last.combine_chunks().to_batches()
            size = last.num_rows * (LENGTH + WINDOW // 2)
            limit = max(BLOCK_BYTES, 2 * size)
    if held:
        whole, last = parted()
        for rows in (whole, last):
            if rows.num_rows > 1:
                yield _sorted_block(rows)[0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x, gone in zip(batch.column("text"), batch.column("gone").to_pylist(), strict=True):
            raw = (x.as_py() or "").encode()
            spans = merged([(g["start"], min(g["stop"], len(raw))) for g in gone or () if g["start"] < len(raw)])
            at, kept = 0, hashlib.sha256()
            for a, z in spans:
                kept.update(raw[at:a])
                at = z
            kept.update(raw[at:])
            rows.append((len(raw), sum(z - a for a, z in spans), len(spans), kept.hexdigest(), [{"start": a, "stop": z} for a, z in spans]))
        n, removed, spans, digest, where = zip(*rows, strict=True) if rows else ((),) * 5
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(where, kind)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop): the bytes of windows that also start earlier; they may overlap."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    found = texts.mapInArrow(_found, "anchor long, doc_id long, run long")
    dealt = found.repartition(common.partitions(spark), "anchor").sortWithinPartitions("anchor")
    near = dealt.mapInArrow(_partnered, "anchor long, doc_id long, run long")
    listed = common.cut(near.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "run")).alias("runs")), "suffix-listed")
    parts = texts.join(listed, "doc_id").mapInArrow(_suffixes, "bucket long, doc_id long, lo long, place short, bytes binary")
    buckets = parts.repartition(common.partitions(spark), "bucket").sortWithinPartitions("bucket", "doc_id", "lo")
    between = common.cut(buckets.mapInArrow(_blocks, "doc_id long, start long, stop long"), "suffix-later")
    span = listed.select("doc_id", F.explode(F.filter("runs", lambda r: F.shiftright(r["run"], COUNT).bitwiseAND(127) == 0)).alias("r"))
    within = span.select("doc_id", F.shiftright("r.run", FIRST).alias("start"), F.col("r.anchor").alias("stop"))
    return within.union(between)


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row."""
    gone = repeated_bytes(docs).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"
    return texts.join(gone, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "gone").mapInArrow(_cut, schema)
