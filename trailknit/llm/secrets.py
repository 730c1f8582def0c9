"""Secret scan: fixed patterns, and formats learnt from what they find by grammar inference.

Base spans come from three patterns (assign, access, hex). The values that they find are the labelled credentials:
for each kind, a prefix tree of a sample is merged state by state where the frequencies of ending and of each symbol and
the distribution of the length that is left are statistically compatible (Hoeffding and Dvoretzky-Kiefer-Wolfowitz bounds,
also of all successors), each state with the most alike of those it is compatible with. That gives a probabilistic
automaton of the kind's format, with its length where that is fixed. An automaton of ordinary tokens is inferred likewise.

Candidates are all tokens of MIN_TOKEN characters or more of the credentials' alphabet, and the base values. A candidate's
format likelihood is its mean log-likelihood ratio of a kind's automaton to that of ordinary tokens. Outside base spans, it
becomes a span of kind pfa_<kind> where the ratio reaches the kind's margin: half-way between what nearly all ordinary
tokens stay below (quantile ORDINARY) and what nearly all credentials reach (quantile QUANTILE), both on a third of the
samples that is held back. Symbols unseen in a state cost a small probability and leave the state as it is.

The automata are fitted on SAMPLE values of each kind and OTHERS ordinary tokens at most, those of the smallest hashes and
of MAX_VALUE characters at most (documented bounds, so what the driver holds does not grow); all texts are scanned whole
and every candidate is scored, whatever its length.

Edge cases: null and empty texts have no spans; letters match in either case only where ASCII letters do; a kind without
enough values (10) has no automaton, and without enough ordinary tokens no candidate is flagged; repeated rows get equal
answers; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailknit.llm import common

# Fixed patterns: what the base spans are.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex")
ALL_KINDS = (*KINDS, *(f"pfa_{k}" for k in KINDS))

CREDENTIAL = np.zeros(256, bool)
CREDENTIAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
MIN_TOKEN, MAX_VALUE = 8, 256
SAMPLE, OTHERS, ENOUGH = 600, 6000, 10
ALPHA, FEW = 0.05, 6
QUANTILE, ORDINARY = 0.05, 0.999


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value), by start and then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all tokens of the credentials' alphabet, start and end in raw."""
    part = CREDENTIAL[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], part])[:-1] if len(raw) else part
    after = np.concatenate([part[1:], [False]]) if len(raw) else part
    start = np.flatnonzero(part & (~before | edge[:-1]))
    end = np.flatnonzero(part & (~after | edge[1:])) + 1
    keep = end - start >= MIN_TOKEN
    start, end = start[keep], end[keep]
    return np.searchsorted(off, start, side="right") - 1, start, end


# ---------------------------------------------------------------- grammar inference

CLASSES = {**{c: "0" for c in "0123456789"}, **{c: "f" for c in "abcdef"}, **{c: "z" for c in "ghijklmnopqrstuvwxyz"}, **{c: "F" for c in "ABCDEF"}, **{c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
WIDTH = {"0": 10, "f": 6, "z": 20, "F": 6, "Z": 20}
END = "$"


class State:
    """count: strings that pass; ends: that end here; seen: the next symbol; left: the length from here on; to: successors."""

    __slots__ = ("count", "ends", "left", "seen", "to")

    def __init__(self):
        self.count, self.ends, self.to, self.seen, self.left = 0, 0, {}, {}, {}


def symbols(value: str) -> list[str]:
    return [CLASSES.get(c, c) for c in value]


def prefix_tree(values: list[str]) -> State:
    root = State()
    for v in values:
        at = root
        for k, s in enumerate([*symbols(v), END]):
            at.count += 1
            at.left[len(v) - k] = at.left.get(len(v) - k, 0) + 1
            if s == END:
                at.ends += 1
            else:
                at.seen[s] = at.seen.get(s, 0) + 1
                at = at.to.setdefault(s, State())
    return root


def _bound(n1: int, n2: int) -> float:
    return math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _length_gap(a: State, b: State) -> float:
    """The largest difference of the distribution functions of the lengths left."""
    most, x, y = 0.0, 0, 0
    for k in sorted(a.left.keys() | b.left.keys()):
        x += a.left.get(k, 0)
        y += b.left.get(k, 0)
        most = max(most, abs(x / a.count - y / b.count))
    return most


def compatible(a: State, b: State) -> bool:
    """Whether the two states, and all successors that they share, are alike; successors too rare to tell are."""
    todo = [(a, b)]
    checked = set()
    while todo:
        x, y = todo.pop()
        if x is y or (id(x), id(y)) in checked or (x is not a or y is not b) and (x.count < FEW or y.count < FEW):
            continue
        checked.add((id(x), id(y)))
        most = _bound(x.count, y.count)
        if abs(x.ends / x.count - y.ends / y.count) > most or _length_gap(x, y) > most:
            return False
        if any(abs(x.seen.get(s, 0) / x.count - y.seen.get(s, 0) / y.count) > most for s in x.seen.keys() | y.seen.keys()):
            return False
        todo += [(x.to[s], y.to[s]) for s in x.to.keys() & y.to.keys()]
    return True


def distance(a: State, b: State) -> float:
    """How unlike two states are: in the length left, and in the next symbol."""
    return _length_gap(a, b) + sum(abs(a.seen.get(s, 0) / a.count - b.seen.get(s, 0) / b.count) for s in a.seen.keys() | b.seen.keys()) / 2


def _fold(into: State, tree: State) -> None:
    """Adds a tree's counts to a state and its successors."""
    todo = [(into, tree)]
    while todo:
        x, y = todo.pop()
        x.count += y.count
        x.ends += y.ends
        for mine, its in ((x.seen, y.seen), (x.left, y.left)):
            for s, n in its.items():
                mine[s] = mine.get(s, 0) + n
        for s, child in y.to.items():
            if s in x.to:
                todo.append((x.to[s], child))
            else:
                x.to[s] = child


def infer(values: list[str]) -> State:
    """The probabilistic automaton: the commonest unmerged successor joins the most alike state that is compatible, or becomes one itself."""
    root = prefix_tree(values)
    states, known = [root], {id(root)}
    while True:
        open_ = [(child.count, s, -i, p) for i, p in enumerate(states) for s, child in p.to.items() if id(child) not in known]
        if not open_:
            return root
        _, s, _, parent = max(open_, key=lambda x: x[:3])
        child = parent.to[s]
        near = sorted((distance(x, child), i) for i, x in enumerate(states))
        match = next((states[i] for _, i in near if compatible(states[i], child)), None)
        if match is not None:
            parent.to[s] = match
            _fold(match, child)
        else:
            states.append(child)
            known.add(id(child))


class Automaton:
    """Tables of an automaton by state and byte: the log-likelihood of the byte, the next state; and that of ending."""

    def __init__(self, root: State):
        order, number = [root], {id(root): 0}
        for x in order:
            for child in x.to.values():
                if id(child) not in number:
                    number[id(child)] = len(order)
                    order.append(child)
        self.cost = np.zeros((len(order), 256))
        self.next = np.repeat(np.arange(len(order), dtype=np.int32)[:, None], 256, 1)
        self.end = np.zeros(len(order))
        for i, x in enumerate(order):
            self.end[i] = math.log((x.ends + 0.05) / (x.count + 0.6))
            for b in range(256):
                s = CLASSES.get(chr(b), chr(b))
                self.cost[i, b] = math.log((x.seen.get(s, 0) + 0.05) / (x.count + 0.6) / WIDTH.get(s, 1))
                if s in x.to:
                    self.next[i, b] = number[id(x.to[s])]

    def likelihood(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mean natural log-likelihood of the characters and the end of each token; all tokens advance together, very long ones one by one."""
        total, size = np.zeros(len(start)), end - start
        for i in np.flatnonzero(size > MAX_VALUE):
            cost, step, state, sum_ = self.cost, self.next, 0, 0.0
            for b in raw[start[i] : end[i]].tolist():
                sum_ += cost[state, b]
                state = step[state, b]
            total[i] = sum_ + self.end[state]
        order = np.argsort(-size, kind="stable")
        order = order[size[order] <= MAX_VALUE]
        first, state, sums = start[order], np.zeros(len(order), np.int32), np.zeros(len(order))
        still = np.searchsorted(-size[order], -np.arange(1, (size[order[0]] if len(order) else 0) + 1), side="right")
        for k, m in enumerate(still.tolist()):
            b = raw[first[:m] + k]
            sums[:m] += self.cost[state[:m], b]
            state[:m] = self.next[state[:m], b]
        total[order] = sums + self.end[state]
        return total / (size + 1)

    def of(self, values: list[str]) -> np.ndarray:
        raw = [v.encode() for v in values]
        ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
        return self.likelihood(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64) if raw else ends, ends)


# ---------------------------------------------------------------- over tables


def _token_hash(value: str) -> int:
    raw = np.frombuffer(value.encode(), np.uint8)
    return int(common.span_hash(raw, np.array([0]), np.array([len(raw)]))[0])


def _scan(batch: pa.RecordBatch) -> Iterator[tuple]:
    """By chunk: (first row, bytes, offsets, base spans of each text, its candidates (text, start, end) outside them)."""
    for lo, hi in common.chunks(batch):
        column = batch.column("text").slice(lo, hi - lo)
        raw, off = common.text_bytes(column)
        text, start, end = candidates(raw, off)
        base = [base_spans(x.as_py() or "") for x in column]
        keep = np.ones(len(text), bool)
        for i in (i for i, b in enumerate(base) if b):
            a, z = np.searchsorted(text, (i, i + 1))
            solid = np.cumsum((raw[off[i] : off[i + 1]] & 0xC0) != 0x80)
            at = lambda p: off[i] + np.searchsorted(solid, p + 1)
            for b in base[i]:
                keep[a:z] &= (end[a:z] <= at(b[0])) | (start[a:z] >= at(b[1] - 1) + 1)
        yield lo, raw, off, base, text[keep], start[keep], end[keep]


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, hash, value): of each kind, the task's values of the smallest hashes."""
    best: dict[str, dict[int, str]] = {k: {} for k in (*KINDS, "other")}

    def trim(kind: str, most: int) -> None:
        if len(best[kind]) > most:
            best[kind] = dict(sorted(best[kind].items())[:most])

    for batch in batches:
        for _, raw, _, base, _, start, end in _scan(batch):
            for *_, kind, value in (s for b in base for s in b):
                if len(value) <= MAX_VALUE:
                    best[kind][_token_hash(value)] = value
            short = end - start <= MAX_VALUE
            start, end = start[short], end[short]
            h, at = np.unique(common.span_hash(raw, start, end), return_index=True)
            best["other"] |= {int(x): raw[start[i] : end[i]].tobytes().decode() for x, i in zip(h[:OTHERS], at[:OTHERS], strict=True)}
            for kind in best:
                trim(kind, OTHERS if kind == "other" else SAMPLE)
    rows = [(kind, h - (1 << 63), value) for kind, some in best.items() for h, value in some.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["kind", "hash", "value"])


def automata(values: dict[str, list[str]]) -> dict[str, tuple[Automaton, float]]:
    """By kind, and 'other' for ordinary tokens: the automaton and the margin. Every third value calibrates the margins."""
    fitted = {k: (Automaton(infer([x for i, x in enumerate(v) if i % 3])), v[::3]) for k, v in values.items() if len(v) >= ENOUGH}
    if "other" not in fitted:
        return {}
    other, held = fitted.pop("other")
    model = {"other": (other, 0.0)}
    for kind, (automaton, own) in fitted.items():
        usual = np.quantile(automaton.of(held) - other.of(held), ORDINARY)
        reached = np.quantile(automaton.of(own) - other.of(own), QUANTILE)
        model[kind] = (automaton, float(max(usual + reached, 2 * usual) / 2))
    return model


def fit(docs: DataFrame) -> dict[str, tuple[Automaton, float]]:
    found = common.cut(docs.select("text").mapInArrow(_values, "kind string, hash long, value string").distinct(), "secret-values")
    values = {}
    for kind in (*KINDS, "other"):
        rows = found.where(F.col("kind") == kind).orderBy("hash", "value").limit(OTHERS if kind == "other" else SAMPLE).collect()
        values[kind] = [r["value"] for r in rows]
    common.discard(found)
    return automata(values)


def _spans(model: dict[str, tuple[Automaton, float]]):
    kinds = [k for k in KINDS if k in model]
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in (*KINDS, "learnt")), ("base_sha256", pa.string()), ("spans", pa.string()), ("likelihood", pa.float64())])

    def ratios(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """By kind and token."""
        usual = model["other"][0].likelihood(raw, start, end)
        return np.stack([model[k][0].likelihood(raw, start, end) - usual for k in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, raw, off, base, text, start, end in _scan(batch):
                more: dict[int, list[tuple[int, int, str]]] = {}
                best = np.full(len(base), -np.inf)
                if kinds and len(text):
                    ratio = ratios(raw, start, end)
                    np.maximum.at(best, text, ratio.max(0))
                    over = ratio - np.array([model[k][1] for k in kinds])[:, None]
                    for i in np.flatnonzero(over.max(0) >= 0).tolist():
                        own = raw[off[text[i]] : start[i]]
                        a = int(((own & 0xC0) != 0x80).sum())
                        more.setdefault(int(text[i]), []).append((a, a + int(end[i] - start[i]), f"pfa_{kinds[over[:, i].argmax()]}"))
                rows = []
                for i, found in enumerate(base):
                    if kinds and found:
                        values = [v.encode() for *_, v in found]
                        z = np.cumsum([len(v) for v in values]).astype(np.int64)
                        best[i] = max(best[i], ratios(np.frombuffer(b"".join(values), np.uint8), z - [len(v) for v in values], z).max())
                    written = ",".join(f"{kind}:{a}:{z}" for a, z, kind, _ in found)
                    every = sorted([b[:3] for b in found] + more.get(i, []), key=lambda s: (s[0], ALL_KINDS.index(s[2])))
                    rows.append((*(sum(b[2] == k for b in found) for k in KINDS), len(more.get(i, ())), hashlib.sha256(written.encode()).hexdigest(), ",".join(f"{kind}:{a}:{z}" for a, z, kind in every), float(best[i]) if best[i] > -np.inf else None))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(base)), *(pa.array(c, t.type) for c, t in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return run


def find_secrets(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_learnt, base_sha256, spans, likelihood) of each row; likelihood is its candidates' highest, or null."""
    model = fit(docs) if model is None else model
    out = "doc_id long, n_assign long, n_access long, n_hex long, n_learnt long, base_sha256 string, spans string, likelihood double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_spans(model), out)
