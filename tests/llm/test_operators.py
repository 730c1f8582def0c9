"""The corpus operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailknit.llm import decontaminate, fingerprints, line_dedup, mixing, neardup, quality, secrets, span_dedup, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed string"


def sentences(rng: random.Random, n: int) -> str:
    return " ".join(" ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega")) + str(rng.randrange(400)) for _ in range(rng.randint(6, 14))) + "." for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rng = random.Random(5)
    base, passage = sentences(rng, 30), sentences(rng, 8)
    words = base.split(" ")
    near = [" ".join(w if rng.random() > 0.02 else "changed" for w in words) for _ in range(4)]
    lines = "\n".join(sentences(rng, 1) for _ in range(5))
    out = [base, base, *near, None, "", " ", "one two", "ONE two", sentences(rng, 20) + " " + passage + " " + sentences(rng, 4), passage + " " + sentences(rng, 10)]
    out += [lines, "head\n" + lines + "\ntail", lines, "a" * 350, "é" * 120, sentences(rng, 900), "x. " * 300]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "hot" if i % 3 else None, len(t or ""), "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[0], None, None, None, None), (0, texts[0], "en", "hot", 1, "again")], SCHEMA).cache()


@pytest.fixture(scope="module")
def plain(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)], SCHEMA).cache()


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def test_fingerprints(plain, docs, texts):
    got = by_id(fingerprints.fingerprints_and_edits(plain))
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[i].fingerprint == fingerprints.fingerprint(fingerprints.tree(text)) == fingerprints.fingerprint(fingerprints.parse(got[i].fingerprint))
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint and got[0].near_edited > 0.3
    assert fingerprints.fingerprints_and_edits(docs).count() == len(texts) + 2
    assert fingerprints.fingerprints_and_edits(docs.where("false")).count() == 0


def test_next_documents_of_ties_and_rows_without_id(spark):
    """Ranges are few or many, some documents share a doc_id, others have none: every row meets the row that follows it in the order."""
    rng = random.Random(23)
    rows = [(rng.choice([None, 7, rng.randrange(-50, 1 << 40), rng.randrange(90)]), sentences(rng, 1) + str(i)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    order = [(r.doc_id, r.text) for r in sorted(table.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))]
    want = sorted((len(t), hashlib.sha256(fingerprints.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (_, t) in enumerate(order))
    for parts in ("1", "4", "60"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = fingerprints.fingerprints_and_edits(table.drop("h")).select("n_chars", "edited_sha256").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert sorted(map(tuple, got)) == want


def test_ranges_by_two_look_ups(spark):
    bounds = [-900, *range(-500, 500, 7)]
    for some in ([], bounds[:1], bounds[:2], bounds):
        got = spark.range(-600, 600).select("id", fingerprints._range_of(F.col("id"), some).alias("at")).collect()
        assert all(r["at"] == sum(b <= r["id"] for b in some) for r in got)


def test_likeness_by_brute_force(plain, texts):
    """near_edited and near_next against a plain comparison of the nested pieces, and against difflib in order."""
    import difflib

    def nested(text):
        return [[[(leaf.digest, leaf.size) for leaf in p.children] for p in s.children] for s in fingerprints.tree(text).children]

    def share(a, b):
        total = sum(len(x.encode()) for x in (a, b))
        if a == b or not a or not b:
            return float(a == b)
        same, left, right = 0, nested(a), nested(b)
        for depth in range(3):
            rest = []
            for x in left:
                if x in right:
                    right.remove(x)
                    same += sum(q[1] for q in (x and [x] if depth == 2 else [q for p in x for q in (p if depth == 0 else [p])]))
                else:
                    rest.append(x)
            left, right = ([y for x in rest for y in x], [y for x in right for y in x]) if depth < 2 else (rest, right)
        return 2 * same / total

    got = by_id(fingerprints.fingerprints_and_edits(plain))
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        assert abs(got[i].near_next - share(text, after)) < 1e-9
        assert abs(got[i].near_edited - share(text, text[: len(text) - len(text) // 2] + after[: len(text) // 2])) < 1e-9
    a, b = texts[0], texts[0].replace("alpha1", "beta2", 3)
    ratio = difflib.SequenceMatcher(None, a.split(". "), b.split(". ")).ratio()
    assert abs(fingerprints.likeness(fingerprints.tree(a), fingerprints.tree(b)) - ratio) < 0.15


def test_edits_are_located():
    a = fingerprints.tree("One two. Three four.\nFive six.\n\nSeven eight.")
    b = fingerprints.tree("One two. Three nine.\nFive six.\n\nSeven eight.")
    assert fingerprints.edits(a, b) == [(0, 0, 1)] and 0.5 < fingerprints.likeness(a, b) < 1


def test_near_duplicates(docs, plain, texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = by_id(neardup.near_duplicates(plain))
    assert {i: (got[i].n_shingles, got[i].component_id) for i in got} == {i: (len(sets[i]), root[i]) for i in range(len(texts))}
    again = neardup.near_duplicates(docs).collect()
    assert len(again) == len(texts) + 2 and all(r.kept for r in again if r.doc_id in (None, 0))
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_cluster_blocks_lose_nothing():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(50)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (neardup.intersections(sets) == np.array(want)).all()


@pytest.mark.parametrize("most_pairs", [2, 10**6])
def test_large_clusters_lose_no_links(spark, monkeypatch, most_pairs):
    """Texts of one template and their near copies, all in one cluster of many blocks, against brute force."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 6)
    monkeypatch.setattr(neardup, "MOST_PAIRS", most_pairs)
    rng = random.Random(3)
    common_part, texts = sentences(rng, 4), []
    for family in range(14):
        words = (common_part + " " + sentences(rng, 4)).split(" ")
        for _ in range(9 if family else 25):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [{tuple(t.lower().split(" ")[k : k + 5]) for k in range(len(t.split(" ")) - 4)} for t in texts]
    n = len(texts)

    def components(edges):
        root = list(range(n))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    linked = {(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = spark.createDataFrame([(i, len(x), 0) for i, x in enumerate(sets)], "doc_id long, n_shingles long, cluster long")
    got = {(max(r), min(r)) for r in neardup.cluster_links(docs, members, 80).collect()}
    assert got <= linked and components(got) == components(linked)
    assert len(set(components(linked))) > 10
    rare = neardup._rare(neardup.sets_of(docs, members), members, 80).collect()
    part = {r.doc_id: r.cluster for r in rare}
    assert all(part[i] == part[j] for i, j in linked) and len(set(part.values())) > 1


def test_suffixes(docs, plain, texts):
    seen: set[bytes] = set()
    got = by_id(suffix_dedup.dedup_suffixes(plain))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(raw[s : s + 100])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.dedup_suffixes(docs).count() == len(texts) + 2
    assert suffix_dedup.dedup_suffixes(docs.where("false")).count() == 0


def in_steps(texts: list[tuple[int, str]], per_batch: int) -> dict[int, np.ndarray]:
    """The removed bytes of each document, by the operator's steps run one after the other on batches."""
    import pyarrow as pa

    def batch(rows, names):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    def rows_of(batches):
        return [tuple(r.values()) for b in batches for r in b.to_pylist()]

    found = rows_of(suffix_dedup._found(batch(texts[i : i + per_batch], ["doc_id", "text"]) for i in range(0, len(texts), per_batch)))
    found.sort(key=lambda r: r[:2])
    names = ["anchor", "doc_id", "run"]
    near = rows_of(suffix_dedup._partnered(batch(found[i : i + 50], names) for i in range(0, len(found), 50)))
    lists = {}
    for anchor, doc, run in near:
        lists.setdefault(doc, []).append({"anchor": anchor, "run": run})
    listed = pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts if d in lists]), pa.array([t for d, t in texts if d in lists]), pa.array([lists[d] for d, _ in texts if d in lists], pa.list_(pa.struct([("anchor", pa.int64()), ("run", pa.int64())])))], ["doc_id", "text", "runs"])
    parts = sorted(rows_of(suffix_dedup._suffixes(iter([listed]))), key=lambda r: r[:3])
    kinds = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("place", pa.int16()), ("bytes", pa.binary())])
    dealt = [pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*parts[i : i + 30], strict=True), kinds, strict=True)], schema=kinds) for i in range(0, len(parts), 30)]
    spans = rows_of(suffix_dedup._blocks(iter(dealt)))
    for doc, runs in lists.items():
        spans += [(doc, r["run"] >> suffix_dedup.FIRST, r["anchor"]) for r in runs if (r["run"] >> suffix_dedup.COUNT) & 127 == 0]
    gone = {d: np.zeros(len(t.encode()), bool) for d, t in texts}
    for doc, a, z in spans:
        gone[doc][a:z] = True
    return gone


def removed_bytes(texts: list[tuple[int, str]]) -> dict[int, np.ndarray]:
    seen, out = set(), {}
    for d, t in sorted(texts):
        raw = t.encode()
        out[d] = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                out[d][s : s + 100] = True
            seen.add(raw[s : s + 100])
    return out


@pytest.mark.parametrize("piece, block, per_batch, many", [(8 << 20, 3 << 20, 100, 2000), (8 << 20, 3 << 20, 3, 2), (600, 3 << 20, 4, 5), (8 << 20, 2000, 2, 1), (700, 1500, 1, 2000), (700, 1500, 1, 3)])
def test_suffixes_in_chunks_pieces_and_blocks(monkeypatch, piece, block, per_batch, many):
    """Passages within and across documents, chunks, pieces of a text and blocks of a bucket; padding and periods; split anchors."""
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rng = random.Random(13)
    some = lambda n, a="abcdefghij": "".join(rng.choice(a) for _ in range(n))
    passages = [some(n) for n in (1500, 700, 100, 101, 99, 260)] + ["xy" * 150, "z" * 333, some(37) * 9]
    texts = []
    for i in range(40):
        parts = [x for _ in range(rng.randint(0, 4)) for x in (some(rng.randint(0, 300), "klmnopqrst"), rng.choice(passages)[rng.randint(0, 40) :])]
        texts.append((100 - i if i % 2 else i, "".join([*parts, some(rng.randint(0, 90))])))
    texts += [(500, texts[3][1]), (501, texts[3][1]), (502, ""), (503, "é" * 200)]
    want = removed_bytes(texts)
    got = in_steps(texts, per_batch)
    assert {d: g.tolist() for d, g in got.items()} == {d: g.tolist() for d, g in want.items()}
    assert sum(g.sum() for g in want.values()) > 5000


def test_stock_phrase_in_many_contexts_is_split(monkeypatch):
    """One anchor of thousands of differing runs: small buckets, and the repeats among them are found all the same."""
    monkeypatch.setattr(suffix_dedup, "MANY", 200)
    rng = random.Random(17)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    for phrase in ("all rights are reserved by owner", "this page was last changed by a user; its text is under a licence"):
        contexts = [some(90) + phrase + some(90) for _ in range(3000)]
        texts = [(i, contexts[i] if i % 10 else contexts[i // 2]) for i in range(3000)]
        sizes = []
        real = suffix_dedup._sorted_block
        monkeypatch.setattr(suffix_dedup, "_sorted_block", lambda rows, real=real, sizes=sizes: sizes.append(np.unique(rows.column("bucket").to_numpy(), return_counts=True)[1].max()) or real(rows))
        got = in_steps(texts, 50)
        monkeypatch.setattr(suffix_dedup, "_sorted_block", real)
        want = removed_bytes(texts)
        assert all((got[d] == want[d]).all() for d, _ in texts) and sum(g.sum() for g in want.values()) > 20_000
        assert max(sizes) <= 200


def test_suffix_array_is_sorted():
    rng = random.Random(2)
    for alphabet in (b"a", b"ab", b"abcdef"):
        t = bytes(rng.choice(alphabet) for _ in range(600))
        t += t[:300]
        starts = np.arange(len(t) - 99)
        order, same = suffix_dedup.suffix_array(np.frombuffer(t, np.uint8), starts)
        w = [t[i : i + 100] for i in starts[order]]
        assert w == sorted(w) and all((x == y) == s for x, y, s in zip(w[:-1], w[1:], same[1:], strict=True))


def test_lines(docs, plain, texts):
    seen, gone = set(), {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone.setdefault(i, set()).update(range(k, k + 3))
            seen.add(w)
    got = by_id(line_dedup.dedup_lines(plain))
    for i, t in enumerate(texts):
        kept = [x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(i, ())]
        assert (got[i].text or "") == "\n".join(kept) and got[i].n_removed == len(gone.get(i, ()))
    assert line_dedup.dedup_lines(docs).count() == len(texts) + 2
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_spans(docs, plain, texts):
    got = by_id(span_dedup.dedup_spans(plain))
    assert got[0].n_removed == 0 and got[1].n_removed > 0 and got[11].n_removed == 0
    whole = {i: re.split(r"(?<=[.!?]) ", texts[i]) for i in (11, 12)}
    repeated = set(whole[11])
    left = re.split(r"(?<=[.!?]) ", got[12].text)
    assert not repeated & {x.strip() for x in left} and got[12].n_bytes == len(texts[12].encode())
    assert all(got[i].text == texts[i] for i in (6, 7, 8, 9, 18))
    assert span_dedup.dedup_spans(docs).count() == len(texts) + 2
    assert span_dedup.dedup_spans(docs.where("false")).count() == 0


def test_spans_by_brute_force(spark):
    """All runs of five whole sentences or of 20 words: one long sentence, tails of few words, whole short texts."""
    rng = random.Random(12)

    def sentence(n):
        return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n)) + "."

    pool = [[sentence(n) for n in sizes] for sizes in ((15, 15, 4), (4, 15, 15), (25,), (30, 2, 3), (3, 2, 30), (9, 2, 9), (9, 1, 9), (60,), (1,) * 25, (1, 2, 1, 2, 1), (2, 1, 1))]
    parts = [rng.choice(pool) if rng.random() < 0.7 else [sentence(rng.randint(1, 30))] for _ in range(150)]
    rows = [[x for p in parts[i : i + 3] for x in p] for i in range(0, 150, 3)]
    rows += [pool[2], pool[2], ["one two."], ["one two."], ["one two.", "three."], ["one two.", "three."], [sentence(12), "one two."], pool[0], [sentence(2), *pool[0], sentence(40)]]
    seen, want = set(), []
    for x in rows:
        words = [s.split() for s in x]
        gone = set()
        for i in range(len(x)):
            for j in range(i, len(x)):
                run = tuple(w for s in words[i : j + 1] for w in s)
                if len(run) >= 20 or j - i >= 4 or (i, j) == (0, len(x) - 1):
                    key = (len(run) >= 20 or j - i >= 4, run)
                    if key in seen:
                        gone.update(range(i, j + 1))
                    seen.add(key)
        want.append("".join(s + " " * (k < len(x) - 1) for k, s in enumerate(x) if k not in gone))
    got = by_id(span_dedup.dedup_spans(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string")))
    assert [got[i].text for i in range(len(rows))] == want
    assert got[51].text == got[53].text == got[55].text == "" and got[56].n_removed == 0


def test_decontamination(spark, docs, texts):
    rng = random.Random(9)
    item = " ".join(f"q{rng.randrange(10_000)}" for _ in range(30))
    changed = item.replace(item.split()[15], "other")
    rows = [(1, f"some words before {item} and after"), (2, f"x {changed} y"), (3, item[: len(item) // 2]), (4, "tiny item"), (5, None), (6, "")]
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "Tiny ITEM")], "item_id long, text string")
    got = by_id(decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench))
    assert {i: r.item_ids for i, r in got.items()} == {1: [10], 2: [], 3: [], 4: [13], 5: [], 6: []}
    near = item + " " + " ".join(f"z{i}" for i in range(25))
    long_bench = spark.createDataFrame([(20, near)], "item_id long, text string")
    edited = near.split()
    edited[50] = "w"
    assert [r.item_ids for r in decontaminate.find_leaks(spark.createDataFrame([(1, "a b " + " ".join(edited))], "doc_id long, text string"), long_bench).collect()] == [[20]]
    assert decontaminate.drop_leaked(docs, bench).count() == len(texts) + 2
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == len(texts) + 2


def test_reordered_items_by_brute_force(spark):
    """Every window of an item's size, in whatever order the item's sentences stand."""
    rng = random.Random(14)

    def grams(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    items = [[f"i{j}w{rng.randrange(40)}" for _ in range(n)] for j, n in enumerate((50, 50, 80, 45, 12, 3, 200))]
    rows = []
    for j, item in enumerate(items * 4):
        at = rng.randrange(1, len(item))
        moved = item[at:] + item[:at] if j % 2 else item[len(item) // 2 :] + item[: len(item) // 2]
        edited = [w if rng.random() > 0.01 * (j // len(items)) else "x" for w in moved]
        rows.append([f"n{rng.randrange(500)}" for _ in range(rng.randrange(100))] + edited + [f"n{rng.randrange(500)}" for _ in range(rng.randrange(100))])
    rows += [items[0][25:] + items[0][:25], items[2][:74], items[2][:60], ["a"] * 100 + items[0][25:] + items[0][:25] + ["b"] * 100]
    want = {}
    for i, words in enumerate(rows):
        best = {}
        for j, item in enumerate(items):
            k = min(5, len(item))
            length = min(len(item), len(words))
            b = grams(item, k)
            for s in range(len(words) - length + 1):
                a = grams(words[s : s + length], k)
                best[j] = max(best.get(j, 0), sum((a & b).values()) / sum((a | b).values()))
        want[i] = ([j for j in best if best[j] >= 0.8], max([v for v in best.values() if v >= 0.8], default=0.0))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    got = by_id(decontaminate.find_leaks(docs, bench))
    assert {i: (r.item_ids, round(r.similarity, 9)) for i, r in got.items()} == {i: (ids, round(v, 9)) for i, (ids, v) in want.items()}
    assert want[len(rows) - 1][0] == [0]


def test_simhash_radius():
    index = decontaminate.Index([(i, " ".join(f"w{i}_{k}" for k in range(20))) for i in range(30)])
    rng = np.random.default_rng(3)
    for i in range(30):
        flip = np.zeros(256, np.uint8)
        flip[rng.choice(256, decontaminate.RADIUS, replace=False)] = 1
        moved = index.prints[i] ^ np.packbits(flip, bitorder="little").view(np.uint64)
        assert i in index.near(moved[None], 20)[1]


def test_mixing(spark, docs, texts):
    got = mixing.replicate(docs).collect()
    per = Counter((r.doc_id, r.copy) for r in got)
    assert per and max(c for (d, _), c in per.items() if d not in (0, None)) == 1
    many = spark.range(20_000).selectExpr("id as doc_id", "concat('text ', id) as text", "case when id % 4 = 0 then 'a' else 'b' end as source")
    n = {r.source: (r.n, r.rate) for r in mixing.replicate(many).groupBy("source").agg(F.count("*").alias("n"), F.max("rate").alias("rate")).collect()}
    for source, docs_ in (("a", 5000), ("b", 15_000)):
        assert abs(n[source][0] / docs_ - n[source][1]) < 0.05
    heavy = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert {r.source for r in mixing.replicate(many, heavy).select("source").distinct().collect()} == {"a"}
    for frame, weights in ((docs, None), (many, None), (many, heavy)):  # more sources than may be broadcast
        assert mixing.replicate(frame, weights).exceptAll(mixing.replicate(frame, weights, max_sources=0)).count() == 0
        assert mixing.replicate(frame, weights, max_sources=0).count() == mixing.replicate(frame, weights).count()
    assert mixing.replicate(docs.where("false")).count() == 0


def test_the_sieve_loses_no_window():
    """Fingerprints of all item-sized windows find what the sieved ones do; 1200 items are one index."""
    import pyarrow as pa

    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 4, 5, 6, 9, 20, 41))))) for i in range(1200)]
    index = decontaminate.Index(items)
    texts = []
    for _ in range(60):
        words = items[rng.randrange(1200)][1].split()
        changed = [w if rng.random() > 0.04 else rng.choice(vocabulary) for w in words]
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15))) + " " + " ".join(changed) + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15))))
    column = pa.array([*texts, None, "", "v1"])
    sieved = sorted(decontaminate.leaks(index, column))
    assert sieved == sorted(decontaminate.leaks(index, column, decontaminate._all_windows)) and len({x[0] for x in sieved}) > 30


def test_a_large_benchmark_takes_several_passes(spark):
    rng = random.Random(22)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(25))) for i in range(1000)]
    rows = [(k, f"before {items[k * 37 % 1000][1]} after") for k in range(60)] + [(100, "nothing here at all to be found by anyone"), (101, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {k: [k * 37 % 1000] for k in range(60)} | {100: [], 101: []}
    for size in (16 << 20, 25_000):
        assert {r.doc_id: r.item_ids for r in decontaminate.find_leaks(docs, bench, size).collect()} == want
        assert sorted(r.doc_id for r in decontaminate.drop_leaked(docs, bench, size).collect()) == [100, 101]


def test_secrets(spark, docs, texts):
    key = "AKIA" + "Z" * 12
    rows = [(1, f"ä password: hunter22x and {key}"), (2, "API_KEY='short' token=abcdefgh"), (3, "f" * 31 + " " + "0" * 40), (4, None), (5, "")]
    got = by_id(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), {}))
    assert got[1].spans == "assign:2:21,access:26:42" and got[2].spans == "assign:16:30" and got[3].n_hex == 1 and got[4].spans == got[5].spans == ""
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.find_secrets(docs.where("false")).count() == 0
    assert secrets.find_secrets(docs).count() == len(texts) + 2


def letters(rng: random.Random, n: int, alphabet: str = "0123456789abcdef") -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def test_infer_recovers_a_grammar():
    rng = random.Random(4)
    fixed = secrets.infer([letters(rng, 40) for _ in range(400)])
    assert len(secrets.Automaton(fixed).end) == 41  # a chain: the length is part of the format
    # lengths without memory are a loop
    loop = secrets.Automaton(secrets.infer(["k" + "a5" * int(1 + rng.expovariate(0.5)) + "." for _ in range(600)]))
    assert len(loop.end) <= 7
    assert loop.of(["k" + "a5" * 9 + "."])[0] > max(loop.of(["kaa55.", "a5a5.", "k5a5a.", "ka5"])) + 0.5
    shape = secrets.Automaton(secrets.infer(["sk-" + letters(rng, 12, "0123456789") for _ in range(200)]))
    assert shape.of(["sk-123456789012"])[0] > shape.of(["sentence-of-words"])[0] + 1
    # states of one tree with unlike lengths left, or unlike symbols, are told apart; like ones aren't
    tree = secrets.prefix_tree([letters(rng, 20) for _ in range(500)])
    assert not secrets.compatible(tree, tree.to["0"]) and secrets.compatible(tree.to["0"], tree.to["f"])
    long_ = letters(rng, 5000)
    by_hand, state = 0.0, 0
    automaton = secrets.Automaton(fixed)
    for c in long_.encode():
        by_hand, state = by_hand + automaton.cost[state, c], automaton.next[state, c]
    assert abs(automaton.of([long_])[0] - (by_hand + automaton.end[state]) / 5001) < 1e-9


def test_unseen_formats_are_found(spark):
    """Learnt from labelled values, tokens of formats that no pattern has are found, without a keyword; words, numbers and addresses aren't."""
    rng = random.Random(31)
    word = lambda: letters(rng, rng.randint(3, 13), "eeeaaoiutnsrhldcmp")
    prose = lambda n: " ".join(word() if rng.random() > 0.03 else rng.choice((letters(rng, 16, "0123456789"), f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.10", f"555-{rng.randrange(9999):04d}", "20" + letters(rng, 2, "0123456789") + "-10-11")) for _ in range(n))
    made = {"assign": lambda: "password=" + letters(rng, rng.randint(10, 24), ALNUM), "access": lambda: "AKIA" + letters(rng, 16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "hex": lambda: letters(rng, 40)}
    rows = [(i, f"{prose(60)} {made[list(made)[i % 3]]()} {prose(30)}") for i in range(600)]
    hidden = {1000 + i: x for i, x in enumerate([letters(rng, 24) for _ in range(20)] + [letters(rng, 31) for _ in range(20)] + ["ghp_" + letters(rng, 36, ALNUM) for _ in range(20)] + [letters(rng, 20, ALNUM) for _ in range(20)])}
    rows += [(i, f"é {x} {prose(20)}") for i, x in hidden.items()] + [(5000 + i, prose(100)) for i in range(300)] + [(6000, rows[0][1]), (6001, None), (6002, "x" * 200_000), (6003, letters(rng, 30_000))]
    got = by_id(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")))
    found = [i for i, x in hidden.items() if f":2:{2 + len(x)}" in got[i].spans]
    false = [i for i in range(5000, 5300) if got[i].n_learnt]
    assert len(found) >= 72 and len(false) <= 9, (len(found), len(false))
    assert all(got[i].likelihood > 0 for i in range(600)) and got[6000].spans == got[0].spans and got[6001].likelihood is None
    plain = {i: ",".join(f"{k}:{a}:{z}" for a, z, k, _ in secrets.base_spans(t or "")) for i, t in rows}
    assert all(got[i].base_sha256 == hashlib.sha256(plain[i].encode()).hexdigest() for i in plain)


def test_samples_are_full_and_bounded(spark):
    """At any number of labels: the documents of the smallest hashes, as many as rows and bytes allow."""
    n = 30_000
    docs = spark.range(n).selectExpr("id as doc_id", "repeat('x', cast(10 + id % 7 as int)) as text", "'e' as extra")
    labels = spark.range(2 * n).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    fold = toxicity.training_fold()
    assert toxicity.train_rows(docs, labels, "toxic", fold, 500, "t").count() == 500
    few = toxicity.train_rows(docs, labels, "toxic", fold, 500, "t", 1000)
    assert 60 <= few.count() <= 100 and few.selectExpr("sum(length(text)) as s").first().s <= 1000
    assert toxicity.train_rows(docs, labels, "toxic", fold, n, "t").count() == docs.where(fold).count()
    # a larger table of labels only moves the cut
    a = toxicity.train_rows(docs.withColumn("text", F.col("doc_id").cast("string")), labels.where(f"doc_id < {n}"), "toxic", fold, 500, "t")
    hashes = docs.where(fold).select(F.xxhash64("doc_id", F.lit(17)).alias("h"), F.col("doc_id").cast("string").alias("t")).orderBy("h").limit(500)
    assert {r.text for r in a.collect()} == {r.t for r in hashes.collect()}


def test_scores_by_brute_force(spark):
    """Toxic segments by trying all, and attention passage by passage; nulls, empty texts and repeated rows with a fitted model."""
    rng = random.Random(18)
    rows = [(i, " ".join(rng.choice(("calm", "green", "house", "vilefool", "nastygit", "river", "walk")) for _ in range(rng.randint(1, 90))), i % 2) for i in range(60)]
    model = toxicity.Model(words={"vilefool": 2.0, "nastygit": 1.2}, scale=0.8, rate=0.05, slope=0.7, height=-0.4)
    texts = [*rows, (100, None, 0), (101, "", 0), (0, rows[0][1], 0), (None, rows[1][1], 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score long")
    got = toxicity.score(docs, model).collect()

    def plainly(text):
        s = [model.words.get(w, -toxicity.OFFSET) for w in (text or "").split()]

        def split(a, z):
            best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=(0,))
            return [] if best[0] <= 1e-12 else [*split(a, best[3]), best[0], *split(best[4], z)]

        found = split(0, len(s))
        x = [0.8 * v - np.log(0.05 * max(1, len(s))) for v in found]
        strong = sum(v for v in x if v > 0)
        e = min(toxicity.CEILING, strong) if strong > 0 else max([toxicity.FLOOR, *x])
        return 1 / (1 + np.exp(-np.clip(0.7 * e - 0.4, -30, 30)))

    want = sorted((d is None, d or 0, round(plainly(t), 9)) for d, t, _ in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9)) for r in got) == want
    assert toxicity.keep_clean(docs, model).count() == sum(x[2] < 0.5 for x in want)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    weights = quality.fit(docs, labels)
    for r in quality.score(docs, weights).collect():
        words = (next(t for d, t, _ in texts if d == r.doc_id) or "").split()
        parts = [" ".join(words[i : i + quality.PASSAGE]) + (" " if i + quality.PASSAGE < len(words) else "") for i in range(0, max(1, len(words)), quality.PASSAGE)]
        x = np.stack([quality.passages(*_bytes(p))[0][0] for p in parts])
        h = np.tanh((x - weights["mean"]) / weights["spread"] @ weights["w"] + weights["b"])
        e = np.exp([np.tanh(v @ weights["v"]) * (1 / (1 + np.exp(-(v @ weights["u"])))) @ weights["a"] for v in h])
        z = sum(w * v for w, v in zip(e / e.sum(), h, strict=True)) @ weights["c"] + weights["d"][0]
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.n_passages == len(parts)


def _bytes(text: str):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_toxicity_and_quality(spark, docs, texts):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"{rng.choice(('ka', 'lo', 'mi', 'te'))}{rng.choice(('ra', 'no', 'su'))}{rng.choice('aeiou')}" for _ in range(60)]
        if bad:
            words[10], words[11] = "grumblefool", "nastyword"
        junk = i % 5 == 0
        rows.append((i, "!! ".join(words).upper() if junk else " ".join(words) + "."))
        labels.append((i, 0 if junk else 1, 1 if bad else 0))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    tox = by_id(toxicity.score(d, toxicity.fit(d, lab)))
    assert sum((tox[i].score >= 0.5) == bool(t) for i, _, t in labels) >= 395
    q = by_id(quality.score(d, quality.fit(d, lab)))
    assert sum((q[i].score >= 0.7) == bool(x) for i, x, _ in labels) >= 395
    for model, score, usual in ((toxicity.fit(docs, lab.where("false")), toxicity.score, 0.02), (quality.fit(docs, lab.where("false")), quality.score, 0.5)):
        found = score(docs, model).collect()
        assert len(found) == len(texts) + 2 and all(abs(r.score - usual) < 1e-9 for r in found)


def test_maximal_segments():
    def brute(s, a, z):
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=(0,))
        return [] if best[0] <= 1e-12 else [*brute(s, a, best[3]), best[3:], *brute(s, best[4], z)]

    rng = random.Random(6)
    for _ in range(200):
        s = np.array([rng.choice((-3, -2, -1, 1, 2, 3)) + rng.random() / 100 for _ in range(rng.randint(0, 12))])
        assert [x[:2] for x in toxicity.maximal_segments(s)] == brute(s, 0, len(s))


def test_spans_of_a_long_text_are_united(spark):
    """A text of many overlapping spans: a row a part goes on, not one for each span."""
    long = "x. " * 200_000
    got = by_id(span_dedup.dedup_spans(spark.createDataFrame([(1, long), (2, "fresh words here. " + long[:300]), (3, "nothing of that.")], "doc_id long, text string")))
    assert got[1].n_spans == got[2].n_spans == 1 and got[3].n_removed == 0
    assert len(got[1].text) < 100 and got[2].text == "fresh words here. " and got[1].n_removed + len(got[1].text) == len(long)


def test_unions_of_intervals():
    rng = random.Random(8)
    for _ in range(300):
        rows = sorted((rng.randrange(3), rng.randrange(30)) for _ in range(rng.randrange(20)))
        group, start = (np.array([r[i] for r in rows], np.int64) for i in range(2))
        stop = start + np.array([rng.randrange(1, 8) for _ in rows], np.int64)
        first, a, z = span_dedup.islands(start, stop, group)
        want = {(g, i) for g, s, e in zip(group, start, stop) for i in range(s, e)}
        assert {(group[f], i) for f, s, e in zip(first, a, z) for i in range(s, e)} == want and sum(z - a) == len(want)
