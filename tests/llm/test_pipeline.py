"""Each stage of the pipeline, and all of them together, against plain versions; and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random

import corpus_pipeline
import pytest

from trailknit.llm import common, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, rate string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(41)
    word = lambda: rng.choice("ka lo mi te su ra no".split()) + rng.choice("ra no su ti po".split()) + str(rng.randrange(30))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [line(30) for _ in range(5)]
    shared = [line(8) for _ in range(4)]
    texts = []
    for i in range(260):
        lines = [line(rng.randint(8, 20)) for _ in range(rng.randint(2, 6))]
        if i % 4 == 0:
            lines[0] += " grumblefool nastyword dreadfulgit"
        if i % 9 == 1:
            lines[1:1] = shared
        if i % 13 == 2:
            lines.append(f"so {items[i % 5]} end")
        texts.append("\n".join(lines))
    base = line(120)
    texts += [base, base, base.replace(base.split()[60], "changed"), " ".join(base.split()[:60]), None, "", "one\ntwo\nthree", "one\ntwo\nthree", "\n\n\n\n"]
    rows = [(i, t, "en", "ab"[i % 3 > 0] if i % 11 else None, len(t or ""), "h", "r") for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (None, "x"), (9, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def shingled(words, k=5):
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def plain_lines(rows):
    seen, out = set(), {}
    for i in sorted(rows):
        lines, gone = (rows[i] or "").split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone.update(range(k, k + 3))
            seen.add(w)
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or text.strip(" "):
            out[i] = text if gone else rows[i]
    return out


def plain_near(rows):
    sets = {i: set(shingled((t or "").lower().split())) for i, t in rows.items()}
    root = {i: i for i in rows}
    for i in rows:
        for j in rows:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return {i: rows[i] for i in rows if root[i] == i}


def plain_clean(rows, items):
    from collections import Counter

    out = {}
    for i, t in rows.items():
        w = (t or "").lower().split()
        leak = False
        for item in items:
            x = item.lower().split()
            k, n = min(5, len(x)), min(len(x), len(w))
            b = Counter(shingled(x, k))
            for s in range(len(w) - n + 1 if n >= k else 0):
                a = Counter(shingled(w[s : s + n], k))
                leak |= sum((a & b).values()) >= 0.8 * sum((a | b).values())
        if not leak:
            out[i] = t
    return out


def plain_mix(rows, source):
    mass = {}
    for i, t in rows.items():
        mass[source[i]] = mass.get(source[i], 0) + len(t or "")
    parts, total = sum(math.sqrt(m) for m in mass.values()), sum(mass.values())
    out = []
    for i in rows:
        rate = math.sqrt(mass[source[i]]) / parts * total / mass[source[i]]
        u = int(hashlib.md5(f"mix-1-1-{i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        out += [(i, k) for k in range(1, n + 1)]
    return sorted(out)


def test_stages_by_brute_force(spark, folder):
    docs = common.read(spark, folder, "documents")
    first = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    items = [r.text for r in common.read(spark, folder, "benchmark").where("item_id is not null and text is not null").collect()]
    model = toxicity.fit(docs, common.read(spark, folder, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    got, want = docs, first
    steps = {
        "toxicity": lambda rows: {i: t for i, t in rows.items() if scores[i] < 0.5},
        "line_dedup": plain_lines,
        "near_dedup": plain_near,
        "decontamination": lambda rows: plain_clean(rows, items),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, before = common.cut(stage(spark, got, folder), name), len(want)
        want = steps[name](want)
        assert {r.doc_id: r.text for r in got.collect()} == want, name
        assert len(want) < before or name == "line_dedup"
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        assert all(r.n_chars == len(r.text or "") for r in got.collect())
    toxic = [i for i in range(260) if i % 4 == 0]
    assert sum(scores[i] >= 0.5 for i in toxic) >= 0.95 * len(toxic) and sum(scores[i] >= 0.5 for i in first if i not in toxic) <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, got, folder)
    assert sorted((r.doc_id, r.copy) for r in last.collect()) == plain_mix(want, source)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.copy, r.text) for r in whole.collect()) == sorted((i, k, want[i]) for i, k in plain_mix(want, source))


def test_stages_on_awkward_tables(spark, folder):
    """Nulls in every column, repeated rows, ties, columns named like the operators' own, and no rows."""
    docs = common.read(spark, folder, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None, None, None), (None, "one\ntwo\nthree", None, None, 1, None, "2"), (7, "a b c", "en", "s", 5, "h", "x"), (7, "a b c", "en", "s", 5, "h", "x"), (8, "word " * 30_000, None, "s", 1, None, None)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
        out = stage(spark, odd, folder)
        assert set(docs.columns) <= set(out.columns)
        if name in ("toxicity", "decontamination"):
            assert out.count() == 5
        if name == "near_dedup":
            assert out.where("doc_id is null").count() == 2 and out.where("doc_id = 7").count() == 2
