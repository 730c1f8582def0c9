"""Blocked link prediction and typed negatives against plain loops, range counting, running top-k and sessions as a stream."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailknit.operators import affinity as A
from trailknit.operators import examples as X
from trailknit.operators import groups as G
from trailknit.operators import links as L
from trailknit.operators import metric as M
from trailknit.operators import ordering as O
from trailknit.streaming import sessions as S

rng = random.Random(3)


def plain_score(h, rel, t):
    c = np.log1p(np.exp(rel["curvature"])) + 1e-4
    ball = lambda v: np.tanh(np.sqrt(c) * np.linalg.norm(v)) * np.array(v) / (np.sqrt(c) * max(np.linalg.norm(v), 1e-15))
    x, y, t_ = ball(h["x"]), ball(rel["x"]), ball(t["x"])
    xy, xx, yy = x @ y, x @ x, y @ y
    m = ((1 + 2 * c * xy + c * yy) * x + (1 - c * xx) * y) / (1 + 2 * c * xy + c * c * xx * yy)
    q = np.concatenate([[np.cos(a) * m[2 * i] - np.sin(a) * m[2 * i + 1], np.sin(a) * m[2 * i] + np.cos(a) * m[2 * i + 1]] for i, a in enumerate(rel["angles"])])
    d = np.arccosh(max(1 + 2 * c * ((q - t_) @ (q - t_)) / ((1 - c * (q @ q)) * (1 - c * (t_ @ t_))), 1 + 1e-7)) / np.sqrt(c)
    return round(-d * d + h["head_bias"] + t["tail_bias"], 9)


@pytest.fixture(scope="module")
def model(spark):
    vector = lambda n: [rng.uniform(-0.6, 0.6) for _ in range(n)]
    entities = [{"id": i, "type": "ab"[i % 3 == 0], "x": vector(4), "head_bias": rng.random() / 5, "tail_bias": rng.random() / 5} for i in range(40)]
    entities[7] |= {"x": entities[9]["x"], "tail_bias": entities[9]["tail_bias"]}  # a tie
    relations = [{"r": r, "x": vector(4), "angles": vector(2), "curvature": c} for r, c in (("likes", 0.0), ("near", 0.8))]
    triples = {(0, "likes", t) for t in range(1, 30)} | {(rng.randrange(40), rng.choice(("likes", "near")), rng.randrange(40)) for _ in range(60)} | {(3, "near", 7), (3, "near", 9)}
    e = spark.createDataFrame([tuple(x.values()) for x in entities], "id long, type string, x array<double>, head_bias double, tail_bias double")
    r = spark.createDataFrame([tuple(x.values()) for x in relations], "r string, x array<double>, angles array<double>, curvature double")
    t = spark.createDataFrame([*triples, *list(triples)[:5], (99, "likes", 1), (1, "other", 2), (1, "likes", 99), (None, "likes", 1)], "h long, r string, t long")
    return entities, {x["r"]: x for x in relations}, triples, e, r, t


@pytest.mark.parametrize("block", [2048, 7])
def test_filtered_ranks_by_a_plain_loop(model, block):
    entities, relations, triples, e, r, t = model
    got = {tuple(x)[:3]: x.rank for x in L.tail_ranks(t, t, e, r, block).collect()}
    assert got.keys() == triples
    for h, rel, tail in triples:
        score = [plain_score(entities[h], relations[rel], x) for x in entities]
        assert got[h, rel, tail] == 1 + sum(s > score[tail] and (h, rel, i) not in triples for i, s in enumerate(score))
    assert L.tail_ranks(t.where("false"), t, e, r).count() == 0


def test_negatives_are_typed_and_unknown(model):
    entities, _, triples, e, _, t = model
    got = L.typed_negatives(t, t, e, ["near"], n=6, attempts=12).collect()
    assert {(x.h, x.r, x.t) for x in got} >= triples and not {(x.h, x.r, x.negative) for x in got} & triples
    assert all(entities[x.negative]["type"] == entities[x.t]["type"] for x in got if x.r == "near")
    assert any(entities[x.negative]["type"] != entities[x.t]["type"] for x in got if x.r == "likes")
    assert len({(x.h, x.r, x.t, x.draw) for x in got}) == len(got) > 5 * len(triples)


def test_values_at_places(spark):
    values = [rng.choice((-1e9, 0.0, 3.5, rng.random(), rng.random() * 1e6)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "s double").coalesce(1).cache()
    places = [0, 1, 700, 1500, 2998, 2999]
    assert A.ranked_values(df, "s", places, few=20, bins=16) == [sorted(values)[p] for p in places]
    for none in (-2e9, 0.25):
        full = np.array(values + [none] * 1234)
        for p in (0, 50, 77.7, 100):
            assert A.cut_score(df, "s", p, len(full), none) == pytest.approx(np.percentile(full, p), abs=1e-6)


def test_numbers_in_order(spark):
    rows = [(rng.randrange(20), i) for i in range(500)]
    got = O.numbered(spark.createDataFrame(rows, "a long, b long").repartition(7), [-F.col("a"), F.col("b")], "n").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (-r[0], r[1])) and sorted(r.n for r in got) == list(range(500))


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_top_by_a_plain_loop(spark, width):
    visits = [(u, rng.randrange(60), rng.choice((*"abcdef", None))) for u in (1, 2) for _ in range(150)]
    moments = sorted({(u, rng.randrange(70)) for u in (1, 2, 3) for _ in range(40)})
    got = defaultdict(list)
    for r in X.running_top(spark.createDataFrame(visits, "user_id long, t long, value string"), spark.createDataFrame(moments, "user_id long, t long"), 3, width).orderBy("rank").collect():
        got[r.user_id, r.t].append((r.value, r.n))
    for u, t in moments:
        before = [(x, v) for w, x, v in visits if w == u and x < t]
        n, first = Counter(v for _, v in before), {}
        for x, v in before:
            first[v] = min(x, first.get(v, x))
        assert got.get((u, t), []) == [(v, n[v]) for v in sorted(n, key=lambda v: (-n[v], first[v], v is not None, v or ""))[:3]]


def test_sessions_as_a_stream(spark, tmp_path):
    start = datetime(2024, 3, 9, 20, 0)  # an hour goes missing in New York the next night
    rows = [(i, rng.randrange(5), rng.randrange(6), start + timedelta(minutes=rng.randrange(4000), seconds=rng.randrange(60))) for i in range(400)]
    rows += [(1000, 9, 1, start), (1001, 9, 2, start + timedelta(minutes=60)), (1002, 9, 1, start + timedelta(minutes=121))]
    end = (5000, 8, 1, start + timedelta(days=9))
    schema = "event_id long, poi_idx long, user_id long, utc_time timestamp_ntz"
    batches = [sorted(rows, key=lambda r: r[3])[:200], [*sorted(rows, key=lambda r: r[3])[200:], end]]
    batches[1].append(batches[0].pop(150))  # a late row, within the day allowed
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        S.run_to_table(S.stream_sessions(stream, late="3 days"), f"{tmp_path}/out", f"file://{tmp_path}/state")
    got = {(r.poi_idx, r.start_minute, r.end_minute, r.n_checkins, tuple(r.users)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    table = spark.createDataFrame(rows, schema).withColumn("minute", F.expr("timestampdiff(MINUTE, timestamp_ntz'1970-01-01', utc_time)"))
    want = G.gap_sessions(table, 60, ["event_id"]).groupBy("poi_idx", "session").agg(F.min("minute").alias("a"), F.max("minute").alias("z"), F.count("*").alias("n"), F.array_sort(F.collect_set("user_id")).alias("u")).collect()
    assert got == {(r.poi_idx, r.a, r.z, r.n, tuple(r.u)) for r in want}
    assert {(r[0], r[3]) for r in got if r[0] == 9} == {(9, 2), (9, 1)}


@pytest.mark.parametrize("heavy, block", [(0, 5), (3, 4), (3, 1000), (1000, 5)])
def test_cosine_pairs_by_a_plain_loop(spark, heavy, block):
    w = {(u, k): rng.random() for u in range(30) for k in "abcdefghij" if rng.random() < (0.9 if k < "c" else 0.1)}
    df = spark.createDataFrame([(u, k, x) for (u, k), x in w.items()] + [(None, "a", 0.5), (3, None, 0.5)], "user_id long, key string, w double")
    want = {}
    for u in range(30):
        for v in range(u + 1, 30):
            both = [w[u, k] * w[v, k] for k in "abcdefghij" if (u, k) in w and (v, k) in w]
            if both:
                want[u, v] = sum(both)
    got = {(r.u1, r.u2): r.value for r in A.cosine_pairs(df, 0.0, heavy, block).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    some = {(r.u1, r.u2): r.value for r in A.cosine_pairs(df, 0.8, heavy, block).where("value >= 0.8").collect()}
    assert some.keys() == {k for k, v in want.items() if v >= 0.8} and all(abs(some[k] - want[k]) < 1e-9 for k in some)


@pytest.mark.parametrize("metric", ["hyperbolic", "euclidean"])
def test_all_nearest_by_a_plain_loop(spark, metric):
    centres = [[rng.uniform(-0.5, 0.5) for _ in range(3)] for _ in range(4)]
    x = [[v + rng.gauss(0, 0.02) for v in rng.choice(centres)] for _ in range(120)] + [centres[0]] * 3 + [[0.0] * 3]
    near, counts = M.all_nearest(spark.createDataFrame([*enumerate(x), (None, None)], "id long, x array<double>"), "id", "x", 4, metric, pivots=6, block=16)
    got = {(r.id, r.neighbour): r.distance for r in near.collect()}
    d = M.distances(np.array(x), np.array(x), metric)
    for i in range(len(x)):
        want = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        assert sorted((v, j) for (k, j), v in got.items() if k == i) == want
    c = counts.first()
    assert c.n_points == len(x) and 0 < c.n_candidates < len(x) ** 2
    tiled, again = M.all_nearest(spark.createDataFrame([*enumerate(x)], "id long, x array<double>"), "id", "x", 4, metric, pivots=6, block=16, tile=40)
    assert {(r.id, r.neighbour): r.distance for r in tiled.collect()} == got and again.first() == c


@pytest.mark.parametrize("metric, many, tile", [("hyperbolic", 5, 20), ("euclidean", 5, 20), ("euclidean", 1000, 1000)])
def test_nearest_to_queries_by_a_plain_loop(spark, metric, many, tile):
    """Equal points are equally far, though a product of their vectors may tell them apart."""
    x = [[rng.uniform(-0.5, 0.5) for _ in range(3)] for _ in range(60)]
    x += [x[3], x[3], x[6], *[x[9]] * 8]
    df = spark.createDataFrame([*enumerate(x), (999, None)], "id long, x array<double>")
    got = sorted(tuple(r) for r in M.nearest_to(df, df.where("id % 3 = 0"), "id", "x", 4, metric, many, tile).select("id", "distance", "neighbour").collect())
    want = []
    for i in range(0, len(x), 3):
        gap = [float(((np.array(x[i]) - np.array(y)) ** 2).sum()) for y in x]
        far = [g**0.5 if metric == "euclidean" else np.arccosh(max(1 + 2 * g / ((1 - np.dot(x[i], x[i])) * (1 - np.dot(y, y))), 1 + 1e-7)) for g, y in zip(gap, x, strict=True)]
        want += [(i, round(float(d), 9), j) for d, j in sorted((round(float(d), 9), j) for j, d in enumerate(far) if j != i)[:4]]
    assert [(i, j) for i, _, j in got] == [(i, j) for i, _, j in sorted(want)] and np.allclose([d for _, d, _ in got], [d for _, d, _ in sorted(want)], atol=2e-9)


def test_heads_travel_once_for_all_their_tails(model, monkeypatch):
    """29 tails of one head are one row beside its point."""
    *_, e, r, t = model
    written, cut = {}, L.cut
    monkeypatch.setattr(L, "cut", lambda df, name: written.setdefault(name, cut(df, name)))
    L.tail_ranks(t, t, e, r).count()
    assert all(df.count() == df.select("h", "r").distinct().count() for df in written.values() if "point" in df.columns)
    assert any("point" in df.columns for df in written.values())


@pytest.mark.parametrize("metric", ["hyperbolic", "euclidean"])
def test_the_nearest_are_measured_alone(monkeypatch, metric):
    """Of 300 others each, some equally far, few distances are worked out; ties go by id."""
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(100, 4)), 3, axis=0) * 0.1
    ids, want, d = np.arange(300), [], M.distances(x, x, metric)
    for i in range(300):
        want += [(i, j, d[i, j]) for j in sorted((j for j in range(300) if j != i), key=lambda j: (d[i, j], j))[:5]]
    far, seen = M._far, []
    monkeypatch.setattr(M, "_far", lambda gap, *more: (seen.append(gap.size), far(gap, *more))[1])
    got = M._best(ids, ids, x, x, 5, metric)
    assert list(got[["id", "neighbour"]].itertuples(index=False, name=None)) == [w[:2] for w in want]
    assert np.allclose(got["distance"], [w[2] for w in want], atol=1e-9) and sum(seen) < 300 * 300 / 2
