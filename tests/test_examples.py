"""Planted companions, group examples and Frechet means."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trailknit.functions import hyperbolic as H
from trailknit.operators import affinity as A
from trailknit.operators import companions as M
from trailknit.operators import examples as X
from trailknit.operators import groups as G
from trailknit.operators import texts as N


def anchors(spark, rows):
    return spark.createDataFrame(rows, "user_id long, pos int, minute long, size int")


def test_best_clique_takes_the_highest_least_score(spark):
    """From 1, the strongest neighbour is 2; of 3 and 4, which both know 1 and 2, 4's least score is higher."""
    edges = spark.createDataFrame([(1, 2, 9.0), (1, 3, 8.0), (2, 3, 1.0), (1, 4, 3.0), (2, 4, 4.0), (1, 5, 7.0)], "u1 long, u2 long, score double")
    got = {r.anchor: (r.members, r.least) for r in A.grow_best(edges, spark.createDataFrame([(1,), (5,), (77,)], "anchor long"), 3).collect()}
    assert got == {1: ([1, 2, 4], 3.0)}


def test_established_are_cliques(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "u1 long, u2 long")
    asked = anchors(spark, [(u, p, 0, 2 + p % 3) for u in (1, 4, 9) for p in range(2, 14)])
    got = M.established(asked, edges, sizes=(2, 3, 4)).join(asked, ["user_id", "pos"]).collect()
    linked = {frozenset(e) for e in ((1, 2), (1, 3), (2, 3), (3, 4))}
    assert {r.user_id for r in got} == {1, 4}
    for r in got:
        assert r.members[0] == r.user_id and len(r.members) == r["size"] <= 3
        assert all(frozenset((a, b)) in linked for a in r.members for b in r.members if a != b)


def test_occasional_need_an_earlier_quiet_group_and_a_recurring_companion(spark):
    groups = spark.createDataFrame([(0, 10, 100, 110, [1, 2, 3]), (1, 20, 100, 110, [1, 8, 9]), (2, 10, 900, 910, [1, 2, 7])], "group_id long, poi_idx long, start_minute long, end_minute long, members array<long>")
    rarity = spark.createDataFrame([(10, 5, 1.0), (20, 500, 0.1)], "poi_idx long, n_users long, rarity double")
    ties = G.co_attended(groups, rarity)
    asked = anchors(spark, [(1, 2, 500, 3), (1, 3, 500, 2), (1, 4, 100, 2), (3, 2, 500, 2), (8, 2, 500, 2), (1, 5, 500, 4)])
    got = {(r.user_id, r.pos): r.members for r in M.occasional(asked, groups, rarity, ties).collect()}
    assert got == {(1, 2): [1, 2, 3], (1, 3): [1, 2]}
    free = {(r.user_id, r.pos): len(r.members) for r in M.occasional(asked, groups, rarity, ties, least_repeat=1).collect()}
    assert free == {(1, 2): 3, (1, 3): 2, (3, 2): 2}


def test_uniform_draws_others_alike(spark):
    users = spark.createDataFrame([(10 * u,) for u in range(6)], "user_id long")
    asked = anchors(spark, [(20, p, 0, 4) for p in range(600)] + [(30, 0, 0, 7)])
    got = M.uniform(asked, users).collect()
    assert len(got) == 600 and all(r.members[0] == 20 and len(set(r.members)) == 4 for r in got)
    n = np.unique([m for r in got for m in r.members[1:]], return_counts=True)
    assert n[0].tolist() == [0, 10, 30, 40, 50] and abs(n[1] - 360).max() < 60


def test_examples_fail_for_the_first_reason(spark):
    """Users 1 and 2 share all; 3 never goes to category B; 4 has one check-in; 5 has none."""
    rows = [(u, m * 10 + u, 100 + m % 2, "AB"[m % 2]) for u in (1, 2) for m in range(8)] + [(3, m * 10 + 3, 100, "A") for m in range(8)] + [(4, 5, 101, "B")]
    visits = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, minute long, poi_idx long, category string")
    visits = visits.withColumns({"prefix": F.col("category"), "utc_time": F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, cast(minute as int), 0)")}).withColumn("hour", F.hour("utc_time"))
    offers = spark.createDataFrame([("r", 1, 9, 200, [1, 2]), ("r", 1, 8, 201, [1, 3]), ("r", 1, 7, 202, [1, 4]), ("r", 1, 6, 203, [1, 5]), ("r", 1, 5, 204, None), ("r", 1, 4, 1, [1, 2])], "regime string, user_id long, pos int, minute long, members array<long>")
    offers = offers.withColumns({"poi_idx": F.lit(101).cast("long"), "prefix": F.lit("B"), "split": F.lit("train"), "size": F.lit(2), "utc_time": F.expr("timestamp_ntz'1970-01-01 03:20:00'")})
    examples, tested = X.group_examples(offers, visits)
    assert {r.pos: r.reason for r in tested.collect()} == {9: "emitted", 8: "constraint", 7: "inactive", 6: "constraint", 5: "no_companions", 4: "constraint"}
    e = examples.first()
    assert (e.example_id, e.size, e.heterogeneity, e.target, e.t_hour, e.t_dow) == ("train_0000000", 2, 0.0, 101, 3, "Thursday")
    assert len(e.hist) == len(e.hist_hours) == len(e.hist_owner) == 15 and e.hist_owner[:3] == [2, 1, 2] and e.hist[:3] == [100, 101, 101]
    assert [(p.n_seen, [tuple(t) for t in p.top_pois], p.top_cats) for p in e.member_profiles] == [(8, [(100, 4), (101, 4)], ["A", "B"])] * 2
    f = X.funnel(tested).first()
    assert (f.n_offers, f.candidates, f.constraint, f.inactive, f.emitted) == (6, 5, 3, 1, 1)
    loose, _ = X.group_examples(offers.where("pos = 6"), visits, constraint=False, min_active=0)
    assert loose.count() == 0  # a history of the anchor alone
    none, _ = X.group_examples(offers.where("false"), visits)
    assert none.count() == 0


def test_frechet_mean_has_no_gradient(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 4)) * 0.2
    df = spark.createDataFrame([(i // 4, float(i % 3), v.tolist()) for i, v in enumerate(x)], "g long, w double, x array<double>")
    means = H.frechet_means(df, "g", "x", "w")
    pull = df.join(means, "g").select("g", "w", H.logmap(F.col("mean"), F.col("x")).alias("u")).collect()
    assert len({r.g for r in pull}) == 3
    for g in range(3):
        assert np.abs(sum(r.w * np.array(r.u) for r in pull if r.g == g)).max() < 1e-6


def test_best_window(spark):
    t = spark.createDataFrame([(30, 5, "SPARSE"), (60, 7, "SPARSE"), (90, 7, "SPARSE")], "window_min int, n_transitions long, verdict string")
    assert G.best_window(t).first().window_min == 60 and G.best_window(t.where("false")).count() == 0


def test_text_of_an_example(spark):
    rows = [(1, 1, 7, "Bar", 9, "train"), (1, 2, 8, None, 21, "train"), (1, 3, 7, "Bar", 9, "test"), (2, 1, 8, None, 5, "train")]
    visits = spark.createDataFrame(rows, "user_id long, pos int, poi_idx long, category string, hour int, split string").withColumn("utc_time", F.expr("timestamp_ntz'2024-01-01 09:30:00'"))
    friends = N.friends_texts(spark.createDataFrame([(1, 2), (2, 3)], "u1 long, u2 long"), visits.where("split = 'train'"))
    assert {r.user_id for r in friends.collect()} == {1, 2, 3}
    got = N.example_texts(visits, "test", friends).collect()
    assert [(r.user_id, r.pos, r.target) for r in got] == [(1, 3, 7)]
    assert got[0].text == N.HEAD + (
        "[user profile]\ncheck-ins so far: 2\nmost visited: <poi_7> (Bar, x1), <poi_8> (Venue, x1)\nfavourite categories: Bar, Venue\nusual hours: 9:00, 21:00\n"
        "[friends]\n1 friends in the network\nfriends' favourite places: <poi_8> (Venue, x1)\n"
        "[recent check-ins]\n<poi_7> (Bar, 9:00)\n<poi_8> (Venue, 21:00)\n[current time] Monday 9:00\n[next POI] "
    )
    plain = N.example_texts(visits, "train", profiles=False).collect()
    assert [(r.user_id, r.text) for r in plain] == [(1, N.HEAD + "[recent check-ins]\n<poi_7> (Bar, 9:00)\n[current time] Monday 21:00\n[next POI] ")]


def test_reasons_and_distances_by_a_plain_loop(spark, monkeypatch):
    """Many check-ins in one minute, and members who come to the anchor's history late."""
    rng = random.Random(5)
    rows = [(i, u, rng.randrange(12 if u < 4 else 40), rng.randrange(4), rng.choice("ABC")) for i, u in enumerate(rng.choice(range(7)) for _ in range(150))]
    visits = spark.createDataFrame([(*r, r[2] % 24) for r in rows], "event_id long, user_id long, minute long, poi_idx long, prefix string, hour int")
    asked = [("r", u, p, rng.randrange(45), rng.choice("ABC"), [u, *rng.sample([v for v in range(8) if v != u], rng.randrange(1, 4))]) for u in range(8) for p in range(25)]
    offers = spark.createDataFrame(asked, "regime string, user_id long, pos int, minute long, prefix string, members array<long>").withColumns({"poi_idx": F.lit(1), "split": F.lit("train"), "utc_time": F.lit(None).cast("timestamp_ntz")})
    reasons, apart = {}, {}
    for _, u, p, t, wanted, members in asked:
        before = {m: sorted((r for r in rows if r[1] == m and r[2] < t), key=lambda r: (r[2], r[0])) for m in members}
        joint = sorted((r[2], r[3], r[2] % 24, m) for m in members for r in before[m][-3:])[-3:]
        tests = (any(all(r[4] != wanted for r in b) for b in before.values()), min(map(len, before.values())) < 2, not joint, all(x[3] == u for x in joint))
        reasons[u, p] = next((r for r, failed in zip(X.REASONS[1:], tests, strict=True) if failed), "emitted")
        w = [Counter(r[4] for r in b) for b in before.values()]
        dot = lambda a, b: sum(a[k] * b[k] for k in a) / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
        if reasons[u, p] == "emitted":
            d = [1 - dot(a, b) for i, a in enumerate(w) for b in w[:i]]
            apart[u, p] = sum(d) / len(d)
    assert set(reasons.values()) == {"constraint", "inactive", "anchor_only", "emitted"}
    tested = X.tested_offers(offers, visits, min_active=2, length=3)
    assert {(r.user_id, r.pos): r.reason for r in tested.collect()} == reasons
    monkeypatch.setattr(X, "member_profiles", None)  # distances need no texts of profiles
    got = {(r.user_id, r.pos): r.heterogeneity for r in X.heterogeneous(tested, visits, width=7).collect()}
    assert got.keys() == apart.keys() and all(abs(got[k] - apart[k]) < 6e-5 for k in apart)


def test_an_example_in_two_batches(monkeypatch):
    rows = [(0, [1, 2], [3, 4]), (0, [1, 2], [3, 4]), (3, [1], [2]), (3, [2], [5]), (3, [1], [1]), (9, [7], [1])]
    kinds = pa.schema([("example_id", pa.int64()), ("keys", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in some], kinds) for some in (rows[:1], rows[1:3], [], rows[3:4], rows[4:])]
    got = {r["example_id"]: round(r["apart"], 9) for b in X._fold_apart(iter(batches)) for r in b.to_pylist()}
    assert got == {0: 0.0, 3: round(2 / 3, 9), 9: 0.0}
