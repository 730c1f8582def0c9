"""Planted cases: nesting is greedy, ties in time, preference descent, session gaps."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from trailknit import plans
from trailknit.operators import evaluation as E
from trailknit.operators import graph as K
from trailknit.operators import groups as G
from trailknit.operators import prepare as P


def visits(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, poi_idx long, minute long, user_id long")
    return df.withColumn("utc_time", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(minute as int), 0)"))


def test_nesting_is_greedy(spark):
    c = visits(spark, [(1, 0, 3), (1, 5, 1), (1, 60, 2), (1, 100, 1), (1, 150, 2)])
    found = {(r.start_minute, r.end_minute, tuple(r.members)) for r in G.ephemeral_groups(c).collect()}
    assert found == {(0, 60, (1, 2, 3)), (100, 150, (1, 2))}


def test_peers_in_time(spark):
    c = visits(spark, [(1, 7, u) for u in range(9)])
    found = [tuple(r.members) for r in G.ephemeral_groups(c).collect()]
    assert found == [tuple(range(1, 9))]


def test_session_gap(spark):
    c = visits(spark, [(1, 0, 1), (1, 60, 2), (1, 121, 3), (1, 122, 4)])
    found = sorted(tuple(r.members) for r in G.legacy_sessions(c).collect())
    assert found == [(1, 2), (3, 4)]


def test_preference_descent(spark):
    venues = spark.createDataFrame([(0, "A>B>C"), (1, "A>D"), (2, "E")], "poi_idx long, category string")
    c = visits(spark, [(0, i, 1) for i in range(6)] + [(1, 10 + i, 1) for i in range(3)] + [(2, 20, 1)])
    assert {r.node for r in K.prefers_category(c, venues).collect()} == {"A", "A>B", "A>B>C"}


def test_active_pairs_in_bounded_tasks(spark, tmp_path, monkeypatch):
    """More rows make more tasks that count pairs, not larger ones, and rows are not sorted to meet venues and users."""
    monkeypatch.setattr(P, "ROWS_A_TASK", 1000, raising=False)
    rows = [(p, u) for p in range(300) for u in range(40)] + [(0, 0)] * 5 + [(999, u) for u in range(9)] + [(p, 77) for p in range(29)] + [(p, 78) for p in range(30)] + [(None, 1)] * 40 + [(2, None)] * 40
    table = spark.createDataFrame(rows, "l_partkey long, l_suppkey long")
    table.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = plans.QUERIES["activity_filter"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.poi_idx, r.user_id): r.n for r in found} == Counter((p, u) for p, u in rows if p not in (None, 999) and u not in (None, 77))
    assert len(found) == 12030 and max(Counter(r.task for r in found).values()) <= 2000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.activity_filter(table, 10, 30, "l_partkey", "l_suppkey")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan


def test_split_floor(spark):
    c = visits(spark, [(1, i, u) for u, n in ((1, 1), (2, 2), (3, 10)) for i in range(n)])
    got = {(r.user_id, r.split): r["count"] for r in P.chronological_split(c).groupBy("user_id", "split").count().collect()}
    assert got == {(1, "train"): 1, (2, "train"): 2, (3, "train"): 7, (3, "val"): 1, (3, "test"): 2}


def test_metric_shear(spark):
    v = spark.createDataFrame([(0, 40.7, -73.95, ""), (1, 40.71, -73.94, ""), (2, 40.69, -73.94, "")], "poi_idx long, latitude double, longitude double, category string")
    best = K.nearest(v, 1).where("poi_idx = 0").first()
    assert best.neighbour == 2


def test_tie_ranks(spark):
    df = spark.createDataFrame([(1, 1.0, 3), (2, 1.0, 1), (3, 2.0, 2)], "id long, a double, b long")
    average = E.spearman(df, "a", "b").first().rho
    ordinal = E.spearman(df, "a", "b", method="ordinal", tie="id").first().rho
    assert abs(average - ordinal) > 1e-6


def test_empty(spark):
    c = visits(spark, [(1, 0, 1)]).where("false")
    assert G.ephemeral_groups(c).count() == 0
    assert G.with_group_ids(G.ephemeral_groups(c)).count() == 0


def test_windows_over_slices_of_time(spark, monkeypatch):
    """Windows that reach over one slice and more, in places that are quiet, full, or always visited by the same few."""
    rng = random.Random(8)
    monkeypatch.setattr(G, "SLICE", 61)
    rows = [(1, rng.randrange(-300, 900), rng.randrange(40)) for _ in range(120)] + [(2, rng.randrange(200), rng.randrange(60)) for _ in range(400)] + [(3, rng.randrange(300), rng.randrange(3)) for _ in range(300)]
    got = [(r.poi_idx, r.start_minute, r.end_minute, tuple(r.members)) for r in G.ephemeral_groups(visits(spark, [*rows, (None, 5, 1)]).union(visits(spark, [(1, 5, None), (1, None, 4)]))).collect()]
    want = []
    for p in (1, 2, 3):
        own = sorted((m, u, i) for i, (q, m, u) in enumerate(rows) if q == p)
        cand = []
        for i, (t, _, _) in enumerate(own):
            some = [x for x in own[i:] if x[0] <= t + 60]
            m = tuple(sorted({u for _, u, _ in some}))
            if 2 <= len(m) <= 8:
                cand.append((-len(m), t, i, some[-1][0], m))
        kept = []
        for _, t0, _, t1, m in sorted(cand):
            if not any(set(m) <= set(k[2]) and not (t1 < k[0] or t0 > k[1]) for k in kept):
                kept.append((t0, t1, m))
        want += [(p, *k) for k in kept]
    assert sorted(got) == sorted(want) and {p for p, *_ in want} >= {1, 3}


def test_audits_find_groups_once(spark, monkeypatch):
    calls, find = [], G.ephemeral_groups
    monkeypatch.setattr(G, "ephemeral_groups", lambda *a, **k: (calls.append(1), find(*a, **k))[1])
    for name in ("audits", "planted_audits"):
        calls.clear()
        plans.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(calls) == 1
