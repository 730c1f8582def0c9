"""Operators on planted tables, against plain versions."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from trailknit.operators import affinity as A
from trailknit.operators import evaluation as E
from trailknit.operators import graph as K
from trailknit.operators import groups as G
from trailknit.operators import ordering as O
from trailknit.operators import prepare as P
from trailknit.sources import tables as S


def test_times_with_offsets_are_utc(spark, tmp_path):
    head = "user_id,venue_id,venue_category_id,venue_category_name,latitude,longitude,timezone_offset,utc_time,poi_idx\n"
    times = ["2012-04-03 18:00:09+00:00", "2012-04-03 18:00:09", "2012-04-03T20:00:09+02:00", "2012-04-03T18:00:09Z", "never", ""]
    for name in ("train", "val", "test"):
        (tmp_path / f"{name}_X.csv").write_text(head + "".join(f"{i},v,,Bar,1,2,0,{t},7\n" for i, t in enumerate(times)))
    got = {(r.user_id, r.t) for r in S.read_splits(spark, str(tmp_path), "X").selectExpr("user_id", "cast(utc_time as string) as t").collect()}
    assert got == {(i, "2012-04-03 18:00:09") for i in range(4)}


def test_sums_and_numbers_by_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abcde") * rng.randint(1, 3), rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, name string, n long")
    got = {r.id: (r.at, r.before) for r in O.numbered(O.sum_before(df, [F.col("name"), F.col("id")], "n", "before"), [F.col("name"), F.col("id")], "at").collect()}
    total = 0
    for k, (i, _, n) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        assert got[i] == (k, total)
        total += n
    assert O.numbered(df.where("false"), [F.col("id")], "at").count() == 0
    split = P.fraction_split(df, 0.8, "name", "id")
    assert {r.id for r in split.where("split = 'train'").collect()} == {i for i, a in got.items() if a[0] < 1600}


def test_nearest_on_the_sphere_and_the_plane(spark):
    rng = random.Random(5)
    places = [(i, rng.uniform(40, 41), rng.uniform(-74, -73)) for i in range(120)] + [(200, 89.9, 10.0), (201, 89.9, -170.0), (202, 0.0, 179.9), (203, 0.0, -179.9), (204, 40.5, -73.5), (205, 40.5, -73.5)]
    df = spark.createDataFrame(places + [(300, float("nan"), 1.0)], "poi_idx long, latitude double, longitude double")

    def great(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * K.EARTH_KM * math.asin(min(1, math.sqrt(h)))

    def flat(a, b):
        return math.hypot(math.cos(math.radians(a[1])) * a[2] - math.cos(math.radians(b[1])) * b[2], a[1] - b[1])

    for metric, d in (("haversine", great), ("sinusoidal", flat)):
        got = {}
        for r in K.nearest(df, 4, metric).collect():
            got.setdefault(r.poi_idx, []).append((round(r.distance, 6), r.neighbour))
        for a in places:
            want = sorted((round(d(a, b), 6), b[0]) for b in places if b[0] != a[0])[:4]
            assert [x[0] for x in sorted(got[a[0]])] == [x[0] for x in want], (metric, a)


def test_taste_trims_paths_and_knows_unknown(spark):
    train = spark.createDataFrame([(1, 10, 0, "2024-01-01 10:00:00"), (2, 11, 0, "2024-01-02 11:00:00"), (3, 12, 0, "2024-01-03 12:00:00"), (4, 13, 0, "2024-01-04 13:00:00")], "user_id long, poi_idx long, minute long, t string").withColumn("utc_time", F.col("t").cast("timestamp_ntz"))
    venues = spark.createDataFrame([(10, "A > B>C", "x"), (11, "A>B > D", "y"), (12, None, "z"), (13, "", "w")], "poi_idx long, category string, locality string")
    rare = spark.createDataFrame([(p, 1, 1.0) for p in (10, 11, 12, 13)], "poi_idx long, n_users long, rarity double")
    scores, _ = A.affinity(train, venues, rare, 4)
    assert {(r.u1, r.u2) for r in scores.where("taste > 0.99").collect()} == {(1, 2), (3, 4)}


def test_equal_depths_are_apart_from_other_strata(spark):
    """Strata of equal depths fall one way, mixed ones the other."""
    rows = [(2, 2, i % 3 / 3, float(i % 3)) for i in range(300)] + [(2, 3, i % 3 / 3, -float(i % 3)) for i in range(300)] + [(8, 8, i % 3 / 3, -float(i % 3)) for i in range(300)]
    pairs = spark.createDataFrame([(0, 0, *r) for r in rows], "a long, b long, da int, db int, divergence double, drop double")
    got = E.consensus_summary(pairs).first()
    assert abs(got.equal_depth_rho - 1) < 1e-9 and abs(got.stratified_rho) < 1e-9 and (got.equal_strata, got.strata) == (1, 2)


def test_behavioural_relations_are_reported(spark):
    edges = spark.createDataFrame([(1, "FOLLOWED_BY", 2), (1, "IS_NEAR_TO", 2), (2, "VISITED_ON", 3), (2, "VISITED_ON", 4)], "a long, rel string, b long")
    assert {(r.rel, r.n) for r in K.behavioural(edges).collect()} == {("FOLLOWED_BY", 1), ("VISITED_ON", 2)}


def test_moved_together_on_planted_moves(spark):
    """Two companions go from one quiet place to another twice, a third joins once; strangers stay."""
    groups = spark.createDataFrame(
        [(0, 10, 0, 20, [1, 2]), (1, 20, 90, 110, [1, 2]), (2, 10, 2000, 2030, [1, 2, 3]), (3, 30, 2100, 2120, [1, 2, 3]), (4, 99, 0, 10, [7, 8]), (5, 10, 5000, 5010, [1, 2]), (6, 20, 5400, 5410, [1, 2]), (7, 20, 9000, 9010, [1, 9])],
        "group_id long, poi_idx long, start_minute long, end_minute long, members array<long>",
    )
    rarity = spark.createDataFrame([(10, 1.0), (20, 0.5), (30, 0.25), (99, 0.1)], "poi_idx long, rarity double")
    moves = G.real_transitions(groups)
    assert {(r.from_group, r.to_group, r.gap_min, r.n_shared) for r in moves.collect()} == {(0, 1, 70, 2), (2, 3, 70, 3)}
    got = {(r.u1, r.u2): (r.n_transitions, r.weight_idf) for r in G.moved_together(moves, rarity).collect()}
    assert got == {(1, 2): (2, 1.375), (1, 3): (1, 0.625), (2, 3): (1, 0.625)}


def test_a_target_never_stands_above_itself(spark):
    """Scores that come out a little different whenever they're worked out, as sums of doubles in another order do."""
    near = F.udf(lambda i: i + random.SystemRandom().random() * 1e-9, "double").asNondeterministic()
    scores = spark.range(60).selectExpr("id as example", "explode(sequence(1, 5)) as item", "3 as target").repartition(3).withColumn("score", near("item"))
    got = E.ranks(scores.union(spark.createDataFrame([(99, 1, 7, 1.0)], scores.schema)), "example", "item", "score", "target").collect()
    assert sorted((r.example, r.rank) for r in got) == [(i, 3) for i in range(60)]
