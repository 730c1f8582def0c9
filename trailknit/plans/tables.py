"""The driver's tables in the library's terms, as DataFrames and as the same SQL.

Check-ins are `events` (place: the number in props), venues are the rows of `part` that have check-ins, categories are
type and brand, localities nations. Friendships are pairs that met, split by a rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailknit.functions import columns as C
from trailknit.operators import groups as G
from trailknit.operators import prepare as P

MAX_VISITORS = 75


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, poi_idx, utc_time, minute, event_type."""
    e = read(spark, sf_dir, "events")
    place = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "user_id", place.alias("poi_idx"), F.col("ts").alias("utc_time"), C.epoch_minute("ts").alias("minute"), "event_type")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chronological_split(checkins(spark, sf_dir))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).where("split = 'train'")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poi_idx, category, locality, region, latitude, longitude of the venues with check-ins."""
    used = checkins(spark, sf_dir).select("poi_idx").distinct()
    p = read(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("poi_idx"), "left_semi")
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("p_partkey").cast("double")
    lat = F.lit(40.5) + F.pmod(F.col("p_partkey"), F.lit(10)).cast("double") * 0.04 + k * 1e-5
    lon = F.lit(-74.2) + F.floor(k / 10).cast("double") * 0.05
    return p.join(n, F.pmod(F.col("p_partkey"), F.lit(25)) == F.col("n_nationkey")).select(F.col("p_partkey").alias("poi_idx"), F.concat_ws(">", "p_type", "p_brand").alias("category"), F.col("n_name").alias("locality"), F.col("r_name").alias("region"), lat.alias("latitude"), lon.alias("longitude"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_group_ids(G.ephemeral_groups(train(spark, sf_dir)))


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = train(spark, sf_dir)
    return G.co_attended(groups(spark, sf_dir), G.venue_rarity(t))


def friends(spark: SparkSession, sf_dir: str, met: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(old, new only); met are the ties, if they are at hand."""
    t = (ties(spark, sf_dir) if met is None else met).select("u1", "u2")
    rest = (F.col("u1") * 31 + F.col("u2")) % 3
    return t.where(rest == 0), t.where(rest == 1)


# ---------------------------------------------------------------- the same in SQL

CHECKINS = """checkins AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS poi_idx, ts AS utc_time,
  CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS minute, event_type FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY utc_time, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM checkins),
cuts AS (SELECT *, greatest(1, ceil(CAST(0.7 AS DOUBLE) * n)) AS c1 FROM ranked),
split AS (SELECT event_id, user_id, poi_idx, utc_time, minute, event_type, pos, n, CASE WHEN pos <= c1 THEN 'train'
  WHEN pos <= least(greatest(ceil((CAST(0.7 AS DOUBLE) + CAST(0.1 AS DOUBLE)) * n), c1), n) THEN 'val' ELSE 'test' END AS split FROM cuts),
train AS (SELECT * FROM split WHERE split = 'train')"""

VENUES = """venues AS (SELECT p_partkey AS poi_idx, p_type || '>' || p_brand AS category, n_name AS locality, r_name AS region,
  CAST(40.5 AS DOUBLE) + CAST(p_partkey % 10 AS DOUBLE) * CAST(0.04 AS DOUBLE) + CAST(p_partkey AS DOUBLE) * CAST(0.00001 AS DOUBLE) AS latitude,
  CAST(-74.2 AS DOUBLE) + floor(CAST(p_partkey AS DOUBLE) / 10) * CAST(0.05 AS DOUBLE) AS longitude
  FROM part JOIN nation ON p_partkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE p_partkey IN (SELECT poi_idx FROM checkins))"""


def groups_sql(source: str = "train", order: str = "user_id, event_id") -> str:
    """CTE `groups` (poi_idx, t0, t1, m): the fold as a recursion over candidates numbered by place."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY poi_idx ORDER BY minute, {order}) AS rn FROM {source}),
ahead AS (SELECT a.poi_idx, a.rn, a.minute AS t0, max(b.minute) AS t1, list_sort(list_distinct(list(b.user_id))) AS m
  FROM numbered a JOIN numbered b ON a.poi_idx = b.poi_idx AND b.rn >= a.rn AND b.minute <= a.minute + 60 GROUP BY 1, 2, 3),
cand AS (SELECT *, row_number() OVER (PARTITION BY poi_idx ORDER BY -len(m), t0, rn) AS i FROM ahead WHERE len(m) BETWEEN 2 AND 8),
fold(p, i, kept) AS (
  SELECT poi_idx, i, [{{'t0': t0, 't1': t1, 'm': m}}] FROM cand WHERE i = 1
  UNION ALL
  SELECT p, c.i, CASE WHEN len(list_filter(kept, lambda k: list_has_all(k.m, c.m) AND NOT (c.t1 < k.t0 OR c.t0 > k.t1))) > 0 THEN kept
    ELSE list_append(kept, {{'t0': c.t0, 't1': c.t1, 'm': c.m}}) END
  FROM fold JOIN cand c ON c.poi_idx = p AND c.i = fold.i + 1),
flat AS (SELECT p AS poi_idx, unnest(arg_max(kept, i)) AS g FROM fold GROUP BY p),
groups AS (SELECT poi_idx, g.t0 AS t0, g.t1 AS t1, g.m AS m,
  row_number() OVER (ORDER BY poi_idx, g.t0, g.t1, array_to_string(g.m, '|')) - 1 AS group_id FROM flat)"""


RARITY = """rarity AS (SELECT poi_idx, count(DISTINCT user_id) AS n_users, 1 / ln(1 + count(DISTINCT user_id)) AS rarity FROM train GROUP BY 1)"""
TIES = """members AS (SELECT group_id, poi_idx, unnest(m) AS u FROM groups),
ties AS (SELECT a.u AS u1, b.u AS u2, count(*) AS n_groups, count(DISTINCT a.poi_idx) AS n_venues, round(sum(r.rarity), 6) AS weight_idf
  FROM members a JOIN members b ON a.group_id = b.group_id AND a.u < b.u JOIN rarity r ON a.poi_idx = r.poi_idx GROUP BY 1, 2)"""
TRANSITIONS = """pairs AS (SELECT a.group_id AS from_group, b.group_id AS to_group, a.poi_idx AS from_poi, b.poi_idx AS to_poi, b.t0 - a.t1 AS gap_min,
    list_sort(list_intersect(a.m, b.m)) AS shared, len(list_distinct(list_concat(a.m, b.m))) AS n_all
  FROM groups a JOIN groups b ON a.poi_idx <> b.poi_idx AND b.t0 > a.t1 AND b.t0 - a.t1 <= 240 AND list_has_any(a.m, b.m)),
transitions AS (SELECT *, len(shared) AS n_shared FROM pairs WHERE len(shared) >= 1 AND len(shared) / n_all >= 0.25)"""


def sql(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}"
