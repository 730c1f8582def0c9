"""Queries on check-ins, splits and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailknit.functions import columns as C
from trailknit.operators import groups as G
from trailknit.operators import prepare as P
from trailknit.operators.scratch import cut
from trailknit.plans import tables as T

QUERIES: dict = {}
ORACLES: dict = {}
BOX = (40.55, 40.8, -74.1, -73.8)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(members: str) -> F.Column:
    return F.array_join(F.transform(members, lambda x: x.cast("string")), "|")


@query(T.sql(T.CHECKINS, select="SELECT event_id, user_id, poi_idx, minute, CAST(hour(utc_time) AS INTEGER) AS hour, dayname(utc_time) AS dow, CAST(CAST(utc_time AS DATE) AS VARCHAR) AS day, CAST((isodow(utc_time) - 1) * 24 + hour(utc_time) AS INTEGER) AS how FROM checkins"))
def checkin_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.checkins(spark, sf_dir)
    return c.select("event_id", "user_id", "poi_idx", "minute", F.hour("utc_time").alias("hour"), C.day_name("utc_time").alias("dow"), F.to_date("utc_time").cast("string").alias("day"), C.hour_of_week("utc_time").alias("how"))


@query(T.sql(T.CHECKINS, select="SELECT event_id, user_id, pos, split FROM split"))
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.split(spark, sf_dir).select("event_id", "user_id", F.col("pos").cast("long").alias("pos"), "split")


@query("""WITH n AS (SELECT count(*) AS n FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, CASE WHEN i <= CAST(floor(0.8 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM r, n""")
def fraction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fraction_split(T.read(spark, sf_dir, "events").select("ts", "event_id"), 0.8, "ts", "event_id").select("event_id", "split")


@query("""WITH v AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 10), a AS (SELECT * FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM v)),
u AS (SELECT l_suppkey FROM a GROUP BY 1 HAVING count(*) >= 30) SELECT l_partkey AS poi_idx, l_suppkey AS user_id, count(*) AS n FROM a WHERE l_suppkey IN (SELECT l_suppkey FROM u) GROUP BY 1, 2""")
def activity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("poi_idx"), F.col("l_suppkey").alias("user_id"))
    return P.key_counts(P.activity_filter(rows), ["poi_idx", "user_id"], rows.count())


@query(T.sql(T.CHECKINS, T.VENUES, select=f"SELECT poi_idx, category, locality FROM venues WHERE latitude BETWEEN {BOX[0]} AND {BOX[1]} AND longitude BETWEEN {BOX[2]} AND {BOX[3]}"))
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.in_box(T.venues(spark, sf_dir), BOX).select("poi_idx", "category", "locality")


@query(T.sql(T.CHECKINS, T.VENUES, select="SELECT poi_idx, printf('%.4f,%.4f', floor(latitude / CAST(0.05 AS DOUBLE)) * CAST(0.05 AS DOUBLE), floor(longitude / CAST(0.05 AS DOUBLE)) * CAST(0.05 AS DOUBLE)) AS locality FROM venues"))
def grid_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.venues(spark, sf_dir).select("poi_idx", C.grid_cell("latitude", "longitude", 0.05).alias("locality"))


@query(T.sql(T.CHECKINS, T.VENUES, select="SELECT poi_idx, category, split_part(category, '>', 1) AS level1, CAST(len(string_split(category, '>')) AS INTEGER) AS depth FROM venues"))
def category_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.category_path("category")
    return T.venues(spark, sf_dir).select("poi_idx", "category", C.prefix(p, 1).alias("level1"), F.size(p).alias("depth"))


@query("""WITH t AS (SELECT p_type AS name, min(p_type || '>' || p_brand) AS path FROM part GROUP BY 1)
SELECT p_partkey, coalesce(t.path, p_type) AS path FROM part LEFT JOIN t ON p_type = t.name AND p_type <> 'ECONOMY'""")
def taxonomy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = T.read(spark, sf_dir, "part")
    taxonomy = part.where("p_type <> 'ECONOMY'").select(F.col("p_type").alias("name"), F.concat_ws(">", "p_type", "p_brand").alias("path"))
    return P.taxonomy_lookup(part, "p_type", taxonomy).select("p_partkey", "path")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS raw, row_number() OVER (ORDER BY length(CAST(o_custkey AS VARCHAR)), CAST(o_custkey AS VARCHAR)) - 1 AS id FROM (SELECT DISTINCT o_custkey FROM orders)""")
def compact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compact_ids(T.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("raw")), "raw", "id")


@query("""WITH s AS (SELECT event_id, user_id, CAST((isodow(ts) - 1) * 24 + hour(ts) + 1 AS BIGINT) AS slot FROM events),
f AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY user_id ORDER BY event_id) <= -24 THEN 1 ELSE 0 END AS fell FROM s),
w AS (SELECT *, sum(fell) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS week FROM f)
SELECT event_id, CAST(week AS BIGINT) AS week, CAST(week * 168 + slot - 1 AS BIGINT) AS abs_hour FROM w""")
def clock_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "events").select("event_id", "user_id", (C.hour_of_week("ts") + 1).cast("long").alias("slot"))
    return P.reconstruct_clock(rows, "event_id").select("event_id", "week", "abs_hour")


@query(T.sql(T.CHECKINS, T.RARITY, select="SELECT poi_idx, n_users, round(rarity, 6) AS rarity FROM rarity"))
def venue_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.venue_rarity(T.train(spark, sf_dir)).withColumn("rarity", F.round("rarity", 6))


@query(T.sql(T.CHECKINS, T.groups_sql("checkins"), select="SELECT poi_idx, t0 AS start_minute, t1 AS end_minute, CAST(len(m) AS INTEGER) AS size, array_to_string(m, '|') AS members FROM groups", recursive=True))
def ephemeral_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ephemeral_groups(T.checkins(spark, sf_dir)).withColumn("members", joined("members"))


@query(T.sql(T.CHECKINS, T.groups_sql(), select="SELECT group_id, poi_idx, t0 AS start_minute, unnest(m) AS user_id FROM groups", recursive=True))
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.groups(spark, sf_dir).select("group_id", "poi_idx", "start_minute", F.explode("members").alias("user_id"))


@query(T.sql(T.CHECKINS, T.groups_sql(), "s AS (SELECT len(m) AS size, CAST(t1 - t0 AS DOUBLE) AS span FROM groups)", select="SELECT CAST(size AS INTEGER) AS size, count(*) AS n_groups, min(span) AS min_span, quantile_cont(span, 0.5) AS median_span, CAST(quantile_cont(span, 0.95) AS DOUBLE) AS p95_span, max(span) AS max_span, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY 1", recursive=True))
def group_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.span_report(T.groups(spark, sf_dir))


@query(T.sql(T.CHECKINS, T.groups_sql(), T.TRANSITIONS, select="SELECT from_poi, to_poi, gap_min, CAST(n_shared AS INTEGER) AS n_shared, round(n_shared / n_all, 4) AS jaccard, array_to_string(shared, '|') AS members FROM transitions", recursive=True))
def group_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.real_transitions(cut(T.groups(spark, sf_dir), "groups"), min_shared=1, min_jaccard=0.25).withColumn("members", joined("members")).drop("from_group", "to_group")


@query(T.sql(T.CHECKINS, T.groups_sql(), T.RARITY, T.TIES, select="SELECT * FROM ties", recursive=True))
def co_attended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ties(spark, sf_dir).orderBy(F.desc("weight_idf"), "u1", "u2")


@query(T.sql(T.CHECKINS, T.groups_sql(), T.RARITY, T.TIES, select="SELECT u1, u2, weight_idf FROM ties WHERE n_groups >= 2 AND n_venues >= 2", recursive=True))
def tie_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tie_pool(T.ties(spark, sf_dir), 2, 2).select("u1", "u2", "weight_idf")


@query(T.sql(T.CHECKINS, T.groups_sql(), T.RARITY, T.TRANSITIONS, "w AS (SELECT unnest(shared) AS u, from_group, to_group, (a.rarity + b.rarity) / 2 AS w FROM transitions JOIN rarity a ON from_poi = a.poi_idx JOIN rarity b ON to_poi = b.poi_idx)", select="SELECT x.u AS u1, y.u AS u2, count(*) AS n_transitions, round(sum(x.w), 6) AS weight_idf FROM w x JOIN w y ON x.from_group = y.from_group AND x.to_group = y.to_group AND x.u < y.u GROUP BY 1, 2", recursive=True))
def moved_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.moved_together(G.real_transitions(cut(T.groups(spark, sf_dir), "groups"), min_shared=1, min_jaccard=0.25), G.venue_rarity(T.train(spark, sf_dir)))


@query(T.sql(T.CHECKINS, T.groups_sql(), T.RARITY, T.TRANSITIONS.replace("<= 240", "<= 43200"), "w AS (SELECT unnest(shared) AS u, from_group, to_group, (a.rarity + b.rarity) / 2 AS w FROM transitions JOIN rarity a ON from_poi = a.poi_idx JOIN rarity b ON to_poi = b.poi_idx)", select="SELECT x.u AS u1, y.u AS u2, count(*) AS n_transitions, round(sum(x.w), 6) AS weight_idf FROM w x JOIN w y ON x.from_group = y.from_group AND x.to_group = y.to_group AND x.u < y.u GROUP BY 1, 2", recursive=True))
def moved_within_a_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared moves of the same people between places within 30 days, of which the tables have some."""
    g = cut(T.groups(spark, sf_dir), "groups")
    return G.moved_together(G.real_transitions(g, horizon=43200, min_shared=1, min_jaccard=0.25), G.venue_rarity(T.train(spark, sf_dir)))


@query(T.sql(T.CHECKINS, """o AS (SELECT *, CASE WHEN minute - lag(minute) OVER (PARTITION BY poi_idx ORDER BY minute, event_id) > 60 THEN 1 ELSE 0 END AS opens FROM checkins),
s AS (SELECT *, sum(opens) OVER (PARTITION BY poi_idx ORDER BY minute, event_id ROWS UNBOUNDED PRECEDING) AS session FROM o),
f AS (SELECT poi_idx, session, user_id, min(minute * 1000000000 + event_id) AS first, min(minute) AS a, max(minute) AS z, count(*) AS n FROM s GROUP BY 1, 2, 3)""", select="SELECT poi_idx, min(a) AS start_minute, max(z) AS end_minute, CAST(sum(n) AS BIGINT) AS n_checkins, string_agg(CAST(user_id AS VARCHAR), '|' ORDER BY first) AS members FROM f GROUP BY poi_idx, session HAVING count(*) >= 2"))
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.legacy_sessions(T.checkins(spark, sf_dir)).withColumn("members", joined("members"))


def _feasible(window: int) -> str:
    return f"""b{window} AS (SELECT a.poi_idx, a.rn, a.minute, list_sort(list_distinct(list(b.user_id))) AS m FROM numbered a JOIN numbered b
  ON a.poi_idx = b.poi_idx AND b.rn <= a.rn AND b.minute >= a.minute - {window} GROUP BY 1, 2, 3),
e{window} AS (SELECT poi_idx, m, min(minute) AS minute FROM b{window} WHERE len(m) BETWEEN 2 AND 5 GROUP BY 1, 2),
t{window} AS (SELECT *, lead(poi_idx) OVER (PARTITION BY m ORDER BY minute, poi_idx) AS p2, lead(minute) OVER (PARTITION BY m ORDER BY minute, poi_idx) AS t2 FROM e{window}),
r{window} AS (SELECT {window} AS window_min, (SELECT count(*) FROM e{window}) AS n_events, (SELECT count(DISTINCT m) FROM e{window}) AS n_groups,
  (SELECT count(DISTINCT m) FROM e{window} WHERE len(m) >= 3) AS n_groups3,
  (SELECT count(*) FROM (SELECT DISTINCT x.u, y.u FROM (SELECT poi_idx, m, unnest(m) AS u FROM e{window}) x JOIN (SELECT poi_idx, m, unnest(m) AS u FROM e{window}) y ON x.poi_idx = y.poi_idx AND x.m = y.m AND x.u < y.u)) AS n_pairs,
  (SELECT count(*) FROM t{window} WHERE t2 > minute AND t2 - minute <= 240 AND p2 <> poi_idx) AS n_transitions)"""


@query(T.sql(T.CHECKINS, "numbered AS (SELECT *, row_number() OVER (PARTITION BY poi_idx ORDER BY minute, user_id, event_id) AS rn FROM checkins)", _feasible(30), _feasible(60), "r AS (SELECT * FROM r30 UNION ALL SELECT * FROM r60)", select="SELECT *, CASE WHEN n_transitions >= 5000 THEN 'STRONG' WHEN n_transitions >= 300 THEN 'USABLE' ELSE 'SPARSE' END AS verdict FROM r"))
def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.feasibility_table(T.checkins(spark, sf_dir), [30, 60])


@query(T.sql(T.CHECKINS, "numbered AS (SELECT *, row_number() OVER (PARTITION BY poi_idx ORDER BY minute, user_id, event_id) AS rn FROM checkins)", _feasible(30), _feasible(60), "r AS (SELECT * FROM r30 UNION ALL SELECT * FROM r60)", select="SELECT *, CASE WHEN n_transitions >= 5000 THEN 'STRONG' WHEN n_transitions >= 300 THEN 'USABLE' ELSE 'SPARSE' END AS verdict FROM r ORDER BY n_transitions DESC, window_min LIMIT 1"))
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_window(G.feasibility_table(T.checkins(spark, sf_dir), [30, 60]))


FRIENDS = "old AS (SELECT u1, u2 FROM ties WHERE (u1 * 31 + u2) % 3 = 0), fresh AS (SELECT u1, u2 FROM ties WHERE (u1 * 31 + u2) % 3 <= 1)"


@query(T.sql(T.CHECKINS, T.groups_sql(), T.RARITY, T.TIES, FRIENDS, select="SELECT * FROM fresh EXCEPT SELECT * FROM old", recursive=True))
def friendships_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = T.friends(spark, sf_dir)
    doubled = old.union(new).select(F.col("u2").alias("a"), F.col("u1").alias("b")).union(new.select("u1", "u2")).union(new.select("u1", "u1"))
    return P.new_only(P.canonical_edges(doubled, "a", "b"), old)


@query(T.sql(T.CHECKINS, T.groups_sql(), T.RARITY, T.TIES, "old AS (SELECT u1, u2 FROM ties WHERE (u1 * 31 + u2) % 3 = 0), later AS (SELECT u2 AS u1, u1 AS u2 FROM ties WHERE u1 % 2 = 0)", select="SELECT 'friendship' AS audit, count(*) AS violations FROM later l WHERE EXISTS (SELECT 1 FROM old o WHERE o.u1 = l.u2 AND o.u2 = l.u1)", recursive=True))
def friendship_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a table with planted leaks (either way round) that stand among the old friendships."""
    old = T.friends(spark, sf_dir)[0]
    later = T.ties(spark, sf_dir).where("u1 % 2 = 0").select(F.col("u2").alias("u1"), F.col("u1").alias("u2"))
    return P.leaked_pairs(later, old).agg(F.count("*").alias("violations")).select(F.lit("friendship").alias("audit"), "violations")


@query("""WITH n AS (SELECT l_partkey AS poi_idx, l_shipmode AS category, count(*) AS n FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2),
v AS (SELECT poi_idx, arg_min(category, (-n, category)) AS category FROM n GROUP BY 1) SELECT * FROM v""".replace("arg_min(category, (-n, category))", "first(category ORDER BY n DESC, category)"))
def modal_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("poi_idx"), F.concat("l_returnflag", "l_linestatus").alias("category"))
    return P.modal_category(rows)


@query("""WITH n AS (SELECT o_custkey AS key, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT key, first(name ORDER BY n DESC, name) AS name, round(max(n) / sum(n), 6) AS purity FROM n GROUP BY 1""")
def category_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes, _ = P.category_names(T.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name")), "key", "name")
    return votes.withColumn("purity", F.round("purity", 6))
