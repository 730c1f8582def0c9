"""Queries on affinity and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailknit.operators import affinity as A
from trailknit.operators import graph as K
from trailknit.operators import groups as G
from trailknit.operators.scratch import cut
from trailknit.plans import tables as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


COS = """{n}_c AS (SELECT user_id, {key} AS key, count(*) AS n FROM train JOIN venues USING (poi_idx) GROUP BY 1, 2),
{n}_w AS (SELECT user_id, key, n / sqrt(sum(n * n) OVER (PARTITION BY user_id)) AS w FROM {n}_c),
{n} AS (SELECT a.user_id AS u1, b.user_id AS u2, sum(a.w * b.w) AS value FROM {n}_w a JOIN {n}_w b ON a.key = b.key AND a.user_id < b.user_id GROUP BY 1, 2)"""
TASTE = COS.format(n="taste", key="category")
BRAND = COS.format(n="brand", key="category")
RHYTHM = COS.format(n="rhythm", key="(isodow(utc_time) - 1) * 24 + hour(utc_time)")
TERRITORY = COS.format(n="territory", key="locality")
FAR = f"""far_c AS (SELECT t.*, minute // 1440 AS day, r.rarity FROM train t JOIN rarity r USING (poi_idx) WHERE r.n_users <= {T.MAX_VISITORS}),
far_covisit AS (SELECT least(a.user_id, b.user_id) AS u1, greatest(a.user_id, b.user_id) AS u2, sum(a.rarity) AS value FROM far_c a JOIN far_c b
  ON a.poi_idx = b.poi_idx AND a.day = b.day AND a.user_id <> b.user_id AND b.minute - a.minute >= 180 GROUP BY 1, 2)"""
SIGNALS = ("taste", "rhythm", "territory", "far_covisit")
ALL_PAIRS = f"""users AS (SELECT DISTINCT user_id AS u FROM checkins), every AS (SELECT a.u AS u1, b.u AS u2 FROM users a JOIN users b ON a.u < b.u),
wide AS (SELECT u1, u2, {", ".join(f"coalesce({s}.value, 0) AS {s}" for s in SIGNALS)} FROM every {" ".join(f"LEFT JOIN {s} USING (u1, u2)" for s in SIGNALS)}),
scored AS (SELECT *, {" + ".join(f"({s} - avg({s}) OVER ()) / (stddev_pop({s}) OVER () + 1e-12)" for s in SIGNALS)} AS combined FROM wide)"""
AFFINITY = (T.CHECKINS, T.VENUES, T.RARITY, TASTE, RHYTHM, TERRITORY, FAR, ALL_PAIRS)
MET = """met AS (SELECT DISTINCT a.u AS u1, b.u AS u2 FROM (SELECT group_id, unnest(m) AS u FROM groups) a JOIN (SELECT group_id, unnest(m) AS u FROM groups) b ON a.group_id = b.group_id AND a.u < b.u),
labelled AS (SELECT s.*, CASE WHEN met.u1 IS NULL THEN 0 ELSE 1 END AS y FROM scored s LEFT JOIN met USING (u1, u2))"""


def _affinity(spark: SparkSession, sf_dir: str) -> A.Scored:
    t, v = cut(T.train(spark, sf_dir), "train"), cut(T.venues(spark, sf_dir), "venues")
    n = T.checkins(spark, sf_dir).select("user_id").distinct().count()
    return A.scored(t, v, G.venue_rarity(t), n, max_visitors=T.MAX_VISITORS)


def scored_edges(spark: SparkSession, sf_dir: str, percentile: float = 95.0) -> DataFrame:
    """(u1, u2, score) of the pairs at the percentile of affinity or above, written."""
    s = _affinity(spark, sf_dir)
    return cut(s.pairs(s.percentiles([percentile])[0], signals=False).withColumnRenamed("combined", "score"), "edges")


@query(T.sql(T.CHECKINS, T.VENUES, COS.format(n="taste", key="split_part(category, '>', 1)"), select="SELECT user_id, key, n, round(w, 6) AS w FROM taste_w JOIN taste_c USING (user_id, key)"))
def category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.train(spark, sf_dir).join(T.venues(spark, sf_dir), "poi_idx")
    return A.profile(t, F.split_part("category", F.lit(">"), F.lit(1))).withColumn("w", F.round("w", 6))


@query(T.sql(T.CHECKINS, "h AS (SELECT user_id, hour(utc_time) AS key, count(*) AS n FROM train GROUP BY 1, 2)", select="SELECT user_id, CAST(key AS INTEGER) AS key, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS w FROM h"))
def hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.profile(T.train(spark, sf_dir), F.hour("utc_time"), norm=1).withColumn("w", F.round("w", 6))


@query(T.sql(T.CHECKINS, T.RARITY, FAR, select="SELECT u1, u2, round(value, 6) AS value FROM far_covisit"))
def far_covisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.train(spark, sf_dir)
    return A.far_covisit(t, G.venue_rarity(t), max_visitors=T.MAX_VISITORS).withColumn("value", F.round("value", 6))


@query(T.sql(*AFFINITY, select=f"SELECT u1, u2, {', '.join(f'round({s}, 5) AS {s}' for s in (*SIGNALS, 'combined'))} FROM scored WHERE taste + rhythm + territory + far_covisit > 0"))
def affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _affinity(spark, sf_dir).pairs(digits=5)


@query(T.sql(*AFFINITY, T.groups_sql(), MET, *[f"auc_{s} AS (SELECT '{s}' AS signal, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM (SELECT y, rank() OVER (ORDER BY round({s}, 9)) + (count(*) OVER (PARTITION BY round({s}, 9)) - 1) / 2 AS r FROM labelled))" for s in (*SIGNALS, "combined")], select=" UNION ALL ".join(f"SELECT signal, round(auc, 6) AS auc FROM auc_{s}" for s in (*SIGNALS, "combined")), recursive=True))
def affinity_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _affinity(spark, sf_dir).aucs(T.ties(spark, sf_dir))
    return spark.createDataFrame([(s, None if found[s] is None else round(found[s], 6)) for s in (*SIGNALS, "combined")], "signal string, auc double")


@query(T.sql(*AFFINITY, T.groups_sql(), MET, "cut AS (SELECT p, quantile_cont(combined, p / 100) AS c FROM labelled, (SELECT unnest([CAST(99.0 AS DOUBLE), CAST(98.0 AS DOUBLE)]) AS p) GROUP BY p)".replace("quantile_cont(combined, p / 100)", "CASE WHEN p = 99 THEN quantile_cont(combined, 0.99) ELSE quantile_cont(combined, 0.98) END"), "chosen AS (SELECT p, u1, u2, y FROM labelled, cut WHERE combined >= c)", select="SELECT p AS percentile, count(*) AS n_pairs, (SELECT count(DISTINCT u) FROM (SELECT p AS q, u1 AS u FROM chosen UNION SELECT p, u2 FROM chosen) WHERE q = p) AS n_users, round(avg(y), 6) AS precision, round(avg(y) / (SELECT avg(y) FROM labelled), 6) AS lift FROM chosen GROUP BY p", recursive=True))
def affinity_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _affinity(spark, sf_dir)
    met = cut(T.ties(spark, sf_dir).select("u1", "u2", F.lit(1).alias("y")), "met")
    cuts = dict(zip((99.0, 98.0), s.percentiles([99.0, 98.0]), strict=True))
    scores = cut(s.pairs(min(cuts.values()), signals=False).join(met, ["u1", "u2"], "left").fillna(0, ["y"]), "labelled")
    out, pairs, met = None, s.n_pairs, met.count()
    for p, cut_at in cuts.items():
        one = A.selection(scores, "combined", "y", cut_at, pairs, met).select(F.lit(p).alias("percentile"), "n_pairs", "n_users", F.round("precision", 6).alias("precision"), F.round("lift", 6).alias("lift"))
        out = one if out is None else out.union(one)
    return out


@query(T.sql(T.CHECKINS, T.VENUES, BRAND, "b AS (SELECT u1, u2, u1 AS me, u2 AS other, value FROM brand WHERE value >= 0.3 UNION ALL SELECT u1, u2, u2, u1, value FROM brand WHERE value >= 0.3)", select="SELECT DISTINCT u1, u2, round(value, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY me ORDER BY round(value, 9) DESC, other) AS rn FROM b) WHERE rn <= 10"))
def similar_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.train(spark, sf_dir).join(T.venues(spark, sf_dir), "poi_idx")
    return A.similar_preference(A.profile(t, F.col("category")), 10, 0.3)


CLIQUES = """cut AS (SELECT quantile_cont(combined, 0.95) AS c FROM scored), e AS (SELECT u1, u2 FROM scored, cut WHERE combined >= c),
near AS (SELECT u, list(v) AS near FROM (SELECT u1 AS u, u2 AS v FROM e UNION ALL SELECT u2, u1 FROM e) GROUP BY 1),
s1 AS (SELECT u AS anchor, variant, [u] AS members, near AS open FROM near, (SELECT unnest([42, 43, 44, 45]) AS variant))"""


def grown_sql(i: int) -> str:
    pick = "list_aggregate(list_transform(open, lambda v: md5(variant || '-' || anchor || '-' || v) || v), 'min')"
    return f"""p{i} AS (SELECT anchor, variant, members, open, CAST(substr({pick}, 33) AS BIGINT) AS pick FROM s{i}),
s{i + 1} AS (SELECT anchor, variant, CASE WHEN pick IS NULL THEN members ELSE list_append(members, pick) END AS members,
  CASE WHEN pick IS NULL THEN open ELSE list_filter(open, lambda v: list_contains(near, v)) END AS open FROM p{i} LEFT JOIN near ON pick = u)"""


@query(T.sql(*AFFINITY, CLIQUES, *[grown_sql(i) for i in (1, 2, 3)], select="SELECT anchor, array_to_string(members, '|') AS members FROM s4 WHERE variant = 42"))
def affinity_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor, members: cliques of the affinity graph at its 95th percentile, grown by least hash."""
    anchors = T.checkins(spark, sf_dir).select(F.col("user_id").alias("anchor")).distinct()
    return A.grow_groups(scored_edges(spark, sf_dir), anchors, 4).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), "|"))


BEST = """sc AS (SELECT u1 AS u, u2 AS v, combined FROM scored, cut WHERE combined >= c UNION ALL SELECT u2, u1, combined FROM scored, cut WHERE combined >= c),
b1 AS (SELECT u AS anchor, [u] AS members, CAST(NULL AS DOUBLE) AS least FROM near)"""


def _best(i: int) -> str:
    return f"""c{i} AS (SELECT b.anchor, b.members, b.least, sc.v, min(sc.combined) AS s FROM b{i} b, sc WHERE list_contains(b.members, sc.u) AND NOT list_contains(b.members, sc.v) GROUP BY ALL HAVING count(*) = {i}),
b{i + 1} AS (SELECT anchor, list_append(members, v) AS members, least(coalesce(least, s), s) AS least FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY s DESC, md5('42-' || anchor || '-' || v)) AS rn FROM c{i}) WHERE rn = 1)"""


@query(T.sql(*AFFINITY, CLIQUES, BEST, *[_best(i) for i in (1, 2, 3)], select="SELECT anchor, array_to_string(members, '|') AS members, round(least, 5) AS least FROM b4"))
def best_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor, members, least: cliques of four in the same graph, each step taking the highest least affinity."""
    anchors = T.checkins(spark, sf_dir).select(F.col("user_id").alias("anchor")).distinct()
    s = _affinity(spark, sf_dir)
    best = s.best_groups(anchors, s.percentiles([95.0])[0], 4)
    return best.select("anchor", F.array_join(F.transform("members", lambda x: x.cast("string")), "|").alias("members"), F.round("least", 5).alias("least"))


# ---------------------------------------------------------------- graph

KG_SQL = {
    "HAS_CATEGORY": "SELECT 'poi:' || poi_idx AS h, 'HAS_CATEGORY' AS rel, 'cat:' || category AS t FROM venues",
    "SUBCATEGORY_OF": "SELECT DISTINCT 'cat:' || category, 'SUBCATEGORY_OF', 'cat:' || split_part(category, '>', 1) FROM venues",
    "LOCATED_IN": "SELECT 'poi:' || poi_idx, 'LOCATED_IN', 'loc:' || locality FROM venues UNION SELECT 'loc:' || locality, 'LOCATED_IN', 'reg:' || region FROM venues",
    "IS_NEAR_TO": "SELECT 'poi:' || a, 'IS_NEAR_TO', 'poi:' || b FROM knn UNION SELECT 'poi:' || b, 'IS_NEAR_TO', 'poi:' || a FROM knn",
    "FOLLOWED_BY": "SELECT DISTINCT 'poi:' || poi_idx, 'FOLLOWED_BY', 'poi:' || nxt FROM (SELECT poi_idx, lead(poi_idx) OVER (PARTITION BY user_id ORDER BY utc_time, event_id) AS nxt FROM train) WHERE nxt <> poi_idx",
    "VISITED": "SELECT DISTINCT 'user:' || user_id, 'VISITED', 'poi:' || poi_idx FROM train",
    "PREFERS_CATEGORY": "SELECT 'user:' || user_id, 'PREFERS_CATEGORY', 'cat:' || node FROM prefers",
    "FRIEND_OF": "SELECT 'user:' || u1, 'FRIEND_OF', 'user:' || u2 FROM old UNION SELECT 'user:' || u2, 'FRIEND_OF', 'user:' || u1 FROM old",
    "OCCURRED_AT": "SELECT 'group:' || group_id, 'OCCURRED_AT', 'poi:' || poi_idx FROM groups",
    "GROUP_PREFERS": "SELECT 'group:' || group_id, 'GROUP_PREFERS', 'cat:' || split_part(category, '>', 1) FROM groups JOIN venues USING (poi_idx)",
    "MEMBER_OF": "SELECT 'user:' || unnest(m), 'MEMBER_OF', 'group:' || group_id FROM groups",
    "CO_ATTENDED": "SELECT 'user:' || u1, 'CO_ATTENDED', 'user:' || u2 FROM ties UNION SELECT 'user:' || u2, 'CO_ATTENDED', 'user:' || u1 FROM ties",
}
KNN = """plane AS (SELECT poi_idx, cos(radians(latitude)) * longitude AS x, latitude AS y FROM venues),
knn AS (SELECT a, b, d FROM (SELECT p.poi_idx AS a, q.poi_idx AS b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d,
  row_number() OVER (PARTITION BY p.poi_idx ORDER BY pow(p.x - q.x, 2) + pow(p.y - q.y, 2), q.poi_idx) AS rn FROM plane p JOIN plane q ON p.poi_idx <> q.poi_idx) WHERE rn <= 10)"""
PREFERS = """leaf AS (SELECT user_id, category AS node, count(*) AS mass FROM train JOIN venues USING (poi_idx) GROUP BY 1, 2),
mass AS (SELECT user_id, node, 2 AS depth, split_part(node, '>', 1) AS parent, mass FROM leaf UNION ALL SELECT user_id, split_part(node, '>', 1), 1, '', sum(mass) FROM leaf GROUP BY 1, 2),
total AS (SELECT user_id, sum(mass) AS total FROM leaf GROUP BY 1),
roots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mass DESC, node) AS rn FROM mass JOIN total USING (user_id) WHERE depth = 1) WHERE rn = 1 OR (rn <= 2 AND mass >= {tau} * total)),
kids AS (SELECT * FROM (SELECT m.*, t.total, row_number() OVER (PARTITION BY m.user_id, m.parent ORDER BY m.mass DESC, m.node) AS rn FROM mass m JOIN total t USING (user_id) JOIN roots r ON r.user_id = m.user_id AND r.node = m.parent WHERE m.depth = 2 AND m.mass >= {tau} * t.total) WHERE rn = 1),
prefers AS (SELECT user_id, node, depth, round(mass / total, 4) AS support FROM roots UNION ALL SELECT user_id, node, depth, round(mass / total, 4) FROM kids)"""
OLD = "old AS (SELECT u1, u2 FROM ties WHERE (u1 * 31 + u2) % 3 = 0)"
GRAPH = (T.CHECKINS, T.VENUES, T.groups_sql(), T.RARITY, T.TIES, KNN, PREFERS.format(tau=0.4), OLD, "kg AS (" + " UNION ALL ".join(KG_SQL.values()) + ")")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph, written; check-ins, groups and ties are worked out once and shared by its layers."""
    train = cut(T.train(spark, sf_dir), "train")
    venues = cut(T.venues(spark, sf_dir), "venues")
    groups = cut(G.with_group_ids(G.ephemeral_groups(train)), "groups")
    ties = cut(G.co_attended(groups, G.venue_rarity(train)), "ties")
    return cut(K.build(venues, train, groups, ties, T.friends(spark, sf_dir, ties)[0]), "graph")


@query(T.sql(T.CHECKINS, T.VENUES, KNN, select="SELECT a AS poi_idx, b AS neighbour, round(d, 6) AS distance FROM knn"))
def nearest_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.nearest(T.venues(spark, sf_dir), 10).withColumn("distance", F.round("distance", 6))


@query(T.sql(T.CHECKINS, select="SELECT user_id, poi_idx, count(*) AS count, CAST(min(utc_time) AS VARCHAR) AS first_ts, CAST(max(utc_time) AS VARCHAR) AS last_ts FROM train GROUP BY 1, 2"))
def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.visits(T.train(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("first_ts", "last_ts")})


@query(T.sql(T.CHECKINS, select="SELECT poi_idx AS a, nxt AS b, count(*) AS n FROM (SELECT poi_idx, lead(poi_idx) OVER (PARTITION BY user_id ORDER BY utc_time, event_id) AS nxt FROM train) WHERE nxt <> poi_idx GROUP BY 1, 2"))
def next_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.next_visits(T.train(spark, sf_dir))


@query(T.sql(T.CHECKINS, T.VENUES, PREFERS.format(tau=0.4), select="SELECT user_id, node, CAST(depth AS INTEGER) AS depth, CAST(mass AS BIGINT) AS mass FROM mass"))
def taxonomy_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.taxonomy_mass(T.train(spark, sf_dir), T.venues(spark, sf_dir))


@query(T.sql(T.CHECKINS, T.VENUES, PREFERS.format(tau=0.05), select="SELECT user_id, node, CAST(depth AS INTEGER) AS depth, support FROM prefers"))
def prefers_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.prefers_category(T.train(spark, sf_dir), T.venues(spark, sf_dir), tau=0.05)


@query(T.sql(*GRAPH, select="SELECT h, rel, t FROM kg", recursive=True))
def knowledge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).select("h", "rel", "t")


@query(T.sql(*GRAPH, "kinds AS (SELECT h AS n FROM kg UNION SELECT t FROM kg)", select="SELECT 'relation' AS kind, rel AS name, count(*) AS n FROM kg GROUP BY rel UNION ALL SELECT 'node', CASE split_part(n, ':', 1) WHEN 'cat' THEN 'category' WHEN 'loc' THEN 'locality' WHEN 'reg' THEN 'region' ELSE split_part(n, ':', 1) END, count(*) FROM kinds GROUP BY 2", recursive=True))
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.counts(_graph(spark, sf_dir))


@query(T.sql(*GRAPH, select="SELECT t AS parent, h AS child, rel FROM kg WHERE rel IN ('HAS_CATEGORY', 'SUBCATEGORY_OF', 'LOCATED_IN', 'PREFERS_CATEGORY', 'GROUP_PREFERS')", recursive=True))
def hierarchy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.hierarchy(_graph(spark, sf_dir))


@query(T.sql(*GRAPH, "nodes AS (SELECT h AS n FROM kg UNION SELECT t FROM kg)", select="SELECT (SELECT count(*) FROM nodes) AS n_entities, (SELECT count(DISTINCT rel) FROM kg) AS n_relations, (SELECT count(*) FROM kg) AS n_triples, (SELECT count(*) FROM nodes) - 1 AS max_id", recursive=True))
def numbered_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r, t = K.numbered(_graph(spark, sf_dir))
    most = F.greatest(F.max("h"), F.max("t")).alias("max_id")
    return e.agg(F.count("*").alias("n_entities")).join(r.agg(F.count("*").alias("n_relations"))).join(t.agg(F.count("*").alias("n_triples"), most))


@query(T.sql(*GRAPH, select="SELECT CAST(split_part(h, ':', 2) AS BIGINT) AS a, rel, CAST(split_part(t, ':', 2) AS BIGINT) AS b FROM kg WHERE h LIKE 'poi:%' AND t LIKE 'poi:%' AND rel <> 'FOLLOWED_BY'", recursive=True))
def venue_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.venue_edges(_graph(spark, sf_dir), exclude=("FOLLOWED_BY",))


def _siblings(level: int, prefix: str) -> str:
    return f"""l{level} AS (SELECT {prefix} AS prefix, poi_idx, row_number() OVER (PARTITION BY {prefix} ORDER BY md5('42-' || poi_idx), poi_idx) - 1 AS i, count(*) OVER (PARTITION BY {prefix}) AS n FROM venues),
t{level} AS (SELECT x.poi_idx AS a, 'SAME_TAXONOMY_L{level}' AS rel, y.poi_idx AS b FROM l{level} x, (SELECT unnest(generate_series(1, 8)) AS s) JOIN l{level} y ON x.prefix = y.prefix AND y.i = (x.i + s) % x.n WHERE s <= x.n - 1)"""


VENUE_TRIPLES = """v AS (SELECT DISTINCT CAST(split_part(h, ':', 2) AS BIGINT) AS a, rel, CAST(split_part(t, ':', 2) AS BIGINT) AS b FROM kg WHERE h LIKE 'poi:%' AND t LIKE 'poi:%'
  UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2),
few AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY md5('42-' || a || '-' || rel || '-' || b), a, b) AS rn FROM v)"""


@query(T.sql(*GRAPH, _siblings(1, "split_part(category, '>', 1)"), _siblings(2, "category"), VENUE_TRIPLES, select="SELECT a, rel, CAST(dense_rank() OVER (ORDER BY rel) - 1 AS INTEGER) AS rel_id, b FROM few WHERE rn <= 500", recursive=True))
def venue_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue-to-venue triples with taxonomy siblings, 500 of each relation by least hash."""
    return K.venue_triples(_graph(spark, sf_dir), T.venues(spark, sf_dir), derive=(1, 2), most=500)


@query(T.sql(*GRAPH, select="SELECT rel, count(*) AS n FROM kg WHERE rel IN ('CO_VISITED_WITH', 'FOLLOWED_BY', 'VISITED', 'VISITED_AT_HOUR', 'VISITED_ON') AND h LIKE 'poi:%' AND t LIKE 'poi:%' GROUP BY 1", recursive=True))
def behavioural_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behavioural relations among the venue-to-venue edges: these must come from training data alone."""
    return K.behavioural(K.venue_edges(_graph(spark, sf_dir)))


@query(T.sql(T.CHECKINS, T.groups_sql(), "members AS (SELECT group_id, unnest(m) AS u FROM groups)", """rows AS (
SELECT 'user:' || user_id AS head, 'VISITED' AS relation, 'poi:' || poi_idx AS tail, 'count=' || count(*) AS attributes FROM train GROUP BY user_id, poi_idx
UNION ALL SELECT 'user:' || a.u, 'CO_ATTENDED', 'user:' || b.u, 'group_ids=' || string_agg(CAST(a.group_id AS VARCHAR), ',' ORDER BY a.group_id) FROM members a JOIN members b ON a.group_id = b.group_id AND a.u < b.u GROUP BY a.u, b.u
UNION ALL SELECT 'group:' || group_id, 'HAS_SIZE', 'size:' || CASE WHEN len(m) <= 2 THEN 'pair' WHEN len(m) <= 4 THEN 'small_group' ELSE 'large_group' END, '' FROM groups
UNION ALL SELECT 'user:' || u, 'MEMBER_OF', 'group:' || group_id, '' FROM members)""", select="SELECT * FROM rows", recursive=True))
def attributed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.exported(T.groups(spark, sf_dir), T.train(spark, sf_dir), G.size_bucket())


@query(T.sql(*GRAPH, select="SELECT h, rel, t FROM kg WHERE h = 'group:0' OR t = 'group:0'", recursive=True))
def ego_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ego(_graph(spark, sf_dir), "group:0")


@query(T.sql(T.CHECKINS, T.VENUES, select="SELECT CAST(len(string_split(category, '>')) AS INTEGER) AS depth, count(*) AS n FROM venues GROUP BY 1"))
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.venues(spark, sf_dir).groupBy(F.size(F.split("category", ">")).alias("depth")).agg(F.count("*").alias("n"))


AUDITS = {
    "group_size": "SELECT count(*) FROM planted_groups WHERE len(m) NOT BETWEEN 2 AND 8",
    "group_span": "SELECT count(*) FROM planted_groups WHERE t1 - t0 > 60 OR t1 < t0",
    "leaked_friends": "SELECT count(*) FROM planted_new n WHERE EXISTS (SELECT 1 FROM old o WHERE (o.u1 = n.u1 AND o.u2 = n.u2) OR (o.u1 = n.u2 AND o.u2 = n.u1))",
    "tie_order": "SELECT count(*) FROM planted_ties WHERE u1 >= u2",
}
PLANTED = """planted_groups AS (SELECT group_id, t0, CASE WHEN group_id % 7 = 0 THEN t1 + 61 ELSE t1 END AS t1, CASE WHEN group_id % 5 = 0 THEN [m[1]] ELSE m END AS m FROM groups),
planted_new AS (SELECT u2 AS u1, u1 AS u2 FROM ties WHERE (u1 * 31 + u2) % 4 = 0), planted_ties AS (SELECT CASE WHEN u1 % 3 = 0 THEN u2 ELSE u1 END AS u1, CASE WHEN u1 % 3 = 0 THEN u1 ELSE u2 END AS u2 FROM ties)"""


def _met(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Groups and ties, worked out once and written."""
    train = T.train(spark, sf_dir)
    groups = cut(G.with_group_ids(G.ephemeral_groups(train)), "groups")
    return groups, cut(G.co_attended(groups, G.venue_rarity(train)), "ties")


def _violations(broken: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in broken.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("audit"), "violations")
        out = one if out is None else out.union(one)
    return out


@query(T.sql(T.CHECKINS, T.groups_sql(), T.RARITY, T.TIES, OLD, PLANTED, select=" UNION ALL ".join(f"SELECT '{k}' AS audit, ({v}) AS violations" for k, v in AUDITS.items()), recursive=True))
def planted_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audits on tables with planted violations."""
    g, t = _met(spark, sf_dir)
    old = T.friends(spark, sf_dir, t)[0]
    g = g.withColumn("end_minute", F.when(F.col("group_id") % 7 == 0, F.col("end_minute") + 61).otherwise(F.col("end_minute")))
    g = g.withColumn("members", F.when(F.col("group_id") % 5 == 0, F.slice("members", 1, 1)).otherwise(F.col("members")))
    new = t.where((F.col("u1") * 31 + F.col("u2")) % 4 == 0).select(F.col("u2").alias("u1"), F.col("u1").alias("u2"))
    swapped = t.select(F.when(F.col("u1") % 3 == 0, F.col("u2")).otherwise(F.col("u1")).alias("u1"), F.when(F.col("u1") % 3 == 0, F.col("u1")).otherwise(F.col("u2")).alias("u2"))
    return _violations(K.broken_rules(g, swapped, old, new))


@query(T.sql(T.CHECKINS, T.groups_sql(), T.RARITY, T.TIES, OLD, PLANTED.replace("planted_groups AS (SELECT group_id, t0, CASE WHEN group_id % 7 = 0 THEN t1 + 61 ELSE t1 END AS t1, CASE WHEN group_id % 5 = 0 THEN [m[1]] ELSE m END AS m FROM groups)", "planted_groups AS (SELECT * FROM groups)").replace("SELECT u2 AS u1, u1 AS u2 FROM ties WHERE (u1 * 31 + u2) % 4 = 0", "SELECT u1, u2 FROM ties WHERE (u1 * 31 + u2) % 3 = 1").replace("SELECT CASE WHEN u1 % 3 = 0 THEN u2 ELSE u1 END AS u1, CASE WHEN u1 % 3 = 0 THEN u1 ELSE u2 END AS u2 FROM ties", "SELECT u1, u2 FROM ties"), select=" UNION ALL ".join(f"SELECT '{k}' AS audit, ({v}) AS violations" for k, v in AUDITS.items()), recursive=True))
def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows that break a rule; all are 0."""
    g, t = _met(spark, sf_dir)
    return _violations(K.broken_rules(g, t, *T.friends(spark, sf_dir, t)))
