"""Queries on histories, profiles and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailknit.operators import affinity as A
from trailknit.operators import companions as M
from trailknit.operators import examples as X
from trailknit.operators import groups as G
from trailknit.operators import texts as N
from trailknit.operators.scratch import cut
from trailknit.plans import graph as PG
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


def _joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


def _typed(spark: SparkSession, sf_dir: str, which: str = "split") -> DataFrame:
    return getattr(T, which)(spark, sf_dir).join(T.venues(spark, sf_dir).select("poi_idx", "category"), "poi_idx")


SEEN = "seen AS (SELECT user_id, category, min(minute) AS first_minute FROM train JOIN venues USING (poi_idx) GROUP BY 1, 2)"


@query(T.sql(T.CHECKINS, T.VENUES, SEEN, select="SELECT * FROM seen"))
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_seen(_typed(spark, sf_dir, "train"))


@query(T.sql(T.CHECKINS, "h AS (SELECT user_id, pos, split, poi_idx, utc_time, list(poi_idx) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS hist FROM split)", select="SELECT user_id, CAST(pos AS BIGINT) AS pos, array_to_string(hist, '|') AS hist, poi_idx AS target, CAST(hour(utc_time) AS INTEGER) AS t_hour, dayname(utc_time) AS t_dow FROM h WHERE split = 'test' AND len(hist) > 0"))
def individual_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.individual_examples(T.split(spark, sf_dir), "test").withColumns({"hist": _joined("hist"), "pos": F.col("pos").cast("long")})


def _best(name: str, value: str, k: int) -> str:
    """The k commonest values before each position of the test split, ties by first appearance."""
    return f"""{name}_n AS (SELECT a.user_id, a.pos, b.{value} AS value, count(*) AS n, min(b.pos) AS first FROM typed a JOIN typed b ON a.user_id = b.user_id AND b.pos < a.pos WHERE a.split = 'test' GROUP BY 1, 2, 3),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY user_id, pos ORDER BY n DESC, first) AS r FROM {name}_n),
{name} AS (SELECT user_id, pos, string_agg(value || ':' || n, '|' ORDER BY r) AS {name} FROM {name}_r WHERE r <= {k} GROUP BY 1, 2)"""


RECORDS = """typed AS (SELECT s.*, category, CAST(hour(utc_time) AS INTEGER) AS hour FROM split s JOIN venues USING (poi_idx)),
h AS (SELECT user_id, pos, split, poi_idx, utc_time, pos - min(pos) OVER (PARTITION BY user_id) AS n_seen, list(poi_idx) OVER w AS hist, list(hour) OVER w AS hours FROM typed WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING))"""


@query(T.sql(T.CHECKINS, T.VENUES, RECORDS, _best("pois", "poi_idx", 5), _best("cats", "category", 3), _best("hrs", "hour", 3), select="SELECT user_id, CAST(pos AS BIGINT) AS pos, array_to_string(hist, '|') AS hist, array_to_string(hours, '|') AS hist_hours, CAST(n_seen AS BIGINT) AS n_seen, pois AS top_pois, cats AS top_cats, hrs AS top_hrs, poi_idx AS target, CAST(hour(utc_time) AS INTEGER) AS t_hour, dayname(utc_time) AS t_dow FROM h JOIN pois USING (user_id, pos) JOIN cats USING (user_id, pos) JOIN hrs USING (user_id, pos) WHERE split = 'test' AND len(hist) > 0"))
def individual_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The individual examples of the test split with hours and profiles as columns; counts are written behind the values."""
    s = cut(_typed(spark, sf_dir).withColumn("hour", F.hour("utc_time")), "typed")
    out = X.individual_records(s, "test")
    pairs = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["value"].cast("string"), x["n"].cast("string"))), "|").alias(c)
    return out.select("user_id", "pos", _joined("hist").alias("hist"), _joined("hist_hours").alias("hist_hours"), "n_seen", *[pairs(c) for c in ("top_pois", "top_cats", "top_hrs")], "target", "t_hour", "t_dow")


@query(T.sql(T.CHECKINS, "h AS (SELECT user_id, pos, split, utc_time, list(poi_idx) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS hist FROM split)", select="SELECT user_id, CAST(pos AS BIGINT) AS pos, 'Visited: POI ' || array_to_string(hist, ', POI ') || '. It is ' || dayname(utc_time) || printf(', %02d:00. Next venue:', hour(utc_time)) AS prompt FROM h WHERE split = 'val' AND len(hist) > 0"))
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.individual_examples(T.split(spark, sf_dir), "val").select("user_id", F.col("pos").cast("long").alias("pos"), X.prompt().alias("prompt"))


@query(T.sql(T.CHECKINS, "p AS (SELECT a.user_id, a.pos, b.poi_idx AS value, count(*) AS n, min(b.pos) AS first FROM split a JOIN split b ON a.user_id = b.user_id AND b.pos < a.pos GROUP BY 1, 2, 3)", select="SELECT user_id, CAST(pos AS BIGINT) AS pos, CAST(rank AS BIGINT) AS rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, pos ORDER BY n DESC, first) AS rank FROM p) WHERE rank <= 5"))
def prefix_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.prefix_top(T.split(spark, sf_dir), "poi_idx", 5).select("user_id", F.col("pos").cast("long").alias("pos"), F.col("rank").cast("long").alias("rank"), "value", F.col("n").cast("long").alias("n"))


@query(T.sql(T.CHECKINS, T.VENUES, "m AS (SELECT DISTINCT user_id, minute FROM split WHERE split = 'test'), p AS (SELECT m.user_id, m.minute, category AS value, count(*) AS n, min(b.minute) AS first FROM m JOIN split b ON m.user_id = b.user_id AND b.minute < m.minute JOIN venues USING (poi_idx) GROUP BY 1, 2, 3)", select="SELECT user_id, minute, CAST(rank AS BIGINT) AS rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, minute ORDER BY n DESC, first, value) AS rank FROM p) WHERE rank <= 3"))
def time_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _typed(spark, sf_dir)
    return X.before_top(s, s.where("split = 'test'"), "category", 3).withColumn("rank", F.col("rank").cast("long"))


@query(T.sql(T.CHECKINS, "m AS (SELECT DISTINCT user_id, minute FROM checkins)", select="SELECT m.user_id, m.minute, count(c.event_id) AS n FROM m LEFT JOIN checkins c ON c.user_id = m.user_id AND c.minute < m.minute GROUP BY 1, 2"))
def activity_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.checkins(spark, sf_dir)
    return X.n_before(c, c)


EXAMPLES = "ex AS (SELECT group_id AS example_id, m, poi_idx, t1 + 1 AS minute FROM groups), mem AS (SELECT example_id, minute, poi_idx, len(m) AS k, unnest(m) AS user_id FROM ex)"


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.groups(spark, sf_dir).select(F.col("group_id").alias("example_id"), "members", "poi_idx", (F.col("end_minute") + 1).alias("minute"))
    return g.join(T.venues(spark, sf_dir).select("poi_idx", "category"), "poi_idx")


@query(T.sql(T.CHECKINS, T.VENUES, SEEN, T.groups_sql(), EXAMPLES, select="SELECT example_id, count(*) FILTER (WHERE first_minute < minute) = max(k) AS all_know FROM mem JOIN venues v ON v.poi_idx = mem.poi_idx LEFT JOIN seen s ON s.user_id = mem.user_id AND s.category = v.category GROUP BY 1", recursive=True))
def all_know(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.all_know(_examples(spark, sf_dir), X.first_seen(_typed(spark, sf_dir, "train")))


@query(T.sql(T.CHECKINS, T.groups_sql(), EXAMPLES, "own AS (SELECT example_id, c.* , row_number() OVER (PARTITION BY example_id, c.user_id ORDER BY c.minute DESC, c.event_id DESC) AS rn FROM mem JOIN train c ON c.user_id = mem.user_id AND c.minute < mem.minute), last AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY minute DESC, poi_idx DESC, hour(utc_time) DESC, user_id DESC) AS k FROM own WHERE rn <= 15)", select="SELECT example_id, string_agg(CAST(poi_idx AS VARCHAR), '|' ORDER BY k DESC) AS hist, string_agg(CAST(hour(utc_time) AS VARCHAR), '|' ORDER BY k DESC) AS hist_hours, string_agg(CAST(user_id AS VARCHAR), '|' ORDER BY k DESC) AS hist_owner FROM last WHERE k <= 15 GROUP BY 1", recursive=True))
def joint_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = X.joint_history(_examples(spark, sf_dir), T.train(spark, sf_dir))
    return h.withColumns({c: _joined(c) for c in ("hist", "hist_hours", "hist_owner")})


@query(T.sql(T.CHECKINS, T.RARITY, T.groups_sql(), "anchors AS (SELECT DISTINCT user_id, minute FROM split WHERE pos > 1)", f"g AS (SELECT group_id, t0, unnest(m) AS user_id FROM groups JOIN rarity USING (poi_idx) WHERE n_users <= {T.MAX_VISITORS})", select="SELECT a.user_id, a.minute, g.group_id FROM anchors a JOIN g ON a.user_id = g.user_id AND g.t0 < a.minute", recursive=True))
def occasional_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check-in from a user's second on is an anchor."""
    anchors = T.split(spark, sf_dir).where("pos > 1")
    return X.occasional(anchors, T.groups(spark, sf_dir), G.venue_rarity(T.train(spark, sf_dir)), T.MAX_VISITORS).drop("members")


@query(T.sql(T.CHECKINS, T.VENUES, T.groups_sql(), EXAMPLES, "c AS (SELECT user_id, category AS key, count(*) AS n FROM train JOIN venues USING (poi_idx) GROUP BY 1, 2), w AS (SELECT user_id, key, n / sqrt(sum(n * n) OVER (PARTITION BY user_id)) AS w FROM c), d AS (SELECT a.example_id, a.user_id, b.user_id AS other, coalesce((SELECT sum(x.w * y.w) FROM w x JOIN w y ON x.key = y.key WHERE x.user_id = a.user_id AND y.user_id = b.user_id), 0) AS v FROM mem a JOIN mem b ON a.example_id = b.example_id AND a.user_id < b.user_id)", select="SELECT example_id, round(round(1 - avg(v), 9), 4) AS heterogeneity FROM d GROUP BY 1", recursive=True))
def member_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = A.profile(_typed(spark, sf_dir, "train"), F.col("category"))
    return X.heterogeneity(_examples(spark, sf_dir), profiles)


@query(T.sql(T.CHECKINS, T.groups_sql(), T.RARITY, T.TIES, "b AS (SELECT u1 AS user_id, u2 AS f FROM ties UNION ALL SELECT u2, u1 FROM ties), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS rn FROM b) WHERE rn <= 5), n AS (SELECT f.user_id, t.poi_idx, count(*) AS n FROM f JOIN train t ON t.user_id = f.f GROUP BY 1, 2)", select="SELECT user_id, CAST(rank AS BIGINT) AS rank, poi_idx, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, poi_idx) AS rank FROM n) WHERE rank <= 5", recursive=True))
def friend_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.friend_favourites(T.ties(spark, sf_dir), T.train(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- group examples


def _hash(*parts: str) -> str:
    return f"md5({" || '-' || ".join(("42", *parts))})"


def _drawn(n: str, *parts: str) -> str:
    return f"CAST('0x' || substr({_hash(*parts)}, 1, 8) AS BIGINT) % ({n})"


SIZED = f"""every_visit AS (SELECT s.*, hour(utc_time) AS hour, category, split_part(category, '>', 1) AS prefix FROM split s JOIN venues USING (poi_idx)),
asked AS (SELECT e.*, regime, [2, 3, 4, 5][1 + {_drawn("4", "regime", "user_id", "pos")}] AS size FROM every_visit e, (SELECT unnest(['established', 'occasional', 'random']) AS regime) WHERE pos > 1)"""
ESTABLISHED = f"""established AS (SELECT user_id, pos, list_prepend(user_id, list_sort(s5.members[2:size])) AS members FROM asked JOIN s5 ON anchor = user_id AND variant = 42 + {_drawn("4", "'clique'", "user_id", "pos")}
  WHERE regime = 'established' AND len(s5.members) >= size)"""
OCCASIONAL = f"""quiet AS (SELECT group_id, m, t0, unnest(m) AS user_id FROM groups JOIN rarity USING (poi_idx) WHERE n_users <= {T.MAX_VISITORS}),
one AS (SELECT user_id, pos, size, m FROM (SELECT a.user_id, pos, size, m, row_number() OVER (PARTITION BY a.user_id, pos ORDER BY {_hash("a.user_id", "pos", "group_id")}) AS rn
  FROM asked a JOIN quiet q ON a.user_id = q.user_id AND t0 < minute AND len(m) >= size WHERE regime = 'occasional') WHERE rn = 1),
often AS (SELECT u1 AS a, u2 AS b FROM ties WHERE n_groups >= 2 UNION ALL SELECT u2, u1 FROM ties WHERE n_groups >= 2),
other AS (SELECT user_id, pos, size, v, EXISTS (SELECT 1 FROM often WHERE a = user_id AND b = v) AS again FROM (SELECT user_id, pos, size, unnest(m) AS v FROM one) WHERE v <> user_id),
keep AS (SELECT user_id, pos, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id, pos ORDER BY {_hash("'keep'", "user_id", "pos", "v")}) AS rn FROM other WHERE again) WHERE rn = 1),
rest AS (SELECT o.*, k.v AS kept, row_number() OVER (PARTITION BY o.user_id, o.pos ORDER BY o.v <> k.v, {_hash("'rest'", "o.user_id", "o.pos", "o.v")}) AS rn FROM other o JOIN keep k USING (user_id, pos)),
-- the one kept stands apart from the rest, so it is number 0
occasional AS (SELECT user_id, pos, list_prepend(user_id, list(v ORDER BY v)) AS members FROM (SELECT *, CASE WHEN v = kept THEN 0 ELSE rn - 1 END AS k FROM rest) WHERE k < size - 1 GROUP BY user_id, pos)"""


def _floyd(i: int) -> str:
    j = f"(n - 1 - (size - 1) + {i - 1})"
    t = _drawn(f"{j} + 1", "'random'", "user_id", "pos", j)
    return f"f{i + 1} AS (SELECT user_id, pos, size, n, own, CASE WHEN {i} > size - 1 THEN got WHEN list_contains(got, {t}) THEN list_append(got, {j}) ELSE list_append(got, {t}) END AS got FROM f{i})"


RANDOM = ",\n".join(
    (
        "ids AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM split))",
        "f1 AS (SELECT a.user_id, pos, size, ids.n, i AS own, CAST([] AS BIGINT[]) AS got FROM asked a JOIN ids USING (user_id) WHERE regime = 'random' AND size <= ids.n)",
        *[_floyd(i) for i in (1, 2, 3, 4)],
        "random_ones AS (SELECT f.user_id, pos, list_prepend(f.user_id, list(ids.user_id ORDER BY ids.user_id)) AS members FROM (SELECT user_id, pos, own, unnest(got) AS g FROM f5) f JOIN ids ON ids.i = CASE WHEN g >= own THEN g + 1 ELSE g END GROUP BY f.user_id, pos)",
    )
)
OFFERS = """offers AS (SELECT asked.*, members, regime || '-' || user_id || '-' || pos AS eid FROM asked
  LEFT JOIN (SELECT 'established' AS regime, * FROM established UNION ALL SELECT 'occasional', * FROM occasional UNION ALL SELECT 'random', * FROM random_ones) USING (regime, user_id, pos))"""
TESTED = """member AS (SELECT eid, user_id AS anchor, pos AS at, minute AS t, prefix AS wanted, unnest(members) AS u FROM offers),
met_before AS (SELECT eid, u, count(event_id) AS n, count(*) FILTER (WHERE prefix = wanted) AS n_wanted FROM member LEFT JOIN every_visit c ON c.user_id = u AND c.minute < t GROUP BY 1, 2),
fit AS (SELECT eid, min(n) AS fewest, min(n_wanted) > 0 AS knows FROM met_before GROUP BY 1),
mine AS (SELECT eid, anchor, c.*, row_number() OVER (PARTITION BY eid, u ORDER BY minute DESC, event_id DESC) AS rn FROM member JOIN every_visit c ON c.user_id = u AND c.minute < t),
joint AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY minute DESC, poi_idx DESC, hour DESC, user_id DESC) AS k FROM mine WHERE rn <= 15),
past AS (SELECT eid, string_agg(CAST(poi_idx AS VARCHAR), '|' ORDER BY k DESC) AS hist, string_agg(CAST(hour AS VARCHAR), '|' ORDER BY k DESC) AS hist_hours, string_agg(CAST(user_id AS VARCHAR), '|' ORDER BY k DESC) AS hist_owner,
  count(*) AS n_hist, count(*) FILTER (WHERE user_id <> anchor) AS n_others FROM joint WHERE k <= 15 GROUP BY 1),
tested AS (SELECT o.*, hist, hist_hours, hist_owner, CASE WHEN members IS NULL THEN 'no_companions' WHEN NOT knows THEN 'constraint' WHEN fewest < 5 THEN 'inactive' WHEN coalesce(n_hist, 0) < 1 THEN 'short_history' WHEN n_others = 0 THEN 'anchor_only' ELSE 'emitted' END AS reason
  FROM offers o LEFT JOIN fit USING (eid) LEFT JOIN past USING (eid))"""


def _top(what: str, value: str, k: int, shown: str) -> str:
    return f"""{what} AS (SELECT eid, u, string_agg({shown}, ',' ORDER BY r) AS l FROM (SELECT *, row_number() OVER (PARTITION BY eid, u ORDER BY n DESC, first, value) AS r
  FROM (SELECT eid, user_id AS u, {value} AS value, count(*) AS n, min(minute) AS first FROM mine JOIN good USING (eid) GROUP BY 1, 2, 3)) WHERE r <= {k} GROUP BY 1, 2)"""


EMITTED = ",\n".join(
    (
        "good AS (SELECT eid FROM tested WHERE reason = 'emitted')",
        _top("top_p", "poi_idx", 5, "value || ':' || n"),
        _top("top_c", "category", 3, "value"),
        _top("top_h", "hour", 3, "CAST(value AS VARCHAR)"),
        "seen_by AS (SELECT eid, u, n || ';' || p.l || ';' || c.l || ';' || h.l AS l FROM met_before JOIN top_p p USING (eid, u) JOIN top_c c USING (eid, u) JOIN top_h h USING (eid, u))",
        "profiles AS (SELECT eid, string_agg(l, '|' ORDER BY u <> anchor, u) AS member_profiles FROM seen_by JOIN member USING (eid, u) GROUP BY 1)",
        "counted AS (SELECT eid, user_id AS u, prefix AS key, count(*) AS n FROM mine JOIN good USING (eid) GROUP BY 1, 2, 3)",
        "normed AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY eid, u)) AS w FROM counted)",
        "dots AS (SELECT a.eid, a.u, b.u AS other, sum(a.w * b.w) AS d FROM normed a JOIN normed b ON a.eid = b.eid AND a.key = b.key AND a.u < b.u GROUP BY 1, 2, 3)",
        "far AS (SELECT eid, CAST(round(CAST(1 - coalesce(sum(d), 0) / (max(size) * (max(size) - 1) / 2) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS heterogeneity FROM tested JOIN good USING (eid) LEFT JOIN dots USING (eid) GROUP BY 1)",
        """examples AS (SELECT printf('%s_%07d', split, row_number() OVER (PARTITION BY split ORDER BY user_id, pos, regime) - 1) AS example_id, user_id AS anchor, CAST(pos AS BIGINT) AS pos, array_to_string(members, '|') AS members, list_sort(members) AS sorted,
  CAST(size AS INTEGER) AS size, regime, hist, hist_hours, hist_owner, member_profiles, poi_idx AS target, CAST(hour AS INTEGER) AS t_hour, dayname(utc_time) AS t_dow, heterogeneity, split FROM tested JOIN far USING (eid) JOIN profiles USING (eid))""",
    )
)
COMPANIONS = (*PG.AFFINITY, PG.CLIQUES, *[PG.grown_sql(i) for i in (1, 2, 3, 4)], T.groups_sql(), T.TIES, SIZED, ESTABLISHED, OCCASIONAL, RANDOM, OFFERS)


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.venues(spark, sf_dir).select("poi_idx", "category", F.split_part("category", F.lit(">"), F.lit(1)).alias("prefix"))
    return T.split(spark, sf_dir).withColumn("hour", F.hour("utc_time")).join(v, "poi_idx")


def _offers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(all check-ins, all but each user's first with the companions that each regime offers)."""
    visits = cut(_visits(spark, sf_dir), "visits")
    train = T.train(spark, sf_dir)
    met = cut(T.groups(spark, sf_dir), "groups")
    rarity = cut(G.venue_rarity(train), "rarity")
    asked = {r: M.sized(visits.where("pos > 1"), r) for r in ("established", "occasional", "random")}
    served = {
        "established": M.established(asked["established"], PG.scored_edges(spark, sf_dir).select("u1", "u2")),
        "occasional": M.occasional(asked["occasional"], met, rarity, G.co_attended(met, rarity), T.MAX_VISITORS),
        "random": M.uniform(asked["random"], visits.select("user_id").distinct()),
    }
    out = None
    for r, a in asked.items():
        one = a.join(served[r], ["user_id", "pos"], "left").withColumn("regime", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return visits, out


def _tested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(all check-ins, all offers with the reason that ends them)."""
    visits, offers = _offers(spark, sf_dir)
    return visits, X.tested_offers(offers, visits)


def _apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples with what the roster and the quartiles need."""
    visits, tested = _tested(spark, sf_dir)
    return X.heterogeneous(tested, visits).withColumns({"anchor": F.col("user_id"), "size": F.size("members")})


@query(T.sql(*COMPANIONS, select="SELECT regime, user_id, CAST(pos AS BIGINT) AS pos, CAST(size AS INTEGER) AS size, array_to_string(members, '|') AS members FROM offers WHERE members IS NOT NULL", recursive=True))
def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is offered to each check-in, by regime."""
    _, offers = _offers(spark, sf_dir)
    return offers.where("members is not null").select("regime", "user_id", F.col("pos").cast("long").alias("pos"), "size", _joined("members").alias("members"))


@query(T.sql(*COMPANIONS, TESTED, EMITTED, select="SELECT * EXCLUDE (sorted) FROM examples", recursive=True))
def group_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits, tested = _tested(spark, sf_dir)
    examples = X.described(tested, visits)
    pois = lambda p: F.array_join(F.transform(p["top_pois"], lambda x: F.concat_ws(":", x["poi_idx"].cast("string"), x["n"].cast("string"))), ",")
    told = F.array_join(F.transform("member_profiles", lambda p: F.concat_ws(";", p["n_seen"].cast("string"), pois(p), F.array_join(p["top_cats"], ","), F.array_join(F.transform(p["top_hrs"], lambda h: h.cast("string")), ","))), "|")
    return examples.withColumns({c: _joined(c) for c in ("members", "hist", "hist_hours", "hist_owner")} | {"member_profiles": told, "pos": F.col("pos").cast("long")})


@query(T.sql(*COMPANIONS, TESTED, select=f"SELECT regime, count(*) AS n_offers, count(*) FILTER (WHERE reason <> 'no_companions') AS candidates, {', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}" for r in (*X.REASONS, 'emitted'))} FROM tested GROUP BY 1", recursive=True))
def example_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.funnel(_tested(spark, sf_dir)[1])


@query(T.sql(*COMPANIONS, TESTED, EMITTED, select="SELECT regime, array_to_string(sorted, '|') AS members, max(size) AS size, array_to_string(list_sort(list(DISTINCT anchor)), '|') AS anchors, count(*) AS n_examples, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test, CAST(round(CAST(avg(heterogeneity) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS heterogeneity FROM examples GROUP BY regime, sorted", recursive=True))
def example_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.roster(_apart(spark, sf_dir)).withColumns({c: _joined(c) for c in ("members", "anchors")})


@query(T.sql(*COMPANIONS, TESTED, EMITTED, select="SELECT split, count(*) AS n, round(quantile_cont(heterogeneity, 0.25), 6) AS p25, round(quantile_cont(heterogeneity, 0.5), 6) AS p50, round(quantile_cont(heterogeneity, 0.75), 6) AS p75 FROM examples GROUP BY 1", recursive=True))
def heterogeneity_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.example_stats(_apart(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("p25", "p50", "p75")})


# ---------------------------------------------------------------- texts


def _chr(text: str) -> str:
    """A text as an SQL expression."""
    return " || chr(10) || ".join("'" + t.replace("'", "''") + "'" for t in text.split("\n"))


def _before(name: str, value: str, shown: str, k: int, order: str = "r") -> str:
    return f"""{name} AS (SELECT user_id, pos, string_agg({shown}, ', ' ORDER BY {order}) AS l FROM (SELECT *, row_number() OVER (PARTITION BY user_id, pos ORDER BY n DESC, first) AS r
  FROM (SELECT a.user_id, a.pos, b.{value} AS value, count(*) AS n, min(b.pos) AS first FROM told a JOIN told b ON a.user_id = b.user_id AND b.pos < a.pos WHERE a.split = 'test' GROUP BY 1, 2, 3)) WHERE r <= {k} GROUP BY 1, 2)"""


TEXTS = (
    "told AS (SELECT s.*, hour(utc_time) AS hour, category, '<poi_' || poi_idx || '> (' || category || ', ' AS place FROM split s JOIN venues USING (poi_idx))",
    _before("p", "place", "value || 'x' || n || ')'", 5),
    _before("c", "category", "value", 3),
    _before("h", "hour", "value || ':00'", 3, "value"),
    "fb AS (SELECT u1 AS user_id, u2 AS f FROM ties UNION SELECT u2, u1 FROM ties), f5 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS rn FROM fb)",
    "fp AS (SELECT f5.user_id, place, t.poi_idx, count(*) AS n FROM f5 JOIN told t ON t.user_id = f AND t.split = 'train' WHERE rn <= 5 GROUP BY 1, 2, 3)",
    "ff AS (SELECT user_id, (SELECT count(*) FROM fb WHERE fb.user_id = q.user_id) || ' friends in the network' || chr(10) || 'friends'' favourite places: ' || string_agg(place || 'x' || n || ')', ', ' ORDER BY r) || chr(10) AS l FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, poi_idx) AS r FROM fp) q WHERE r <= 5 GROUP BY user_id)",
    "w AS (SELECT user_id, pos, split, hour, utc_time, poi_idx, list(place || hour || ':00)') OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS hist FROM told)",
)


@query(T.sql(T.CHECKINS, T.VENUES, T.groups_sql(), T.RARITY, T.TIES, *TEXTS, select=f"""SELECT w.user_id, CAST(w.pos AS BIGINT) AS pos, w.poi_idx AS target, {_chr(N.HEAD)} || {_chr("[user profile]")} || chr(10) || 'check-ins so far: ' || (w.pos - 1) || chr(10) || 'most visited: ' || p.l || chr(10)
  || 'favourite categories: ' || c.l || chr(10) || 'usual hours: ' || h.l || chr(10) || coalesce('[friends]' || chr(10) || ff.l, '') || '[recent check-ins]' || chr(10) || array_to_string(hist, chr(10)) || chr(10) || '[current time] ' || dayname(utc_time) || ' ' || hour || ':00' || chr(10) || '[next POI] ' AS text
  FROM w JOIN p USING (user_id, pos) JOIN c USING (user_id, pos) JOIN h USING (user_id, pos) LEFT JOIN ff ON ff.user_id = w.user_id WHERE w.split = 'test'""", recursive=True))
def example_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = _visits(spark, sf_dir)
    friends = N.friends_texts(T.ties(spark, sf_dir), visits.where("split = 'train'"))
    return N.example_texts(visits, "test", friends).withColumn("pos", F.col("pos").cast("long"))
