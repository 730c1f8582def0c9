"""Queries on embeddings, rankings and link prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trailknit.functions import hyperbolic as H
from trailknit.operators import evaluation as E
from trailknit.operators import metric as M
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


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, depth (1 to 5), x: points inside the ball, further out for deeper labels."""
    e = T.read(spark, sf_dir, "embeddings")
    depth = F.col("label") % 5 + 1
    x = F.transform("embedding", lambda v: v.cast("double") * (0.3 + 0.1 * depth.cast("double")))
    return e.select("vec_id", "label", depth.alias("depth"), x.alias("x"))


POINTS = "points AS (SELECT vec_id, label, label % 5 + 1 AS depth, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * (CAST(0.3 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(label % 5 + 1 AS DOUBLE))) AS x FROM embeddings)"
RADII = "radii AS (SELECT *, 2 * atanh(least(sqrt(list_dot_product(x, x)), CAST(0.99999 AS DOUBLE))) AS r FROM points)"


def _rank(v: str, by: str = "") -> str:
    p = f"PARTITION BY {by} " if by else ""
    return f"rank() OVER ({p}ORDER BY {v}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{v}) - 1) / 2"


@query(T.sql(POINTS, RADII, select="SELECT vec_id, round(r, 6) AS r, round(sqrt(list_dot_product(x, x)), 6) AS norm FROM radii"))
def hyperbolic_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("vec_id", F.round(H.radius(F.col("x")), 6).alias("r"), F.round(H.norm(F.col("x")), 6).alias("norm"))


PAIR = "pair AS (SELECT a.vec_id, a.x, b.x AS y FROM points a JOIN points b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(T.sql(POINTS, PAIR, "d AS (SELECT *, list_dot_product(x, x) AS xx, list_dot_product(y, y) AS yy, list_dot_product(x, y) AS xy FROM pair)", select="SELECT vec_id, round(acosh(greatest(1 + 2 * (xx + yy - 2 * xy) / ((1 - xx) * (1 - yy)), CAST(1.0000001 AS DOUBLE))), 6) AS distance, round(acosh(greatest(1 + 2 * (xx + yy - 2 * xy) / ((1 - xx) * (1 - yy)), CAST(1.0000001 AS DOUBLE))), 6) AS gyro FROM d"))
def hyperbolic_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", F.round(H.distance(F.col("x"), F.col("y")), 6).alias("distance"), F.round(H.gyro_distance(F.col("x"), F.col("y")), 6).alias("gyro"))


@query(T.sql(POINTS, PAIR, select="SELECT vec_id, CAST(0.0 AS DOUBLE) AS origin_error, CAST(0.0 AS DOUBLE) AS base_error, CAST(0.0 AS DOUBLE) AS klein_error FROM pair"))
def map_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    gap = lambda a, b: F.abs(F.round(H.norm(H.subtract(F.col(a), F.col(b))), 6))
    # step by step: nested lambdas would take the analyzer too many passes
    p = _pairs(spark, sf_dir).withColumns({"u": H.logmap0(x), "v": H.logmap(x, y), "k": H.to_klein(x)})
    p = p.withColumns({"u": H.expmap0(F.col("u")), "v": H.expmap(x, F.col("v")), "k": H.to_poincare(F.col("k"))})
    return p.select("vec_id", gap("u", "x").alias("origin_error"), gap("v", "y").alias("base_error"), gap("k", "x").alias("klein_error"))


BASED = """q AS (SELECT vec_id, x, y, list_dot_product(x, x) AS xx, list_dot_product(y, y) AS yy, list_dot_product(x, y) AS xy FROM pair),
u AS (SELECT *, list_transform(x, lambda a, i: (-a * (1 - 2 * xy + yy) + y[i] * (1 - xx)) / (1 - 2 * xy + xx * yy)) AS u FROM q),
v AS (SELECT *, sqrt(list_dot_product(u, u)) AS n FROM u),
m AS (SELECT vec_id, x, xx, [a * (1 - xx) * atanh(n) / n FOR a IN u] AS v FROM v)"""


@query(T.sql(POINTS, PAIR, BASED, select="SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS i, round(unnest(v), 6) + 0.0 AS tangent, round(unnest([a * 2 / (1 + xx) FOR a IN x]), 6) + 0.0 AS klein FROM m"))
def based_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tangent vectors at each point towards the next one, and the points in Klein's model, by coordinate."""
    p = _pairs(spark, sf_dir).withColumns({"v": H.logmap(F.col("x"), F.col("y")), "k": H.to_klein(F.col("x"))})
    rows = p.select("vec_id", F.posexplode(F.arrays_zip("v", "k")).alias("i", "z"))
    return rows.select("vec_id", "i", (F.round("z.v", 6) + 0.0).alias("tangent"), (F.round("z.k", 6) + 0.0).alias("klein"))


@query(T.sql(POINTS, "t AS (SELECT vec_id, i, x[2 * i - 1] AS a, x[2 * i] AS b, CAST(i AS DOUBLE) / 7 AS w FROM points, (SELECT unnest(generate_series(1, 32)) AS i))", select="SELECT vec_id, CAST(i AS INTEGER) AS i, round(cos(w) * a - sin(w) * b, 6) + 0 AS u, round(sin(w) * a + cos(w) * b, 6) + 0 AS v FROM t"))
def givens_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = H.givens(F.col("x"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: i.cast("double") / 7))
    t = points(spark, sf_dir).select("vec_id", turned.alias("t")).select("vec_id", "t", F.explode(F.sequence(F.lit(1), F.lit(32))).alias("i"))
    return t.select("vec_id", "i", *[(F.round(F.get("t", 2 * F.col("i") - k), 6) + 0).alias(n) for n, k in (("u", 2), ("v", 1))])


@query(T.sql(POINTS, "n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n, list_dot_product(x, x) AS q FROM points)", select="SELECT vec_id, round(atanh(n), 6) AS log_norm, round(atanh(n) / n * x[1], 6) + 0 AS log_first, round(tanh(n) / n * x[2], 6) + 0 AS exp_second, round(2 / (1 + q) * x[3], 6) + 0 AS klein_third FROM n"))
def tangent_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps to and from the tangent space at the origin, and to the Klein model, by coordinates."""
    p = points(spark, sf_dir).select("vec_id", H.logmap0(F.col("x")).alias("l"), H.expmap0(F.col("x")).alias("e"), H.to_klein(F.col("x")).alias("k"))
    coordinate = lambda c, i: F.round(F.get(c, i), 6) + 0
    return p.select("vec_id", F.round(H.norm(F.col("l")), 6).alias("log_norm"), coordinate("l", 0).alias("log_first"), coordinate("e", 1).alias("exp_second"), coordinate("k", 2).alias("klein_third"))


MIDPOINT = """klein AS (SELECT vec_id, label, x, list_transform(x, lambda v: 2 * v / (1 + list_dot_product(x, x))) AS k FROM points),
weighed AS (SELECT *, 1 / sqrt(1 - list_dot_product(k, k)) AS w FROM klein),
flat AS (SELECT label, w, unnest(k) AS v, generate_subscripts(k, 1) AS i FROM weighed),
means AS (SELECT label, i, sum(v * w) / sum(w) AS v FROM flat GROUP BY 1, 2),
centres AS (SELECT label, list(v ORDER BY i) AS k FROM means GROUP BY 1),
mids AS (SELECT label, list_transform(k, lambda v: v / (1 + sqrt(1 - list_dot_product(k, k)))) AS m FROM centres)"""


@query(T.sql(POINTS, MIDPOINT, select="SELECT label, CAST(i - 1 AS INTEGER) AS i, round(v, 6) AS v FROM (SELECT label, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM mids)"))
def gyromidpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = H.midpoints(points(spark, sf_dir), "label", "x")
    return m.select("label", F.posexplode("midpoint").alias("i", "v")).withColumn("v", F.round("v", 6))


@query(T.sql(POINTS, RADII, MIDPOINT, "j AS (SELECT label, r, 2 * atanh(sqrt(list_dot_product(m, m))) AS g, acosh(greatest(1 + 2 * (list_dot_product(x, x) + list_dot_product(m, m) - 2 * list_dot_product(x, m)) / ((1 - list_dot_product(x, x)) * (1 - list_dot_product(m, m))), CAST(1.0000001 AS DOUBLE))) AS d FROM radii JOIN mids USING (label))", select="SELECT label, round(avg(d), 6) AS dispersion, round(avg(r) - max(g), 6) AS depth_drop, round(max(g), 6) AS consensus_radius FROM j GROUP BY 1"))
def group_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.heterogeneity(points(spark, sf_dir), "label", "x").select("label", *[F.round(c, 6).alias(c) for c in ("dispersion", "depth_drop", "consensus_radius")])


@query()
def frechet_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, distance: how far the Frechet mean of each five consecutive points is from their Einstein midpoint; no SQL, tested by its gradient."""
    p = points(spark, sf_dir).select(F.floor(F.col("vec_id") / 5).alias("g"), "x")
    both = H.frechet_means(p, "g", "x").join(H.midpoints(p, "g", "x"), "g")
    return both.select("g", F.round(H.distance(F.col("mean"), F.col("midpoint")), 6).alias("distance"))


@query(T.sql(POINTS, RADII, f"k AS (SELECT {_rank('depth')} AS a, {_rank('round(r, 9)')} AS b FROM radii)", "rho AS (SELECT count(*) AS n, corr(a, b) AS rho FROM k)", select="SELECT n, round(rho, 6) AS rho, CASE WHEN rho > 0.30 THEN 'STRONG' WHEN rho > 0.10 THEN 'WEAK' ELSE 'ABSENT' END AS verdict FROM rho"))
def radial_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.radial_hierarchy(points(spark, sf_dir), "depth", "x")[0].withColumn("rho", F.round("rho", 6))


@query(T.sql(POINTS, RADII, "b AS (SELECT depth, avg(round(r, 9)) AS mean, stddev_pop(round(r, 9)) AS sd, count(*) AS n FROM radii GROUP BY 1)", select="SELECT CAST(depth AS INTEGER) AS depth, round(mean, 6) AS mean, round(sd, 6) AS sd, n, coalesce(mean > lag(mean) OVER (ORDER BY depth), true) AS rising FROM b"))
def radius_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.radial_hierarchy(points(spark, sf_dir), "depth", "x")[1].select("depth", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n", "rising")


CONSENSUS = f"""o AS (SELECT *, list_transform(generate_series(1, depth), lambda i: i || '-' || CAST(floor(label / pow(2, 5 - i)) AS BIGINT)) AS path, row_number() OVER (ORDER BY md5('7-' || vec_id), vec_id) - 1 AS at, count(*) OVER () AS n FROM radii),
pair AS (SELECT a.depth AS da, b.depth AS db, a.path AS pa, b.path AS pb, a.r AS ra, b.r AS rb, a.x AS xa, b.x AS xb, list_dot_product(a.x, a.x) AS qa, list_dot_product(b.x, b.x) AS qb, list_dot_product(a.x, b.x) AS ab
  FROM o a, (SELECT unnest(generate_series(1, 40)) AS s) JOIN o b ON b.at = (a.at + s) % a.n),
g AS (SELECT *, (1 + qa) / (1 - qa) AS ga, (1 + qb) / (1 - qb) AS gb FROM pair),
k AS (SELECT *, (ga * ga * 4 * qa / pow(1 + qa, 2) + gb * gb * 4 * qb / pow(1 + qb, 2) + 2 * ga * gb * 4 * ab / ((1 + qa) * (1 + qb))) / pow(ga + gb, 2) AS kk FROM g),
d AS (SELECT least(da, db) AS lo, greatest(da, db) AS hi, 1 - len(list_filter(generate_series(1, least(da, db)), lambda i: pa[1:i] = pb[1:i])) / least(da, db) AS divergence,
  round((ra + rb) / 2 - 2 * atanh(least(sqrt(kk) / (1 + sqrt(1 - kk)), CAST(0.99999 AS DOUBLE))), 9) AS drop_ FROM k),
fit AS (SELECT lo, hi FROM d GROUP BY 1, 2 HAVING count(*) >= 300 AND count(DISTINCT divergence) >= 2),
ranked AS (SELECT lo, hi, {_rank('divergence', 'lo, hi')} AS a, {_rank('drop_', 'lo, hi')} AS b FROM d JOIN fit USING (lo, hi)),
rho AS (SELECT lo, hi, count(*) AS n, corr(a, b) AS rho FROM ranked GROUP BY 1, 2)"""


@query(T.sql(POINTS, RADII, CONSENSUS, select="SELECT round(sum(CASE WHEN lo = hi THEN rho * n END) / sum(CASE WHEN lo = hi THEN n END), 4) AS equal_depth_rho, count(*) FILTER (WHERE lo = hi) AS equal_strata, round(sum(rho * n) / sum(n), 4) AS stratified_rho, count(*) AS strata, (SELECT round(avg(drop_), 6) FROM d) AS mean_drop, (SELECT count(*) FROM d) AS n_pairs FROM rho"))
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.concat_ws("-", i.cast("string"), F.floor(F.col("label") / F.pow(F.lit(2), 5 - i)).cast("string")))
    s = E.consensus_summary(E.consensus_pairs(points(spark, sf_dir), "vec_id", path, "x", 40))
    return s.withColumns({"equal_depth_rho": F.round("equal_depth_rho", 4), "stratified_rho": F.round("stratified_rho", 4), "mean_drop": F.round("mean_drop", 6)})


NEAR = """q AS (SELECT * FROM points WHERE vec_id % 20 = 0),
hyp AS (SELECT * FROM (SELECT q.vec_id, p.vec_id AS neighbour, round(acosh(greatest(1 + 2 * (list_dot_product(q.x, q.x) + list_dot_product(p.x, p.x) - 2 * list_dot_product(q.x, p.x)) / ((1 - list_dot_product(q.x, q.x)) * (1 - list_dot_product(p.x, p.x))), CAST(1.0000001 AS DOUBLE))), 9) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, p.vec_id) AS rn FROM q JOIN points p ON p.vec_id <> q.vec_id) WHERE rn <= 10),
euc AS (SELECT * FROM (SELECT q.vec_id, p.vec_id AS neighbour, list_distance(q.x, p.x) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(distance, 9), p.vec_id) AS rn FROM q JOIN points p ON p.vec_id <> q.vec_id) WHERE rn <= 10)"""


@query(T.sql(POINTS, NEAR, select="SELECT vec_id, neighbour, round(distance, 6) AS distance FROM hyp"))
def geodesic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return M.nearest_to(p, p.where("vec_id % 20 = 0"), "vec_id", "x").withColumn("distance", F.round("distance", 6))


@query(T.sql(POINTS, NEAR.replace("WHERE vec_id % 20 = 0", ""), select="SELECT vec_id, neighbour, round(distance, 6) AS distance FROM hyp"))
def all_geodesic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every point in the ball."""
    return M.all_nearest(points(spark, sf_dir), "vec_id", "x", 10, pivots=16, block=128)[0].withColumn("distance", F.round("distance", 6))


@query(T.sql(POINTS, NEAR, "o AS (SELECT h.vec_id, count(e.neighbour) / 10 AS overlap, avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS purity FROM hyp h LEFT JOIN euc e ON h.vec_id = e.vec_id AND h.neighbour = e.neighbour JOIN points a ON a.vec_id = h.vec_id JOIN points b ON b.vec_id = h.neighbour GROUP BY 1)", select="SELECT vec_id, overlap, CAST(purity AS DOUBLE) AS purity FROM o"))
def neighbour_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    q = p.where("vec_id % 20 = 0")
    return E.overlap_and_purity(M.nearest_to(p, q, "vec_id", "x"), M.nearest_to(p, q, "vec_id", "x", metric="euclidean"), "vec_id", p.select("vec_id", "label"))


# ---------------------------------------------------------------- rankings: parts scored for each order's customer segment

SCORES = """scores AS (SELECT l_orderkey AS example, l_linenumber AS item, sum(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2),
target AS (SELECT example, max(item) AS target FROM scores GROUP BY 1), s AS (SELECT * FROM scores JOIN target USING (example)),
own AS (SELECT example, score AS own FROM s WHERE item = target),
ranks AS (SELECT s.example, count(*) FILTER (WHERE score > own) + 1 AS rank FROM s JOIN own USING (example) GROUP BY 1)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("example"), F.col("l_linenumber").alias("item")).agg(F.sum("l_extendedprice").alias("score"))
    return s.where("example is not null").withColumn("target", F.max("item").over(W.partitionBy("example")))


@query(T.sql(SCORES, select="SELECT example, rank FROM ranks"))
def target_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ranks(_scores(spark, sf_dir), "example", "item", "score", "target")


@query(T.sql(SCORES, select="SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS acc1, round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS acc5, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS acc10, round(avg(1 / rank), 6) AS mrr FROM ranks"))
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.rank_metrics(E.ranks(_scores(spark, sf_dir), "example", "item", "score", "target"))
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("acc1", "acc5", "acc10", "mrr")])


LINKS = """known AS (SELECT DISTINCT l_suppkey AS h, l_returnflag AS r, l_linenumber AS t FROM lineitem),
cand AS (SELECT h, r, t, c AS candidate, CAST((h * 7 + c * 13 + t) % 11 AS DOUBLE) AS score FROM known, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS c)),
own AS (SELECT h, r, t, score AS own FROM cand WHERE candidate = t),
rival AS (SELECT c.* FROM cand c WHERE candidate <> t AND NOT EXISTS (SELECT 1 FROM known k WHERE k.h = c.h AND k.r = c.r AND k.t = c.candidate)),
lr AS (SELECT o.h, o.r, o.t, count(x.candidate) + 1 AS rank FROM own o LEFT JOIN rival x ON o.h = x.h AND o.r = x.r AND o.t = x.t AND x.score > own GROUP BY 1, 2, 3)"""


@query(T.sql(LINKS, select="SELECT r AS relation, count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS hits1, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS hits10 FROM lr GROUP BY ROLLUP (r)"))
def link_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = T.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("h"), F.col("l_returnflag").alias("r"), F.col("l_linenumber").alias("t")).distinct()
    cand = known.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("score", ((F.col("h") * 7 + F.col("candidate") * 13 + F.col("t")) % 11).cast("double"))
    m = E.link_prediction(E.filtered_ranks(cand, known))
    return m.select("relation", "n", *[F.round(c, 6).alias(c) for c in ("mrr", "hits1", "hits10")])


@query("WITH c AS (SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT name, (SELECT sum(n) FROM c) / n AS w FROM c) SELECT name, round(least(w / (SELECT avg(w) FROM w), 5), 6) AS weight FROM w")
def relation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = T.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("count"))
    return E.relation_weights(rel).withColumn("weight", F.round("weight", 6))


SLOTS = """g AS (SELECT l_orderkey AS e, list(l_linenumber ORDER BY l_extendedprice DESC, l_linenumber) AS r, min(l_linenumber) AS t FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber, l_extendedprice DESC) GROUP BY 1),
p AS (SELECT e, t, 0 AS i, [] :: INTEGER[] AS done, r FROM g UNION ALL SELECT e, t, i + 1, list_append(done, CASE WHEN list_contains(list_slice(list_filter(r, lambda x: NOT list_contains(done, x)), 1, 3), t) THEN t ELSE list_filter(r, lambda x: NOT list_contains(done, x))[1] END), r FROM p WHERE i < 2)"""


@query(T.sql(SLOTS, select="SELECT e AS example, CAST(i AS INTEGER) AS slot, CAST(done[i] AS DOUBLE) AS placed, list_contains(done, t) AS acc_at FROM p WHERE i > 0", recursive=True))
def greedy_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = T.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("p"))
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "l_linenumber"))), lambda x: x["l_linenumber"])
    g = line.groupBy(F.col("l_orderkey").alias("example")).agg(order.alias("ranking"), F.min("l_linenumber").alias("target"))
    return E.placed_slots(g.withColumn("slot", F.explode(F.array(F.lit(1), F.lit(2)))), "example", "slot", "ranking", "target").withColumn("placed", F.col("placed").cast("double"))


FUSE = """s AS (SELECT o_orderpriority AS g, o_custkey AS m, o_orderstatus AS i, avg(o_totalprice) AS s FROM orders GROUP BY 1, 2, 3),
pt AS (SELECT *, row_number() OVER (PARTITION BY g, m ORDER BY s, i DESC) - 1 AS p FROM s),
base AS (SELECT g, i, avg(s) AS average, min(s) AS least, max(s) AS most, sum(p) AS borda FROM pt GROUP BY 1, 2),
duel AS (SELECT a.g, a.i, b.i AS j, sign(sum(sign(a.s - b.s))) AS w FROM s a JOIN s b ON a.g = b.g AND a.m = b.m AND a.i <> b.i GROUP BY 1, 2, 3)"""


@query(T.sql(FUSE, select="SELECT b.g, b.i, round(average, 4) AS average, round(least, 4) AS least, round(most, 4) AS most, CAST(borda AS BIGINT) AS borda, CAST(coalesce(c, 0) AS DOUBLE) AS copeland FROM base b LEFT JOIN (SELECT g, i, sum(w) AS c FROM duel GROUP BY 1, 2) d ON b.g = d.g AND b.i = d.i"))
def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.col("o_custkey").alias("m"), F.col("o_orderstatus").alias("i")).agg(F.avg("o_totalprice").alias("s"))
    return E.fused(s, "g", "m", "i", "s").select("g", "i", *[F.round(c, 4).alias(c) for c in ("average", "least", "most")], "borda", F.col("copeland").cast("double").alias("copeland"))


@query(T.sql(POINTS, MIDPOINT, "d AS (SELECT a.label, b.label AS node, round(acosh(greatest(1 + 2 * (list_dot_product(a.m, a.m) + list_dot_product(b.m, b.m) - 2 * list_dot_product(a.m, b.m)) / ((1 - list_dot_product(a.m, a.m)) * (1 - list_dot_product(b.m, b.m))), CAST(1.0000001 AS DOUBLE))), 9) AS d FROM mids a JOIN mids b ON a.label <> b.label)", select="SELECT label, CAST(node AS INTEGER) AS node, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, node) AS rn FROM d) WHERE rn = 1"))
def consensus_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = H.midpoints(points(spark, sf_dir), "label", "x")
    nodes = m.select(F.col("label").alias("node"), F.col("midpoint").alias("y"))
    return E.nearest_node(m, nodes, "label", "midpoint", "node", "y", own=False).withColumn("distance", F.round("distance", 6))


INJECTED = """tangent AS (SELECT vec_id, label, [v * atanh(least(n, CAST(0.99999 AS DOUBLE))) / n FOR v IN x] AS v FROM (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM points)),
w AS (SELECT j, list(CASE WHEN substr(md5('42-' || i || '-' || j), 1, 1) < '8' THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END / sqrt(64) ORDER BY i) AS w FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(16)) AS j) GROUP BY 1),
moved AS (SELECT vec_id, label, list(list_dot_product(v, w) ORDER BY j) AS y FROM tangent, w GROUP BY 1, 2),
injected AS (SELECT vec_id, label, [v * 2 / sqrt(list_dot_product(y, y)) FOR v IN y] AS y FROM moved)"""


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.inject(points(spark, sf_dir), "x", 16, 2.0)


@query(T.sql(POINTS, INJECTED, select="SELECT vec_id, CAST(unnest(range(16)) AS INTEGER) AS i, round(unnest(y), 6) + 0.0 AS value FROM injected"))
def injected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rows of 16 numbers and length 2, by a hashed sign projection of their tangent vectors."""
    return _injected(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v")).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("value"))


@query(T.sql(POINTS, INJECTED, "a AS (SELECT vec_id, unnest(range(16)) AS i, unnest(x[1:16]) AS v FROM points), b AS (SELECT unnest(range(16)) AS i, unnest(y) AS v FROM injected)", "s AS (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM a GROUP BY 1), q AS (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM b GROUP BY 1)", select="SELECT vec_id, CAST(i AS INTEGER) AS i, round((a.v - s.m) / (s.s + CAST(0.000001 AS DOUBLE)) * q.s + q.m, 6) + 0.0 AS value FROM a JOIN s USING (i) JOIN q USING (i)"))
def matched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 coordinates of the embeddings, moved to the mean and deviation of the injected rows, by coordinate."""
    p = points(spark, sf_dir).select("vec_id", F.slice("x", 1, 16).alias("x"))
    out = H.match_distribution(p, "x", _injected(spark, sf_dir).select(F.col("x").alias("y")), "y")
    return out.select("vec_id", F.posexplode("x").alias("i", "v")).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("value"))


SPREAD = """g AS (SELECT label, vec_id % 40 AS cell, vec_id, x FROM points),
d AS (SELECT a.label, a.cell, acosh(greatest(1 + 2 * (list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x)) / ((1 - list_dot_product(a.x, a.x)) * (1 - list_dot_product(b.x, b.x))), CAST(1.0000001 AS DOUBLE))) AS d
  FROM g a JOIN g b ON a.label = b.label AND a.cell = b.cell AND a.vec_id <> b.vec_id)"""


@query(T.sql(POINTS, SPREAD, select="SELECT label || '-' || cell AS grp, round(avg(d), 6) AS spread FROM d GROUP BY 1"))
def group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of the pairs of small groups: those of a label, dealt into 40."""
    p = points(spark, sf_dir).withColumn("grp", F.concat_ws("-", F.col("label").cast("string"), (F.col("vec_id") % 40).cast("string")))
    return H.spread(p, "grp", "x").withColumn("spread", F.round("spread", 6))


@query(T.sql(SCORES, "o AS (SELECT example, rank, o_orderpriority AS priority, o_orderstatus AS status FROM ranks JOIN orders ON o_orderkey = example)", select="SELECT priority, status, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS acc1, round(avg(1 / rank), 6) AS mrr FROM o GROUP BY 1, 2"))
def comparison_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics of several runs side by side: a run is a priority and a status of orders."""
    o = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    r = E.ranks(_scores(spark, sf_dir), "example", "item", "score", "target").join(o, "example")
    grid = E.comparison_grid(r, ("priority", "status"))
    return grid.select("priority", "status", "n", *[F.round(c, 6).alias(c) for c in ("acc1", "mrr")])
