"""Queries on link prediction: entities are `embeddings`, triples are suppliers, return flags and parts of `lineitem` that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailknit.operators import evaluation as E
from trailknit.operators import links as L
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


FLAGS = ("A", "N", "R")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, x, head_bias, tail_bias."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    e = T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), x.alias("__x"))
    by = 0.3 + 0.1 * (F.col("type") % 5 + 1).cast("double")
    return e.select("id", "type", F.transform("__x", lambda v: v * by).alias("x"), (F.get("__x", 0) * 0.1).alias("head_bias"), (F.get("__x", 1) * 0.1).alias("tail_bias"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, x, angles, curvature: the vectors of the first entities stand for trained relations."""
    e = _vectors(spark, sf_dir).where(F.col("id") < len(FLAGS))
    r = F.element_at(F.array(*[F.lit(f) for f in FLAGS]), (F.col("id") + 1).cast("int"))
    return e.select(r.alias("r"), F.reverse("x").alias("x"), F.slice("x", 1, 32).alias("angles"), (0.2 * F.col("id").cast("double") - 0.1).alias("curvature"))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = T.read(spark, sf_dir, "embeddings").select("vec_id")
    known = T.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("h"), F.col("l_returnflag").alias("r"), F.col("l_partkey").alias("t")).distinct()
    return known.join(ids.select(F.col("vec_id").alias("h")), "h", "left_semi").join(ids.select(F.col("vec_id").alias("t")), "t", "left_semi").select("h", "r", "t")


D = "CAST({} AS DOUBLE)"
ENTITIES = """ents AS (SELECT vec_id AS id, label AS type, [CAST(v AS DOUBLE) * (CAST(0.3 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(label % 5 + 1 AS DOUBLE)) FOR v IN embedding] AS x,
  CAST(embedding[1] AS DOUBLE) * CAST(0.1 AS DOUBLE) AS hb, CAST(embedding[2] AS DOUBLE) * CAST(0.1 AS DOUBLE) AS tb FROM embeddings),
known AS (SELECT DISTINCT l_suppkey AS h, l_returnflag AS r, l_partkey AS t FROM lineitem WHERE l_suppkey IN (SELECT vec_id FROM embeddings) AND l_partkey IN (SELECT vec_id FROM embeddings))"""
ROTATED = """rel AS (SELECT ['A', 'N', 'R'][id + 1] AS r, list_reverse(x) AS v, x[1:32] AS angles, ln(1 + exp(CAST(0.2 AS DOUBLE) * id - CAST(0.1 AS DOUBLE))) + CAST(0.0001 AS DOUBLE) AS c FROM ents WHERE id < 3),
tails AS (SELECT id, r, c, tb, hb, [y * tanh(sqrt(c) * n) / (sqrt(c) * n) FOR y IN x] AS x FROM (SELECT e.*, r, c, sqrt(list_dot_product(x, x)) AS n FROM ents e, rel)),
moves AS (SELECT r, c, angles, [y * tanh(sqrt(c) * n) / (sqrt(c) * n) FOR y IN v] AS v FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM rel)),
m0 AS (SELECT id AS h, r, c, hb, angles, x, v, list_dot_product(x, v) AS xv, list_dot_product(x, x) AS xx, list_dot_product(v, v) AS vv FROM tails JOIN moves USING (r, c)),
m1 AS (SELECT h, r, c, hb, angles, list_transform(x, lambda a, i: (a * (1 + 2 * c * xv + c * vv) + v[i] * (1 - c * xx)) / (1 + 2 * c * xv + c * c * xx * vv)) AS m FROM m0),
points AS (SELECT h, r, c, hb, list_transform(m, lambda a, i: CASE WHEN i % 2 = 1 THEN cos(angles[(i + 1) // 2]) * a - sin(angles[(i + 1) // 2]) * m[i + 1] ELSE sin(angles[i // 2]) * m[i - 1] + cos(angles[i // 2]) * a END) AS q FROM m1),
asked AS (SELECT * FROM known WHERE h % 20 = 0),
pairs AS (SELECT DISTINCT h, r FROM asked),
scored AS (SELECT p.h, p.r, e.id, round(-pow(acosh(greatest(1 + 2 * e.c * (list_dot_product(q, q) + list_dot_product(x, x) - 2 * list_dot_product(q, x)) / ((1 - e.c * list_dot_product(q, q)) * (1 - e.c * list_dot_product(x, x))), CAST(1.0000001 AS DOUBLE))) / sqrt(e.c), 2) + p.hb + e.tb, 9) AS score
  FROM points p JOIN pairs USING (h, r) JOIN tails e ON e.r = p.r),
ranks AS (SELECT a.h, a.r, a.t, 1 + count(*) FILTER (WHERE s.score > o.score AND k.t IS NULL) AS rank
  FROM asked a JOIN scored o ON o.h = a.h AND o.r = a.r AND o.id = a.t JOIN scored s ON s.h = a.h AND s.r = a.r
  LEFT JOIN known k ON k.h = s.h AND k.r = s.r AND k.t = s.id GROUP BY 1, 2, 3)"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _triples(spark, sf_dir)
    return L.tail_ranks(known.where("h % 20 = 0"), known, _vectors(spark, sf_dir), _relations(spark, sf_dir))


@query(T.sql(ENTITIES, ROTATED, select="SELECT h, r, t, rank FROM ranks"))
def rotation_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered ranks of the triples of every twentieth head, among all entities."""
    return _ranks(spark, sf_dir)


@query(T.sql(ENTITIES, ROTATED, select="SELECT r AS relation, count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS hits1, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS hits10 FROM ranks GROUP BY ROLLUP (r)"))
def rotation_link_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered MRR and Hits by relation and over all."""
    m = E.link_prediction(_ranks(spark, sf_dir))
    return m.select("relation", "n", *[F.round(c, 6).alias(c) for c in ("mrr", "hits1", "hits10")])


NEGATIVES = """numbered AS (SELECT id, type, row_number() OVER (ORDER BY type, id) - 1 AS number FROM ents),
pools AS (SELECT type, min(number) AS first, count(*) AS size FROM numbered GROUP BY 1),
tries AS (SELECT h, r, t, draw, attempt, CASE WHEN r = 'A' THEN first ELSE 0 END AS lo, CASE WHEN r = 'A' THEN size ELSE (SELECT count(*) FROM ents) END AS n
  FROM known JOIN ents ON ents.id = known.t JOIN pools USING (type), (SELECT unnest(range(1, 4)) AS draw), (SELECT unnest(range(1, 5)) AS attempt)),
found AS (SELECT x.*, e.id AS negative FROM (SELECT *, lo + CAST('0x' || substr(md5('42-' || h || '-' || r || '-' || t || '-' || draw || '-' || attempt), 1, 15) AS BIGINT) % n AS number FROM tries) x JOIN numbered e USING (number)),
free AS (SELECT f.* FROM found f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.h = f.h AND k.r = f.r AND k.t = f.negative))"""


@query(T.sql(ENTITIES, NEGATIVES, select="SELECT h, r, t, CAST(draw AS INTEGER) AS draw, arg_min(negative, attempt) AS negative FROM free GROUP BY h, r, t, draw"))
def typed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three corrupted tails a triple, for the flag A of the tail's own type."""
    known = _triples(spark, sf_dir)
    return L.typed_negatives(known, known, _vectors(spark, sf_dir), ["A"], n=3, attempts=4)
