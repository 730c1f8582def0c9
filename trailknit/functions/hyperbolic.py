"""Poincare-ball geometry on array<double> columns, as native expressions. c is the curvature's size (1 by default)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BALL = 1e-5
TINY = 1e-15


def bind(f, *values: Column) -> Column:
    """f of the values, each of which is computed once; a lambda would else compute outer expressions for every element."""
    row = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(row), lambda r: f(*[r[f"v{i}"] for i in range(len(values))])), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, k: Column | float) -> Column:
    if isinstance(k, float):
        return F.transform(a, lambda x: x * k)
    return bind(lambda v, q: F.transform(v, lambda x: x * q), a, k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def project(x: Column, c: float = 1.0, edge: float = BALL) -> Column:
    """Points beyond (1 - edge) / sqrt(c) are drawn back to it."""
    most = (1 - edge) / c**0.5
    return bind(lambda v, n: F.when(n > most, scale(v, most / F.greatest(n, F.lit(TINY)))).otherwise(v), x, norm(x))


def radius(x: Column, c: float = 1.0, scaled: bool = True) -> Column:
    """Distance from the origin; unscaled leaves out 1 / sqrt(c), as one of the two conventions does."""
    return 2 / (c**0.5 if scaled else 1.0) * F.atanh(F.least(c**0.5 * norm(x), F.lit(1 - BALL)))


def mobius_add(x: Column, y: Column, c: float = 1.0, projected: bool = True) -> Column:
    def sum_(a: Column, b: Column, ab: Column, a2: Column, b2: Column) -> Column:
        low = F.greatest(1 + 2 * c * ab + c * c * a2 * b2, F.lit(TINY))
        return bind(lambda v, w, k, q: F.zip_with(v, w, lambda s, t: s * k + t * q), a, b, (1 + 2 * c * ab + c * b2) / low, (1 - c * a2) / low)

    out = bind(lambda a, b: bind(sum_, a, b, dot(a, b), dot(a, a), dot(b, b)), x, y)
    return project(out, c) if projected else out


def gyro_distance(x: Column, y: Column, c: float = 1.0, edge: float = BALL) -> Column:
    d = norm(mobius_add(scale(x, -1.0), y, c, projected=False))
    return 2 / c**0.5 * F.atanh(F.least(c**0.5 * d, F.lit(1 - edge)))


def distance(x: Column, y: Column, c: float = 1.0) -> Column:
    """The same distance from squared norms alone; its argument is 1 + 1e-7 at least."""
    gap = subtract(x, y)
    return F.acosh(F.greatest(1 + 2 * c * dot(gap, gap) / F.greatest((1 - c * dot(x, x)) * (1 - c * dot(y, y)), F.lit(TINY)), F.lit(1 + 1e-7))) / c**0.5


def expmap0(v: Column, c: float = 1.0) -> Column:
    n = F.greatest(norm(v), F.lit(TINY))
    return project(scale(v, F.tanh(c**0.5 * n) / (c**0.5 * n)), c)


def logmap0(x: Column, c: float = 1.0) -> Column:
    n = F.greatest(norm(x), F.lit(TINY))
    return scale(x, F.atanh(F.least(c**0.5 * n, F.lit(1 - BALL))) / (c**0.5 * n))


def expmap(x: Column, v: Column, c: float = 1.0) -> Column:
    """From the tangent space at x."""
    n = F.greatest(norm(v), F.lit(TINY))
    lam = 2 / F.greatest(1 - c * dot(x, x), F.lit(TINY))
    return mobius_add(x, scale(v, F.tanh(c**0.5 * lam * n / 2) / (c**0.5 * n)), c)


def logmap(x: Column, y: Column, c: float = 1.0) -> Column:
    u = mobius_add(scale(x, -1.0), y, c, projected=False)
    n = F.greatest(norm(u), F.lit(TINY))
    lam = 2 / F.greatest(1 - c * dot(x, x), F.lit(TINY))
    return scale(u, 2 / (c**0.5 * lam) * F.atanh(F.least(c**0.5 * n, F.lit(1 - BALL))) / n)


def to_klein(x: Column, c: float = 1.0) -> Column:
    return scale(x, 2 / (1 + c * dot(x, x)))


def to_poincare(k: Column, c: float = 1.0) -> Column:
    return scale(k, 1 / (1 + F.sqrt(F.greatest(1 - c * dot(k, k), F.lit(TINY)))))


def givens(x: Column, angles: Column) -> Column:
    """Rotates consecutive pairs of coordinates, each by its angle."""
    i = lambda k: F.element_at(x, k)
    return F.flatten(F.transform(angles, lambda t, p: F.array(F.cos(t) * i((2 * p + 1).cast("int")) - F.sin(t) * i((2 * p + 2).cast("int")), F.sin(t) * i((2 * p + 1).cast("int")) + F.cos(t) * i((2 * p + 2).cast("int")))))


def midpoints(points: DataFrame, key: str, x: str, weight: str | None = None, c: float = 1.0) -> DataFrame:
    """(key, midpoint): the weighted Einstein midpoint of each group's points; c = 0 gives the weighted mean.

    It is a sum of vectors over a sum of weights, so coordinates are summed in the map tasks first and groups of any size do.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    k = to_klein(F.col(x), c) if c > 0 else F.col(x)
    rows = points.where(w > 0).select(F.col(key).alias("key"), k.alias("k"), w.alias("w"))
    if c > 0:
        rows = rows.withColumn("w", F.col("w") / F.sqrt(F.greatest(1 - c * dot(F.col("k"), F.col("k")), F.lit(TINY))))
    parts = rows.select("key", "w", F.posexplode("k").alias("i", "v")).groupBy("key", "i").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    mean = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select(F.col("key").alias(key), F.transform("s", lambda s: s["v"]).alias("m"))
    return mean.select(key, (project(to_poincare(F.col("m"), c), c) if c > 0 else F.col("m")).alias("midpoint"))


def frechet_means(points: DataFrame, key: str, x: str, weight: str | None = None, c: float = 1.0, rounds: int = 25, step: float = 0.5) -> DataFrame:
    """(key, mean): the weighted Frechet mean by damped descent from the Einstein midpoint; for groups of people, whose sizes are bounded.

    Each round averages the tangent vectors to all points and moves by `step` of that; a step of 1 would overshoot.
    Points without a positive weight are left out, and groups without any point.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    some = points.where(w > 0).select(F.col(key).alias("__key"), F.struct(F.col(x).alias("x"), w.alias("w")).alias("p"))
    held = some.groupBy("__key").agg(F.collect_list("p").alias("ps"), F.sum("p.w").alias("total"))
    start = midpoints(points, key, x, weight, c).select(F.col(key).alias("__key"), "midpoint")

    def move(m: Column, _: Column) -> Column:
        none = F.transform(m, lambda v: F.lit(0.0))
        pull = F.aggregate("ps", none, lambda s, p: add(s, scale(logmap(m, p["x"], c), p["w"] / F.col("total"))))
        return bind(lambda v, u: expmap(v, scale(u, step), c), m, pull)

    mean = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("midpoint"), move)
    return held.join(start, "__key").select(F.col("__key").alias(key), mean.alias("mean"))


def heterogeneity(points: DataFrame, key: str, x: str, c: float = 1.0) -> DataFrame:
    """(key, dispersion, depth_drop, consensus_radius): mean distance to the midpoint, mean radius less the midpoint's, and that."""
    m = midpoints(points, key, x, c=c)
    j = points.join(m, key).withColumns({"d": distance(F.col(x), F.col("midpoint"), c), "r": radius(F.col(x), c), "g": radius(F.col("midpoint"), c)})
    return j.groupBy(key).agg(F.avg("d").alias("dispersion"), (F.avg("r") - F.max("g")).alias("depth_drop"), F.max("g").alias("consensus_radius"))


def spread(points: DataFrame, key: str, x: str, c: float = 1.0) -> DataFrame:
    """(key, spread): the mean distance of a group's pairs; for groups of people, whose sizes are bounded."""
    g = points.groupBy(key).agg(F.collect_list(x).alias("xs")).where(F.size("xs") > 1)
    sums = F.aggregate(F.sequence(F.lit(0), F.size("xs") - 1), F.lit(0.0), lambda s, i: s + F.aggregate(F.col("xs"), F.lit(0.0), lambda q, y: q + distance(F.get("xs", i), y, c)))
    return g.select(key, ((sums - F.size("xs") * F.acosh(F.lit(1 + 1e-7)) / c**0.5) / (F.size("xs") * (F.size("xs") - 1))).alias("spread"))


def match_distribution(points: DataFrame, x: str, reference: DataFrame, y: str) -> DataFrame:
    """points with x standardised by coordinate and moved to the reference's mean and (sample) deviation."""
    stats = lambda d, c: d.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    a, b = stats(points, x), stats(reference, y)
    both = a.join(b.select("i", F.col("m").alias("m2"), F.col("s").alias("s2")), "i").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s", "m2", "s2"))).alias("t"))
    return points.join(F.broadcast(both)).withColumn(x, F.zip_with(x, "t", lambda v, t: (v - t["m"]) / (t["s"] + 1e-6) * t["s2"] + t["m2"])).drop("t")


def inject(points: DataFrame, x: str, wide: int, row_norm: float, kind: str = "hyperbolic", c: float = 1.0, seed: int = 42) -> DataFrame:
    """points with x turned into a row of `wide` numbers and length row_norm, to be put into a table of trained vectors.

    kind: 'hyperbolic' takes the tangent vector at the origin, 'euclidean' the vector as it is. Both are multiplied by a matrix of random
    signs over the root of the dimension, in which the sign of (i, j) is a bit of MD5('seed-i-j'); the matrix is worked out once, in one
    row, whose size is the two dimensions' product.
    """
    if kind not in ("hyperbolic", "euclidean"):
        raise ValueError(kind)
    deep = points.select(F.size(x).alias("n")).where("n > 0").limit(1)
    sign = lambda i, j: F.when(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), i.cast("string"), j.cast("string"))), 1, 1) < "8", 1.0).otherwise(-1.0)
    matrix = deep.select(F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda j: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: sign(i, j) / F.sqrt(F.col("n").cast("double")))).alias("__w"))
    v = logmap0(F.col(x), c) if kind == "hyperbolic" else F.col(x)
    moved = points.withColumn("__v", v).join(F.broadcast(matrix)).withColumn("__v", F.transform("__w", lambda w: dot(F.col("__v"), w)))
    length = F.greatest(norm(F.col("__v")), F.lit(1e-9))
    return moved.withColumn(x, scale(F.col("__v"), row_norm / length)).drop("__v", "__w")
