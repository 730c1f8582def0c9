"""Diagnostics of embeddings and rankings: radial order, consensus, ranks, link prediction, fused scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trailknit.functions import columns as C
from trailknit.functions import hyperbolic as H
from trailknit.operators import ordering as O


def ranked(df: DataFrame, value: str, out: str, by: list[str] | None = None, method: str = "average", tie: str | None = None) -> DataFrame:
    """out: the rank of the value, tied ranks averaged, or ('ordinal') in the order of `tie`.

    Averaged ranks come from counts of distinct values; without groups these are added up range by range.
    """
    by = by or []
    if method == "ordinal":
        return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(value, tie)).cast("double"))
    n = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    if by:
        n = n.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    else:
        n = O.sum_before(n.where(F.col(value).isNotNull()), [F.col(value)], "__n", "__before")
    return df.join(n.withColumn(out, F.col("__before") + (F.col("__n") + 1) / 2).drop("__n", "__before"), [*by, value])


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None, method: str = "average", tie: str | None = None) -> DataFrame:
    """(by, n, rho)."""
    r = ranked(ranked(df, a, "__ra", by, method, tie), b, "__rb", by, method, tie)
    return r.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.corr("__ra", "__rb").alias("rho"))


def radial_hierarchy(points: DataFrame, depth: str, x: str, drop_root: bool = True) -> tuple[DataFrame, DataFrame]:
    """((rho, verdict), (depth, mean, sd, n, rising)): whether deeper categories lie further out."""
    p = points.withColumn("r", F.round(H.radius(F.col(x)), 9))
    p = p.where(F.col(depth) > 0) if drop_root else p
    rho = spearman(p, depth, "r").withColumn("verdict", F.when(F.col("rho") > 0.30, "STRONG").when(F.col("rho") > 0.10, "WEAK").otherwise("ABSENT"))
    by = p.groupBy(F.col(depth).alias("depth")).agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.count("*").alias("n"))
    return rho, by.withColumn("rising", F.coalesce(F.col("mean") > F.lag("mean").over(W.orderBy("depth")), F.lit(True)))


def consensus_pairs(points: DataFrame, key: str, path: Column, x: str, partners: int, seed: int = 7) -> DataFrame:
    """(a, b, da, db, divergence, drop) of a sample of pairs: each point with the `partners` that follow it in a hashed circle.

    divergence is 1 less the shared prefix over the shorter path; drop is the mean radius less that of the midpoint.
    """
    p = points.select(F.col(key).alias("a"), path.alias("pa"), H.radius(F.col(x)).alias("ra"), H.to_klein(F.col(x)).alias("ka"))
    p = p.withColumn("ga", 1 / F.sqrt(F.greatest(1 - H.dot(F.col("ka"), F.col("ka")), F.lit(H.TINY))))
    n = p.count()
    placed = p.join(O.numbered(p.select("a"), [C.order_key(seed, "a"), F.col("a")], "at"), "a")
    other = placed.select(F.col("a").alias("b"), F.col("pa").alias("pb"), F.col("ra").alias("rb"), F.col("ka").alias("kb"), F.col("ga").alias("gb"), F.col("at").alias("to"))
    pairs = placed.select("*", F.explode(F.sequence(F.lit(1), F.lit(min(partners, max(1, n - 1))))).alias("s")).withColumn("to", F.pmod(F.col("at") + F.col("s"), F.lit(n))).join(other, "to").where("a <> b")
    da, db = F.size("pa"), F.size("pb")
    # the midpoint, in the Klein model and then in the ball, a column a step to keep expressions flat
    pairs = pairs.withColumn("m", F.zip_with("ka", "kb", lambda u, v: (u * F.col("ga") + v * F.col("gb")) / (F.col("ga") + F.col("gb"))))
    pairs = pairs.withColumn("m", H.to_poincare(F.col("m"))).withColumn("rm", H.radius(F.col("m")))
    return pairs.select("a", "b", da.alias("da"), db.alias("db"), (1 - C.shared_depth(F.col("pa"), F.col("pb")) / F.greatest(F.least(da, db), F.lit(1))).alias("divergence"), ((F.col("ra") + F.col("rb")) / 2 - F.col("rm")).alias("drop"))


def consensus_summary(pairs: DataFrame, least: int = 300, depths: tuple[int, int] = (1, 7)) -> DataFrame:
    """One row: the mean drop, and mean Spearman correlations of divergence and drop within strata of depths from the least to the most of `depths`, weighted by pairs.

    equal_depth_rho is over strata of two equal depths, stratified_rho over all strata of a lower and a higher one;
    a stratum needs `least` pairs and two different divergences.
    """
    p = pairs.withColumns({"lo": F.least("da", "db"), "hi": F.greatest("da", "db"), "drop": F.round("drop", 9)})
    fit = p.where((F.col("lo") >= depths[0]) & (F.col("hi") <= depths[1])).groupBy("lo", "hi").agg(F.count("*").alias("c"), F.countDistinct("divergence").alias("k")).where((F.col("c") >= least) & (F.col("k") >= 2))
    rho = spearman(p.join(fit, ["lo", "hi"]), "divergence", "drop", ["lo", "hi"])
    equal = F.col("lo") == F.col("hi")
    mean = lambda some: F.sum(F.when(some, F.col("rho") * F.col("n"))) / F.sum(F.when(some, F.col("n")))
    stats = rho.agg(mean(equal).alias("equal_depth_rho"), F.count_if(equal).alias("equal_strata"), mean(F.lit(True)).alias("stratified_rho"), F.count("*").alias("strata"))
    return stats.join(F.broadcast(p.agg(F.avg("drop").alias("mean_drop"), F.count("*").alias("n_pairs"))))


def overlap_and_purity(a: DataFrame, b: DataFrame, key: str, labels: DataFrame, k: int = 10) -> DataFrame:
    """(key, overlap, purity): shared neighbours of two lists over k, and the share of a's neighbours with the label of the key."""
    both = a.join(b.select(key, "neighbour", F.lit(1).alias("in")), [key, "neighbour"], "left")
    lab = labels.select(F.col(key), F.col("label").alias("own"))
    other = labels.select(F.col(key).alias("neighbour"), "label")
    j = both.join(lab, key).join(other, "neighbour")
    return j.groupBy(key).agg((F.count("in") / k).alias("overlap"), F.avg((F.col("own") == F.col("label")).cast("double")).alias("purity"))


def ranks(scores: DataFrame, example: str, item: str, score: str, target: str) -> DataFrame:
    """(example, rank): one more than the items with a score above the target's; ties favour the target. Examples without their target have none.

    Scores are read once, as sums of doubles that are worked out twice may differ in their last bits, also the target's from its own.
    """
    is_target, w = F.col(item) == F.col(target), W.partitionBy(example)
    held = scores.withColumns({"__own": F.max(F.when(is_target, F.col(score))).over(w), "__has": F.max(is_target).over(w)}).where("__has")
    return held.groupBy(example).agg((F.count_if(F.col(score) > F.col("__own")) + 1).alias("rank"))


def rank_metrics(df: DataFrame, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """n, acc1, acc5, acc10, mrr."""
    hit = lambda k: F.avg((F.col(rank) <= k).cast("double"))
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), hit(1).alias("acc1"), hit(5).alias("acc5"), hit(10).alias("acc10"), F.avg(1 / F.col(rank)).alias("mrr"))


def filtered_ranks(scores: DataFrame, known: DataFrame) -> DataFrame:
    """(h, r, t, rank) of the targets of scores (h, r, t, candidate, score), other known tails of (h, r) left out."""
    other = known.select("h", "r", F.col("t").alias("candidate")).distinct()
    target = scores.where("candidate = t").select("h", "r", "t", F.col("score").alias("__own"))
    rivals = scores.where("candidate <> t").join(other, ["h", "r", "candidate"], "left_anti")
    above = rivals.join(target, ["h", "r", "t"]).where("score > __own").groupBy("h", "r", "t").agg(F.count("*").alias("n"))
    return target.join(above, ["h", "r", "t"], "left").select("h", "r", "t", (F.coalesce("n", F.lit(0)) + 1).alias("rank"))


def link_prediction(df: DataFrame) -> DataFrame:
    """(relation, n, mrr, hits1, hits10), relation null for all."""
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return df.rollup("r").agg(F.count("*").alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), hit(1).alias("hits1"), hit(10).alias("hits10")).withColumnRenamed("r", "relation")


def relation_weights(relations: DataFrame, most: float = 5.0) -> DataFrame:
    """(name, weight): all triples over the relation's, over the mean of these, at most `most`."""
    total = relations.agg(F.sum("count").alias("__t"))
    raw = relations.join(F.broadcast(total)).withColumn("__w", F.col("__t") / F.col("count"))
    mean = raw.agg(F.avg("__w").alias("__m"))
    return raw.join(F.broadcast(mean)).select("name", F.least(F.col("__w") / F.col("__m"), F.lit(most)).alias("weight"))


def placed_slots(slots: DataFrame, example: str, slot: str, ranking: str, target: str, k: int = 3) -> DataFrame:
    """(example, slot, placed, acc_at): each slot takes the target if it is among the k best items not placed before, else the best of them.

    ranking is an array of items, best first; acc_at tells whether the target is placed by then.
    """
    s = slots.groupBy(example).agg(F.array_sort(F.collect_list(F.struct(F.col(slot).alias("s"), F.col(ranking).alias("r"), F.col(target).alias("t")))).alias("all"))
    kind = dict(slots.dtypes)[target]
    start = F.array().cast(f"array<{kind}>")

    def step(done: Column, x: Column) -> Column:
        top = F.slice(F.array_except(x["r"], done), 1, k)
        return F.concat(done, F.array(F.when(F.array_contains(top, x["t"]), x["t"]).otherwise(F.get(top, 0))))

    folded = s.withColumn("placed", F.aggregate("all", start, step))
    out = folded.select(example, F.posexplode(F.arrays_zip("all", "placed")).alias("i", "z"), "placed").select(example, F.col("z.all.s").alias(slot), F.col("z.placed").alias("placed"), F.array_contains(F.slice("placed", F.lit(1), F.col("i") + 1), F.col("z.all.t")).alias("acc_at"))
    return out


def fused(scores: DataFrame, group: str, member: str, item: str, score: str) -> DataFrame:
    """(group, item, average, least, most, borda, copeland) of the members' scores."""
    n = F.row_number().over(W.partitionBy(group, member).orderBy(F.col(score).asc(), F.col(item).desc())) - 1
    base = scores.withColumn("__points", n).groupBy(group, item).agg(F.avg(score).alias("average"), F.min(score).alias("least"), F.max(score).alias("most"), F.sum("__points").alias("borda"))
    a = scores.select(group, member, F.col(item).alias("i"), F.col(score).alias("s"))
    b = scores.select(group, member, F.col(item).alias("j"), F.col(score).alias("t"))
    duel = a.join(b, [group, member]).where("i <> j").groupBy(group, "i", "j").agg(F.sign(F.sum(F.sign(F.col("s") - F.col("t")))).alias("w"))
    return base.join(duel.groupBy(group, F.col("i").alias(item)).agg(F.sum("w").alias("copeland")), [group, item], "left").fillna(0, ["copeland"])


def nearest_node(consensus: DataFrame, nodes: DataFrame, key: str, x: str, name: str, y: str, own: bool = True, most: int = 20_000) -> DataFrame:
    """(key, name, distance): the node nearest to each group's midpoint (own: be it of the same key).

    Nodes are a taxonomy's categories, a stated query set held against all groups: `most` is checked, more are an error.
    """
    if nodes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes")
    pairs = consensus.crossJoin(F.broadcast(nodes.select(name, F.col(y).alias("__y"))))
    d = (pairs if own else pairs.where(F.col(key) != F.col(name))).withColumn("distance", F.round(H.distance(F.col(x), F.col("__y")), 9))
    return d.groupBy(key).agg(F.min_by(name, F.struct("distance", name)).alias(name), F.min("distance").alias("distance"))


def comparison_grid(ranks: DataFrame, settings: tuple[str, ...], rank: str = "rank") -> DataFrame:
    """The metrics of several runs as one table, one row for each combination of the runs' settings (columns of ranks), in one pass."""
    return rank_metrics(ranks, rank, list(settings))
