"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the corpus (in characters) over its present share. Each document is repeated
a Poisson number of times with that mean: the distribution is inverted at a uniform number from a hash of the seed and
doc_id, so the draw needs no state, no order and no second pass, and comes out the same on every cluster. Rates above
STEP are drawn as a sum of equal parts, each with a uniform number of its own, so the table of a source's distribution has
STEPS entries whatever the rate. Copies are then shuffled globally: dealt into
partitions by a hash of seed, doc_id and copy, and sorted by it there.

Only a row for each source is aggregated (map tasks combine first, so a source with a third of all rows is no hot key). Up to
MAX_SOURCES rows (a checked size) are broadcast; beyond, numbers of copies are drawn on (doc_id, source) alone, in a join of two
plain shuffles, whose hot partitions Spark splits. Either way the texts are shuffled once, by the order of the copies: that
is a hash, so partitions come out even without a sampling pass.

Target weights are a table (source, weight), or by default the square root of each source's characters, which lies half-way
between the natural and an equal mix.

Edge cases: a null source is a source of its own; sources without a weight have weight 0 and vanish, sources without any
characters keep rate 1; null and empty texts count no characters and are drawn like others; rows that share a doc_id
are drawn alike (rows without one count as one); extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailknit.llm import common

SEED = "mix-1"
STEP, STEPS = 16.0, 80
MAX_SOURCES = 50_000
TWO_52 = float(1 << 52)


def uniform(*parts: Column | str) -> Column:
    """A number from 0 to 1, of 52 bits of the MD5 of the parts."""
    text = F.concat_ws("-", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / TWO_52


def distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... STEPS - 1 of the Poisson distribution."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(x: Column, k: Column) -> Column:
        p = x["p"] * rate / k
        return F.struct(p.alias("p"), (x["sum"] + p).alias("sum"), F.concat(x["all"], F.array(x["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)), start, step, lambda x: x["all"])


def rates(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(source, rate): the mean number of copies of each source's documents."""
    mass = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("mass"))
    if weights is None:
        weighed = mass.withColumn("weight", F.sqrt("mass"))
    else:
        given = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        weighed = mass.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "mass", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = weighed.agg(F.sum("mass").alias("total"), F.sum("weight").alias("parts"))
    rate = F.when(F.col("mass") > 0, F.col("weight") / F.col("parts") * F.col("total") / F.col("mass")).otherwise(1.0)
    return weighed.join(F.broadcast(total)).select("source", rate.alias("rate"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, seed: str = SEED, max_sources: int = MAX_SOURCES) -> DataFrame:
    """docs with rate and copy (1, 2, ...), each row as often as drawn, in the order of the shuffle."""
    table = common.cut(rates(docs, weights), "mixing-rates").withColumnRenamed("source", "__source").withColumnRenamed("rate", "__rate")
    parts = F.greatest(F.ceil(F.col("__rate") / STEP), F.lit(1)).cast("int")
    table = table.withColumn("__parts", parts).withColumn("__table", distribution(F.col("__rate") / F.col("__parts")))
    own = docs.drop("rate", "copy")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda n, i: n + F.size(F.filter("__table", lambda c: c <= uniform(seed, i.cast("string"), name))))
    same = F.col("source").eqNullSafe(F.col("__source"))
    if table.limit(max_sources + 1).count() <= max_sources:
        counted = own.join(F.broadcast(table), same).withColumn("__n", draw)
    else:
        thin = own.select("doc_id", "source").distinct().join(table, same).select(F.col("doc_id").alias("__doc"), "__source", "__rate", draw.alias("__n"))
        counted = own.join(common.cut(thin.where("__n > 0"), "mixing-draws"), F.col("doc_id").eqNullSafe(F.col("__doc")) & same)
    drawn = counted.where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    key = F.md5(F.concat_ws("-", F.lit(seed), F.lit("order"), name, F.col("copy").cast("string")))
    return drawn.select(*own.columns, F.col("__rate").alias("rate"), "copy", key.alias("__key")).repartition("__key").sortWithinPartitions("__key").drop("__key")


ORACLE = f"""
WITH RECURSIVE mass AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS mass FROM documents GROUP BY source),
total AS (SELECT sum(mass) AS total, sum(sqrt(mass)) AS parts FROM mass),
rates AS (SELECT source, CASE WHEN mass > 0 THEN sqrt(mass) / parts * total / mass ELSE 1.0 END AS rate FROM mass, total),
parted AS (SELECT source, rate, greatest(CAST(ceil(rate / {STEP}) AS BIGINT), 1) AS parts FROM rates),
steps(source, k, l, p, c) AS (
  SELECT source, 0, rate / parts, exp(-rate / parts), exp(-rate / parts) FROM parted
  UNION ALL SELECT source, k + 1, l, p * l / (k + 1), c + p * l / (k + 1) FROM steps WHERE k < {STEPS - 1}),
tables AS (SELECT source, list(c ORDER BY k) AS t FROM steps GROUP BY source),
draws AS (SELECT doc_id, text, d.source, rate, t, unnest(generate_series(1, parts)) AS i
          FROM documents d JOIN parted r ON d.source IS NOT DISTINCT FROM r.source JOIN tables s ON d.source IS NOT DISTINCT FROM s.source),
counted AS (SELECT doc_id, any_value(text) AS text, any_value(source) AS source, any_value(rate) AS rate,
            CAST(sum(len(list_filter(t, lambda c: c <= CAST(CAST('0x' || substr(md5('{SEED}-' || i || '-' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / {TWO_52}))) AS BIGINT) AS n
            FROM draws GROUP BY doc_id)
SELECT doc_id, text, source, round(rate, 9) AS rate, CAST(unnest(generate_series(1, n)) AS INTEGER) AS copy FROM counted WHERE n > 0
"""
