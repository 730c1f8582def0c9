"""Numbers and running sums in a total order of rows, without a task that sees all rows.

The order is cut into ranges by Spark's range partitioning; what the driver holds is its sample, bounded by the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from trailknit.operators.scratch import cut


def sum_before(df: DataFrame, order: list[Column], value: str | Column, out: str) -> DataFrame:
    """out: the sum of the value over the rows that come before in the order, 0 for the first.

    Rows are dealt into ranges of the order by Spark's range partitioning and written once; equal keys share a range. Ranges are summed each
    on its own, and a small window over one row a range gives where each begins.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(value) if isinstance(value, str) else value
    dealt = cut(df.withColumn("__value", value).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    # one row a range
    begin = per.select("__part", F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__begin"))
    within = F.coalesce(F.sum("__value").over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__within", within).join(F.broadcast(begin), "__part").withColumn(out, F.col("__begin") + F.col("__within")).drop("__part", "__value", "__begin", "__within")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """out: 0, 1, 2, ... in the order."""
    return sum_before(df, order, F.lit(1).cast("long"), out)
