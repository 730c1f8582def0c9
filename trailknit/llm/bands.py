"""Numeric band join: items and sale lines of near unit prices, as totals and as the nearest few, without writing the pairs.

An item of price p (cents) pairs with every line of another item whose unit price u is at most w = max(LEAST, p div SHARE) away.

* Totals: lines are counted by (item, u), then by u. Prefix sums of count, u and checksum over sorted u are summed in blocks of 2 ** BITS
  values, blocks in blocks of blocks, and so on: every window has at most 2 ** BITS rows, and no task or driver sees all. An item's totals are
  differences of the prefix sums at its interval's ends (and at p, where the sign of u - p turns) less the sums of its own lines. Items of
  equal price share one look-up.
* Nearest few: of the lines of one u, the FIRST of each item and then the first 2 * FIRST hold the first FIRST lines of other items,
  whichever item asks. These are dealt to price ranges that widen with the price. In each range that an interval meets, two cursors start at
  p and expand outward, taking lines by gap, again up to FIRST of one item and 2 * FIRST in all. The ranges' lists of a price (at most five)
  together hold the first FIRST lines of other items, since what a range leaves out has as many lines before it.

Bounded: windows as said; a range holds at most 2 * FIRST lines for each of its distinct unit prices and one row for each distinct price
that looks into it, however hot an item, a price or a line is (limits by rank are applied in the map tasks first, see WindowGroupLimit).

Edge cases: lines without sale_id, item_id, quantity or amount, of quantity 0, or of an amount beyond 4e16 or not a number never pair; nor do items
without price or item_id, or with such a price; a null line_no counts as empty text in the checksum and comes first in ties; repeated lines
count each, repeated items get a result each; negative prices have the band LEAST; extra columns are ignored; empty tables give an
empty result (no items) or rows of rank 0 (no lines).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trailknit.llm import common

LEAST, SHARE, FIRST = 10, 500, 5
BITS = 8
WIDE = "decimal(38,0)"


def cents(price: Column) -> Column:
    """Whole cents, null where the price is none or out of range."""
    return F.when(F.abs(price) < 4e16, F.floor(100 * price + 0.5).cast("long"))


def floor_div(x: Column, y: Column) -> Column:
    """The floor of x / y in whole numbers, y > 0."""
    return F.call_function("div", x - F.pmod(x, y), y)


def unit_price(amount: Column, quantity: Column) -> Column:
    """The floor of (2 * a + q) / (2 * q) for the amount's cents a and the quantity q."""
    q = quantity.cast("long")
    sign = F.when(q < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    return F.when(q != 0, floor_div((2 * cents(amount) + q) * sign, 2 * q * sign))


def lines_of(sale_lines: DataFrame) -> DataFrame:
    """(item, u, sale_id, line_no) of the lines that can pair."""
    c = lambda name: F.col(name).cast("long").alias(name)
    out = sale_lines.select(F.col("item_id").cast("long").alias("item"), unit_price(F.col("amount"), F.col("quantity")).alias("u"), c("sale_id"), c("line_no"))
    return out.where("item is not null and u is not null and sale_id is not null")


def checksum() -> Column:
    text = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item").cast("string"))
    return F.crc32(text.cast("binary"))


def bands(prices: DataFrame) -> DataFrame:
    """prices with lo and hi, the ends of the interval around p."""
    w = F.greatest(F.lit(LEAST).cast("long"), floor_div(F.col("p"), F.lit(SHARE).cast("long")))
    return prices.withColumns({"lo": F.col("p") - w, "hi": F.col("p") + w})


# ---------------------------------------------------------------- totals


def prefix_sums(points: DataFrame, values: list[str]) -> DataFrame:
    """points (x, values) with the values summed over all points up to x; x must be distinct."""
    spark = points.sparkSession
    ends = points.agg(F.min("x"), F.max("x")).first()
    levels = [] if ends[0] is None else [BITS]
    at = lambda s: F.shiftright("x", s)
    while levels and (ends[1] >> levels[-1]) - (ends[0] >> levels[-1]) >= 1 << BITS:
        levels.append(levels[-1] + BITS)
    sums = None
    for s in reversed(levels):  # from the widest blocks on
        rows = points.groupBy(at(s).alias("block")).agg(*[F.sum(v).cast(WIDE).alias(v) for v in values])
        rows = rows.withColumn("above", F.lit(0) if sums is None else F.shiftright("block", BITS))  # at the top, few blocks
        own = W.partitionBy("above").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.select("block", "above", *[F.coalesce(F.sum(v).over(own), F.lit(0)).cast(WIDE).alias(v) for v in values])
        if sums is not None:
            up = sums.select(F.col("block").alias("above"), *[F.col(v).alias(f"up_{v}") for v in values])
            rows = rows.join(up, "above").select("block", *[(F.col(v) + F.col(f"up_{v}")).cast(WIDE).alias(v) for v in values])
        sums = common.cut(rows.select("block", *values), "band-blocks")
    own = W.partitionBy("block").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    within = points.withColumn("block", at(BITS)).select("x", "block", *[F.sum(v).over(own).cast(WIDE).alias(v) for v in values])
    if sums is None:
        return within.drop("block")
    up = sums.select("block", *[F.col(v).alias(f"up_{v}") for v in values])
    return within.join(up, "block").select("x", *[(F.col(v) + F.col(f"up_{v}")).cast(WIDE).alias(v) for v in values])


def totals(counts: DataFrame, prices: DataFrame) -> DataFrame:
    """(p, n_pairs, gap_sum, lines_crc) over all lines (u, n, crc) in the interval of each price."""
    ends = F.array(*[F.struct(x.alias("x"), F.lit(sign).alias("sign"), F.lit(turn).alias("turn")) for x, sign, turn in ((F.col("lo") - 1, -1, 1), (F.col("p"), 0, -2), (F.col("hi"), 1, 1))])
    probes = prices.select("p", F.explode(ends).alias("e")).select("p", "e.*")
    nil = F.lit(0).cast(WIDE)
    sold = counts.select(F.col("u").alias("x"), F.col("n").cast(WIDE).alias("n"), (F.col("u").cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")).cast(WIDE).alias("s"), F.col("crc").cast(WIDE).alias("crc"))
    points = sold.union(probes.select("x", nil, nil, nil)).groupBy("x").agg(*[F.sum(v).cast(WIDE).alias(v) for v in ("n", "s", "crc")])
    points = common.cut(points, "band-points")
    sums = common.cut(prefix_sums(points, ["n", "s", "crc"]), "band-prefix")
    met = probes.join(sums, "x")
    # the sum of u - p up to x; its turn at p makes the terms below p positive
    gap = F.col("turn") * (F.col("s") - F.col("p").cast("decimal(19,0)") * F.col("n"))
    return met.groupBy("p").agg(F.sum(F.col("sign") * F.col("n")).alias("n_pairs"), F.sum(gap).alias("gap_sum"), F.sum(F.col("sign") * F.col("crc")).alias("lines_crc"))


# ---------------------------------------------------------------- nearest few


def price_range(x: Column) -> Column:
    """A number that rises with x: ranges of 16 cents below 8192, and of 1/256 of each further doubling."""
    level = F.length(F.bin(F.greatest(x, F.lit(8192).cast("long")))) - 13  # 1 from 8192 on
    start = F.call_function("shiftleft", F.lit(4096).cast("long"), level)
    above = 512 + 256 * (level - 1) + floor_div(x - start, F.shiftright(start, 8))
    return F.when(x < 8192, floor_div(x, F.lit(16).cast("long"))).otherwise(above).cast("long")


def nearest(u: np.ndarray, item: np.ndarray, p: int, lo: int, hi: int) -> list[int]:
    """The places of the first lines by (gap, u), FIRST of an item and 2 * FIRST in all at most, of lines sorted by u and then rank."""
    right = int(np.searchsorted(u, p))
    left = right - 1
    taken: list[int] = []
    each: dict[int, int] = {}
    while len(taken) < 2 * FIRST:
        below = p - int(u[left]) if left >= 0 and u[left] >= lo else None
        above = int(u[right]) - p if right < len(u) and u[right] <= hi else None
        if below is None and above is None:
            break
        if above is None or below is not None and below <= above:
            end = left + 1
            left = int(np.searchsorted(u, u[left])) - 1
            group = range(left + 1, end)
        else:
            begin = right
            right = int(np.searchsorted(u, u[right], side="right"))
            group = range(begin, right)
        for i in group:
            owner = int(item[i])
            if each.get(owner, 0) < FIRST and len(taken) < 2 * FIRST:
                each[owner] = each.get(owner, 0) + 1
                taken.append(i)
    return taken


FOUND = pa.schema([(c, pa.int64()) for c in ("p", "gap", "u", "sale_id", "line_no", "item")])


def _cursors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, p, lo, hi, u, item, sale_id, line_no), sorted by range, p (null in lines), u and rank."""
    for group in common.sorted_groups(batches, ["range"]):
        line = group.column("p").is_null().to_numpy()
        lines, probes = group.filter(pa.array(line)), group.filter(pa.array(~line))
        u, item = lines.column("u").to_numpy(), lines.column("item").to_numpy()
        p, at = [], []
        for price, lo, hi in zip(*(probes.column(c).to_pylist() for c in ("p", "lo", "hi")), strict=True):
            some = nearest(u, item, price, lo, hi)
            p += [price] * len(some)
            at += some
        if at:
            part = lines.take(pa.array(at))
            gap = np.abs(part.column("u").to_numpy() - np.array(p))
            yield from pa.Table.from_arrays([pa.array(p, pa.int64()), pa.array(gap), *(part.column(c) for c in FOUND.names[2:])], schema=FOUND).to_batches()


def nearest_lines(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """(p, near): for each price an array (gap, u, sale_id, line_no, item) in that order; without any one item, its first FIRST are the nearest."""
    spark = lines.sparkSession
    order = [F.col(c).asc_nulls_first() for c in ("sale_id", "line_no", "item")]
    few = lines.withColumn("rank", F.row_number().over(W.partitionBy("u", "item").orderBy(*order))).where(F.col("rank") <= FIRST).drop("rank")
    few = few.withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy(*order))).where(F.col("rank") <= 2 * FIRST)
    few = common.cut(few.select("u", "item", "sale_id", "line_no", "rank"), "band-few")
    none = F.lit(None).cast("long")
    held = few.select(price_range(F.col("u")).alias("range"), none.alias("p"), none.alias("lo"), none.alias("hi"), "u", "item", "sale_id", "line_no", "rank")
    asks = prices.select(F.explode(F.sequence(price_range(F.col("lo")), price_range(F.col("hi")))).alias("range"), "p", "lo", "hi", none.alias("u"), none.alias("item"), none.alias("sale_id"), none.alias("line_no"), F.lit(0).alias("rank"))
    dealt = held.union(asks).repartition(common.partitions(spark), "range").sortWithinPartitions("range", "p", "u", "rank")
    found = dealt.mapInArrow(_cursors, "p long, gap long, u long, sale_id long, line_no long, item long")
    return found.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("gap", "u", "sale_id", "line_no", "item"))).alias("near"))


def band_join(sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, p, n_pairs, gap_sum, lines_crc, near) of each row of items; near: its first FIRST pairs by gap, u, sale_id, line_no, item."""
    lines = lines_of(sale_lines)
    counts = common.cut(lines.groupBy("item", "u").agg(F.count("*").alias("n"), F.sum(checksum()).alias("crc")), "band-counts")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.when(F.col("item_id").isNotNull(), cents(F.col("price").cast("double"))).alias("p"))
    asked = common.cut(asked, "band-items")
    pairs = bands(asked.where("p is not null").distinct())
    prices = common.cut(bands(asked.where("p is not null").select("p").distinct()), "band-prices")
    by_u = counts.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
    all_lines = totals(by_u, prices)
    near = nearest_lines(lines, prices)
    of_price = common.cut(prices.select("p").join(all_lines, "p", "left").join(near, "p", "left"), "band-of-price")
    met = counts.join(common.cut(pairs, "band-pairs"), F.col("item") == F.col("item_id")).where(F.col("u").between(F.col("lo"), F.col("hi")))
    n = F.col("n").cast(WIDE)
    own = met.groupBy("item_id", "p").agg(F.sum(n).alias("own_n"), F.sum(n * F.abs(F.col("u") - F.col("p")).cast("decimal(19,0)")).alias("own_gap"), F.sum(F.col("crc").cast(WIDE)).alias("own_crc"))
    own = common.cut(own, "band-own")
    out = asked.join(of_price, "p", "left").join(own, ["item_id", "p"], "left")
    less = lambda a, b: (F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))).cast("long").alias(a)
    first = F.slice(F.filter(F.coalesce("near", F.array().cast(near.schema["near"].dataType)), lambda c: c["item"] != F.col("item_id")), 1, FIRST)
    return out.select("item_id", "p", less("n_pairs", "own_n"), less("gap_sum", "own_gap"), less("lines_crc", "own_crc"), first.alias("near"))


ORACLE = """
WITH RECURSIVE bit(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
l AS (SELECT item_id, CAST(sale_id AS BIGINT) AS sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS q, CAST(floor(100 * amount + 0.5) AS BIGINT) AS a
      FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL AND amount IS NOT NULL),
s AS (SELECT *, CAST(floor((2 * a + q) / (2 * q)::DOUBLE) AS BIGINT) AS u, [ascii(c) FOR c IN string_split(concat_ws(',', sale_id, line_no, item_id), '')] AS bytes FROM l),
d AS (SELECT sale_id, line_no, item_id AS line_item_id, u, t, list_prepend(4294967295, bytes::BIGINT[]) AS bytes FROM s, tab),
lines AS (SELECT sale_id, line_no, line_item_id, u, xor(list_reduce(bytes, lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295) AS crc FROM d),
p AS (SELECT row_number() OVER () AS row, item_id, CAST(floor(100 * price + 0.5) AS BIGINT) AS p FROM items),
pairs AS (SELECT row, p.item_id, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc
          FROM p JOIN lines ON u BETWEEN p - greatest(10, p // 500) AND p + greatest(10, p // 500)
          WHERE line_item_id <> p.item_id AND (abs(u - p) <= 10 OR 1000 * abs(u - p) <= 2 * p)),
best AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY gap, u, sale_id, line_no, line_item_id) AS rank FROM pairs),
sums AS (SELECT row, count(*) AS n_pairs, sum(gap) AS gap_sum, sum(crc) AS lines_crc FROM pairs GROUP BY 1)
SELECT p.item_id, CAST(coalesce(rank, 0) AS INTEGER) AS rank, gap, u, sale_id, line_no, line_item_id,
       CAST(coalesce(n_pairs, 0) AS BIGINT) AS n_pairs, CAST(coalesce(gap_sum, 0) AS BIGINT) AS gap_sum, CAST(coalesce(lines_crc, 0) AS BIGINT) AS lines_crc
FROM p LEFT JOIN sums USING (row) LEFT JOIN (SELECT * FROM best WHERE rank <= 5) b ON p.row = b.row
"""
