"""From raw check-ins, venues and friendships to house tables: filters, ids, splits, clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trailknit.functions import columns as C
from trailknit.operators import ordering as O
from trailknit.operators.scratch import cut

TRAIN, VAL = 0.7, 0.1
#: Rows that one task counts by key, if most keys are rare: about 0.1 GB of its memory.
ROWS_A_TASK = 1 << 19


def in_box(df: DataFrame, box: tuple[float, float, float, float], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows inside (south, north, west, east), edges included."""
    south, north, west, east = box
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def activity_filter(checkins: DataFrame, min_venue: int = 10, min_user: int = 30, venue: str = "poi_idx", user: str = "user_id") -> DataFrame:
    """Venues with enough check-ins, and then users with enough of what is left; one pass each, venues first.

    Tasks hold the venues and users, of which each has min_venue or min_user check-ins, and stream the check-ins past them unsorted.
    """
    venues = checkins.groupBy(venue).count().where(F.col("count") >= min_venue).select(venue)
    left = checkins.join(venues.hint("shuffle_hash"), venue, "left_semi")
    users = left.groupBy(user).count().where(F.col("count") >= min_user).select(user)
    return left.join(users.hint("shuffle_hash"), user, "left_semi")


def key_counts(df: DataFrame, keys: list[str], rows: int, out: str = "n") -> DataFrame:
    """(keys, out): how many rows have each key. df has `rows` rows at most, and is dealt by key into parts of some ROWS_A_TASK, as a task may hold as many keys as rows."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    return df.repartition(n, *keys).groupBy(*keys).agg(F.count("*").alias(out))


def compact_ids(df: DataFrame, raw: str, new: str, numeric: bool = True) -> DataFrame:
    """(raw, new): numbers from 0 in the order of the distinct raw ids, numeric ones by length and then text; null has no number."""
    ids = df.select(F.col(raw).cast("string").alias(raw)).where(F.col(raw).isNotNull()).distinct()
    return O.numbered(ids, [F.length(raw), F.col(raw)] if numeric else [F.col(raw)], new)


def chronological_split(checkins: DataFrame, train: float = TRAIN, val: float = VAL, tie: str = "event_id") -> DataFrame:
    """Each user's first ceil(train * n) check-ins (one at least) are 'train', up to ceil((train + val) * n) 'val', then 'test'."""
    order = W.partitionBy("user_id").orderBy("utc_time", tie)
    n = F.count("*").over(W.partitionBy("user_id"))
    pos = F.row_number().over(order)
    first = F.greatest(F.lit(1), F.ceil(F.lit(train) * F.col("__n")))
    second = F.least(F.greatest(F.ceil(F.lit(train + val) * F.col("__n")), first), F.col("__n"))
    label = F.when(F.col("pos") <= first, "train").when(F.col("pos") <= second, "val").otherwise("test")
    return checkins.withColumns({"pos": pos, "__n": n}).withColumn("split", label).drop("__n")


def fraction_split(df: DataFrame, fraction: float, *order: str) -> DataFrame:
    """'train' for the first int(fraction * N) rows of an order, else 'test'; rows are numbered range by range, not in one sorted task."""
    n = df.agg(F.count("*").alias("__n"))
    placed = O.numbered(df, [F.col(c) for c in order], "__at").join(F.broadcast(n))
    return placed.withColumn("split", F.when(F.col("__at") < F.floor(F.lit(fraction) * F.col("__n")), "train").otherwise("test")).drop("__at", "__n")


def with_metadata(checkins: DataFrame, metadata: DataFrame, key: str = "poi_idx") -> DataFrame:
    return checkins.join(metadata, key, "left")


def taxonomy_lookup(df: DataFrame, name: str, taxonomy: DataFrame) -> DataFrame:
    """path: the least of the taxonomy's paths (name, path) for a category name, else the name itself."""
    least = taxonomy.groupBy(F.col("name").alias("__name")).agg(F.min("path").alias("__path"))
    return df.join(least, F.col(name) == F.col("__name"), "left").withColumn("path", F.coalesce("__path", name)).drop("__name", "__path")


def canonical_edges(edges: DataFrame, a: str, b: str, ids: DataFrame | None = None, raw: str = "raw", new: str = "id") -> DataFrame:
    """Distinct (u1, u2) with u1 < u2; with ids (raw, id), both ends are mapped and pairs with an unknown end go."""
    e = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    if ids is not None:
        left, right = ids.select(F.col(raw).alias("__a"), F.col(new).alias("__x")), ids.select(F.col(raw).alias("__b"), F.col(new).alias("__y"))
        e = e.join(left, "__a").join(right, "__b").select(F.col("__x").alias("__a"), F.col("__y").alias("__b"))
    return e.where("__a <> __b").select(F.least("__a", "__b").alias("u1"), F.greatest("__a", "__b").alias("u2")).distinct()


def new_only(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.join(old, ["u1", "u2"], "left_anti")


def leaked_pairs(pairs: DataFrame, edges: DataFrame, a: str = "u1", b: str = "u2") -> DataFrame:
    """Pairs that stand among the edges in either direction; empty if nothing leaks."""
    both = edges.select(F.col(a).alias("u1"), F.col(b).alias("u2")).union(edges.select(F.col(b).alias("u1"), F.col(a).alias("u2")))
    return pairs.join(both, ["u1", "u2"], "left_semi")


def reconstruct_clock(rows: DataFrame, order: str = "row", slot: str = "slot", user: str | None = "user_id", wrap: int = 24) -> DataFrame:
    """week: how often the slot (1 to 168) fell by `wrap` hours or more so far; abs_hour: week * 168 + slot - 1. Per user, or over all rows."""
    w = W.partitionBy(user).orderBy(order) if user else W.orderBy(order)
    fell = F.when(F.col(slot) - F.lag(slot).over(w) <= -wrap, 1).otherwise(0)
    week = F.sum("__fell").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("__fell", fell).withColumn("week", week).withColumn("abs_hour", F.col("week") * 168 + F.col(slot) - 1).drop("__fell")


def file_clock(rows: DataFrame, order: str = "row", slot: str = "slot", wrap: int = 24) -> DataFrame:
    """reconstruct_clock() over all rows of a file, whose order is 0, 1, 2, ...: a row meets the one before by its number, and falls are summed range by range."""
    before = rows.select((F.col(order) + 1).alias(order), F.col(slot).alias("__before"))
    fell = rows.join(before, order, "left").withColumn("__fell", F.when(F.col(slot) - F.col("__before") <= -wrap, 1).otherwise(0).cast("long"))
    summed = O.sum_before(fell, [F.col(order)], "__fell", "week").withColumn("week", F.col("week") + F.col("__fell"))
    return summed.withColumn("abs_hour", F.col("week") * 168 + F.col(slot) - 1).drop("__before", "__fell")


def mat_tables(checkins: DataFrame, venue_ids: DataFrame, friends_old: DataFrame, friends_new: DataFrame, meta: DataFrame | None = None, taxonomy: DataFrame | None = None, cell: float = 0.01) -> dict[str, DataFrame]:
    """House tables of a social .mat file: check-ins (row, user_id, slot, venue, category), venue ids (poi_idx, venue_id), friendships (u1, u2).

    Venues and categories get the numbers of their values' order. A venue has its commonest category (the lower number of equally common
    ones); a category has the name that its check-ins' venues most often have in meta (venue_id, latitude, longitude, cat_name), and the name's
    least path in the taxonomy (name, path), or the name itself, or cat-<number> without any. purity is the mean share of the winning names.
    """
    number = lambda c, new: O.numbered(checkins.select(c).where(F.col(c).isNotNull()).distinct(), [F.col(c)], new)
    rows = file_clock(checkins).join(number("venue", "poi_idx"), "venue").join(number("category", "cat_idx"), "category")
    rows = cut(chronological_split(rows.withColumn("utc_time", F.col("row")), tie="row").select("user_id", "slot", "poi_idx", "cat_idx", "week", "abs_hour", F.col("row").alias("ts"), "split"), "mat-checkins")
    modal = modal_category(rows, "poi_idx", "cat_idx").join(rows.groupBy("poi_idx").agg(F.count("*").alias("n_checkins")), "poi_idx")
    venues = modal.join(venue_ids, "poi_idx", "left")
    if meta is None:
        meta = venue_ids.select("venue_id", *[F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude")], F.lit(None).cast("string").alias("cat_name")).limit(0)
    meta = meta.groupBy("venue_id").agg(F.min(F.struct("latitude", "longitude", "cat_name")).alias("m")).select("venue_id", "m.*")
    named = rows.join(venue_ids, "poi_idx").join(meta.where("cat_name <> ''"), "venue_id")
    names, purity = category_names(named, "cat_idx", "cat_name")
    paths = taxonomy.groupBy(F.col("name").alias("cat_name")).agg(F.min("path").alias("path")) if taxonomy is not None else names.select("cat_name", F.lit(None).cast("string").alias("path")).distinct()
    placed = venues.join(names.select("cat_idx", "cat_name").join(paths, "cat_name", "left"), "cat_idx", "left").join(meta.drop("cat_name"), "venue_id", "left")
    category = F.coalesce("path", "cat_name", F.concat(F.lit("cat-"), F.col("cat_idx").cast("string")))
    placed = placed.select("poi_idx", "venue_id", category.alias("category"), "latitude", "longitude", F.when(F.col("latitude").isNotNull(), C.grid_cell("latitude", "longitude", cell)).alias("locality"), "n_checkins")
    return {"checkins": rows, "poi_metadata": placed, "friendship_old": friends_old, "friendship_new_only": new_only(friends_new, friends_old), "purity": purity}


def modal_category(checkins: DataFrame, venue: str = "poi_idx", category: str = "category") -> DataFrame:
    """(venue, category): the commonest category of a venue, the least of equally common ones."""
    n = checkins.groupBy(venue, category).count()
    return n.groupBy(venue).agg(F.min_by(category, F.struct(-F.col("count"), F.col(category))).alias(category))


def category_names(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(key, name, purity): each key's commonest name and its share; and the mean purity."""
    n = rows.groupBy(key, name).count()
    votes = n.groupBy(key).agg(F.min_by(name, F.struct(-F.col("count"), F.col(name))).alias(name), (F.max("count") / F.sum("count")).alias("purity"))
    return votes, votes.agg(F.avg("purity").alias("mean_purity"))


def house_tables(pois: DataFrame, checkins: DataFrame, friends_old: DataFrame, friends_new: DataFrame, taxonomy: DataFrame, box: tuple[float, float, float, float], min_venue: int = 10, min_user: int = 30, cell: float = 0.05) -> dict[str, DataFrame]:
    """The house tables of raw venues (venue_id, latitude, longitude, venue_category_name), check-ins (user_id, venue_id, utc_time, timezone_offset) and friendships (u1, u2)."""
    inside = in_box(pois, box).groupBy("venue_id").agg(F.min_by(F.struct("latitude", "longitude", "venue_category_name"), F.struct("latitude", "longitude")).alias("v")).select("venue_id", "v.*")
    active = activity_filter(checkins.join(inside.select("venue_id"), "venue_id", "left_semi"), min_venue, min_user, "venue_id", "user_id")
    users, venues = compact_ids(active, "user_id", "id"), compact_ids(active, "venue_id", "poi_idx", numeric=False)
    meta = taxonomy_lookup(inside.join(venues, "venue_id"), "venue_category_name", taxonomy)
    meta = meta.select("poi_idx", "venue_id", F.col("path").alias("category"), C.grid_cell("latitude", "longitude", cell).alias("locality"), F.lit("").alias("region"), "latitude", "longitude", "venue_category_name")
    rows = active.withColumn("user_id", F.col("user_id").cast("string")).join(users, "user_id").drop("user_id").withColumnRenamed("id", "user_id").join(meta, "venue_id")
    split = chronological_split(rows, tie="venue_id")
    named = users.withColumnRenamed("user_id", "raw")
    strings = lambda e: e.select(F.col("u1").cast("string").alias("u1"), F.col("u2").cast("string").alias("u2"))
    old = canonical_edges(strings(friends_old), "u1", "u2", named)
    return {"checkins": split, "poi_metadata": meta.drop("venue_category_name"), "users": named, "friendship_old": old, "friendship_new_only": new_only(canonical_edges(strings(friends_new), "u1", "u2", named), old)}


def by_position(ids: DataFrame, column: str, first: int = 0) -> DataFrame:
    """(poi_idx, venue_id): the items of the one array in `column`, each with its place in it, counted from `first`."""
    return ids.select(F.posexplode(column).alias("__at", "venue_id")).select((F.col("__at") + first).cast("long").alias("poi_idx"), "venue_id")
