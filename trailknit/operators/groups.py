"""Groups of people who were in the same place at the same time, and what follows from them.

Members are sorted arrays of user ids. Minutes are whole minutes since 1970.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trailknit.functions import columns as C

SLICE = 7 * 1440


def _numbered(checkins: DataFrame, order: list[str]) -> DataFrame:
    return checkins.withColumn("__rn", F.row_number().over(W.partitionBy("poi_idx").orderBy("minute", *order)))


def gap_sessions(checkins: DataFrame, gap: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """session: a number that rises wherever more than `gap` minutes pass between check-ins at a place."""
    keys = keys or ["poi_idx"]
    w = W.partitionBy(*keys).orderBy("minute", *order)
    opens = F.when(F.col("minute") - F.lag("minute").over(w) > gap, 1).otherwise(0)
    return checkins.withColumn("__open", opens).withColumn("session", F.sum("__open").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__open")


def ephemeral_groups(checkins: DataFrame, window: int = 60, min_size: int = 2, max_size: int = 8, order: tuple[str, ...] = ("user_id", "event_id")) -> DataFrame:
    """(poi_idx, start_minute, end_minute, size, members) of the groups that met at a place within a window.

    Each check-in opens a candidate of all visitors in the `window` minutes from it on. Candidates of a fitting size are
    taken from the largest (then the earliest) on, unless one that was taken holds all their members and overlaps
    them in time. Windows are moved over a place's slices of time, each with the minutes that its windows reach beyond it, so that a
    check-in enters and leaves one window and dense places cost no more than others. Stretches of candidates end at minutes that no candidate spans, and each stretch is folded alone; hours in which
    a place is empty, or too full for a group, end a stretch.
    """
    # a check-in belongs to the slice of its minute, and to the ones whose windows reach it
    width = max(SLICE, window)
    own, kind_p, kind_u = F.floor(F.col("minute") / width), checkins.schema["poi_idx"].dataType.simpleString(), checkins.schema["user_id"].dataType.simpleString()
    rows = checkins.where("poi_idx is not null and user_id is not null and minute is not null").withColumn("__own", own)
    rows = rows.select("poi_idx", "user_id", "minute", *[F.col(c).alias(f"__by{i}") for i, c in enumerate(order)], "__own", F.explode(F.sequence(F.floor((F.col("minute") - window) / width), F.col("__own"))).alias("__slice"))

    def ahead(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["minute", *[f"__by{i}" for i in range(len(order))]], kind="stable", na_position="first")
        minute, user, opens = part["minute"].tolist(), part["user_id"].tolist(), (part["__own"] == part["__slice"]).tolist()
        seen, end, found = {}, 0, []
        for i, t in enumerate(minute):
            if not opens[i]:
                break  # what is left belongs to the next slice
            while end < len(minute) and minute[end] <= t + window:
                seen[user[end]] = seen.get(user[end], 0) + 1
                end += 1
            if min_size <= len(seen) <= max_size:
                found.append((t, minute[end - 1], sorted(seen), i))
            seen[user[i]] -= 1
            if not seen[user[i]]:
                del seen[user[i]]
        return pd.DataFrame(found, columns=["t0", "t1", "m", "__rn"]).assign(poi_idx=part["poi_idx"].iloc[0])

    # a stated number of partitions, as these rows are small but long work
    parts = int(checkins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cand = rows.repartition(parts, "poi_idx", "__slice").groupBy("poi_idx", "__slice").applyInPandas(ahead, f"t0 bigint, t1 bigint, m array<{kind_u}>, __rn int, poi_idx {kind_p}")
    w = W.partitionBy("poi_idx").orderBy("t0", "__rn")
    opens = F.when(F.col("t0") > F.max("t1").over(w.rowsBetween(W.unboundedPreceding, -1)), 1).otherwise(0)
    cand = cand.withColumn("__open", opens).withColumn("session", F.sum("__open").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    each = F.struct((-F.size("m")).alias("s"), F.col("t0"), F.col("__rn").alias("rn"), F.col("t1"), F.col("m"))
    kind = f"array<struct<s:int,t0:bigint,rn:int,t1:bigint,m:array<{kind_u}>>>"

    def keep(kept: Column, x: Column) -> Column:
        inside = F.exists(kept, lambda k: (F.size(F.array_except(x["m"], k["m"])) == 0) & ~((x["t1"] < k["t0"]) | (x["t0"] > k["t1"])))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(x)))

    folded = cand.groupBy("poi_idx", "session").agg(F.array_sort(F.collect_list(each)).alias("all"))
    kept = folded.select("poi_idx", F.explode(F.aggregate(F.col("all").cast(kind), F.array().cast(kind), keep)).alias("g"))
    return kept.select("poi_idx", F.col("g.t0").alias("start_minute"), F.col("g.t1").alias("end_minute"), F.size("g.m").alias("size"), F.col("g.m").alias("members"))


def with_group_ids(groups: DataFrame) -> DataFrame:
    """group_id: a number by (poi_idx, start_minute, end_minute, members), counted place by place.

    Places are few, so their sizes are summed in one small window; groups are numbered within their place.
    """
    per = groups.groupBy("poi_idx").agg(F.count("*").alias("__n"))
    before = per.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("poi_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rn = F.row_number().over(W.partitionBy("poi_idx").orderBy("start_minute", "end_minute", F.concat_ws("|", F.transform("members", lambda x: x.cast("string")))))
    return groups.withColumn("__rn", rn).join(before, "poi_idx").withColumn("group_id", F.col("__before") + F.col("__rn") - 1).drop("__rn", "__before")


def legacy_sessions(checkins: DataFrame, gap: int = 60, order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Single-linkage sessions of a place with two different users or more; members in the order of their first check-in."""
    rows = gap_sessions(checkins, gap, list(order))
    first = rows.groupBy("poi_idx", "session", "user_id").agg(F.min(F.struct("minute", *order)).alias("first"), F.max("minute").alias("last"), F.count("*").alias("n"))
    out = first.groupBy("poi_idx", "session").agg(F.min("first.minute").alias("start_minute"), F.max("last").alias("end_minute"), F.sum("n").alias("n_checkins"), F.array_sort(F.collect_list(F.struct("first", "user_id"))).alias("m"))
    return out.where(F.size("m") >= 2).select("poi_idx", "start_minute", "end_minute", "n_checkins", F.transform("m", lambda x: x["user_id"]).alias("members"))


def real_transitions(groups: DataFrame, horizon: int = 240, min_shared: int = 2, min_jaccard: float = 0.5) -> DataFrame:
    """Group to later group at another place that shares enough members, within the horizon (minutes from end to start).

    Groups are matched by member and time slice, so a pair of groups meets only if they share a member and time; only ids, times
    and sizes travel, and the shared members are the rows that met. Members are distinct.
    """
    left = groups.select(F.col("group_id").alias("from_group"), F.col("poi_idx").alias("from_poi"), F.col("end_minute").alias("__end"), F.size("members").alias("__n"), F.explode("members").alias("__u"))
    left = left.withColumn("__slice", F.explode(F.array(F.floor(F.col("__end") / horizon), F.floor(F.col("__end") / horizon) + 1)))
    right = groups.select(F.col("group_id").alias("to_group"), F.col("poi_idx").alias("to_poi"), F.col("start_minute").alias("__start"), F.size("members").alias("__m"), F.explode("members").alias("__u")).withColumn("__slice", F.floor(F.col("__start") / horizon))
    met = left.join(right, ["__u", "__slice"]).where((F.col("from_poi") != F.col("to_poi")) & (F.col("__start") > F.col("__end")) & (F.col("__start") - F.col("__end") <= horizon))
    # a pair's rows are its shared members, each once, as an end and a start within the horizon meet in one slice
    met = met.groupBy("from_group", "to_group", "from_poi", "to_poi", "__start", "__end", "__n", "__m").agg(F.array_sort(F.collect_list("__u")).alias("members")).withColumn("n_shared", F.size("members"))
    jaccard = F.col("n_shared") / (F.col("__n") + F.col("__m") - F.col("n_shared"))
    out = met.withColumn("jaccard", jaccard).where((F.col("n_shared") >= min_shared) & (F.col("jaccard") >= min_jaccard))
    return out.select("from_group", "to_group", "from_poi", "to_poi", (F.col("__start") - F.col("__end")).alias("gap_min"), "n_shared", F.round("jaccard", 4).alias("jaccard"), "members")


def venue_rarity(checkins: DataFrame) -> DataFrame:
    """(poi_idx, n_users, rarity): distinct visitors and 1 / ln(1 + visitors)."""
    return checkins.groupBy("poi_idx").agg(F.countDistinct("user_id").alias("n_users")).withColumn("rarity", 1 / F.log1p(F.col("n_users")))


def co_attended(groups: DataFrame, rarity: DataFrame) -> DataFrame:
    """(u1, u2, n_groups, n_venues, weight_idf): how often, at how many places, and at how rare ones two users met."""
    rare = groups.join(rarity.select("poi_idx", "rarity"), "poi_idx", "left")
    pairs = rare.select("poi_idx", F.coalesce("rarity", F.lit(1.0)).alias("rarity"), F.explode(C.pairs_within("members")).alias("p")).select("poi_idx", "rarity", "p.*")
    return pairs.groupBy("u1", "u2").agg(F.count("*").alias("n_groups"), F.countDistinct("poi_idx").alias("n_venues"), F.round(F.sum("rarity"), 6).alias("weight_idf"))


def tie_pool(ties: DataFrame, min_groups: int, min_venues: int) -> DataFrame:
    return ties.where((F.col("n_groups") >= min_groups) & (F.col("n_venues") >= min_venues))


def moved_together(transitions: DataFrame, rarity: DataFrame) -> DataFrame:
    """(u1, u2, n_transitions, weight_idf): shared moves, weighted by the mean rarity of both places."""
    r = rarity.select(F.col("poi_idx").alias("__p"), F.col("rarity").alias("__r"))
    t = transitions.join(r.withColumnsRenamed({"__p": "from_poi", "__r": "__from"}), "from_poi", "left").join(r.withColumnsRenamed({"__p": "to_poi", "__r": "__to"}), "to_poi", "left")
    w = (F.coalesce("__from", F.lit(1.0)) + F.coalesce("__to", F.lit(1.0))) / 2
    pairs = t.withColumn("__w", w).select("__w", F.explode(C.pairs_within("members")).alias("p"))
    return pairs.groupBy("p.u1", "p.u2").agg(F.count("*").alias("n_transitions"), F.round(F.sum("__w"), 6).alias("weight_idf"))


def span_report(groups: DataFrame) -> DataFrame:
    """Least, median, 95th percentile and largest span in minutes, and groups, by size."""
    span = groups.withColumn("span_min", (F.col("end_minute") - F.col("start_minute")).cast("double"))
    q = F.percentile("span_min", F.array(F.lit(0.5), F.lit(0.95)))
    out = span.groupBy("size").agg(F.count("*").alias("n_groups"), F.min("span_min").alias("min_span"), q.alias("q"), F.max("span_min").alias("max_span"))
    total = span.agg(F.count("*").alias("__all"))
    return out.join(F.broadcast(total)).select("size", "n_groups", "min_span", F.col("q")[0].alias("median_span"), F.col("q")[1].alias("p95_span"), "max_span", F.round(F.col("n_groups") / F.col("__all"), 6).alias("share"))


def feasibility(checkins: DataFrame, window: int, horizon: int = 240, max_size: int = 5, order: tuple[str, ...] = ("user_id", "event_id")) -> tuple[DataFrame, DataFrame]:
    """(events, transitions): the first time each set of users met at each place within the `window` minutes before, and moves
    of one exact set to another place within the horizon."""
    order = list(order)
    back = W.partitionBy("poi_idx").orderBy("minute").rangeBetween(-window, 0)
    seen = F.filter(F.collect_list(F.struct(F.col("__rn").alias("rn"), F.col("user_id").alias("u"))).over(back), lambda x: x["rn"] <= F.col("__rn"))
    rows = _numbered(checkins, order).withColumn("members", F.array_sort(F.array_distinct(F.transform(seen, lambda x: x["u"]))))
    sets = rows.where(F.size("members").between(2, max_size))
    events = sets.groupBy("poi_idx", "members").agg(F.min("minute").alias("minute"))
    w = W.partitionBy("members").orderBy("minute", "poi_idx")
    nxt = events.withColumns({"to_poi": F.lead("poi_idx").over(w), "to_minute": F.lead("minute").over(w)})
    moves = nxt.where((F.col("to_minute") > F.col("minute")) & (F.col("to_minute") - F.col("minute") <= horizon) & (F.col("to_poi") != F.col("poi_idx")))
    return events, moves


def feasibility_table(checkins: DataFrame, windows: list[int], **more: object) -> DataFrame:
    """One row a window: events, distinct pairs, groups, groups of three and more, transitions, and a verdict."""
    out = None
    for w in windows:
        events, moves = feasibility(checkins, w, **more)
        pairs = events.select(F.explode(C.pairs_within("members")).alias("p")).select("p.*").distinct().agg(F.count("*").alias("n_pairs"))
        counts = events.agg(F.count("*").alias("n_events"), F.countDistinct("members").alias("n_groups"), F.count_distinct(F.when(F.size("members") >= 3, F.col("members"))).alias("n_groups3"))
        row = counts.join(F.broadcast(pairs)).join(F.broadcast(moves.agg(F.count("*").alias("n_transitions")))).select(F.lit(w).alias("window_min"), "*")
        out = row if out is None else out.unionByName(row)
    verdict = F.when(F.col("n_transitions") >= 5000, "STRONG").when(F.col("n_transitions") >= 300, "USABLE").otherwise("SPARSE")
    return out.withColumn("verdict", verdict)


def best_window(table: DataFrame) -> DataFrame:
    """The row of the feasibility table with most transitions, the smallest window among equals."""
    best = F.max_by(F.struct(*table.columns), F.struct("n_transitions", -F.col("window_min")))
    return table.agg(best.alias("b")).where("b is not null").select("b.*")


def size_bucket(size: str = "size") -> Column:
    return F.when(F.col(size) <= 2, "pair").when(F.col(size) <= 4, "small_group").otherwise("large_group")
