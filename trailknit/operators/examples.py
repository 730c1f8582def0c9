"""Next-venue examples: histories and profiles that look back only, companions, and the texts made of them.

'Before' is strict in two senses, both offered: by position in a user's sequence (prefix_*) and by minute (before_*).
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trailknit.operators import ordering as O
from trailknit.operators.scratch import cut

REASONS = ("no_companions", "constraint", "inactive", "short_history", "anchor_only")


def first_seen(checkins: DataFrame, category: str = "category") -> DataFrame:
    """(user_id, category, first_minute)."""
    return checkins.groupBy("user_id", category).agg(F.min("minute").alias("first_minute"))


def recent(split: DataFrame, value: str, length: int = 15) -> Column:
    """The up to `length` values before a check-in, oldest first."""
    return F.collect_list(value).over(W.partitionBy("user_id").orderBy("pos").rowsBetween(-length, -1))


def _fold_top(k: int):
    """Rows of a user's slice in the order of time: what was counted before it, then moments, each before the visits of its time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, top = None, {}, []
        for batch in batches:
            out: list[tuple] = []
            for user, part, t, kind, value, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (user, part) != at:
                    at, counts, top = (user, part), {}, []
                if kind == 1:
                    out += [(user, t, i + 1, key[3], -key[0]) for i, key in enumerate(top)]
                    continue
                before, since = counts.get(value, (0, first))
                counts[value] = (before + n, since)
                # counts only grow, so a value outside the list can enter it only when it is counted itself
                top = [key for key in top if key[3] != value]
                insort(top, (-(before + n), since, value is not None, value))
                del top[k:]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (batch.schema.field(0).type, batch.schema.field(2).type, pa.int32(), batch.schema.field(4).type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], ["user_id", "t", "rank", "value", "n"])

    return run


def _dealt(visits: DataFrame, moments: DataFrame, width: int) -> DataFrame:
    """Visits (user_id, t, value) and moments (user_id, t) in slices of `width`, in the order of time, each slice with what was counted before it.

    Rows are (user_id, part, t, kind, value, n, first): kind 0 what was counted before, 1 moments, 2 visits.
    """
    part = lambda t: F.floor(F.col(t) / width).cast("long")
    v = visits.select("user_id", F.col("t").cast("long").alias("t"), "value").groupBy("user_id", "t", "value").agg(F.count("*").alias("n")).withColumn("part", part("t"))
    m = moments.select("user_id", F.col("t").cast("long").alias("t")).distinct().withColumn("part", part("t"))
    wanted = m.select("user_id", "part").distinct()
    last = wanted.groupBy("user_id").agg(F.max("part").alias("last"))
    per = v.groupBy("user_id", "value", "part").agg(F.sum("n").alias("c"), F.min("t").alias("f"))
    w = W.partitionBy("user_id", "value").orderBy("part")
    run = per.select("user_id", "value", "part", F.sum("c").over(w).alias("n"), F.min("f").over(w).alias("first"), F.lead("part").over(w).alias("next")).join(last, "user_id").where("part < last")
    begins = run.select("user_id", "value", "n", "first", F.explode(F.sequence(F.col("part") + 1, F.least(F.coalesce("next", "last"), F.col("last")))).alias("part")).join(wanted, ["user_id", "part"], "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    kind = visits.schema["value"].dataType
    rows = begins.select("user_id", "part", none("long").alias("t"), F.lit(0).alias("kind"), "value", "n", "first")
    rows = rows.union(m.select("user_id", "part", "t", F.lit(1), none(kind), none("long"), none("long"))).union(v.join(wanted, ["user_id", "part"], "left_semi").select("user_id", "part", "t", F.lit(2), "value", "n", F.col("t")))
    return rows.repartition("user_id", "part").sortWithinPartitions("user_id", "part", F.col("t").asc_nulls_first(), "kind", "value")


def running_top(visits: DataFrame, moments: DataFrame, k: int, width: int) -> DataFrame:
    """(user_id, t, rank, value, n): the k commonest values of a user's visits (user_id, t, value) before each moment (user_id, t), t a whole number.

    Ties go by first appearance and then value. Time is cut into slices of `width`: running sums over slices give what each slice begins with, and
    a fold over a slice's own visits keeps the k best, so the work is the visits, the moments and a row for each slice and value of a
    user, never a user's moments times visits, and a long history is shared by many tasks.
    """
    schema = f"user_id {visits.schema['user_id'].dataType.simpleString()}, t long, rank int, value {visits.schema['value'].dataType.simpleString()}, n long"
    return _dealt(visits, moments, width).mapInArrow(_fold_top(k), schema)


def _fold_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, counts = None, {}
    for batch in batches:
        who, when, keys, numbers = [], [], [], []
        for user, part, t, kind, value, n, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (user, part) != at:
                at, counts = (user, part), {}
            if kind != 1:
                counts[value] = counts.get(value, 0) + n
            elif counts:
                who.append(user)
                when.append(t)
                keys.append(list(counts))
                numbers.append(list(counts.values()))
        kinds = (batch.schema.field(0).type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip((who, when, keys, numbers), kinds, strict=True)], ["user_id", "t", "keys", "counts"])


def running_counts(visits: DataFrame, moments: DataFrame, width: int) -> DataFrame:
    """(user_id, t, keys, counts): how often each value, an int, of a user's visits (user_id, t, value) came before each moment (user_id, t) with any before it.

    Slices of time as in running_top(); a moment is one row, whatever the number of values.
    """
    return _dealt(visits, moments, width).mapInArrow(_fold_counts, f"user_id {visits.schema['user_id'].dataType.simpleString()}, t long, keys array<int>, counts array<int>")


def prefix_top(split: DataFrame, value: str, k: int) -> DataFrame:
    """(user_id, pos, rank, value, n): the k commonest values before each position, ties by first appearance."""
    s = split.select("user_id", F.col("pos").alias("t"), F.col(value).alias("value"))
    return running_top(s, s, k, 1024).withColumnRenamed("t", "pos")


def before_counts(checkins: DataFrame, moments: DataFrame, value: str) -> DataFrame:
    """(user_id, minute, value, n, first): how often, and when first, each value was seen in earlier minutes than each moment (user_id, minute).

    Visits are summed a minute first; a moment meets one row for each value, the value's running count before it.
    """
    per = checkins.groupBy("user_id", F.col(value).alias("value"), "minute").agg(F.count("*").alias("c"))
    w = W.partitionBy("user_id", "value").orderBy("minute")
    run = per.withColumns({"n": F.sum("c").over(w), "next": F.lead("minute").over(w), "first": F.min("minute").over(W.partitionBy("user_id", "value"))})
    m = moments.select("user_id", F.col("minute").alias("t")).distinct()
    met = run.join(m, "user_id").where("t > minute and (next is null or t <= next)")
    return met.select("user_id", F.col("t").alias("minute"), "value", "n", "first")


def before_top(checkins: DataFrame, moments: DataFrame, value: str, k: int, width: int = 28 * 1440) -> DataFrame:
    """(user_id, minute, rank, value, n): the k commonest values in earlier minutes than each moment (user_id, minute); ties by first appearance."""
    c = checkins.select("user_id", F.col("minute").alias("t"), F.col(value).alias("value"))
    return running_top(c, moments.select("user_id", F.col("minute").alias("t")), k, width).withColumnRenamed("t", "minute")


def n_before(checkins: DataFrame, moments: DataFrame) -> DataFrame:
    """(user_id, minute, n): check-ins in earlier minutes; from running counts over the union of both, without a range join."""
    c = checkins.groupBy("user_id", "minute").agg(F.count("*").alias("c"))
    both = c.unionByName(moments.select("user_id", "minute").distinct().withColumn("c", F.lit(0).cast("long")))
    per = both.groupBy("user_id", "minute").agg(F.sum("c").alias("c"))
    run = per.withColumn("n", F.coalesce(F.sum("c").over(W.partitionBy("user_id").orderBy("minute").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return moments.select("user_id", "minute").distinct().join(run.select("user_id", "minute", "n"), ["user_id", "minute"])


def all_know(examples: DataFrame, seen: DataFrame, category: str = "category") -> DataFrame:
    """(example_id, all_know): whether every member has visited the category in an earlier minute. examples: example_id, members, category, minute."""
    m = examples.select("example_id", "minute", F.size("members").alias("k"), F.col(category).alias("__c"), F.explode("members").alias("user_id"))
    s = seen.select("user_id", F.col(category).alias("__c"), "first_minute")
    j = m.join(s, ["user_id", "__c"], "left")
    return j.groupBy("example_id").agg((F.count_if(F.col("first_minute") < F.col("minute")) == F.max("k")).alias("all_know"))


def joint_history(examples: DataFrame, checkins: DataFrame, length: int = 15) -> DataFrame:
    """(example_id, hist, hist_hours, hist_owner): the last `length` check-ins of all members in earlier minutes, oldest first.

    Check-ins are numbered in each user's history once; a member meets the last `length` numbers before the moment alone.
    """
    m = examples.select("example_id", "minute", F.explode("members").alias("user_id"))
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("minute", "event_id")).cast("long")
    c = checkins.select("user_id", "minute", "poi_idx", F.hour("utc_time").alias("hour"), seq.alias("seq"))
    upto = m.join(n_before(checkins, m), ["user_id", "minute"]).where("n > 0").drop("minute")
    near = upto.select("example_id", "user_id", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("n") - length + 1), F.col("n"))).alias("seq")).join(c, ["user_id", "seq"])
    order = F.array_sort(F.collect_list(F.struct("minute", "poi_idx", "hour", "user_id")))
    last = near.groupBy("example_id").agg(order.alias("h")).withColumn("h", F.slice("h", -F.least(F.size("h"), F.lit(length)), length))
    part = lambda k: F.transform("h", lambda x: x[k])
    return last.select("example_id", part("poi_idx").alias("hist"), part("hour").alias("hist_hours"), part("user_id").alias("hist_owner"))


def occasional(anchors: DataFrame, groups: DataFrame, rarity: DataFrame, max_visitors: int, least: int = 2, strict: bool = False) -> DataFrame:
    """(user_id, minute, group_id, members): groups with the user that began (strict: ended) in earlier minutes, at quiet places."""
    g = groups.join(rarity.where(F.col("n_users") <= max_visitors).select("poi_idx"), "poi_idx", "left_semi").where(F.col("size") >= least)
    g = g.select("group_id", "members", F.col("end_minute" if strict else "start_minute").alias("s"), F.explode("members").alias("user_id"))
    return anchors.select("user_id", "minute").distinct().join(g, "user_id").where("s < minute").select("user_id", "minute", "group_id", "members")


def heterogeneity(examples: DataFrame, profiles: DataFrame) -> DataFrame:
    """(example_id, heterogeneity): mean cosine distance of the members' profiles (user_id, [minute,] key, w); 0 with fewer than two profiles.

    With a minute, a member's profile is the one at the example's minute.
    """
    at = [c for c in ("user_id", "minute") if c in profiles.columns]
    m = examples.select("example_id", *at[1:], F.explode("members").alias("user_id"))
    has = m.join(profiles.select(*at).distinct(), at)
    k = has.groupBy("example_id").agg(F.count("*").alias("k"))
    sums = has.join(profiles, at).groupBy("example_id", "key").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    # the sum of all pairs' products is half of the squared sum less the sum of squares
    dots = sums.groupBy("example_id").agg((F.sum(F.col("s") * F.col("s") - F.col("q")) / 2).alias("dots"))
    out = examples.select("example_id").join(k, "example_id", "left").join(dots, "example_id", "left")
    n = F.col("k") * (F.col("k") - 1) / 2
    return out.select("example_id", F.when(F.coalesce("k", F.lit(0)) < 2, 0.0).otherwise(F.round(F.round(1 - F.col("dots") / n, 9), 4)).alias("heterogeneity"))


def profiles_before(checkins: DataFrame, moments: DataFrame, key: str) -> DataFrame:
    """(user_id, minute, key, w): counts in earlier minutes over their L2 norm, at each moment."""
    c = before_counts(checkins, moments, key)
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("user_id", "minute")))
    return c.select("user_id", "minute", F.col("value").alias("key"), (F.col("n") / norm).alias("w"))


def member_profiles(checkins: DataFrame, moments: DataFrame, n_places: int = 5, n_categories: int = 3, n_hours: int = 3) -> DataFrame:
    """(user_id, minute, n_seen, top_pois [(poi_idx, n)], top_cats, top_hrs): what a user did in earlier minutes, commonest first.

    checkins have category and hour. A user without earlier check-ins has 0 and empty lists.
    """
    m = moments.select("user_id", "minute").distinct()
    listed = lambda value, k, *what: before_top(checkins, m, value, k).groupBy("user_id", "minute").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("l"))
    pois = listed("poi_idx", n_places).select("user_id", "minute", F.transform("l", lambda x: F.struct(x["value"].alias("poi_idx"), x["n"].alias("n"))).alias("top_pois"))
    cats = listed("category", n_categories).select("user_id", "minute", F.transform("l", lambda x: x["value"]).alias("top_cats"))
    hours = listed("hour", n_hours).select("user_id", "minute", F.transform("l", lambda x: x["value"]).alias("top_hrs"))
    out = n_before(checkins, m).withColumnRenamed("n", "n_seen")
    for lists in (pois, cats, hours):
        name = lists.columns[-1]
        out = out.join(lists, ["user_id", "minute"], "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def individual_examples(split: DataFrame, which: str, length: int = 15) -> DataFrame:
    """(user_id, pos, hist, target, t_hour, t_dow) of the check-ins of one split with any history; history crosses splits."""
    rows = split.withColumns({"hist": recent(split, "poi_idx", length), "t_hour": F.hour("utc_time"), "t_dow": F.date_format("utc_time", "EEEE")})
    return rows.where((F.col("split") == which) & (F.size("hist") > 0)).select("user_id", "pos", "hist", F.col("poi_idx").alias("target"), "t_hour", "t_dow")


def individual_records(split: DataFrame, which: str, length: int = 15, n_places: int = 5, n_categories: int = 3, n_hours: int = 3) -> DataFrame:
    """individual_examples() with hist_hours and the profile before the position: n_seen, top_pois, top_cats, top_hrs (value, n).

    split has category and hour. Profiles count positions before the check-in, whatever their split, and never the check-in itself.
    """
    rows = split.withColumns({"hist": recent(split, "poi_idx", length), "hist_hours": recent(split, "hour", length)})
    rows = rows.where((F.col("split") == which) & (F.size("hist") > 0))
    asked = rows.select("user_id", F.col("pos").cast("long").alias("t"))
    out = rows.select("user_id", F.col("pos").cast("long").alias("pos"), "hist", "hist_hours", F.col("poi_idx").alias("target"), F.hour("utc_time").alias("t_hour"), F.date_format("utc_time", "EEEE").alias("t_dow"))
    first = split.groupBy("user_id").agg(F.min("pos").cast("long").alias("__first"))
    out = out.join(first, "user_id").withColumn("n_seen", F.col("pos") - F.col("__first")).drop("__first")
    for name, value, k in (("top_pois", "poi_idx", n_places), ("top_cats", "category", n_categories), ("top_hrs", "hour", n_hours)):
        visits = split.select("user_id", F.col("pos").cast("long").alias("t"), F.col(value).alias("value"))
        best = running_top(visits, asked, k, 1024).groupBy("user_id", F.col("t").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("l"))
        item = lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))
        out = out.join(best.select("user_id", "pos", F.transform("l", item).alias(name)), ["user_id", "pos"], "left")
    return out


def states(checkins: DataFrame, length: int = 15) -> DataFrame:
    """(user_id, at, n, last): for each minute that a user checks in at, how many check-ins came up to it, and the last `length` of them (minute, poi_idx, hour).

    What a member did before an example is what the member did up to one of these minutes, so examples share them.
    """
    w = W.partitionBy("user_id").orderBy("minute", "event_id")
    rows = checkins.select("user_id", "minute", F.row_number().over(w).cast("long").alias("n"), F.collect_list(F.struct("minute", "poi_idx", "hour")).over(w.rowsBetween(1 - length, 0)).alias("last"), F.lead("minute").over(w).alias("__next"))
    return rows.where("__next is null or __next > minute").select("user_id", F.col("minute").alias("at"), "n", "last")


def tested_offers(offers: DataFrame, checkins: DataFrame, constraint: bool = True, min_active: int = 5, min_history: int = 1, length: int = 15) -> DataFrame:
    """All offers, numbered (example_id), with the reason that ends them, and each member's last minute of a check-in before them (`ats`, beside members).

    Arguments are those of group_examples(). Members meet their check-ins in one pass over time, in which only counts and the ends of a history
    travel: a joint history is the anchor's alone if the anchor's last `length` all come after the other members' last ones.
    """
    kept = ["regime", "user_id", "pos", "minute", "poi_idx", "prefix", "utc_time", "split", "members"]
    a = cut(offers.select(F.monotonically_increasing_id().alias("example_id"), *kept), "offers")
    m = a.where("members is not null").select("example_id", "minute", F.col("prefix").alias("wanted"), F.posexplode("members").alias("place", "user_id"))
    end = lambda best: best(F.transform("last", lambda x: F.struct(x["minute"].alias("minute"), x["poi_idx"].alias("poi_idx"), x["hour"].alias("hour"), F.col("user_id").alias("user_id"))))
    s = states(checkins, length).select("user_id", F.col("at").alias("minute"), F.struct("at", "n", end(F.array_max).alias("top"), F.when(F.size("last") == length, end(F.array_min)).alias("low")).alias("state"))
    before = F.last("state", ignorenulls=True).over(W.partitionBy("user_id").orderBy("minute").rangeBetween(W.unboundedPreceding, -1))
    met = m.unionByName(s, allowMissingColumns=True).withColumn("state", before).where("example_id is not null")
    know = F.lit(True)
    if constraint:
        firsts = first_seen(checkins, "prefix").where("prefix is not null").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "first_minute"))).alias("firsts"))
        met = met.join(firsts, "user_id", "left")
        know = F.coalesce(F.try_element_at("firsts", F.col("wanted")) < F.col("minute"), F.lit(False))
    n = F.coalesce("state.n", F.lit(0))
    tried = met.groupBy("example_id").agg(
        F.min(n).alias("fewest"), F.bool_and(know).alias("all_know"), F.sum(F.least(n, F.lit(length))).alias("__hist"), F.count("*").alias("__k"),
        F.max(F.when(F.col("place") > 0, F.col("state.top"))).alias("__others"), F.max(F.when(F.col("place") == 0, F.col("state.low"))).alias("__low"),
        F.array_sort(F.collect_list(F.struct("place", "state.at"))).alias("ats"),
    )
    alone = (F.col("__k") > 1) & (F.col("__others").isNull() | F.coalesce(F.col("__others") < F.col("__low"), F.lit(False)))
    reason = F.when(F.col("members").isNull(), REASONS[0]).when(~F.col("all_know"), REASONS[1]).when(F.col("fewest") < min_active, REASONS[2]).when(F.col("__hist") < min_history, REASONS[3]).when(alone, REASONS[4]).otherwise("emitted")
    return cut(a.join(tried, "example_id", "left").select("example_id", *kept, F.transform("ats", lambda x: x["at"]).alias("ats"), reason.alias("reason")), "tested")


def _emitted_members(tested: DataFrame) -> DataFrame:
    """(example_id, place, user_id, at) of the examples, at null for a member without check-ins before."""
    each = tested.where("reason = 'emitted'").select("example_id", F.posexplode(F.arrays_zip("members", "ats")).alias("place", "m"))
    return each.select("example_id", "place", F.col("m.members").alias("user_id"), F.col("m.ats").alias("at"))


def _fold_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(example_id, apart): 1 less the mean product of all pairs of an example's rows (example_id, keys, counts), which come together."""
    rest: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        rows = pa.Table.from_batches([*rest, *([] if batch is None else [batch])]) if rest or batch is not None else None
        if rows is None or not rows.num_rows:
            continue
        ids = rows["example_id"].to_numpy()
        # the last example may go on in the next batch
        upto = len(ids) if batch is None else int(np.searchsorted(ids, ids[-1]))
        rest = rows.slice(upto).to_batches()
        if not upto:
            continue
        rows = rows.slice(0, upto).combine_chunks()
        names, of, k = np.unique(ids[:upto], return_inverse=True, return_counts=True)
        keys, counts = (rows[c].chunk(0) for c in ("keys", "counts"))
        row = np.repeat(np.arange(upto), keys.value_lengths().to_numpy())
        key, w = keys.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(float)
        w /= np.sqrt(np.bincount(row, w * w, upto))[row]
        code, width = of[row] * (key.max() + 1) + key, key.max() + 1
        if len(names) * width > 1 << 22:
            code, where = np.unique(code, return_inverse=True)
            total, owner = np.bincount(where, w), code // width
        else:
            total = np.bincount(code, w, len(names) * width)
            owner = np.repeat(np.arange(len(names)), width)
        # the sum of all pairs' products is half of the squared sum less the sum of squares
        dots = (np.bincount(owner, total * total, len(names)) - np.bincount(of[row], w * w, len(names))) / 2
        apart = np.where(k < 2, 0.0, 1 - dots / np.maximum(k * (k - 1) / 2, 1))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(apart)], ["example_id", "apart"])


def heterogeneous(tested: DataFrame, checkins: DataFrame, key: str = "prefix", width: int = 28 * 1440) -> DataFrame:
    """The examples among tested_offers() with their heterogeneity, as in heterogeneity(), by the members' profiles before them.

    A member is one row with packed counts, and each profile is worked out once for all examples that see it.
    """
    codes = O.numbered(checkins.select(F.col(key).alias("__c")).distinct(), [F.col("__c")], "value")
    visits = checkins.join(codes, F.col(key).eqNullSafe(F.col("__c"))).select("user_id", F.col("minute").alias("t"), F.col("value").cast("int").alias("value"))
    met = _emitted_members(tested).where("at is not null").select("example_id", "user_id", (F.col("at") + 1).alias("t"))
    profiles = running_counts(visits, met, width)
    rows = met.join(profiles, ["user_id", "t"]).select("example_id", "keys", "counts").repartition("example_id").sortWithinPartitions("example_id")
    apart = rows.mapInArrow(_fold_apart, "example_id long, apart double")
    return tested.where("reason = 'emitted'").join(apart, "example_id", "left").withColumn("heterogeneity", F.round(F.round(F.coalesce("apart", F.lit(0.0)), 9), 4)).drop("apart")


def group_examples(offers: DataFrame, checkins: DataFrame, constraint: bool = True, min_active: int = 5, min_history: int = 1, length: int = 15) -> tuple[DataFrame, DataFrame]:
    """(examples, tested): an example for each offer that passes all tests, and all offers with the reason that ends them.

    offers: regime, user_id, pos, minute, poi_idx, prefix (of the target's category), utc_time, split, members (anchor
    first; null without companions). checkins: event_id, user_id, poi_idx, minute, utc_time, hour, category, prefix. The
    tests stand in the order of REASONS and an offer counts for its first failing one: no companions; a member who
    hasn't been in the category (only with constraint); one with too few earlier check-ins; a short joint history; a
    history of the anchor alone. min_history is 1 or more. Tables are written between the steps.
    """
    tested = tested_offers(offers, checkins, constraint, min_active, min_history, length)
    return described(tested, checkins, length), tested


def described(tested: DataFrame, checkins: DataFrame, length: int = 15) -> DataFrame:
    """The examples among tested_offers(), named, with joint histories, profiles and heterogeneity."""
    good = heterogeneous(tested, checkins)
    s = states(checkins, length).drop("n")
    seen = member_profiles(checkins, s.select("user_id", (F.col("at") + 1).alias("minute"))).withColumn("at", F.col("minute") - 1).drop("minute")
    seen = cut(seen.join(s, ["user_id", "at"]), "seen")
    what = ["n_seen", "top_pois", "top_cats", "top_hrs"]
    none = [F.coalesce(c, (F.lit(0) if c == "n_seen" else F.array()).cast(seen.schema[c].dataType)).alias(c) for c in what]
    of = _emitted_members(tested).join(seen, ["user_id", "at"], "left").groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("place", "user_id", F.struct(*none).alias("profile"), "last"))).alias("all"))
    visits = F.flatten(F.transform("all", lambda m: F.transform(F.coalesce(m["last"], F.array().cast(seen.schema["last"].dataType)), lambda x: F.struct(x["minute"].alias("minute"), x["poi_idx"].alias("poi_idx"), x["hour"].alias("hour"), m["user_id"].alias("user_id")))))
    of = of.select("example_id", F.transform("all", lambda m: m["profile"]).alias("member_profiles"), F.array_sort(visits).alias("h")).withColumn("h", F.slice("h", -F.least(F.size("h"), F.lit(length)), length))
    part = lambda k, name: F.transform("h", lambda x: x[k]).alias(name)
    of = of.select("example_id", "member_profiles", part("poi_idx", "hist"), part("hour", "hist_hours"), part("user_id", "hist_owner"))
    # numbers run within each split, in the order of users, positions and regimes
    order = [F.col("split"), F.col("user_id"), F.col("pos"), F.col("regime")]
    n = O.numbered(tested.where("reason = 'emitted'").select("example_id", "split", "user_id", "pos", "regime"), order, "number")
    begin = n.groupBy("split").agg(F.min("number").alias("begin"))  # a row for each of three splits
    named = n.join(F.broadcast(begin), "split").select("example_id", F.format_string("%s_%07d", "split", F.col("number") - F.col("begin")).alias("name"))
    out = good.join(of, "example_id").join(named, "example_id")
    return out.select(F.col("name").alias("example_id"), F.col("user_id").alias("anchor"), "pos", "members", F.size("members").alias("size"), "regime", "hist", "hist_hours", "hist_owner", "member_profiles", F.col("poi_idx").alias("target"), F.hour("utc_time").alias("t_hour"), F.date_format("utc_time", "EEEE").alias("t_dow"), "heterogeneity", "split")


def funnel(tested: DataFrame) -> DataFrame:
    """(regime, n_offers, candidates, a column for each of REASONS, emitted)."""
    n = lambda r: F.count_if(F.col("reason") == r).alias(r)
    return tested.groupBy("regime").agg(F.count("*").alias("n_offers"), F.count_if(F.col("reason") != REASONS[0]).alias("candidates"), *[n(r) for r in (*REASONS, "emitted")])


def roster(examples: DataFrame) -> DataFrame:
    """(regime, members, size, anchors, n_examples, n_train, n_val, n_test, heterogeneity) of the groups that examples are built of."""
    e = examples.withColumn("members", F.array_sort("members"))
    part = lambda s: F.count_if(F.col("split") == s).alias(f"n_{s}")
    return e.groupBy("regime", "members").agg(F.max("size").alias("size"), F.array_sort(F.collect_set("anchor")).alias("anchors"), F.count("*").alias("n_examples"), part("train"), part("val"), part("test"), F.round(F.round(F.avg("heterogeneity"), 9), 4).alias("heterogeneity"))


def example_stats(examples: DataFrame) -> DataFrame:
    """(split, n, p25, p50, p75) of heterogeneity."""
    q = F.percentile("heterogeneity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return examples.groupBy("split").agg(F.count("*").alias("n"), q.alias("q")).select("split", "n", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"))


def prompt(hist: str = "hist", hour: str = "t_hour", dow: str = "t_dow") -> Column:
    """The text of an individual example."""
    past = F.array_join(F.transform(hist, lambda p: F.concat(F.lit("POI "), p.cast("string"))), ", ")
    return F.when(F.size(hist) == 0, F.concat(F.lit("A new user. It is "), F.col(dow), F.format_string(", %02d:00. Next venue:", hour))).otherwise(F.concat(F.lit("Visited: "), past, F.lit(". It is "), F.col(dow), F.format_string(", %02d:00. Next venue:", hour)))


def friend_favourites(friends: DataFrame, train: DataFrame, most_friends: int = 5, k: int = 5) -> DataFrame:
    """(user_id, rank, poi_idx, n): the commonest places of each user's first friends by number; ties by place."""
    both = friends.select(F.col("u1").alias("user_id"), F.col("u2").alias("f")).union(friends.select(F.col("u2"), F.col("u1")))
    first = both.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy("f"))).where(F.col("rn") <= most_friends).select("user_id", "f")
    counts = train.groupBy(F.col("user_id").alias("f"), "poi_idx").agg(F.count("*").alias("c"))
    n = first.join(counts, "f").groupBy("user_id", "poi_idx").agg(F.sum("c").alias("n"))
    rn = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "poi_idx"))
    return n.withColumn("rank", rn).where(F.col("rank") <= k).select("user_id", "rank", "poi_idx", "n")
