"""The texts of individual examples: a user's profile, the friends' favourites, the last check-ins and the moment.

visits: user_id, pos (from 1), poi_idx, category, hour, utc_time, split. All that a text tells lies before its check-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailknit.operators import examples as X

# The wording of the texts.
HEAD = "You are a POI recommendation expert. Using the user's long-term profile and their recent check-ins, predict the next POI token.\n"
NEW_USER = "[user profile]\nnew user, no prior check-ins\n"
PROFILE = "[user profile]\ncheck-ins so far: %d\nmost visited: %s\nfavourite categories: %s\nusual hours: %s\n"
FRIENDS = "[friends]\n%d friends in the network\nfriends' favourite places: %s\n"
EXAMPLE = "[recent check-ins]\n%s\n[current time] %s %d:00\n[next POI] "
UNNAMED = "Venue"


def place(poi: str = "poi_idx", category: str = "category") -> Column:
    """A place as the texts begin to name it; what is told of it and a closing bracket follow."""
    return F.format_string("<poi_%d> (%s, ", F.col(poi), F.coalesce(category, F.lit(UNNAMED)))


def _listed(top: DataFrame, shown: Column, out: str) -> DataFrame:
    return top.groupBy("user_id", "pos").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("s")))).alias("l")).select("user_id", "pos", F.transform("l", lambda x: x["s"]).alias(out))


def profile_texts(visits: DataFrame, n_places: int = 5, n_categories: int = 3, n_hours: int = 3) -> DataFrame:
    """(user_id, pos, profile) of each position but a user's first: the commonest places, categories and hours before it, ties by first appearance."""
    v = visits.withColumns({"place": place(), "category": F.coalesce("category", F.lit(UNNAMED))})
    counted = F.concat("value", F.lit("x"), F.col("n").cast("string"), F.lit(")"))
    places = _listed(X.prefix_top(v, "place", n_places), counted, "places")
    categories = _listed(X.prefix_top(v, "category", n_categories), F.col("value"), "categories")
    hours = _listed(X.prefix_top(v, "hour", n_hours), F.col("value"), "hours")
    joined = places.join(categories, ["user_id", "pos"]).join(hours, ["user_id", "pos"])
    clock = F.array_join(F.transform(F.array_sort("hours"), lambda h: F.concat(h.cast("string"), F.lit(":00"))), ", ")
    return joined.select("user_id", "pos", F.format_string(PROFILE, F.col("pos") - 1, F.array_join("places", ", "), F.array_join("categories", ", "), clock).alias("profile"))


def friends_texts(friends: DataFrame, train: DataFrame, most_friends: int = 5, k: int = 5) -> DataFrame:
    """(user_id, friends) of the users whose friends have check-ins in train (poi_idx, category); friends: u1, u2."""
    both = friends.select(F.col("u1").alias("user_id"), F.col("u2").alias("f")).union(friends.select(F.col("u2"), F.col("u1"))).distinct()
    best = X.friend_favourites(friends, train, most_friends, k).join(train.groupBy("poi_idx").agg(F.min("category").alias("category")), "poi_idx")
    item = F.concat(place(), F.lit("x"), F.col("n").cast("string"), F.lit(")"))
    told = best.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("s")))).alias("l"))
    return told.join(both.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").select("user_id", F.format_string(FRIENDS, "n", F.array_join(F.transform("l", lambda x: x["s"]), ", ")).alias("friends"))


def example_texts(visits: DataFrame, which: str, friends: DataFrame | None = None, length: int = 15, profiles: bool = True) -> DataFrame:
    """(user_id, pos, text, target) of one split's check-ins that have any before them; friends as friends_texts gives them."""
    lines = visits.withColumn("line", F.concat(place(), F.col("hour").cast("string"), F.lit(":00)"))).withColumn("hist", X.recent(visits, "line", length))
    out = lines.where((F.col("split") == which) & (F.col("pos") > 1))
    parts = [F.lit(HEAD)]
    if profiles:
        out = out.join(profile_texts(visits), ["user_id", "pos"], "left")
        parts.append(F.coalesce("profile", F.lit(NEW_USER)))
    if friends is not None:
        out = out.join(friends, "user_id", "left")
        parts.append(F.coalesce("friends", F.lit("")))
    parts.append(F.format_string(EXAMPLE, F.array_join("hist", "\n"), F.date_format("utc_time", "EEEE"), "hour"))
    return out.select("user_id", "pos", F.concat(*parts).alias("text"), F.col("poi_idx").alias("target"))
