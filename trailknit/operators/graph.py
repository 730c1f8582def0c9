"""The knowledge graph: one builder a relation, each a DataFrame (h, h_type, rel, t, t_type, layer) of named nodes.

Node names are 'poi:3', 'cat:A>B', 'loc:X', 'reg:Y', 'user:7', 'group:5'. Graphs are unions of relations without loops and
repeats; numbers for nodes are given at the end, by layer and name, so that they don't depend on the order of rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trailknit.functions import columns as C
from trailknit.operators import ordering as O
from trailknit.operators import prepare as P
from trailknit.operators import scratch

LAYERS = ("taxonomy", "spatial", "near", "follow", "visit", "prefer", "friend", "group")
# Relations of behaviour between venues.
BEHAVIOURAL = ("CO_VISITED_WITH", "FOLLOWED_BY", "VISITED", "VISITED_AT_HOUR", "VISITED_ON")
#: The Earth's mean radius.
EARTH_KM = 6371.0088


def _node(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _edges(df: DataFrame, h: Column, h_type: str, rel: str, t: Column, t_type: str, layer: str) -> DataFrame:
    return df.select(h.alias("h"), F.lit(h_type).alias("h_type"), F.lit(rel).alias("rel"), t.alias("t"), F.lit(t_type).alias("t_type"), F.lit(LAYERS.index(layer)).alias("layer"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("t").alias("h"), F.col("t_type").alias("h_type"), "rel", F.col("h").alias("t"), F.col("h_type").alias("t_type"), "layer"))


def clean(edges: DataFrame) -> DataFrame:
    return edges.where("h <> t").dropDuplicates(["h", "rel", "t"])


def taxonomy(venues: DataFrame) -> DataFrame:
    """HAS_CATEGORY from venue to its whole path; SUBCATEGORY_OF from a path to the path above."""
    v = venues.withColumn("path", C.category_path("category")).withColumn("path", F.when(F.size("path") == 0, F.array(F.lit(C.UNKNOWN))).otherwise(F.col("path")))
    has = _edges(v, _node("poi", "poi_idx"), "poi", "HAS_CATEGORY", _node("cat", F.array_join("path", C.SEP)), "category", "taxonomy")
    steps = v.select("path").distinct().where(F.size("path") > 1).select("path", F.explode(F.sequence(F.lit(2), F.size("path"))).alias("d"))
    sub = _edges(steps, _node("cat", F.array_join(F.slice("path", 1, F.col("d")), C.SEP)), "category", "SUBCATEGORY_OF", _node("cat", F.array_join(F.slice("path", 1, F.col("d") - 1), C.SEP)), "category", "taxonomy")
    return clean(has.unionByName(sub))


def _named(c: str) -> Column:
    x = F.trim(c)
    return F.when((x != "") & (F.lower(x) != "nan"), x)


def spatial(venues: DataFrame) -> DataFrame:
    """LOCATED_IN from venue to locality and from locality to region; blank names and 'nan' make no edge."""
    v = venues.select("poi_idx", _named("locality").alias("loc"), _named("region").alias("reg"))
    a = _edges(v.where("loc is not null"), _node("poi", "poi_idx"), "poi", "LOCATED_IN", _node("loc", "loc"), "locality", "spatial")
    b = _edges(v.where("loc is not null and reg is not null"), _node("loc", "loc"), "locality", "LOCATED_IN", _node("reg", "reg"), "region", "spatial")
    return clean(a.unionByName(b))


def nearest(venues: DataFrame, k: int = 10, metric: str = "sinusoidal", cell: float = 0.1, most: int = 16) -> DataFrame:
    """(poi_idx, neighbour, distance): each venue's k nearest, ties by number.

    Venues meet in grid cells only: of the plane (cos(lat) * lon, lat), or of the unit sphere for 'haversine', where a chord
    tells the great circle and nothing wraps. Venues whose k-th neighbour is not yet nearer than the neighbouring cells reach
    go on with cells of twice the size, so every round joins each venue with 9 (27) cells and no round joins all with all
    unless one cell holds all. A round's result is a table, so no round runs twice.
    """
    v = venues.where(C.finite("latitude", "longitude")).select("poi_idx", F.radians(F.col("latitude").cast("double")).alias("phi"), F.radians(F.col("longitude").cast("double")).alias("lam"))
    if metric == "haversine":
        at, unit = [F.cos("phi") * F.cos("lam"), F.cos("phi") * F.sin("lam"), F.sin("phi")], cell * 3.141592653589793 / 180
    else:
        at, unit = [F.cos("phi") * F.degrees("lam"), F.degrees("phi")], cell
    v = v.select("poi_idx", "phi", "lam", F.array(*at).alias("p"))
    v = scratch.cut(v, "venues")
    n = v.count()
    k = min(k, max(0, n - 1))
    if metric == "haversine":
        half = lambda x: F.pow(F.sin(x / 2), 2)
        dist = 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), half(F.col("phi2") - F.col("phi")) + F.cos("phi") * F.cos("phi2") * half(F.col("lam2") - F.col("lam")))))
        reach = lambda d: 2 * EARTH_KM * math.asin(min(1.0, d / 2))
    else:
        dist = F.sqrt(F.pow(F.col("p2")[0] - F.col("p")[0], 2) + F.pow(F.col("p2")[1] - F.col("p")[1], 2))
        reach = float
    done, left = None, v
    for step in range(most):
        size = unit * 2**step
        key = lambda p: F.transform(p, lambda x: F.floor(x / size))  # noqa: E731, B023
        moves = [list(m) for m in itertools.product((-1, 0, 1), repeat=len(at))]
        near = F.explode(F.array(*[F.zip_with(key(F.col("p")), F.array(*[F.lit(x).cast("long") for x in m]), lambda a, b: a + b) for m in moves]))
        asked = left.select("*", near.alias("cell"))
        other = v.select(F.col("poi_idx").alias("neighbour"), F.col("phi").alias("phi2"), F.col("lam").alias("lam2"), F.col("p").alias("p2"), key(F.col("p")).alias("cell"))
        met = asked.join(other, "cell").where("poi_idx <> neighbour").withColumn("distance", dist)
        ranked = met.withColumn("rn", F.row_number().over(W.partitionBy("poi_idx").orderBy("distance", "neighbour"))).where(F.col("rn") <= k).select("poi_idx", "neighbour", "distance", "rn")
        ranked = scratch.cut(ranked, f"near-{step}")
        last = step == most - 1
        sure = ranked.where((F.col("rn") == k) & ((F.col("distance") < reach(size)) | F.lit(last))).select("poi_idx")
        part = ranked.join(sure, "poi_idx", "left_semi").drop("rn")
        done = part if done is None else done.union(part)
        if last or k == 0:
            break
        left = scratch.cut(left.join(sure, "poi_idx", "left_anti"), f"left-{step}")
        if left.isEmpty():
            break
    return done


def proximity(near: DataFrame) -> DataFrame:
    return clean(both_ways(_edges(near, _node("poi", "poi_idx"), "poi", "IS_NEAR_TO", _node("poi", "neighbour"), "poi", "near")))


def next_visits(train: DataFrame, tie: str = "event_id") -> DataFrame:
    """(a, b, n): how often users went from a to another place b next."""
    nxt = F.lead("poi_idx").over(W.partitionBy("user_id").orderBy("utc_time", tie))
    return train.select(F.col("poi_idx").alias("a"), nxt.alias("b")).where("b is not null and a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def followed_by(train: DataFrame, top: int | None = None) -> DataFrame:
    n = next_visits(train)
    n = n.orderBy(F.desc("n"), "a", "b").limit(top) if top else n
    return _edges(n, _node("poi", "a"), "poi", "FOLLOWED_BY", _node("poi", "b"), "poi", "follow")


def visits(train: DataFrame) -> DataFrame:
    """(user_id, poi_idx, count, first_ts, last_ts)."""
    return train.groupBy("user_id", "poi_idx").agg(F.count("*").alias("count"), F.min("utc_time").alias("first_ts"), F.max("utc_time").alias("last_ts"))


def visited(train: DataFrame) -> DataFrame:
    return _edges(train.select("user_id", "poi_idx").distinct(), _node("user", "user_id"), "user", "VISITED", _node("poi", "poi_idx"), "poi", "visit")


def taxonomy_mass(train: DataFrame, venues: DataFrame) -> DataFrame:
    """(user_id, node, depth, mass): visits below each category path."""
    t = train.select("user_id", "poi_idx").join(venues.select("poi_idx", C.category_path("category").alias("path")), "poi_idx")
    up = t.select("user_id", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth")).where("size(path) > 0")
    return up.groupBy("user_id", F.array_join(F.slice("path", 1, F.col("depth")), C.SEP).alias("node"), "depth").agg(F.count("*").alias("mass"))


def prefers_category(train: DataFrame, venues: DataFrame, tau: float = 0.4, max_branches: int = 2, max_depth: int = 8) -> DataFrame:
    """(user_id, node, depth, support): down from up to max_branches roots, at each step into the heaviest child with tau of all visits.

    The heaviest root needs no share, further ones tau; every node on the way is a row. Ties go to the first name.
    """
    mass = taxonomy_mass(train, venues)
    total = train.join(venues.select("poi_idx"), "poi_idx", "left_semi").groupBy("user_id").agg(F.count("*").alias("total"))
    mass = mass.join(total, "user_id").withColumn("parent", F.regexp_replace("node", ">[^>]*$", ""))
    best = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("mass"), "node"))
    roots = mass.where("depth = 1").withColumn("rn", best).where((F.col("rn") == 1) | (F.col("rn") <= max_branches) & (F.col("mass") >= tau * F.col("total")))
    level = roots.select("user_id", "node", "depth", "mass", "total")
    deepest = min(max_depth, mass.agg(F.max("depth")).first()[0] or 0)
    out = level
    for d in range(2, deepest + 1):
        child = mass.where(F.col("depth") == d).join(level.select("user_id", F.col("node").alias("parent")), ["user_id", "parent"]).where(F.col("mass") >= tau * F.col("total"))
        first = F.row_number().over(W.partitionBy("user_id", "parent").orderBy(F.desc("mass"), "node"))
        level = child.withColumn("rn", first).where("rn = 1").select("user_id", "node", "depth", "mass", "total")
        out = out.union(level)
    return out.select("user_id", "node", "depth", F.round(F.col("mass") / F.col("total"), 4).alias("support"))


def preferences(rows: DataFrame) -> DataFrame:
    return _edges(rows, _node("user", "user_id"), "user", "PREFERS_CATEGORY", _node("cat", "node"), "category", "prefer")


def friendships(pairs: DataFrame) -> DataFrame:
    return both_ways(_edges(pairs, _node("user", "u1"), "user", "FRIEND_OF", _node("user", "u2"), "user", "friend"))


def group_layer(groups: DataFrame, ties: DataFrame, venues: DataFrame) -> DataFrame:
    """OCCURRED_AT, GROUP_PREFERS (the venue's path less its last level), MEMBER_OF, and CO_ATTENDED both ways."""
    at = _edges(groups, _node("group", "group_id"), "group", "OCCURRED_AT", _node("poi", "poi_idx"), "poi", "group")
    path = F.when(F.size("path") > 1, F.array_join(F.slice("path", 1, F.size("path") - 1), C.SEP)).otherwise(F.array_join("path", C.SEP))
    g = groups.select("group_id", "poi_idx").join(venues.select("poi_idx", C.category_path("category").alias("path")), "poi_idx").where("size(path) > 0")
    likes = _edges(g, _node("group", "group_id"), "group", "GROUP_PREFERS", _node("cat", path), "category", "group")
    of = _edges(groups.select("group_id", F.explode("members").alias("u")), _node("user", "u"), "user", "MEMBER_OF", _node("group", "group_id"), "group", "group")
    met = both_ways(_edges(ties, _node("user", "u1"), "user", "CO_ATTENDED", _node("user", "u2"), "user", "group"))
    return at.unionByName(likes).unionByName(of).unionByName(met)


def build(venues: DataFrame, train: DataFrame, groups: DataFrame | None = None, ties: DataFrame | None = None, friends: DataFrame | None = None, knn: int = 10, max_followed: int | None = None) -> DataFrame:
    """The whole graph. Without coordinates there is no proximity, without groups no group layer, without friends no FRIEND_OF.

    Relations of behaviour come from training data alone: of check-ins with a column `split`, only those of 'train' count.
    """
    if "split" in train.columns:
        train = train.where("split = 'train'")
    parts = [taxonomy(venues), spatial(venues), followed_by(train, max_followed), visited(train), preferences(prefers_category(train, venues))]
    if not venues.where(C.finite("latitude", "longitude")).isEmpty():
        parts.append(proximity(nearest(venues, knn)))
    if friends is not None:
        parts.append(friendships(friends))
    if groups is not None and ties is not None:
        parts.append(group_layer(groups, ties, venues))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return clean(out)


def counts(edges: DataFrame) -> DataFrame:
    """(kind, name, n): triples by relation and nodes by type."""
    nodes = edges.select(F.col("h").alias("n"), F.col("h_type").alias("t")).union(edges.select("t", "t_type")).distinct()
    return edges.groupBy("rel").agg(F.count("*").alias("n")).select(F.lit("relation").alias("kind"), F.col("rel").alias("name"), "n").union(nodes.groupBy("t").agg(F.count("*").alias("n")).select(F.lit("node"), F.col("t"), "n"))


def hierarchy(edges: DataFrame) -> DataFrame:
    """(parent, child, rel): the graph's parent-child pairs."""
    return edges.where(F.col("rel").isin("HAS_CATEGORY", "SUBCATEGORY_OF", "LOCATED_IN", "PREFERS_CATEGORY", "GROUP_PREFERS")).select(F.col("t").alias("parent"), F.col("h").alias("child"), "rel")


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities (id, name, type), relations (id, name, count), triples (h, r, t)); ids by first layer and name."""
    nodes = edges.select(F.col("h").alias("name"), F.col("h_type").alias("type"), "layer").union(edges.select("t", "t_type", "layer")).groupBy("name").agg(F.min("type").alias("type"), F.min("layer").alias("layer"))
    entities = O.numbered(nodes, [F.col("layer"), F.col("name")], "id").select("id", "name", "type")
    rels = edges.groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("count"), F.min("layer").alias("layer"))
    relations = rels.withColumn("id", F.row_number().over(W.orderBy("layer", "name")) - 1).select("id", "name", "count")
    triples = edges.join(entities.select(F.col("id").alias("hi"), F.col("name").alias("h")), "h").join(entities.select(F.col("id").alias("ti"), F.col("name").alias("t")), "t").join(F.broadcast(relations.select(F.col("id").alias("r"), F.col("name").alias("rel"))), "rel")
    return entities, relations, triples.select(F.col("hi").alias("h"), "r", F.col("ti").alias("t"))


# ---------------------------------------------------------------- venue-to-venue triples


def venue_edges(edges: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(a, rel, b): edges between two venues, without loops, repeats and excluded relations."""
    e = edges.select(C.poi_of_node("h").alias("a"), "rel", C.poi_of_node("t").alias("b")).where("a is not null and b is not null and a <> b")
    return e.where(~F.col("rel").isin(*exclude)).distinct() if exclude else e.distinct()


def attributed_venue_edges(nodes: DataFrame, edges: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """venue_edges() of a graph with attributes: nodes (id, attributes), edges (h, t, key, attributes), attributes being maps of texts."""
    at = nodes.select("id", C.poi_of("id", "attributes").alias("poi")).where("poi is not null")
    e = edges.select("h", "t", C.relation_of("attributes", "key").alias("rel")).join(at.select(F.col("id").alias("h"), F.col("poi").alias("a")), "h").join(at.select(F.col("id").alias("t"), F.col("poi").alias("b")), "t")
    e = e.where("a <> b").select("a", "rel", "b")
    return e.where(~F.col("rel").isin(*exclude)).distinct() if exclude else e.distinct()


def taxonomy_siblings(venues: DataFrame, levels: tuple[int, ...] = (2,), partners: int = 8, seed: int = 42) -> DataFrame:
    """(a, rel, b): for each venue, up to `partners` of the venues that share its first k levels, by least hash: SAME_TAXONOMY_L{k}.

    The sample is the operator. Each prefix's venues are sorted once by hash, and a venue takes the `partners` that follow it in
    the circle, so no pairs of a large prefix are formed.
    """
    out = None
    v = venues.select("poi_idx", C.category_path("category").alias("path"))
    for k in levels:
        p = v.where(F.size("path") >= k).withColumn("prefix", C.prefix(F.col("path"), k))
        w = W.partitionBy("prefix").orderBy(C.order_key(seed, "poi_idx"), "poi_idx")
        p = p.withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(W.partitionBy("prefix"))})
        steps = p.select("prefix", "poi_idx", F.explode(F.sequence(F.lit(1), F.least(F.lit(partners), F.col("n") - 1))).alias("s"), "rn", "n").where("n > 1").withColumn("to", F.pmod(F.col("rn") - 1 + F.col("s"), F.col("n")) + 1)
        q = p.select("prefix", F.col("rn").alias("to"), F.col("poi_idx").alias("b"))
        one = steps.join(q, ["prefix", "to"]).select(F.col("poi_idx").alias("a"), F.lit(f"SAME_TAXONOMY_L{k}").alias("rel"), "b")
        out = one if out is None else out.union(one)
    return out


def capped(edges: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """Each relation's `most` edges of the least hash; edges are numbered range by range, so that no task sees a whole relation."""
    at = O.numbered(edges.withColumn("__key", C.order_key(seed, "a", "rel", "b")), [F.col(c) for c in ("rel", "__key", "a", "b")], "__at")
    begin = at.groupBy("rel").agg(F.min("__at").alias("__begin"))  # a row a relation
    return at.join(F.broadcast(begin), "rel").where(F.col("__at") - F.col("__begin") < most).select(*edges.columns)


def venue_triples(edges: DataFrame, venues: DataFrame, derive: tuple[int, ...] = (2,), most: int = 40_000, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(a, rel, rel_id, b), relations numbered by name."""
    e = capped(venue_edges(edges, exclude).union(taxonomy_siblings(venues, derive)), most)
    ids = e.select("rel").distinct().withColumn("rel_id", F.row_number().over(W.orderBy("rel")) - 1)
    return e.join(F.broadcast(ids), "rel").select("a", "rel", "rel_id", "b")


def behavioural(edges: DataFrame) -> DataFrame:
    """(rel, n): the relations of behaviour among the edges (a, rel, b), which must be built from training data alone."""
    return edges.where(F.col("rel").isin(*BEHAVIOURAL)).groupBy("rel").agg(F.count("*").alias("n"))


def broken_rules(groups: DataFrame, ties: DataFrame, old: DataFrame, new: DataFrame, sizes: tuple[int, int] = (2, 8), span: int = 60) -> dict[str, DataFrame]:
    """By audit, the rows that break its rule."""
    return {
        "group_size": groups.where(~F.size("members").between(*sizes)),
        "group_span": groups.where((F.col("end_minute") - F.col("start_minute") > span) | (F.col("end_minute") < F.col("start_minute"))),
        "leaked_friends": P.leaked_pairs(new, old),
        "tie_order": ties.where("u1 >= u2"),
    }


# ---------------------------------------------------------------- the older graph with attributes


def co_attended_edges(groups: DataFrame) -> DataFrame:
    """(u1, u2, count, group_ids): with the sorted ids of the groups in which both were."""
    p = groups.select("group_id", F.explode(C.pairs_within("members")).alias("p"))
    return p.groupBy("p.u1", "p.u2").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("group_id")).alias("group_ids"))


def exported(groups: DataFrame, train: DataFrame, bucket: Column) -> DataFrame:
    """(head, relation, tail, attributes): the attributed graph as flat rows, lists written with commas."""
    v = visits(train).select(_node("user", "user_id").alias("head"), F.lit("VISITED").alias("relation"), _node("poi", "poi_idx").alias("tail"), F.concat(F.lit("count="), F.col("count").cast("string")).alias("attributes"))
    c = co_attended_edges(groups).select(_node("user", "u1"), F.lit("CO_ATTENDED"), _node("user", "u2"), F.concat(F.lit("group_ids="), F.array_join(F.transform("group_ids", lambda x: x.cast("string")), ",")))
    s = groups.select(_node("group", "group_id"), F.lit("HAS_SIZE"), F.concat(F.lit("size:"), bucket), F.lit(""))
    m = groups.select(_node("group", "group_id").alias("g"), F.explode("members").alias("u")).select(_node("user", "u"), F.lit("MEMBER_OF"), "g", F.lit(""))
    return v.union(c).union(s).union(m)


def ego(edges: DataFrame, node: str) -> DataFrame:
    """The edges out of and into a node."""
    return edges.where((F.col("h") == node) | (F.col("t") == node)).select("h", "rel", "t")
