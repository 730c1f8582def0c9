"""MinHash near-duplicates by tensored banding.

Two small collections of `side` sub-keys, each made of `width` minhashes, are combined in all pairs to side * side table
keys of 2 * width minhashes each: the minhashes computed are about the square root of those that as many
separate keys would take.

1. Texts with equal shingle sets form a class; only its smallest doc_id goes on.
2. Members of a table's bucket are linked to the bucket's smallest member; the connected clusters of these candidate
   links hold every pair that collides anywhere, and no pairs within a bucket are written.
3. Each cluster is verified on full sets, in blocks of bounded size: one block counts all intersections as a matrix
   product over the shingles that two members share, and returns a spanning forest of the links that hold, which has
   the same components as all of them. First every block is taken alone, with the cluster's smallest member
   added. What links to that member within its block is settled: settled members are in one component, so that
   only pairs of blocks with the members left over, if any, remain. A cluster of near copies thus costs in proportion to its size.
4. A cluster of many remaining block pairs (mostly texts of one template, chained by chance collisions) is first split
   without loss: two sets of the asked similarity share a shingle among the rarest few of each, so that
   the clusters of shared rare shingles hold all links.
5. Components of the verified links give each document the smallest doc_id that it reaches.

Edge cases: null or empty texts have an empty set and are linked with nothing; texts of fewer than five words have one
shingle; rows without a doc_id are kept and linked with nothing; repeated rows get equal answers; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trailknit.llm import common
from trailknit.llm.common import LOWER, TURN, U64, mix

WORDS = 5
WIDTH, MISS = 3, 5e-5
BLOCK_ROWS, BLOCK_SHINGLES = 160, 1 << 20
TILE = 2048
MOST_PAIRS = 64


def sides(percent: int) -> int:
    """How many sub-keys a collection needs."""
    return next(n for n in range(1, 1000) if 2 * (1 - (percent / 100) ** WIDTH) ** n <= MISS)


def shingle_sets(column: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, off = common.text_bytes(column)
    raw = LOWER[raw]
    start, end, first = common.words(raw, off)
    h, begin = common.shingles(common.span_hash(raw, start, end), first, k)
    for i in range(len(column)):
        yield np.unique(h[begin[i] : begin[i + 1]])


def _signatures(side: int):
    turn = common.stream(7, 2 * WIDTH * side) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in common.chunks(batch):
                n, s1, s2, keys = [], [], [], []
                for u in shingle_sets(batch.column("text").slice(a, z - a)):
                    n.append(len(u))
                    s1.append(int(mix(u).sum(dtype=U64)) - (1 << 63) if len(u) else 0)
                    s2.append(int(mix(u ^ TURN[9]).sum(dtype=U64)) - (1 << 63) if len(u) else 0)
                    low = np.full(len(turn), ~U64(0))
                    for at in range(0, len(u), 4096):
                        np.minimum(low, (turn[:, None] * u[None, at : at + 4096]).min(1), out=low)
                    sub = np.zeros(2 * side, U64)
                    for w in range(WIDTH):
                        sub += low.reshape(2 * side, WIDTH)[:, w] * TURN[w]
                    keys.append(mix(sub).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "keys"])

    return run


def _tables(side: int):
    pair = common.stream(8, side * side).reshape(side, side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (key, doc) for each pair of sub-keys."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sub = np.frombuffer(b"".join(part.column("keys").to_pylist()), U64).reshape(-1, 2 * side)
                key = mix(sub[:, :side, None] * TURN[10] + sub[:, None, side:] * TURN[11] + pair[None])
                doc = np.repeat(part.column("doc_id").to_numpy(), side * side)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(doc)], ["key", "doc"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingles): the shingle set of each text, as bytes."""
    for batch in batches:
        for a, z in common.chunks(batch):
            part = batch.slice(a, z - a)
            sets = [u.tobytes() for u in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, cluster, n_shingles, token) for each shingle of a set."""
    for batch in batches:
        for a, z in common.chunks(batch, "shingles"):
            part = batch.slice(a, z - a)
            sets = [np.frombuffer(x.as_py(), U64) for x in part.column("shingles")]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(u) for u in sets]))
            token = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("doc_id", "cluster", "n_shingles")), pa.array(token)], ["doc_id", "cluster", "n_shingles", "token"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of the sets' intersection sizes, by tiles of the elements that at least two sets have."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, inverse, count = np.unique(np.concatenate(sets) if sets else np.empty(0, U64), return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[inverse]
    use = shared[inverse]
    owner, column = owner[use], column[use]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((m, m), np.float32)
    for at in range(0, int(shared.sum()), TILE):
        a, z = np.searchsorted(column, (at, at + TILE))
        rows = np.unique(owner[a:z])
        tile = np.zeros((len(rows), min(TILE, int(shared.sum()) - at)), np.float32)
        tile[np.searchsorted(rows, owner[a:z]), column[a:z] - at] = 1
        total[np.ix_(rows, rows)] += tile @ tile.T
    return total


def forest(linked: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(root, v, w) for the edges of a spanning forest of a boolean adjacency matrix, from each component's first vertex, its root, on."""
    left = np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            v = queue.pop()
            new = np.flatnonzero(linked[v] & left)
            left[new] = False
            queue += new.tolist()
            yield from ((root, v, w) for w in new.tolist())


def _verified(percent: int):
    """(a, b, first): links of each group that have the components of all its links; first: reached from the group's first member."""

    def table(found: list[tuple[int, int, bool]]) -> pa.RecordBatch:
        a, b, first = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.bool_())], ["a", "b", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, bool]] = []
        for group in common.sorted_groups(batches, ["cluster", "lo", "hi"]):
            ids = group.column("doc_id").to_numpy()
            sets = [np.frombuffer(x.as_py(), U64) for x in group.column("shingles")]
            size = np.array([len(s) for s in sets], np.float64)
            both = intersections(sets).astype(np.float64)
            for root, i, j in forest(100 * both >= percent * (size[:, None] + size[None, :] - both)):
                found.append((int(ids[i]), int(ids[j]), root == 0))
            if len(found) > 50_000:
                yield table(found)
                found = []
        if found:
            yield table(found)

    return run


def _verify(sets: DataFrame, placed: DataFrame, percent: int, name: str) -> DataFrame:
    """The links within each group (cluster, lo, hi) of blocks.

    placed has doc_id, cluster, block, since, upto: a member's block meets the blocks from since to upto; a member without a
    block is in each of these.
    """
    held = sets.join(placed.select("doc_id", "cluster", "block", "since", "upto"), "doc_id")
    # least and greatest pass over null
    paired = held.withColumn("other", F.explode(F.sequence("since", "upto"))).select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "shingles")
    dealt = paired.repartition(common.partitions(sets.sparkSession), "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "doc_id")
    return common.cut(dealt.mapInArrow(_verified(percent), "a long, b long, first boolean").where("a <> b").distinct(), name)


def _blocks(where: F.Column) -> F.Column:
    """How many blocks the members of a cluster need for which the condition holds."""
    rows, size = F.count_if(where), F.coalesce(F.sum(F.when(where, F.col("n_shingles"))), F.lit(0))
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_SHINGLES)).cast("int")


def _rare(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """members (doc_id, n_shingles, cluster) in smaller clusters, those of shared rare shingles; members that share none are gone.

    Of a set's n shingles, in the order of their number of sets within the cluster, the last ceil(percent * n / 100) - 1
    are too few for a link: the sets of a link share one of the others. Shingles of one set alone are not looked at.
    """
    tokens = sets.join(members.select("doc_id", "cluster", "n_shingles"), "doc_id").mapInArrow(_tokens, "doc_id long, cluster long, n_shingles long, token long")
    counts = common.cut(tokens.groupBy("cluster", "token").agg(F.count("*").alias("n")).where("n > 1"), "neardup-counts")
    own = W.partitionBy("cluster", "doc_id")
    spare = F.count("*").over(own) + 1 - F.ceil(F.col("n_shingles") * percent / 100)
    ranked = tokens.join(counts, ["cluster", "token"]).select("cluster", "token", "doc_id", spare.alias("spare"), F.row_number().over(own.orderBy("n", "token")).alias("rank"))
    rare = common.cut(ranked.where("rank <= spare").select("cluster", "token", "doc_id"), "neardup-rare")
    centre = common.cut(rare.groupBy("cluster", "token").agg(F.min("doc_id").alias("a")), "neardup-rare-centres")
    stars = common.cut(rare.join(centre, ["cluster", "token"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b")), "neardup-rare-stars")
    parts = common.components(stars, "neardup-parts").select(F.col("v").alias("doc_id"), F.col("root").alias("cluster"))
    common.discard(counts, rare, centre, stars)
    return members.select("doc_id", "n_shingles").join(parts, "doc_id")


def _links(sets: DataFrame, members: DataFrame, percent: int, split: bool = True) -> DataFrame:
    """(a, b), tables in the shared folder: links between the members (doc_id, n_shingles, cluster) of a cluster that have the components of all its links.

    sets (doc_id, shingles) holds the members' sets, members is a table. cluster is the smallest doc_id of its members. split: clusters with more than MOST_PAIRS block pairs are taken apart first.
    """
    # a table of its own, so that Spark can split a hot cluster of the join
    blocks = common.cut(members.groupBy("cluster").agg(_blocks(F.lit(True)).alias("blocks")), "neardup-blocks")
    at, first = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.col("doc_id") == F.col("cluster")
    ends = {"block": F.lit(None).cast("int"), "since": F.when(first, 0).otherwise(at), "upto": F.when(first, F.col("blocks") - 1).otherwise(at)}
    placed = common.cut(members.join(blocks, "cluster").withColumns(ends), "neardup-placed")
    common.discard(blocks)
    near = _verify(sets, placed, percent, "neardup-near")
    links = near.select("a", "b")
    many = placed.where("blocks > 1")
    if many.isEmpty():
        return links
    settled = near.where("first").select(F.col("b").alias("doc_id")).distinct().withColumn("settled", F.lit(True))
    known = many.join(settled, "doc_id", "left").select("doc_id", "n_shingles", "cluster", (F.col("settled").isNotNull() | (F.col("doc_id") == F.col("cluster"))).alias("settled"))
    known = common.cut(known, "neardup-known")
    sizes = common.cut(known.groupBy("cluster").agg(_blocks(F.col("settled")).alias("ins"), _blocks(~F.col("settled")).alias("outs")).where("outs > 0"), "neardup-sizes")
    block = F.when(F.col("settled"), F.pmod(F.xxhash64("doc_id"), F.col("ins"))).otherwise(F.col("ins") + F.pmod(F.xxhash64("doc_id"), F.col("outs"))).cast("int")
    ends = {"block": block, "since": F.when(F.col("settled"), F.col("ins")).otherwise(F.lit(0)), "upto": F.col("ins") + F.col("outs") - 1}
    left = common.cut(known.join(sizes, "cluster").withColumns(ends), "neardup-left")
    common.discard(placed, known, sizes)
    large = F.lit(split) & (F.col("outs").cast("long") * (F.col("ins") + F.col("outs")) > MOST_PAIRS)
    links = links.union(_verify(sets, left.where(~large), percent, "neardup-crossed").select("a", "b"))
    apart = left.where(large)
    if split and not apart.isEmpty():
        parts = common.cut(_rare(sets, apart.select("doc_id", "n_shingles", "cluster"), percent), "neardup-apart")
        links = links.union(_links(sets, parts, percent, False))
    return links


def sets_of(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the members, as a table in the shared folder."""
    return common.cut(texts.join(members.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary"), "neardup-sets")


def cluster_links(texts: DataFrame, members: DataFrame, percent: int, split: bool = True) -> DataFrame:
    """_links(); texts (doc_id, text) are read once, for the members' sets, which all verification shares."""
    members = common.cut(members, "neardup-members")
    sets = sets_of(texts, members)
    links = common.cut(_links(sets, members, percent, split).distinct(), "neardup-links")
    common.discard(members, sets)
    return links


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; links have 100 * intersection >= percent * union."""
    spark, side = docs.sparkSession, sides(percent)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    sig = common.cut(texts.mapInArrow(_signatures(side), "doc_id long, n_shingles long, s1 long, s2 long, keys binary"), "neardup-signatures")
    linkable = sig.where("doc_id is not null and n_shingles > 0")
    classes = common.cut(linkable.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "neardup-classes")
    member = linkable.select("doc_id", "s1", "s2", "n_shingles").join(classes, ["s1", "s2", "n_shingles"]).select("doc_id", "s1", "s2", "n_shingles", "rep")
    reps = linkable.join(classes.select("s1", "s2", "n_shingles", F.col("rep").alias("doc_id")), ["s1", "s2", "n_shingles", "doc_id"]).select("doc_id", "n_shingles", "keys")
    table = reps.select("doc_id", "keys").mapInArrow(_tables(side), "key long, doc long")
    # a table of its own: a join of two plain shuffles is one whose hot partitions Spark can split
    shared = common.cut(table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "neardup-shared")
    entries = common.cut(table.join(shared, "key"), "neardup-buckets")
    centre = common.cut(entries.groupBy("key").agg(F.min("doc").alias("a")), "neardup-centres")
    stars = common.cut(entries.join(centre, "key").where("doc <> a").select("a", F.col("doc").alias("b")), "neardup-stars")
    common.discard(shared, entries, centre)
    clusters = common.components(stars, "neardup-clusters").select(F.col("v").alias("doc_id"), F.col("root").alias("cluster"))
    sized = clusters.join(reps.groupBy("doc_id").agg(F.min("n_shingles").alias("n_shingles")), "doc_id")
    found = cluster_links(texts, sized, percent)
    common.discard(stars)
    joined = common.components(found, "neardup-components")
    found = member.select("doc_id", "rep").dropDuplicates(["doc_id", "rep"]).join(joined, F.col("rep") == F.col("v"), "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    out = sig.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
