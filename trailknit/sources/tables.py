"""Readers and writers of the house tables: CSV splits, metadata with other column names, raw TSV, JSON lines, graphs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailknit.functions import columns as C

CHECKIN_SCHEMA = "user_id long, venue_id string, venue_category_id string, venue_category_name string, latitude double, longitude double, timezone_offset int, utc_time string, poi_idx long"
RAW_POIS = "venue_id string, latitude string, longitude string, venue_category_name string, country_code string"
RAW_CHECKINS = "user_id string, venue_id string, utc_time string, timezone_offset int"
RAW_FRIENDS = "u1 string, u2 string"
#: Names that a column goes by, in order of preference.
ALIASES = {
    "poi_idx": ("poi_idx", "poi", "idx"), "venue_id": ("venue_id", "venue", "fsq_id"), "category": ("category_path", "category", "categories", "cat"),
    "latitude": ("latitude", "lat"), "longitude": ("longitude", "lon", "lng"), "locality": ("locality", "city"), "region": ("region", "state"),
}


def read_splits(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """train, val and test files as one table with orig_split; rows without a readable time go; a missing file is an error."""
    out = None
    for name in ("train", "val", "test"):
        one = spark.read.schema(CHECKIN_SCHEMA).csv(f"{folder}/{name}_{dataset}.csv", header=True).withColumn("orig_split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    # texts without an offset are UTC; those with one are moved to it, whatever the session's zone is
    bare = F.expr("try_cast(utc_time as timestamp_ntz)")
    offset = F.to_utc_timestamp(F.try_to_timestamp("utc_time"), F.current_timezone()).cast("timestamp_ntz")
    has = F.regexp_like(F.trim("utc_time"), F.lit(r"(?i)\d(\s*[+-]\d{1,2}(:?\d{2})?|\s*z|\s*utc|\s*gmt)$")) & F.col("utc_time").contains(":")
    timed = out.withColumn("utc_time", F.when(has, offset).otherwise(bare)).where("utc_time is not null")
    return timed.withColumn("venue_id", F.coalesce("venue_id", F.col("poi_idx").cast("string"))).withColumn("minute", C.epoch_minute("utc_time"))


def read_one(spark: SparkSession, path: str, needed: tuple[str, ...]) -> DataFrame:
    df = spark.read.csv(path, header=True)
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no {missing}")
    return df


def sniffed(spark: SparkSession, path: str, among: str = ",\t;|") -> str:
    """The delimiter that a file's first line has most of, of those named; the first of them if it has none."""
    line = spark.read.text(path).limit(1).collect()
    return max(among, key=line[0][0].count) if line else among[0]


def read_metadata(spark: SparkSession, path: str, sep: str | None = None, unknown: str = C.UNKNOWN) -> DataFrame:
    """poi_idx, venue_id, category, locality, region, latitude, longitude, whatever the columns are called; no category is `unknown`.

    Without sep, the delimiter is the one that the first line has most of.
    """
    sep = sep or sniffed(spark, path)
    df = spark.read.csv(path, header=True, sep=sep)
    c = {k: C.first_present(df, names, F.lit(None).cast("string")) for k, names in ALIASES.items()}
    return df.select(c["poi_idx"].cast("long").alias("poi_idx"), F.coalesce(c["venue_id"], c["poi_idx"]).alias("venue_id"), F.coalesce(c["category"], F.lit(unknown)).alias("category"), c["locality"].alias("locality"), c["region"].alias("region"), c["latitude"].cast("double").alias("latitude"), c["longitude"].cast("double").alias("longitude"))


def scan_pois(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Raw venues in (south, north, west, east); of rows with one id, the first by coordinates."""
    raw = spark.read.schema(RAW_POIS).csv(path, sep="\t")
    p = raw.select("venue_id", F.expr("try_cast(latitude as double)").alias("latitude"), F.expr("try_cast(longitude as double)").alias("longitude"), "venue_category_name", "country_code")
    inside = p.where(F.col("latitude").between(box[0], box[1]) & F.col("longitude").between(box[2], box[3]))
    return inside.groupBy("venue_id").agg(F.min(F.struct("latitude", "longitude", "venue_category_name", "country_code")).alias("v")).select("venue_id", "v.*")


def scan_checkins(spark: SparkSession, path: str, venues: DataFrame) -> DataFrame:
    raw = spark.read.schema(RAW_CHECKINS).csv(path, sep="\t").join(venues.select("venue_id"), "venue_id", "left_semi")
    at = C.parse_social_time("utc_time")
    checked = F.when(at.isNull(), F.raise_error(F.concat(F.lit("unreadable time: "), F.coalesce("utc_time", F.lit("null")))).cast("timestamp")).otherwise(at)
    return raw.withColumn("utc_time", F.to_utc_timestamp(checked, F.current_timezone()).cast("timestamp_ntz"))


def scan_friendships(spark: SparkSession, path: str, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Edges of which both ends are users."""
    raw = spark.read.schema(RAW_FRIENDS).csv(path, sep="\t")
    u = users.select(F.col(key).cast("string").alias("u1")).distinct()
    return raw.join(u, "u1", "left_semi").join(u.withColumnRenamed("u1", "u2"), "u2", "left_semi").select("u1", "u2")


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays are written with '|' between their items."""
    flat = df.select(*[F.array_join(F.transform(f.name, lambda x: x.cast("string")), "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema])
    flat.write.mode("overwrite").csv(path, header=True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_groups(spark: SparkSession, path: str, empty: str = "group_id string, venue_id string, poi_idx string, span_min string, size string, start_time string, end_time string, members array<long>") -> DataFrame:
    """Groups as write_csv wrote them; no folder gives no groups, with the columns of `empty`."""
    if not exists(spark, path):
        return spark.createDataFrame([], empty)
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.withColumn("members", F.transform(F.split("members", "\\|"), lambda x: x.cast("long")))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One folder of JSON lines a split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_manifest(values: dict, spark: SparkSession, path: str) -> None:
    """One JSON object; numbers, truth values, lists and nested objects keep their types, anything else is written as text."""
    spark.createDataFrame([(json.dumps(values, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_graph(entities: DataFrame, relations: DataFrame, triples: DataFrame, path: str) -> None:
    for name, df in (("entities", entities), ("relations", relations), ("triples", triples)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("entities", "relations", "triples"))


def read_graphml(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """(h, rel, t) of a GraphML file's edges; `relation` is the name of the edge attribute that holds rel, which may be absent.

    Edges are read in parallel. Only the declarations of attributes, which are as many as attributes, come to the driver.
    """
    declared = "_id string, _for string, `_attr.name` string"
    keys = spark.read.schema(declared).option("rowTag", "key").format("xml").load(path)
    named = [r[0] for r in keys.where((F.col("_for").isin("edge", "all")) & (F.col("`_attr.name`") == relation)).select("_id").collect()]
    edges = spark.read.schema("_source string, _target string, data array<struct<_VALUE: string, _key: string>>").option("rowTag", "edge").format("xml").load(path)
    held = F.filter(F.coalesce("data", F.array().cast("array<struct<_VALUE: string, _key: string>>")), lambda d: d["_key"].isin(named))
    return edges.select(F.col("_source").alias("h"), F.get(held, 0)["_VALUE"].alias("rel"), F.col("_target").alias("t"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, relation: str = "relation") -> None:
    """GraphML of nodes (id, and text attributes) and edges (h, rel, t, and text attributes), as a folder of files.

    Every file is a valid document of its own with the same declarations, so tasks write in parallel and no file passes through one task;
    read_graphml reads the folder, other readers its files one after another. Null attributes are left out.
    """
    of_nodes, of_edges = [c for c in nodes.columns if c != "id"], [c for c in edges.columns if c not in ("h", "rel", "t")]
    keys = [("node", c) for c in of_nodes] + [("edge", relation)] + [("edge", c) for c in of_edges]
    named = {k: f"d{i}" for i, k in enumerate(keys)}
    text = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda kind, c, column: F.coalesce(F.concat(F.lit(f'<data key="{named[kind, c]}">'), text(column), F.lit("</data>")), F.lit(""))
    node = F.concat(F.lit('<node id="'), text("id"), F.lit('">'), *[data("node", c, c) for c in of_nodes], F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), text("h"), F.lit('" target="'), text("t"), F.lit('">'), data("edge", relation, "rel"), *[data("edge", c, c) for c in of_edges], F.lit("</edge>"))
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'<key id="{named[k]}" for="{k[0]}" attr.name="{k[1]}" attr.type="string"/>' for k in keys), '<graph edgedefault="directed">']

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": head})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])
        yield pa.RecordBatch.from_pydict({"value": ["</graph>", "</graphml>"]})

    nodes.select(node.alias("value")).union(edges.select(edge.alias("value"))).mapInArrow(document, "value string").write.mode("overwrite").text(path)


def read_graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """(h, t, key, attributes) of the edges, attributes by their declared names; key is the edge's id, if it has one."""
    keys = spark.read.schema("_id string, _for string, `_attr.name` string").option("rowTag", "key").format("xml").load(path)
    named = {r[0]: r[1] for r in keys.where(F.col("_for").isin("edge", "all")).select("_id", "`_attr.name`").distinct().collect()}
    kind = "array<struct<_VALUE: string, _key: string>>"
    rows = spark.read.schema(f"_source string, _target string, _id string, data {kind}").option("rowTag", "edge").format("xml").load(path)
    return rows.select(F.col("_source").alias("h"), F.col("_target").alias("t"), F.col("_id").alias("key"), _attributes(named).alias("attributes"))


def _attributes(named: dict[str, str]) -> F.Column:
    kind = "array<struct<_VALUE: string, _key: string>>"
    names = F.create_map(*[F.lit(x) for k in named.items() for x in k]) if named else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    held = F.filter(F.coalesce("data", F.array().cast(kind)), lambda d: F.map_contains_key(names, d["_key"]))
    return F.map_from_entries(F.transform(held, lambda d: F.struct(F.element_at(names, d["_key"]), d["_VALUE"])))


def read_graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, attributes) of the nodes, attributes by their declared names; declarations, as many as attributes, come to the driver."""
    keys = spark.read.schema("_id string, _for string, `_attr.name` string").option("rowTag", "key").format("xml").load(path)
    named = {r[0]: r[1] for r in keys.where(F.col("_for").isin("node", "all")).select("_id", "`_attr.name`").distinct().collect()}
    kind = "array<struct<_VALUE: string, _key: string>>"
    rows = spark.read.schema(f"_id string, data {kind}").option("rowTag", "node").format("xml").load(path)
    return rows.select(F.col("_id").alias("id"), _attributes(named).alias("attributes"))


def read_npy(spark: SparkSession, path: str, rows_a_task: int = 1 << 16) -> DataFrame:
    """(id, z) of a two-dimensional .npy file that the driver and all executors can open; each task maps its own rows only."""
    import numpy as np
    import pyarrow as pa

    shape = np.load(path, mmap_mode="r", allow_pickle=False).shape
    if len(shape) != 2:
        raise ValueError(f"{path} has {len(shape)} dimensions, not 2")

    def rows(batches):
        table = np.load(path, mmap_mode="r", allow_pickle=False)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            z = np.asarray(table[ids], np.float64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * shape[1]), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), flat], ["id", "z"])

    return spark.range(0, shape[0], 1, max(1, -(-shape[0] // rows_a_task))).mapInArrow(rows, "id long, z array<double>")


def read_embeddings(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """(id, z) from Parquet; with `rows`, any other number of rows is an error."""
    df = spark.read.parquet(path).select("id", F.col("z").cast("array<double>").alias("z"))
    if rows is not None and df.count() != rows:
        raise ValueError(f"{path} has not {rows} rows")
    return df
