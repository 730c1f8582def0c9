"""Queries that read the driver's tables as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailknit.operators.scratch import scratch_dir
from trailknit.plans import tables as T
from trailknit.streaming import sessions as S

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(T.sql(T.CHECKINS, "g AS (SELECT *, CASE WHEN minute - lag(minute) OVER (PARTITION BY poi_idx ORDER BY minute, event_id) > 60 THEN 1 ELSE 0 END AS opens FROM checkins)", "s AS (SELECT *, sum(opens) OVER (PARTITION BY poi_idx ORDER BY minute, event_id) AS session FROM g)", "f AS (SELECT poi_idx, min(minute) AS start_minute, max(minute) AS end_minute, count(*) AS n_checkins, count(DISTINCT user_id) AS n_users FROM s GROUP BY poi_idx, session)", select="SELECT * FROM f WHERE end_minute * 60 + 3601 <= (SELECT max(minute) * 60 FROM checkins) - 86400"))
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of places that are final when all of `events` has streamed by, with a day for late rows."""
    events = T.read(spark, sf_dir, "events")
    # a pattern, as a stream's path must not be one file
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir.rstrip('/')}/event[s].parquet")
    place = F.get_json_object("props", "$.k").cast("long")
    rows = stream.select(place.alias("poi_idx"), "user_id", F.col("ts").alias("utc_time"))
    folder = f"{scratch_dir(spark)}/sessions-{uuid.uuid4().hex}"
    S.run_to_table(S.stream_sessions(rows), f"{folder}/out", f"{folder}/state")
    out = spark.read.schema("poi_idx long, start_minute long, end_minute long, n_checkins long, users array<long>").parquet(f"{folder}/out")
    return out.select("poi_idx", "start_minute", "end_minute", "n_checkins", F.size("users").cast("long").alias("n_users"))
