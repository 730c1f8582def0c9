"""Sessions of a place as a stream: check-ins may come late, and a session is final once the watermark has passed its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailknit.functions import columns as C


def stream_sessions(checkins: DataFrame, gap: int = 60, late: str = "1 day", keys: tuple[str, ...] = ("poi_idx",)) -> DataFrame:
    """(keys, start_minute, end_minute, n_checkins, users) of the sessions of a stream of check-ins (keys, user_id, utc_time without zone).

    A session ends where more than `gap` whole minutes pass. Check-ins later than `late` behind the latest one seen may be
    dropped; all others count, in whatever order they come. Append mode gives each session once, when it is final; state is held for
    open sessions alone. On a table that isn't a stream it gives all sessions.
    """
    at = F.timestamp_seconds(C.epoch_minute("utc_time") * 60)
    rows = checkins.select(*keys, "user_id", at.alias("__at")).where("__at is not null").withWatermark("__at", late)
    # a window that ends a second after the gap still meets a check-in exactly that much later
    window = F.session_window("__at", f"{gap * 60 + 1} seconds")
    minute = lambda c: F.floor(F.unix_timestamp(c) / 60).cast("long")
    out = rows.groupBy(*keys, window.alias("w")).agg(F.min("__at").alias("a"), F.max("__at").alias("z"), F.count("*").alias("n_checkins"), F.array_sort(F.collect_set("user_id")).alias("users"))
    return out.select(*keys, minute("a").alias("start_minute"), minute("z").alias("end_minute"), "n_checkins", "users")


def run_to_table(sessions: DataFrame, path: str, checkpoint: str) -> None:
    """Appends the sessions that are final to Parquet, for all that has arrived; run again on the same checkpoint, it goes on from there."""
    query = sessions.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
