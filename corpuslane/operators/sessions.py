"""Event logs: rollups, cursors, last events, completion and time windows, in batch form.

``events`` has (event_id, ts, user_id, event_type, value, props). A user's events are a run; rows without user or
time are left out of rollups; repeated rows count once where a row is one event (``distinct_events``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_events(events: DataFrame) -> DataFrame:
    return events.where("event_id is not null").select("event_id", "ts", "user_id", "event_type", "value", "props").distinct()


def manifest(events: DataFrame, failed: str = "error", terminal: str = "purchase") -> DataFrame:
    """A row a run: counts, kinds, summed value, first and last time, last kind and state."""
    e = events.where("user_id is not null and ts is not null")
    at = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == failed).alias("failures"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"),
        F.round(F.sum("value"), 4).alias("total_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("event_type", at).alias("last_kind"),
        F.max(F.when(F.col("event_type") == terminal, F.lit("complete")).otherwise("a_open")).alias("_s"),
    ).withColumn("state", F.when(F.col("_s") == "complete", "complete").otherwise("open")).drop("_s")


def last_matching(events: DataFrame, kind: str) -> DataFrame:
    """(user_id, event_id, value): each run's last event of a kind."""
    e = events.where((F.col("event_type") == kind) & F.col("user_id").isNotNull())
    best = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("l"))
    return best.select("user_id", "l.event_id", "l.value")


def after_last(events: DataFrame, kind: str) -> DataFrame:
    """(user_id, events): how many events of a run come after its last event of a kind."""
    ends = events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("_end"))
    return events.join(ends, "user_id").where(F.struct("ts", "event_id") > F.col("_end")).groupBy("user_id").agg(F.count("*").alias("events"))


def page(events: DataFrame, after: int, size: int) -> DataFrame:
    """The next ``size`` events behind a cursor, in order."""
    return events.where(F.col("event_id") > after).orderBy("event_id").limit(size)


def windows(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """(start, event_type, events, mean): tumbling windows, or sliding ones with ``slide``."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "events", "mean")


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """(user_id, start, events): runs of a user's events without a pause of ``gap_seconds`` or more."""
    w = F.session_window("ts", f"{gap_seconds} seconds")
    return events.where("user_id is not null").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


def props_totals(events: DataFrame) -> DataFrame:
    """(event_type, key, n, total): the numbers held by the JSON properties."""
    kv = events.select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return kv.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").try_cast("double")), 4).alias("total"))


def numbered(events: DataFrame) -> DataFrame:
    """``seq``: the run and the place of the event in it, five digits wide."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.where("user_id is not null").withColumn("seq", F.concat_ws("-", F.col("user_id").cast("string"), F.lpad(order.cast("string"), 5, "0")))
