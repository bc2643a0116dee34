"""File streams over the events table; each result equals the batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import files as ST
from .registry import R, query, r, text


FILES = 4


def events_stream(t):
    """The events as a stream of several files, one per micro-batch."""
    folder = scratch_path(t.spark, "events")
    t.events.repartition(FILES).write.parquet(folder)
    return ST.table_stream(t.spark, folder, "part", t.events.schema)


@query("t01_chunked_filter", (), "SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def _(t):
    return ST.filter_chunks(events_stream(t), F.col("event_type") == "click").select("event_id", "user_id", "value")


@query("t02_chunk_callback", (), f"""
SELECT event_type, COUNT(*) AS n, {R('SUM(value)', 2)} AS total, 0 AS first_position, {FILES - 1} AS last_position FROM events WHERE value > 10 GROUP BY 1""")
def _(t):
    def keep_large(rows, number):
        return rows.where(F.col("value") > 10).withColumn("position", F.lit(number))

    d = ST.map_chunks(events_stream(t), keep_large)
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"),
                                     F.min("position").alias("first_position"), F.max("position").alias("last_position"))


@query("t03_daily_sums", (), f"SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, {R('SUM(value)', 2)} AS total, COUNT(*) AS n FROM events GROUP BY 1")
def _(t):
    # one row of state per day, so no row needs to be too late
    d = ST.run_updates(ST.daily_sums(events_stream(t), "ts", "value"), ["day"])
    return d.select(text("day").alias("day"), r("total", 2).alias("total"), "n")
