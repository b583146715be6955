"""Streaming operators (SS), run over all rows present and written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from muster.plans.lineage import shared_dir
from muster.streaming import streams
from muster.suite.base import Tables, query


def _drained(t: Tables, make, name: str) -> DataFrame:
    """make(stream of a table) run until all rows present are read, and its sink as a table."""
    spark = t.spark
    root = f"{shared_dir(spark)}/muster/{name}-{uuid.uuid4().hex}"
    q = make().writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _stream(t: Tables, name: str) -> DataFrame:
    """Reads the table's files as they come; a table of one file is picked out of its folder."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.dir}/{name}.parquet*")


@query("SELECT DISTINCT id FROM comments WHERE ingested_at IS NOT NULL")
def ss1_first_wins(t: Tables) -> DataFrame:
    at = lambda: _stream(t, "comments").select("id", F.col("ingested_at").cast("timestamp").alias("at")).where("at IS NOT NULL")
    return _drained(t, lambda: streams.first_wins(at(), "id", "at", "3650 days"), "first").select("id")


@query("SELECT strftime(h, '%Y-%m-%dT%H:00:00Z') AS hour, n FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1) WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def ss2_hourly(t: Tables) -> DataFrame:
    at = lambda: _stream(t, "events").select(F.col("ts").cast("timestamp").alias("at"))
    out = _drained(t, lambda: streams.hourly(at(), "at", "1 hour"), "hourly")
    return out.select(F.date_format("hour", "yyyy-MM-dd'T'HH:00:00'Z'").alias("hour"), "n")


@query("SELECT a.event_id AS key_a, b.event_id AS key_b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.ts BETWEEN a.ts - INTERVAL 60 SECOND AND a.ts + INTERVAL 60 SECOND")
def ss3_timed_together(t: Tables) -> DataFrame:
    at = lambda: _stream(t, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    return _drained(t, lambda: streams.timed_together(at(), at(), "event_id", "at", "user_id"), "together")


@query()
def ss4_sessions(t: Tables) -> DataFrame:
    at = lambda: _stream(t, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return _drained(t, lambda: streams.sessions(at(), "user_id", "at"), "sessions")


@query()
def ss5_late_rows(t: Tables) -> DataFrame:
    """Hours given out under a watermark of a day; rows that come later than that are dropped."""
    at = lambda: _stream(t, "comments").select(F.col("posted_date").cast("timestamp").alias("at")).where("at IS NOT NULL")
    return _drained(t, lambda: streams.hourly(at(), "at", "1 day"), "late")
