"""Queries that run a stream over all rows of a table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.registry import Registry
from tidemark.streaming import events as E

registry = Registry()


@registry.add("stream_tumbling", "SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that a late row still changes for a day; then their state is dropped and later rows are left out."""
    made = E.tumbling(E.stream_table(spark, sf_dir, "events"), ["event_type"], "ts", "1 hour", "1 day")
    last = E.run_to_end(made, "update", lambda out: out.groupBy("event_type", "w").agg(F.max("n").alias("n")))
    return last.selectExpr("event_type", "CAST(w.start AS timestamp_ntz) AS window_start", "n")


@registry.add("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z5."""
    made = E.sessions(E.stream_table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours", "1 day")
    return E.run_to_end(made, "complete").selectExpr("user_id", "CAST(w.start AS timestamp_ntz) AS session_start", "n")


@registry.add("stream_state", "SELECT user_id AS key, count(*) AS n, max(epoch_us(ts)) AS last_us, arg_max(event_type, struct_pack(a := ts, b := event_type)) AS value FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user did last and how much, as a keyed state."""
    made = E.latest_state(E.stream_table(spark, sf_dir, "events"), "user_id", "ts", "event_type")
    return E.run_to_end(made, "update", lambda out: out.groupBy("key").agg(F.max_by(F.struct("n", "last_us", "value"), "n").alias("x")).select("key", "x.*"))
