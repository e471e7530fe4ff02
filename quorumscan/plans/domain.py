"""The analysis' tables read out of a table of events, and the same as SQL.

A user is a character, four groups of users are the videos, a user's session is a track and
an error event a cut.  Times are seconds since the first day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumscan.operators.tracking import roll_up, sessionise

LENGTH, STEP, GAP, SHIFT = 21600.0, 3600.0, 21600.0, 1800.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("CAST(unix_micros(CAST(ts AS timestamp)) - unix_micros(CAST(timestamp_ntz'2024-01-01 00:00:00' AS timestamp)) AS double) / 1000000D")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", (F.col("user_id") % 4).cast("string").alias("video"), t.alias("t"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionise(events(spark, sf_dir), ["video", "user_id"], "t", GAP, "event_id")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roll_up(sessions(spark, sf_dir), ["video", "user_id", "track_no"], "t")
    return rows.select("video", (F.col("user_id") * 100000 + F.col("track_no")).alias("track_id"), F.col("user_id").alias("character_id"), "track_no", "start_time", "end_time", "num_detections")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("video").agg(F.max("t").alias("duration"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'error'").select("video", F.col("t").alias("cut"))


def micros(column: str):
    return F.round(F.col(column) * 1000000).cast("long")


#: The same as common table expressions.
SQL = """
    ev AS (
        SELECT event_id, user_id, event_type, value, props, CAST(user_id % 4 AS VARCHAR) AS video,
               CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS t
        FROM events
    ), flagged AS (
        SELECT *, CASE WHEN t - lag(t) OVER w > 21600 THEN 1 ELSE 0 END AS fresh FROM ev
        WINDOW w AS (PARTITION BY video, user_id ORDER BY t, event_id)
    ), sess AS (
        SELECT *, CAST(sum(fresh) OVER (PARTITION BY video, user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS track_no
        FROM flagged
    ), tracks AS (
        SELECT video, user_id * 100000 + track_no AS track_id, user_id AS character_id, track_no,
               min(t) AS start_time, max(t) AS end_time, count(*) AS num_detections
        FROM sess GROUP BY video, user_id, track_no
    ), videos AS (
        SELECT video, max(t) AS duration FROM ev GROUP BY video
    ), cuts AS (
        SELECT video, t AS cut FROM ev WHERE event_type = 'error'
    ), windows AS (
        SELECT video, k, CAST(k * 3600 AS DOUBLE) AS t
        FROM videos, LATERAL (SELECT unnest(range(0, CAST(floor(duration / 3600) AS BIGINT) + 1)) AS k)
        WHERE k * 3600 + 21600 <= duration + 1e-6
    ), scan AS (
        SELECT w.video, w.k, w.t, count(DISTINCT r.character_id) AS n
        FROM windows w LEFT JOIN tracks r ON r.video = w.video AND r.start_time < w.t + 21600 AND r.end_time >= w.t
        GROUP BY ALL
    )
"""
#: The threshold that the selection queries use, and a walk over the candidates.
THRESHOLD_SQL = "x AS (SELECT percentile_disc(0.75) WITHIN GROUP (ORDER BY n) AS x FROM scan)"
WALK_SQL = """
    succ AS (
        SELECT c.video, c.k, min(d.k) AS after FROM cand c LEFT JOIN cand d ON d.video = c.video AND d.k >= c.next_k GROUP BY ALL
    ), walk AS (
        SELECT video, min(k) AS k FROM cand GROUP BY video
        UNION ALL
        SELECT w.video, s.after FROM walk w JOIN succ s USING (video, k) WHERE s.after IS NOT NULL
    )
"""
