"""Registered queries of the event-time windows and joins, as batches over whole tables; tests hold streams against the same functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import event_time
from .queries import _query


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"), "value")


@_query("""WITH s AS (SELECT epoch_us(ts) // 900000000 - k AS b, event_type, user_id FROM events, (SELECT unnest(range(4)) AS k))
SELECT event_type, b * 900 AS start_s, count(*) AS n, count(DISTINCT user_id) AS users FROM s GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    """Events and users of each hour, an hour every quarter."""
    found = event_time.sliding(_events(spark, sf_dir), "at", "1 hour", "15 minutes", ("event_type",), users=F.count_distinct("user_id"))
    return found.select("event_type", F.unix_seconds("start").alias("start_s"), "n", "users")


@_query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), m AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 7200000000, true)::INT AS new FROM e),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT user_id, min(t) AS start_us, max(t) + 7200000000 AS end_us, count(*) AS n FROM k GROUP BY user_id, session""")
def user_sessions(spark, sf_dir):
    """Each user's sessions: events less than two hours apart."""
    found = event_time.sessions(_events(spark, sf_dir), "at", "2 hours", ("user_id",))
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@_query("""WITH e AS (SELECT *, epoch_us(ts) AS t FROM events), v AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'view'), c AS (SELECT event_id AS click_id, user_id, t AS click_t FROM e WHERE event_type = 'click')
SELECT event_id, v.user_id, click_id FROM v LEFT JOIN c ON v.user_id = c.user_id AND click_t BETWEEN t - 600000000 AND t + 3600000000""")
def clicks_around_views(spark, sf_dir):
    """Each view with its user's clicks from ten minutes before to an hour after; views without any stay."""
    e = _events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("at").alias("click_at"))
    found = event_time.joined_within(e.where("event_type = 'view'").select("event_id", "user_id", "at"), clicks, ("user_id",), "at", "click_at", "10 minutes", "1 hour", "left_outer")
    return found.select("event_id", "user_id", "click_id")
