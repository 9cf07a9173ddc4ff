"""Registered queries of the joins along an order: intervals, nearest neighbours and greedy choices, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, intervals, jumps
from .queries import _query


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: orders as ranges of part numbers that overlap one another; the customer is the range's rank
RANGES_SQL = "r AS (SELECT o_orderkey AS name, o_orderkey % 1900 AS lo, o_orderkey % 1900 + o_custkey % 41 AS hi, o_custkey * 1000000 + o_orderkey AS ord FROM orders)"


def _order_ranges(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 1900).alias("start"), (F.col("o_orderkey") % 1900 + F.col("o_custkey") % 41).alias("end"), (F.col("o_custkey") * 1000000 + F.col("o_orderkey")).alias("ord"))


@_query(f"""WITH {RANGES_SQL}, v AS (SELECT DISTINCT l_partkey FROM lineitem), f AS (SELECT l_partkey, min(ord) AS ord FROM v JOIN r ON l_partkey BETWEEN lo AND hi GROUP BY l_partkey)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(r.name, -1) AS first_range FROM lineitem l LEFT JOIN f ON l.l_partkey = f.l_partkey LEFT JOIN r ON r.ord = f.ord""")
def first_of_overlapping_ranges(spark, sf_dir):
    """Each line with the first of the many ranges that hold its part."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return intervals.first_range(lines, _order_ranges(spark, sf_dir), "l_partkey", "first_range", -1)


@_query(f"WITH {RANGES_SQL} SELECT p_partkey, count(*) AS n_ranges, min(name) AS least, max(name) AS greatest FROM part JOIN r ON p_partkey BETWEEN lo AND hi GROUP BY p_partkey")
def ranges_holding_parts(spark, sf_dir):
    """All ranges that hold a part, in bins of eight values with a test of what sticks out."""
    pairs = intervals.holding(_table(spark, sf_dir, "part").select("p_partkey"), _order_ranges(spark, sf_dir), "p_partkey", ("name",), width=8)
    return pairs.groupBy("p_partkey").agg(F.count("*").alias("n_ranges"), F.min("name").alias("least"), F.max("name").alias("greatest"))


#: signups and clicks before views as figures before questions
_EVENTS_SQL = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events)"


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@_query(f"""WITH {_EVENTS_SQL}, c AS (SELECT t, min(event_id) AS event_id FROM e WHERE event_type = 'click' GROUP BY t), v AS (SELECT * FROM e WHERE event_type = 'view'),
b AS (SELECT v.event_id, c.t AS low, c.event_id AS low_id FROM v ASOF LEFT JOIN c ON v.t >= c.t), a AS (SELECT v.event_id, c.t AS high, c.event_id AS high_id FROM v ASOF LEFT JOIN c ON v.t <= c.t)
SELECT event_id, CASE WHEN high IS NULL OR t - low <= high - t THEN low_id ELSE high_id END AS nearest_id, CASE WHEN high IS NULL OR t - low <= high - t THEN t - low ELSE high - t END AS distance FROM v JOIN b USING (event_id) JOIN a USING (event_id)""")
def nearest_click(spark, sf_dir):
    """Each view with the click nearest in time, at any distance."""
    e = _events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select(F.col("at").alias("spot"), F.col("event_id").alias("nearest_id"))
    found = asof.asof(e.where("event_type = 'view'").select("event_id", "at"), clicks, "at", "spot", columns=("nearest_id",))
    return found.select("event_id", "nearest_id", "distance")


@_query(f"""WITH {_EVENTS_SQL}, c AS (SELECT user_id, t, min(event_id) AS event_id FROM e WHERE event_type = 'click' GROUP BY ALL), v AS (SELECT * FROM e WHERE event_type = 'view')
SELECT v.event_id, v.user_id, c.event_id AS click_id, v.t - c.t AS distance FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.t > c.t""")
def click_before_view(spark, sf_dir):
    """Each view with its user's last click before it."""
    e = _events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select("user_id", F.col("at").alias("spot"), F.col("event_id").alias("click_id"))
    found = asof.asof(e.where("event_type = 'view'").select("event_id", "user_id", "at"), clicks, "at", "spot", ("user_id",), ("click_id",), direction="backward", exact=False)
    return found.select("event_id", "user_id", "click_id", "distance")


@_query("""WITH RECURSIVE v AS (SELECT DISTINCT l_orderkey % 2 AS page, l_orderkey AS y FROM lineitem), k AS (SELECT page, min(y) AS y FROM v GROUP BY page UNION ALL SELECT page, (SELECT min(v.y) FROM v WHERE v.page = k.page AND v.y >= k.y + 190) FROM k WHERE y IS NOT NULL)
SELECT page, y FROM k WHERE y IS NOT NULL""")
def thin_long_groups(spark, sf_dir):
    """All lines are boxes of two pages, so each group is as long as half the table."""
    boxes = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2).alias("page"), F.col("l_orderkey").alias("y"), F.lit(40).alias("h"))
    return jumps.thinned(boxes, ("page",))


@_query("""WITH RECURSIVE v AS (SELECT DISTINCT epoch_us(ts) // 1000000 AS t FROM events), k AS (SELECT min(t) AS t FROM v UNION ALL SELECT (SELECT min(v.t) FROM v WHERE v.t > k.t + 3600) FROM k WHERE t IS NOT NULL)
SELECT event_id, k.t AS start FROM (SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events) e ASOF LEFT JOIN (SELECT t FROM k WHERE t IS NOT NULL) k ON e.t >= k.t""")
def cluster_whole_table(spark, sf_dir):
    """All events as one group: a cluster lasts an hour from its first event."""
    e = _table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return jumps.clustered(e, (), "t", 3600).select("event_id", "start")
