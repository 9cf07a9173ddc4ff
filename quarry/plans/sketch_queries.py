"""Registered queries of the sketches: what merged states say, held against exact counts within the sketches' bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches
from .queries import _query


@_query("SELECT l_returnflag, count(*) AS n, true AS distinct_within, true AS median_within FROM lineitem GROUP BY l_returnflag")
def sketched_lines(spark, sf_dir):
    """Suppliers and prices by flag and month, merged upward to flags; exact counts are read beside them for the bounds only."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("month"), "l_partkey", "l_extendedprice")
    states = sketches.sketched(lines, ("l_returnflag", "month"), "l_partkey", "l_extendedprice")
    found = sketches.told(sketches.merged(states, ("l_returnflag",)), ("l_returnflag",))
    exact = lines.groupBy(F.col("l_returnflag").alias("_flag")).agg(F.count_distinct("l_partkey").alias("_exact"))
    near = found.join(exact, F.col("l_returnflag").eqNullSafe(F.col("_flag"))).withColumn("_median", F.element_at("quantiles", 1))
    below = lines.join(F.broadcast(near.select(F.col("l_returnflag").alias("_f"), "_median")), F.col("l_returnflag").eqNullSafe(F.col("_f"))).groupBy("_f").agg(F.avg((F.col("l_extendedprice") <= F.col("_median")).cast("int")).alias("_rank"))
    out = near.join(below, F.col("l_returnflag").eqNullSafe(F.col("_f")))
    return out.select("l_returnflag", "n", (F.abs(F.col("n_distinct") - F.col("_exact")) <= 0.09 * F.col("_exact")).alias("distinct_within"), F.col("_rank").between(0.46, 0.54).alias("median_within"))


@_query("SELECT event_type, user_id, count(*) AS n, true AS never_too_few FROM events GROUP BY ALL")
def sketched_frequencies(spark, sf_dir):
    """How often each user stands in each kind of event: count-min states by day, merged upward."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.to_date(F.col("ts").cast("timestamp")).alias("day"), "user_id", "value")
    states = sketches.merged(sketches.sketched(e, ("event_type", "day"), "user_id", "value"), ("event_type",))
    exact = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return sketches.frequency(exact, states, ("event_type",), "user_id").select("event_type", "user_id", "n", (F.col("at_most") >= F.col("n")).alias("never_too_few"))
