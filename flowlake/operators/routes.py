"""Transfer routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.columns import SCALE_PERIODS, in_window, instant, route_label

KEYS = ["source_chain", "dest_chain", "source_name", "dest_name"]


def _grouped(t: DataFrame) -> DataFrame:
    return t.groupBy(*KEYS).agg(F.count("*").alias("transfer_count"), F.sum("amount").alias("total_volume"), F.max("timestamp").alias("last_activity"))


def listed(grouped: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of routes with their count, volume and last activity."""
    volume = F.coalesce("total_volume", F.lit(0)).cast("decimal(28,2)").alias("total_volume")
    top = grouped.select(*KEYS, "transfer_count", volume, "last_activity").orderBy(F.desc("transfer_count"), *KEYS).limit(n)
    return top.withColumn("route", route_label())


def popular_routes(t: DataFrame, as_of, n: int = 50) -> DataFrame:
    """AGG14: routes with most transfers in 30 days."""
    return listed(_grouped(t.filter(in_window(F.col("timestamp"), as_of, "30d"))), n)


def top_routes(t: DataFrame, since, limit: int) -> DataFrame:
    """AGG15: routes with most transfers since an instant."""
    return listed(_grouped(t.filter(F.col("timestamp") > instant(since))), limit)


def popular_routes_by_scale(t: DataFrame, as_of, n: int = 10) -> DataFrame:
    """AGG15 for every time scale: one grouping, then the top of each scale."""
    counts = [F.count(F.when(in_window(F.col("timestamp"), as_of, p), 1)).alias(p) for p in SCALE_PERIODS]
    grouped = t.filter(in_window(F.col("timestamp"), as_of, "30d")).groupBy(*KEYS).agg(*counts)
    return by_scale_of(grouped, n)


def by_scale_of(grouped: DataFrame, n: int) -> DataFrame:
    """AGG15 of routes with the count of each time scale."""
    long = grouped.unpivot(KEYS, SCALE_PERIODS, "time_scale", "transfer_count").filter("transfer_count > 0")
    rank = F.row_number().over(Window.partitionBy("time_scale").orderBy(F.desc("transfer_count"), *KEYS))
    return long.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("route", route_label())
