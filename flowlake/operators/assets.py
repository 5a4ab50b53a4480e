"""Asset volumes and their routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.columns import asset_key, in_window, instant, route_label


def _sum(column: str = "amount") -> F.Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("decimal(28,2)")


def asset_volumes(t: DataFrame, as_of, n: int = 50) -> DataFrame:
    """AGG11: count, sum, largest and mean amount per asset in 30 days, most transfers first."""
    keyed = t.filter(in_window(F.col("timestamp"), as_of, "30d")).withColumn("asset_symbol", asset_key()).filter("asset_symbol IS NOT NULL")
    grouped = keyed.groupBy("asset_symbol").agg(
        F.count("*").alias("transfer_count"), F.sum("amount").alias("total_volume"), F.max("amount").alias("largest"),
        F.count("amount").alias("amounts"), F.max("timestamp").alias("last_activity"))
    return listed(grouped, n)


def listed(grouped: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of assets with their count, volume, largest amount, number of amounts and last activity."""
    money = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(28,2)")
    mean = F.when(F.col("amounts") > 0, F.col("total_volume").cast("double") / F.col("amounts")).otherwise(0.0)
    rows = grouped.select(
        "asset_symbol", "transfer_count", money("total_volume").alias("total_volume"), money("largest").alias("largest_transfer"),
        F.round(mean, 6).alias("average_amount"), "last_activity")
    return rows.orderBy(F.desc("transfer_count"), "asset_symbol").limit(n)


def asset_top_routes(t: DataFrame, as_of, n: int = 5) -> DataFrame:
    """AGG12: the first ``n`` routes of every asset; ``percentage`` is of the asset's listed volume."""
    keys = ["asset", "source_chain", "dest_chain", "source_name", "dest_name"]
    keyed = t.filter(in_window(F.col("timestamp"), as_of, "30d")).withColumn("asset", asset_key()).filter("asset IS NOT NULL")
    return top_routes_of(keyed.groupBy(*keys).agg(F.count("*").alias("count"), _sum().alias("volume"), F.max("timestamp").alias("last_activity")), n)


def top_routes_of(grouped: DataFrame, n: int = 5) -> DataFrame:
    """AGG12 of assets and routes with their count, volume and last activity."""
    keys = ["asset", "source_chain", "dest_chain", "source_name", "dest_name"]
    rank = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("count"), *keys[1:]))
    listed = grouped.withColumn("rank", rank).filter(F.col("rank") <= n)
    whole = F.sum("volume").over(Window.partitionBy("asset")).cast("double")
    share = F.when(whole > 0, F.col("volume").cast("double") / whole * 100).otherwise(0.0)
    return listed.withColumn("route", route_label("name")).withColumn("percentage", F.round(share, 6))


def top_assets(t: DataFrame, since, limit: int) -> DataFrame:
    """AGG13: raw token symbols with most transfers since an instant."""
    recent = t.filter(F.col("timestamp") > instant(since)).filter("token_symbol IS NOT NULL")
    grouped = recent.groupBy("token_symbol").agg(F.count("*").alias("transfer_count"), _sum().alias("total_volume"))
    return grouped.orderBy(F.desc("transfer_count"), "token_symbol").limit(limit)


def asset_totals(assets: DataFrame, n: int = 10) -> DataFrame:
    """AGG18: number, volume and transfers of the listed first ``n`` assets, and of all given."""
    sums = lambda df, prefix: df.agg(
        F.count("*").alias(f"{prefix}_assets"), F.sum("total_volume").cast("decimal(28,2)").alias(f"{prefix}_volume"),
        F.sum("transfer_count").alias(f"{prefix}_transfers"))
    listed = assets.orderBy(F.desc("transfer_count"), "asset_symbol").limit(n)
    return sums(listed, "total").crossJoin(F.broadcast(sums(assets, "all")))  # one row each
