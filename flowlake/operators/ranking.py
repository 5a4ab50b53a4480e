"""Shares and relative sizes of ranked rows. Inputs are ranked lists: a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _top(df: DataFrame, measure: Column, n: int, ties: list[str]) -> DataFrame:
    return df.withColumn("measure", measure).orderBy(F.abs("measure").desc(), *ties).limit(n)


def whole_percent(x: Column) -> Column:
    """Rounded half up."""
    return F.floor(x + 0.5).cast("long")


def share_of_listed(df: DataFrame, measure: Column, n: int, ties: list[str], least_total: int = 0) -> DataFrame:
    """WIN4: the first ``n`` rows by ``measure`` with ``share``, their whole percent of the listed absolute total.

    A total below ``least_total`` counts as that; a total of 0 gives shares of 0.
    """
    listed = _top(df, measure, n, ties)
    total = F.greatest(F.sum(F.abs("measure")).over(Window.partitionBy(F.lit(0))), F.lit(least_total)).cast("double")
    share = F.when(total > 0, whole_percent(F.abs("measure").cast("double") / total * 100)).otherwise(F.lit(0).cast("long"))
    return listed.withColumn("share", share).drop("measure")


def wallet_share(senders: DataFrame, receivers: DataFrame, n: int = 10) -> DataFrame:
    """WIN5: side, address, count and whole percent of the larger of both sides' listed totals."""
    lists = []
    for side, df in (("sender", senders), ("receiver", receivers)):
        lists.append(df.orderBy(F.desc("count"), "address").limit(n).select(F.lit(side).alias("side"), "address", "count"))
    both = lists[0].unionByName(lists[1])
    total = both.groupBy("side").agg(F.sum("count").alias("t")).agg(F.greatest(F.max("t"), F.lit(1)).alias("total"))
    shared = both.crossJoin(F.broadcast(total))  # one row
    return shared.withColumn("share", whole_percent(F.col("count") / F.col("total") * 100)).drop("total")


def relative_to_max(df: DataFrame, measure: str) -> DataFrame:
    """WIN6: ``relative``, the measure over the largest listed one (1 where nothing is larger than 0)."""
    largest = F.max(measure).over(Window.partitionBy(F.lit(0)))
    return df.withColumn("relative", F.round(F.when(largest > 0, F.col(measure) / largest).otherwise(F.lit(1.0)), 6))


def remaining_share(asset_routes: DataFrame, k: int = 5) -> DataFrame:
    """WIN7: percentage of each asset's routes after the first ``k``."""
    rest = F.coalesce(F.sum(F.when(F.col("rank") > k, F.col("percentage"))), F.lit(0.0))
    return asset_routes.groupBy("asset").agg(F.round(rest, 4).alias("remaining_percentage"))


def recent_transfers(t: DataFrame, n: int = 1000) -> DataFrame:
    """TOP5: the newest ``n`` transfers, newest first."""
    return t.orderBy(F.desc("timestamp"), "packet_hash").limit(n)
