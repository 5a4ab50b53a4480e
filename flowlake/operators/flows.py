"""Chain flows and the assets behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.columns import SCALE_PERIODS, asset_key, in_window, instant


def chain_flows(t: DataFrame, as_of) -> DataFrame:
    """AGG8 / JN1: outgoing and incoming counts of every chain in 30 days; net is in - out.

    Grouped by id and name, joined by id only, so a chain of several names gives a row for each pairing.
    """
    recent = t.filter(in_window(F.col("timestamp"), as_of, "30d"))
    by_route = recent.groupBy("source_chain", "dest_chain", "source_name", "dest_name")
    return flows_of(by_route.agg(F.count("*").alias("transfer_count"), F.max("timestamp").alias("last_activity")), as_of)


def flows_of(by_route: DataFrame, as_of) -> DataFrame:
    """AGG8 of routes with their count and last activity: what is grouped twice are routes, not transfers."""
    def half(side: str, count: str) -> DataFrame:
        return by_route.groupBy(F.col(f"{side}_chain").alias(f"{side}_id"), F.col(f"{side}_name").alias(f"{side}_nm")).agg(
            F.sum("transfer_count").alias(count), F.max("last_activity").alias(f"{side}_last"))

    out, inc = half("source", "out"), half("dest", "inc")
    o, i = F.coalesce("out", F.lit(0)), F.coalesce("inc", F.lit(0))
    return out.join(inc, F.col("source_id") == F.col("dest_id"), "full").select(
        F.coalesce("source_id", "dest_id").alias("universal_chain_id"),
        F.coalesce("source_nm", "dest_nm").alias("chain_name"),
        o.alias("outgoing_count"),
        i.alias("incoming_count"),
        (i - o).alias("net_flow"),
        F.greatest("source_last", "dest_last").alias("last_transfer_at"),
        instant(as_of).alias("last_activity"),
    )


def chain_flow_ranking(flows: DataFrame, mode: str = "total", n: int = 10) -> DataFrame:
    """TOP2: the first ``n`` chains by total, outgoing, incoming or netflow."""
    measure = {
        "total": F.col("outgoing_count") + F.col("incoming_count"),
        "outgoing": F.col("outgoing_count"),
        "incoming": F.col("incoming_count"),
        "netflow": F.col("net_flow"),
    }[mode]
    return flows.orderBy(measure.desc(), "universal_chain_id", "chain_name").limit(n)


def _directed(by_route: DataFrame) -> DataFrame:
    """Each route once for its source and once for its destination."""
    end = lambda side: F.struct(F.col(f"{side}_chain").alias("chain_id"), F.col(f"{side}_name").alias("chain_name"), F.lit(side).alias("side"))
    return by_route.withColumn("end", F.explode(F.array(end("source"), end("dest")))).select("*", "end.*").drop("end")


ROUTE = ["source_chain", "dest_chain", "source_name", "dest_name"]


def chain_flows_by_scale(t: DataFrame, as_of, n: int = 10) -> DataFrame:
    """AGG9: flows per time scale with net = out - in, the first ``n`` chains of each scale."""
    counts = [F.count(F.when(in_window(F.col("timestamp"), as_of, p), 1)).alias(p) for p in SCALE_PERIODS]
    return by_scale_of(t.filter(in_window(F.col("timestamp"), as_of, "30d")).groupBy(*ROUTE).agg(*counts), n)


def by_scale_of(by_route: DataFrame, n: int) -> DataFrame:
    """AGG9 of routes with the count of each time scale."""
    out, inc = F.col("side") == "source", F.col("side") == "dest"
    total = lambda side, p: F.coalesce(F.sum(F.when(side, F.col(p))), F.lit(0))
    counts = [total(side, p).alias(f"{name}_{p}") for p in SCALE_PERIODS for name, side in (("out", out), ("in", inc))]
    grouped = _directed(by_route).groupBy("chain_id").agg(F.min("chain_name").alias("chain_name"), *counts)
    rows = [
        F.struct(F.lit(p).alias("time_scale"), F.col(f"out_{p}").alias("outgoing_count"), F.col(f"in_{p}").alias("incoming_count"))
        for p in SCALE_PERIODS
    ]
    long = grouped.select("chain_id", "chain_name", F.explode(F.array(*rows)).alias("x")).select("chain_id", "chain_name", "x.*")
    total = F.col("outgoing_count") + F.col("incoming_count")
    rank = F.row_number().over(Window.partitionBy("time_scale").orderBy(total.desc(), "chain_id"))
    ranked = long.filter(total > 0).withColumn("rank", rank).filter(F.col("rank") <= n)
    return ranked.withColumn("net_flow", F.col("outgoing_count") - F.col("incoming_count"))


def chain_top_assets(t: DataFrame, as_of, n: int = 5) -> DataFrame:
    """AGG10 / WIN1-2: the first ``n`` assets of every chain by transfers in 30 days.

    ``percentage`` is of the volume of the listed rows of the chain.
    """
    keyed = t.filter(in_window(F.col("timestamp"), as_of, "30d")).withColumn("asset", asset_key()).filter("asset IS NOT NULL")
    grouped = keyed.groupBy(*ROUTE, "asset").agg(F.count("*").alias("n"), F.sum("amount").alias("volume"), F.max("timestamp").alias("last"))
    return top_assets_of(grouped, n)


def top_assets_of(by_route: DataFrame, n: int = 5) -> DataFrame:
    """AGG10 of routes and assets with their count ``n``, ``volume`` and ``last`` activity."""
    out, inc = F.col("side") == "source", F.col("side") == "dest"
    volume = lambda c: F.coalesce(F.sum(F.when(c, F.col("volume"))), F.lit(0)).cast("decimal(28,2)")
    number = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    grouped = _directed(by_route).groupBy("chain_id", "asset").agg(
        number(out).alias("outgoing_count"),
        number(inc).alias("incoming_count"),
        volume(out).alias("outgoing_volume"),
        volume(inc).alias("incoming_volume"),
        F.max("last").alias("last_activity"),
    )
    total = F.col("outgoing_count") + F.col("incoming_count")
    rank = F.row_number().over(Window.partitionBy("chain_id").orderBy(total.desc(), "asset"))
    listed = grouped.withColumn("rank", rank).filter(F.col("rank") <= n)
    listed = listed.withColumn("total_volume", (F.col("outgoing_volume") + F.col("incoming_volume")).cast("decimal(28,2)"))
    all_listed = F.sum("total_volume").over(Window.partitionBy("chain_id")).cast("double")
    volume_ = F.col("total_volume").cast("double")
    return listed.select(
        "chain_id", "rank", "asset", "outgoing_count", "incoming_count",
        (F.col("incoming_count") - F.col("outgoing_count")).alias("net_flow"),
        "total_volume",
        F.round(volume_ / total, 6).alias("average_amount"),
        F.round(F.when(all_listed > 0, volume_ / all_listed * 100).otherwise(0.0), 6).alias("percentage"),
        "last_activity",
    )


def flow_totals(flows: DataFrame, n: int = 10) -> DataFrame:
    """AGG18: sums over the listed first ``n`` chains, and over all."""
    listed = chain_flow_ranking(flows, "total", n).agg(
        F.sum("outgoing_count").alias("total_outgoing"), F.sum("incoming_count").alias("total_incoming"))
    everything = flows.agg(F.sum("outgoing_count").alias("all_outgoing"), F.sum("incoming_count").alias("all_incoming"))
    return listed.crossJoin(F.broadcast(everything))  # one row each
