"""Partial aggregates by hour, from which the seven summaries of any newest instant are put together.

A refresh aggregates the new rows only and adds them to the stored partials, which are segments merged
by level. A trailing window is the hours inside it plus the rows of the one hour that it begins in,
which are read from the facts (one date, one range of time), so the summaries equal those of all facts.
Partials older than the longest window go when their segment is merged, but for the counts by hour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions.columns import HOUR, PERIODS, RATE_PERIODS, ago, asset_key, instant
from flowlake.operators import assets, flows, routes, wallets
from flowlake.sources.segments import Segments

#: Keys of each kind of partial, beside the hour.
KEYS = {"hours": [], "routes": routes.KEYS, "assets": ["asset_symbol"], "wallets": ["side", "address"]}
#: The kind of partial that each summary is made of.
KIND_OF = {
    "transfer_rates": "hours", "wallet_stats": "wallets", "active_senders": "wallets", "active_receivers": "wallets",
    "popular_routes": "routes", "chain_flows": "routes", "asset_volumes": "assets",
}
#: How measures of partials are merged; others by the greatest.
SUMS = ["n", "volume", "amounts"]
LONGEST = PERIODS["30d"]
MONEY = "decimal(38,18)"


def hour_of(ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / HOUR) * HOUR)


def after(as_of, seconds: int) -> Column:
    """The first full hour of a trailing window."""
    return hour_of(ago(as_of, seconds)) + F.expr("INTERVAL 1 HOUR")


def hourly(t: DataFrame, kind: str) -> DataFrame:
    """Partial aggregates of rows of the transfers."""
    n, last = F.count("*").alias("n"), F.max("timestamp").alias("last")
    if kind == "wallets":
        side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("address"))
        t = t.select("timestamp", F.explode(F.array(side("sender"), side("receiver"))).alias("x")).select("timestamp", "x.*").filter("address IS NOT NULL")
    measures = [n, last]
    if kind in ("routes", "assets"):
        measures.append(F.sum("amount").cast(MONEY).alias("volume"))
    if kind == "assets":
        t = t.withColumn("asset_symbol", asset_key()).filter("asset_symbol IS NOT NULL")
        measures += [F.count("amount").alias("amounts"), F.max("amount").cast(MONEY).alias("largest")]
    return t.groupBy(hour_of(F.col("timestamp")).alias("hour"), *KEYS[kind]).agg(*measures)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partials with one row for each of ``keys``."""
    measures = [c for c in parts.columns if c in (*SUMS, "last", "largest")]
    kept = lambda c: F.sum(c).cast(parts.schema[c].dataType) if c in SUMS else F.max(c)
    return parts.groupBy(*keys).agg(*[kept(c).alias(c) for c in measures])


def store_of(spark: SparkSession, out: str, kind: str, as_of=None) -> Segments:
    def merge(rows: DataFrame) -> DataFrame:
        if kind != "hours" and as_of is not None:
            rows = rows.filter(F.col("hour") >= hour_of(ago(as_of, LONGEST)))
        return merged(rows, ["hour", *KEYS[kind]])

    return Segments(spark, f"{out}/partials/{kind}", merge)


def newest(spark: SparkSession, out: str):
    """The newest instant of all rows that were folded."""
    hours = store_of(spark, out, "hours").read()
    return None if hours is None else hours.agg(F.max("last")).first()[0]


def fold(spark: SparkSession, rows: DataFrame, out: str, number: int, kinds: set[str] | None = None) -> None:
    """Add the partials of new rows, of all kinds or those given. ``number`` is the batch's; a batch that was folded is passed over."""
    for kind in [k for k in KEYS if kinds is None or k in kinds]:
        at = newest(spark, out) if kind != "hours" else None
        store_of(spark, out, kind, at).add(hourly(rows, kind), "facts", number)


def _at_edges(facts: DataFrame, as_of, seconds: list[int]) -> DataFrame:
    """Facts of the hours that trailing windows begin in, of those dates and times only."""
    ts = F.col("timestamp")
    ranges = [(ago(as_of, s), after(as_of, s)) for s in seconds]
    inside = reduce(lambda a, b: a | b, [(ts > lo) & (ts < hi) for lo, hi in ranges])
    if "date" in facts.columns:
        inside = inside & reduce(lambda a, b: a | b, [F.col("date").between(F.to_date(lo), F.to_date(hi)) for lo, hi in ranges])
    return facts.filter(inside)


def window_parts(parts: DataFrame, facts: DataFrame, as_of, kind: str) -> DataFrame:
    """Partials of the last 30 days before ``as_of``, the newest instant, one row for each key of the kind."""
    edge = hourly(_at_edges(facts, as_of, [LONGEST]), kind)
    within = parts.filter((F.col("hour") >= after(as_of, LONGEST)) & (F.col("hour") <= instant(as_of)))
    return merged(within.unionByName(edge), KEYS[kind])


def _rates(hours: DataFrame, facts: DataFrame, as_of) -> DataFrame:
    counts = [F.coalesce(F.sum("n"), F.lit(0)).alias("all")]
    counts += [F.coalesce(F.sum(F.when(F.col("hour") >= after(as_of, PERIODS[p]), F.col("n"))), F.lit(0)).alias(p) for p in RATE_PERIODS]
    ts = F.col("timestamp")
    # of a window inside one hour all rows are at its edge
    begun = [F.count(F.when((ts > ago(as_of, PERIODS[p])) & (ts < after(as_of, PERIODS[p])), 1)).alias(f"edge_{p}") for p in RATE_PERIODS]
    edges = _at_edges(facts, as_of, [PERIODS[p] for p in RATE_PERIODS]).agg(*begun)
    wide = hours.agg(*counts).crossJoin(F.broadcast(edges))  # one row each
    wide = wide.select("all", *[(F.col(p) + F.col(f"edge_{p}")).alias(p) for p in RATE_PERIODS])
    return wide.unpivot([], wide.columns, "period", "count").withColumn("calculated_at", instant(as_of))


def summaries_of(parts: dict[str, DataFrame], facts: DataFrame, as_of) -> dict[str, DataFrame]:
    """The summary tables of partials, as far as their kinds are given; of all kinds the seven."""
    recent = {kind: window_parts(df, facts, as_of, kind) for kind, df in parts.items() if kind != "hours"}
    made = {}
    measured = lambda df: df.withColumnsRenamed({"n": "transfer_count", "volume": "total_volume", "last": "last_activity"})
    last = lambda side: F.max(F.when(F.col("side") == side, F.col("last")))
    if "hours" in parts:
        made["transfer_rates"] = _rates(parts["hours"], facts, as_of)
    if "wallets" in recent:
        ends = recent["wallets"]
        made["wallet_stats"] = wallets.stats_of(ends.groupBy("address").agg(last("sender").alias("s"), last("receiver").alias("r")), as_of)
        for side in ("sender", "receiver"):
            own = ends.filter(F.col("side") == side).select("address", F.col("n").alias("count"), F.col("last").alias("last_activity"))
            made[f"active_{side}s"] = wallets.listed(own, 50)
    if "routes" in recent:
        made["popular_routes"] = routes.listed(measured(recent["routes"]), 50)
        made["chain_flows"] = flows.flows_of(measured(recent["routes"]), as_of)
    if "assets" in recent:
        made["asset_volumes"] = assets.listed(measured(recent["assets"]), 50)
    return made


def stored_summaries(spark: SparkSession, facts: DataFrame, out: str, as_of, kinds: set[str] | None = None) -> dict[str, DataFrame]:
    """The summaries of what was folded into ``out``; of ``facts`` only the hours at the windows' edges are read."""
    return summaries_of({kind: store_of(spark, out, kind).read() for kind in KEYS if kinds is None or kind in kinds}, facts, as_of)
