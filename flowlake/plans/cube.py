"""The transfers of 60 days in one pass: by route and asset, by sender and by receiver, for all windows at once.

Each grouping set has the same measures, which are counts and sums under the conditions of the windows.
All sections of the dashboard are put together from this one table; the facts are read and shuffled
once. It has a row for each route and asset and for each wallet, and is written, as every section reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.files import shared_path
from flowlake.functions.columns import PERIODS, RATE_PERIODS, SCALE_PERIODS, ago, asset_key, in_window, instant, since
from flowlake.operators import assets, flows, rates, routes, wallets

SETS = {"routes": [*routes.KEYS, "asset"], "sender": ["sender"], "receiver": ["receiver"]}
CHANGES = [f"{w}_{p}" for p in RATE_PERIODS for w in ("cur", "prev")] + ["base"]


def aggregate(t: DataFrame, as_of) -> DataFrame:
    """kind, the keys of all sets and the measures. One scan and one exchange of the transfers."""
    ts, month = F.col("timestamp"), in_window(F.col("timestamp"), as_of, "30d")
    recent = since(t, as_of, 2 * PERIODS["30d"]).filter(ts <= instant(as_of)).withColumn("asset", asset_key())
    keys = [k for names in SETS.values() for k in names]
    measures = [
        *rates.change_counters(as_of),
        F.count(F.when(in_window(ts, as_of, "1m"), 1)).alias("cur_1m"),
        F.sum(F.when(month, F.col("amount"))).alias("volume"),
        F.count(F.when(month, F.col("amount"))).alias("amounts"),
        F.max(F.when(month, F.col("amount"))).alias("largest"),
        F.max(F.when(month, ts)).alias("last"),
        F.max(ts).alias("now"),
        *[F.max(F.when(ts <= ago(as_of, PERIODS[p]), ts)).alias(f"before_{p}") for p in RATE_PERIODS],
    ]
    grouped = recent.groupingSets([[F.col(k) for k in names] for names in SETS.values()], *[F.col(k) for k in keys])
    kind = F.lit(None).cast("string")
    for name, names in SETS.items():
        # a bit for each key that the set does not have
        mask = sum((k not in names) << (len(keys) - 1 - i) for i, k in enumerate(keys))
        kind = F.when(F.col("gid") == mask, name).otherwise(kind)
    return grouped.agg(F.grouping_id().alias("gid"), *measures).withColumn("kind", kind).drop("gid")


@dataclass(frozen=True)
class Cube:
    """The written aggregate, and the sections' operators over it."""

    rows: DataFrame
    as_of: object

    def _kind(self, kind: str) -> DataFrame:
        return self.rows.filter(F.col("kind") == kind)

    def _month(self, *keys: str) -> DataFrame:
        """Routes and assets of 30 days by ``keys``, with the measures of the summaries."""
        grouped = self._kind("routes").filter("cur_30d > 0").groupBy(*keys)
        counts = [F.sum(f"cur_{p}").alias(p) for p in SCALE_PERIODS]
        return grouped.agg(*counts, F.sum("volume").alias("volume"), F.sum("amounts").alias("amounts"), F.max("largest").alias("largest"), F.max("last").alias("last"))

    def _named(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({"30d": "transfer_count", "volume": "total_volume", "last": "last_activity"})

    def transfer_rate_changes(self) -> DataFrame:
        return rates.changes_of(self._kind("routes").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CHANGES]))

    def data_availability(self) -> DataFrame:
        return rates.availability_of(self._kind("routes").agg(*[F.coalesce(F.sum(f"cur_{p}"), F.lit(0)).alias(p) for p in SCALE_PERIODS]))

    def wallet_rate_changes(self) -> DataFrame:
        seen = lambda kind: self._kind(kind).filter(F.col(kind).isNotNull()).select(
            F.col(kind).alias("wallet"), F.lit(kind[0]).alias("side"), "now", *[F.col(f"before_{p}").alias(p) for p in RATE_PERIODS])
        return wallets.changes_of(seen("sender").unionByName(seen("receiver")), self.as_of)

    def popular_routes(self, n: int = 50) -> DataFrame:
        return routes.listed(self._named(self._month(*routes.KEYS)), n)

    def popular_routes_by_scale(self, n: int = 10) -> DataFrame:
        return routes.by_scale_of(self._month(*routes.KEYS).select(*routes.KEYS, *SCALE_PERIODS), n)

    def _active(self, side: str) -> DataFrame:
        rows = self._kind(side).filter(F.col(side).isNotNull() & (F.col("cur_30d") > 0))
        return rows.select(F.col(side).alias("address"), F.col("last").alias("last_activity"), *[F.col(f"cur_{p}").alias(p) for p in SCALE_PERIODS])

    def active_wallets(self, side: str, n: int = 50) -> DataFrame:
        return wallets.listed(self._active(side).withColumnRenamed("30d", "count"), n)

    def active_wallets_by_scale(self, side: str, n: int = 10) -> DataFrame:
        return wallets.by_scale_of(self._active(side), n)

    def chain_flows(self) -> DataFrame:
        return flows.flows_of(self._named(self._month(*routes.KEYS)), self.as_of)

    def chain_flows_by_scale(self, n: int = 10) -> DataFrame:
        return flows.by_scale_of(self._month(*routes.KEYS), n)

    def chain_top_assets(self, n: int = 5) -> DataFrame:
        return flows.top_assets_of(self._month(*routes.KEYS, "asset").filter("asset IS NOT NULL").withColumnRenamed("30d", "n"), n)

    def asset_volumes(self, n: int = 50) -> DataFrame:
        return assets.listed(self._named(self._month("asset").filter("asset IS NOT NULL")).withColumnRenamed("asset", "asset_symbol"), n)

    def asset_top_routes(self, n: int = 5) -> DataFrame:
        grouped = self._month(*routes.KEYS, "asset").filter("asset IS NOT NULL")
        volume = F.coalesce("volume", F.lit(0)).cast("decimal(28,2)").alias("volume")
        return assets.top_routes_of(grouped.select(*routes.KEYS, "asset", F.col("30d").alias("count"), volume, F.col("last").alias("last_activity")), n)


def cube(t: DataFrame, as_of) -> Cube:
    """The cube of ``t``, written in the shared folder."""
    rows = aggregate(t, as_of)
    path = shared_path(t.sparkSession, "cube")
    rows.write.parquet(path)
    return Cube(t.sparkSession.read.schema(rows.schema).parquet(path), as_of)
