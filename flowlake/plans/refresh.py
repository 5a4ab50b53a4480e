"""Refresh of the seven summary tables (SNK6)."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.files import Manifest, children, remove
from flowlake.functions.columns import DAY, since
from flowlake.operators import assets, flows, rates, routes, wallets
from flowlake.plans.partials import KIND_OF, fold, newest, stored_summaries

COLUMNS = ["source_chain", "dest_chain", "source_name", "dest_name", "sender", "receiver", "amount", "token_symbol", "canonical_token_symbol", "timestamp"]

VIEWS = ["transfer_rates", "wallet_stats", "popular_routes", "chain_flows", "asset_volumes", "active_senders", "active_receivers"]


def summaries(t: DataFrame, recent: DataFrame, as_of) -> dict[str, DataFrame]:
    """The seven summary tables; only the all-time count needs more than ``recent``."""
    return {
        "transfer_rates": rates.transfer_rates(recent, as_of, t),
        "wallet_stats": wallets.wallet_stats(recent, as_of),
        "popular_routes": routes.popular_routes(recent, as_of),
        "chain_flows": flows.chain_flows(recent, as_of),
        "asset_volumes": assets.asset_volumes(recent, as_of),
        "active_senders": wallets.active_wallets(recent, as_of, "sender"),
        "active_receivers": wallets.active_wallets(recent, as_of, "receiver"),
    }


def speed_class(seconds: F.Column) -> F.Column:
    """Refreshes of over 30 s are slow, of over 10 s moderate."""
    return F.when(seconds > 30, "slow").when(seconds > 10, "moderate").otherwise("fast")


def publish(views: dict[str, DataFrame], out: str, as_of: datetime) -> DataFrame:
    """Write summaries as a new version under ``out`` and make it the current one. Returns view, rows, seconds, class.

    Readers see the old version until the manifest names the new one. The version before stays for
    readers that have it open; older ones are removed.
    """
    spark = next(iter(views.values())).sparkSession
    version = as_of.strftime("v%Y%m%dT%H%M%S%f") + f"-{time.time_ns()}"
    report = []
    for view, df in views.items():
        began = time.time()
        path = f"{out}/{version}/{view}"
        df.write.parquet(path)
        report.append((view, spark.read.parquet(path).count(), round(time.time() - began, 3)))
    manifest = Manifest(spark, f"{out}/current")
    manifest.commit({"version": version, "as_of": as_of.isoformat(), "report": report})
    kept = {d["version"] for d in manifest.history()}
    for name in children(spark, out):
        if name.startswith("v") and name not in kept:
            remove(spark, f"{out}/{name}")
    return report_of(spark, report)


def report_of(spark: SparkSession, report: list) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in report], "view string, rows long, seconds double").withColumn("class", speed_class(F.col("seconds")))


def refresh_analytics(t: DataFrame, as_of: datetime, out: str) -> DataFrame:
    """SNK6 from the facts: all summaries computed anew and published."""
    recent = since(t, as_of, 30 * DAY).select(*COLUMNS).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return publish(summaries(t, recent, as_of), out, as_of)
    finally:
        recent.unpersist()


def refresh_incremental(facts: DataFrame, new: DataFrame, number: int, out: str, views: list[str] | None = None) -> DataFrame | None:
    """SNK6 by partials: fold the rows ``new`` (batch ``number``) into those under ``out``, then publish the summaries.

    ``facts`` are all rows, the new ones included; only the hours at the edges of the windows are read
    of them. ``new`` is read once for each kind of partial: give a persisted batch. ``as_of`` is the
    newest instant; None is returned as long as there is none.
    """
    spark = facts.sparkSession
    kinds = None if views is None else {"hours", *[KIND_OF[v] for v in views]}
    fold(spark, new, out, number, kinds)
    as_of = newest(spark, out)
    if as_of is None:
        return None
    found = stored_summaries(spark, facts, out, as_of, kinds)
    return publish({v: found[v] for v in views or VIEWS}, out, as_of)


def current(spark: SparkSession, out: str) -> dict:
    """version, as_of and report of the last refresh."""
    return Manifest(spark, f"{out}/current").current()


def read_summary(spark: SparkSession, out: str, view: str) -> DataFrame:
    """A summary table of the newest finished version."""
    return spark.read.parquet(f"{out}/{current(spark, out)['version']}/{view}")


def read_all_summaries(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """All summary tables, of one version."""
    version = current(spark, out)["version"]
    return {view: spark.read.parquet(f"{out}/{version}/{view}") for view in VIEWS}
