"""Operational reports over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.columns import instant

BYTES_PER_TRANSFER = 800
TARGET_ROWS = 5_500_000
SCENARIOS = {"10_million": 10_000_000, "100_million": 100_000_000, "175_million": 175_000_000, "1_billion": 1_000_000_000}


def analytics_status(rates: DataFrame, wallets: DataFrame, routes: DataFrame, flows: DataFrame, assets: DataFrame, calculated_at, now=None) -> DataFrame:
    """AGG26: view_name, record_count, last_updated, age_seconds. An empty table has no row."""
    rows = lambda df, name: df.agg(F.count("*").alias("record_count")).filter("record_count > 0").select(F.lit(name).alias("view_name"), "record_count")
    parts = [
        rates.filter("period = 'all'").select(F.lit("transfer_rates").alias("view_name"), F.col("count").alias("record_count")),
        wallets.filter("period = '30d'").select(F.lit("wallet_stats").alias("view_name"), F.col("unique_total").alias("record_count")),
        rows(routes, "popular_routes"), rows(flows, "chain_flows"), rows(assets, "asset_volumes"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    at = instant(calculated_at)
    age = F.unix_micros(instant(now if now is not None else calculated_at)) - F.unix_micros(at)
    return out.withColumn("last_updated", at).withColumn("age_seconds", age / 1_000_000)


def load_progress(t: DataFrame, target: int = TARGET_ROWS) -> DataFrame:
    """AGG27: rows and percent of the rows to load, to two places."""
    pct = (F.col("actual_rows").cast("decimal(20,0)") * 100 / F.lit(target).cast("decimal(20,0)")).cast("decimal(12,2)")
    return t.agg(F.count("*").alias("actual_rows")).select(
        F.lit("transfers").alias("table_name"), F.lit(target).cast("long").alias("estimated_rows"), "actual_rows", pct.alias("progress_pct"))


def capacity_report(t: DataFrame) -> DataFrame:
    """AGG28: size of the table now and at the planned row counts, with tier and recommendation class."""
    count = t.agg(F.count("*").alias("n"))
    named = [F.struct(F.lit("current").alias("scenario"), F.col("n").alias("transfers"))]
    named += [F.struct(F.lit(k).alias("scenario"), F.lit(v).cast("long").alias("transfers")) for k, v in SCENARIOS.items()]
    rows = count.select("n", F.explode(F.array(*named)).alias("x")).select("n", "x.*")
    size = F.col("transfers") * BYTES_PER_TRANSFER
    return rows.select(
        "scenario", "transfers", size.alias("size_bytes"),
        F.round(size / float(1024**3), 6).alias("size_gb"), F.round(size / float(1024**4), 6).alias("size_tb"),
        F.when(F.col("n") > 1_000_000, "large_scale_optimized").otherwise("medium_scale").alias("scale_status"),
        F.when(F.col("n") > 100_000_000, "partition_history").when(F.col("n") > 10_000_000, "analyze_regularly").otherwise("none_needed").alias("recommendation"),
    )


def log_rollup(logs: DataFrame, window: str = "1 second", ties: str = "seq") -> DataFrame:
    """AGG29: entries by flush window, component and level.

    One entry stays as it is, up to three are joined, of more the first, the number between and the last are shown.
    """
    keyed = logs.select(F.window("ts", window)["start"].alias("window_start"), "component", "level", F.struct("ts", ties).alias("at"), "message")
    keys = ["window_start", "component", "level"]
    # of a group only its first and its last are held, and the one between of groups of three, however many entries it has
    ends = keyed.groupBy(*keys).agg(
        F.count("*").alias("entries"), F.min_by("message", F.struct("at", "message")).alias("first"), F.max_by("message", F.struct("at", "message")).alias("last"))
    three = ends.filter("entries = 3").select(*[F.col(k).alias(f"__{k}") for k in keys])
    inner = keyed.join(three, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi")
    second = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "message"))  # of groups of three
    middle = inner.withColumn("r", second).filter("r = 2").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("message").alias("middle"))
    joined = ends.join(middle, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    n = F.col("entries")
    summary = F.when(n == 1, F.col("first")).when(n == 2, F.concat_ws("; ", "first", "last")).when(n == 3, F.concat_ws("; ", "first", "middle", "last")).otherwise(
        F.concat("first", F.lit(" ... (+"), (n - 2).cast("string"), F.lit(" similar) ... "), "last"))
    return joined.select(*keys, n.alias("entries"), summary.alias("summary"))
