"""Nested documents: drill-downs and the dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.columns import rfc3339
from flowlake.operators import assets, flows, health, latency, routes
from flowlake.plans.cube import cube


def ranked_list(df: DataFrame, keys: list[str], name: str, order: str = "rank") -> DataFrame:
    """Rows of each key as one array of structs in rank order. Lists are short: they are top-k lists."""
    fields = [order, *[c for c in df.columns if c not in (*keys, order)]]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def _with_rank(df: DataFrame, *order: Column) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def chain_flow_document(t: DataFrame, as_of, n: int = 10, n_assets: int = 5) -> DataFrame:
    """DOC1: the first ``n`` chains with their top assets."""
    return chain_flow_document_of(flows.chain_flows(t, as_of), flows.chain_top_assets(t, as_of, n_assets), n)


def chain_flow_document_of(chain_flows: DataFrame, top_assets: DataFrame, n: int = 10) -> DataFrame:
    """DOC1 of flows and top assets."""
    listed = flows.chain_flow_ranking(chain_flows, "total", n)
    top = top_assets.withColumn("last_activity", rfc3339(F.col("last_activity")))
    nested = ranked_list(top, ["chain_id"], "top_assets")
    joined = F.broadcast(listed).join(nested, F.col("universal_chain_id") == F.col("chain_id"), "left").drop("chain_id")
    return joined.withColumn("last_activity", rfc3339(F.col("last_activity")))


def asset_document(t: DataFrame, as_of, n: int = 10, n_routes: int = 5) -> DataFrame:
    """DOC2: the first ``n`` assets with their top routes."""
    return asset_document_of(assets.asset_volumes(t, as_of, n), assets.asset_top_routes(t, as_of, n_routes), n)


def asset_document_of(volumes: DataFrame, top_routes: DataFrame, n: int = 10) -> DataFrame:
    """DOC2 of volumes and top routes."""
    listed = volumes.orderBy(F.desc("transfer_count"), "asset_symbol").limit(n)
    top = top_routes.withColumn("last_activity", rfc3339(F.col("last_activity")))
    nested = ranked_list(top, ["asset"], "top_routes")
    joined = F.broadcast(listed).join(nested, F.col("asset_symbol") == F.col("asset"), "left").drop("asset")
    return joined.withColumn("last_activity", rfc3339(F.col("last_activity")))


def node_health_document(h: DataFrame, as_of) -> DataFrame:
    """DOC4: the summary with all nodes and a map of chain id to statistics. Nodes number in the thousands."""
    latest = health.latest_node_health(h, as_of)
    node = F.struct(
        "chain_id", "rpc_url", "chain_name", "rpc_type", "status", "response_time_ms", "latest_block_height", "uptime",
        F.unix_timestamp("checked_at").alias("last_check_time"), F.coalesce("error_message", F.lit("")).alias("error"))
    nodes = latest.agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    stats = health.chain_health(h, as_of)
    entry = F.struct("chain_id", F.struct(*[c for c in stats.columns if c != "chain_id"]))
    by_chain = stats.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("chain_stats"))
    summary = health.node_health_summary(h, as_of).crossJoin(health.node_availability(h, as_of))
    return summary.crossJoin(nodes).crossJoin(by_chain)  # one row each


def _scales(df: DataFrame, name: str) -> DataFrame:
    """One row: a map of time scale to the ranked list of that scale."""
    lists = ranked_list(df, ["time_scale"], "rows")
    return lists.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("time_scale", "rows")))).alias(name))


def _list(df: DataFrame, name: str, *order: Column) -> DataFrame:
    ranked = _with_rank(df, *order)
    return ranked.agg(F.array_sort(F.collect_list(F.struct("rank", *df.columns))).alias(name))


def _first(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def dashboard(t: DataFrame, latency_data: DataFrame, h: DataFrame, as_of, n: int = 10, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """DOC5: the whole dashboard as one row with one struct ``doc``.

    All sections of transfers come from one cube of 60 days. ``stored`` holds the summary tables of a
    refresh at ``as_of``: routes, wallets, flows and assets are then read from them.
    """
    c = cube(t, as_of)
    views = stored or {
        "popular_routes": c.popular_routes(), "chain_flows": c.chain_flows(), "asset_volumes": c.asset_volumes(),
        "active_senders": c.active_wallets("sender"), "active_receivers": c.active_wallets("receiver")}
    by_count = F.desc("count"), F.asc("address")
    row = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    ranked = chain_flow_document_of(views["chain_flows"], c.chain_top_assets(), n), asset_document_of(views["asset_volumes"], c.asset_top_routes(), n)
    top_routes = _first(views["popular_routes"], n, F.desc("transfer_count"), *[F.asc(c) for c in routes.KEYS])
    sections = [
        row(c.transfer_rate_changes(), "transferRates"),
        row(c.wallet_rate_changes(), "activeWalletRates"),
        _list(top_routes, "popularRoutes", F.desc("transfer_count"), F.asc("route")),
        _scales(c.popular_routes_by_scale(n), "popularRoutesTimeScale"),
        _list(_first(views["active_senders"], n, *by_count), "activeSenders", *by_count),
        _list(_first(views["active_receivers"], n, *by_count), "activeReceivers", *by_count),
        _scales(c.active_wallets_by_scale("sender", n), "activeSendersTimeScale"),
        _scales(c.active_wallets_by_scale("receiver", n), "activeReceiversTimeScale"),
        _list(ranked[0], "chainFlows", (F.col("outgoing_count") + F.col("incoming_count")).desc(), F.asc("universal_chain_id"), F.asc("chain_name")),
        _scales(c.chain_flows_by_scale(n), "chainFlowsTimeScale"),
        row(flows.flow_totals(views["chain_flows"], n), "chainFlowTotals"),
        _list(ranked[1], "assets", F.desc("transfer_count"), F.asc("asset_symbol")),
        row(assets.asset_totals(views["asset_volumes"], n), "assetTotals"),
        row(latency.latency_document(latency_data), "latency"),
        node_health_document(h, as_of).select(F.struct("*").alias("nodeHealth")),
        c.data_availability().select(F.struct("*").alias("dataAvailability")),
    ]
    return _side_by_side(sections).select(F.struct("*").alias("doc"))


def _side_by_side(rows: list[DataFrame]) -> DataFrame:
    """Tables of one row as one row with all their columns: stacked, and of each column the row that has it."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
