"""Name -> query and name -> oracle SQL of the transfer-analytics operators.

Each query applies one operator to whole tables, with the newest instant of its input as "now".
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import fixtures as fx, schemas
from flowlake.files import children, shared_path
from flowlake.functions import columns as col
from flowlake.operators import assets, enrich, flows, health, latency, ops, ranking, rates, routes, wallets
from flowlake.plans import documents
from flowlake.plans.cube import cube
from flowlake.plans.refresh import read_all_summaries, read_summary, refresh_analytics, refresh_incremental
from flowlake.sources import cursors, sinks
from flowlake.sources.segments import Segments
from flowlake.sources.documents import read_chains, read_latency_docs, read_transfers, transfer_rows
from flowlake.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}

# ---------------------------------------------------------------------------------------------- inputs in SQL

_RT = """
rt AS (SELECT 'pkt-' || event_id AS packet_hash, lpad(CAST(event_id AS VARCHAR), 20, '0') AS sort_order,
       'chain-' || (user_id % 7) AS source_chain, 'chain-' || (event_id % 5) AS dest_chain,
       'CHAIN-' || (user_id % 7) AS source_name, 'CHAIN-' || (event_id % 5) AS dest_name,
       'w-' || user_id AS sender, 'w-' || (event_id % 211) AS receiver, CAST(value AS DECIMAL(18,2)) AS amount,
       event_type AS token_symbol,
       CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN upper(event_type) END AS canonical_token_symbol,
       ts AS timestamp, event_id AS ingest_seq FROM events),
t AS MATERIALIZED (SELECT *, max(timestamp) OVER () AS as_of, coalesce(nullif(canonical_token_symbol, ''), token_symbol) AS asset FROM rt)
"""

_STAR = """
star AS (SELECT l.*, s_name, c_name, ns.n_nationkey AS ns_key, ns.n_name AS ns_name, nc.n_nationkey AS nc_key, nc.n_name AS nc_name
         FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN nation nc ON c_nationkey = nc.n_nationkey)
"""

_TRANSFERS = f"""{_STAR},
tr AS (SELECT l_orderkey || '-' || l_linenumber AS packet_hash, l_shipdate AS timestamp,
       'nation-' || ns_key AS source_chain, 'nation-' || nc_key AS dest_chain, ns_name AS source_name, nc_name AS dest_name,
       s_name AS sender, c_name AS receiver, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, p_brand AS token_symbol,
       CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS canonical_token_symbol,
       row_number() OVER (PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn
       FROM star JOIN part ON l_partkey = p_partkey),
t AS MATERIALIZED (SELECT *, max(timestamp) OVER () AS as_of, coalesce(nullif(canonical_token_symbol, ''), token_symbol) AS asset FROM tr WHERE rn = 1)
"""

_NODES = """
h AS MATERIALIZED (SELECT *, max(checked_at) OVER () AS as_of FROM (
      SELECT 'chain-' || (user_id % 5) AS chain_id, 'Chain ' || (user_id % 5) AS chain_name,
      'https://rpc-' || (user_id % 20) || '.example' AS rpc_url, CASE WHEN user_id % 2 = 0 THEN 'cosmos' ELSE 'evm' END AS rpc_type,
      CASE event_type WHEN 'error' THEN 'unhealthy' WHEN 'signup' THEN 'degraded' ELSE 'healthy' END AS status,
      CAST(round(value) AS INT) AS response_time_ms, CASE WHEN event_type <> 'error' THEN event_id END AS latest_block_height,
      CASE WHEN event_type = 'error' THEN 'timeout' END AS error_message,
      CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS uptime, ts AS checked_at FROM events)),
latest AS (SELECT * EXCLUDE r FROM (SELECT *, rank() OVER (PARTITION BY rpc_url ORDER BY checked_at DESC) AS r FROM h
      WHERE checked_at > as_of - INTERVAL 1 HOUR AND checked_at <= as_of) WHERE r = 1)
"""

_PROBES = """
p AS (SELECT *, row_number() OVER (PARTITION BY rpc_url, run ORDER BY ts, event_id) AS seq FROM (
      SELECT 'https://rpc-' || (user_id % 20) || '.example' AS rpc_url, 'chain-' || (user_id % 5) AS chain_id,
      date_trunc('day', ts)::TIMESTAMP AS run, ts, event_id, event_type AS name, event_type <> 'error' AS success,
      CAST(round(value) AS BIGINT) AS response_ms FROM events)),
r AS (SELECT rpc_url, chain_id, run, count(*) AS checks, count(*) FILTER (success) AS passed,
      CAST(floor(sum(response_ms) / count(*)) AS BIGINT) AS response_time_ms,
      arg_min(event_id, seq) FILTER (success) AS height,
      coalesce(string_agg(name || ': timeout', '; ' ORDER BY seq) FILTER (NOT success), '') AS errors FROM p GROUP BY ALL),
rollup_ AS (SELECT *, CASE WHEN passed / checks >= 0.8 THEN 'healthy' WHEN passed / checks >= 0.5 THEN 'degraded' ELSE 'unhealthy' END AS status FROM r)
"""

_QUANT = ", ".join(
    f"round(quantile_cont({expr}, {q}), 3) AS {event}_{stat}"
    for event, expr in (("packet_recv", "recv"), ("write_ack", "wack"), ("packet_ack", "ack"))
    for stat, q in (("p5", 0.05), ("median", 0.5), ("p95", 0.95))
)
_VALUES = ", ".join(latency.VALUES)
_PACKETS = f"""{_STAR},
packets AS (SELECT 'nation-' || ns_key AS source_chain, 'nation-' || nc_key AS dest_chain, ns_name AS source_name, nc_name AS dest_name,
       l_linenumber AS line, CAST(l_quantity AS DOUBLE) AS recv, CAST(l_quantity + l_linenumber AS DOUBLE) AS wack,
       CAST(l_quantity + 2 * l_linenumber AS DOUBLE) AS ack FROM star)
"""
_LATENCY = f"""{_PACKETS},
lat AS MATERIALIZED (
  SELECT source_chain, dest_chain, source_name, dest_name, {_QUANT}, TIMESTAMP '2024-01-01' AS fetched_at FROM packets GROUP BY ALL
  UNION ALL
  SELECT source_chain, dest_chain, source_name, dest_name, {_QUANT}, TIMESTAMP '2024-01-02' AS fetched_at FROM packets WHERE line % 2 = 0 GROUP BY ALL),
ll AS (SELECT DISTINCT * EXCLUDE r FROM (SELECT *, rank() OVER (PARTITION BY source_chain, dest_chain ORDER BY fetched_at DESC) AS r FROM lat) WHERE r = 1)
"""
_CHAINS = """
c AS (SELECT 'nation-' || n_nationkey AS universal_chain_id, 'id-' || n_nationkey AS chain_id,
      CASE WHEN n_nationkey % 5 <> 0 THEN n_name ELSE '' END AS display_name, lower(replace(n_name, ' ', '-')) AS host FROM nation)
"""

_SECONDS = {p: f"INTERVAL {s} SECONDS" for p, s in col.PERIODS.items()}


def _in(p: str, ts: str = "timestamp") -> str:
    return f"({ts} > as_of - {_SECONDS[p]} AND {ts} <= as_of)"


def _prev(p: str) -> str:
    if p == "5m":
        return f"(timestamp > as_of - INTERVAL 1800 SECONDS AND timestamp <= as_of - {_SECONDS[p]})"
    return f"(timestamp > as_of - {_SECONDS[p]} - {_SECONDS[p]} AND timestamp <= as_of - {_SECONDS[p]})"


def _union(template, periods=col.RATE_PERIODS) -> str:
    return " UNION ALL ".join(template(p) for p in periods)


def _pct(now: str, before: str) -> str:
    return f"CASE WHEN {before} > 0 THEN (CAST({now} AS DOUBLE) - {before}) / {before} * 100 ELSE 0 END"


# ---------------------------------------------------------------------------------------------- registration


def _add(name: str, query, sql: str | None = None, on: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = f"WITH {on} {sql}" if on else sql


def _on(table, operator):
    """Query: ``operator(table, newest instant)``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir)
        if table is fx.transfers:
            return operator(t, fx.latest_transfer(spark, sf_dir))
        return operator(t, fx.latest(t, "checked_at" if table is fx.node_health else "timestamp"))

    return query


def _lat(operator):
    return lambda spark, sf_dir: operator(latency.latest_latency(fx.latency_data(spark, sf_dir)))


RT, STAR, NODES = fx.transfers_rt, fx.transfers, fx.node_health

# rates ------------------------------------------------------------------------------------------------------
_add("agg1_transfer_rates", _on(RT, rates.transfer_rates),
     f"SELECT 'all' AS period, count(*) AS count, max(as_of) AS calculated_at FROM t UNION ALL "
     + _union(lambda p: f"SELECT '{p}', count(*) FILTER ({_in(p)}), max(as_of) FROM t"), _RT)
_add("agg2_transfer_rates_legacy", _on(RT, rates.transfer_rates_legacy),
     f"SELECT count(*) FILTER ({_in('1m')}) AS per_minute, count(*) FILTER ({_in('1h')}) AS per_hour, "
     f"count(*) FILTER ({_in('1d')}) AS per_day, count(*) AS total FROM t", _RT)


def _change_sql(p: str) -> str:
    two = f"count(*) FILTER (timestamp > as_of - {_SECONDS[p]} - {_SECONDS[p]} AND timestamp <= as_of - {_SECONDS[p]})"
    return f"SELECT '{p}' AS period, count(*) FILTER ({_in(p)}) AS cur, {two} AS prev, count(*) FILTER ({_prev('5m')}) / 5 AS base FROM t"


_add("agg3_transfer_rate_changes", _on(RT, rates.transfer_rate_changes),
     f"SELECT period, cur AS current_count, prev AS prev_count, round(CASE WHEN period = '5m' THEN {_pct('cur', 'base')} ELSE {_pct('cur', 'prev')} END, 6) AS change_pct "
     f"FROM ({_union(_change_sql)})", _RT)
def _in_order(df: DataFrame) -> DataFrame:
    """An ordered result with the place of each row, numbered in the order that it comes in."""
    return df.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)  # ranked lists: a few rows


_add("top1_period_order", _on(RT, lambda t, a: _in_order(rates.order_periods(rates.transfer_rates(t, a))).select("place", "period", "count")),
     f"SELECT row_number() OVER (ORDER BY list_position(['30d', '14d', '7d', '1d', '1h', '5m', 'all'], period)) AS place, * FROM ("
     f"SELECT 'all' AS period, count(*) AS count FROM t UNION ALL " + _union(lambda p: f"SELECT '{p}', count(*) FILTER ({_in(p)}) FROM t") + ")", _RT)
_FLAGS = {"1m": "has_minute", "1h": "has_hour", "1d": "has_day", "7d": "has_7_days", "14d": "has_14_days", "30d": "has_30_days"}
_add("agg19_data_availability", _on(RT, rates.data_availability),
     "SELECT " + ", ".join(f"count(*) FILTER ({_in(p)}) > 0 AS {n}" for p, n in _FLAGS.items()) + f", count(*) FILTER ({_in('30d')}) > 0 AS served FROM t", _RT)

# wallets ----------------------------------------------------------------------------------------------------
_SR = lambda p: f"SELECT '{p}' AS period, count(DISTINCT sender) FILTER ({_in(p)}) AS s, count(DISTINCT receiver) FILTER ({_in(p)}) AS r FROM t"
_TOTAL = "greatest(s, r) + CAST(round(CAST(least(s, r) AS DECIMAL(18,1)) * 0.3, 0) AS BIGINT)"
_add("agg4_wallet_stats", _on(RT, wallets.wallet_stats),
     f"SELECT period, s AS unique_senders, r AS unique_receivers, {_TOTAL} AS unique_total, (SELECT max(as_of) FROM t) AS calculated_at FROM ({_union(_SR)})", _RT)
_EXACT = lambda p: f"SELECT '{p}' AS period, (SELECT count(DISTINCT sender) FROM t WHERE {_in(p)}) AS s, (SELECT count(DISTINCT receiver) FROM t WHERE {_in(p)}) AS r, (SELECT count(*) FROM (SELECT sender FROM t WHERE {_in(p)} UNION SELECT receiver FROM t WHERE {_in(p)})) AS a"
_add("agg5_wallet_stats_exact", _on(RT, wallets.wallet_stats_exact),
     f"SELECT period, s AS unique_senders, r AS unique_receivers, a AS unique_total FROM ({_union(_EXACT)})", _RT)
_add("agg6_wallet_estimates", _on(RT, wallets.wallet_estimates),
     "SELECT period, s AS unique_senders, r AS unique_receivers, a AS exact_total, "
     + ", ".join(f"s + r - least(s, r) * {p} // 100 AS estimate_{p}" for p in (25, 30, 70)) + f" FROM ({_union(_EXACT)})", _RT)


def _wallet_change_sql(p: str) -> str:
    both = lambda c: f"(SELECT count(*) FROM (SELECT sender FROM t WHERE {c} UNION SELECT receiver FROM t WHERE {c}))"
    side = lambda w, c: f"(SELECT count(DISTINCT {w}) FROM t WHERE {c})"
    now, before = _in(p), _prev(p)
    return (f"SELECT '{p}' AS period, {side('sender', now)} AS s, {side('receiver', now)} AS r, {both(now)} AS a, "
            f"{side('sender', before)} AS ps, {side('receiver', before)} AS pr, {both(before)} AS pa")


_five = lambda x: f"(CASE WHEN period = '5m' THEN {x} / 5 ELSE CAST({x} AS DOUBLE) END)"
_prev_total = "(ps + pr - least(ps, pr) * 30 // 100)"
_prev_base = f"(CASE WHEN period = '5m' THEN CASE WHEN ps > 0 AND pr > 0 THEN (ps + pr) / 5 * CAST(0.7 AS DOUBLE) ELSE 0 END ELSE CAST({_prev_total} AS DOUBLE) END)"
_add("agg7_wallet_rate_changes", _on(RT, wallets.wallet_rate_changes),
     f"SELECT period, s AS senders, r AS receivers, {_TOTAL} AS total, ps AS prev_senders, pr AS prev_receivers, {_prev_total} AS prev_total, "
     f"round({_pct('s', _five('ps'))}, 6) AS senders_change, round({_pct('r', _five('pr'))}, 6) AS receivers_change, "
     f"round({_pct('(' + _TOTAL + ')', _prev_base)}, 6) AS total_change, round({_pct('a', _five('pa'))}, 6) AS exact_change "
     f"FROM ({_union(_wallet_change_sql)})", _RT)
_add("agg20_tracked_totals", _on(RT, wallets.tracked_totals),
     f"SELECT s AS unique_senders, r AS unique_receivers, s + r AS total_tracked FROM ({_SR('30d')})", _RT)
_add("set2_distinct_wallets", _on(RT, lambda t, a: wallets.distinct_wallets(t, col.ago(a, 7 * col.DAY))),
     f"SELECT sender AS wallet FROM t WHERE {_in('7d')} UNION SELECT receiver FROM t WHERE {_in('7d')}", _RT)
_SHORT = lambda c, h, n: f"CASE WHEN length({c}) > {n} THEN {c}[:{h}] || '...' || right({c}, 6) ELSE {c} END"


def _active_sql(side: str, where: str, n: int, head: int, least: int) -> str:
    return (f"SELECT {side} AS address, {_SHORT(side, head, least)} AS display_address, count(*) AS count, max(timestamp) AS last_activity "
            f"FROM t WHERE {where} GROUP BY {side} ORDER BY count DESC, address LIMIT {n}")


for _side in ("sender", "receiver"):
    _add(f"agg16_active_{_side}s", _on(STAR, lambda t, a, s=_side: wallets.active_wallets(t, a, s)), _active_sql(_side, _in("30d"), 50, 8, 16), _TRANSFERS)
    _add(f"agg17_top_{_side}s", _on(STAR, lambda t, a, s=_side: wallets.top_wallets(t, col.ago(a, 90 * col.DAY), s, 25)),
         _active_sql(_side, "timestamp > as_of - INTERVAL 90 DAYS", 25, 6, 12), _TRANSFERS)
    _add(f"agg17_active_{_side}s_by_scale", _on(RT, lambda t, a, s=_side: wallets.active_wallets_by_scale(t, a, s)),
         "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY time_scale ORDER BY count DESC, address) AS rank FROM ("
         + _union(lambda p, s=_side: f"SELECT '{p}' AS time_scale, {s} AS address, count(*) FILTER ({_in(p)}) AS count, max(timestamp) FILTER ({_in('30d')}) AS last_activity FROM t GROUP BY {s}", col.SCALE_PERIODS)
         + ") WHERE count > 0) WHERE rank <= 10", _RT)
_add("prj8_shorten_address", lambda spark, sf_dir: STAR(spark, sf_dir).groupBy("receiver").agg(F.count("*").alias("n")).select(
        "n", "receiver", col.shorten_address(F.col("receiver")).alias("serving"), col.shorten_address(F.col("receiver"), 6, 6, 12).alias("legacy")),
     f"SELECT receiver, {_SHORT('receiver', 8, 16)} AS serving, {_SHORT('receiver', 6, 12)} AS legacy, count(*) AS n FROM t GROUP BY receiver", _TRANSFERS)

# routes -----------------------------------------------------------------------------------------------------
_ROUTE_KEYS = "source_chain, dest_chain, source_name, dest_name"


def _routes_sql(where: str, n: int) -> str:
    return (f"SELECT {_ROUTE_KEYS}, count(*) AS transfer_count, CAST(coalesce(sum(amount), 0) AS DECIMAL(28,2)) AS total_volume, max(timestamp) AS last_activity, "
            f"source_chain || '→' || dest_chain AS route FROM t WHERE {where} GROUP BY {_ROUTE_KEYS} ORDER BY transfer_count DESC, {_ROUTE_KEYS} LIMIT {n}")


_add("agg14_popular_routes", _on(STAR, routes.popular_routes), _routes_sql(_in("30d"), 50), _TRANSFERS)
_add("agg15_top_routes", _on(STAR, lambda t, a: routes.top_routes(t, col.ago(a, 365 * col.DAY), 100)), _routes_sql("timestamp > as_of - INTERVAL 365 DAYS", 100), _TRANSFERS)
_SCALED_ROUTES = ("SELECT *, source_chain || '→' || dest_chain AS route FROM (SELECT *, row_number() OVER (PARTITION BY time_scale ORDER BY transfer_count DESC, " + _ROUTE_KEYS + ") AS rank FROM ("
     + _union(lambda p: f"SELECT {_ROUTE_KEYS}, '{p}' AS time_scale, count(*) AS transfer_count FROM t WHERE {_in(p)} GROUP BY ALL", col.SCALE_PERIODS) + ")) WHERE rank <= 10")
_add("agg15_popular_routes_by_scale", _on(RT, routes.popular_routes_by_scale), _SCALED_ROUTES, _RT)

# flows ------------------------------------------------------------------------------------------------------
_FLOWS = f"""
o AS (SELECT source_chain, source_name, count(*) AS n, max(timestamp) AS m FROM t WHERE {_in('30d')} GROUP BY ALL),
i AS (SELECT dest_chain, dest_name, count(*) AS n, max(timestamp) AS m FROM t WHERE {_in('30d')} GROUP BY ALL),
flows AS (SELECT coalesce(source_chain, dest_chain) AS universal_chain_id, coalesce(source_name, dest_name) AS chain_name,
       coalesce(o.n, 0) AS outgoing_count, coalesce(i.n, 0) AS incoming_count, coalesce(i.n, 0) - coalesce(o.n, 0) AS net_flow,
       greatest(o.m, i.m) AS last_transfer_at, (SELECT max(as_of) FROM t) AS last_activity FROM o FULL JOIN i ON source_chain = dest_chain)
"""
_add("agg8_chain_flows", _on(RT, flows.chain_flows), "SELECT * FROM flows", f"{_RT},{_FLOWS}")
for _mode, _measure in (("total", "outgoing_count + incoming_count"), ("outgoing", "outgoing_count"), ("incoming", "incoming_count"), ("netflow", "net_flow")):
    _add(f"top2_chain_flow_{_mode}", _on(STAR, lambda t, a, m=_mode: flows.chain_flow_ranking(flows.chain_flows(t, a), m, 10)),
         f"SELECT * FROM flows ORDER BY {_measure} DESC, universal_chain_id, chain_name LIMIT 10", f"{_TRANSFERS},{_FLOWS}")
_add("agg18_flow_totals", _on(STAR, lambda t, a: flows.flow_totals(flows.chain_flows(t, a))),
     "SELECT CAST(sum(outgoing_count) AS BIGINT) AS total_outgoing, CAST(sum(incoming_count) AS BIGINT) AS total_incoming, "
     "(SELECT CAST(sum(outgoing_count) AS BIGINT) FROM flows) AS all_outgoing, (SELECT CAST(sum(incoming_count) AS BIGINT) FROM flows) AS all_incoming "
     "FROM (SELECT * FROM flows ORDER BY outgoing_count + incoming_count DESC, universal_chain_id, chain_name LIMIT 10)", f"{_TRANSFERS},{_FLOWS}")
_ENDS = "ends AS (SELECT *, source_chain AS cid, source_name AS cname, 1 AS o FROM t UNION ALL SELECT *, dest_chain, dest_name, 0 FROM t)"
_add("agg9_chain_flows_by_scale", _on(RT, flows.chain_flows_by_scale),
     "SELECT time_scale, chain_id, chain_name, outgoing_count, incoming_count, outgoing_count - incoming_count AS net_flow, rank FROM ("
     "SELECT *, row_number() OVER (PARTITION BY time_scale ORDER BY outgoing_count + incoming_count DESC, chain_id) AS rank FROM ("
     + _union(lambda p: f"SELECT '{p}' AS time_scale, cid AS chain_id, min(cname) AS chain_name, count(*) FILTER (o = 1) AS outgoing_count, count(*) FILTER (o = 0) AS incoming_count FROM ends WHERE {_in(p)} GROUP BY cid", col.SCALE_PERIODS)
     + ")) WHERE rank <= 10", f"{_RT},{_ENDS}")
_TOP_ASSETS = f"""{_ENDS},
ca AS (SELECT cid AS chain_id, asset, count(*) FILTER (o = 1) AS outgoing_count, count(*) FILTER (o = 0) AS incoming_count,
       CAST(sum(amount) AS DECIMAL(28,2)) AS total_volume, max(timestamp) AS last_activity FROM ends WHERE {_in('30d')} AND asset IS NOT NULL GROUP BY cid, asset),
top_assets AS (SELECT chain_id, rank, asset, outgoing_count, incoming_count, incoming_count - outgoing_count AS net_flow, total_volume,
       round(CAST(total_volume AS DOUBLE) / (outgoing_count + incoming_count), 6) AS average_amount,
       round(CASE WHEN sum(total_volume) OVER w > 0 THEN CAST(total_volume AS DOUBLE) / CAST(sum(total_volume) OVER w AS DOUBLE) * 100 ELSE 0 END, 6) AS percentage, last_activity
       FROM (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY outgoing_count + incoming_count DESC, asset) AS rank FROM ca) WHERE rank <= 5
       WINDOW w AS (PARTITION BY chain_id))
"""
_add("agg10_chain_top_assets", _on(STAR, flows.chain_top_assets), "SELECT * FROM top_assets", f"{_TRANSFERS},{_TOP_ASSETS}")

# assets -----------------------------------------------------------------------------------------------------
_ASSETS = f"""
av AS (SELECT asset AS asset_symbol, count(*) AS transfer_count, CAST(coalesce(sum(amount), 0) AS DECIMAL(28,2)) AS total_volume,
       CAST(coalesce(max(amount), 0) AS DECIMAL(28,2)) AS largest_transfer,
       round(coalesce(CAST(sum(amount) AS DOUBLE) / count(amount), 0), 6) AS average_amount, max(timestamp) AS last_activity
       FROM t WHERE {_in('30d')} AND asset IS NOT NULL GROUP BY asset ORDER BY transfer_count DESC, asset_symbol LIMIT 50)
"""
_ASSET_ROUTES = f"""
ar AS (SELECT asset, {_ROUTE_KEYS}, count(*) AS count, CAST(coalesce(sum(amount), 0) AS DECIMAL(28,2)) AS volume, max(timestamp) AS last_activity
       FROM t WHERE {_in('30d')} AND asset IS NOT NULL GROUP BY ALL),
arr AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY count DESC, {_ROUTE_KEYS}) AS rank FROM ar),
asset_routes AS (SELECT *, source_name || '→' || dest_name AS route,
       round(CASE WHEN sum(volume) OVER (PARTITION BY asset) > 0 THEN CAST(volume AS DOUBLE) / CAST(sum(volume) OVER (PARTITION BY asset) AS DOUBLE) * 100 ELSE 0 END, 6) AS percentage
       FROM arr WHERE rank <= {{n}})
"""
_add("agg11_asset_volumes", _on(STAR, assets.asset_volumes), "SELECT * FROM av", f"{_TRANSFERS},{_ASSETS}")
_add("prj3_asset_key", _on(RT, assets.asset_volumes), "SELECT * FROM av", f"{_RT},{_ASSETS}")
_add("agg12_asset_top_routes", _on(STAR, assets.asset_top_routes), "SELECT * FROM asset_routes", f"{_TRANSFERS},{_ASSET_ROUTES.format(n=5)}")
_add("win7_remaining_share", _on(RT, lambda t, a: ranking.remaining_share(assets.asset_top_routes(t, a, 10), 5)),
     "SELECT asset, round(coalesce(sum(percentage) FILTER (rank > 5), 0), 4) AS remaining_percentage FROM asset_routes GROUP BY asset", f"{_RT},{_ASSET_ROUTES.format(n=10)}")
_add("agg13_top_assets", _on(STAR, lambda t, a: assets.top_assets(t, col.ago(a, 365 * col.DAY), 20)),
     "SELECT token_symbol, count(*) AS transfer_count, CAST(sum(amount) AS DECIMAL(28,2)) AS total_volume FROM t WHERE timestamp > as_of - INTERVAL 365 DAYS "
     "AND token_symbol IS NOT NULL GROUP BY token_symbol ORDER BY transfer_count DESC, token_symbol LIMIT 20", _TRANSFERS)
_add("agg18_asset_totals", _on(STAR, lambda t, a: assets.asset_totals(assets.asset_volumes(t, a))),
     "SELECT count(*) AS total_assets, CAST(sum(total_volume) AS DECIMAL(28,2)) AS total_volume, CAST(sum(transfer_count) AS BIGINT) AS total_transfers, "
     "(SELECT count(*) FROM av) AS all_assets, (SELECT CAST(sum(total_volume) AS DECIMAL(28,2)) FROM av) AS all_volume, (SELECT CAST(sum(transfer_count) AS BIGINT) FROM av) AS all_transfers "
     "FROM (SELECT * FROM av ORDER BY transfer_count DESC, asset_symbol LIMIT 10)", f"{_TRANSFERS},{_ASSETS}")

# shares -----------------------------------------------------------------------------------------------------
_pc = lambda x, total: f"CAST(floor(CAST({x} AS DOUBLE) / {total} * 100 + 0.5) AS BIGINT)"
_add("win4_route_share", _on(STAR, lambda t, a: ranking.share_of_listed(
        routes.popular_routes(t, a).select("route", "transfer_count"), F.col("transfer_count"), 10, ["route"], 1)),
     f"SELECT route, transfer_count, {_pc('transfer_count', 'greatest(sum(transfer_count) OVER (), 1)')} AS share "
     f"FROM (SELECT * FROM ({_routes_sql(_in('30d'), 50)}) ORDER BY transfer_count DESC, route LIMIT 10)", _TRANSFERS)
_add("win4_asset_share", _on(STAR, lambda t, a: ranking.share_of_listed(
        assets.asset_volumes(t, a).select("asset_symbol", "transfer_count"), F.col("transfer_count"), 10, ["asset_symbol"])),
     f"SELECT asset_symbol, transfer_count, {_pc('transfer_count', 'sum(transfer_count) OVER ()')} AS share "
     "FROM (SELECT * FROM av ORDER BY transfer_count DESC, asset_symbol LIMIT 10)", f"{_TRANSFERS},{_ASSETS}")
_add("win4_chain_share", _on(RT, lambda t, a: ranking.share_of_listed(
        flows.chain_flows(t, a).select("universal_chain_id", "net_flow"), F.col("net_flow"), 5, ["universal_chain_id"])),
     f"SELECT universal_chain_id, net_flow, {_pc('abs(net_flow)', 'sum(abs(net_flow)) OVER ()')} AS share FROM (SELECT * FROM flows ORDER BY abs(net_flow) DESC, universal_chain_id LIMIT 5)", f"{_RT},{_FLOWS}")


def _wallet_share(t: DataFrame, as_of) -> DataFrame:
    return ranking.wallet_share(wallets.active_wallets(t, as_of, "sender"), wallets.active_wallets(t, as_of, "receiver"))


_LIST10 = lambda s: f"SELECT '{s}' AS side, {s} AS address, count(*) AS count FROM t WHERE {_in('30d')} GROUP BY {s} ORDER BY count DESC, address LIMIT 10"
_add("win5_wallet_share", _on(RT, _wallet_share),
     f"SELECT side, address, count, {_pc('count', '(SELECT greatest(max(s), 1) FROM (SELECT sum(count) AS s FROM both_ GROUP BY side))')} AS share FROM both_",
     f"{_RT}, both_ AS (SELECT * FROM ({_LIST10('sender')}) UNION ALL SELECT * FROM ({_LIST10('receiver')}))")
_add("win6_relative_routes", _on(STAR, lambda t, a: ranking.relative_to_max(routes.popular_routes(t, a).select("route", "transfer_count"), "transfer_count")),
     f"SELECT route, transfer_count, round(transfer_count / max(transfer_count) OVER (), 6) AS relative FROM ({_routes_sql(_in('30d'), 50)})", _TRANSFERS)
_add("top5_recent_transfers", lambda spark, sf_dir: ranking.recent_transfers(RT(spark, sf_dir)).select("packet_hash", "timestamp", "amount"),
     "SELECT packet_hash, timestamp, amount FROM t ORDER BY timestamp DESC, packet_hash LIMIT 1000", _RT)

# latency ----------------------------------------------------------------------------------------------------
_add("agg25_latency_percentiles", lambda spark, sf_dir: latency.latency_percentiles(fx.packets(spark, sf_dir)),
     f"SELECT source_chain, dest_chain, source_name, dest_name, {_QUANT} FROM packets GROUP BY ALL", _PACKETS)
_add("jn2_latest_latency", _lat(lambda l: l), "SELECT * FROM ll", _LATENCY)
_FLAT = [f"{e}.{s} AS {e}_{s}" for e in latency.EVENTS for s in latency.STATS]
_add("doc3_latency_document", lambda spark, sf_dir: latency.latency_document(fx.latency_data(spark, sf_dir)).selectExpr("source_chain", "dest_chain", "source_name", "dest_name", *_FLAT),
     f"SELECT source_chain, dest_chain, source_name, dest_name, {_VALUES} FROM ll", _LATENCY)
_add("top3_latency_ranking", _lat(latency.latency_ranking), "SELECT * FROM ll ORDER BY packet_ack_median, source_chain, dest_chain LIMIT 4", _LATENCY)
_add("top3_latency_ranking_of_source", _lat(lambda l: latency.latency_ranking(l, source="NATION_7")),
     "SELECT * FROM ll WHERE source_name = 'NATION_7' ORDER BY packet_ack_median, source_chain, dest_chain LIMIT 12", _LATENCY)
_add("set3_latency_endpoints", _lat(lambda l: latency.latency_endpoints(l, "NATION_7")),
     "SELECT DISTINCT 'source' AS kind, source_name AS name FROM ll WHERE source_name <> '' UNION SELECT DISTINCT 'destination', dest_name FROM ll WHERE source_name = 'NATION_7' AND dest_name <> ''", _LATENCY)
_MELT = " UNION ALL ".join(f"SELECT source_chain, dest_chain, '{e}' AS event, '{s}' AS stat, {e}_{s} AS value FROM ll" for e in latency.EVENTS for s in latency.STATS)
_add("scl1_latency_scale", _lat(latency.latency_scale),
     "SELECT source_chain, dest_chain, event, stat, value, lo AS route_min, hi AS route_max, "
     "round(CASE WHEN hi > lo THEN sqrt(value - lo) / sqrt(hi - lo) * 100 ELSE 0 END, 6) AS position, "
     "round(greatest(0, glo - greatest((ghi - glo) * CAST(0.05 AS DOUBLE), ghi * CAST(0.01 AS DOUBLE))), 6) AS global_min, "
     "round(ghi + greatest((ghi - glo) * CAST(0.05 AS DOUBLE), ghi * CAST(0.01 AS DOUBLE)), 6) AS global_max FROM ("
     "SELECT *, min(value) OVER r AS lo, max(value) OVER r AS hi, min(value) OVER () AS glo, max(value) OVER () AS ghi FROM melt WINDOW r AS (PARTITION BY source_chain, dest_chain))",
     f"{_LATENCY}, melt AS ({_MELT})")
_PAIRS = "n AS (SELECT DISTINCT universal_chain_id AS id, coalesce(nullif(display_name, ''), chain_id) AS name FROM c), pairs AS (SELECT a.id AS source_chain, a.name AS source_name, b.id AS dest_chain, b.name AS dest_name FROM n a, n b WHERE a.id <> b.id)"
_add("jn4_chain_pairs", lambda spark, sf_dir: latency.chain_pairs(fx.chains(spark, sf_dir)), "SELECT * FROM pairs", f"{_CHAINS},{_PAIRS}")
_add("jn5_latency_for_pairs", lambda spark, sf_dir: latency.latency_for_pairs(latency.chain_pairs(fx.chains(spark, sf_dir)), latency.latest_latency(fx.latency_data(spark, sf_dir))),
     f"SELECT p.*, {_VALUES} FROM pairs p JOIN ll USING (source_chain, dest_chain)", f"{_LATENCY},{_CHAINS},{_PAIRS}")
_add("jn7_chain_names", lambda spark, sf_dir: enrich.with_chain_names(STAR(spark, sf_dir), fx.chains(spark, sf_dir)).groupBy("source_label", "dest_label").agg(F.count("*").alias("n")),
     "SELECT coalesce(nullif(a.display_name, ''), a.chain_id, source_chain) AS source_label, coalesce(nullif(b.display_name, ''), b.chain_id, dest_chain) AS dest_label, count(*) AS n "
     "FROM t LEFT JOIN c a ON source_chain = a.universal_chain_id LEFT JOIN c b ON dest_chain = b.universal_chain_id GROUP BY 1, 2", f"{_TRANSFERS},{_CHAINS}")

# health -----------------------------------------------------------------------------------------------------
_BY_STATUS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_nodes" for s in health.STATUSES)
_SUMMARY = f"SELECT count(*) AS total_nodes, {_BY_STATUS}, round(coalesce(avg(response_time_ms) FILTER (status IN ('healthy', 'degraded') AND response_time_ms > 0), 0), 6) AS avg_response_time FROM latest"
_add("jn3_latest_node_health", _on(NODES, health.latest_node_health), "SELECT * EXCLUDE as_of FROM latest", _NODES)
_add("agg21_node_health_summary", _on(NODES, health.node_health_summary), _SUMMARY, _NODES)
_add("scl2_health_percentage", _on(NODES, lambda h, a: health.health_percentage(health.node_health_summary(h, a))),
     f"SELECT CAST(CASE WHEN total_nodes > 0 THEN floor(healthy_nodes / total_nodes * 100 + 0.5) ELSE 0 END AS BIGINT) AS health_percentage FROM ({_SUMMARY})", _NODES)
_add("agg22_chain_health", _on(NODES, health.chain_health),
     f"SELECT *, round(healthy_nodes / total_nodes * 100, 6) AS health_score FROM (SELECT chain_id, min(chain_name) AS chain_name, count(*) AS total_nodes, {_BY_STATUS}, "
     "round(avg(response_time_ms), 6) AS avg_response_time, round(avg(uptime), 6) AS uptime FROM latest GROUP BY chain_id)", _NODES)
_add("agg19_node_availability", _on(NODES, health.node_availability),
     "SELECT " + ", ".join(f"count(*) FILTER (checked_at > as_of - INTERVAL {s} SECONDS AND checked_at <= as_of) > 0 AS {n}" for n, s in
     {"has_hour": 3600, "has_day": col.DAY, "has_7_days": 7 * col.DAY, "has_14_days": 14 * col.DAY, "has_30_days": 30 * col.DAY}.items()) + " FROM h", _NODES)
_add("agg23_probe_rollup", lambda spark, sf_dir: health.probe_rollup(fx.probes(spark, sf_dir)),
     "SELECT rpc_url, chain_id, run, checks, passed, status, response_time_ms, CASE WHEN status <> 'unhealthy' THEN height END AS latest_block_height, "
     "CASE status WHEN 'degraded' THEN 'Partial failure: ' || (checks - passed) || '/' || checks || ' checks failed' "
     "WHEN 'unhealthy' THEN CASE WHEN errors <> '' THEN errors ELSE 'Failed ' || (checks - passed) || '/' || checks || ' health checks' END END AS error_message FROM rollup_", _PROBES)
_add("agg24_probe_status_counts", lambda spark, sf_dir: health.probe_status_counts(fx.probes(spark, sf_dir)),
     f"SELECT run, count(*) AS total_nodes, {_BY_STATUS} FROM rollup_ GROUP BY run", _PROBES)
_URLS = "urls AS (SELECT universal_chain_id, unnest(['https://' || host || '.example/rpc', 'https://' || host || '.example:9090/grpc', 'https://' || host || '.example/rest/v1']) AS rpc_url FROM c), ep AS (SELECT *, NOT regexp_matches(lower(rpc_url), 'grpc|/rest/|rest\\.|api\\.|/api/') AS is_rpc FROM urls)"
_add("prj12_rpc_endpoints", lambda spark, sf_dir: health.rpc_endpoints(fx.chains(spark, sf_dir)), "SELECT * FROM ep", f"{_CHAINS},{_URLS}")
_add("agg24_endpoint_counts", lambda spark, sf_dir: health.endpoint_counts(fx.chains(spark, sf_dir)),
     "SELECT count(*) AS total_endpoints, count(*) FILTER (is_rpc) AS rpc_endpoints, count(*) FILTER (NOT is_rpc) AS filtered_endpoints FROM ep", f"{_CHAINS},{_URLS}")
_add("win3_node_uptime", lambda spark, sf_dir: health.node_uptime(NODES(spark, sf_dir)),
     "SELECT rpc_url, checked_at, status, coalesce(lag(CASE WHEN status <> 'unhealthy' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY rpc_url ORDER BY checked_at, latest_block_height), 0) AS uptime, "
     "round(avg(CASE WHEN status <> 'unhealthy' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY rpc_url ORDER BY checked_at RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 6) AS uptime_24h FROM h", _NODES)
_NODE_ORDER = {
    "chain": "chain_name", "status": "list_position(['healthy', 'degraded', 'unhealthy'], status)",
    "response": "nullif(response_time_ms, 0) ASC NULLS LAST", "uptime": "uptime DESC",
}
for _sort, _status in [*((s, "all") for s in _NODE_ORDER), ("response", "healthy"), ("uptime", "unhealthy")]:
    _add(f"top4_node_list_by_{_sort}" + (f"_of_{_status}" if _status != "all" else ""),
         _on(NODES, lambda h, a, s=_sort, k=_status: _in_order(health.node_list(health.latest_node_health(h, a), k, s)).select("place", "rpc_url", "status", "response_time_ms", "uptime")),
         f"SELECT row_number() OVER (ORDER BY {_NODE_ORDER[_sort]}, rpc_url, checked_at) AS place, rpc_url, status, response_time_ms, uptime FROM latest"
         + (f" WHERE status = '{_status}'" if _status != "all" else ""), _NODES)

# operations -------------------------------------------------------------------------------------------------


def _status(t: DataFrame, as_of) -> DataFrame:
    """AGG26 over the stored summaries of a refresh."""
    out = shared_path(t.sparkSession, "refresh")
    refresh_analytics(t, as_of, out)
    s = read_all_summaries(t.sparkSession, out)
    return ops.analytics_status(s["transfer_rates"], s["wallet_stats"], s["popular_routes"], s["chain_flows"], s["asset_volumes"], as_of)


_add("agg26_analytics_status", _on(RT, _status),
     f"SELECT view_name, record_count, (SELECT max(as_of) FROM t) AS last_updated, CAST(0 AS DOUBLE) AS age_seconds FROM ("
     f"SELECT 'transfer_rates' AS view_name, count(*) AS record_count FROM t UNION ALL SELECT 'wallet_stats', {_TOTAL} FROM ({_SR('30d')}) "
     f"UNION ALL SELECT 'popular_routes', count(*) FROM ({_routes_sql(_in('30d'), 50)}) UNION ALL SELECT 'chain_flows', count(*) FROM flows "
     f"UNION ALL SELECT 'asset_volumes', count(*) FROM av)", f"{_RT},{_FLOWS},{_ASSETS}")
_add("agg27_load_progress", lambda spark, sf_dir: ops.load_progress(STAR(spark, sf_dir)),
     "SELECT 'transfers' AS table_name, CAST(5500000 AS BIGINT) AS estimated_rows, count(*) AS actual_rows, CAST(CAST(count(*) AS DECIMAL(20,4)) * 100 / 5500000 AS DECIMAL(12,2)) AS progress_pct FROM t", _TRANSFERS)
_SCEN = ", ".join(f"('{k}', {v})" for k, v in ops.SCENARIOS.items())
_add("agg28_capacity_report", lambda spark, sf_dir: ops.capacity_report(STAR(spark, sf_dir)),
     f"SELECT scenario, CAST(transfers AS BIGINT) AS transfers, CAST(transfers * 800 AS BIGINT) AS size_bytes, round(transfers * 800 / 1073741824.0::DOUBLE, 6) AS size_gb, round(transfers * 800 / 1099511627776.0::DOUBLE, 6) AS size_tb, "
     "CASE WHEN n > 1000000 THEN 'large_scale_optimized' ELSE 'medium_scale' END AS scale_status, "
     "CASE WHEN n > 100000000 THEN 'partition_history' WHEN n > 10000000 THEN 'analyze_regularly' ELSE 'none_needed' END AS recommendation "
     f"FROM (SELECT 'current' AS scenario, count(*) AS transfers FROM t UNION ALL SELECT * FROM (VALUES {_SCEN})), (SELECT count(*) AS n FROM t)", _TRANSFERS)
_add("agg29_log_rollup", lambda spark, sf_dir: ops.log_rollup(fx.logs(spark, sf_dir), "1 hour"),
     "SELECT w AS window_start, component, level, count(*) AS entries, CASE WHEN count(*) <= 3 THEN string_agg(m, '; ' ORDER BY ts, event_id) "
     "ELSE arg_min(m, event_id) || ' ... (+' || (count(*) - 2) || ' similar) ... ' || arg_max(m, event_id) END AS summary FROM ("
     "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS component, ['DEBUG', 'INFO', 'WARN', 'ERROR'][CAST(event_id % 4 + 1 AS INT)] AS level, props AS m, ts, event_id FROM events) GROUP BY ALL")

# sources, sinks and projections -----------------------------------------------------------------------------
_add("src5_read_forward", lambda spark, sf_dir: cursors.read_forward(RT(spark, sf_dir), "5".rjust(20, "0"), 100)[0].select("packet_hash", "sort_order"),
     "SELECT packet_hash, sort_order FROM t WHERE sort_order > lpad('5', 20, '0') ORDER BY sort_order LIMIT 100", _RT)
_add("src6_read_backward", _on(RT, lambda t, a: cursors.read_backward(t, "500".rjust(20, "0"), a, 30).select("packet_hash", "sort_order")),
     "SELECT packet_hash, sort_order FROM t WHERE sort_order < lpad('500', 20, '0') AND timestamp >= as_of - INTERVAL 30 DAYS", _RT)
_add("src7_filter_network", lambda spark, sf_dir: enrich.filter_network(RT(spark, sf_dir), ["chain-1", "chain-6"]).select("packet_hash", "source_chain", "dest_chain"),
     "SELECT packet_hash, source_chain, dest_chain FROM t WHERE source_chain IN ('chain-1', 'chain-6') OR dest_chain IN ('chain-1', 'chain-6')", _RT)
_add("src8_cursors", lambda spark, sf_dir: cursors.latest_cursor(RT(spark, sf_dir)).select(F.lit("latest").alias("which"), "cursor").unionByName(
        cursors.earliest_cursor(RT(spark, sf_dir)).select(F.lit("earliest").alias("which"), "cursor")),
     "SELECT 'latest' AS which, arg_max(sort_order, ingest_seq) AS cursor FROM t UNION ALL SELECT 'earliest', arg_min(sort_order, ingest_seq) FROM t", _RT)
_add("src9_needs_backfill", lambda spark, sf_dir: cursors.needs_backfill(RT(spark, sf_dir)),
     "SELECT count(*) > 0 AND count(sort_order) > 0 AS needed, 'rows to extend' AS reason FROM t", _RT)


def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The un-deduplicated rows, written once as they arrive, appended to the even orders already stored."""
    path = shared_path(spark, "arrived")
    fx.transfers_raw(spark, sf_dir).write.parquet(path)
    raw = spark.read.parquet(path)
    stored = raw.filter("rn = 1").filter(F.split_part("packet_hash", F.lit("-"), F.lit(1)).cast("long") % 2 == 0)
    return sinks.append_transfers(stored, raw, [F.col("rn")]).drop("rn")


_add("snk1_append_transfers", _append, "SELECT * EXCLUDE (as_of, asset, rn) FROM t", _TRANSFERS)


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = fx.latency_data(spark, sf_dir)
    keys = ["source_chain", "dest_chain", "fetched_at"]
    return sinks.append_snapshot(data.filter(F.col("fetched_at") == F.lit(fx.FETCHED[0])), data, keys)


_add("snk7_append_snapshot", _snapshot, "SELECT * FROM lat", _LATENCY)
_add("snk3_transfer_messages", lambda spark, sf_dir: sinks.transfer_messages(RT(spark, sf_dir).select("packet_hash", "source_chain", "dest_chain")),
     """SELECT '{"type":"transfers","data":[{"packet_hash":"' || packet_hash || '","source_chain":"' || source_chain || '","dest_chain":"' || dest_chain || '"}]}' AS value FROM t""", _RT)
_add("prj11_filter_chains", lambda spark, sf_dir: enrich.filter_chains(RT(spark, sf_dir), "chain-2", "chain-3").select("packet_hash").unionAll(
        enrich.filter_chains(RT(spark, sf_dir), "chain-4").select("packet_hash")),
     "SELECT packet_hash FROM t WHERE source_chain = 'chain-2' AND dest_chain = 'chain-3' UNION ALL SELECT packet_hash FROM t WHERE source_chain = 'chain-4' OR dest_chain = 'chain-4'", _RT)
_add("prj9_rfc3339", _on(RT, lambda t, a: t.groupBy("source_chain").agg(col.rfc3339(F.max("timestamp")).alias("last_activity"))),
     "SELECT source_chain, strftime(max(timestamp), '%Y-%m-%dT%H:%M:%SZ') AS last_activity FROM t GROUP BY source_chain", _RT)


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").cast("string").alias("base_amount"),
        (F.col("l_linenumber") % 7).cast("int").alias("base_token_decimals"))
    return enrich.scale_amount(raw).groupBy("base_token_decimals").agg(F.sum("amount").cast("decimal(38,8)").alias("amount"), F.count(F.when(F.col("amount_overflow"), 1)).alias("overflows"))


_POWERS = " ".join(f"WHEN {i} THEN CAST({10**-i:.8f} AS DECIMAL(9,8))" for i in range(7))
_add("prj4_scale_amount", _scaled,
     "SELECT places AS base_token_decimals, CAST(CAST(sum(cents) AS DECIMAL(22,0)) * CASE places " + _POWERS + " END AS DECIMAL(38,8)) AS amount, CAST(0 AS BIGINT) AS overflows "
     "FROM (SELECT CAST(l_linenumber % 7 AS INT) AS places, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) GROUP BY places")


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = STAR(spark, sf_dir).withColumn("sender", F.sha1("sender")).withColumn("receiver", F.concat(F.lit("0x"), F.upper(F.sha1("receiver"))))
    return enrich.build_address_dim(t, fx.chains(spark, sf_dir))


_add("prj13_address_dim", _addresses)


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire documents, through JSON text as a source reads them, to enriched rows."""
    text = fx.transfer_docs(spark, sf_dir).select(F.to_json(F.struct("data", "errors")).alias("json"))
    docs = text.select(F.from_json("json", schemas.TRANSFER_DOCS).alias("d")).select("d.*")
    return enrich.enrich_transfers(enrich.scale_amount(enrich.to_transfer_model(transfer_rows(docs))))


_DOCS = f"""{_RT},
ok AS (SELECT *, ingest_seq // 50 AS response FROM t WHERE (ingest_seq // 50) % 10 <> 9)
"""
_add("src2_transfer_docs", lambda spark, sf_dir: _model(spark, sf_dir).select("packet_hash", "sort_order", "token_symbol", "base_amount", "timestamp"),
     "SELECT packet_hash, sort_order, token_symbol, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS base_amount, timestamp FROM ok JOIN events ON event_id = ingest_seq", _DOCS)
_add("prj1_transfer_model", lambda spark, sf_dir: _model(spark, sf_dir).select(
        "packet_hash", F.size("quote_wrapping").alias("n_wrappings"), F.col("base_wrapping")[0]["unwrapped_chain"].alias("unwrapped_chain"),
        F.col("base_wrapping")[0]["wrapped_chain"].alias("wrapped_chain"), F.col("quote_wrapping")[0]["unwrapped_address"].alias("unwrapped_address"), "canonical_token_symbol"),
     "SELECT packet_hash, CAST(1 AS INT) AS n_wrappings, source_chain AS unwrapped_chain, dest_chain AS wrapped_chain, to_hex(ingest_seq) AS unwrapped_address, token_symbol AS canonical_token_symbol FROM ok", _DOCS)
_add("prj5_enrich_transfers", lambda spark, sf_dir: _model(spark, sf_dir).select("packet_hash", "tx_hash", "is_testnet_transfer", "formatted_timestamp", "route_key", "source_display_name", "dest_display_name"),
     "SELECT packet_hash, CASE WHEN ingest_seq % 3 = 0 THEN packet_hash ELSE 'tx-' || ingest_seq END AS tx_hash, user_id % 2 = 1 OR ingest_seq % 5 = 3 AS is_testnet_transfer, "
     "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS formatted_timestamp, source_chain || '_' || dest_chain AS route_key, source_name AS source_display_name, dest_name AS dest_display_name FROM ok JOIN events ON event_id = ingest_seq", _DOCS)
_add("prj6_broadcast", lambda spark, sf_dir: enrich.to_broadcast(_model(spark, sf_dir)).select("packet_hash", "senderDisplay", "receiverDisplay", F.col("source_chain.chain_id").alias("source_chain_id")),
     "SELECT packet_hash, CASE WHEN ingest_seq % 2 = 0 THEN 'shown-' || user_id ELSE sender END AS senderDisplay, receiver AS receiverDisplay, 'id-' || source_chain AS source_chain_id FROM ok JOIN events ON event_id = ingest_seq", _DOCS)
_FACT = ("SELECT packet_hash, sort_order, source_chain, dest_chain, source_name, dest_name, sender, receiver, CAST(amount AS DECIMAL(28,2)) AS amount, "
         "token_symbol, token_symbol AS canonical_token_symbol, timestamp FROM ok")
_add("snk2_fact_rows", lambda spark, sf_dir: enrich.to_fact_rows(_model(spark, sf_dir)).drop("created_at").withColumn("amount", F.col("amount").cast("decimal(28,2)")), _FACT, _DOCS)


#: A file of responses is some 1.3 MB, 26 MB as text.
RESPONSES_PER_FILE = 500


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1-4: responses in files, streamed twice through the fan-out in two batches, and the stored facts read back.

    A compressed file is read by one task, so files are small and grow in number with the input.
    """
    base = shared_path(spark, "ingest")
    files = max(4, math.ceil(fx.read(spark, sf_dir, "events").count() / (fx.PER_RESPONSE * RESPONSES_PER_FILE)))
    fx.transfer_docs(spark, sf_dir, tasks=files).write.option("ignoreNullFields", "true").option("compression", "gzip").json(f"{base}/in")
    half = (sum(name.endswith(".json.gz") for name in children(spark, f"{base}/in")) + 1) // 2
    for run in ("first", "again"):
        stream = ingest.ingest_stream(spark, f"{base}/in", max_files=max(half, 1), wrappings=False)
        ingest.start_ingest(stream, f"{base}/store", f"{base}/messages-{run}", f"{base}/checkpoint-{run}").awaitTermination()
    facts = spark.read.parquet(f"{base}/store/facts")
    return facts.drop("created_at", "date").withColumn("amount", F.col("amount").cast("decimal(28,2)"))


_add("str2_ingest_fan_out", _ingested, _FACT, _DOCS)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: the message of every transfer, parsed back."""
    value = ingest.message_stream(_model(spark, sf_dir))
    row = F.from_json("value", "type string, data array<struct<packet_hash: string, routeKey: string>>").alias("m")
    return value.select(row).select("m.type", F.col("m.data")[0]["packet_hash"].alias("packet_hash"), F.col("m.data")[0]["routeKey"].alias("route_key"))


_add("str4_messages", _messages, "SELECT 'transfers' AS type, packet_hash, source_chain || '_' || dest_chain AS route_key FROM ok", _DOCS)


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR6: five-minute counts kept by a stream in update mode, read back."""
    base = shared_path(spark, "windowed")
    rt = RT(spark, sf_dir).select("packet_hash", "timestamp", "amount")
    rt.repartition(4, "packet_hash").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rt.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    counts = ingest.windowed_rates_stream(stream)
    write = counts.writeStream.outputMode("update").foreachBatch(ingest.upsert_partials(f"{base}/partials"))
    write.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ingest.read_partials(spark, f"{base}/partials").withColumn("volume", F.col("volume").cast("decimal(28,2)"))


_add("str6_windowed_stream", _windowed,
     "SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS window_start, count(*) AS n, CAST(sum(amount) AS DECIMAL(28,2)) AS volume FROM t GROUP BY 1", _RT)


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6: all summaries written as a version; the report, and one summary read back through the pointer."""
    t, out = RT(spark, sf_dir), shared_path(spark, "refresh")
    report = refresh_analytics(t, fx.latest(t), out).select("view", "rows")
    again = read_summary(spark, out, "chain_flows").agg(F.count("*").alias("rows")).select(F.lit("read back: chain_flows").alias("view"), "rows")
    return report.unionByName(again)


_NROWS = lambda v, q: f"SELECT '{v}' AS view, count(*) AS rows FROM ({q})"
_add("snk6_refresh_analytics", _refreshed,
     "SELECT 'transfer_rates' AS view, CAST(7 AS BIGINT) AS rows UNION ALL SELECT 'wallet_stats', 6 UNION ALL "
     + " UNION ALL ".join([_NROWS("popular_routes", _routes_sql(_in("30d"), 50)), _NROWS("chain_flows", "SELECT * FROM flows"), _NROWS("read back: chain_flows", "SELECT * FROM flows"), _NROWS("asset_volumes", "SELECT * FROM av"),
                           *[_NROWS(f"active_{s}s", _active_sql(s, _in("30d"), 50, 8, 16)) for s in ("sender", "receiver")]]), f"{_RT},{_FLOWS},{_ASSETS}")

# documents --------------------------------------------------------------------------------------------------
_rfc = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def _unnested(document, name: str, outer: list[str]):
    """Query: the rows inside a document's nested list, beside the named outer columns."""
    return _on(STAR, lambda t, a: document(t, a).select(*outer, F.explode(name).alias("x")).select(*outer, "x.*"))


_add("doc1_chain_flow_document",
     _on(STAR, lambda t, a: documents.chain_flow_document(t, a).withColumnRenamed("net_flow", "chain_net_flow").select(
         "universal_chain_id", "chain_name", "chain_net_flow", F.explode("top_assets").alias("x")).select("universal_chain_id", "chain_name", "chain_net_flow", "x.*")),
     f"SELECT universal_chain_id, chain_name, f.net_flow AS chain_net_flow, a.* EXCLUDE (chain_id) REPLACE ({_rfc('a.last_activity')} AS last_activity) "
     "FROM (SELECT * FROM flows ORDER BY outgoing_count + incoming_count DESC, universal_chain_id, chain_name LIMIT 10) f JOIN top_assets a ON universal_chain_id = chain_id",
     f"{_TRANSFERS},{_FLOWS},{_TOP_ASSETS}")
_add("doc2_asset_document", _unnested(documents.asset_document, "top_routes", ["asset_symbol", "transfer_count", "total_volume"]),
     f"SELECT asset_symbol, transfer_count, total_volume, r.* EXCLUDE (asset) REPLACE ({_rfc('r.last_activity')} AS last_activity) "
     "FROM (SELECT * FROM av ORDER BY transfer_count DESC, asset_symbol LIMIT 10) a JOIN asset_routes r ON asset_symbol = asset",
     f"{_TRANSFERS},{_ASSETS},{_ASSET_ROUTES.format(n=5)}")
_CHAIN_HEALTH = (f"SELECT *, round(healthy_nodes / total_nodes * 100, 6) AS health_score FROM (SELECT chain_id, min(chain_name) AS chain_name, count(*) AS total_nodes, {_BY_STATUS}, "
     "round(avg(response_time_ms), 6) AS avg_response_time, round(avg(uptime), 6) AS uptime FROM latest GROUP BY chain_id)")
_add("doc4_node_health_document", _on(NODES, lambda h, a: documents.node_health_document(h, a).select(
        F.size("nodes").alias("listed_nodes"), F.explode("chain_stats").alias("chain_id", "s")).select("listed_nodes", "chain_id", "s.*")),
     f"SELECT (SELECT CAST(count(*) AS INT) FROM latest) AS listed_nodes, * FROM ({_CHAIN_HEALTH})", _NODES)


def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = RT(spark, sf_dir)
    doc = documents.dashboard(t, fx.latency_data(spark, sf_dir), NODES(spark, sf_dir), fx.latest(t))
    return doc.select(F.to_json("doc").alias("doc"))


_add("doc5_dashboard", _dashboard)


def _dashboard_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section of the whole document, read back from its JSON."""
    part = "struct<popularRoutesTimeScale: map<string, array<struct<rank: int, source_chain: string, dest_chain: string, transfer_count: bigint>>>>"
    parsed = _dashboard(spark, sf_dir).select(F.from_json("doc", part).alias("d"))
    lists = parsed.select(F.explode("d.popularRoutesTimeScale").alias("time_scale", "rows"))
    return lists.select("time_scale", F.explode("rows").alias("x")).select("time_scale", "x.*")


_add("doc5_dashboard_routes", _dashboard_routes, f"SELECT time_scale, rank, source_chain, dest_chain, transfer_count FROM ({_SCALED_ROUTES})", _RT)


def _from_cube(section):
    """Query: a section of the dashboard as its cube gives it."""
    return _on(RT, lambda t, a: section(cube(t, a)))


#: Sections of the dashboard beside the queries of the operators that they stand for, on the same rows.
for _name, _section, _same in [
    ("rate_changes", lambda c: c.transfer_rate_changes(), "agg3_transfer_rate_changes"),
    ("wallet_changes", lambda c: c.wallet_rate_changes(), "agg7_wallet_rate_changes"),
    ("routes_by_scale", lambda c: c.popular_routes_by_scale(), "agg15_popular_routes_by_scale"),
    ("senders_by_scale", lambda c: c.active_wallets_by_scale("sender"), "agg17_active_senders_by_scale"),
    ("receivers_by_scale", lambda c: c.active_wallets_by_scale("receiver"), "agg17_active_receivers_by_scale"),
    ("chain_flows", lambda c: c.chain_flows(), "agg8_chain_flows"),
    ("flows_by_scale", lambda c: c.chain_flows_by_scale(), "agg9_chain_flows_by_scale"),
    ("data_availability", lambda c: c.data_availability(), "agg19_data_availability"),
]:
    _add(f"doc5_{_name}", _from_cube(_section), ORACLES[_same])
_add("doc5_popular_routes", _from_cube(lambda c: c.popular_routes()), _routes_sql(_in("30d"), 50), _RT)
_add("doc5_asset_volumes", _from_cube(lambda c: c.asset_volumes()), "SELECT * FROM av", f"{_RT},{_ASSETS}")
_add("doc5_chain_top_assets", _from_cube(lambda c: c.chain_top_assets()), "SELECT * FROM top_assets", f"{_RT},{_TOP_ASSETS}")
_add("doc5_asset_top_routes", _from_cube(lambda c: c.asset_top_routes()), "SELECT * FROM asset_routes", f"{_RT},{_ASSET_ROUTES.format(n=5)}")
for _side in ("sender", "receiver"):
    _add(f"doc5_active_{_side}s", _from_cube(lambda c, s=_side: c.active_wallets(s)), _active_sql(_side, _in("30d"), 50, 8, 16), _RT)


def _flow_message(t: DataFrame, as_of) -> DataFrame:
    """The chain flows and their top assets as a document in the message envelope."""
    top = F.transform("top_assets", lambda x: F.struct(x["rank"].alias("rank"), x["asset"].alias("asset"), x["net_flow"].alias("net_flow")))
    rows = documents.chain_flow_document(t, as_of).select("universal_chain_id", "outgoing_count", "incoming_count", "net_flow", top.alias("top_assets"))
    return sinks.chart_message(rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("doc")))


_add("snk4_chart_message", _on(RT, _flow_message),
     """SELECT '{"type":"chartData","data":[' || string_agg('{"universal_chain_id":"' || universal_chain_id || '","outgoing_count":' || outgoing_count || ',"incoming_count":' || incoming_count
     || ',"net_flow":' || f.net_flow || ',"top_assets":[' || a.list || ']}', ',' ORDER BY universal_chain_id) || ']}' AS value
     FROM (SELECT * FROM flows ORDER BY outgoing_count + incoming_count DESC, universal_chain_id, chain_name LIMIT 10) f
     JOIN (SELECT chain_id, string_agg('{"rank":' || rank || ',"asset":"' || asset || '","net_flow":' || net_flow || '}', ',' ORDER BY rank) AS list FROM top_assets GROUP BY chain_id) a
     ON chain_id = universal_chain_id""", f"{_RT},{_FLOWS},{_TOP_ASSETS}")
_add("snk5_summary_rows", _on(RT, lambda t, a: sinks.summary_rows(
        wallets.active_wallets(t, a, "sender", 10).select(F.lpad(F.col("count").cast("string"), 9, "0").alias("n"), "address"), "active_senders", "30d", a)),
     """SELECT 'active_senders' AS chart_type, '30d' AS time_scale, (SELECT max(as_of) FROM t) AS updated_at,
     '[' || string_agg('{"n":"' || n || '","address":"' || address || '"}', ',' ORDER BY n, address) || ']' AS data_json
     FROM (SELECT lpad(CAST(count AS VARCHAR), 9, '0') AS n, address FROM (""" + _LIST10("sender") + "))", _RT)
_add("str6_window_partials", lambda spark, sf_dir: ingest.window_partials(RT(spark, sf_dir)).withColumn("volume", F.col("volume").cast("decimal(28,2)")),
     "SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS window_start, count(*) AS n, CAST(sum(amount) AS DECIMAL(28,2)) AS volume FROM t GROUP BY 1", _RT)
_add("str6_rates_from_partials", _on(RT, lambda t, a: ingest.rates_from_partials(ingest.window_partials(t), F.lit(a))),
     "SELECT period, count FROM (" + _union(lambda p: f"SELECT '{p}' AS period, count(*) AS count FROM t WHERE timestamp < time_bucket(INTERVAL 5 MINUTES, as_of) AND timestamp >= time_bucket(INTERVAL 5 MINUTES, as_of) - {_SECONDS[p]}") + ")", _RT)

# stores at rest ---------------------------------------------------------------------------------------------


def _refreshed_twice(view: str):
    """Query: a summary table after two refreshes, the second of which reads only the quarter of the rows that is new."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, out = RT(spark, sf_dir), shared_path(spark, "refresh")
        old, new = t.filter("ingest_seq % 4 <> 1"), t.filter("ingest_seq % 4 = 1")
        refresh_incremental(old, old, 0, out, [view])
        refresh_incremental(t, new, 1, out, [view])
        return read_summary(spark, out, view)

    return query


for _view, _sql, _with in [
    ("transfer_rates", ORACLES["agg1_transfer_rates"], None),
    ("wallet_stats", ORACLES["agg4_wallet_stats"], None),
    ("popular_routes", _routes_sql(_in("30d"), 50), _RT),
    ("chain_flows", ORACLES["agg8_chain_flows"], None),
    ("asset_volumes", "SELECT * FROM av", f"{_RT},{_ASSETS}"),
    *[(f"active_{s}s", _active_sql(s, _in("30d"), 50, 8, 16), _RT) for s in ("sender", "receiver")],
]:
    _add(f"snk6_{_view}", _refreshed_twice(_view), _sql, _with)


def _stored_twice(spark: SparkSession, sf_dir: str) -> str:
    """A store of the transfers: the even ones, then all of them, each twice."""
    t, path = RT(spark, sf_dir), shared_path(spark, "store")
    sinks.store_transfers(spark, path, t.filter("ingest_seq % 2 = 0"))
    sinks.store_transfers(spark, path, t.unionByName(t))
    return path


_add("snk1_store_transfers", lambda spark, sf_dir: spark.read.parquet(f"{_stored_twice(spark, sf_dir)}/facts").drop("date", "created_at"),
     "SELECT * EXCLUDE (as_of, asset) FROM t", _RT)


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: a week of the stored table."""
    path = shared_path(spark, "store")
    sinks.store_transfers(spark, path, RT(spark, sf_dir).withColumn("amount", F.col("amount").cast("decimal(38,18)")))
    recent = read_transfers(spark, f"{path}/facts", fx.latest(RT(spark, sf_dir)), 7)
    return recent.withColumn("amount", F.col("amount").cast("decimal(18,2)")).drop("date", "created_at")


_add("src1_read_transfers", _recent, f"SELECT * EXCLUDE (as_of, asset) FROM t WHERE {_in('7d')}", _RT)


def _stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7 at rest: the first snapshot, then both."""
    data, path = fx.latency_data(spark, sf_dir), shared_path(spark, "store")
    for batch in (data.filter(F.col("fetched_at") == F.lit(fx.FETCHED[0])), data):
        sinks.store_snapshot(spark, path, batch, "latency")
    return spark.read.parquet(f"{path}/latency").drop("date")


_add("snk7_store_snapshot", _stored_snapshots, "SELECT * FROM lat", _LATENCY)


def _chain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: chains written as one response and read as a source."""
    path, c = shared_path(spark, "chains"), fx.chains(spark, sf_dir)
    c.agg(F.struct(F.array_sort(F.collect_list(F.struct(*c.columns))).alias("v2_chains")).alias("data")).write.json(path)
    return read_chains(spark, path).select("universal_chain_id", "chain_id", "display_name", "testnet", F.size("rpcs").alias("endpoints"), F.col("rpcs")[0]["url"].alias("first_url"))


_add("src3_read_chains", _chain_docs,
     "SELECT universal_chain_id, chain_id, display_name, CAST(split_part(universal_chain_id, '-', 2) AS INT) % 2 = 1 AS testnet, CAST(3 AS INT) AS endpoints, 'https://' || host || '.example/rpc' AS first_url FROM c", _CHAINS)


def _latency_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: the first snapshot as responses, streamed into the store and read back."""
    base = shared_path(spark, "latency")
    rows = fx.latency_data(spark, sf_dir).filter(F.col("fetched_at") == F.lit(fx.FETCHED[0]))
    wire = {"packet_ack": "secs_until_packet_ack", "packet_recv": "secs_until_packet_recv", "write_ack": "secs_until_write_ack"}
    stats = F.struct(*[F.struct(*[F.col(f"{e}_{s}").alias(s) for s in latency.STATS]).alias(field) for e, field in wire.items()])
    rows.select("source_chain", "dest_chain", F.struct(F.array(stats).alias("v2_stats_latency")).alias("data")).write.json(f"{base}/in")
    found = read_latency_docs(spark, f"{base}/in").withColumn("fetched_at", F.lit(fx.FETCHED[0]))
    chains = fx.chains(spark, sf_dir)
    for number in range(2):  # the second time nothing is new
        ingest.store_latency(f"{base}/store", chains)(found, number)
    return spark.read.parquet(f"{base}/store/latency").drop("date")


_NAME = lambda side: f"(SELECT coalesce(nullif(display_name, ''), universal_chain_id) FROM c WHERE universal_chain_id = {side}_chain)"
_add("src4_latency_docs", _latency_docs,
     f"SELECT * REPLACE ({_NAME('source')} AS source_name, {_NAME('dest')} AS dest_name) FROM lat WHERE fetched_at = TIMESTAMP '2024-01-01'", f"{_LATENCY},{_CHAINS}")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG23 into the store: probes of even days and then all of them, as a stream's batches."""
    path, probes, chains = shared_path(spark, "store"), fx.probes(spark, sf_dir), fx.chains(spark, sf_dir)
    store = ingest.store_probes(path, chains)
    for number, batch in enumerate((probes.filter("run < '2024-01-15'"), probes.filter("run >= '2024-01-15'"), probes)):
        store(batch, number)
    return spark.read.parquet(f"{path}/health").select("rpc_url", "chain_id", "checked_at", "status", "response_time_ms", "latest_block_height", "uptime")


_add("agg23_store_checks", _checks,
     "SELECT rpc_url, chain_id, run AS checked_at, status, CAST(response_time_ms AS INT) AS response_time_ms, CASE WHEN status <> 'unhealthy' THEN height END AS latest_block_height, "
     "coalesce(lag(CASE WHEN status <> 'unhealthy' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY rpc_url ORDER BY run), 0) AS uptime FROM rollup_", _PROBES)


def _sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG25 from stored sketches, in batches by line number, beside the exact ranks of what they give."""
    base, packets = shared_path(spark, "latency"), fx.packets(spark, sf_dir)
    store = Segments(spark, base, lambda rows: latency.merged_sketches(rows, ["line"]))
    for number, part in enumerate((packets.filter("line <= 3"), packets.filter("line > 3"))):
        store.add(latency.latency_sketches(part, ["line"]), "packets", number)
    found = latency.percentiles_of(store.read())
    route = found.select(*latency.ROUTE, "packets", *latency.VALUES)
    ranked = packets.join(F.broadcast(route), latency.ROUTE)  # a row for each pair of nations
    off = []
    for e in latency.EVENTS:
        for s, q in zip(latency.STATS, (0.05, 0.5, 0.95)):
            share = lambda c: F.count(F.when(c, 1)) / F.count("*")
            x, v = F.col(latency.SECONDS[e]), F.col(f"{e}_{s}")
            off.append((share(x < v) <= q + latency.RANK_ERROR) & (share(x <= v) >= q - latency.RANK_ERROR))
    within = off[0]
    for o in off[1:]:
        within = within & o
    return ranked.groupBy(*latency.ROUTE, "packets").agg(within.alias("within_rank_error"))


_add("agg25_latency_sketches", _sketched, "SELECT source_chain, dest_chain, count(*) AS packets, true AS within_rank_error FROM packets GROUP BY ALL", _PACKETS)


def _estimated(t: DataFrame, as_of) -> DataFrame:
    """AGG4 and AGG7 from stored distinct sketches: estimates that are within four standard deviations of the exact numbers."""
    store = Segments(t.sparkSession, shared_path(t.sparkSession, "wallets"), wallets.merged_sketches)
    for number, half in enumerate((t.filter("ingest_seq % 2 = 0"), t.filter("ingest_seq % 2 = 1"))):
        store.add(wallets.wallet_sketches(half), "facts", number)
    found = wallets.wallet_stats_of_sketches(store.read(), as_of)
    floor = F.floor(F.unix_timestamp(F.lit(as_of)) / 300) * 300
    # windows of whole buckets: [from, to) is the operator's (from, to] moved by a microsecond
    shifted = t.withColumn("timestamp", F.timestamp_micros(F.unix_micros("timestamp") + 1))
    exact = wallets.wallet_rate_changes(shifted, F.timestamp_seconds(floor)).select("period", "senders", "receivers")
    close = lambda a, b: F.abs(F.col(f"f.{a}") - F.col(f"e.{b}")) <= 2 + 0.035 * F.col(f"e.{b}")
    both = found.alias("f").join(F.broadcast(exact.alias("e")), F.col("f.period") == F.col("e.period"))  # six rows
    return both.select("f.period", "e.senders", "e.receivers", (close("senders", "senders") & close("receivers", "receivers")).alias("within_error"))


_FLOORED = lambda c, p: f"count(DISTINCT {c}) FILTER (timestamp >= time_bucket(INTERVAL 5 MINUTES, as_of) - {_SECONDS[p]} AND timestamp < time_bucket(INTERVAL 5 MINUTES, as_of))"
_add("agg4_wallet_sketches", _on(RT, _estimated),
     _union(lambda p: f"SELECT '{p}' AS period, {_FLOORED('sender', p)} AS senders, {_FLOORED('receiver', p)} AS receivers, true AS within_error FROM t"), _RT)


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3: every transfer twice, in shuffled files, through the deduplicating stream."""
    base, rt = shared_path(spark, "dedup"), RT(spark, sf_dir).select("packet_hash", "timestamp")
    rt.unionByName(rt).repartition(3, "timestamp").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rt.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    write = ingest.dedup_stream(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    write.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rt.schema).parquet(f"{base}/out")


_add("str3_dedup_stream", _once, "SELECT packet_hash, timestamp FROM t", _RT)


def _other_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ13 but for its bech32 branch: chains of hexadecimal addresses."""
    evm = fx.chains(spark, sf_dir).filter("rpc_type = 'evm'").select("universal_chain_id")
    return _addresses(spark, sf_dir).join(F.broadcast(evm), "universal_chain_id", "left_semi")  # a chain is a nation


_add("prj13_address_dim_evm", _other_addresses,
     "SELECT DISTINCT address, universal_chain_id, lower(CASE WHEN starts_with(address, '0x') THEN address ELSE '0x' || address END) AS formatted FROM ("
     "SELECT sha1(sender) AS address, source_chain AS universal_chain_id FROM t UNION SELECT '0x' || upper(sha1(receiver)), dest_chain FROM t) "
     "WHERE CAST(split_part(universal_chain_id, '-', 2) AS INT) % 2 = 1", _TRANSFERS)
_add("doc4_nodes", _on(NODES, lambda h, a: documents.node_health_document(h, a).select(F.explode("nodes").alias("x")).select("x.*")),
     "SELECT chain_id, rpc_url, chain_name, rpc_type, status, response_time_ms, latest_block_height, uptime, CAST(floor(epoch(checked_at)) AS BIGINT) AS last_check_time, coalesce(error_message, '') AS error FROM latest", _NODES)
