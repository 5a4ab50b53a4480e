"""Explicit schemas of stored tables and wire documents, as DDL."""

from __future__ import annotations

TRANSFERS = (
    "packet_hash string, sort_order string, source_chain string, dest_chain string, source_name string, dest_name string, "
    "sender string, receiver string, amount decimal(38,18), token_symbol string, canonical_token_symbol string, "
    "timestamp timestamp, created_at timestamp, ingest_seq long"
)
LATENCY = (
    "source_chain string, dest_chain string, source_name string, dest_name string, "
    + ", ".join(f"{event}_{stat} double" for event in ("packet_ack", "packet_recv", "write_ack") for stat in ("p5", "median", "p95"))
    + ", fetched_at timestamp"
)
NODE_HEALTH = (
    "chain_id string, chain_name string, rpc_url string, rpc_type string, status string, response_time_ms int, "
    "latest_block_height long, error_message string, uptime double, checked_at timestamp"
)
CHAINS = (
    "universal_chain_id string, chain_id string, display_name string, testnet boolean, rpc_type string, addr_prefix string, "
    "rpcs array<struct<url: string>>"
)

_CHAIN = "struct<universal_chain_id: string, chain_id: string, display_name: string, testnet: boolean, rpc_type: string, addr_prefix: string>"
_META = (
    "struct<wrapping: array<struct<index: int, unwrapped_chain: struct<universal_chain_id: string>, unwrapped_address_hex: string, "
    "wrapped_chain: struct<universal_chain_id: string>>>>"
)
_TRANSFER = (
    f"source_chain: {_CHAIN}, destination_chain: {_CHAIN}, sender_canonical: string, sender_display: string, "
    "receiver_canonical: string, receiver_display: string, transfer_send_timestamp: string, transfer_send_transaction_hash: string, "
    "base_token: string, base_amount: string, base_token_symbol: string, base_token_decimals: int, sort_order: string, "
    "packet_hash: string, wrap_direction: string"
)
RAW_TRANSFER = f"struct<{_TRANSFER}, quote_token_meta: {_META}, base_token_meta: {_META}>"
_ERRORS = "errors array<struct<message: string>>"
TRANSFER_DOCS = (f"data struct<v2_transfers: array<{RAW_TRANSFER}>>, {_ERRORS}")
#: The same without the tokens' wrappings, a third of a response, which neither facts nor messages have.
UNWRAPPED_DOCS = f"data struct<v2_transfers: array<struct<{_TRANSFER}>>>, {_ERRORS}"
CHAIN_DOCS = (
    "data struct<v2_chains: array<struct<universal_chain_id: string, chain_id: string, display_name: string, testnet: boolean, "
    f"rpc_type: string, addr_prefix: string, rpcs: array<struct<url: string>>>>>, {_ERRORS}"
)
_STATS = "struct<p5: double, median: double, p95: double>"
LATENCY_DOCS = (
    "source_chain string, dest_chain string, data struct<v2_stats_latency: array<struct<"
    f"secs_until_packet_ack: {_STATS}, secs_until_packet_recv: {_STATS}, secs_until_write_ack: {_STATS}>>>, {_ERRORS}"
)
