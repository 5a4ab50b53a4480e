"""Branch logic on hand-made rows."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlake.functions import columns as col
from flowlake.operators import assets, enrich, flows, health, latency, ops, ranking, rates, wallets
from flowlake.sources import cursors, sinks

NOW = datetime(2024, 3, 1, 12, 0, 0)
SCHEMA = (
    "packet_hash string, sort_order string, source_chain string, dest_chain string, source_name string, dest_name string, sender string, "
    "receiver string, amount decimal(18,2), token_symbol string, canonical_token_symbol string, timestamp timestamp, ingest_seq long"
)


def transfers(spark, *rows):
    """(minutes before NOW, fields...)"""
    out = []
    for i, (minutes, f) in enumerate(rows):
        out.append(
            (f"p{i}", f"{i:04}", f.get("src", "a"), f.get("dst", "b"), f.get("sn", "A"), f.get("dn", "B"), f.get("s", "w1"), f.get("r", "w2"),
             Decimal(f.get("amt", "1.00")) if f.get("amt", "") is not None else None, f.get("sym", "t"), f.get("can", ""), NOW - timedelta(minutes=minutes), i)
        )
    return spark.createDataFrame(out, SCHEMA)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_window_edges(spark):
    t = transfers(spark, (0, {}), (60, {}), (59, {}), (120, {}), (61, {}))
    counts = by(rates.transfer_rates(t, NOW), "period")
    assert counts["1h"]["count"] == 2  # the row exactly an hour old is out
    change = by(rates.transfer_rate_changes(t, NOW), "period")
    assert change["1h"]["prev_count"] == 2  # that row is in the window before; the one of two hours is not
    assert change["1h"]["change_pct"] == 0.0


def test_no_previous_rows_no_change(spark):
    change = by(rates.transfer_rate_changes(transfers(spark, (1, {})), NOW), "period")
    assert all(r["change_pct"] == 0 for r in change.values())


def test_five_minutes_use_the_average_before(spark):
    t = transfers(spark, (1, {}), (2, {}), *[(10 + i, {}) for i in range(5)])
    assert by(rates.transfer_rate_changes(t, NOW), "period")["5m"]["change_pct"] == 100.0


def test_empty_table(spark):
    t = transfers(spark, (1, {})).limit(0)
    assert by(rates.transfer_rates(t, NOW), "period")["all"]["count"] == 0
    assert by(wallets.wallet_stats(t, NOW), "period")["30d"]["unique_total"] == 0
    assert flows.chain_flows(t, NOW).count() == 0
    assert cursors.needs_backfill(t).first()["reason"] == "empty table"
    assert cursors.latest_cursor(t).first()["cursor"] is None


def test_wallet_totals(spark):
    t = transfers(spark, *[(1, {"s": f"s{i}", "r": f"r{i % 5}"}) for i in range(7)], (1, {"s": "r0", "r": "s0"}))
    stats = by(wallets.wallet_stats(t, NOW), "period")["1d"]
    exact = by(wallets.wallet_stats_exact(t, NOW), "period")["1d"]
    assert (stats["unique_senders"], stats["unique_receivers"]) == (8, 6)
    assert stats["unique_total"] == 8 + 2  # 30 % of 6 is 1.8, rounded
    assert max(8, 6) <= exact["unique_total"] == 12 <= 8 + 6
    est = by(wallets.wallet_estimates(t, NOW), "period")["1d"]
    assert (est["estimate_25"], est["estimate_30"], est["estimate_70"]) == (13, 13, 10)


def test_half_rounds_up(spark):
    t = transfers(spark, *[(1, {"s": f"s{i}", "r": f"r{i}"}) for i in range(5)])
    assert by(wallets.wallet_stats(t, NOW), "period")["1d"]["unique_total"] == 7  # 1.5 -> 2


def test_one_sided_wallets(spark):
    t = transfers(spark, (10, {"s": "x", "r": None}), (70, {"s": "x", "r": None}))
    change = by(wallets.wallet_rate_changes(t, NOW), "period")["1h"]
    assert (change["senders"], change["receivers"], change["prev_senders"], change["senders_change"]) == (1, 0, 1, 0.0)


def test_approximate_wallets_are_close(spark):
    t = transfers(spark, *[(1, {"s": f"s{i % 300}", "r": f"r{i % 70}"}) for i in range(900)])
    got = by(wallets.wallet_stats_approx(t, NOW), "period")["1d"]
    assert abs(got["unique_senders"] - 300) <= 18 and abs(got["unique_receivers"] - 70) <= 5


def test_a_chain_of_two_names_fans_out(spark):
    t = transfers(spark, (1, {"src": "c", "sn": "C1"}), (1, {"src": "c", "sn": "C2"}), (1, {"dst": "c", "dn": "C"}))
    rows = [r for r in flows.chain_flows(t, NOW).collect() if r["universal_chain_id"] == "c"]
    assert sorted((r["chain_name"], r["outgoing_count"], r["incoming_count"], r["net_flow"]) for r in rows) == [("C1", 1, 1, 0), ("C2", 1, 1, 0)]


def test_flows_balance(spark):
    t = transfers(spark, *[(i, {"src": f"c{i % 3}", "dst": f"c{i % 4}", "sn": f"C{i % 3}", "dn": f"C{i % 4}"}) for i in range(40)])
    total = flows.flow_totals(flows.chain_flows(t, NOW)).first()
    assert total["all_outgoing"] == total["all_incoming"] == 40


def test_asset_symbols(spark):
    t = transfers(spark, (1, {"sym": "x", "can": ""}), (1, {"sym": "x", "can": "X"}), (1, {"sym": None, "can": None}), (1, {"sym": "X", "can": None, "amt": None}))
    got = by(assets.asset_volumes(t, NOW), "asset_symbol")
    assert set(got) == {"x", "X"} and got["X"]["transfer_count"] == 2
    assert got["X"]["average_amount"] == 1.0  # a null amount is no amount
    shares = flows.chain_top_assets(t, NOW).groupBy("chain_id").agg(F.sum("percentage").alias("p")).collect()
    assert all(abs(r["p"] - 100) < 1e-3 for r in shares)


def test_ties_are_stable(spark):
    t = transfers(spark, *[(1, {"s": f"s{i}"}) for i in range(30)])
    first = [r["address"] for r in wallets.active_wallets(t, NOW, "sender", 5).collect()]
    assert first == sorted(f"s{i}" for i in range(30))[:5]


def test_latest_latency_keeps_equal_instants(spark):
    row = lambda ack, at: ("a", "b", "A", "B", *[float(ack)] * 9, at)
    schema = "source_chain string, dest_chain string, source_name string, dest_name string, " + ", ".join(f"{v} double" for v in latency.VALUES) + ", fetched_at timestamp"
    df = spark.createDataFrame([row(1, NOW), row(2, NOW), row(2, NOW), row(3, NOW - timedelta(days=1))], schema)
    assert sorted(r["packet_ack_p5"] for r in latency.latest_latency(df).collect()) == [1.0, 2.0]


def test_probe_thresholds(spark):
    def run(url, oks, error="e"):
        return [(url, "c", NOW, i, f"n{i}", ok, 10 * i, 100 + i if ok else None, None if ok else error) for i, ok in enumerate(oks)]

    rows = run("u80", [True] * 4 + [False]) + run("u50", [True, False]) + run("u0", [False, False]) + run("quiet", [False], None)
    schema = "rpc_url string, chain_id string, run timestamp, seq int, name string, success boolean, response_ms long, block_height long, error string"
    got = by(health.probe_rollup(spark.createDataFrame(rows, schema)), "rpc_url")
    assert got["u80"]["status"] == "healthy" and got["u80"]["latest_block_height"] == 100 and got["u80"]["error_message"] is None
    assert got["u50"]["status"] == "degraded" and got["u50"]["error_message"] == "Partial failure: 1/2 checks failed"
    assert got["u0"]["status"] == "unhealthy" and got["u0"]["error_message"] == "n0: e; n1: e"
    assert got["quiet"]["error_message"] == "Failed 1/1 health checks"


def test_health_without_nodes(spark):
    h = spark.createDataFrame([], "chain_id string, chain_name string, rpc_url string, rpc_type string, status string, response_time_ms int, latest_block_height long, error_message string, uptime double, checked_at timestamp")
    assert health.health_percentage(health.node_health_summary(h, NOW)).first()[0] == 0


@pytest.mark.parametrize(
    ("amount", "decimals", "value", "overflow"),
    [("", 6, "0", False), ("0", 6, "0", False), ("abc", 6, "0", False), (None, 6, "0", False), ("1", 18, "0.000000000000000001", False),
     ("1234567", 6, "1.234567", False), ("-5", 1, "-0.5", False), ("9" * 60, 0, None, True), ("1" + "0" * 40, 30, "10000000000", False)],
)
def test_scale_amount(spark, amount, decimals, value, overflow):
    got = enrich.scale_amount(spark.createDataFrame([(amount, decimals)], "base_amount string, base_token_decimals int")).first()
    assert got["amount_overflow"] == overflow
    assert got["amount"] == (None if value is None else Decimal(value))


def test_scale_amount_of_odd_texts(spark):
    """Signs, leading zeros, blanks, line ends, negative places, rounding at the 18th place and both ends of the type."""
    want = {
        ("+007", 2): "0.07", ("-0", 3): "0", (" 12 ", 1): "1.2", ("12", -4): "12", ("12", None): "12", ("1e5", 0): "0", ("12d", 0): "0", ("--1", 0): "0", ("12\n", 0): None,
        ("5", 19): "0.000000000000000001", ("4", 19): "0", ("-15", 19): "-0.000000000000000002", ("1", 400): "0", ("0" * 60 + "7", 1): "0.7",
        ("9" * 20, 0): "9" * 20, ("9" * 21, 0): None, ("9" * 38, 18): "9" * 20 + "." + "9" * 18, ("9" * 39, 19): None, ("9" * 39, 21): "9" * 18 + "." + "9" * 18,
    }
    want["9" * 39, 21] = "1" + "0" * 18  # rounded up
    df = spark.createDataFrame(list(want), "base_amount string, base_token_decimals int")
    for r in enrich.scale_amount(df).collect():
        value = want[r["base_amount"], r["base_token_decimals"]]
        assert r["amount"] == (None if value is None else Decimal(value)) and r["amount_overflow"] == (value is None), r


def test_shorten_address(spark):
    df = spark.createDataFrame([("x" * 16,), ("abcdefgh12345uvwxyz",)], "a string")
    assert [r[0] for r in df.select(col.shorten_address(F.col("a"))).collect()] == ["x" * 16, "abcdefgh...uvwxyz"]


def test_bech32_known_value():
    # a published test vector of the bech32 specification: an empty payload and the letters of the alphabet
    assert enrich.bech32("a", b"") == "a12uel5l"


def test_address_forms(spark):
    rows = [
        ("ab" * 20, "cosmos", "osmo"), ("0x" + "AB" * 20, "evm", ""), ("1f", "evm", ""), ("", "evm", ""), ("plain", "other", "x"),
        ("osmo1" + "q" * 38, "cosmos", "osmo"), ("ab" * 32, "cosmos", "osmo"), ("zz", "cosmos", "osmo"),
    ]
    df = spark.createDataFrame(rows, "a string, k string, p string")
    got = [r[0] for r in df.select(enrich.format_address(F.col("a"), F.col("k"), F.col("p"))).collect()]
    assert got[0] == enrich.bech32("osmo", bytes.fromhex("ab" * 20)) and got[0] == got[6]
    assert got[1:6] == ["0x" + "ab" * 20, "0x" + "0" * 38 + "1f", "", "plain", "osmo1" + "q" * 38]
    assert got[7] == "zz"


def test_hexadecimal_forms_come_before_the_look_of_bech32(spark):
    rows = [("0x0133FFE04405EE086A8F3BAC5C526247CFFACD8C", "0x0133ffe04405ee086a8f3bac5c526247cffacd8c"), ("abc", "abc"), ("cosmos1" + "Q" * 38, "cosmos1" + "Q" * 38)]
    df = spark.createDataFrame(rows, "a string, want string")
    assert df.filter(enrich.format_address(F.col("a"), F.lit("evm"), F.lit("")) != F.col("want")).count() == 0


def test_append_is_idempotent(spark):
    t = transfers(spark, (1, {}), (2, {}))
    twice = sinks.append_transfers(sinks.append_transfers(t.limit(0), t), t.unionByName(t))
    assert twice.count() == 2


def test_store_transfers_once(spark, tmp_path):
    t = transfers(spark, (1, {}), (2, {}), (3000, {}))
    assert sinks.store_transfers(spark, str(tmp_path), t) == 3
    assert sinks.store_transfers(spark, str(tmp_path), t) == 0
    # a batch that failed between facts and keys
    t2 = t.withColumn("packet_hash", F.concat(F.lit("x"), "packet_hash"))
    t2.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(f"{tmp_path}/facts")
    (tmp_path / "_pending").touch()
    assert sinks.store_transfers(spark, str(tmp_path), t2) == 0
    assert spark.read.parquet(f"{tmp_path}/facts").count() == 6


def test_store_summary_replaces_its_partition(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "rank int, name string")
    for scale in ("1d", "7d", "1d"):
        sinks.store_summary(df, "routes", scale, NOW, str(tmp_path))
    got = sinks.read_summaries(spark, str(tmp_path)).collect()
    assert sorted(r["time_scale"] for r in got) == ["1d", "7d"] and got[0]["data_json"] == '[{"rank":1,"name":"x"}]'


def test_forward_cursor(spark):
    t = transfers(spark, *[(i, {}) for i in range(10)])
    page, cursor = cursors.read_forward(t, None, 3)
    assert sorted(r["sort_order"] for r in page.collect()) == ["0007", "0008", "0009"] and cursor == "0009"
    page, cursor = cursors.read_forward(t, "0002", 3)
    assert cursor == "0005" and page.count() == 3
    assert cursors.read_forward(t, "0009", 3)[1] == "0009"


def test_filter_chains(spark):
    t = transfers(spark, (1, {"src": "a", "dst": "b"}), (1, {"src": "b", "dst": "a"}), (1, {"src": "c", "dst": "c"}))
    assert [enrich.filter_chains(t, *x).count() for x in (("a", "b"), ("a", None), (None, "c"), (None, None))] == [1, 2, 1, 3]


def test_shares(spark):
    df = spark.createDataFrame([("x", 0), ("y", 0)], "k string, v long")
    assert [r["share"] for r in ranking.share_of_listed(df, F.col("v"), 5, ["k"]).collect()] == [0, 0]
    df = spark.createDataFrame([("x", -3), ("y", 1)], "k string, v long")
    assert {r["k"]: r["share"] for r in ranking.share_of_listed(df, F.col("v"), 5, ["k"]).collect()} == {"x": 75, "y": 25}


def test_capacity_and_progress(spark):
    t = transfers(spark, (1, {}))
    assert by(ops.capacity_report(t), "scenario")["1_billion"]["size_bytes"] == 800_000_000_000
    assert str(ops.load_progress(t, 3).first()["progress_pct"]) == "33.33"


def test_uptime_over_gaps_and_days(spark):
    """As one window over a node's whole history, also over days without checks, ties and null heights."""
    from random import Random

    rng, rows = Random(4), []
    for node in "ab":
        for d in (1, 2, 3, 7, 8, 20):
            for _ in range(rng.randrange(1, 12)):
                rows.append((node, datetime(2024, 1, d, rng.randrange(24), rng.choice([0, 30])), rng.choice(["healthy", "degraded", "unhealthy"]), rng.choice([None, *range(1000)])))
    h = spark.createDataFrame(rows, "rpc_url string, checked_at timestamp, status string, latest_block_height long").dropDuplicates(["rpc_url", "checked_at", "latest_block_height"])
    up = F.when(F.col("status") != "unhealthy", 100.0).otherwise(0.0)
    whole = Window.partitionBy("rpc_url")
    want = h.select("rpc_url", "checked_at", "status",
                    F.coalesce(F.lag(up).over(whole.orderBy("checked_at", "latest_block_height")), F.lit(0.0)).alias("uptime"),
                    F.round(F.avg(up).over(whole.orderBy(F.unix_micros("checked_at")).rangeBetween(-86_400_000_000, 0)), 6).alias("uptime_24h"))
    assert sorted(map(repr, health.node_uptime(h).collect())) == sorted(map(repr, want.collect()))


def test_uptime_costs_the_same_for_each_check_of_a_day(spark):
    """Shares are running counts: no frame slides over a day's checks. Checks of a day less, exactly and more than a day ago, and without instant or node."""
    first, us = datetime(2024, 1, 1, 5), timedelta(microseconds=1)
    ats = [first, first, first + timedelta(days=1) - us, first + timedelta(days=1), first + timedelta(days=1) + us, first + timedelta(days=2, hours=3), None, None]
    rows = [(node, at, s, i) for node in ("a", "b", None) for i, (at, s) in enumerate(zip(ats, ["healthy", "unhealthy", "degraded", "healthy", "unhealthy", "healthy", "healthy", "unhealthy"]))]
    h = spark.createDataFrame(rows, "rpc_url string, checked_at timestamp, status string, latest_block_height long")
    found = health.node_uptime(h)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+), ([^)]+)\)", plan)
    assert frames and {lower for _, lower, _ in frames} == {"unboundedpreceding$()"}
    got = [(r["uptime"], r["uptime_24h"]) for r in found.filter("rpc_url = 'a' AND checked_at IS NOT NULL").orderBy("checked_at", "uptime").collect()]
    assert got == [(0.0, 50.0), (100.0, 50.0), (0.0, 66.666667), (100.0, 75.0), (100.0, 66.666667), (0.0, 100.0)]
    for node in ("rpc_url = 'a'", "rpc_url IS NULL"):
        assert [r["uptime_24h"] for r in found.filter(f"{node} AND checked_at IS NULL").collect()] == [50.0, 50.0]
    assert found.count() == len(rows)
