"""Sources on files, streams against batches, and plans."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta
from itertools import accumulate

from pyspark.sql import functions as F

from flowlake import fixtures as fx
from flowlake import registry, schemas
from flowlake.operators import enrich, health, latency, rates, routes, wallets
from flowlake.plans import documents, partials, refresh
from flowlake.sources import documents as src
from flowlake.sources import segments, sinks
from flowlake.streaming import ingest

SF = "/root/testdata/sf0.001"


def _write(path, *docs):
    path.write_text("\n".join(json.dumps(d) for d in docs))
    return str(path)


def test_transfer_docs(spark, tmp_path):
    ok = {"data": {"v2_transfers": [{"packet_hash": "p1", "sort_order": "1"}, {"packet_hash": "p2"}]}}
    bad = {"data": {"v2_transfers": [{"packet_hash": "p3"}]}, "errors": [{"message": "no"}]}
    empty = {"data": {"v2_transfers": []}, "errors": []}
    got = src.read_transfer_docs(spark, _write(tmp_path / "d.json", ok, bad, empty)).collect()
    assert [r["packet_hash"] for r in got] == ["p1", "p2"]


def test_chain_docs(spark, tmp_path):
    doc = {"data": {"v2_chains": [{"universal_chain_id": "u", "rpcs": [{"url": "x"}]}, {"universal_chain_id": "v"}]}}
    got = {r["universal_chain_id"]: r["rpcs"] for r in src.read_chains(spark, _write(tmp_path / "c.json", doc)).collect()}
    assert got["u"][0]["url"] == "x" and got["v"] is None


def test_latency_docs(spark, tmp_path):
    stats = {"p5": 1, "median": 2, "p95": 3}
    item = {k: stats for k in ("secs_until_packet_ack", "secs_until_packet_recv", "secs_until_write_ack")}
    docs = [{"source_chain": "a", "dest_chain": "b", "data": {"v2_stats_latency": [item, {}]}}, {"source_chain": "a", "dest_chain": "c", "data": {"v2_stats_latency": []}}]
    got = src.read_latency_docs(spark, _write(tmp_path / "l.json", *docs)).collect()
    assert len(got) == 1 and got[0]["packet_ack_median"] == 2.0


def test_forward_stream(spark, tmp_path):
    def arrive(ids):
        rows = [(f"p{i}", f"{i // 2:05}", datetime(2024, 1, 1) + timedelta(seconds=i)) for i in ids]  # two rows a sort key
        spark.createDataFrame(rows, "packet_hash string, sort_order string, timestamp timestamp").repartition(3).write.mode("append").parquet(f"{tmp_path}/t")

    def run():
        stream = src.stream_forward(spark, f"{tmp_path}/t", "00009", max_files=1).select("packet_hash", "sort_order")
        write = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        write.trigger(availableNow=True).start().awaitTermination()
        return sorted(int(r[0][1:]) for r in spark.read.parquet(f"{tmp_path}/out").select("packet_hash").collect())

    arrive(range(250))
    assert run() == list(range(20, 250))
    arrive(range(250, 300))
    assert run() == list(range(20, 300))


def test_windows_are_stored_by_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 3)
    write = ingest.upsert_partials(f"{tmp_path}/p")
    batch = lambda *rows: spark.createDataFrame([(datetime(2024, 1, 1, 0, m), n, float(n)) for m, n in rows], "window_start timestamp, n long, volume double")
    for i in range(5):
        write(batch((0, i + 1), (5 * i + 5, 1)), i)
    write(batch((0, 7), (25, 2)), 4)  # a batch that is repeated
    got = {r["window_start"].minute: r["n"] for r in ingest.read_partials(spark, f"{tmp_path}/p").collect()}
    assert got == {0: 5, 5: 1, 10: 1, 15: 1, 20: 1, 25: 1}
    assert sorted(s["level"] for s in ingest._windows(spark, f"{tmp_path}/p").live()) == [0, 0, 1]


def test_stream_dedup(spark, tmp_path):
    base = [(f"p{i}", datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(20)]
    spark.createDataFrame(base + base[:7], "packet_hash string, timestamp timestamp").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("packet_hash string, timestamp timestamp").parquet(f"{tmp_path}/in")
    query = ingest.dedup_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("packet_hash").collect()) == sorted(p for p, _ in base)


def _facts(spark, path, t):
    t.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(f"{path}/facts")


def test_refresh_now(spark, tmp_path):
    t, store, out = fx.transfers_rt(spark, SF), f"{tmp_path}/store", f"{tmp_path}/out"
    _facts(spark, store, t)
    h, latencies = fx.node_health(spark, SF), fx.latency_data(spark, SF)
    sinks.store_snapshot(spark, store, h, "health")
    sinks.store_snapshot(spark, store, latencies, "latency")
    ingest.refresh_now(spark, store, out)
    message = json.loads(ingest.read_message(spark, out).first()[0])
    # the dashboard from the stored summaries is that from the facts
    whole = documents.dashboard(t, latencies, h, fx.latest(t)).select(F.to_json("doc")).first()[0]
    assert message == {"type": "chartData", "data": json.loads(whole)}
    assert refresh.report_of(spark, refresh.current(spark, out)["report"]).count() == 7
    ingest.refresh_now(spark, store, out)  # nothing has arrived: nothing is published
    assert len([c for c in os.listdir(out) if c.startswith("v")]) == 1


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_incremental_refresh_equals_a_full_one(spark, tmp_path, monkeypatch):
    """Batches in time order, a late one, one of a single row, and repeated ones; windows begin inside hours."""
    monkeypatch.setattr(segments, "FAN", 3)
    t, out = fx.transfers_rt(spark, SF).persist(), f"{tmp_path}/out"
    at = lambda *cuts: [t.filter((F.col("ingest_seq") % 7 != 3) & F.col("timestamp").between(*[F.lit(datetime(2024, 1, d)) for d in cuts]))]
    last = t.orderBy(F.desc("timestamp")).limit(1)
    batches = at(1, 9) + at(10, 19) + at(20, 25) + at(26, 31) + [t.filter("ingest_seq % 7 = 3"), last.withColumn("timestamp", F.expr("timestamp + INTERVAL 47 MINUTES 3 SECONDS"))]
    facts = None
    for number, batch in enumerate(batches):
        facts = batch if facts is None else facts.unionByName(batch)
        refresh.refresh_incremental(facts, batch, number, out)
        refresh.refresh_incremental(facts, batch, number, out)  # repeated: folded once
    as_of = fx.latest(facts)
    for view, want in refresh.summaries(facts, facts, as_of).items():
        got = refresh.read_summary(spark, out, view)
        assert _rows(got.select(*want.columns)) == _rows(want), view
    assert len([c for c in os.listdir(out) if c.startswith("v")]) == 2  # the version before stays
    assert len(partials.store_of(spark, out, "routes").live()) < len(batches)
    t.unpersist()


def test_a_refresh_reads_new_facts_and_the_edges_of_windows_only(spark, tmp_path):
    t, store, out = fx.transfers_rt(spark, SF), f"{tmp_path}/store", f"{tmp_path}/out"
    _facts(spark, store, t.filter("timestamp < '2024-01-29'"))
    ingest.refresh_now(spark, store, out)
    new = t.filter("timestamp >= '2024-01-29'")
    _facts(spark, store, new)
    ingest.refresh_now(spark, store, out)
    progress = sorted(os.listdir(f"{out}/checkpoint/sources/0"))
    assert "1" in progress
    files = [line for line in open(f"{out}/checkpoint/sources/0/1").read().splitlines() if "parquet" in line]
    assert files and all("date=2024-01-29" in f or "date=2024-01-3" in f for f in files)
    as_of = fx.latest(t)
    edge = partials._at_edges(spark.read.parquet(f"{store}/facts"), as_of, [partials.LONGEST])
    assert "PartitionFilters: [isnotnull(date" in _plan(edge)
    want = wallets.wallet_stats(t, as_of)
    assert _rows(refresh.read_summary(spark, out, "wallet_stats").select(*want.columns)) == _rows(want)


def test_a_stream_resumes_after_the_newest_stored_key(spark, tmp_path):
    """STR7: without a checkpoint a forward stream begins after what is stored."""
    t = fx.transfers_rt(spark, SF).withColumn("amount", F.col("amount").cast("decimal(38,18)"))
    sinks.store_transfers(spark, f"{tmp_path}/store", t.filter("ingest_seq < 700"))
    cursor = ingest.resume_cursor(spark.read.parquet(f"{tmp_path}/store/facts").withColumn("ingest_seq", F.col("sort_order").cast("long")))
    t.write.parquet(f"{tmp_path}/source")
    stream = src.stream_forward(spark, f"{tmp_path}/source", cursor)
    stream.writeStream.foreachBatch(lambda batch, _: sinks.store_transfers(spark, f"{tmp_path}/store", batch)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    newest = cursor  # the newest by time, which is not the greatest key
    want = t.filter((F.col("ingest_seq") < 700) | (F.col("sort_order") > newest)).count()
    assert spark.read.parquet(f"{tmp_path}/store/facts").count() == want


def _stream_of(spark, path, df, write, checkpoint):
    df.write.mode("append").parquet(path)
    spark.readStream.schema(df.schema).parquet(path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_documents_and_probes_reach_the_dashboard(spark, tmp_path):
    """Latency documents and probes in, dashboard sections out; repeated input changes nothing."""
    store = f"{tmp_path}/store"
    chains = spark.createDataFrame([(f"chain-{i}", f"c{i}", f"Chain {i}" if i else "", False, "cosmos", "x") for i in range(7)], "universal_chain_id string, chain_id string, display_name string, testnet boolean, rpc_type string, addr_prefix string")
    stats = {"p5": 1, "median": 2, "p95": 3}
    item = {k: stats for k in ("secs_until_packet_ack", "secs_until_packet_recv", "secs_until_write_ack")}
    docs = [{"source_chain": f"chain-{i}", "dest_chain": "chain-1", "data": {"v2_stats_latency": [item]}} for i in (0, 2)]
    latencies = src.read_latency_docs(spark, _write(tmp_path / "l.json", *docs)).withColumn("fetched_at", F.lit(datetime(2024, 1, 30)))
    probes = fx.probes(spark, SF)
    for again in range(2):
        _stream_of(spark, f"{tmp_path}/l", latencies, ingest.store_latency(store, chains), f"{tmp_path}/cl")
        _stream_of(spark, f"{tmp_path}/p", probes, ingest.store_probes(store, chains), f"{tmp_path}/cp")
    checks = spark.read.schema(schemas.NODE_HEALTH).parquet(f"{store}/health")
    assert checks.count() == health.probe_rollup(probes).count() and spark.read.parquet(f"{store}/latency").count() == 2
    # uptime goes on over batches as over all checks at once
    want = {(r["rpc_url"], r["checked_at"]): r["uptime"] for r in health.node_uptime(checks).collect()}
    assert {(r["rpc_url"], r["checked_at"]): r["uptime"] for r in checks.collect()} == want and len(set(want.values())) == 2
    as_of = checks.agg(F.max("checked_at")).first()[0]
    doc = json.loads(documents.dashboard(fx.transfers_rt(spark, SF), spark.read.schema(schemas.LATENCY).parquet(f"{store}/latency"), checks, as_of).select(F.to_json("doc")).first()[0])
    assert {(x["source_name"], x["dest_name"], x["packet_ack"]["median"]) for x in doc["latency"]} == {("chain-0", "Chain 1", 2.0), ("Chain 2", "Chain 1", 2.0)}
    assert doc["nodeHealth"]["total_nodes"] == len(doc["nodeHealth"]["nodes"]) > 0


def test_partials_give_the_batch_counts(spark):
    t = fx.transfers_rt(spark, SF).withColumn("timestamp", F.date_trunc("minute", "timestamp"))
    as_of = datetime(2024, 1, 20)  # on a five-minute boundary
    from_partials = {r["period"]: r["count"] for r in ingest.rates_from_partials(ingest.window_partials(t), F.lit(as_of)).collect()}
    shifted = t.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 SECOND"))
    batch = {r["period"]: r["count"] for r in rates.transfer_rates(shifted, as_of).collect()}
    assert all(from_partials[p] == batch[p] for p in from_partials)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rates_are_one_scan(spark):
    t = fx.transfers_rt(spark, SF)
    plan = _plan(rates.transfer_rates(t, datetime(2024, 1, 20)))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1


def test_windows_reach_the_scan(spark, tmp_path):
    fx.transfers_rt(spark, SF).write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    plan = _plan(routes.popular_routes(stored, datetime(2024, 1, 20)))
    assert "GreaterThan(timestamp" in plan and "LessThanOrEqual(timestamp" in plan
    assert "sender" not in plan  # columns are pruned


def test_recent_reads_list_recent_partitions_only(spark, tmp_path):
    t = fx.transfers_rt(spark, SF).withColumn("amount", F.col("amount").cast("decimal(38,18)")).withColumn("date", F.to_date("timestamp"))
    t.write.partitionBy("date").parquet(f"{tmp_path}/facts")
    as_of = datetime(2024, 1, 20)
    recent = src.read_transfers(spark, f"{tmp_path}/facts", as_of, 7)
    plan = _plan(recent)
    assert "PartitionFilters: [isnotnull(date" in plan and ">= 2024-01-13" in plan
    assert recent.count() == t.filter((F.col("timestamp") > F.lit(as_of - timedelta(days=7)))).count()


def test_wallets_shuffle_once_by_wallet(spark):
    plan = _plan(wallets.wallet_stats_exact(fx.transfers_rt(spark, SF), datetime(2024, 1, 20)))
    assert plan.count("hashpartitioning") == 1 and plan.count("FileScan parquet") == 1


def test_approximate_percentiles(spark):
    p = fx.packets(spark, SF)
    exact = latency.latency_percentiles(p).agg(F.avg("packet_ack_median")).first()[0]
    rough = latency.latency_percentiles(p, approximate=True).agg(F.avg("packet_ack_median")).first()[0]
    assert abs(exact - rough) / exact < 0.1


def test_dashboard_is_one_row(spark):
    t, h = fx.transfers_rt(spark, SF), fx.node_health(spark, SF)
    doc = documents.dashboard(t, fx.latency_data(spark, SF), h, fx.latest(t)).select(F.to_json("doc")).collect()
    assert len(doc) == 1 and {"transferRates", "nodeHealth", "chainFlows", "latency"} <= set(json.loads(doc[0][0]))


def test_responses_are_made_after_their_events_were_dealt(spark):
    """Events are shuffled as narrow rows, once: nothing is grouped, and no item is made, before the exchange."""
    plan = fx.transfer_docs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    before = plan[plan.index("Exchange") :]
    assert "Aggregate" not in before and "pkt-" not in before


def test_fan_out_skips_what_it_does_not_write(spark, tmp_path, monkeypatch):
    """The wrappings of tokens are neither parsed nor held; all other columns are those of the whole rows."""
    fx.transfer_docs(spark, SF).write.option("ignoreNullFields", "true").json(f"{tmp_path}/in")
    seen = {}

    def recorder(store, messages):
        return lambda batch, _: seen.update({store: (batch.columns, sorted(batch.collect()))})

    monkeypatch.setattr(ingest, "fan_out", recorder)
    for wrappings in (True, False):
        stream = ingest.ingest_stream(spark, f"{tmp_path}/in", wrappings=wrappings)
        assert ("quote_wrapping" in stream.columns) == wrappings
        ingest.start_ingest(stream, str(wrappings), "", f"{tmp_path}/checkpoint-{wrappings}").awaitTermination()
    assert seen["True"] == seen["False"] and seen["True"][1]
    assert not set(seen["True"][0]) & {"quote_wrapping", "base_wrapping", "base_amount"}


def test_stored_batch_is_held_once(spark, tmp_path, monkeypatch):
    """The fan-out holds its batch; the store does not hold a second copy of its rows."""
    kept = []
    persist = type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *a: kept.append(df.columns) or persist(df, *a))
    fx.transfer_docs(spark, SF).write.option("ignoreNullFields", "true").json(f"{tmp_path}/in")
    stream = ingest.ingest_stream(spark, f"{tmp_path}/in", wrappings=False)
    ingest.start_ingest(stream, f"{tmp_path}/store", f"{tmp_path}/messages", f"{tmp_path}/checkpoint").awaitTermination()
    assert len([c for c in kept if "packet_hash" in c and "date" not in c]) == 1


def _bytes(path, suffix):
    """Bytes of a folder's data files, which all end in ``suffix``."""
    files = [os.path.join(root, f) for root, _, names in os.walk(path) for f in names if not f.startswith((".", "_"))]
    assert files and all(f.endswith(suffix) for f in files)
    return sum(map(os.path.getsize, files))


def test_ingest_keeps_little_on_disk(spark, tmp_path, monkeypatch):
    """Responses and messages are compressed; responses are in small files, of which a batch takes half."""
    monkeypatch.setattr(registry, "shared_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(registry, "RESPONSES_PER_FILE", 1)
    assert registry.QUERIES["str2_ingest_fan_out"](spark, SF).count() == 900
    base = f"{tmp_path}/ingest"
    assert spark.read.text(f"{base}/in").count() == 20 and len([f for f in os.listdir(f"{base}/in") if f.endswith(".json.gz")]) > 4
    assert _bytes(f"{base}/in", ".json.gz") < 200 * 1000  # as text 1,000 bytes an event
    for run in ("first", "again"):
        batches = os.listdir(f"{base}/messages-{run}")
        assert sorted(b for b in batches if b.startswith("batch=")) == ["batch=0", "batch=1"]
        assert spark.read.text(f"{base}/messages-{run}").count() == 900
        assert _bytes(f"{base}/messages-{run}", ".txt.gz") < 100 * 900  # as text 580 bytes a message


def test_items_are_made_after_their_events_were_collected(spark):
    """What is collected into a response are events, not the transfers that are some ten times as wide."""
    rest = fx.transfer_docs(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("collect_list(", 1)[1]
    depth = list(accumulate(((c == "(") - (c == ")") for c in rest), initial=1))
    collected = rest[: depth.index(0)]
    assert "event_type" in collected and "source_chain" not in collected


def test_enriched_rows_are_made_by_compiled_code(spark, tmp_path):
    """The JVM interprets methods of over 8,000 bytes; the widest one is that which parses a response into the fan-out's rows."""
    fx.transfer_docs(spark, SF).write.json(f"{tmp_path}/in")
    docs = src.transfer_rows(spark.read.schema(schemas.UNWRAPPED_DOCS).json(f"{tmp_path}/in"))
    rows = enrich.enrich_transfers(enrich.scale_amount(enrich.to_transfer_model(docs))).drop(*ingest.NOT_FANNED_OUT)
    stages = rows._jdf.queryExecution().debug().codegenToSeq()
    sizes = [int(stages.apply(i)._3().maxMethodCodeSize()) for i in range(stages.size())]
    assert sizes and max(sizes) < 8000
