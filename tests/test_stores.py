"""Stores at rest: keys, segments, snapshots."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.files import Manifest, children
from flowlake.sources import segments, sinks
from flowlake.sources.segments import KeyStore, Segments


def _keys(spark, numbers):
    return spark.createDataFrame([(f"p{i}", i) for i in numbers], "packet_hash string, other long")


def test_manifest_keeps_two_documents(spark, tmp_path):
    m = Manifest(spark, f"{tmp_path}/m")
    assert m.current() == {} and m.history() == []
    for i in range(4):
        m.commit({"i": i})
    assert m.current() == {"i": 3} and m.history() == [{"i": 2}, {"i": 3}] and len([c for c in children(spark, f"{tmp_path}/m") if c.endswith(".json")]) == 2


def test_segments_merge_by_level_and_apply_batches_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 3)
    store = Segments(spark, f"{tmp_path}/s", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))
    for i in range(10):
        assert store.add(spark.createDataFrame([(i % 2, 1)], "k long, n long"), "a", i)
    assert not store.add(spark.createDataFrame([(0, 1)], "k long, n long"), "a", 9)
    assert sorted(s["level"] for s in store.live()) == [0, 2]
    assert {r["k"]: r["n"] for r in store.read().groupBy("k").agg(F.sum("n").alias("n")).collect()} == {0: 5, 1: 5}
    listed = {s["name"] for d in store.manifest.history() for s in d["segments"]}
    assert {c for c in children(spark, store.path) if c.startswith("segment-")} == listed


@pytest.mark.parametrize("per_bucket", [1_000_000, 20])
def test_key_store_knows_its_keys(spark, tmp_path, monkeypatch, per_bucket):
    monkeypatch.setattr(segments, "KEYS_PER_BUCKET", per_bucket)
    monkeypatch.setattr(segments, "FAN", 3)
    store = KeyStore(spark, f"{tmp_path}/k", ["packet_hash"])
    assert store.known(_keys(spark, range(3))) is None
    for at in range(0, 500, 100):
        store.add(_keys(spark, range(at, at + 100)))
    for some in (range(480, 520), range(1000, 1100), range(-5, 5)):
        batch = _keys(spark, some)
        known = store.known(batch)
        found = [] if known is None else batch.join(known, "packet_hash", "left_semi").collect()
        assert sorted(r["other"] for r in found) == [i for i in some if 0 <= i < 500]
    null = spark.createDataFrame([(None,)], "packet_hash string")
    assert store.known(null) is None
    store.add(null)
    assert store.known(null).filter("packet_hash IS NULL").count() == 1


def test_an_append_opens_only_buckets_that_its_keys_may_be_in(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "KEYS_PER_BUCKET", 50)
    store = KeyStore(spark, f"{tmp_path}/k", ["packet_hash"])
    store.add(_keys(spark, range(2000)))
    (segment,) = store.live()
    assert segment["buckets"] == 40
    folders = lambda: {c for c in children(spark, f"{store.path}/{segment['name']}/keys") if c.startswith("bucket=")}
    assert len(folders()) == 40
    known = store.known(_keys(spark, [7]))
    assert len(store.opened) == 1 and len(known.inputFiles()) == 1
    assert store.known(_keys(spark, [7, 8, 9])) is not None and len(store.opened) <= 3
    store.known(_keys(spark, range(10_000, 10_200)))  # none is stored: filters keep nearly all buckets shut
    assert len(store.opened) <= 6


def _transfers(spark, numbers):
    rows = [(f"p{i}", f"{i:06}", datetime(2024, 1, 1) + timedelta(hours=i % 72)) for i in numbers]
    return spark.createDataFrame(rows, "packet_hash string, sort_order string, timestamp timestamp")


def test_store_transfers_equals_the_append_in_memory(spark, tmp_path):
    path, want = f"{tmp_path}/t", None
    for some in (range(0, 60), range(40, 120), range(0, 120), range(200, 203)):
        batch = _transfers(spark, some)
        want = sinks.append_transfers(batch.limit(0) if want is None else want, batch)
        sinks.store_transfers(spark, path, batch.unionByName(batch))
    got = spark.read.parquet(f"{path}/facts").drop("date")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_whole_rows_are_dealt_by_key_only_in_mixed_batches(spark, tmp_path, monkeypatch):
    """Where a batch is new as a whole, or stored as a whole, keys alone are shuffled to find that out."""
    dealt = []
    new_rows = sinks.new_rows
    monkeypatch.setattr(sinks, "new_rows", lambda keys, batch, *a: dealt.append(batch.columns) or new_rows(keys, batch, *a))
    for some, again, new, wide in ((range(60), 1, 60, False), (range(60), 1, 0, False), (range(60, 90), 1, 30, False), (range(80, 100), 1, 10, True), (range(100, 110), 2, 10, True), (range(110), 2, 0, False)):
        dealt.clear()
        batch = reduce(DataFrame.unionByName, [_transfers(spark, some)] * again)
        assert sinks.store_transfers(spark, f"{tmp_path}/t", batch) == new
        assert any(c != ["packet_hash"] for c in dealt) == wide
    facts = spark.read.parquet(f"{tmp_path}/t/facts").drop("date")
    assert sorted(map(tuple, facts.collect())) == sorted(map(tuple, _transfers(spark, range(110)).collect()))


def test_facts_are_ordered_by_sort_key(spark, tmp_path):
    sinks.store_transfers(spark, f"{tmp_path}/t", _transfers(spark, range(300)).repartition(5))
    files = spark.read.parquet(f"{tmp_path}/t/facts").select(F.input_file_name().alias("f"), "date", "sort_order", F.monotonically_increasing_id().alias("at")).collect()
    assert len({r["f"] for r in files}) == 3  # a file a date
    for name in {r["f"] for r in files}:
        mine = [r["sort_order"] for r in sorted(files, key=lambda r: r["at"]) if r["f"] == name]
        assert mine == sorted(mine)


def test_failed_batch_is_found_by_its_dates(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.store_transfers(spark, path, _transfers(spark, range(10)))
    lost = _transfers(spark, range(10, 20)).withColumn("date", F.to_date("timestamp"))
    lost.write.mode("append").partitionBy("date").parquet(f"{path}/facts")
    (tmp_path / "t" / "_pending").write_text('["2024-01-01"]')
    assert sinks.store_transfers(spark, path, _transfers(spark, range(5, 25))) == 5
    assert sinks.store_transfers(spark, path, _transfers(spark, range(0, 25))) == 0
    assert spark.read.parquet(f"{path}/facts").count() == 25


def test_snapshots_are_unique_by_key_at_rest(spark, tmp_path):
    at = lambda d, h: datetime(2024, 1, d, h)
    make = lambda *rows: spark.createDataFrame(list(rows), "rpc_url string, checked_at timestamp, status string")
    path = str(tmp_path)
    assert sinks.store_snapshot(spark, path, make(("a", at(1, 0), "healthy"), ("b", at(1, 0), "healthy"), ("a", at(2, 0), "healthy")), "health") == 3
    before = {f for f in (tmp_path / "health" / "date=2024-01-02").iterdir()}
    assert sinks.store_snapshot(spark, path, make(("a", at(1, 0), "other"), ("a", at(1, 5), "degraded")), "health") == 1
    assert sinks.store_snapshot(spark, path, make(("a", at(1, 0), "other"), ("a", at(1, 5), "other")), "health") == 0
    got = spark.read.parquet(f"{path}/health").orderBy("rpc_url", "checked_at").collect()
    assert [(r["rpc_url"], r["checked_at"], r["status"]) for r in got] == [
        ("a", at(1, 0), "healthy"), ("a", at(1, 5), "degraded"), ("a", at(2, 0), "healthy"), ("b", at(1, 0), "healthy")]
    assert {f for f in (tmp_path / "health" / "date=2024-01-02").iterdir()} == before  # other dates are not written


def test_an_append_deals_its_rows_once(spark):
    """Keys and batch are shuffled together by key; null keys, repeated rows and repeated stored keys."""
    keys = spark.createDataFrame([("p1",), ("p1",), (None,)], "packet_hash string")
    batch = spark.createDataFrame([("p1", 1), (None, 2), ("p2", 4), ("p2", 3), ("p3", 5), ("p3", 5)], "packet_hash string, other long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fresh = sinks.new_rows(keys, batch, ["packet_hash"])
        assert fresh.columns == batch.columns
        assert sorted(map(tuple, fresh.collect())) == [("p2", 3), ("p3", 5)]
        plan = fresh._jdf.queryExecution().sparkPlan().toString(), fresh._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan[0] and plan[1].split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
        assert sorted(map(tuple, sinks.new_rows(keys.filter("packet_hash = 'p1'"), batch, ["packet_hash"], [F.desc("other")]).collect()), key=str) == [("p2", 4), ("p3", 5), (None, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
