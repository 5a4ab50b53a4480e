"""Idempotent appends, messages and summary tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.files import children, exists, read_text, remove, shared_path, write_text
from flowlake.sources.segments import KeyStore


def new_rows(keys: DataFrame, batch: DataFrame, key_columns: list[str], order: list | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is new: one per key (the first by ``order``), none that ``keys`` has.

    ``keys`` holds the key columns only, so the fact table itself is never read for an append. Keys and
    batch are dealt by key together, once; a stored key comes before the rows of the batch.
    """
    rows = batch.withColumn("__stored", F.lit(False)).unionByName(keys.select(*key_columns).withColumn("__stored", F.lit(True)), allowMissingColumns=True)
    within = Window.partitionBy(*key_columns).orderBy(F.desc("__stored"), *(order or [F.col(c) for c in sorted(batch.columns)]))
    # not by row_number: rows would also be sorted before they are dealt, and spilled
    return rows.withColumn("__before", F.lag("__stored").over(within)).filter("__before IS NULL AND NOT __stored").drop("__stored", "__before")


def append_transfers(existing: DataFrame, batch: DataFrame, order: list | None = None) -> DataFrame:
    """SNK1 / JN6: ``existing`` with the new packets of ``batch``; stored rows win."""
    return existing.unionByName(new_rows(existing.select("packet_hash"), batch, ["packet_hash"], order))


def append_snapshot(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """SNK7: the same under another unique key."""
    return existing.unionByName(new_rows(existing.select(*keys), batch, keys))


def store_transfers(spark: SparkSession, path: str, batch: DataFrame, held: bool = False) -> int:
    """SNK1 at rest: append what is new to ``path``/facts (by date, in the order of the sort key) and its keys to ``path``/keys.

    The key store opens only what the batch's keys may be in, and new keys are found among keys alone:
    whole rows are dealt by key only where a batch mixes new rows with stored or repeated ones. A marker
    with the dates of a batch stands while it is being written. Where a batch finds the marker of a
    failed one, it also takes the keys of the facts of those dates into account, so nothing is appended
    twice. The batch is persisted meanwhile, unless the caller says that what it is read from is ``held`` already.
    """
    facts, marker, key = f"{path}/facts", f"{path}/_pending", ["packet_hash"]
    keys = KeyStore(spark, f"{path}/keys", key)
    batch = batch if held else batch.persist()
    try:
        known = keys.known(batch)
        lost = _lost_keys(spark, facts, marker)
        if lost is not None:
            known = lost if known is None else known.unionByName(lost)
        known = batch.select(*key).limit(0) if known is None else known
        new_keys = new_rows(known, batch.select(*key), key)
        n = new_keys.count()
        mixed = 0 < n < batch.count()
        fresh = (new_rows(known, batch, key) if mixed else batch).withColumn("date", F.to_date("timestamp"))
        fresh = fresh.persist() if mixed else fresh
        try:
            if n:
                write_text(spark, marker, json.dumps([str(r[0]) for r in fresh.select("date").distinct().collect()]))
                clustered = [F.col(c) for c in ("date", "sort_order") if c in fresh.columns]
                fresh.repartition("date").sortWithinPartitions(*clustered).write.mode("append").partitionBy("date").parquet(facts)
            if n or lost is not None:
                found = fresh.select(*key) if n else lost
                keys.add(found.unionByName(lost) if n and lost is not None else found)
        finally:
            if mixed:
                fresh.unpersist()
    finally:
        if not held:
            batch.unpersist()
    remove(spark, marker)
    return n


def _lost_keys(spark: SparkSession, facts: str, marker: str) -> DataFrame | None:
    """Keys of the facts that a failed batch may have written, which are those of its dates."""
    if not exists(spark, marker) or not children(spark, facts):
        return None
    stored, dates = spark.read.parquet(facts), json.loads(read_text(spark, marker) or "null")
    return (stored if dates is None else stored.filter(F.col("date").cast("string").isin(dates))).select("packet_hash").distinct()


#: Unique keys and the time of the snapshot tables.
SNAPSHOTS = {"latency": (["source_chain", "dest_chain", "fetched_at"], "fetched_at"), "health": (["rpc_url", "checked_at"], "checked_at")}


def store_snapshot(spark: SparkSession, path: str, batch: DataFrame, table: str) -> int:
    """SNK7 at rest: merge ``batch`` into ``path``/table, by date; stored rows win. Returns the number of new rows.

    Only the dates of the batch are read. Dates that get rows are written anew as a whole, in one
    exchange of partitions, so a repeated or failed batch leaves no row twice and dates stay few files.
    """
    keys, time = SNAPSHOTS[table]
    at, batch = f"{path}/{table}", batch.withColumn("date", F.to_date(time)).persist()
    try:
        dates = [r[0] for r in batch.select("date").distinct().collect()]
        there = [f"{at}/date={d}" for d in dates if d is not None and exists(spark, f"{at}/date={d}")]
        stored = spark.read.schema(batch.schema).option("basePath", at).parquet(*there) if there else batch.limit(0)
        fresh = new_rows(stored.select(*keys), batch, keys).persist()
        try:
            n = fresh.count()
            if n:
                touched = fresh.select("date").distinct()
                merged = stored.join(F.broadcast(touched), "date", "left_semi").select(*batch.columns).unionByName(fresh)  # a batch has few dates
                draft = shared_path(spark, "snapshot")
                merged.repartition("date").write.parquet(draft)
                spark.read.schema(batch.schema).parquet(draft).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(at)
                remove(spark, draft)
        finally:
            fresh.unpersist()
    finally:
        batch.unpersist()
    return n


def transfer_messages(df: DataFrame) -> DataFrame:
    """SNK3: one message per row: {"type": "transfers", "data": [row]}."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.to_json(F.struct(F.lit("transfers").alias("type"), F.array(row).alias("data"))).alias("value"))


def chart_message(doc: DataFrame, column: str = "doc") -> DataFrame:
    """SNK4: {"type": "chartData", "data": document}."""
    return doc.select(F.to_json(F.struct(F.lit("chartData").alias("type"), F.col(column).alias("data"))).alias("value"))


def summary_rows(df: DataFrame, chart_type: str, time_scale: str, as_of) -> DataFrame:
    """SNK5: chart_type, time_scale, data_json, updated_at: a ranked list as one JSON payload."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in df.columns])))
    return df.agg(F.to_json(rows).alias("data_json")).select(
        F.lit(chart_type).alias("chart_type"), F.lit(time_scale).alias("time_scale"), "data_json", F.lit(as_of).alias("updated_at"))


def store_summary(df: DataFrame, chart_type: str, time_scale: str, as_of, path: str) -> None:
    """SNK5 at rest: replace the one partition of (chart_type, time_scale)."""
    rows = summary_rows(df, chart_type, time_scale, as_of)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chart_type", "time_scale").parquet(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Stored summaries. The schema is stated: a time scale of 1d would be inferred to be a number."""
    return spark.read.schema("data_json string, updated_at timestamp, chart_type string, time_scale string").parquet(path)
