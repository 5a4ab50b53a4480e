"""Streams: ingest, fan-out, messages, refresh and windowed counts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlake import schemas
from flowlake.files import children
from flowlake.functions.columns import PERIODS, RATE_PERIODS, since
from flowlake.operators import enrich, latency
from flowlake.operators.health import health_checks, last_states
from flowlake.plans.documents import dashboard
from flowlake.plans.refresh import COLUMNS, current, read_all_summaries, refresh_incremental
from flowlake.sources import sinks
from flowlake.sources.cursors import latest_cursor
from flowlake.sources.documents import stream_transfer_docs
from flowlake.sources.segments import Segments

#: Rows come late by the depth of the backfill; a watermark of less would drop them.
WATERMARK = "31 days"
BUCKET_SECONDS = PERIODS["5m"]
#: Columns of enriched rows that neither facts nor messages have.
NOT_FANNED_OUT = ["quote_wrapping", "base_wrapping", "base_token", "base_amount", "base_token_decimals", "wrap_direction", "tx_hash", "amount_overflow"]


def ingest_stream(spark: SparkSession, path: str, max_files: int | None = None, wrappings: bool = True) -> DataFrame:
    """STR1: enriched transfer rows of the responses that arrive in ``path``; ``wrappings`` of tokens can be left out."""
    docs = stream_transfer_docs(spark, path, max_files, schemas.TRANSFER_DOCS if wrappings else schemas.UNWRAPPED_DOCS)
    rows = enrich.to_transfer_model(docs)
    return enrich.enrich_transfers(enrich.scale_amount(rows))


def message_stream(stream: DataFrame) -> DataFrame:
    """STR4: one message per enriched transfer."""
    return sinks.transfer_messages(enrich.to_broadcast(stream))


def fan_out(store: str, messages: str) -> Callable[[DataFrame, int], None]:
    """STR2: a ``foreachBatch`` function that stores every batch and writes its messages.

    The batch's id names its messages, so a repeated batch replaces them instead of adding.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            sinks.store_transfers(batch.sparkSession, store, enrich.to_fact_rows(batch), held=True)
            message_stream(batch).write.mode("overwrite").option("compression", "gzip").text(f"{messages}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def store_only(store: str) -> Callable[[DataFrame, int], None]:
    """STR2 for backfilled rows: stored, not broadcast."""
    return lambda batch, batch_id: sinks.store_transfers(batch.sparkSession, store, enrich.to_fact_rows(batch))


def start_ingest(stream: DataFrame, store: str, messages: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """STR1-3: run the fan-out every ``interval``, or once over all that is there."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.drop(*NOT_FANNED_OUT).writeStream.foreachBatch(fan_out(store, messages)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def dedup_stream(stream: DataFrame, horizon: str = WATERMARK) -> DataFrame:
    """STR3: packets once within ``horizon``. Rows later than the horizon are dropped, so it is an optional
    step before the append, which by itself accepts any lateness."""
    timed = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return timed.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark(["packet_hash"])


def refresh_stream(spark: SparkSession, store: str, out: str, checkpoint: str, interval: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """STR5: whenever facts have arrived, at most every ``interval``, fold them into the partials and publish the summaries.

    The checkpoint knows the files that were folded, so a refresh reads new facts only. ``once`` does it
    for all that is there and ends.
    """
    facts = f"{store}/facts"
    arrived = spark.readStream.schema(spark.read.parquet(facts).schema).parquet(facts)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            refresh_batch(batch, batch_id, store, out)
        finally:
            batch.unpersist()

    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return arrived.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def refresh_now(spark: SparkSession, store: str, out: str) -> None:
    """One refresh of all facts that have not been folded yet; the checkpoint is ``out``/checkpoint."""
    refresh_stream(spark, store, out, f"{out}/checkpoint", once=True).awaitTermination()


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if children(spark, path) else spark.createDataFrame([], schema)


def refresh_batch(batch: DataFrame, number: int, store: str, out: str) -> None:
    """One refresh; then its dashboard, read from the new summaries, as a message in the version's folder.

    Latency and node records are those in ``store``/latency and ``store``/health (``store_latency``,
    ``store_probes``); their sections are empty where there are none.
    """
    spark = batch.sparkSession
    facts = spark.read.parquet(f"{store}/facts")
    if refresh_incremental(facts, batch, number, out) is None:
        return
    now = current(spark, out)
    as_of = datetime.fromisoformat(now["as_of"])
    latency_data, health = _stored(spark, f"{store}/latency", schemas.LATENCY), _stored(spark, f"{store}/health", schemas.NODE_HEALTH)
    doc = dashboard(since(facts, as_of, 2 * PERIODS["30d"]).select(*COLUMNS), latency_data, health, as_of, stored=read_all_summaries(spark, out))
    sinks.chart_message(doc).coalesce(1).write.mode("overwrite").text(f"{out}/{now['version']}/message")


def read_message(spark: SparkSession, out: str) -> DataFrame:
    """SNK4: the message of the last refresh."""
    return spark.read.text(f"{out}/{current(spark, out)['version']}/message")


def store_latency(path: str, chains: DataFrame) -> Callable[[DataFrame, int], None]:
    """SRC4 into SNK7: a ``foreachBatch`` function that stores latency rows under the names of their chains.

    The instant of the batch is in the column ``fetched_at`` of its rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.store_snapshot(batch.sparkSession, path, latency.with_names(batch, chains).select(*_columns(schemas.LATENCY)), "latency")

    return write


def store_probes(path: str, chains: DataFrame) -> Callable[[DataFrame, int], None]:
    """AGG23 into SNK7: a ``foreachBatch`` function that rolls probes up and stores the checks of nodes with their uptime.

    A run's probes come in one batch. Uptime follows the check before, which is looked up among the
    stored ones of the last day and, beyond that, in the newest states under ``path``/health_states.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        states = Segments(spark, f"{path}/health_states", last_states)
        known = states.read()
        last = spark.createDataFrame([], "rpc_url string, checked_at timestamp, status string") if known is None else last_states(known)
        checks = health_checks(batch, chains, _stored(spark, f"{path}/health", schemas.NODE_HEALTH), last).persist()
        try:
            if sinks.store_snapshot(spark, path, checks.select(*_columns(schemas.NODE_HEALTH)), "health"):
                states.add(last_states(checks))
        finally:
            checks.unpersist()

    return write


def _columns(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def window_partials(df: DataFrame) -> DataFrame:
    """Counts per tumbling five minutes, of a batch or a stream."""
    return df.groupBy(F.window("timestamp", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.sum("amount").alias("volume")).select(
        F.col("w.start").alias("window_start"), "n", "volume")


def windowed_rates_stream(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """STR6: the same kept incrementally; run in update mode, each window replacing its last value."""
    timed = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", watermark)
    return window_partials(timed)


def rates_from_partials(partials: DataFrame, as_of: Column) -> DataFrame:
    """Trailing counts from five-minute partials; ``as_of`` is floored to five minutes."""
    floor = F.timestamp_seconds(F.floor(F.unix_timestamp(as_of) / BUCKET_SECONDS) * BUCKET_SECONDS)
    start = F.col("window_start")
    sums = []
    for p in RATE_PERIODS:
        start_at = floor - F.expr(f"INTERVAL {PERIODS[p]} SECONDS")
        sums.append(F.coalesce(F.sum(F.when((start >= start_at) & (start < floor), F.col("n"))), F.lit(0)).alias(p))
    wide = partials.agg(*sums)
    return wide.unpivot([], RATE_PERIODS, "period", "count")


def _windows(spark: SparkSession, path: str) -> Segments:
    last = lambda rows: rows.groupBy("window_start").agg(F.max_by(F.struct("n", "volume", "batch"), "batch").alias("x")).select("window_start", "x.*")
    return Segments(spark, path, last)


def upsert_partials(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: store the windows of the batch; of a window the last batch counts.

    A batch writes its own windows only, and a repeated batch is passed over. Segments of batches are
    merged by level, so the store stays as large as its windows. One ``path`` per checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _windows(batch.sparkSession, path).add(batch.select("window_start", "n", "volume", F.lit(batch_id).cast("long").alias("batch")), "windows", batch_id)

    return write


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """The stored windows."""
    store = _windows(spark, path)
    return store.merge(store.read()).select("window_start", "n", "volume")


def resume_cursor(t: DataFrame) -> str | None:
    """STR7: where a stream without a checkpoint starts: the newest stored sort key."""
    return latest_cursor(t).first()[0]
