"""Operator inputs derived from the star-schema and event tables (see FIXTURES.md)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str, prefix: str = "") -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _shipments(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Line items with the nation of their supplier and of their customer, whom the fewer orders find first."""
    t = lambda name: read(spark, sf_dir, name)
    ns = t("nation").select(F.col("n_nationkey").alias("ns_key"), F.col("n_name").alias("ns_name"))
    nc = t("nation").select(F.col("n_nationkey").alias("nc_key"), F.col("n_name").alias("nc_name"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(ns, F.col("s_nationkey") == F.col("ns_key"))
        .join(nc, F.col("c_nationkey") == F.col("nc_key"))
    )


def _lines(lines: DataFrame) -> DataFrame:
    """Line items ranked among those of one key. They are dealt by order, as their join with orders asks for."""
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
    )
    return lines.repartition("l_orderkey").withColumn("rn", F.row_number().over(order))


def _with_parts(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    return lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))


def _as_transfers(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("packet_hash"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        _text("ns_key", "nation-").alias("source_chain"),
        _text("nc_key", "nation-").alias("dest_chain"),
        F.col("ns_name").alias("source_name"),
        F.col("nc_name").alias("dest_name"),
        F.col("s_name").alias("sender"),
        F.col("c_name").alias("receiver"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.col("p_brand").alias("token_symbol"),
        F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_type")).alias("canonical_token_symbol"),
        "rn",
    )


def transfers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers of day granularity, with repeated packet hashes; ``rn`` = 1 marks the row that an append keeps.

    Parts are joined while rows are narrow, and orders last, so the rows of a packet come out of one task.
    """
    lines = _with_parts(spark, sf_dir, read(spark, sf_dir, "lineitem"))
    return _as_transfers(_shipments(spark, sf_dir, _lines(lines)))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transfers of first rank, which are ranked as narrow rows before any join."""
    lines = _lines(read(spark, sf_dir, "lineitem")).filter("rn = 1")
    return _as_transfers(_with_parts(spark, sf_dir, _shipments(spark, sf_dir, lines))).drop("rn")


def transfers_rt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers with sub-second timestamps, from ``events``."""
    e = read(spark, sf_dir, "events")
    source = F.concat(F.lit("chain-"), (F.col("user_id") % 7).cast("string"))
    dest = F.concat(F.lit("chain-"), (F.col("event_id") % 5).cast("string"))
    canonical = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.upper("event_type"))
    return e.select(
        _text("event_id", "pkt-").alias("packet_hash"),
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("sort_order"),
        source.alias("source_chain"),
        dest.alias("dest_chain"),
        F.upper(source).alias("source_name"),
        F.upper(dest).alias("dest_name"),
        _text("user_id", "w-").alias("sender"),
        F.concat(F.lit("w-"), (F.col("event_id") % 211).cast("string")).alias("receiver"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.col("event_type").alias("token_symbol"),
        canonical.alias("canonical_token_symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_id").alias("ingest_seq"),
    )


def node_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    chain = (F.col("user_id") % 5).cast("string")
    error = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("chain-"), chain).alias("chain_id"),
        F.concat(F.lit("Chain "), chain).alias("chain_name"),
        F.concat(F.lit("https://rpc-"), (F.col("user_id") % 20).cast("string"), F.lit(".example")).alias("rpc_url"),
        F.when(F.col("user_id") % 2 == 0, "cosmos").otherwise("evm").alias("rpc_type"),
        F.when(error, "unhealthy").when(F.col("event_type") == "signup", "degraded").otherwise("healthy").alias("status"),
        F.round("value").cast("int").alias("response_time_ms"),
        F.when(~error, F.col("event_id")).alias("latest_block_height"),
        F.when(error, "timeout").alias("error_message"),
        F.when(error, 0.0).otherwise(100.0).alias("uptime"),
        F.col("ts").cast("timestamp").alias("checked_at"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("rpc_url", F.concat(F.lit("https://rpc-"), (F.col("user_id") % 20).cast("string"), F.lit(".example")))
    e = e.withColumn("run", F.date_trunc("day", "ts"))
    error = F.col("event_type") == "error"
    return e.select(
        "rpc_url",
        F.concat(F.lit("chain-"), (F.col("user_id") % 5).cast("string")).alias("chain_id"),
        "run",
        F.row_number().over(Window.partitionBy("rpc_url", "run").orderBy("ts", "event_id")).alias("seq"),
        F.col("event_type").alias("name"),
        (~error).alias("success"),
        F.round("value").cast("long").alias("response_ms"),
        F.when(~error, F.col("event_id")).alias("block_height"),
        F.when(error, "timeout").alias("error"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shipments(spark, sf_dir, read(spark, sf_dir, "lineitem")).select(
        _text("ns_key", "nation-").alias("source_chain"),
        _text("nc_key", "nation-").alias("dest_chain"),
        F.col("ns_name").alias("source_name"),
        F.col("nc_name").alias("dest_name"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("double").alias("recv_secs"),
        (F.col("l_quantity") + F.col("l_linenumber")).cast("double").alias("write_ack_secs"),
        (F.col("l_quantity") + 2 * F.col("l_linenumber")).cast("double").alias("ack_secs"),
    )


#: The two snapshots of ``latency_data``.
FETCHED = [datetime(2024, 1, 1), datetime(2024, 1, 2)]


def latency_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of percentiles per route; the later one is of even line numbers."""
    from flowlake.operators.latency import latency_percentiles

    p = packets(spark, sf_dir)
    first = latency_percentiles(p).withColumn("fetched_at", F.lit(FETCHED[0]))
    second = latency_percentiles(p.filter("line % 2 = 0")).withColumn("fetched_at", F.lit(FETCHED[1]))
    return first.unionByName(second)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    level = F.element_at(F.array(*[F.lit(x) for x in ("DEBUG", "INFO", "WARN", "ERROR")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        level.alias("level"),
        F.col("event_type").alias("component"),
        F.col("props").cast("string").alias("message"),
        F.col("event_id").alias("seq"),
    )


#: Events of a transfer response.
PER_RESPONSE = 50


def transfer_docs(spark: SparkSession, sf_dir: str, per_response: int = PER_RESPONSE, tasks: int | None = None) -> DataFrame:
    """Transfer responses of the wire format, of ``per_response`` events each; every tenth carries an error.

    They are made in ``tasks`` tasks, or in as many as Spark takes for the events.
    """
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    # events are dealt and collected as they are: their items are some ten times as wide, and made as a response is read
    dealt = e.withColumn("n", F.floor(F.col("event_id") / per_response)).repartition(*([tasks] if tasks else []), "n")
    grouped = dealt.groupBy("n").agg(F.array_sort(F.collect_list(F.struct(*e.columns))).alias("rows"))
    errors = F.when(F.col("n") % 10 == 9, F.array(F.struct(F.lit("timeout").alias("message"))))
    return grouped.select(F.struct(F.transform("rows", _item).alias("v2_transfers")).alias("data"), errors.alias("errors"))


def _item(e: F.Column) -> F.Column:
    """The transfer of an event, as responses have it."""
    key = lambda column, n, prefix: F.concat(F.lit(prefix), (e[column] % n).cast("string"))
    text = lambda column, prefix: F.concat(F.lit(prefix), e[column].cast("string"))

    def chain(id_: F.Column, odd: F.Column) -> F.Column:
        return F.struct(
            id_.alias("universal_chain_id"), F.concat(F.lit("id-"), id_).alias("chain_id"), F.upper(id_).alias("display_name"),
            odd.alias("testnet"), F.when(odd, "evm").otherwise("cosmos").alias("rpc_type"), F.lit("pre").alias("addr_prefix"))

    wrapping = F.array(F.struct(
        F.lit(0).alias("index"), F.struct(key("user_id", 7, "chain-").alias("universal_chain_id")).alias("unwrapped_chain"),
        F.hex(e["event_id"]).alias("unwrapped_address_hex"), F.struct(key("event_id", 5, "chain-").alias("universal_chain_id")).alias("wrapped_chain")))
    return F.struct(
        chain(key("user_id", 7, "chain-"), e["user_id"] % 2 == 1).alias("source_chain"),
        chain(key("event_id", 5, "chain-"), e["event_id"] % 5 == 3).alias("destination_chain"),
        text("user_id", "w-").alias("sender_canonical"), F.when(e["event_id"] % 2 == 0, text("user_id", "shown-")).alias("sender_display"),
        key("event_id", 211, "w-").alias("receiver_canonical"), F.lit("").alias("receiver_display"),
        F.date_format(e["ts"].cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("transfer_send_timestamp"),
        F.when(e["event_id"] % 3 == 0, F.lit("")).otherwise(text("event_id", "tx-")).alias("transfer_send_transaction_hash"),
        F.lit("tok").alias("base_token"), F.round(e["value"] * 100).cast("long").cast("string").alias("base_amount"),
        e["event_type"].alias("base_token_symbol"), F.lit(2).alias("base_token_decimals"),
        F.lpad(e["event_id"].cast("string"), 20, "0").alias("sort_order"), text("event_id", "pkt-").alias("packet_hash"),
        F.lit("wrap").alias("wrap_direction"),
        F.struct(wrapping.alias("wrapping")).alias("quote_token_meta"), F.struct(wrapping.alias("wrapping")).alias("base_token_meta"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    name = F.lower(F.regexp_replace("n_name", " ", "-"))
    url = lambda kind: F.struct(F.concat(F.lit("https://"), name, F.lit(kind)).alias("url"))
    odd = F.col("n_nationkey") % 2 == 1
    return n.select(
        _text("n_nationkey", "nation-").alias("universal_chain_id"),
        _text("n_nationkey", "id-").alias("chain_id"),
        F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).otherwise(F.lit("")).alias("display_name"),
        odd.alias("testnet"),
        F.when(odd, "evm").otherwise("cosmos").alias("rpc_type"),
        F.when(odd, "0x").otherwise(F.lower(F.substring("n_name", 1, 4))).alias("addr_prefix"),
        F.array(url(".example/rpc"), url(".example:9090/grpc"), url(".example/rest/v1")).alias("rpcs"),
    )


def latest(df: DataFrame, column: str = "timestamp") -> datetime:
    """The newest instant of a table, as the literal that stands for now."""
    return df.agg(F.max(column)).first()[0]


def latest_transfer(spark: SparkSession, sf_dir: str) -> datetime:
    """``latest`` of ``transfers`` without its joins: the kept line item of a key is its earliest, and every key has its parents."""
    kept = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("ts"))
    return kept.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
