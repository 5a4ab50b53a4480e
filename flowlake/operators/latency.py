"""Packet latency per route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUTE = ["source_chain", "dest_chain"]
EVENTS = ["packet_recv", "write_ack", "packet_ack"]
STATS = ["p5", "median", "p95"]
VALUES = [f"{e}_{s}" for e in EVENTS for s in STATS]
#: Input column of the packets table for each event.
SECONDS = {"packet_recv": "recv_secs", "write_ack": "write_ack_secs", "packet_ack": "ack_secs"}


def latency_percentiles(packets: DataFrame, approximate: bool = False) -> DataFrame:
    """AGG25: p5, median and p95 of each event per route, to 3 places.

    ``approximate`` uses mergeable quantile sketches, which is the form for routes of billions of packets.
    """
    quantile = F.percentile_approx if approximate else F.percentile
    lists = [quantile(F.col(SECONDS[e]), [0.05, 0.5, 0.95]).alias(e) for e in EVENTS]
    grouped = packets.groupBy(*ROUTE, "source_name", "dest_name").agg(*lists)
    values = [F.round(F.element_at(e, i + 1), 3).alias(f"{e}_{s}") for e in EVENTS for i, s in enumerate(STATS)]
    return grouped.select(*ROUTE, "source_name", "dest_name", *values)


#: Size of a quantile sketch: of 1,000, the rank of a quantile is off by at most RANK_ERROR with 99 % confidence.
SKETCH_SIZE = 1000
RANK_ERROR = 0.005
_NAMED = [*ROUTE, "source_name", "dest_name"]


def latency_sketches(packets: DataFrame, by: list[str]) -> DataFrame:
    """AGG25 as stored state: a quantile sketch of each event per route and ``by`` (a day, say). Memory per group is that of the sketches."""
    return packets.groupBy(*_NAMED, *by).agg(*[F.kll_sketch_agg_double(SECONDS[e], SKETCH_SIZE).alias(e) for e in EVENTS])


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the same route and ``by`` as one."""
    return sketches.groupBy(*_NAMED, *by).agg(*[F.kll_merge_agg_double(e, SKETCH_SIZE).alias(e) for e in EVENTS])


def percentiles_of(sketches: DataFrame) -> DataFrame:
    """AGG25 of stored sketches: those of a route are merged, no packet is read. With ``packets``, their number."""
    merged = merged_sketches(sketches, [])
    quantiles = [F.kll_sketch_get_quantile_double(F.col(e), F.lit(q)).alias(f"{e}_{s}") for e in EVENTS for s, q in zip(STATS, (0.05, 0.5, 0.95))]
    return merged.select(*_NAMED, F.kll_sketch_get_n_double(EVENTS[0]).alias("packets"), *quantiles)


def with_names(latency: DataFrame, chains: DataFrame) -> DataFrame:
    """Latency rows with the display names of their chains; a chain without one goes by its id."""
    names = chains.select("universal_chain_id", F.nullif("display_name", F.lit("")).alias("name")).dropDuplicates(["universal_chain_id"])
    for side in ("source", "dest"):
        own = names.select(F.col("universal_chain_id").alias(f"{side}_chain"), F.col("name").alias(f"{side}_name"))
        latency = latency.join(own, f"{side}_chain", "left").withColumn(f"{side}_name", F.coalesce(f"{side}_name", f"{side}_chain"))
    return latency


def latest_latency(latency: DataFrame) -> DataFrame:
    """JN2: rows of the newest snapshot of each route; equal instants are all kept, equal rows once."""
    newest = Window.partitionBy(*ROUTE).orderBy(F.desc("fetched_at"))
    return latency.withColumn("r", F.rank().over(newest)).filter("r = 1").drop("r").distinct()


def latency_document(latency: DataFrame) -> DataFrame:
    """DOC3: routes with nested p5 / median / p95 structs."""
    nested = [F.struct(*[F.col(f"{e}_{s}").alias(s) for s in STATS]).alias(e) for e in EVENTS]
    return latest_latency(latency).select(*ROUTE, "source_name", "dest_name", *nested)


def latency_ranking(latency: DataFrame, source: str | None = None, dest: str | None = None) -> DataFrame:
    """TOP3: routes by median acknowledgement time; 4 rows, or 12 where a source or destination is chosen."""
    rows = latency.filter(" AND ".join(f"{e}_median IS NOT NULL" for e in EVENTS))
    if source:
        rows = rows.filter(F.col("source_name") == source)
    if dest:
        rows = rows.filter(F.col("dest_name") == dest)
    return rows.orderBy("packet_ack_median", *ROUTE).limit(12 if source or dest else 4)


def latency_endpoints(latency: DataFrame, source: str | None = None) -> DataFrame:
    """SET3: kind ('source' or 'destination'), name: what can be chosen; destinations of the chosen source only."""
    named = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    sources = latency.filter(named("source_name")).select(F.lit("source").alias("kind"), F.col("source_name").alias("name"))
    dests = latency if not source else latency.filter(F.col("source_name") == source)
    dests = dests.filter(named("dest_name")).select(F.lit("destination").alias("kind"), F.col("dest_name").alias("name"))
    return sources.unionByName(dests).distinct()


def latency_scale(latency: DataFrame) -> DataFrame:
    """SCL1: one row per route, event and statistic with the route's and the padded global bounds.

    ``position`` is the square-root position in percent between the route's bounds.
    """
    rows = [
        F.struct(F.lit(e).alias("event"), F.lit(s).alias("stat"), F.col(f"{e}_{s}").alias("value")) for e in EVENTS for s in STATS
    ]
    long = latency.select(*ROUTE, F.explode(F.array(*rows)).alias("x")).select(*ROUTE, "x.*").filter("value IS NOT NULL")
    route = Window.partitionBy(*ROUTE)
    long = long.withColumn("route_min", F.min("value").over(route)).withColumn("route_max", F.max("value").over(route))
    bounds = latency.agg(
        F.min(F.least(*VALUES)).alias("lo"), F.max(F.greatest(*VALUES)).alias("hi"))
    pad = F.greatest((F.col("hi") - F.col("lo")) * 0.05, F.col("hi") * 0.01)
    bounds = bounds.select(
        F.round(F.greatest(F.lit(0.0), F.col("lo") - pad), 6).alias("global_min"), F.round(F.col("hi") + pad, 6).alias("global_max"))
    place = F.sqrt(F.col("value") - F.col("route_min")) / F.sqrt(F.col("route_max") - F.col("route_min")) * 100
    position = F.when(F.col("route_max") > F.col("route_min"), place).otherwise(0.0)
    return long.withColumn("position", F.round(position, 6)).crossJoin(F.broadcast(bounds))  # bounds: one row


def chain_pairs(chains: DataFrame) -> DataFrame:
    """JN4: all ordered pairs of different chains, with names. The chains dimension is small by nature."""
    ids = chains.select("universal_chain_id", F.coalesce(F.nullif("display_name", F.lit("")), "chain_id", "universal_chain_id").alias("name")).distinct()
    a = ids.select(F.col("universal_chain_id").alias("source_chain"), F.col("name").alias("source_name"))
    b = ids.select(F.col("universal_chain_id").alias("dest_chain"), F.col("name").alias("dest_name"))
    return a.join(b, F.col("source_chain") != F.col("dest_chain"))


def latency_for_pairs(pairs: DataFrame, latency: DataFrame) -> DataFrame:
    """JN5: pairs with latency; pairs without are dropped."""
    return pairs.join(latency.select(*ROUTE, *VALUES), ROUTE)
