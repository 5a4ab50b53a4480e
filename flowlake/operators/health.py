"""Node health: snapshots, probes and endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.columns import DAY, HOUR, ago, instant

STATUSES = ["healthy", "degraded", "unhealthy"]


def latest_node_health(h: DataFrame, as_of) -> DataFrame:
    """JN3: newest check of each node in the last hour; equal instants are all kept."""
    recent = h.filter((F.col("checked_at") > ago(as_of, HOUR)) & (F.col("checked_at") <= instant(as_of)))
    newest = Window.partitionBy("rpc_url").orderBy(F.desc("checked_at"))
    return recent.withColumn("r", F.rank().over(newest)).filter("r = 1").drop("r")


def _count(status: str) -> Column:
    return F.count(F.when(F.col("status") == status, 1))


def node_health_summary(h: DataFrame, as_of) -> DataFrame:
    """AGG21: nodes by status and the mean response of healthy and degraded nodes that answered."""
    answered = F.col("status").isin("healthy", "degraded") & (F.col("response_time_ms") > 0)
    return latest_node_health(h, as_of).agg(
        F.count("*").alias("total_nodes"),
        *[_count(s).alias(f"{s}_nodes") for s in STATUSES],
        F.round(F.coalesce(F.avg(F.when(answered, F.col("response_time_ms"))), F.lit(0.0)), 6).alias("avg_response_time"),
    )


def chain_health(h: DataFrame, as_of) -> DataFrame:
    """AGG22: nodes by status per chain, score = share of healthy nodes in percent, mean response and uptime."""
    grouped = latest_node_health(h, as_of).groupBy("chain_id").agg(
        F.min("chain_name").alias("chain_name"),
        F.count("*").alias("total_nodes"),
        *[_count(s).alias(f"{s}_nodes") for s in STATUSES],
        F.round(F.avg("response_time_ms"), 6).alias("avg_response_time"),
        F.round(F.avg("uptime"), 6).alias("uptime"),
    )
    return grouped.withColumn("health_score", F.round(F.col("healthy_nodes") / F.col("total_nodes") * 100, 6))


def health_percentage(summary: DataFrame) -> DataFrame:
    """SCL2: healthy share in whole percent, 0 without nodes."""
    share = F.floor(F.col("healthy_nodes") / F.col("total_nodes") * 100 + 0.5)
    return summary.select(F.coalesce(F.when(F.col("total_nodes") > 0, share), F.lit(0)).cast("long").alias("health_percentage"))


def node_availability(h: DataFrame, as_of) -> DataFrame:
    """AGG19: whether the last hour, day, 7, 14 and 30 days have checks."""
    spans = {"has_hour": HOUR, "has_day": DAY, "has_7_days": 7 * DAY, "has_14_days": 14 * DAY, "has_30_days": 30 * DAY}
    at = F.col("checked_at")
    return h.filter(at > ago(as_of, 30 * DAY)).agg(*[(F.count(F.when((at > ago(as_of, s)) & (at <= instant(as_of)), 1)) > 0).alias(name) for name, s in spans.items()])


def probe_rollup(probes: DataFrame) -> DataFrame:
    """AGG23: status of each node's run from its probes.

    At least 80 % successes are healthy, 50 % degraded, less unhealthy.
    """
    failure = F.when(~F.col("success") & F.col("error").isNotNull(), F.struct("seq", F.concat_ws(": ", "name", "error").alias("text")))
    height = F.when(F.col("success"), F.col("block_height"))
    grouped = probes.groupBy("rpc_url", "chain_id", "run").agg(
        F.count("*").alias("checks"),
        F.count(F.when(F.col("success"), 1)).alias("passed"),
        F.floor(F.sum("response_ms") / F.count("*")).cast("long").alias("response_time_ms"),
        F.min_by(height, F.when(height.isNotNull(), F.col("seq"))).alias("height"),
        F.array_join(F.transform(F.array_sort(F.collect_list(failure)), lambda x: x["text"]), "; ").alias("errors"),
    )
    rate = F.col("passed") / F.col("checks")
    status = F.when(rate >= 0.8, "healthy").when(rate >= 0.5, "degraded").otherwise("unhealthy")
    failed = F.concat((F.col("checks") - F.col("passed")).cast("string"), F.lit("/"), F.col("checks").cast("string"))
    message = F.when(F.col("status") == "degraded", F.concat(F.lit("Partial failure: "), failed, F.lit(" checks failed"))).when(
        F.col("status") == "unhealthy",
        F.when(F.col("errors") != "", F.col("errors")).otherwise(F.concat(F.lit("Failed "), failed, F.lit(" health checks"))),
    )
    return grouped.withColumn("status", status).select(
        "rpc_url", "chain_id", "run", "checks", "passed", "status", "response_time_ms",
        F.when(F.col("status") != "unhealthy", F.col("height")).alias("latest_block_height"),
        message.alias("error_message"),
    )


def last_states(checks: DataFrame) -> DataFrame:
    """rpc_url, checked_at, status of the newest check of each node."""
    return checks.groupBy("rpc_url").agg(F.max("checked_at").alias("checked_at"), F.max_by("status", "checked_at").alias("status"))


def health_checks(probes: DataFrame, chains: DataFrame, stored: DataFrame, last: DataFrame) -> DataFrame:
    """Rows of the node-health table from probes: AGG23 with names, and the uptime of WIN3 going on from what is ``stored``.

    Of the stored checks only those from a day before the probes' first run on are looked at; a longer gap
    is bridged by ``last``, the newest state of each node. (A late check that lies in such a gap itself has
    no state before it.)
    """
    first = F.broadcast(probes.agg((F.min("run") - F.expr("INTERVAL 1 DAY")).alias("since")))  # one row
    names = chains.select("universal_chain_id", F.coalesce(F.nullif("display_name", F.lit("")), "universal_chain_id").alias("chain_name"), F.col("rpc_type")).dropDuplicates(["universal_chain_id"])
    found = probe_rollup(probes).select(
        "chain_id", "rpc_url", "status", F.col("response_time_ms").cast("int").alias("response_time_ms"), "latest_block_height", "error_message",
        F.col("run").alias("checked_at"), F.lit(True).alias("new"))
    found = found.join(names, found["chain_id"] == names["universal_chain_id"], "left").drop("universal_chain_id")
    found = found.withColumn("chain_name", F.coalesce("chain_name", "chain_id"))
    before = stored.join(first, F.col("checked_at") >= F.col("since"), "left_semi").select("rpc_url", "status", "checked_at", F.lit(False).alias("new"))
    older = last.join(first, F.col("checked_at") < F.col("since"), "left_semi").select("rpc_url", "status", "checked_at", F.lit(False).alias("new"))
    before = before.unionByName(older)
    both = found.unionByName(before, allowMissingColumns=True)
    up = F.when(F.col("status").isin("healthy", "degraded"), 100.0).otherwise(0.0)
    last = F.lag(up).over(Window.partitionBy("rpc_url").orderBy("checked_at", F.desc("new")))
    return both.withColumn("uptime", F.coalesce(last, F.lit(0.0))).filter("new").drop("new")


def probe_status_counts(probes: DataFrame) -> DataFrame:
    """AGG24: nodes by status per run."""
    return probe_rollup(probes).groupBy("run").agg(F.count("*").alias("total_nodes"), *[_count(s).alias(f"{s}_nodes") for s in STATUSES])


def node_uptime(h: DataFrame) -> DataFrame:
    """WIN3: 100 where the check before was healthy or degraded, else 0; and the share over 24 hours.

    A check is counted from its instant on and taken off a day later, so the share is a running count and
    costs the same for each row, however many checks a day has. Running counts are kept within an hour of
    a node; what came before the hour is carried on by a narrow window over one row for each node and hour.
    """
    up = F.when(F.col("status").isin("healthy", "degraded"), 1).otherwise(0)
    rows = h.select("rpc_url", "status", "latest_block_height", up.alias("up"), F.unix_micros("checked_at").alias("at"))
    mark = lambda at, sign: F.struct(at.alias("mark"), F.lit(sign).alias("sign"))
    marks = rows.select("*", F.inline(F.array(mark(F.col("at"), 1), mark(F.col("at") + DAY * 1_000_000 + 1, -1)))).drop("at").filter("sign > 0 OR mark IS NOT NULL")
    marks = marks.withColumns({
        "slot": F.floor(F.col("mark") / (HOUR * 1_000_000)), "signed": F.col("sign") * F.col("up"), "own": F.when(F.col("sign") > 0, F.col("up"))})
    slots = marks.groupBy("rpc_url", "slot").agg(
        F.sum("sign").alias("n"), F.sum("signed").alias("ups"), F.max_by("up", F.when(F.col("sign") > 0, F.struct("mark", "latest_block_height"))).alias("own"))
    past = Window.partitionBy("rpc_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    timed = lambda c: F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col(c))).over(past), F.lit(0))  # noqa: E731  checks without an instant are in no day
    carried = slots.select(
        F.col("rpc_url").alias("node"), F.col("slot").alias("of"), timed("n").alias("n0"), timed("ups").alias("ups0"), F.last("own", ignorenulls=True).over(past).alias("own0"))
    near = Window.partitionBy("rpc_url", "slot")
    upto = near.orderBy("mark").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("own", ignorenulls=True).over(near.orderBy("mark", "latest_block_height").rowsBetween(Window.unboundedPreceding, -1))
    found = marks.withColumns({"before": last, "n": F.sum("sign").over(upto), "ups": F.sum("signed").over(upto)}).filter("sign > 0")
    found = found.join(carried, F.col("rpc_url").eqNullSafe(F.col("node")) & F.col("slot").eqNullSafe(F.col("of")), "left")
    return found.select(
        "rpc_url", F.timestamp_micros("mark").alias("checked_at"), "status", F.coalesce(F.coalesce("before", "own0") * 100.0, F.lit(0.0)).alias("uptime"),
        F.round((F.col("ups") + F.col("ups0")) * 100.0 / (F.col("n") + F.col("n0")), 6).alias("uptime_24h"))


def node_list(h: DataFrame, status: str = "all", sort: str = "chain") -> DataFrame:
    """TOP4: nodes of a status, ordered by chain, status, response (unanswered last) or uptime."""
    rows = h if status == "all" else h.filter(F.col("status") == status)
    rank = F.lit(len(STATUSES))
    for i, s in enumerate(STATUSES):
        rank = F.when(F.col("status") == s, i).otherwise(rank)
    order = {
        "chain": F.col("chain_name").asc(),
        "status": rank.asc(),
        "response": F.nullif("response_time_ms", F.lit(0)).asc_nulls_last(),
        "uptime": F.col("uptime").desc(),
    }[sort]
    return rows.orderBy(order, "rpc_url", "checked_at")


#: Parts of a URL that mark an endpoint that is not JSON-RPC.
NOT_RPC = r"grpc|/rest/|rest\.|api\.|/api/"


def rpc_endpoints(chains: DataFrame) -> DataFrame:
    """PRJ12: endpoints of each chain with the flag ``is_rpc``."""
    urls = chains.select("universal_chain_id", F.explode("rpcs.url").alias("rpc_url"))
    return urls.withColumn("is_rpc", ~F.lower("rpc_url").rlike(NOT_RPC))


def endpoint_counts(chains: DataFrame) -> DataFrame:
    """AGG24: endpoints, those kept as JSON-RPC and those filtered."""
    return rpc_endpoints(chains).agg(
        F.count("*").alias("total_endpoints"), F.count(F.when(F.col("is_rpc"), 1)).alias("rpc_endpoints"),
        F.count(F.when(~F.col("is_rpc"), 1)).alias("filtered_endpoints"))
