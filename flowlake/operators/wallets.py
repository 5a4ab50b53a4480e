"""Unique and most active wallets.

A wallet is distinct in a trailing window exactly if it was last seen inside it. One grouping by
wallet with last-seen instants therefore answers all windows at once; no distinct count is shuffled
per window.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.columns import PERIODS, RATE_PERIODS, SCALE_PERIODS, ago, in_window, instant, percent_change, shorten_address


def _ends(t: DataFrame) -> DataFrame:
    """wallet, side, ts: both ends of each transfer."""
    side = lambda name, column: F.struct(F.lit(name).alias("side"), F.col(column).alias("wallet"))
    both = F.explode(F.array(side("s", "sender"), side("r", "receiver")))
    return t.select(F.col("timestamp").alias("ts"), both.alias("x")).select("ts", "x.side", "x.wallet").filter("wallet IS NOT NULL")


def _last(condition: Column) -> Column:
    return F.max(F.when(condition, F.col("ts")))


def _seen(last: str, as_of, seconds: int) -> Column:
    return F.count(F.when(F.col(last) > ago(as_of, seconds), 1))


def _to_rows(wide: DataFrame, periods: list[str], fields: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(p).alias("period"), *[F.col(f"{f}_{p}").alias(f) for f in fields]) for p in periods]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def overlap_total(s: Column, r: Column) -> Column:
    """greatest + 30 % of the least, the latter rounded half up."""
    part = F.round(F.least(s, r).cast("decimal(18,0)") * F.lit(Decimal("0.3")), 0).cast("long")
    return F.greatest(s, r) + part


def wallet_total_estimate(s: Column, r: Column, percent: int) -> Column:
    """AGG6: s + r less ``percent`` of the smaller side, truncated; nothing less where a side is empty."""
    return s + r - F.floor(F.least(s, r) * percent / 100).cast("long")


def _per_wallet(t: DataFrame, as_of) -> DataFrame:
    recent = _ends(t.filter(in_window(F.col("timestamp"), as_of, "30d")))
    s, r = F.col("side") == "s", F.col("side") == "r"
    return recent.groupBy("wallet").agg(_last(s).alias("s"), _last(r).alias("r"), F.max("ts").alias("any"))


def wallet_stats(t: DataFrame, as_of) -> DataFrame:
    """AGG4: unique senders and receivers per period and the estimated total."""
    return stats_of(_per_wallet(t, as_of), as_of)


def stats_of(per_wallet: DataFrame, as_of) -> DataFrame:
    """AGG4 of wallets with the instants ``s`` and ``r`` that they last sent and received at."""
    counters = [_seen(c, as_of, PERIODS[p]).alias(f"{name}_{p}") for p in RATE_PERIODS for c, name in (("s", "unique_senders"), ("r", "unique_receivers"))]
    rows = _to_rows(per_wallet.agg(*counters), RATE_PERIODS, ["unique_senders", "unique_receivers"])
    total = overlap_total(F.col("unique_senders"), F.col("unique_receivers"))
    return rows.withColumn("unique_total", total).withColumn("calculated_at", instant(as_of))


def wallet_stats_exact(t: DataFrame, as_of) -> DataFrame:
    """AGG5: the same with the exact number of wallets on either side."""
    names = [("s", "unique_senders"), ("r", "unique_receivers"), ("any", "unique_total")]
    counters = [_seen(c, as_of, PERIODS[p]).alias(f"{name}_{p}") for p in RATE_PERIODS for c, name in names]
    return _to_rows(_per_wallet(t, as_of).agg(*counters), RATE_PERIODS, [name for _, name in names])


def wallet_estimates(t: DataFrame, as_of) -> DataFrame:
    """AGG6: the three estimates of the total beside the exact total."""
    s, r = F.col("unique_senders"), F.col("unique_receivers")
    return wallet_stats_exact(t, as_of).select(
        "period", "unique_senders", "unique_receivers", F.col("unique_total").alias("exact_total"),
        *[wallet_total_estimate(s, r, p).alias(f"estimate_{p}") for p in (25, 30, 70)],
    )


def wallet_stats_approx(t: DataFrame, as_of, rsd: float = 0.02) -> DataFrame:
    """The exact counts' scalable relative: one mergeable sketch per side and period, no grouping by wallet."""
    ts = F.col("timestamp")
    counters = [
        F.approx_count_distinct(F.when(in_window(ts, as_of, p), F.col(c)), rsd).alias(f"{name}_{p}")
        for p in RATE_PERIODS for c, name in (("sender", "unique_senders"), ("receiver", "unique_receivers"))
    ]
    return _to_rows(t.agg(*counters), RATE_PERIODS, ["unique_senders", "unique_receivers"])


def wallet_rate_changes(t: DataFrame, as_of) -> DataFrame:
    """AGG7: wallets of each period and the one before, and the change in percent.

    The current total is ``overlap_total`` and the previous one s + r - 30 % of the smaller side, as
    served; ``exact_change`` compares exact totals instead. Five minutes are compared with a fifth
    of the 25 minutes before them, the total of which is taken by 0.7.
    """
    span = F.col("timestamp") > ago(as_of, 2 * PERIODS["30d"])
    ends = _ends(t.filter(span & (F.col("timestamp") <= instant(as_of))))
    by_side = ends.groupBy("wallet", "side").agg(F.max("ts").alias("now"), *[_last(F.col("ts") <= ago(as_of, PERIODS[p])).alias(p) for p in RATE_PERIODS])
    return changes_of(by_side, as_of)


def changes_of(by_side: DataFrame, as_of) -> DataFrame:
    """AGG7 of wallet and side ('s', 'r') with the last instant of all (now) and before each period."""
    sides = {"s": F.col("side") == "s", "r": F.col("side") == "r", "a": F.lit(True)}
    wallets = by_side.groupBy("wallet").agg(*[F.max(F.when(c, F.col(x))).alias(f"{k}_{x}") for k, c in sides.items() for x in ("now", *RATE_PERIODS)])
    counters = []
    for p in RATE_PERIODS:
        for k in sides:
            counters.append(_seen(f"{k}_now", as_of, PERIODS[p]).alias(f"cur_{k}_{p}"))
            counters.append(_seen(f"{k}_{p}", as_of, 1800 if p == "5m" else 2 * PERIODS[p]).alias(f"prev_{k}_{p}"))
    fields = [f"{w}_{k}" for w in ("cur", "prev") for k in sides]
    rows = _to_rows(wallets.agg(*counters), RATE_PERIODS, fields)
    five = F.col("period") == "5m"
    s, r, ps, pr = F.col("cur_s"), F.col("cur_r"), F.col("prev_s"), F.col("prev_r")
    prev_total = ps + pr - F.floor(F.least(ps, pr) * 30 / 100).cast("long")
    total = overlap_total(s, r)
    fifth = lambda c: F.when(five, c / 5).otherwise(c)
    five_total = F.when((ps > 0) & (pr > 0), (ps + pr) / 5 * 0.7).otherwise(0.0)
    return rows.select(
        "period",
        s.alias("senders"), r.alias("receivers"), total.alias("total"),
        ps.alias("prev_senders"), pr.alias("prev_receivers"), prev_total.alias("prev_total"),
        F.round(percent_change(s, fifth(ps)), 6).alias("senders_change"),
        F.round(percent_change(r, fifth(pr)), 6).alias("receivers_change"),
        F.round(percent_change(total, F.when(five, five_total).otherwise(prev_total)), 6).alias("total_change"),
        F.round(percent_change(F.col("cur_a"), fifth(F.col("prev_a"))), 6).alias("exact_change"),
    )


#: Seconds of a bucket of stored sketches, and the logarithm of a sketch's size; estimates are off by some 0.8 % (one standard deviation).
SKETCH_SECONDS, SKETCH_LOG = 300, 14


def wallet_sketches(t: DataFrame) -> DataFrame:
    """AGG4-7 as stored state: bucket, side, wallets: a distinct sketch of either side for every five minutes."""
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / SKETCH_SECONDS) * SKETCH_SECONDS)
    return _ends(t).groupBy(bucket.alias("bucket"), "side").agg(F.hll_sketch_agg("wallet", SKETCH_LOG).alias("wallets"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("bucket", "side").agg(F.hll_union_agg("wallets").alias("wallets"))


def wallet_stats_of_sketches(sketches: DataFrame, as_of) -> DataFrame:
    """Estimated senders, receivers and wallets of each period and the one before, without any transfer.

    ``as_of`` is floored to five minutes.
    """
    end = F.timestamp_seconds(F.floor(F.unix_timestamp(instant(as_of)) / SKETCH_SECONDS) * SKETCH_SECONDS)
    before = lambda seconds: end - F.expr(f"INTERVAL {seconds} SECONDS")
    at, fields, counters = F.col("bucket"), [], []
    for when, first, last in (("", 1, 0), ("prev_", 2, 1)):
        for name, side in (("senders", F.col("side") == "s"), ("receivers", F.col("side") == "r"), ("wallets", F.lit(True))):
            fields.append(when + name)
            for p in RATE_PERIODS:
                inside = side & (at >= before(first * PERIODS[p])) & (at < before(last * PERIODS[p]))
                estimate = F.hll_sketch_estimate(F.hll_union_agg(F.when(inside, F.col("wallets"))))
                counters.append(F.coalesce(estimate, F.lit(0)).alias(f"{when}{name}_{p}"))
    recent = sketches.filter((at >= before(2 * PERIODS["30d"])) & (at < end))
    return _to_rows(recent.agg(*counters), RATE_PERIODS, fields)


def tracked_totals(t: DataFrame, as_of) -> DataFrame:
    """AGG20: 30-day senders, receivers and their sum."""
    return wallet_stats(t, as_of).filter("period = '30d'").select(
        "unique_senders", "unique_receivers", (F.col("unique_senders") + F.col("unique_receivers")).alias("total_tracked"))


def distinct_wallets(t: DataFrame, since) -> DataFrame:
    """SET2: senders and receivers since an instant, each once."""
    return _ends(t.filter(F.col("timestamp") > instant(since))).select("wallet").distinct()


def _side(side: str) -> str:
    return {"sender": "sender", "receiver": "receiver"}[side]


def active_wallets(t: DataFrame, as_of, side: str, n: int = 50) -> DataFrame:
    """AGG16: the most active senders or receivers of 30 days."""
    recent = t.filter(in_window(F.col("timestamp"), as_of, "30d")).filter(F.col(_side(side)).isNotNull())
    return listed(recent.groupBy(F.col(_side(side)).alias("address")).agg(F.count("*").alias("count"), F.max("timestamp").alias("last_activity")), n)


def listed(grouped: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of wallets with their count and last activity."""
    top = grouped.orderBy(F.desc("count"), "address").limit(n)
    return top.select("address", shorten_address(F.col("address")).alias("display_address"), "count", "last_activity")


def top_wallets(t: DataFrame, since, side: str, limit: int) -> DataFrame:
    """AGG17: the most active senders or receivers since an instant."""
    recent = t.filter(F.col("timestamp") > instant(since)).filter(F.col(_side(side)).isNotNull())
    grouped = recent.groupBy(F.col(_side(side)).alias("address")).agg(F.count("*").alias("count"), F.max("timestamp").alias("last_activity"))
    return grouped.orderBy(F.desc("count"), "address").limit(limit).withColumn("display_address", shorten_address(F.col("address"), 6, 6, 12))


def active_wallets_by_scale(t: DataFrame, as_of, side: str, n: int = 10) -> DataFrame:
    """AGG17 for every time scale: one grouping, then the top of each scale."""
    ts = F.col("timestamp")
    recent = t.filter(in_window(ts, as_of, "30d")).filter(F.col(_side(side)).isNotNull())
    grouped = recent.groupBy(F.col(_side(side)).alias("address")).agg(
        *[F.count(F.when(in_window(ts, as_of, p), 1)).alias(p) for p in SCALE_PERIODS], F.max("timestamp").alias("last_activity"))
    return by_scale_of(grouped, n)


def by_scale_of(grouped: DataFrame, n: int) -> DataFrame:
    """AGG17 of wallets with their last activity and the count of each time scale."""
    long = grouped.unpivot(["address", "last_activity"], SCALE_PERIODS, "time_scale", "count").filter("count > 0")
    rank = F.row_number().over(Window.partitionBy("time_scale").orderBy(F.desc("count"), "address"))
    return long.withColumn("rank", rank).filter(F.col("rank") <= n)
