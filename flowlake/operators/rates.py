"""Transfer counts over trailing periods, and their change. One scan and one row of counters each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions.columns import PERIODS, RATE_PERIODS, SCALE_PERIODS, ago, in_prev_window, in_window, instant, percent_change, period_rank, since


def _count(condition) -> F.Column:
    return F.count(F.when(condition, 1))


def transfer_rates(t: DataFrame, as_of, everything: DataFrame | None = None) -> DataFrame:
    """AGG1: period, count, calculated_at for all time and six trailing periods.

    Where ``t`` holds the rows of 30 days only, ``everything`` is the whole table: its rows are counted without reading a column.
    """
    total = F.count("*").alias("all")
    counters = [_count(in_window(F.col("timestamp"), as_of, p)).alias(p) for p in RATE_PERIODS]
    wide = t.agg(total, *counters) if everything is None else everything.agg(total).crossJoin(F.broadcast(t.agg(*counters)))  # one row each
    return wide.unpivot([], wide.columns, "period", "count").withColumn("calculated_at", instant(as_of))


def transfer_rates_legacy(t: DataFrame, as_of) -> DataFrame:
    """AGG2: minute, hour, day and total counts in one row."""
    return t.agg(
        _count(in_window(F.col("timestamp"), as_of, "1m")).alias("per_minute"),
        _count(in_window(F.col("timestamp"), as_of, "1h")).alias("per_hour"),
        _count(in_window(F.col("timestamp"), as_of, "1d")).alias("per_day"),
        F.count("*").alias("total"),
    )


def transfer_rate_changes(t: DataFrame, as_of) -> DataFrame:
    """AGG3: current and previous count of each period and the change in percent.

    Five minutes are compared with a fifth of the 25 minutes before them; no earlier rows, no change.
    """
    return changes_of(since(t, as_of, 2 * PERIODS["30d"]).agg(*change_counters(as_of)))


def change_counters(as_of) -> list[F.Column]:
    """cur_ and prev_ count of each period, and base: the 25 minutes before the last five."""
    ts, counters = F.col("timestamp"), []
    for p in RATE_PERIODS:
        counters += [_count(in_window(ts, as_of, p)).alias(f"cur_{p}"), _count(in_prev_window(ts, as_of, p)).alias(f"prev_{p}")]
    base = (ts > ago(as_of, 1800)) & (ts <= ago(as_of, PERIODS["5m"]))
    return [*counters, _count(base).alias("base")]


def changes_of(wide: DataFrame) -> DataFrame:
    """AGG3 of one row of its counters."""
    rows = [
        F.struct(
            F.lit(p).alias("period"),
            F.col(f"cur_{p}").alias("current_count"),
            F.col(f"prev_{p}").alias("prev_count"),
            F.round(percent_change(F.col(f"cur_{p}"), F.col("base") / 5 if p == "5m" else F.col(f"prev_{p}")), 6).alias("change_pct"),
        )
        for p in RATE_PERIODS
    ]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def order_periods(df: DataFrame, column: str = "period") -> DataFrame:
    """TOP1: rows from 30d down to 5m; other periods last."""
    return df.orderBy(period_rank(F.col(column)), column)


def data_availability(t: DataFrame, as_of) -> DataFrame:
    """AGG19: whether each trailing period has transfers, and the 30-day flag served for all of them."""
    counts = [_count(in_window(F.col("timestamp"), as_of, p)).alias(p) for p in SCALE_PERIODS]
    return availability_of(since(t, as_of, PERIODS["30d"]).agg(*counts))


def availability_of(counts: DataFrame) -> DataFrame:
    """AGG19 of one row with the count of each time scale."""
    names = {"1m": "has_minute", "1h": "has_hour", "1d": "has_day", "7d": "has_7_days", "14d": "has_14_days", "30d": "has_30_days"}
    return counts.select(*[(F.col(p) > 0).alias(name) for p, name in names.items()]).withColumn("served", F.col("has_30_days"))
