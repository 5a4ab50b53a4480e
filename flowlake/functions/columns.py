"""Column expressions: periods, windows, labels and address forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60, 3600, 86400
#: Seconds of each trailing period.
PERIODS = {"1m": MINUTE, "5m": 5 * MINUTE, "1h": HOUR, "1d": DAY, "7d": 7 * DAY, "14d": 14 * DAY, "30d": 30 * DAY}
RATE_PERIODS = ["5m", "1h", "1d", "7d", "14d", "30d"]
SCALE_PERIODS = ["1m", "1h", "1d", "7d", "14d", "30d"]
ARROW = "→"


def instant(as_of: Column | datetime) -> Column:
    """A literal where ``as_of`` is a datetime, so that windows on it can prune files."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def ago(as_of: Column | datetime, seconds: int) -> Column:
    return instant(as_of) - F.expr(f"INTERVAL {seconds} SECONDS")


def in_window(ts: Column, as_of: Column | datetime, period: str) -> Column:
    """Trailing window: as_of - period < ts <= as_of."""
    return (ts > ago(as_of, PERIODS[period])) & (ts <= instant(as_of))


def in_prev_window(ts: Column, as_of: Column | datetime, period: str) -> Column:
    """The window of the same length before: as_of - 2 periods < ts <= as_of - period."""
    return (ts > ago(as_of, 2 * PERIODS[period])) & (ts <= ago(as_of, PERIODS[period]))


def since(t: DataFrame, as_of: Column | datetime, seconds: int) -> DataFrame:
    """Rows newer than ``as_of`` less ``seconds``; of a table partitioned by date, only those partitions are listed."""
    recent = t.filter(F.col("timestamp") > ago(as_of, seconds))
    return recent.filter(F.col("date") >= F.to_date(ago(as_of, seconds))) if "date" in t.columns else recent


def asset_key(canonical: str = "canonical_token_symbol", symbol: str = "token_symbol") -> Column:
    return F.coalesce(F.nullif(F.col(canonical), F.lit("")), F.col(symbol))


def route_label(by: str = "id") -> Column:
    source, dest = ("source_chain", "dest_chain") if by == "id" else ("source_name", "dest_name")
    return F.concat(F.col(source), F.lit(ARROW), F.col(dest))


def shorten_address(address: Column, head: int = 8, tail: int = 6, min_len: int = 16) -> Column:
    """head...tail of an address longer than ``min_len``."""
    short = F.concat(F.substring(address, 1, head), F.lit("..."), F.right(address, F.lit(tail)))
    return F.when(F.length(address) > min_len, short).otherwise(address)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def percent_change(now: Column, before: Column) -> Column:
    """(now - before) / before in percent; 0 without a before."""
    now, before = now.cast("double"), before.cast("double")
    return F.when(before > 0, (now - before) / before * 100).otherwise(F.lit(0.0))


def period_rank(period: Column) -> Column:
    """30d, 14d, 7d, 1d, 1h, 5m: the display order."""
    out = F.lit(len(RATE_PERIODS) + 1)
    for rank, name in enumerate(reversed(RATE_PERIODS), start=1):
        out = F.when(period == name, rank).otherwise(out)
    return out
