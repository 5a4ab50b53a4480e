"""Incremental reads by the monotone sort key of transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions.columns import DAY, ago


def read_forward(src: DataFrame, cursor: str | None, limit: int) -> tuple[DataFrame, str | None]:
    """SRC5: the next rows after ``cursor``; without one, the latest. Returns the rows and the new cursor.

    A page ends with all rows of its last sort key, which may be more than ``limit``: the cursor is a
    sort key, so rows of an equal one would be passed over by the next page.
    """
    keyed = src.filter(F.col("sort_order").isNotNull())
    key = F.col("sort_order")
    ahead = keyed if cursor is None else keyed.filter(key > cursor)
    edges = ahead.select(key).orderBy(key.desc() if cursor is None else key.asc()).limit(limit).agg(F.min(key), F.max(key)).first()
    if edges[1] is None:
        return ahead.limit(0), cursor
    return (keyed.filter(key >= edges[0]), keyed.agg(F.max(key)).first()[0]) if cursor is None else (ahead.filter(key <= edges[1]), edges[1])


def read_backward(src: DataFrame, cursor: str, as_of, depth_days: int = 30) -> DataFrame:
    """SRC6: everything before ``cursor`` down to the depth. Pages have no use here: it is one pruned range scan."""
    deep_enough = F.col("timestamp") >= ago(as_of, depth_days * DAY)
    return src.filter((F.col("sort_order") < cursor) & deep_enough)


def latest_cursor(t: DataFrame) -> DataFrame:
    """SRC8: sort key of the newest row that has one."""
    keyed = t.filter(F.coalesce("sort_order", F.lit("")) != "")
    return keyed.agg(F.max_by("sort_order", F.struct("timestamp", "ingest_seq")).alias("cursor"))


def earliest_cursor(t: DataFrame) -> DataFrame:
    """SRC8: sort key of the oldest row that has one."""
    keyed = t.filter(F.coalesce("sort_order", F.lit("")) != "")
    return keyed.agg(F.min_by("sort_order", F.struct("timestamp", "ingest_seq")).alias("cursor"))


def needs_backfill(t: DataFrame) -> DataFrame:
    """SRC9: needed, reason: only a table with rows and a sort key is filled backward."""
    keyed = F.when(F.coalesce("sort_order", F.lit("")) != "", F.col("sort_order"))
    state = t.agg(F.count("*").alias("n"), F.count(keyed).alias("k"))
    reason = F.when(F.col("n") == 0, "empty table").when(F.col("k") == 0, "no sort order").otherwise("rows to extend")
    return state.select(((F.col("n") > 0) & (F.col("k") > 0)).alias("needed"), reason.alias("reason"))
