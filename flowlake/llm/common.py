"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.files import remove, shared_path

#: Most rows that may be broadcast. Callers broadcast a few numbers or short strings per row, so
#: this bounds a broadcast to roughly 100 MB; anything larger is joined by shuffling instead.
MAX_BROADCAST_ROWS = 500_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation. Pass the reader to
    ``release`` once nothing that is still to run reads it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._flowlake_path = path
    return written


@contextmanager
def text_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of ``rows`` texts for the actions inside, so that Python workers hold few texts at a time."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def give_back() -> None:
    """In a Python worker: return the memory of finished batches to the system. Workers live on idle, beside tasks that need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # other C libraries
        pass


def release(*written: DataFrame) -> None:
    """Delete the files of tables of ``materialize`` that have served; other frames are left alone."""
    for df in written:
        path = getattr(df, "_flowlake_path", None)
        if path is not None:
            remove(df.sparkSession, path)


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if a count shows at most ``max_rows`` rows, else ``df`` for a shuffled join.

    Give it something materialised: the count is an action, which then reads file footers only.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast general ``lower``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def split_words(text: Column, between: str) -> Column:
    """Words of a text: what lies between matches of ``between``. Splitting is several times faster than matching words."""
    return F.array_remove(F.split(text, between), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once, also where ``body`` uses it several times or inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def single_rows(docs: DataFrame, keys: list[Column], repeated: DataFrame) -> DataFrame:
    """``docs`` with one row for each key that ``repeated`` lists (columns __r0, __r1, ...).

    Only rows with a repeated key are shuffled with their texts; the others are passed through.
    """
    if repeated.isEmpty():
        return docs
    repeated = broadcast_if_small(repeated)
    same = [k.eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    twice = docs.join(repeated, on, "left_semi").withColumns({f"__r{i}": k for i, k in enumerate(keys)})
    twice = twice.dropDuplicates([f"__r{i}" for i in range(len(keys))]).drop(*[f"__r{i}" for i in range(len(keys))])
    return docs.join(repeated, on, "left_anti").unionByName(twice)
