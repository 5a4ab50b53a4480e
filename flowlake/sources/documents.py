"""Wire documents and stored tables as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import schemas
from flowlake.functions.columns import DAY, since


def read_transfers(spark: SparkSession, path: str, as_of=None, days: int | None = None) -> DataFrame:
    """SRC1: the transfers table; with ``as_of`` and ``days`` only the partitions and rows of that time."""
    stored = spark.read.schema(schemas.TRANSFERS).parquet(path)
    return stored if as_of is None or days is None else since(stored, as_of, days * DAY)


def stream_forward(spark: SparkSession, path: str, cursor: str | None = None, max_files: int | None = None) -> DataFrame:
    """SRC5 as a stream: stored transfers after ``cursor``, each file once as it arrives, ``max_files`` per batch.

    The checkpoint remembers the files that were read, so no batch reads earlier ones again and rows of
    equal sort keys all arrive.
    """
    reader = spark.readStream.schema(schemas.TRANSFERS)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stored = reader.parquet(path)
    return stored if cursor is None else stored.filter(F.col("sort_order") > cursor)


def _accepted(docs: DataFrame) -> DataFrame:
    """Responses without errors; one error rejects its whole response."""
    return docs.filter(F.coalesce(F.size("errors"), F.lit(0)) <= 0)


def transfer_rows(docs: DataFrame) -> DataFrame:
    """SRC2: rows of transfer responses, batch or streaming."""
    return _accepted(docs).select(F.explode("data.v2_transfers").alias("t")).select("t.*")


def read_transfer_docs(spark: SparkSession, path: str) -> DataFrame:
    return transfer_rows(spark.read.schema(schemas.TRANSFER_DOCS).json(path))


def stream_transfer_docs(spark: SparkSession, path: str, max_files: int | None = None, schema: str = schemas.TRANSFER_DOCS) -> DataFrame:
    """SRC2 as a stream. JSON is parsed by ``schema``: what it leaves out is skipped, not parsed."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return transfer_rows(reader.json(path))


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: the chains dimension with its endpoints."""
    docs = spark.read.schema(schemas.CHAIN_DOCS).json(path)
    rows = _accepted(docs).select(F.explode("data.v2_chains").alias("c")).select("c.*")
    return rows.withColumn("rpcs", F.transform("rpcs", lambda r: F.struct(r["url"].alias("url"))))


def read_latency_docs(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: the first statistics of each pair as flat columns; pairs without any are dropped."""
    docs = _accepted(spark.read.schema(schemas.LATENCY_DOCS).json(path))
    first = docs.select("source_chain", "dest_chain", F.get(F.col("data.v2_stats_latency"), F.lit(0)).alias("s")).filter("s IS NOT NULL")
    wire = {"packet_ack": "secs_until_packet_ack", "packet_recv": "secs_until_packet_recv", "write_ack": "secs_until_write_ack"}
    stats = [F.col(f"s.{field}.{stat}").alias(f"{event}_{stat}") for event, field in wire.items() for stat in ("p5", "median", "p95")]
    return first.select("source_chain", "dest_chain", *stats)
