"""Exact deduplication by progressive refinement: byte length, then prefix hash, then full hash.

Only narrow keys are shuffled. A text is hashed in full only if another text has its length and
its prefix hash.

Defined results for odd input
* A null text counts as the empty text; all empty texts are copies of each other.
* Of equal texts the row with the largest ``id_col`` stays; null ids lose to any other id, and
  where all ids of a group are null its ``keep_id`` is null and one of the rows stays.
* Repeated rows (same id and text) are copies: exactly one of them stays.
* An empty table gives an empty result. Other columns of the input are not looked at, so their
  names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import broadcast_if_small, materialize

#: Characters of a text that the second step hashes.
PREFIX_CHARS = 64


def _keyed(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """id, text, n_bytes and prefix_hash. A column that a step does not use is not computed by it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix_hash"),
    )


def full_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lower-case hex."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def shared_lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Step 1: n_bytes of which there are two texts or more."""
    lengths = docs.select(F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n_bytes")).groupBy("n_bytes").count()
    return materialize(lengths.filter("count > 1").select("n_bytes"), "dedup-lengths")


def surviving_keys(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """Step 2: (n_bytes, prefix_hash) of two texts or more. Prefixes are hashed of texts that share their length only."""
    lengths = broadcast_if_small(shared_lengths(docs, text_col))
    keyed = _keyed(docs, id_col, text_col, prefix_chars).join(lengths, "n_bytes", "left_semi")
    counted = keyed.groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n"))
    return materialize(counted.filter("n > 1").select("n_bytes", "prefix_hash"), "dedup-survivors")


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """Step 3: groups of two or more equal texts: n_bytes, prefix_hash, text_sha256, keep_id, group_size.

    Full content is read of texts that share length and prefix only.
    """
    keys = broadcast_if_small(surviving_keys(docs, id_col, text_col, prefix_chars))
    survivors = _keyed(docs, id_col, text_col, prefix_chars).join(keys, ["n_bytes", "prefix_hash"], "left_semi")
    return (
        survivors.select("id", "n_bytes", "prefix_hash", full_hash(F.col("text")).alias("text_sha256"))
        .groupBy("n_bytes", "prefix_hash", "text_sha256")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Groups come from the refinement and are joined by its keys; the digest of a row outside of any
    group is a column of the result and decides nothing.
    """
    # written first, so that the join below deals rows by plain exchanges: a hot text can be split
    groups = broadcast_if_small(materialize(duplicate_groups(docs, id_col, text_col, prefix_chars), "dedup-groups"))
    keys = ["n_bytes", "prefix_hash", "text_sha256"]
    keyed = _keyed(docs, id_col, text_col, prefix_chars).withColumn("text_sha256", full_hash(F.col("text")))
    rows = keyed.groupBy("id", *keys).agg(F.count("*").alias("copies"))
    # repeated rows are told apart by their copy number only
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return (
        rows.join(groups, keys, "left")
        .select("id", "text_sha256", "keep_id", "group_size", copy)
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("group_size").isNull() | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))).alias(
                "kept"
            ),
            "text_sha256",
        )
    )


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """``docs`` without the rows that are not kept; of texts outside a group no more than the prefix is hashed.

    Where several rows of a group have the id that stays, one of them stays.
    """
    keys = ["__bytes", "__prefix"]
    groups = materialize(duplicate_groups(docs, id_col, text_col, prefix_chars), "dedup-groups")
    few = broadcast_if_small(materialize(
        groups.select(F.col("n_bytes").alias("__bytes"), F.col("prefix_hash").alias("__prefix")).distinct(), "dedup-survivors"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__bytes": F.octet_length(text), "__prefix": F.xxhash64(F.substring(text, 1, prefix_chars))})
    alone = keyed.join(few, keys, "left_anti")
    among = keyed.join(few, keys, "left_semi").withColumn("__sha", full_hash(F.col(text_col)))
    stays = groups.select(F.col("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep"), F.lit(True).alias("__in"))
    among = among.join(broadcast_if_small(stays), "__sha", "left")
    single = among.filter("__in IS NULL").select(*docs.columns)
    kept = among.filter(F.col("__in") & F.col(id_col).eqNullSafe(F.col("__keep"))).dropDuplicates(["__sha"]).select(*docs.columns)
    return alone.select(*docs.columns).unionByName(single).unionByName(kept)
