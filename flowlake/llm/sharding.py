"""Sharding over fixed virtual slots.

Records hash into ``n_slots`` virtual slots; the bytes of each slot are aggregated; a versioned
map says which shard holds which slot. The map lists every slot, also those that are empty so far,
so a corpus that grows keeps its map and loses nothing. It is the only thing that a rebalance edits:
that moves as few slots as it needs, and every record follows its slot. The map has ``n_slots`` rows
whatever the corpus, which is the proven bound that lets it be broadcast and be packed in one row.

A stored map is a folder of versions. ``shard_documents`` uses the newest one there is; only where
there is none it packs version 1, and only when told to rebalance it writes the next.

Defined results for odd input
* A null text has no bytes (size 16 with the default overhead) and the CRC-32 of the empty text.
* Slots hash id, size and CRC. Rows that repeat all three (repeated rows, null ids on one text) are
  dealt ``COPIES_TOGETHER`` at a time, so that no slot holds a hot group of them whole; they get
  different positions.
* Equal texts with different ids hash to different slots: nothing keeps copies together.
* An empty table gives an empty result, and a map that deals the empty slots evenly. Other columns
  are not looked at.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.files import children, exists, shared_path
from flowlake.llm.common import materialize

N_SLOTS = 4096
OVERHEAD_BYTES = 16
COPIES_TOGETHER = 64


def slot_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_slots: int = N_SLOTS,
    overhead: int = OVERHEAD_BYTES,
) -> DataFrame:
    """id, size, text_crc32, copies, virtual_slot: ``copies`` records that are alike go to the slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    alike = sized.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n"))
    dealt = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES_TOGETHER}"))))
    place = F.when(F.col("part") == 0, F.xxhash64("id", "size", "text_crc32")).otherwise(F.xxhash64("id", "size", "text_crc32", "part"))
    return dealt.select(
        "id",
        "size",
        "text_crc32",
        F.least(F.lit(COPIES_TOGETHER), F.col("n") - F.col("part") * COPIES_TOGETHER).alias("copies"),
        F.pmod(place, F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """bytes and n_rows of every virtual slot, empty ones included."""
    held = rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.sum("copies").alias("r"))
    slots = rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    zero = F.lit(0).cast("long")
    return slots.join(held, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("b", zero).alias("bytes"), F.coalesce("r", zero).alias("n_rows"))


def _pack(slots: DataFrame, n_shards: int, version: int, start=None) -> DataFrame:
    """Put slots, largest first, one after the other into the shard with the fewest bytes.

    One row of at most n_slots entries; ``start`` holds the bytes that shards have already. A slot
    counts a byte more than it holds, so that empty slots are dealt evenly too.
    """
    loads = start if start is not None else F.array_repeat(F.lit(0).cast("long"), n_shards)
    ordered = F.sort_array(F.collect_list(F.struct((F.col("bytes") + 1).alias("bytes"), "virtual_slot")), asc=False)
    one = slots.agg(ordered.alias("slots")).withColumn("loads", loads)

    def put(state, x):
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda b, i: F.when(i == least, b + x["bytes"]).otherwise(b)).alias("loads"),
            F.concat(state["shards"], F.array(least)).alias("shards"),
        )

    empty = F.struct(F.col("loads"), F.array().cast("array<int>").alias("shards"))
    packed = one.select("slots", F.aggregate("slots", empty, put, lambda s: s["shards"]).alias("shards"))
    pair = F.explode(F.arrays_zip(F.col("slots.virtual_slot").alias("virtual_slot"), "shards")).alias("x")
    return packed.select(pair).select(
        F.lit(version).alias("version"),
        F.col("x.virtual_slot").alias("virtual_slot"),
        F.col("x.shards").alias("shard"),
    )


def build_slot_map(sizes: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """First map: version, virtual_slot, shard of every slot in ``sizes``."""
    return _pack(sizes, n_shards, version)


def rebalance(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """Next version of a map for new sizes or another shard count.

    Slots leave a shard, largest first, only while what the shard holds is over its even share (or
    the shard is gone); those slots, and any the map does not list, are packed into the least filled
    shards. Every other slot stays where it is.
    """
    sized = sizes.join(F.broadcast(slot_map), "virtual_slot", "left")
    total = sizes.agg(F.sum("bytes")).scalar()
    version = slot_map.agg(F.max("version")).scalar() + 1
    by_size = Window.partitionBy("shard").orderBy(F.col("bytes"), "virtual_slot")
    held = sized.withColumn("below", F.sum("bytes").over(by_size)).withColumn("total", total)
    stays = (F.col("shard") < n_shards) & (F.col("below") * n_shards <= F.col("total"))
    held = held.withColumn("stays", F.coalesce(stays, F.lit(False)))
    kept = held.filter("stays").select("virtual_slot", "shard")
    shards = sizes.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    per_shard = shards.join(held.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("b")), "shard", "left")
    loads = per_shard.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("shard", F.coalesce("b", F.lit(0)).cast("long").alias("b")))),
            lambda x: x["b"],
        )
    ).scalar()
    moved = _pack(held.filter("NOT stays").select("bytes", "virtual_slot"), n_shards, 0, start=loads)
    both = kept.unionByName(moved.select("virtual_slot", "shard"))
    return both.select(version.alias("version"), "virtual_slot", "shard")


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a stored map that were written to their end, in order."""
    named = [n for n in children(spark, path) if n.startswith("version=") and exists(spark, f"{path}/{n}/_SUCCESS")]
    return sorted(int(n.removeprefix("version=")) for n in named)


def store_slot_map(slot_map: DataFrame, path: str) -> int:
    """Write the version that ``slot_map`` holds beside the older ones. A version is written once: one that is there is an error."""
    version = slot_map.agg(F.max("version")).first()[0]
    if version in stored_versions(slot_map.sparkSession, path):
        raise ValueError(f"version {version} of the map is stored already")
    # what a failed write has left of this version is replaced
    slot_map.select("virtual_slot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def read_slot_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, by default the latest: version, virtual_slot, shard."""
    wanted = version if version is not None else stored_versions(spark, path)[-1]
    stored = spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={wanted}")
    return stored.select(F.lit(wanted).alias("version"), "virtual_slot", "shard")


def assign(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, size, text_crc32, virtual_slot, shard and the gapless position ``slot`` in the shard.

    Positions need no sort of a whole shard: a virtual slot starts where the slots before it in its
    shard end, and rows are numbered inside their virtual slot only.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sizes, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size", "copies")
    upto = F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("first", upto - F.col("copies")).join(F.broadcast(starts), "virtual_slot")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    return placed.select("id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("first")).alias("at"), copy).select(
        "id", "size", "text_crc32", "virtual_slot", "shard", (F.col("at") + F.col("copy")).alias("slot"))


def _current_map(sizes: DataFrame, n_shards: int, n_slots: int, path: str, move: bool) -> DataFrame:
    """The stored map that holds now: the newest, the next one if told to ``move`` slots, or a first one."""
    spark = sizes.sparkSession
    if not stored_versions(spark, path):
        store_slot_map(materialize(build_slot_map(sizes, n_shards), "shard-map"), path)
        return read_slot_map(spark, path)
    held = read_slot_map(spark, path)
    slots, shards = held.agg(F.count("*"), F.max("shard") + 1).first()
    if slots != n_slots:
        raise ValueError(f"the stored map has {slots} slots, not {n_slots}: slots are fixed")
    if move:
        store_slot_map(materialize(rebalance(held, sizes, n_shards), "shard-map"), path)
        return read_slot_map(spark, path)
    if shards != n_shards:
        raise ValueError(f"the stored map has {shards} shards, not {n_shards}: ask for a rebalance")
    return held


def shard_documents(
    docs: DataFrame,
    n_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_slots: int = N_SLOTS,
    map_path: str | None = None,
    move: bool = False,
) -> DataFrame:
    """Shard a corpus so that shards hold nearly equal bytes.

    The map is read from ``map_path``, or made there if there is none; ``move`` rebalances it first
    and stores the next version. Without a path the run's own map is stored in the shared folder.
    """
    rows = materialize(slot_rows(docs, id_col, text_col, n_slots), "shard-rows")
    sizes = materialize(slot_sizes(rows, n_slots), "shard-sizes")
    path = map_path or shared_path(docs.sparkSession, "slot-map")
    return assign(rows, _current_map(sizes, n_shards, n_slots, path, move), sizes).withColumnRenamed("id", id_col)
