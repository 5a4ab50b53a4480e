"""Tables that grow by small batches: immutable segments listed by a manifest and merged by size.

A batch becomes a segment of level 0. ``FAN`` segments of a level are merged into one of the next, so
a row is rewritten once a level, and a store of n batches has some FAN * log(n) segments. Readers take
the segments of the current manifest; what only older manifests list is removed.

``KeyStore`` keeps the keys of stored rows this way. A segment's keys are dealt over buckets by hash,
each with a Bloom filter, so a batch opens the filters of the buckets that its keys fall in and the
keys of those buckets only where a filter lets one of them pass.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.files import Manifest, remove

FAN = 8


class Segments:
    """``merge`` makes one table of several; by default it appends them."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.merge = spark, path, merge or (lambda rows: rows)
        self.manifest = Manifest(spark, f"{path}/manifest")

    def live(self) -> list[dict]:
        return self.manifest.current().get("segments", [])

    def applied(self, source: str) -> int:
        """Number of the last batch of a source that was added."""
        return self.manifest.current().get("applied", {}).get(source, -1)

    def write(self, rows: DataFrame, path: str) -> dict:
        """Write a segment; what is returned is kept in the manifest."""
        rows.write.parquet(path)
        return {}

    def rows_of(self, segments: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{s['name']}" for s in segments])

    def read(self) -> DataFrame | None:
        """All rows, merged only as far as their segments were; None without any segment."""
        live = self.live()
        return self.rows_of(live) if live else None

    def add(self, rows: DataFrame, source: str | None = None, number: int | None = None) -> bool:
        """Add a batch. A batch number of ``source`` that was applied before is passed over."""
        if source is not None and number <= self.applied(source):
            return False
        now = self.manifest.current()
        applied = {**now.get("applied", {}), **({source: number} if source is not None else {})}
        self._commit([*now.get("segments", []), self._written(rows, 0)], applied)
        self._merge_full_levels()
        return True

    def _written(self, rows: DataFrame, level: int) -> dict:
        name = f"segment-{uuid.uuid4().hex}"
        return {"name": name, "level": level, **self.write(rows, f"{self.path}/{name}")}

    def _merge_full_levels(self) -> None:
        while True:
            live = self.live()
            full = next((level for level in sorted({s["level"] for s in live}) if sum(s["level"] == level for s in live) >= FAN), None)
            if full is None:
                return
            old = [s for s in live if s["level"] == full]
            merged = self._written(self.merge(self.rows_of(old)), full + 1)
            self._commit([*[s for s in live if s["level"] != full], merged], self.manifest.current().get("applied", {}))

    def _commit(self, segments: list[dict], applied: dict) -> None:
        listed = {s["name"] for d in self.manifest.history() for s in d["segments"]}
        self.manifest.commit({"segments": segments, "applied": applied})
        still = {s["name"] for d in self.manifest.history() for s in d["segments"]}
        for name in listed - still:
            remove(self.spark, f"{self.path}/{name}")


#: Keys of a bucket, and bits of its filter per key. A filter is made of pages of 4 KB; a key sets its bits in one page.
KEYS_PER_BUCKET = 1_000_000
BITS_PER_KEY = 12
PAGE_BITS = 8 * 4096
PROBES = 4


class KeyStore(Segments):
    """Keys, of one or more columns, of all rows that were stored."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        super().__init__(spark, path)
        self.keys = keys
        #: Folders of keys that the last ``known`` has read.
        self.opened: list[str] = []

    def _hash(self, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *self.keys)

    def _place(self, buckets: int, pages: int) -> dict[str, Column]:
        bits = F.array(*[F.pmod(self._hash(2 + i), F.lit(PAGE_BITS)) for i in range(PROBES)])
        return {"bucket": F.pmod(self._hash(0), F.lit(buckets)).cast("int"), "page": F.pmod(self._hash(1), F.lit(pages)).cast("int"), "bits": bits}

    def write(self, rows: DataFrame, path: str) -> dict:
        n = rows.count()
        buckets = max(1, math.ceil(n / KEYS_PER_BUCKET))
        pages = max(1, math.ceil(n / buckets * BITS_PER_KEY / PAGE_BITS))
        placed = rows.select(*self.keys).withColumns(self._place(buckets, pages))
        dealt = placed.repartition("bucket") if buckets > 1 else placed.coalesce(1)
        dealt.select("bucket", *self.keys).write.partitionBy("bucket").parquet(f"{path}/keys")
        filters = placed.select("bucket", "page", F.explode("bits").alias("bit")).groupBy("bucket", "page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        filters.repartition(min(buckets, 200), "bucket").write.partitionBy("bucket").parquet(f"{path}/filters")
        present = [r[0] for r in self.spark.read.parquet(f"{path}/filters").select("bucket").distinct().collect()]
        return {"rows": n, "buckets": buckets, "pages": pages, "missing": sorted(set(range(buckets)) - set(present))}

    def rows_of(self, segments: list[dict]) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{s['name']}/keys" for s in segments]).select(*self.keys)

    def _folders(self, segment: dict, kind: str, buckets: set[int]) -> list[str]:
        return [f"{self.path}/{segment['name']}/{kind}/bucket={b}" for b in sorted(buckets - set(segment["missing"]))]

    def known(self, batch: DataFrame) -> DataFrame | None:
        """The keys of ``batch`` that are stored, for a semi or anti join; None where no filter lets any pass."""
        self.opened = []
        live = [s for s in self.live() if s["rows"]]
        if not live:
            return None
        counts = sorted({s["buckets"] for s in live})
        keys = batch.select(*self.keys)
        # at most as many numbers as there are buckets
        touched = keys.agg(*[F.collect_set(self._place(n, 1)["bucket"]) for n in counts]).first()
        touched = {n: set(found) for n, found in zip(counts, touched)}
        passed = []
        for i, s in enumerate(live):
            folders = self._folders(s, "filters", touched[s["buckets"]])
            if folders:
                filters = self.spark.read.option("basePath", f"{self.path}/{s['name']}/filters").parquet(*folders)
                hits = keys.withColumns(self._place(s["buckets"], s["pages"])).join(filters, ["bucket", "page"])
                passed.append(hits.filter(F.forall("bits", lambda b: _bit(F.col("bitmap"), b))).select(F.lit(i).alias("segment"), "bucket"))
        found = reduce(DataFrame.unionByName, passed).distinct().collect() if passed else []
        for i, s in enumerate(live):
            self.opened += self._folders(s, "keys", {r["bucket"] for r in found if r["segment"] == i})
        if not self.opened:
            return None
        return self.spark.read.schema(batch.select(*self.keys).schema).option("recursiveFileLookup", "true").parquet(*self.opened)


def _bit(bitmap: Column, at: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    octet = F.conv(F.hex(F.substring(bitmap, (F.shiftright(at.cast("int"), 3) + 1), F.lit(1))), 16, 10).cast("int")
    return F.getbit(octet, F.pmod(at, F.lit(8)).cast("int")) == 1
