"""SimHash near-deduplication over a byte-position inverted index with count filtering.

Fingerprints of 64 bits link at ``MAX_DISTANCE`` = 2 or fewer differing bits. Two differing bits
touch at most two of the eight byte positions, so linked fingerprints share at least
``MIN_SHARED_BYTES`` = 6 positional bytes: the guaranteed minimum of the count filter.

Lists of single bytes would be 2,048 that grow with the corpus, and their pairs with its square. The
index therefore keeps the lists intersected: there is one for each choice of six positions and their
bytes, 28 per fingerprint. A pair that shares t bytes meets in C(t, 6) of them (28, 7, 1 or, below
six, none), so the tally of shared bytes reaches the minimum exactly where a pair meets in a list,
and no pair has to be counted that does not reach it.

What meets still has to be verified, without making all pairs of a list. A list's members differ in
two bytes only. Each is probed under itself and under its copies with one of those 16 bits flipped;
two members are within two bits exactly if they share a probe, and all that share one are within two
bits of each other. Linking each to the least of its probe gives the components of all linked pairs
with 17 rows per posting, however long the list.

Defined results for odd input
* A null or wordless text has fingerprint zero and links like any other.
* Documents of one fingerprint are one class, also where an id repeats on different texts; a
  component is named by its smallest id.
* Null ids are ignored by the minimum; a class of null ids alone has a null component.
* Repeated rows give repeated result rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import broadcast_if_small, materialize, release, single_rows, text_batches
from flowlake.llm.graph import connected_components

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_DISTANCE = 2
MIN_SHARED_BYTES = 8 - MAX_DISTANCE
#: Shingles hashed at a time, so that a very long text needs no list of all of them.
BLOCK = 8192

#: The choices of byte positions that make a posting key.
KEY_POSITIONS = list(combinations(range(8), MIN_SHARED_BYTES))


def shingle_hashes(text: str | None, k: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text in order, in blocks; a text of ``k`` words or fewer is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        yield np.array([digest(joined, seed)], dtype=np.uint64)
        return
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate([[0], gaps[: len(gaps) - k + 2] + 1])
    ends = np.concatenate([gaps[k - 1 :], [len(joined)]])
    for at in range(0, len(starts), BLOCK):
        block = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        yield np.array([digest(joined[s:e], seed) for s, e in block], dtype=np.uint64)


def _fingerprint(text: str | None, k: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Signed 64-bit SimHash: a bit is 1 if set in over half of the shingle hashes."""
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for hashes in shingle_hashes(text, k, seed):
        n += len(hashes)
        packed = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(packed, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


@F.pandas_udf(T.LongType())
def simhash(text: pd.Series) -> pd.Series:
    """SimHash fingerprint of a text column."""
    return pd.Series([_fingerprint(t) for t in text], dtype="int64")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(0xFF))


def _postings(classes: DataFrame) -> DataFrame:
    """fp, key: 28 rows per fingerprint. A key is the number of its choice of positions, and their six bytes."""
    fp = F.col("fp")
    keys = [
        sum((F.shiftleft(_byte(fp, p), 8 * i) for i, p in enumerate(positions)), F.lit(slot << 8 * MIN_SHARED_BYTES).cast("long"))
        for slot, positions in enumerate(KEY_POSITIONS)
    ]
    return classes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _flips() -> Column:
    """For each choice of positions: zero, and each bit of the positions left out."""
    bit = lambda b: F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
    rows = [[bit(8 * p + b) for p in range(8) if p not in positions for b in range(8)] for positions in KEY_POSITIONS]
    return F.array(*[F.array(F.lit(0).cast("long"), *row) for row in rows])


def near_links(classes: DataFrame) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fp`` that give the components of all linked pairs."""
    postings = _postings(classes)
    # nearly all keys are of one fingerprint: dealt first, as merging them before the shuffle would save nothing
    lists = postings.repartition("key").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    lists = materialize(lists, "simhash-lists")
    slot = F.shiftrightunsigned("key", 8 * MIN_SHARED_BYTES).cast("int")
    members = postings.join(broadcast_if_small(lists), "key").select("fp", slot.alias("slot"))
    probes = members.select("fp", "slot", F.explode(F.element_at(_flips(), F.col("slot") + 1)).alias("flip"))
    probes = materialize(probes.select("fp", "slot", F.col("fp").bitwiseXOR(F.col("flip")).alias("probe")), "simhash-probes")
    least = probes.groupBy("slot", "probe").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = probes.join(least, ["slot", "probe"]).filter("fp != v").select(F.col("fp").alias("u"), "v").distinct()
    links = materialize(stars.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE), "simhash-links")
    release(lists, probes)
    return links


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key (a hash of the text), fp of every row, written once so that the texts are read once."""
    key = text_hash(F.col(text_col)).alias("text_key")
    with text_batches(docs.sparkSession):
        return materialize(docs.select(F.col(id_col).alias("id"), key, simhash(F.col(text_col)).alias("fp")), "simhash-fp")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp (signed long), component_id of every row: the smallest id reachable over links."""
    rows = fingerprints(docs, id_col, text_col)
    return _resolve(rows).select(F.col("id").alias(id_col), "fp", "component_id")


def _resolve(rows: DataFrame) -> DataFrame:
    """``rows`` with the component of their fingerprint's class: its least fingerprint, and its smallest id."""
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    links = near_links(classes.filter("least IS NOT NULL"))
    found = connected_components(links)
    resolved = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    resolved = materialize(resolved, "simhash-resolved")
    release(classes, links)
    ids = resolved.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(resolved.join(ids, "component").select("fp", "component", "component_id"), "fp")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component.

    Rows with a null id in a component without any id stay. Rows that repeat an id and a text leave
    one row; an id on two texts is two documents.
    """
    return keep_one(docs, _resolve(fingerprints(docs, id_col, text_col)), id_col, text_col)


def keep_one(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of ``rows`` (id, text_key, component): that of the smallest id, then text_key."""
    rows = materialize(rows.groupBy("id", "text_key", "component").agg(F.count("*").alias("n")), "simhash-components")
    first = rows.filter("id IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "text_key")).alias("first"))
    losers = rows.join(materialize(first, "simhash-first"), "component").filter(~F.struct("id", "text_key").eqNullSafe(F.col("first")))
    losers = materialize(losers.select(F.col("id").alias("__id"), F.col("text_key").alias("__key")), "simhash-losers")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (text_hash(F.col(text_col)) == F.col("__key"))
    kept = docs.join(broadcast_if_small(losers), same, "left_anti")
    again = rows.filter("id IS NOT NULL AND n > 1").select(F.col("id").alias("__r0"), F.col("text_key").alias("__r1"))
    return single_rows(kept, [F.col(id_col), text_hash(F.col(text_col))], materialize(again, "simhash-repeated"))
