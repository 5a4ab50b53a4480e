"""Ranked lexical search over posting lists that are blocked by document similarity.

The score of a document is a sum over the terms of an item: the term's weight, by its document
frequency, times the document's part in it, by its occurrences and the document's length. All is
integer arithmetic, so that sums do not depend on their order.

Index: documents are ordered by a signature of their weighted parts (random hyperplanes), so that
similar ones are neighbours. Each posting list follows that order and is cut into blocks of ``BLOCK``
consecutive documents: clusters of that list, the finer the rarer the term, and never larger however
many equal documents there are. A block stores the coordinatewise maximum of its documents' parts,
for the terms that items with the list's term can ask for.

Search: the terms of an item are taken by rising frequency. Documents that hold its rarest terms are
scored first; the last of the best ``k`` of them is the item's threshold. A list is needed for an
item only if the item's terms from it on can reach the threshold with the largest parts of all
documents (documents with rarer terms are found in the lists before). Of a list that is needed, a
block is skipped only if those terms cannot reach the threshold with the block's summary. Both
bounds are exact, so no document of the result is missed. The documents of all other blocks are
scored in full.

Items are handled in batches of about ``BATCH_TERMS`` terms, which is what a task has to hold.
Documents that need no scoring leave the index once; the others are joined to it by row number.

Defined results for odd input
* Null and wordless documents are in no list; null and wordless items have no results.
* Every row of documents counts, also repeated ones and those without an id (listed after others of
  their score). Every row of items has its own list, also where item ids repeat.
* An empty table gives an empty result. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import MAX_BROADCAST_ROWS, broadcast_if_small, materialize, release, text_batches

TOP_K = 20
#: Documents of a block.
BLOCK = 8
#: Documents that an item's rarest terms should have, for its threshold, as a multiple of k.
SEEDS = 5
#: Terms that the items of a batch have together, about.
BATCH_TERMS = 200_000
#: Postings of unfinished blocks that a task holds at most; blocks are cut short beyond.
OPEN_POSTINGS = 400_000

#: ASCII but for digits and letters separates terms.
_SPACED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, as UTF-8; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACED).split()


def _counter(known: Broadcast | None):
    @F.pandas_udf("n long, terms array<string>, counts array<int>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        ns, terms, counts = [], [], []
        for text in texts:
            words = terms_of(text)
            found = Counter(words)
            if known is not None:
                found = {t: found[t] for t in found.keys() & known.value}
            ns.append(len(words))
            terms.append([t.decode() for t in found])
            counts.append(list(found.values()))
        return pd.DataFrame({"n": pd.Series(ns, dtype="int64"), "terms": terms, "counts": counts})

    return counted


def _counts(df: DataFrame, id_col: str, text_col: str, known: Broadcast | None) -> DataFrame:
    """id, n, terms, counts of every text, written."""
    rows = df.select(F.col(id_col).alias("id"), _counter(known)(F.col(text_col)).alias("c")).select("id", "c.*")
    with text_batches(df.sparkSession):
        return materialize(rows, "search-counts")


# index ------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Index:
    """``rows``: row, id, terms, parts, similar documents next to each other. ``weights``: term, df, weight, most (largest part)."""

    rows: DataFrame
    weights: DataFrame


def _signer(weights: Broadcast | None):
    @F.pandas_udf("long")
    def signature(terms: pd.Series, parts: pd.Series) -> pd.Series:
        out = np.zeros(len(terms), dtype=np.int64)
        for i, (own, part) in enumerate(zip(terms, parts)):
            if len(own):
                sides = np.array([xxhash.xxh3_64_intdigest(t) for t in own], dtype=">u8").view(np.uint8).reshape(-1, 8)
                x = np.asarray(part, dtype=np.float64)
                if weights is not None:
                    x = x * np.array([weights.value.get(t, 0) for t in own])
                out[i] = np.packbits(x @ (np.unpackbits(sides, axis=1) * 2.0 - 1.0) > 0).view(">i8")[0]
        return pd.Series(out)

    return signature


def build_index(docs: DataFrame, vocabulary: Broadcast | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index of all rows; of the terms in ``vocabulary`` only, where one is given."""
    spark = docs.sparkSession
    counts = _counts(docs, id_col, text_col, vocabulary)
    n_docs, n_terms = counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, 1)), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    damping = F.expr(f"75 + (25 * n * {n_docs}L) div {max(n_terms, 1)}L")
    part = F.expr("transform(counts, tf -> (1000000000L * tf) div (1000L * tf + 12 * damping))")
    parts = counts.withColumn("damping", damping).withColumn("parts", part).select("id", "n", "terms", "parts")
    posted = parts.select(F.explode(F.arrays_zip("terms", "parts")).alias("p"))
    weights = posted.groupBy(F.col("p.terms").alias("term")).agg(F.count("*").alias("df"), F.max("p.parts").alias("most"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = materialize(weights.withColumn("weight", weight).filter("weight > 0"), "search-weights")
    # where the terms are too many to broadcast, signatures go by parts alone
    known = {r["term"]: r["weight"] for r in weights.select("term", "weight").collect()} if weights.count() <= MAX_BROADCAST_ROWS else None
    signed = parts.withColumn("signature", _signer(None if known is None else spark.sparkContext.broadcast(known))("terms", "parts"))
    order = ["signature", F.xxhash64("id", "n")]  # equal signatures may be split
    rows = signed.filter(F.size("terms") > 0).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", "terms", "parts"), "search-index")
    release(counts)
    return Index(rows, weights)


# batches of items -------------------------------------------------------------------------------------------
@dataclass
class Batch:
    """Items of a batch as tasks use them. Terms are numbered by rising document frequency, so a list's later terms have larger numbers."""

    terms: dict[str, int]
    #: item -> {term: weight times its repeats}
    items: dict[int, dict[int, int]]
    most: list[int]
    df: list[int]
    threshold: dict[int, int] = field(default_factory=dict)
    #: term -> items that are scored for it first
    seeds: dict[int, list[int]] = field(default_factory=dict)
    #: term -> items that need its list, and the terms from it on that they can ask for
    lists: dict[int, list[int]] = field(default_factory=dict)
    asked: dict[int, frozenset[int]] = field(default_factory=dict)


def _batch(rows: list) -> Batch:
    """From rows of item, term, repeats, weight, df, most."""
    order = sorted({(r["df"], r["term"]): r["most"] for r in rows}.items())
    number = {term: i for i, ((_, term), _) in enumerate(order)}
    items: dict[int, dict[int, int]] = {}
    for r in rows:
        items.setdefault(r["item"], {})[number[r["term"]]] = r["repeats"] * r["weight"]
    return Batch(number, items, [most for _, most in order], [df for (df, _), _ in order])


def _seed(batch: Batch, enough: int) -> None:
    for item, own in batch.items.items():
        held = 0
        for term in sorted(own):
            if held >= enough:
                break
            batch.seeds.setdefault(term, []).append(item)
            held += batch.df[term]


def _need(batch: Batch) -> None:
    """Fill ``lists`` and ``asked`` by the bounds of whole lists."""
    asked: dict[int, set[int]] = {}
    for item, own in batch.items.items():
        order, reach, low = sorted(own), 0, max(batch.threshold.get(item, 0), 1)
        reaches = []
        for term in reversed(order):
            reach += own[term] * batch.most[term]
            reaches.append((term, reach))
        for term, reach in reversed(reaches):
            if reach < low:
                break
            batch.lists.setdefault(term, []).append(item)
            asked.setdefault(term, set()).update(t for t in order if t >= term)
    batch.asked = {term: frozenset(found) for term, found in asked.items()}


# passes over the index --------------------------------------------------------------------------------------
def _score(own: dict[int, int], wanted: dict[int, int]) -> int:
    few, many = (own, wanted) if len(own) < len(wanted) else (wanted, own)
    return sum(x * many[t] for t, x in few.items() if t in many)


def _documents(batch: pa.RecordBatch, numbers: dict[str, int]) -> Iterator[dict[int, int]]:
    """{term: part} of each document of an Arrow batch, for the terms of the items."""
    for terms, parts in zip(batch.column("terms").to_pylist(), batch.column("parts").to_pylist()):
        yield {numbers[t]: p for t, p in zip(terms, parts) if t in numbers}


def _scored(rows: DataFrame, batch: Broadcast, chosen: bool) -> DataFrame:
    """item, row, id, score (positive, and not under the threshold) of documents with the items in their column ``items``, or else with those that their terms are seeds of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Batch = batch.value
        for some in batches:
            at, items, scores = [], [], []
            wanted = some.column("items").to_pylist() if chosen else [None] * some.num_rows
            for i, own in enumerate(_documents(some, b.terms)):
                seeded = {x for t in own.keys() & b.seeds.keys() for x in b.seeds[t]}
                for item in set(wanted[i]) - seeded if chosen else seeded:
                    score = _score(own, b.items[item])
                    if score >= max(b.threshold.get(item, 0), 1):
                        at.append(i), items.append(item), scores.append(score)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int64()), some.column("row").take(at), some.column("id").take(at), pa.array(scores, pa.int64())], ["item", "row", "id", "score"])

    return rows.mapInArrow(run, f"item long, row long, id {rows.schema['id'].dataType.simpleString()}, score long")


def _blocks(rows: DataFrame, batch: Broadcast, block: int) -> DataFrame:
    """term, rows, at, most: the blocks of the lists that are needed, with their summaries (parts ``most`` of the terms ``at``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Batch = batch.value
        held: dict[int, tuple[list[int], dict[int, int]]] = {}
        n, done = 0, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([t for t, _, _ in done], pa.int32()), pa.array([r for _, r, _ in done], pa.list_(pa.int64())),
                       pa.array([list(s) for _, _, s in done], pa.list_(pa.int32())), pa.array([list(s.values()) for _, _, s in done], pa.list_(pa.int64()))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "rows", "at", "most"])

        for some in batches:
            for row, own in zip(some.column("row").to_pylist(), _documents(some, b.terms)):
                for term in own.keys() & b.asked.keys():
                    if term not in held:
                        held[term] = ([], {})
                    members, summary = held[term]
                    members.append(row)
                    n += 1
                    for t in own.keys() & b.asked[term]:
                        if summary.get(t, 0) < own[t]:
                            summary[t] = own[t]
                    if len(members) == block:
                        done.append((term, *held.pop(term)))
                        n -= block
                if n > OPEN_POSTINGS:
                    done += [(term, *x) for term, x in held.items()]
                    held, n = {}, 0
                if len(done) > 5000:
                    yield out()
        done += [(term, *x) for term, x in held.items()]
        yield out()

    return rows.mapInArrow(run, "term int, rows array<long>, at array<int>, most array<long>")


def _kept(blocks: DataFrame, batch: Broadcast) -> DataFrame:
    """item, rows of the blocks whose summary reaches the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Batch = batch.value
        for some in batches:
            at, items = [], []
            columns = [some.column(c).to_pylist() for c in ("term", "at", "most")]
            for i, (term, terms, most) in enumerate(zip(*columns)):
                summary = dict(zip(terms, most))
                for item in b.lists[term]:
                    if _score(summary, b.items[item]) >= max(b.threshold.get(item, 0), 1):
                        at.append(i), items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), some.column("rows").take(pa.array(at, pa.int64()))], ["item", "rows"])

    return blocks.mapInArrow(run, "item long, rows array<long>")


# search -----------------------------------------------------------------------------------------------------
def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_batch(index: Index, batch: Batch, k: int, block: int) -> DataFrame:
    spark = index.rows.sparkSession
    share = spark.sparkContext.broadcast
    _seed(batch, SEEDS * k)
    first = materialize(_best(_scored(index.rows, share(batch), False), k), "search-seeds")
    batch.threshold = {r["item"]: r["low"] for r in first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("low")).filter(F.col("n") >= k).collect()}
    _need(batch)
    shared = share(batch)
    blocks = materialize(_blocks(index.rows, shared, block), "search-blocks")
    wanted = _kept(blocks, shared).select("item", F.explode("rows").alias("row")).groupBy("row").agg(F.collect_set("item").alias("items"))
    wanted = materialize(wanted, "search-wanted")
    scored = _scored(index.rows.join(broadcast_if_small(wanted, MAX_BROADCAST_ROWS // 10), "row"), shared, True)
    found = materialize(_best(scored.unionByName(first.drop("rank")), k), "search-found")
    release(first, blocks, wanted)
    return found


def _batches(items: DataFrame, weights: DataFrame) -> Iterator[Batch]:
    total = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / BATCH_TERMS))
    for i in range(n):
        mine = items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        pairs = mine.select("item", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("item", F.col("p.terms").alias("term"), F.col("p.counts").alias("repeats"))
        rows = pairs.join(weights, "term").collect()
        if rows:
            yield _batch(rows)


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, block: int = BLOCK, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """item, rank, id, score: the ``k`` best documents of every row of ``items``; equal scores by id.

    Without an ``index`` one is built for the terms of the items, as far as these can be broadcast.
    """
    spark = items.sparkSession
    counts = _counts(items, item_col, text_col, None)
    named = materialize(counts.withColumn("item", F.monotonically_increasing_id()), "search-items")
    release(counts)
    if index is None:
        words = materialize(named.select(F.explode("terms").alias("term")).distinct(), "search-terms")
        known = {r["term"].encode() for r in words.collect()} if words.count() <= MAX_BROADCAST_ROWS else None
        release(words)
        index = build_index(docs, None if known is None else spark.sparkContext.broadcast(known), id_col, text_col)
    found = [_search_batch(index, b, k, block) for b in _batches(named, index.weights)]
    names = named.select("item", F.col("id").alias(item_col))
    out = found[0] if found else _best(index.rows.select(F.lit(0).cast("long").alias("item"), "row", "id", F.lit(0).cast("long").alias("score")).limit(0), k)
    for more in found[1:]:
        out = out.unionByName(more)
    return out.join(broadcast_if_small(names), "item").select(item_col, "rank", F.col("id").alias(id_col), "score")
