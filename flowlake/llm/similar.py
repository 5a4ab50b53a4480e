"""Near copies by Jaccard similarity: candidates from a byte-position index of SimHash fingerprints.

The two bits of ``simhash`` find texts that are almost equal; of two texts with four fifths of their
shingles in common every seventh sign differs, and a byte of eight signs rarely survives that. Here
the byte at a position is the number of the largest of ``DIRECTIONS`` projections of the text's
shingle set, with its sign: at a Jaccard coefficient of 0.8 about 45 in 100 positions agree, of
unlike texts hardly any. Texts are posted under ``KEYS`` choices of ``KEY_BYTES`` positions and their
bytes. The count filter tallies the lists that a pair meets in and retains those that reach
``MIN_LISTS``, then the positions that they share and retains those that reach ``MIN_SHARED`` (three
and a half standard deviations under the mean at 0.8), and each of these is verified by the exact Jaccard coefficient of the shingle sets of the
whole texts. What is linked is thus right; a similar pair is missed only if it meets in too few
lists (README: measured recall).

A set of too few shingles is similar to no other (of three shared shingles of four, 0.75 is left): such
texts are in no list. Of 0.8 that is sets of up to three shingles.

Texts of one shingle set are one class, named by a 64-bit hash of the set, so exact copies make no
pairs. The members of a list are never paired with each other outright. Under the first of the keys
they are paired with their list's centre only (the member that meets most texts in all), and with
the foremost of their centres to begin with, which settles groups of copies. Then all keys are
looked at, but only lists that hold several components: there, members outside the component of most
of the list are paired with the members of others. Pairs inside a component cannot change it.

Lists of more than ``LONG_LIST`` members are paired no further. They come of texts that are alike but mostly
below the threshold (a text and its more and more edited copies), of which nearly all pairs would meet. Among
the texts of such lists the sets themselves decide, and no similar pair is missed: either two texts share a
shingle that at most ``RARE`` of these texts have, within the prefix that has to hold a common one, or all that
they share is frequent. Then the frequent shingles of either must suffice for a link at the other's size, which a
text with many edits does not reach; those that do are looked up by size and by the prefix of their
frequent shingles, from the smaller component in the larger, and with the foremost one first. What remains
quadratic: a group of texts in different components that differ in little and have nothing rare in common.

Defined results for odd input
* A text of ``shingle_words`` words or fewer is one shingle. Null and wordless texts are copies of each other.
* Null ids, repeated rows, an id on two texts: as in ``simhash.keep_one``. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import broadcast_if_small, give_back, materialize, release, text_batches
from flowlake.llm.graph import connected_components
from flowlake.llm.simhash import HASH_SEED, keep_one, shingle_hashes, text_hash

SIMILARITY = 0.8
SHINGLE_WORDS = 5
#: Dimensions that shingle sets are first folded into, byte positions, and projections per position (an index and a sign fill 7 bits).
DIMENSIONS = 512
POSITIONS = 64
DIRECTIONS = 64
#: Posting keys per text, those of them that groups are settled by first, and positions per key. 28 bits a key: for over some ten million texts take more.
KEYS = 256
FIRST_KEYS = 64
KEY_BYTES = 4
#: Lists that a pair has to meet in, and positions that it has to share.
MIN_LISTS = 2
MIN_SHARED = 14
#: Members of the longest lists that are paired, most texts of a rare shingle, and the ratio of the sizes that are looked up together.
LONG_LIST = 16
RARE = 32
SIZE_STEP = 1.03


def shingle_set(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    blocks = list(shingle_hashes(text, k, HASH_SEED))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, dtype=np.uint64)


@lru_cache(maxsize=1)
def _projections() -> np.ndarray:
    signs = np.random.default_rng(17).integers(0, 2, (DIMENSIONS, POSITIONS * DIRECTIONS), dtype=np.int8)
    return signs.astype(np.float32) * 2 - 1


def positional_bytes(sets: list[np.ndarray]) -> np.ndarray:
    """Texts x POSITIONS bytes: which projection of the position is largest, and its sign."""
    folded = np.zeros((len(sets), DIMENSIONS), dtype=np.float32)
    for row, s in zip(folded, sets):
        sign = 1.0 - 2.0 * (s >> np.uint64(63)).astype(np.float64)
        row[:] = np.bincount((s % np.uint64(DIMENSIONS)).astype(np.int64), weights=sign, minlength=DIMENSIONS)
    out = np.empty((len(sets), POSITIONS), dtype=np.uint8)
    for at in range(0, len(sets), 128):  # a few MB at a time
        x = (folded[at : at + 128] @ _projections()).reshape(-1, POSITIONS, DIRECTIONS)
        top = np.abs(x).argmax(axis=2)
        value = np.take_along_axis(x, top[:, :, None], axis=2)[:, :, 0]
        out[at : at + 128] = top * 2 + (value > 0)
    return out


def key_positions(keys: int = KEYS, key_bytes: int = KEY_BYTES) -> np.ndarray:
    """Byte positions of each posting key: all positions in seeded orders, cut into groups."""
    rng, out = random.Random(17), []
    while len(out) < keys:
        order = rng.sample(range(POSITIONS), POSITIONS)
        out += [order[i : i + key_bytes] for i in range(0, POSITIONS - key_bytes + 1, key_bytes)]
    return np.array(out[:keys])


_PRINT = T.StructType([T.StructField("node", T.LongType()), T.StructField("fp", T.BinaryType())])


def _printer(k: int, similarity: float):
    few = similarity / (1 - similarity) - 1e-9 if similarity < 1 else float("inf")

    @F.pandas_udf(_PRINT)
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            nodes, prints = [], []
            for at in range(0, len(texts), 128):
                sets = [shingle_set(t, k) for t in texts.iloc[at : at + 128]]
                nodes += [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets]
                prints += [row.tobytes() if len(s) >= few else None for s, row in zip(sets, positional_bytes(sets))]
            yield pd.DataFrame({"node": nodes, "fp": prints})
        give_back()

    return printed


def _poster(positions: np.ndarray):
    slots = np.arange(len(positions), dtype=np.int64) << 8 * positions.shape[1]
    places = 256 ** np.arange(positions.shape[1], dtype=np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(fps: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(fps), 256):
            some = fps.iloc[at : at + 256]
            octets = np.frombuffer(b"".join(some), dtype=np.uint8).reshape(len(some), -1).astype(np.int64)
            out += list((octets[:, positions] * places).sum(axis=2) + slots)
        return pd.Series(out, dtype="object")

    return keys


@F.pandas_udf(T.IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Tally of the positional bytes that two fingerprints share."""
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(axis=1, dtype=np.int32))


def _setter(k: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, k).view(np.int64) for t in texts], dtype="object")

    return shingles


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


class _Verifier:
    """Candidate pairs (u, v) of classes -> those of them that are similar."""

    def __init__(self, docs: DataFrame, rows: DataFrame, classes: DataFrame, text_col: str, k: int, min_shared: int, similarity: float):
        self.docs, self.rows, self.classes, self.text_col = docs, rows, classes, text_col
        self.k, self.min_shared, self.similarity = k, min_shared, similarity

    def __call__(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.classes.select(F.col("node").alias(x), F.col("fp").alias(f"fp_{x}"))
        near = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("shared", _shared("fp_u", "fp_v"))
        near = materialize(near.filter(F.col("shared") >= self.min_shared).select("u", "v"), "similar-candidates")
        held = self.sets(near.select(F.col("u").alias("node")).union(near.select(F.col("v").alias("node"))).distinct())
        side = lambda x: held.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}"))
        both = F.size(F.array_intersect("s_u", "s_v"))
        alike = both >= self.similarity * (F.size("s_u") + F.size("s_v") - both) - 1e-9
        links = materialize(near.join(side("u"), "u").join(side("v"), "v").filter(alike).select("u", "v"), "similar-links")
        release(near, held)
        return links

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, s (its shingle set, sorted) of ``nodes``."""
        keys = self.rows.join(nodes, "node").groupBy("node").agg(F.min("text_key").alias("__key"))
        keys = materialize(keys, "similar-texts")
        held = self.docs.select(F.col(self.text_col).alias("__text")).join(broadcast_if_small(keys), text_hash(F.col("__text")) == F.col("__key"))
        held = held.groupBy("node").agg(F.first("__text").alias("__text")).select("node", _setter(self.k)("__text").alias("s"))
        with text_batches(self.docs.sparkSession):
            held = materialize(held, "similar-sets")
        release(keys)
        return held


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` (u, v) in different components, or in none yet."""
    side = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    placed = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left")
    return placed.filter(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).select("u", "v")


def _lists(postings: DataFrame, *more: Column) -> DataFrame:
    """key, n, least, most (node) and ``more`` of each list of two or more."""
    # nearly all keys are of one class: dealt first, as merging them before the shuffle would save nothing
    return postings.repartition("key").groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"), *more).filter("n > 1")


def _twos(lists: DataFrame) -> DataFrame:
    """The pairs of lists of two, which are known by their ends."""
    return lists.filter("n = 2").select(F.col("most").alias("u"), F.col("least").alias("v"))


def _often(pairs: DataFrame) -> DataFrame:
    """Count filter over the index: pairs that meet in MIN_LISTS lists at least."""
    return pairs.groupBy("u", "v").agg(F.count("*").alias("lists")).filter(F.col("lists") >= MIN_LISTS).drop("lists")


def _up(x: Column) -> Column:
    return F.ceil(x - 1e-9).cast("int")


def _parts(sets: DataFrame) -> DataFrame:
    """node, n (shingles), rare, often: the set of each text, cut by how many texts of ``sets`` (node, s) have a shingle."""
    shingles = sets.select("node", F.explode("s").alias("shingle"))
    frequent = materialize(shingles.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") > RARE).select("shingle"), "similar-frequent")
    rare = shingles.join(broadcast_if_small(frequent), "shingle", "left_anti").groupBy("node").agg(F.array_sort(F.collect_list("shingle")).alias("rare"))
    parts = sets.join(rare, "node", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<long>")))
    parts = materialize(parts.select("node", F.size("s").alias("n"), "rare", F.array_except("s", "rare").alias("often")), "similar-parts")
    release(frequent, sets)
    return parts


def _placed(parts: DataFrame, found: DataFrame) -> DataFrame:
    return parts.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _rare_pairs(placed: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components that share a rare shingle within the prefixes of the order of rare shingles, then frequent ones."""
    heads = placed.select("node", "c", F.explode(F.slice("rare", F.lit(1), F.col("n") - _up(F.col("n") * similarity) + 1)).alias("shingle"))
    other = heads.select("shingle", F.col("node").alias("x"), F.col("c").alias("cx"))
    return heads.join(other, "shingle").filter("node > x AND c != cx").select(F.col("node").alias("u"), F.col("x").alias("v")).distinct()


def _frequent_pairs(placed: DataFrame, similarity: float, foremost: bool) -> DataFrame:
    """Pairs of different components whose frequent shingles suffice for a link: all of them, or one with a large component for each text."""
    enough = lambda sizes: _up(sizes * (similarity / (1 + similarity)))  # noqa: E731  # shingles that a similar pair of these sizes together shares
    band = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(SIZE_STEP))).cast("int")
    prefix = lambda shared: F.explode(F.slice("often", F.lit(1), F.col("f") - shared + 1)).alias("shingle")
    own = _up(F.col("n") * similarity)
    weights = materialize(placed.groupBy("c").agg(F.count("*").alias("m")), "similar-weights")
    largest = weights.agg(F.max_by("c", F.struct("m", "c"))).first()[0]
    able = placed.withColumn("f", F.size("often")).filter(F.col("f") >= own).join(broadcast_if_small(weights), "c")
    hosts = able.select(band(F.col("n")).alias("band"), prefix(own), *[F.col(x).alias(f"{x}_h") for x in ("m", "f", "node", "c", "n")])
    if foremost:
        host = F.struct("m_h", "f_h", "node_h", "c_h", "n_h")
        hosts = hosts.groupBy("band", "shingle").agg(F.max(host).alias("host")).select("band", "shingle", "host.*")
    # from the smaller component, in the order of sizes, then names, to the sizes that a similar text may have
    guests = able.filter(F.col("c") != F.lit(largest)).withColumn("band", F.explode(F.sequence(band(own), band(F.col("n") / similarity + 1e-9))))
    guests = guests.withColumn("shared", enough(F.col("n") + F.greatest(_up(F.pow(F.lit(SIZE_STEP), F.col("band")) - 1e-6), own))).filter("f >= shared")
    guests = guests.select("band", prefix(F.col("shared")), "node", "c", "m", "n", "f")
    meet = guests.join(hosts, ["band", "shingle"]).filter("m < m_h OR (m = m_h AND c < c_h)").filter(F.least("f", "f_h") >= enough(F.col("n") + F.col("n_h")))
    if foremost:
        meet = meet.groupBy("node").agg(F.max_by("node_h", F.struct("m_h", "f_h", "node_h")).alias("node_h"))
    pairs = materialize(meet.select(*_ordered("node", "node_h")).distinct(), "similar-frequent-pairs")
    release(weights)
    return pairs


def _settled(classes: DataFrame, verify: _Verifier, positions: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, pairs looked at) of texts with the centres of their lists, under some of the keys, and the texts of long lists."""
    postings = classes.select("node", F.explode(_poster(positions)("fp")).alias("key"))
    lists = materialize(_lists(postings), "similar-lists")
    longer = materialize(lists.filter("n > 2").select("key", "n"), "similar-longer")
    members = materialize(postings.join(broadcast_if_small(longer), "key"), "similar-members")
    # the text that copies were made from meets more of them than they meet each other: it is the centre of their lists
    met = materialize(members.groupBy("node").agg(F.sum("n").alias("met")), "similar-met")
    centres = members.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("centre"))
    centres = materialize(centres, "similar-centres")
    stars = members.join(broadcast_if_small(centres), "key").filter("node != centre").select(*_ordered("node", "centre"))
    stars = materialize(_often(stars.unionByName(_twos(lists))), "similar-stars")
    ends = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).union(stars.select(F.col("v").alias("x"), F.col("u").alias("y")))
    foremost = ends.join(met.select(F.col("node").alias("y"), "met"), "y", "left").groupBy("x").agg(
        F.max_by("y", F.struct(F.coalesce("met", F.lit(0)), "y")).alias("y"))
    links = verify(foremost.select(*_ordered("x", "y")).distinct())
    found = connected_components(links)
    links = links.union(verify(_apart(stars, found)))
    dense = materialize(members.filter(F.col("n") > LONG_LIST).select("node").distinct(), "similar-crowd")
    release(lists, longer, members, met, centres)
    return links, stars, dense


def _components(classes: DataFrame, verify: _Verifier, positions: np.ndarray, first_keys: int) -> DataFrame:
    """(node, component) of all that is linked over similar pairs that meet often enough."""
    links, tried, dense = _settled(classes, verify, positions[:first_keys])
    found = materialize(connected_components(links), "similar-found")
    placed = classes.join(found, "node", "left").join(broadcast_if_small(dense.withColumn("dense", F.lit(True))), "node", "left")
    placed = placed.select("node", F.coalesce("component", "node").alias("c"), F.coalesce("dense", F.lit(False)).alias("dense"), F.explode(_poster(positions)("fp")).alias("key"))
    # a list inside one component has nothing to add, nor has one of texts whose sets are compared anyway
    lists = _lists(placed, F.min("c").alias("c1"), F.max("c").alias("c2"), F.bool_and("dense").alias("known"))
    lists = materialize(lists.filter("c1 != c2 AND NOT known"), "similar-lists")
    longer = materialize(lists.filter("n > 2").select("key", (F.col("n") > LONG_LIST).alias("long")), "similar-longer")
    members = materialize(placed.join(broadcast_if_small(longer), "key").filter("NOT (long AND dense)"), "similar-members")
    crowd = members.filter("long").select("node").distinct()
    members = members.filter("NOT long")
    sizes = members.groupBy("key", "c").agg(F.count("*").alias("m"))
    main = materialize(sizes.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main")), "similar-main")
    outside = members.join(main, "key").filter("c != main").select("key", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("dense").alias("dense_x"))
    rest = members.join(outside, "key").filter("c != cx AND NOT (dense AND dense_x)")
    rest = rest.select(*_ordered("node", "x"), "key").distinct().drop("key")
    rest = _often(rest.unionByName(_twos(lists)))
    crowd = materialize(dense.union(crowd), "similar-crowd")
    parts = None if crowd.isEmpty() else _parts(verify.sets(crowd))
    if parts is not None:
        among = _placed(parts, found)
        rest = rest.union(_rare_pairs(among, verify.similarity)).union(_frequent_pairs(among, verify.similarity, True)).distinct()
    rest = materialize(rest.join(tried, ["u", "v"], "left_anti"), "similar-rest")
    links = links.union(verify(rest))
    found = connected_components(links)
    if parts is not None:
        more = _frequent_pairs(_placed(parts, found), verify.similarity, False).join(tried.union(rest), ["u", "v"], "left_anti")
        found = connected_components(links.union(verify(more)))
        release(parts)
    release(lists, longer, members, main, crowd, dense, tried, rest)
    return found


def drop_similar(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    shingle_words: int = SHINGLE_WORDS,
    keys: int = KEYS,
    first_keys: int = FIRST_KEYS,
    key_bytes: int = KEY_BYTES,
    min_shared: int = MIN_SHARED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component of similar texts."""
    printed = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("text_key"), _printer(shingle_words, similarity)(F.col(text_col)).alias("p"))
    with text_batches(docs.sparkSession):
        rows = materialize(printed.select("id", "text_key", "p.node", "p.fp"), "similar-fp")
    classes = materialize(rows.groupBy("node").agg(F.min("fp").alias("fp")), "similar-classes")
    rows = rows.drop("fp")
    verify = _Verifier(docs, rows, classes, text_col, shingle_words, min_shared, similarity)
    with text_batches(docs.sparkSession):  # a row's keys are as large as a text
        found = _components(classes.filter("fp IS NOT NULL"), verify, key_positions(keys, key_bytes), first_keys)
    release(classes)
    return keep_one(docs, rows.join(found, "node", "left").select("id", "text_key", F.coalesce("component", "node").alias("component")), id_col, text_col)
