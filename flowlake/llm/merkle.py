"""Merkle manifest of a dataset with a proof for every document, found by pointer jumping.

A document is a leaf: SHA-256 over its fields, each written as its UTF-8 byte count, a colon and its
value, or ``-`` if null. The leaves of a source ascend by id; every ``ARITY`` consecutive nodes become
their digest until one is left, the source's subroot. Subroots, ordered by source, likewise give the root.

Positions come from a range partitioning by (source, id): a row's place in its source is its place in
the partition plus what earlier partitions hold of that source, so no task numbers a whole source.
Each level of all trees is one grouping by (tree, position div ARITY), of at most ARITY rows a group.

Each node starts with a segment of one entry, its siblings left and right of it, towards its parent. A
round joins the table with itself: a node that points d levels up takes the pointer of the node there,
appends that node's segment, and then points 2d levels up. So the rounds are the logarithm of the
height. After it only nodes at a multiple of 2d levels above the leaves can be pointed at, and the
others are dropped. A node d levels up is pointed at by ARITY ** d nodes, but there are as many times
fewer of them: either they are few enough to broadcast (checked), or so many that no join key holds
more than a small share of the rows.

A proof folds to the root: entry by entry the digest is put between its siblings and hashed again.
A leaf's proof holds (ARITY - 1) digests of 32 bytes a level, which is the size of the result.

Defined results for odd input
* A null id comes first in its source; rows of equal ids ascend by their leaf digest (equal rows are
  leaves of equal digests). A null source is a source of its own, before all others.
* A source of one document has its leaf as subroot; one source has its subroot as root. Their proofs
  lack those levels, and the proof of a single document is empty.
* A last run of fewer nodes is hashed as it is, even one node alone.
* An empty table gives an empty result. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import MAX_BROADCAST_ROWS, broadcast_if_small, materialize, release

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Number of the tree over the subroots; the trees of sources have their source's number.
TOP = -1
KEY = ["tree", "level", "pos"]
UP = ["up_tree", "up_level", "up_pos"]
SEGMENT = "array<struct<left: binary, right: binary>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    def written(x: Column) -> Column:
        value = x.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*[written(x) for x in fields])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof give."""
    text = lambda b: F.lower(F.hex(b))
    return F.aggregate(proof, leaf, lambda below, s: digest(text(s["left"]), below, text(s["right"])))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as hex."""
    return F.array_join(F.transform(proof, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Written ``rows`` with their position ``name`` from 0 among the rows of the same ``by``, ascending by ``order`` (nulls first), and ``size``, the number of those rows."""
    ascending = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    ranged = rows.repartitionByRange(*ascending).sortWithinPartitions(*ascending)
    placed = materialize(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "merkle-ordered")
    runs = placed.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)])
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "size": F.sum("__n").over(whole)})
    runs = runs.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{c}") for c in by], "__first", "__before", "size")
    runs = materialize(runs, "merkle-runs")
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), by, F.col("__part") == F.col("__p"))
    out = placed.join(broadcast_if_small(runs), same).withColumn(name, F.col("__at") - F.col("__first") + F.col("__before"))
    out = materialize(out.select(*rows.columns, name, "size"), "merkle-numbered")
    release(placed, runs)
    return out


def _grown(nodes: DataFrame) -> DataFrame:
    """One level up: the parents of nodes of one level, with their ``children`` in order. Only leaves have a document, ``doc``."""
    groups = nodes.groupBy("tree", F.expr(f"pos div {ARITY}").alias("up"), "size", "level").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "doc"))).alias("children"))
    inputs = F.array_join(F.transform("children", lambda c: c["digest"]), "")
    return groups.select(
        "tree", (F.col("level") + 1).alias("level"), F.col("up").alias("pos"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"),
        digest(inputs).alias("digest"), F.lit(None).cast(nodes.schema["doc"].dataType).alias("doc"), "children")


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The last nodes of all trees, and all written levels above ``nodes``."""
    largest, ended, levels = nodes.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0], [nodes.filter("size = 1")], []
    while largest > 1:
        levels.append(materialize(_grown(nodes.filter("size > 1")), "merkle-level"))
        nodes = levels[-1].drop("children")
        ended.append(nodes.filter("size = 1"))
        largest = -(-largest // ARITY)
    return reduce(DataFrame.unionByName, ended), levels


def _pointers(level: DataFrame) -> DataFrame:
    """Children of a written level: their key, the parent's key and a segment of one entry."""
    joined = lambda side: F.unhex(F.array_join(F.transform(F.filter("children", side), lambda c: c["digest"]), ""))
    rows = level.select("tree", "level", "pos", "size", "children", F.explode("children").alias("c"))
    top = (F.col("size") == 1) & (F.col("tree") != TOP)  # the last node of a source is a leaf of the top tree
    up = [F.when(top, TOP).otherwise(F.col("tree")).cast("long"), F.when(top, 0).otherwise(F.col("level")).cast("int"), F.when(top, F.col("tree")).otherwise(F.col("pos"))]
    entry = F.struct(joined(lambda c: c["pos"] < F.col("c.pos")).alias("left"), joined(lambda c: c["pos"] > F.col("c.pos")).alias("right"))
    return rows.select(
        "tree", (F.col("level") - 1).cast("int").alias("level"), F.col("c.pos").alias("pos"), "c.doc", F.col("c.digest").alias("digest"),
        *[u.alias(name) for u, name in zip(up, UP)], F.array(entry).cast(SEGMENT).alias("segment"))


def _jumped(pointers: DataFrame) -> DataFrame:
    """All leaves below the root with their segments up to it.

    A node that points at the root finds no pointer there: it is done, and others still join with it.
    """
    now, done, step, leaves = pointers, [], 1, F.col("doc").isNotNull()
    while True:
        there = reduce(DataFrame.unionByName, done, now)
        there = there.filter((F.col("tree") == TOP) | (F.col("level") >= step))
        far = there.select(*[F.col(k).alias(u) for k, u in zip(KEY, UP)], *[F.col(u).alias(f"next_{u}") for u in UP], F.col("segment").alias("rest"))
        asked = now.filter((F.col("tree") == TOP) | (F.col("level") % (2 * step) == 0))
        # a segment has at most 2 * step entries of some 100 bytes
        joined = asked.join(broadcast_if_small(far, MAX_BROADCAST_ROWS // (2 * step)), UP, "left")
        joined = joined.select(
            *KEY, "doc", "digest", *[F.col(f"next_{u}").alias(u) for u in UP],
            F.concat("segment", F.coalesce("rest", F.array().cast(SEGMENT))).alias("segment"))
        written = materialize(joined, "merkle-jump")
        done.append(written.filter(F.col("up_tree").isNull()))
        now, step = written.filter(F.col("up_tree").isNotNull()), 2 * step
        if now.isEmpty():
            return reduce(DataFrame.unionByName, [d.filter(leaves) for d in done])


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """id, source, leaf, subroot, root, proof of every document, and the columns ``carry`` computed from it.

    The documents are read once. A proof is a list of entries with the sibling digests left and right.
    """
    carry = carry or {}
    docs = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf_digest(*[F.col(f) for f in fields]).alias("leaf"), *[c.alias(f"carry_{n}") for n, c in carry.items()])
    leaves = materialize(docs, "merkle-leaves")
    sources = numbered(materialize(leaves.select("source").distinct(), "merkle-sources"), [], ["source"], "number")
    placed = numbered(leaves, ["source"], ["id", "leaf"], "pos")
    names = sources.select(F.col("source").alias("__source"), F.col("number").alias("tree"), F.col("size").alias("sources"))
    kept = F.struct("id", "source", *[f"carry_{n}" for n in carry])
    nodes = placed.join(broadcast_if_small(names), F.col("source").eqNullSafe(F.col("__source"))).select(
        "tree", F.lit(0).alias("level"), "pos", "size", F.col("leaf").alias("digest"), kept.alias("doc"), "sources")
    nodes = materialize(nodes, "merkle-nodes")
    release(leaves, placed)

    subroots, levels = _climb(nodes.drop("sources"))
    subroots = materialize(subroots.select("tree", "digest", "doc"), "merkle-subroots")
    count = sources.agg(F.count("*")).first()[0]
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("size"), "digest", "doc")
    root, above = _climb(top)
    levels += above
    root = materialize(root.select("digest", "doc"), "merkle-root")  # one row

    number = F.when(F.col("tree") == TOP, F.col("pos")).otherwise(F.col("tree"))
    proven = root.filter("doc IS NOT NULL").select("doc", F.col("digest").alias("leaf"), F.lit(0).cast("long").alias("number"), F.array().cast(SEGMENT).alias("proof"))
    if levels:
        pointers = materialize(reduce(DataFrame.unionByName, [_pointers(x) for x in levels]), "merkle-jump")
        jumped = _jumped(pointers)
        release(pointers)
        proven = proven.unionByName(jumped.select("doc", F.col("digest").alias("leaf"), number.alias("number"), F.col("segment").alias("proof")))
    release(nodes, *levels)
    below = subroots.select(F.col("tree").alias("number"), F.col("digest").alias("subroot"))
    out = proven.join(broadcast_if_small(below), "number").crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))
    return out.select(
        F.col("doc.id").alias(id_col), F.col("doc.source").alias(source_col), "leaf", "subroot", "root", "proof", *[F.col(f"doc.carry_{n}").alias(n) for n in carry])
