from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlake.llm import merkle


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return sha(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle.FIELDS])


def grow(nodes):
    """(root, proof of each node as a list of (left, right)) of digests in order."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, own in enumerate(at):
            run = nodes[own // 3 * 3 : own // 3 * 3 + 3]
            proofs[i].append(("".join(run[: own % 3]), "".join(run[own % 3 + 1 :])))
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [own // 3 for own in at]
    return nodes[0], proofs


def brute(rows):
    """Counter of (id, leaf, subroot, root, proof) of all rows."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, found = [], []
    for s in order:
        docs = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)) for r in by[s]))
        subroot, proofs = grow([d[2] for d in docs])
        subs.append(subroot)
        found.append([(None if not d[0] else d[1], d[2], subroot, p) for d, p in zip(docs, proofs)])
    root, tops = grow(subs)
    return Counter((i, leaf, sub, root, tuple(p + top)) for docs, top in zip(found, tops) for i, leaf, sub, p in docs)


def proven(df):
    text = lambda b: bytes(b).hex()
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((text(e["left"]), text(e["right"])) for e in r["proof"])) for r in df.collect())


def test_odd_rows(odd, none):
    found = merkle.manifest(odd)
    assert proven(found) == brute(odd.collect())
    assert found.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert merkle.manifest(none).count() == 0


@pytest.mark.parametrize("sizes", [[1], [3], [1, 1], [28, 1, 5], [82, 1, 1, 10]])
def test_shapes_of_trees(spark, sizes):
    rows = [(i * 100 + j, f"s{i}", None, j, f"text {i} {j}") for i, n in enumerate(sizes) for j in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert proven(merkle.manifest(df)) == brute(df.collect())


def test_hot_source_and_joins_without_broadcast(spark, monkeypatch):
    """One source with most rows; all joins shuffled."""
    df = spark.range(3000).select(
        (F.col("id") * 7919 % 3001).alias("doc_id"), F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.concat(F.lit("t"), F.col("id") % 50).alias("text"))
    monkeypatch.setattr(merkle, "broadcast_if_small", lambda df, *_: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert proven(merkle.manifest(df)) == brute(df.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_changes_are_found(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"text {i}\nmore") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    changed = F.when(F.col("doc_id") == 17, F.lit("other")).otherwise(F.col("text"))
    presented = merkle.leaf_digest(*[changed if f == "text" else F.col(f) for f in merkle.FIELDS])
    found = merkle.manifest(df, carry={"presented": presented})
    bad = found.filter(merkle.fold(F.col("presented"), F.col("proof")) != F.col("root")).collect()
    assert [r["doc_id"] for r in bad] == [17]
